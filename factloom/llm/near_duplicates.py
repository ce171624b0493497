"""Near duplicates by MinHash with sequential Bayesian verification.

A document's set is that of its k-word shingles (A-Z as a-z); documents link where 100 * intersection >=
percent * union, and a component's least id names it. The steps:

1. sketch: the set's size, a 128-bit digest of it and HASHES minima. Documents of one digest have the same set and
   are one class from here on, named by its least id, so exact copies cost a row each and no pairs.
2. candidates: bands of the minima, as many rows a band as leave a pair at the threshold unseen with a chance below
   MISSED. Buckets of one class are dropped.
3. first round: every member of a bucket is compared with the bucket's hub, the member that shares most with others.
   That is at most one pair for each row of the bands, however large a bucket.
4. second round: only buckets that still hold several components. Their pairs across components are compared: by a
   join in small buckets, in blocks of bounded size in large ones, where what leaves a block is a forest of links.

A comparison looks at the minima in batches and stops when the posterior chance (uniform prior) that the similarity
attains the threshold is below PRUNED; survivors are confirmed on the full sets. Every pair that shares a bucket is
either compared or already in one component, so no link between different texts is lost but by the two chances.

Defined results: texts of fewer words than k have the sequence of all words as their one shingle; without words the
set is empty and links with nothing. Rows of one id are one document. A null id links with nothing: its component is
null, and it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, hashed_words, mix64, row_blocks, shingled, string_bytes
from factloom.llm.graph import components

HASHES = 128
LOOKS = (32, 64, 96, 128)
MISSED = 1e-6
PRUNED = 1e-7
#: Members of a bucket up to which the second round compares by a join, and rows of a block beyond.
SMALL = 48
BLOCK = 256
#: Members that are compared with one copy of their hub.
STAR = 512


def band_rows(percent: int) -> int:
    """The most rows a band that leave a pair at the threshold unseen with a chance of at most MISSED."""
    return max(r for r in range(1, HASHES + 1) if r == 1 or (1 - (percent / 100) ** r) ** (HASHES // r) <= MISSED)


def least_matches(percent: int) -> list[int]:
    """For each look, the matches below which P(similarity >= threshold | matches) < PRUNED.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial's lower one.
    """
    t, out = percent / 100, []
    for n in LOOKS:
        tail, m = 0.0, -1
        while tail < PRUNED:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash), distinct and sorted, of a block of texts."""
    words, rows, _, _ = hashed_words(data, offsets)
    shingles, at = shingled(words, rows, k)
    owner = rows[at]
    count = np.bincount(rows, minlength=len(offsets) - 1)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.searchsorted(rows, few)
        with np.errstate(over="ignore"):
            h = count[few].astype(np.uint64)
            for i in range(k - 1):
                more = count[few] > i
                h[more] = mix64(h[more] * np.uint64(0x2545F4914F6CDD1D) + words[first[more] + i])
        shingles, owner = np.concatenate((shingles, h)), np.concatenate((owner, few))
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], shingles[new]


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), digest and minima (null without words) for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients()
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            n = np.zeros(batch.num_rows, np.int64)
            digests: list[bytes | None] = [None] * batch.num_rows
            minima: list[bytes | None] = [None] * batch.num_rows
            for first, last in row_blocks(offsets):
                owner, x = sets_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], k)
                if not len(owner):
                    continue
                starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                rows = owner[starts] + first
                n[rows] = np.diff(np.append(starts, len(owner)))
                digest = np.stack([np.add.reduceat(mix64(x + np.uint64(c)), starts) for c in (1, 2)], axis=1)
                low = (x >> np.uint64(32)).astype(np.uint32)
                m = np.stack([np.minimum.reduceat(low * p + q, starts) for p, q in zip(a, b, strict=True)], axis=1)
                for i, r in enumerate(rows.tolist()):
                    digests[r], minima[r] = digest[i].tobytes(), m[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(digests, pa.binary()), pa.array(minima, pa.binary())], names=["doc_id", "n", "digest", "minima"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, digest binary, minima binary")


def banded(classes: DataFrame, percent: int) -> DataFrame:
    """bucket, id: a row for each band of classes(id, minima)."""
    r = band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint64)
            ids = batch.column(0).to_numpy()
            for band in range(HASHES // r):
                h = np.full(len(m), band + 1, np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(band * r, band * r + r):
                        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + m[:, i])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids)], names=["bucket", "id"])

    return classes.select("id", "minima").mapInArrow(run, "bucket long, id long")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """id, set (sorted 64-bit hashes) for every row of docs(doc_id, text) with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for first, last in row_blocks(offsets):
                owner, x = sets_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], k)
                starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
                parts = [p.tobytes() for p in np.split(x, starts[1:])] if len(owner) else []
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner[starts] + first], pa.int64()), pa.array(parts, pa.binary())], names=["id", "set"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "id long, set binary")


def passes(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of minima a and b (or one row and many) survive the sequential test."""
    n = max(len(a), len(b))
    alive, matches, done = np.arange(n), np.zeros(n, np.int64), 0
    a, b = np.broadcast_to(a, (n, HASHES)), np.broadcast_to(b, (n, HASHES))
    for look, needed in zip(LOOKS, least, strict=True):
        matches[alive] += (a[alive, done:look] == b[alive, done:look]).sum(axis=1)
        alive, done = alive[matches[alive] >= needed], look
    out = np.zeros(n, bool)
    out[alive] = True
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted, distinct) attain the threshold."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _compared(pairs: DataFrame, payload: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(hub, id) that payload(id, data) confirms: data are minima (column `minima`) or sets (`set`).

    Members stream past their hub: a hub is sent once for about STAR members, not once for each.
    """
    exact = "set" in payload.columns
    payload = payload.withColumnRenamed("set" if exact else "minima", "data")
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    pairs = pairs.join(parts, "hub").select("hub", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    members = pairs.join(payload, "id").select("hub", "part", F.lit(1).alias("kind"), "id", "data")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    hubs = hubs.join(payload, hubs["hub"] == payload["id"]).select("hub", "part", F.lit(0).alias("kind"), "id", "data")
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_of = [], None  # the hub's data; several if rows of one id differ
        for batch in batches:
            hub, kind, ids, data = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            out_hub, out_id = [], []
            at = 0
            while at < len(hub):
                if kind[at] == 0:
                    x = np.frombuffer(data[at], np.uint64 if exact else np.uint32)
                    own, own_of = ([*own, x] if own_of == hub[at] else [x]), hub[at]
                    at += 1
                    continue
                end = at
                while end < len(hub) and kind[end] == 1 and hub[end] == hub[at]:
                    end += 1
                ok = np.zeros(end - at, bool)
                if own_of == hub[at]:
                    for x in own:
                        if exact:
                            ok |= np.array([linked(x, np.frombuffer(d, np.uint64), percent) for d in data[at:end]])
                        else:
                            ok |= passes(x[None, :], np.frombuffer(b"".join(data[at:end]), np.uint32).reshape(-1, HASHES), least)
                out_hub += [hub[at]] * int(ok.sum())
                out_id += [i for i, yes in zip(ids[at:end], ok.tolist(), strict=True) if yes]
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(out_hub, pa.int64()), pa.array(out_id, pa.int64())], names=["hub", "id"])

    rows = hubs.union(members).repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
    return rows.mapInArrow(run, "hub long, id long").distinct()


def _forest(ids: np.ndarray, roots: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Of pairs (places in ids), those that join different components, as a forest."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    out = []
    for i, j in pairs.tolist():
        a, b = find(int(roots[i])), find(int(roots[j]))
        if a != b:
            up[a] = b
            out.append((int(ids[i]), int(ids[j])))
    return out


def compare_block(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between rows of two blocks (id, root, minima, set) of different roots."""
    least = least_matches(percent)
    ids = np.concatenate((left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)))
    roots = np.concatenate((left["root"].to_numpy(np.int64), right["root"].to_numpy(np.int64)))
    minima = [np.frombuffer(b"".join(x["minima"]), np.uint32).reshape(-1, HASHES) for x in (left, right)]
    sets = [np.frombuffer(s, np.uint64) for x in (left, right) for s in x["set"]]
    found = []
    for i in range(len(left)):
        other = np.flatnonzero((roots[len(left) :] != roots[i]) & (ids[len(left) :] != ids[i]))
        if len(other):
            other = other[passes(minima[0][i][None, :], minima[1][other], least)]
            found += [(i, len(left) + j) for j in other.tolist() if linked(sets[i], sets[len(left) + j], percent)]
    return _forest(ids, roots, np.array(found, np.int64).reshape(-1, 2))


def _across(members: DataFrame, labels: DataFrame, payload: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (hub, id) between components that share buckets of members(bucket, id)."""
    m = members.join(labels, members["id"] == labels["node"], "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    per_root = m.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = per_root.groupBy("bucket").agg(F.count("*").alias("roots"), F.sum("n").alias("size"), F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"))
    m = scratch.keep(m.join(mixed.where("roots > 1").drop("roots"), "bucket"))
    small = m.where(F.col("size") <= SMALL).select("bucket", "id", "root")
    a, b = (small.select("bucket", F.col("id").alias(x), F.col("root").alias(f"{x}_root")) for x in ("hub", "id"))
    pairs = a.join(b, "bucket").where("hub < id and hub_root <> id_root").select("hub", "id").distinct()
    pairs = scratch.keep(_compared(scratch.keep(pairs), payload.select("id", "minima"), percent))
    links = _compared(pairs, payload.select("id", "set"), percent)
    # large buckets: blocks of the main component, blocks of the rest; the rest meets all
    large = m.where(F.col("size") > SMALL)
    if large.isEmpty():
        return links
    is_main = F.col("root") == F.col("main")
    main_blocks, rest_blocks = (F.ceil(n / BLOCK).cast("int") for n in (F.col("most"), F.col("size") - F.col("most")))
    block = F.pmod(F.xxhash64("id"), F.when(is_main, main_blocks).otherwise(rest_blocks)).cast("int")
    large = large.select("bucket", "id", "root", is_main.alias("main"), block.alias("block"), main_blocks.alias("mains"), rest_blocks.alias("rests"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.col("block")
    # a cell (i, j, main): rest block i with main block j, or with rest block j >= i; side 0 is i's
    as_rest = F.concat(
        F.transform(upto(F.col("mains")), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("with_main"), F.lit(0).alias("side"))),
        F.transform(F.sequence(own, F.col("rests") - 1), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(False).alias("with_main"), F.lit(0).alias("side"))),
        F.transform(F.sequence(F.lit(0), own), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("with_main"), F.lit(1).alias("side"))),
    )
    as_main = F.transform(upto(F.col("rests")), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(True).alias("with_main"), F.lit(1).alias("side")))
    cells = large.select("bucket", "id", "root", F.explode(F.when(F.col("main"), as_main).otherwise(as_rest)).alias("c")).select("bucket", "id", "root", "c.*")

    def cell(rows: pd.DataFrame) -> pd.DataFrame:
        found = compare_block(rows[rows["side"] == 0], rows[rows["side"] == 1], percent)
        return pd.DataFrame(found, columns=["hub", "id"])

    found = cells.join(payload, "id").groupBy("bucket", "i", "j", "with_main").applyInPandas(cell, "hub long, id long")
    return links.union(found)


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    rows = scratch.keep(sketches(docs, k))
    grouped = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("minima").alias("minima"))
    classes = scratch.keep(grouped)
    members = banded(classes, percent)
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.keep(members.join(shared, "bucket"))
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    sets = shingle_sets(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), k)
    payload = scratch.keep(sets.join(classes.select("id", "minima"), "id"))
    mass = members.groupBy("id").agg(F.sum("size").alias("mass"))
    hubs = members.join(mass, "id").groupBy("bucket").agg(F.max_by("id", F.struct("mass", -F.col("id"))).alias("hub"))
    pairs = scratch.keep(members.join(hubs, "bucket").where("id <> hub").select("hub", "id").distinct())
    pairs = scratch.keep(_compared(pairs, payload.select("id", "minima"), percent))
    links = scratch.keep(_compared(pairs, payload.select("id", "set"), percent))
    edges = lambda x: x.select(F.col("hub").alias("a"), F.col("id").alias("b"))
    labels = components(edges(links), scratch)
    more = scratch.keep(_across(members.select("bucket", "id"), labels, payload, percent, scratch))
    labels = components(edges(links.union(more)), scratch)
    named = classes.join(labels, classes["id"] == labels["node"], "left").select("digest", F.coalesce("root", "id").alias("component_id"))
    out = rows.join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each component, with docs' own columns, and every row of null id.

    A component's row is one of its least id; of several rows of that id the one of least hash stays. The choice is an
    aggregate, combined before the shuffle, so an id with a third of all rows costs one row a task.
    """
    names = docs.columns
    kept = near_duplicates(docs, **options).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), row.alias("_row"), F.xxhash64(*hashed).alias("_hash"))
    unnamed = F.when(F.col("_id").isNull(), F.monotonically_increasing_id()).alias("_unnamed")
    one = rows.select("*", unnamed).join(kept.withColumn("_stays", F.lit(True)), "_id", "left").where("_id is null or _stays")
    one = one.groupBy("_id", "_unnamed").agg(F.min_by("_row", "_hash").alias("_row"))
    return one.select("_row.*")
