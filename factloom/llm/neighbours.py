"""Approximate nearest neighbours by inner product: a robust-pruned directed graph a shard, beam search in each.

Vectors are dealt to shards by a salt, each small enough for one task. A shard's task builds its graph in batches that
double: the batch searches the graph so far, what its searches met is pruned to at most DEGREE edges (a candidate goes
when some kept neighbour is closer to it, by the factor `relaxed`, than the node is), and the edges are added in reverse
and pruned again where a node has too many. The index is a table, a row for each distinct vector of a shard with the
ids that have it and its edges. Every query searches every shard with a beam, and a window merges what they found.

Nearest by inner product is made nearest by distance: vectors are divided by the largest norm, and one more component
gives all of them norm 1; a query has 0 there. Scores are those of the original vectors, summed in double precision in
the order of the components.

There are SHARDS shards, or more if one would have over SHARD_ROWS vectors; a task holds a shard, its graph and, when
searching, QUERIES queries. Nothing is broadcast and nothing passes the driver but the table's size, width and norm.

Defined results: rows whose id is null, whose vector is null, all zero or empty, or holds a null, NaN or infinity take
no part. Shorter vectors count as padded with zeros. Equal vectors are one node of a shard, so that copies can't crowd
out its edges; all their ids are candidates, and of equal scores the smaller ids win. A query leaves out every row of
its own id; of several vectors of one id the least asks. Ids that occur twice are candidates twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import Scratch

SHARDS = 8
SHARD_ROWS = 262_144
QUERIES = 16_384
#: Edges of a node, and the factor by which pruning is relaxed.
DEGREE, RELAXED = 32, 1.2
#: Width of the beam that builds and of the one that searches, and how many of its nodes a step expands.
BUILD_BEAM, BEAM, EXPAND = 64, 96, 4
#: Queries that are searched for at once, and marks (queries x nodes) that they may take.
TOGETHER, MARKS = 512, 1 << 26
#: Nodes of the largest norms where searches begin, besides the one nearest to the mean.
STARTS = 63


def beam_search(graph: np.ndarray, vectors: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the best `beam` nodes met, best first; -1 where fewer were met.

    graph: nodes x degree, -1 for no edge. Every step expands the EXPAND best nodes that aren't yet, until all are.
    """
    m, degree = len(queries), graph.shape[1]
    seen = np.zeros((m, len(vectors)), bool)
    seen[:, starts] = True
    first = queries @ vectors[starts].T
    nodes, scores, open_ = (np.full((m, beam), v) for v in (np.int64(-1), np.float32(-np.inf), False))
    order = np.argsort(-first, 1, kind="stable")[:, :beam]
    nodes[:, : order.shape[1]], scores[:, : order.shape[1]], open_[:, : order.shape[1]] = starts[order], np.take_along_axis(first, order, 1), True
    live = np.arange(m)
    while len(live):
        pick = np.argsort(~open_[live], 1, kind="stable")[:, :EXPAND]
        expand = np.where(np.take_along_axis(open_[live], pick, 1), np.take_along_axis(nodes[live], pick, 1), -1)
        open_[live[:, None], pick] = False
        near = np.where(expand[:, :, None] >= 0, graph[expand], -1).reshape(len(live), -1)
        near.sort(1)
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new)
        node = near[row, col]
        fresh = ~seen[live[row], node]
        row, col, node = row[fresh], col[fresh], node[fresh]
        seen[live[row], node] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[row, col] = np.einsum("ij,ij->i", vectors[node], queries[live[row]])
        all_scores = np.concatenate((scores[live], found), 1)
        top = np.argpartition(-all_scores, beam - 1, 1)[:, :beam]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(all_scores, top, 1), 1, kind="stable"), 1)
        scores[live] = np.take_along_axis(all_scores, top, 1)
        nodes[live] = np.where(np.isfinite(scores[live]), np.take_along_axis(np.concatenate((nodes[live], near), 1), top, 1), -1)
        open_[live] = np.take_along_axis(np.concatenate((open_[live], np.isfinite(found)), 1), top, 1)
        live = live[open_[live].any(1)]
    return nodes, scores


def robust_prune(vectors: np.ndarray, at: np.ndarray, near: np.ndarray, degree: int = DEGREE, relaxed: float = RELAXED) -> np.ndarray:
    """At most `degree` diverse neighbours of each node of `at` among its row of near (-1: none, no row names a node
    twice): the nearest is kept, and what it is closer to than at / relaxed goes; and so on. Edges still free after
    that take the nearest of those that went: next to vectors of very uneven norms few are diverse."""
    m = len(at)
    out = np.full((m, degree), -1, np.int64)
    to = np.where(near >= 0, 1 - np.einsum("ijk,ik->ij", vectors[near], vectors[at]), np.inf)
    to[near == at[:, None]] = np.inf
    order = np.argsort(to, 1, kind="stable")
    near, to = np.take_along_axis(near, order, 1), np.take_along_axis(to, order, 1)
    points = vectors[near]
    among = 1 - points @ points.transpose(0, 2, 1)
    left = np.isfinite(to)
    rows = np.arange(m)
    for k in range(degree):
        pick = left.argmax(1)
        has = left[rows, pick]
        if not has.any():
            break
        out[has, k] = near[rows, pick][has]
        left &= ~(has[:, None] & (relaxed**2 * among[rows, pick] <= to))
        left[rows, pick] = False
        near[rows[has], pick[has]], to[rows[has], pick[has]] = -1, np.inf
    free = (out < 0).sum(1)
    rest = np.argsort(to, 1, kind="stable")[:, :degree]
    rest = np.where(np.isfinite(np.take_along_axis(to, rest, 1)), np.take_along_axis(near, rest, 1), -1)
    row, place = np.nonzero(out < 0)
    at_rest = place - (degree - free)[row]
    ok = at_rest < rest.shape[1]
    out[row[ok], place[ok]] = rest[row[ok], at_rest[ok]]
    return out


def _add_reverse(graph: np.ndarray, vectors: np.ndarray, batch: np.ndarray) -> None:
    """The edges of the batch's nodes, in the other direction too."""
    degree = graph.shape[1]
    source = np.repeat(batch, degree)
    target = graph[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    known = (graph[target] == source[:, None]).any(1)
    source, target = source[~known], target[~known]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    room = (graph[nodes] < 0).sum(1)
    fits = count <= room
    place = np.arange(len(target)) - np.repeat(first, count)
    easy = np.repeat(fits, count)
    graph[target[easy], degree - np.repeat(room, count)[easy] + place[easy]] = source[easy]
    # the others are pruned, those with about as many candidates together
    for full in np.array_split(crowded := np.flatnonzero(~fits)[np.argsort(count[~fits], kind="stable")], max(1, -(-len(crowded) // 128))):
        if len(full):
            wide = int(count[full].max())
            new = np.full((len(full), wide), -1, np.int64)
            for i, f in enumerate(full):
                new[i, : count[f]] = source[first[f] : first[f] + count[f]]
            graph[nodes[full]] = robust_prune(vectors, nodes[full], np.concatenate((graph[nodes[full]], new), 1), degree)


def start_nodes(vectors: np.ndarray) -> np.ndarray:
    """Where searches begin: the node nearest to the mean, and STARTS of the largest norms, which are far from all
    others but first in many answers."""
    mean = int(np.argmax(vectors @ vectors.mean(0)))
    large = np.argsort(vectors[:, -1], kind="stable")[:STARTS]
    return np.concatenate(([mean], large[large != mean]))


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> np.ndarray:
    """Edges (nodes x degree, -1 for none) over vectors of norm 1, no two equal."""
    n = len(vectors)
    graph = np.full((n, degree), -1, np.int64)
    start = start_nodes(vectors)
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate((start, order[~np.isin(order, start)]))
    done = 1
    while done < n:
        batch = order[done : done + min(done, max(64, n // 50), 2048)]
        for at in range(0, len(batch), 256):
            part = batch[at : at + 256]
            met, _ = beam_search(graph, vectors, order[: min(done, len(start))], vectors[part], beam)
            graph[part] = robust_prune(vectors, part, met, degree)
        _add_reverse(graph, vectors, batch)
        done += len(batch)
    return graph


def scores_of(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, added up in the order of the components."""
    out = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        out += queries[:, d] * vectors[:, d]
    return out


def unit(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Vectors of norm 1 with one component more, whose distances to (query, 0) order as the inner products do."""
    small = vectors / largest
    rest = np.sqrt(np.maximum(0, 1 - (small * small).sum(1)))
    return np.concatenate((small, rest[:, None]), 1).astype(np.float32)


def asked(queries: np.ndarray) -> np.ndarray:
    """Queries of norm 1, with 0 for the component that unit() adds."""
    q = queries / np.abs(queries).max(1, keepdims=True)
    q /= np.sqrt((q * q).sum(1, keepdims=True))
    return np.concatenate((q, np.zeros((len(q), 1))), 1).astype(np.float32)


def search_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, starts: np.ndarray, vectors: np.ndarray, graph: np.ndarray, largest: float, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best rows found for each query. ids[starts[i]:starts[i + 1]], ascending, have
    vectors[i]."""
    points, out = unit(vectors, largest), []
    first = start_nodes(points)
    own: dict[int, set[int]] = {}
    at = np.flatnonzero(np.isin(ids, query_ids))
    for i, node in zip(ids[at].tolist(), (np.searchsorted(starts, at, "right") - 1).tolist(), strict=True):
        own.setdefault(i, set()).add(node)
    count = np.minimum(np.diff(starts), k)
    together = max(1, min(TOGETHER, MARKS // len(vectors)))
    for a in range(0, len(queries), together):
        q, names = queries[a : a + together], query_ids[a : a + together]
        nodes, _ = beam_search(graph, points, first, asked(q), max(beam, 2 * k))
        row, col = np.nonzero(nodes >= 0)
        node = nodes[row, col]
        score = scores_of(q[row], vectors[node])
        mine = np.array([n in own.get(i, ()) for i, n in zip(names[row].tolist(), node.tolist(), strict=True)], bool)
        take = np.where(mine, 0, count[node])
        place = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        found = [(np.repeat(row, take), ids[np.repeat(starts[node], take) + place], np.repeat(score, take))]
        for i in np.flatnonzero(mine):  # copies of the query's vector, without the query's own rows
            others = ids[starts[node[i]] : starts[node[i] + 1]]
            others = others[others != names[row[i]]][:k]
            found.append((np.full(len(others), row[i]), others, np.full(len(others), score[i])))
        row, name, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((name, -score, row))
        row, name, score = row[order], name[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        out.append((names[row[rank < k]], name[rank < k], score[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width))
    lengths = np.diff(column.offsets.to_numpy())
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def usable(vectors: DataFrame, is_query: Column) -> DataFrame:
    """vec_id, v and whether it asks, of the rows that take part."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    return rows.where(~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda x: x != 0))


def build_index(rows: DataFrame, shards: int, width: int, largest: float) -> DataFrame:
    """shard, node, ids, v, edges: a row for each distinct vector of a shard, kept in the shared folder."""

    def graph_of(group: pa.Table) -> pa.Table:
        ids, vectors = group.column("vec_id").to_numpy(), _matrix(group.column("v"), width) + 0.0  # no -0
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, at, of = np.unique(np.ascontiguousarray(vectors).view([("", f"V{8 * width}")]).ravel(), return_index=True, return_inverse=True)
        by_id = np.argsort(at)  # nodes in the order of their first ids, not of their bytes
        place = np.empty(len(at), np.int64)
        place[by_id] = np.arange(len(at))
        of = place[of.ravel()]
        members = np.argsort(of, kind="stable")
        vectors = vectors[at[by_id]]
        n = len(vectors)
        graph = build(unit(vectors, largest))
        offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32)
        has = graph >= 0
        edges = np.concatenate(([0], np.cumsum(has.sum(1)))).astype(np.int32)
        return pa.table({
            "shard": pa.repeat(group.column("shard")[0], n),
            "node": pa.array(np.arange(n, dtype=np.int32)),
            "ids": pa.ListArray.from_arrays(offsets, ids[members]),
            "v": pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), vectors.ravel()),
            "edges": pa.ListArray.from_arrays(edges, graph[has].astype(np.int32)),
        })

    salted = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
    built = salted.groupBy("shard").applyInArrow(graph_of, "shard int, node int, ids array<long>, v array<double>, edges array<int>")
    return Scratch(rows.sparkSession, "neighbours").keep(built)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows found for each row that is_query holds for."""
    rows = usable(vectors, is_query)
    most = F.array_max(F.transform("v", F.abs))
    norm = most * F.sqrt(F.aggregate(F.transform("v", lambda x: (x / most) * (x / most)), F.lit(0.0), lambda a, x: a + x))
    n, asking, width, largest = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v")), F.max(F.least(norm, F.lit(1e300)))).first()
    shards, blocks = max(SHARDS, -(-n // SHARD_ROWS)), max(1, -(-asking // QUERIES))
    width, largest = width or 1, largest or 1.0
    index = build_index(rows, shards, width, largest)
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    queries = rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), spread(shards).alias("shard"))
    index = index.withColumn("block", spread(blocks))

    def cell(q: pa.Table, index: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if q.num_rows and index.num_rows:
            index = index.sort_by("node")
            ids, edges = (index.column(c).combine_chunks() for c in ("ids", "edges"))
            graph = np.full((index.num_rows, DEGREE), -1, np.int64)
            graph[np.arange(DEGREE) < np.diff(edges.offsets.to_numpy())[:, None]] = edges.flatten().to_numpy()
            starts = np.concatenate(([0], np.cumsum(np.diff(ids.offsets.to_numpy()))))
            found = search_shard(q.column("vec_id").to_numpy(), _matrix(q.column("v"), width), ids.flatten().to_numpy(), starts, _matrix(index.column("v"), width), graph, largest, k, beam)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    found = queries.groupBy("block", "shard").cogroup(index.groupBy("block", "shard")).applyInArrow(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
