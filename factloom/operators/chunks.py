"""Semantic chunks: eligibility, redaction, line windows, projection, retrieval."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import redact_secrets, short_hash, trimmed, usable_vector

#: Vectors in a block of queries, and of those searched; queries that are scored at a time.
QUERIES = 4096
VECTORS = 32768
STRIP = 64
#: What a matrix product's cosine may be off from the one added up in order, with room to spare.
NEAR = 1e-9
#: Folders and files that never become chunks, and what makes code explanatory.
EXCLUDED = r"(^|/)(\.git|\.next|build|coverage|dist|node_modules|target)(/|\z)"
SECRET_FILE = r"(^|/)(\.env|id_rsa|id_ed25519)(\.|\z)"
EXPLANATORY = r"(^|\n)\s*(//|/\*|\*|#)|\b(class|interface|function|fun|public|private|protected|export|async)\b"


def eligibility(path: Column, kind: Column, content: Column) -> Column:
    """Why a source becomes chunks; null if it doesn't."""
    size = F.length(trimmed(content))
    barred = path.rlike(EXCLUDED) | path.rlike(SECRET_FILE)
    return F.when(barred, None).when((kind == "documentation") & (size >= 40), "explanatory Markdown section").when((kind == "code") & (size >= 80) & content.rlike(EXPLANATORY), "explanatory source span")


def windows(content: Column, most: int = 1800, overlap: int = 3) -> Column:
    """Windows of whole lines of at most `most` characters; the next repeats the last `overlap` lines."""
    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("done"), empty.alias("lines"), F.lit(0).alias("length"))

    def step(acc: Column, line: Column) -> Column:
        full = (F.size(acc["lines"]) > 0) & (acc["length"] + F.length(line) + 1 > most)
        tail = F.slice(acc["lines"], F.greatest(F.size(acc["lines"]) - overlap + 1, F.lit(1)), F.lit(overlap))
        return F.when(
            full,
            F.struct(F.array_append(acc["done"], trimmed(F.array_join(acc["lines"], "\n"))).alias("done"), F.array_append(tail, line).alias("lines"), (F.length(F.array_join(tail, "\n")) + F.length(line) + 1).alias("length")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.array_append(acc["lines"], line).alias("lines"), (acc["length"] + F.length(line) + 1).alias("length")))

    def finish(acc: Column) -> Column:
        last = trimmed(F.array_join(acc["lines"], "\n"))
        return F.when(last != "", F.array_append(acc["done"], last)).otherwise(acc["done"])

    return F.aggregate(F.split(content, "\n"), zero, step, finish)


def chunk(sources: DataFrame, most: int = 1800) -> DataFrame:
    """id, source_id, position, content, checksum, redactions for sources(source_id, path, kind, content)."""
    clean = sources.where(eligibility(F.col("path"), F.col("kind"), F.col("content")).isNotNull()).select("source_id", "kind", redact_secrets(F.col("content")).alias("r"))
    cut = clean.select("source_id", "kind", F.col("r.count").alias("redactions"), F.posexplode(windows(F.col("r.content"), most)).alias("position", "content"))
    name = F.concat(F.col("source_id"), F.lit("#chunk-"), F.col("position"))
    return cut.select(F.concat(F.lit("semantic:"), short_hash(F.col("kind"), name, separator="\0")).alias("id"), "source_id", "position", "content", F.sha2("content", 256).alias("checksum"), "redactions")


def project(existing: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """id and action (embed, retain, stale) from existing(id, checksum, model) and chunks(id, checksum)."""
    old = existing.select("id", F.col("checksum").alias("old"), F.col("model").alias("old_model"))
    both = chunks.select("id", "checksum").join(old, "id", "full_outer")
    same = (F.col("checksum") == F.col("old")) & (F.col("old_model") == model)
    return both.select("id", F.when(F.col("checksum").isNull(), "stale").when(F.coalesce(same, F.lit(False)), "retain").otherwise("embed").alias("action"))


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, added up in the order of the components: equal rows give equal sums,
    wherever they stand, which a matrix product doesn't promise."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def search_block(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector (places) and similarity (NaN where a norm is 0) of the k best vectors of each query, the first
    of equal ones.

    A matrix product finds what may be among the k best, NEAR below the last of them included; those are summed again
    in order and ranked by the exact doubles. Equal vectors are one column, and stand for their first k places.
    """
    width = vectors.shape[1]
    _, first, of = np.unique(np.ascontiguousarray(vectors + 0.0).view([("", f"V{8 * width}")]).ravel(), return_index=True, return_inverse=True)
    members = np.argsort(of.ravel(), kind="stable")
    count = np.bincount(of.ravel(), minlength=len(first))
    starts, distinct = np.cumsum(count) - count, vectors[first]
    norms, out = np.sqrt(_sums(distinct, distinct)), []
    for at in range(0, len(queries), STRIP):
        q = queries[at : at + STRIP]
        own = np.sqrt(_sums(q, q))
        with np.errstate(invalid="ignore", divide="ignore"):
            x = (q @ distinct.T) / (own[:, None] * norms)
        x = np.where(np.isfinite(x), x, -2.0)
        least = np.partition(x, x.shape[1] - k, axis=1)[:, -k] if x.shape[1] > k else np.full(len(q), -2.0)
        row, col = np.nonzero(x >= least[:, None] - NEAR)
        with np.errstate(invalid="ignore", divide="ignore"):
            exact = _sums(q[row], distinct[col]) / (own[row] * norms[col])
        take = np.minimum(count[col], k)
        place = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        row, name, exact = np.repeat(row, take), members[np.repeat(starts[col], take) + place], np.repeat(exact, take)
        order = np.lexsort((name, np.where(np.isfinite(exact), -exact, np.inf), row))
        row, name, exact = row[order], name[order], exact[order]
        best = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
        out.append((row[best] + at, name[best], np.where(np.isfinite(exact[best]), exact[best], np.nan)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def semantic_search(queries: DataFrame, vectors: DataFrame, k: int = 8) -> DataFrame:
    """query_id, rank, id, similarity: the k rows of vectors(id, embedding) most like each of queries(query_id, query),
    by the exact doubles of their cosines; only equal ones are in order of id.

    Queries and vectors of one length lie in blocks of bounded size; a task has one block of each and keeps k a
    query, and a window merges the blocks, so neither side is broadcast or limited.
    """
    asking = queries.select("query_id", F.col("query").cast("array<double>").alias("v"))
    usable = vectors.where(usable_vector(F.col("embedding"))).select("id", F.col("embedding").cast("array<double>").alias("v"))
    query_blocks, n = -(-asking.count() // QUERIES), usable.count()
    # more blocks than VECTORS asks for while there are few, for parallel work
    blocks = max(-(-n // VECTORS), min(int(usable.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 4096)), 1)
    # dealt before they are copied: all copies of a row are in one block of its side
    dealt = lambda of: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(of)).cast("int")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    query_blocks = max(1, query_blocks)
    asking = asking.where(F.size("v") > 0).select("query_id", "v", F.size("v").alias("width"), dealt(query_blocks).alias("qb")).select("*", spread(blocks).alias("vb"))
    usable = usable.select("id", "v", F.size("v").alias("width"), dealt(blocks).alias("vb")).select("*", spread(query_blocks).alias("qb"))

    def matrix(t: pa.Table) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)

    def cell(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return pa.table({"query_id": q.column("query_id").slice(0, 0), "id": v.column("id").slice(0, 0), "similarity": pa.array([], pa.float64())})
        v = v.take(pc.sort_indices(v, sort_keys=[("id", "ascending")], null_placement="at_start"))
        at, of, similarity = search_block(matrix(q), matrix(v), k)
        return pa.table({"query_id": q.column("query_id").take(pa.array(at)), "id": v.column("id").take(pa.array(of)), "similarity": pa.array(similarity, pa.float64(), from_pandas=True)})

    kinds = [d.schema[c].dataType.simpleString() for d, c in ((asking, "query_id"), (usable, "id"))]
    keys = ["width", "qb", "vb"]
    found = asking.groupBy(*keys).cogroup(usable.groupBy(*keys)).applyInArrow(cell, f"query_id {kinds[0]}, id {kinds[1]}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.col("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def removed_sources(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """source_id of chunks(source_id, path) whose file changes(change, path, previous_path) deleted or renamed."""
    gone = changes.where("change = 'deleted'").select("path").union(changes.where("change = 'renamed'").select("previous_path"))
    return chunks.join(gone.distinct(), "path", "left_semi").select("source_id").distinct()


#: A heading's line (of any block, fenced or not), and files that lock dependencies.
SECTION_HEADING = r"^#{1,6}[\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+[^\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LOCKFILE = r"(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock)\z"


def document_sources(artifacts: DataFrame) -> DataFrame:
    """source_id, path, kind, content, start_line, end_line: a source for each heading's lines up to the next heading, of
    documentation artifacts(path, kind, content); the whole of a page without headings, unless it is blank.

    What stands before the first heading is in no source; fences aren't looked for. Lock files are none.
    """
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  evaluates value once a row
    pages = artifacts.where((F.col("kind") == "documentation") & ~F.col("path").rlike(LOCKFILE))
    whole = F.when(trimmed(F.col("content")) != "", F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))

    def sections(lines: Column) -> Column:
        headed = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(SECTION_HEADING), i)), lambda i: i.isNotNull())

        def cut(start: Column, i: Column, starts: Column) -> Column:
            end = F.coalesce(F.get(starts, i + 1), F.size(lines))
            content = F.array_join(F.slice(lines, start + 1, end - start), "\n")
            return F.struct((i + 1).alias("n"), content.alias("content"), (start + 1).alias("start_line"), end.alias("end_line"))

        return let(headed, lambda h: let(F.when(F.size(h) > 0, h).otherwise(whole), lambda starts: F.transform(starts, lambda s, i: cut(s, i, starts))))

    found = pages.select("path", "kind", F.explode(let(F.split("content", "\n"), sections)).alias("s"))
    return found.select(F.concat("path", F.lit("#section-"), "s.n").alias("source_id"), "path", "kind", "s.content", "s.start_line", "s.end_line")


def code_sources(artifacts: DataFrame, entities: DataFrame) -> DataFrame:
    """source_id, path, kind, content: one source for each code artifact(path, kind, content) with an entity(path, kind,
    visibility) that isn't private; lockfiles, tests, configuration and build files are none."""
    useful = entities.where(F.col("kind").isin("class", "interface", "function", "method", "endpoint") & (F.coalesce("visibility", F.lit("public")) != "private"))
    code = artifacts.where((F.col("kind") == "code") & ~F.col("path").rlike(r"(^|/)[^/]*\.lock$|-lock\.[a-z]+$"))
    return code.join(useful.select("path").distinct(), "path", "left_semi").select(F.concat(F.lit("code:"), "path").alias("source_id"), "path", "kind", "content")


def projection_status(sources: DataFrame, embedded: DataFrame, enabled: bool) -> DataFrame:
    """One row: state (disabled, degraded, ready), sources and embedded, by how many of sources(id) embedded(id) has."""
    both = sources.select("id").distinct().join(embedded.select("id", F.lit(True).alias("_there")).distinct(), "id", "left")
    state = F.when(~F.lit(enabled), "disabled").when(F.count("_there") < F.count("*"), "degraded").otherwise("ready")
    return both.agg(state.alias("state"), F.count("*").alias("sources"), F.count("_there").alias("embedded"))
