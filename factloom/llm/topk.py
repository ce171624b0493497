"""Exact top-k search by inner product: exhaustive, term at a time.

A vector component x counts as floor(256 * x). A block of candidates is turned into postings: for every dimension
the candidates with a non-zero weight there. A query's non-zero components then scatter their weighted postings
into a dense array of scores, partition selection takes the block's k best, and a window merges the blocks.

Queries and candidates both lie in blocks of bounded size; a task has one block of each, so it holds QUERIES +
CANDIDATES vectors whatever the tables' sizes, and no table is broadcast. Each candidate is sent once for every
block of queries, each query once for every block of candidates.

Defined results: vectors that are null or hold a null, NaN or infinity take no part, nor do rows whose id is
null; shorter vectors count as padded with zeros; scores wrap as 64-bit integers; ties go to the smaller id.
Repeated rows are candidates of their own; a query leaves out every row of its own id, and of several vectors
of one id the least asks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of queries, and of candidates.
QUERIES = 4096
CANDIDATES = 32768
#: Scores that are accumulated at a time, so that they stay in a core's cache.
STRIP = 8192


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def _usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def postings(vectors: np.ndarray) -> list[tuple[int, np.ndarray | None, np.ndarray]]:
    """(dimension, candidates, weights) for each dimension that has any; None for all candidates."""
    out = []
    for d in range(vectors.shape[1]):
        w = vectors[:, d]
        at = np.flatnonzero(w)
        if len(at) == len(w):
            out.append((d, None, np.ascontiguousarray(w)))
        elif len(at):
            out.append((d, at, w[at]))
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, the first of equal ones, in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate((above, np.flatnonzero(scores == least)[: k - len(above)]))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search_block(query_ids, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of each query. ids must ascend."""
    out = []
    found: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    for first in range(0, len(ids), STRIP):
        strip = candidates[first : first + STRIP]
        own = ids[first : first + STRIP]
        terms = postings(strip)
        scores = np.empty(len(own), np.int64)
        for q, query in enumerate(queries):
            scores[:] = 0
            for d, at, weights in terms:
                if x := query[d]:
                    if at is None:
                        scores += x * weights
                    else:
                        scores[at] += x * weights
            a, b = np.searchsorted(own, query_ids[q], "left"), np.searchsorted(own, query_ids[q], "right")
            others = scores if a == b else np.delete(scores, slice(a, b))
            names = own if a == b else np.delete(own, slice(a, b))
            top = best(others, k)
            found[q] += zip((-others[top]).tolist(), names[top].tolist(), strict=True)
            found[q] = sorted(found[q])[:k]
    for q, pairs in zip(query_ids, found, strict=True):
        out += [(int(q), i, -s) for s, i in pairs]
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other rows for each row of vectors(vec_id,
    embedding) that is_query holds for."""
    usable = _usable(vectors).select("vec_id", quantised(F.col("embedding")).alias("v"), is_query.alias("_query"))
    n, asked, width = usable.agg(F.count("*"), F.count_if("_query"), F.max(F.size("v"))).first()
    query_blocks, blocks = max(1, -(-asked // QUERIES)), max(1, -(-n // CANDIDATES))
    # more blocks than CANDIDATES asks for while there are few, for parallel work
    blocks = max(blocks, min(int(usable.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 4096)), 1)
    block = lambda column, of: F.pmod(F.xxhash64(column, F.lit(of)), F.lit(of)).cast("int")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    asking = usable.where("_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = asking.select("vec_id", "v", block("vec_id", query_blocks).alias("qb"), spread(blocks).alias("cb"))
    salt = F.monotonically_increasing_id()  # rows of one id needn't share a block
    candidates = usable.select("vec_id", "v", block(salt, blocks).alias("cb"), spread(query_blocks).alias("qb"))
    width = width or 0

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("vec_id", kind="stable")
        found = search_block(q["vec_id"].to_numpy(), _matrix(q["v"], width), c["vec_id"].to_numpy(np.int64), _matrix(c["v"], width), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInPandas(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
