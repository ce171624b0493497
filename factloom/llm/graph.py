"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the component's least node) for every node of edges(a, b) that isn't a root itself.

    Each round joins every edge to the least neighbour of its end; a component of diameter d is a star after about
    log d rounds. Least neighbours are aggregates, combined before the shuffle, so a hub costs one row a task;
    nothing is collected but two numbers a round that tell whether edges still change.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    e = scratch.keep(edges.where("a <> b").select(most.alias("u"), least.alias("v")).distinct())
    before = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = scratch.keep(small.select("e.*").where("u <> v").distinct())
        scratch.drop(e)
        e, before = after, mark
