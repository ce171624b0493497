"""The table of embedded chunks from one revision to the next, as one merge.

The table has id, parent, checksum, model, revision and vector, in partitions by a hash of the parent. A revision brings
the chunks of the parents that it updates and names those that it removes; all other parents' chunks stay as they are.
One full outer join by id decides on every chunk: embed (new, or another checksum or model), retain (the same; it gets
the revision), stale (its parent lost it, or is gone) or keep (its parent wasn't touched). Only partitions with anything
but keep are written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans import kept


def plan(existing: DataFrame, chunks: DataFrame, updated: DataFrame, removed: DataFrame, model: str) -> DataFrame:
    """id, parent and action of existing(id, parent, checksum, model) and chunks(id, parent, checksum), given the parents
    that are updated(parent) and removed(parent). A parent both updated and removed loses what it had."""
    old = existing.select("id", F.col("parent").alias("_parent"), F.col("checksum").alias("_checksum"), F.col("model").alias("_model"))
    both = chunks.select("id", "parent", "checksum").join(old, "id", "full_outer").withColumn("parent", F.coalesce("parent", "_parent"))
    touched = updated.select("parent", F.lit(False).alias("_gone")).union(removed.select("parent", F.lit(True))).groupBy("parent").agg(F.max("_gone").alias("_gone"))
    both = both.join(touched, "parent", "left")
    same = F.coalesce((F.col("checksum") == F.col("_checksum")) & (F.col("_model") == model), F.lit(False))
    had = F.col("_checksum").isNotNull()
    action = F.when(F.col("_gone") & had, "stale").when(F.col("checksum").isNotNull(), F.when(same, "retain").otherwise("embed")).when(F.col("_gone").isNotNull(), "stale").otherwise("keep")
    return both.select("id", "parent", action.alias("action"))


def merged(existing: DataFrame, chunks: DataFrame, planned: DataFrame, vectors: DataFrame, model: str, revision: str) -> DataFrame:
    """The table after the plan: vectors(id, vector) are those of what is to embed; raises if one of them lacks."""
    new = chunks.join(planned.where("action = 'embed'").select("id"), "id", "left_semi").join(vectors.select("id", "vector"), "id", "left")
    if not new.where("vector is null").isEmpty():
        raise ValueError("a chunk to embed has no vector")
    columns = ("id", "parent", "checksum", "model", "revision", "vector")
    stay = existing.select(*columns).join(planned.where("action in ('keep', 'retain')").select("id", "action"), "id")
    stay = stay.withColumn("revision", F.when(F.col("action") == "retain", revision).otherwise(F.col("revision"))).select(*columns)
    return stay.unionByName(new.select("id", "parent", "checksum", F.lit(model).alias("model"), F.lit(revision).alias("revision"), "vector"))


def part_of(parent: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(parent), F.lit(parts)).cast("int")


def write(after: DataFrame, planned: DataFrame, root: str, parts: int = 64) -> int:
    """Writes those partitions of the table below root again that the plan touches; how many. after may have been read
    from there. A partition that has no chunk left is deleted."""
    spark = after.sparkSession
    touched = [r[0] for r in planned.where("action <> 'keep'").select(part_of(F.col("parent"), parts)).distinct().collect()]  # `parts` at most
    if not touched:
        return 0
    rows = kept(after.withColumn("part", part_of(F.col("parent"), parts)).where(F.col("part").isin(touched)).repartition("part"))
    full = {r[0] for r in rows.select("part").distinct().collect()}
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("part").parquet(root)
    for part in set(touched) - full:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/part={part}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(touched)
