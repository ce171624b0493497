"""Snapshot joins, lookups, aggregates and key-wise merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans import kept


def entity_search(entities: DataFrame, term: str, limit: int = 25) -> DataFrame:
    """Entities whose name holds the term, whatever the case, by name and key; wildcards in it count for nothing."""
    plain = term.replace("%", "").replace("_", "")
    return entities.where(F.col("name").ilike(f"%{plain}%")).orderBy("name", "stable_key").limit(limit)


def entity_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(F.count("*").alias("n"))


def kind_list(entities: DataFrame) -> DataFrame:
    """One row: "n kind" of each kind, sorted by kind."""
    return entity_counts(entities).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["kind"])), ", ").alias("kinds"))


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The last row of each key: max_by, combined before the shuffle."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(by, *[c for c in others if c != by])).alias("r")).select(key, "r.*")


def snapshot_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with the names and kinds of both ends."""
    end = lambda side: entities.select(F.col("stable_key").alias(f"{side}_key"), F.col("kind").alias(f"{side}_kind"), F.col("name").alias(f"{side}_name"))
    return relationships.join(end("source"), "source_key").join(end("target"), "target_key")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """current with incoming merged by key: `update` columns are taken from incoming, others stay; of incoming rows
    of one key the greatest counts."""
    others = [c for c in current.columns if c not in keys]
    new = incoming.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in others])).alias("_new"))
    both = current.withColumn("_there", F.lit(True)).join(new, list(keys), "full_outer")
    there = F.col("_there").isNotNull()
    take = lambda c: F.when(~there, F.col("_new")[c]).when(F.col("_new").isNotNull() & F.lit(c in update), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
    return both.select(*[F.col(c) if c in keys else take(c) for c in current.columns])


def insert_if_absent(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """current and those of incoming whose key it lacks; of several of one key the least."""
    others = [c for c in current.columns if c not in keys]
    new = incoming.join(current.select(*keys), list(keys), "left_anti").groupBy(*keys).agg(F.min(F.struct(*others)).alias("_new"))
    return current.unionByName(new.select(*keys, "_new.*"))


def resolve_unique(references: DataFrame, symbols: DataFrame, on: str = "name") -> DataFrame:
    """reference, target: the references that exactly one symbol answers. Counts are made on symbols, once a name, so
    a name with many references and many symbols never multiplies."""
    only = symbols.groupBy(on).agg(F.count("*").alias("n"), F.min("stable_key").alias("target")).where("n = 1").select(on, "target")
    return references.join(only, on).select("reference", "target")


def nearest_match(left: DataFrame, right: DataFrame, key: str, at: str = "line") -> DataFrame:
    """For each left row (id, key, line) the right row (id, key, line) of its key at the least distance, the earlier of two.

    Both sides are laid in one order, cut into ranges of about the same size whatever the keys, and each left row looks
    at the last right row before it, then, in the order reversed, at the last one after it: no product of the two, and
    no row looks at another's rest. What a range lacks its neighbours have: each range's first and last right row of a
    key are carried on over the ranges that the key is in.
    """
    rows = left.select(F.col("id").alias("left_id"), key, at, F.lit(None).cast("string").alias("right_id")).union(right.select(F.lit(None).cast("string"), key, at, F.col("id").cast("string")))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(rows.repartitionByRange(n, key, at).withColumn("_range", F.spark_partition_id()))
    other = F.when(F.col("right_id").isNotNull(), F.struct(F.col(at).alias("at"), F.col("right_id").alias("id")))
    upto = lambda *order: Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    back = F.last(other, True).over(upto(F.col(at), F.col("right_id").isNull(), F.col("right_id")))
    ahead = F.last(other, True).over(upto(F.col(at).desc(), F.col("right_id").isNotNull(), F.col("right_id").desc()))
    ends = rows.groupBy(key, "_range").agg(F.min(other).alias("_first"), F.max(other).alias("_last"))
    carried = lambda c, order: F.last(c, True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), carried("_last", F.col("_range")).alias("_from"), carried("_first", F.col("_range").desc()).alias("_to"))
    near = rows.select("left_id", key, "_range", F.col(at).alias("_at"), back.alias("_back"), ahead.alias("_ahead")).where("left_id is not null")
    near = near.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    near = near.select("left_id", "_at", F.coalesce("_back", "_from").alias("_back"), F.coalesce("_ahead", "_to").alias("_ahead"))
    before = F.when(F.col("_back").isNotNull(), F.struct((F.col("_at") - F.col("_back.at")).alias("distance"), F.lit(0).alias("turn"), F.col("_back.id").alias("id")))
    after = F.when(F.col("_ahead").isNotNull(), F.struct((F.col("_ahead.at") - F.col("_at")).alias("distance"), F.lit(1).alias("turn"), F.col("_ahead.id").alias("id")))
    return near.select("left_id", F.least(before, after).alias("m")).select("left_id", F.col("m.id").alias("right_id"), F.col("m.distance").alias("distance"))


def precision_recall(found: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = found.select(*keys).distinct().withColumn("f", F.lit(1)).join(expected.select(*keys).distinct().withColumn("e", F.lit(1)), list(keys), "full_outer")
    hit = F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull())
    return both.agg((hit / F.nullif(F.count("f"), F.lit(0))).alias("precision"), (hit / F.nullif(F.count("e"), F.lit(0))).alias("recall"))


def activate(previous: DataFrame, staged: DataFrame, affected_artifacts: DataFrame, relationships: DataFrame, revision: str) -> DataFrame:
    """The new revision's entities: what affected artifacts don't own, and what was staged, keeping first_seen.

    Raises before anything is written if a relationship lacks an end.
    """
    stay = previous.join(affected_artifacts, "artifact", "left_anti").select("stable_key", "artifact", "first_seen")
    seen = previous.select("stable_key", "first_seen")
    new = staged.select("stable_key", "artifact").distinct().join(seen, "stable_key", "left").select("stable_key", "artifact", F.coalesce("first_seen", F.lit(revision)).alias("first_seen"))
    out = stay.join(new, "stable_key", "left_anti").union(new)
    ends = relationships.select(F.explode(F.array("source_key", "target_key")).alias("stable_key"))
    if not ends.join(out, "stable_key", "left_anti").isEmpty():
        raise ValueError("a relationship refers to an entity that the revision lacks")
    return out.withColumn("revision", F.lit(revision))
