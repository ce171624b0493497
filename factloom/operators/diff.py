"""Semantic diffs between revisions, change sets between inventories, renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import changed_fields
from factloom.plans import kept


def _change(base_there, target_there, modified):
    return F.when(~base_there, "added").when(~target_there, "removed").when(modified, "modified")


def entity_diff(base: DataFrame, target: DataFrame, fields: tuple[str, ...] = ("attributes", "kind", "language", "name", "qualified_name")) -> DataFrame:
    """stable_key, change and changed_fields of entities that differ; where a row comes from is not material."""
    used = [f for f in fields if f in base.columns and f in target.columns]
    b = base.select(F.col("stable_key").alias("b_key"), *[F.col(f).alias(f"b_{f}") for f in used])
    t = target.select(F.col("stable_key").alias("t_key"), *[F.col(f).alias(f"t_{f}") for f in used])
    both = b.join(t, F.col("b_key") == F.col("t_key"), "full_outer")
    fields_ = changed_fields(**{f: (F.col(f"b_{f}"), F.col(f"t_{f}")) for f in used})
    there_b, there_t = F.col("b_key").isNotNull(), F.col("t_key").isNotNull()
    out = both.select(F.coalesce("b_key", "t_key").alias("stable_key"), F.when(there_b & there_t, fields_).otherwise(F.array().cast("array<string>")).alias("changed_fields"), there_b.alias("b"), there_t.alias("t"))
    return out.select("stable_key", _change(F.col("b"), F.col("t"), F.size("changed_fields") > 0).alias("change"), "changed_fields").where("change is not null")


def relationship_index(relationships: DataFrame) -> DataFrame:
    """One relationship for each (kind, source_key, target_key): the strongest (no confidence counts as 1), then by the
    text of its attributes, if there are any, and by id.

    The least of (less confidence, id) is combined before the shuffle, so a pair with many parallel edges is not one task's burden.
    """
    keys = ["kind", "source_key", "target_key"]
    more = [c for c in ("attributes",) if c in relationships.columns]
    best = F.min(F.struct((-F.coalesce("confidence", F.lit(1.0))).alias("less"), *more, F.col("id").alias("id"), F.col("confidence").alias("confidence"))).alias("best")
    return relationships.groupBy(*keys).agg(best).select(*keys, F.col("best.id").alias("id"), F.col("best.confidence").alias("confidence"), *[F.col(f"best.{c}").alias(c) for c in more])


def _by_index(base: DataFrame, target: DataFrame, both_have: list[str]) -> DataFrame:
    """relationship_diff() from both sides' strongest relationships, each held against the other."""
    keys = ["kind", "source_key", "target_key"]
    side = lambda df, s: relationship_index(df).select(*keys, F.lit(True).alias(s), F.struct(*both_have).alias(f"{s}_body"))
    b, t = side(base, "b"), side(target, "t")
    there = lambda c: F.coalesce(F.col(c), F.lit(False))
    both = b.join(t, keys, "full_outer")
    return both.select(*keys, _change(there("b"), there("t"), ~F.col("b_body").eqNullSafe(F.col("t_body"))).alias("change")).where("change is not null")


def relationship_diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """kind, source_key, target_key and change between the strongest relationships of two revisions: modified if
    confidence or attributes differ.

    Where confidence alone is compared, one hash aggregate over both revisions tells it: no ids or texts are sorted or
    joined. Only where no confidence and one of 1 are the strongest alike does the id decide; such keys are looked up.
    """
    keys = ["kind", "source_key", "target_key"]
    both_have = [c for c in ("confidence", "attributes") if c in base.columns and c in target.columns]
    if both_have != ["confidence"] or "attributes" in base.columns + target.columns:
        return _by_index(base, target, both_have)
    less = -F.coalesce("confidence", F.lit(1.0))
    rows = base.select(*keys, F.lit(True).alias("b"), "confidence").union(target.select(*keys, F.lit(False), "confidence"))
    columns = []
    for s, here in (("b", F.col("b")), ("t", ~F.col("b"))):
        columns += [F.min(F.when(here, less)).alias(f"{s}_less"), F.max(here & F.col("confidence").isNull()).alias(f"{s}_none"), F.max(here & F.coalesce(F.col("confidence") == 1, F.lit(False))).alias(f"{s}_one")]
    # a null key equals none of the other side
    apart = F.when(F.col("kind").isNull() | F.col("source_key").isNull() | F.col("target_key").isNull(), F.col("b")).alias("_apart")
    found = rows.groupBy(*keys, apart).agg(*columns)
    none = lambda s: (F.col(f"{s}_less") == -1) & ~F.col(f"{s}_one")
    open_ = lambda s: (F.col(f"{s}_less") == -1) & F.col(f"{s}_one") & F.col(f"{s}_none")
    alike = F.col("b_less").eqNullSafe(F.col("t_less"))
    change = _change(F.col("b_less").isNotNull(), F.col("t_less").isNotNull(), ~alike | (none("b") != none("t")))
    found = kept(found.select(*keys, change.alias("change"), F.coalesce(alike & (open_("b") | open_("t")), F.lit(False)).alias("_open")).where("change is not null or _open"))
    sure, left = found.where("not _open").select(*keys, "change"), found.where("_open").select(*keys)
    if left.isEmpty():
        return sure
    of = lambda df: df.join(left, keys, "left_semi")
    return sure.union(_by_index(of(base), of(target), both_have))


def diff_summary(*diffs: DataFrame) -> DataFrame:
    """added, modified and removed over all diffs, as one row."""
    changes = [d.select("change") for d in diffs]
    out = changes[0]
    for d in changes[1:]:
        out = out.union(d)
    return out.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "removed")])


def change_set(base: DataFrame, target: DataFrame) -> DataFrame:
    """path, change (added, modified, deleted), previous_hash and current_hash between two inventories (path, content_hash)."""
    b = base.select("path", F.col("content_hash").alias("previous_hash"))
    t = target.select("path", F.col("content_hash").alias("current_hash"))
    change = F.when(F.col("previous_hash").isNull(), "added").when(F.col("current_hash").isNull(), "deleted").when(F.col("previous_hash") != F.col("current_hash"), "modified")
    return b.join(t, "path", "full_outer").select("path", change.alias("change"), "previous_hash", "current_hash").where("change is not null")


def coalesce_renames(changes: DataFrame) -> DataFrame:
    """Deleted and added files of equal content, paired in order of path, as renames; adds previous_path.

    Numbers run within a content hash: copies of one content pair off one to one. They are counted in ranges of paths
    first and inside a range then, so that no content's files are ever in one task.
    """
    side = lambda change, column: changes.where(F.col("change") == change).select("path", F.col(column).alias("hash"))

    def number(df: DataFrame) -> DataFrame:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = kept(df.repartitionByRange(n, "hash", "path").withColumn("_range", F.spark_partition_id()))
        counts = df.groupBy("hash", "_range").count()
        before = F.sum("count").over(Window.partitionBy("hash").orderBy("_range")) - F.col("count")
        inside = F.row_number().over(Window.partitionBy("hash", "_range").orderBy("path"))
        return df.join(counts.select("hash", "_range", before.alias("_before")), ["hash", "_range"]).select("path", "hash", (F.col("_before") + inside).alias("n"))

    gone, new = side("deleted", "previous_hash"), side("added", "current_hash")
    # only hashes on both sides are numbered: everything else needs no window
    gone, new = gone.join(new.select("hash").distinct(), "hash", "left_semi"), new.join(gone.select("hash").distinct(), "hash", "left_semi")
    pairs = number(gone).withColumnRenamed("path", "previous_path").join(number(new), ["hash", "n"]).select("previous_path", "path", "hash")
    used = pairs.select(F.explode(F.array(F.struct(F.lit("deleted").alias("change"), F.col("previous_path").alias("path")), F.struct(F.lit("added").alias("change"), F.col("path").alias("path")))).alias("u")).select("u.*")
    rest = changes.join(used, ["change", "path"], "left_anti").select("path", "change", "previous_hash", "current_hash", F.lit(None).cast("string").alias("previous_path"))
    return rest.union(pairs.select("path", F.lit("renamed"), "hash", "hash", "previous_path"))


def fingerprint(inventory: DataFrame) -> DataFrame:
    """One hash for the whole of (path, content_hash), whatever the order of rows: sums of row hashes, not a list."""
    row = F.sha2(F.concat_ws("\x1f", "path", "content_hash"), 256)
    part = lambda a: F.sum(F.conv(F.substring(row, a, 15), 16, 10).cast("decimal(38,0)"))
    return inventory.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1).cast("string"), part(16).cast("string")), 256).alias("fingerprint"))


def require_same_repository(base: str, target: str) -> None:
    if base != target:
        raise ValueError(f"revisions of different repositories: {base} and {target}")
