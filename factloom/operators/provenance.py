"""Joins of facts with where they come from: provenance, artifacts, owners, revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans import kept


def with_sources(entities: DataFrame, provenance: DataFrame, artifacts: DataFrame) -> DataFrame:
    """entities with path, start_line and end_line; null where an entity has no provenance(stable_key, artifact_id,
    start_line, end_line) or its artifact(artifact_id, path) is gone. One row for each provenance."""
    places = provenance.select("stable_key", "artifact_id", "start_line", "end_line")
    return entities.join(places, "stable_key", "left").join(artifacts.select("artifact_id", "path"), "artifact_id", "left").drop("artifact_id")


def owned(entities: DataFrame, artifacts: DataFrame) -> DataFrame:
    """entities(stable_key, artifact_id) whose owner artifact(artifact_id, path, kind) exists, with its path and kind."""
    owner = artifacts.select("artifact_id", F.col("path").alias("owner_path"), F.col("kind").alias("owner_kind"))
    return entities.join(owner, "artifact_id")


def structural_references(keys: DataFrame, provenance: DataFrame, entities: DataFrame, artifacts: DataFrame) -> DataFrame:
    """stable_key, name, path, start_line, end_line of keys(stable_key), with n, the place in order of (path, start_line)
    within each stable_key; of equal ones the one that ends first, then the least name. The rows come in order of (path,
    start_line), then key and n; what has no line comes last.

    The keys meet the places, not the entities: Spark asks each part of a union for all keys again, in one task. What
    grows with the files is merged, never broadcast. Places are counted in ranges first and inside a range then, so that
    no key's places are ever in one task.
    """
    places = provenance.select("stable_key", "artifact_id", "start_line", "end_line").join(artifacts.select("artifact_id", "path").hint("merge"), "artifact_id").drop("artifact_id")
    asked = places.join(keys.select("stable_key").hint("merge"), "stable_key", "left_semi")
    found = entities.select("stable_key", "name").join(asked.hint("merge"), "stable_key").select("stable_key", "name", "start_line", "end_line", "path")
    order = [F.asc_nulls_last(c) for c in ("path", "start_line", "end_line", "name")]
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(found.repartitionByRange(parts, F.asc("stable_key"), *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("stable_key", "_range").count()
    before = counts.select("stable_key", "_range", (F.sum("count").over(Window.partitionBy("stable_key").orderBy("_range")) - F.col("count")).alias("_before"))
    before = before.where("_before > 0")  # of keys in more than one range, as many as ranges at most
    inside = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("stable_key", "_range").orderBy(*order)))
    numbered = inside.join(before.hint("merge"), ["stable_key", "_range"], "left").withColumn("n", F.coalesce("_before", F.lit(0)) + F.col("_n"))
    return numbered.select("stable_key", "name", "path", "start_line", "end_line", "n").orderBy(*order[:2], "stable_key", "n")


def revisions_of(revisions: DataFrame, repositories: DataFrame) -> DataFrame:
    """revisions(revision_id, repository_id, ...) with the repository's name; those without a repository are left out."""
    return revisions.join(repositories.select("repository_id", F.col("name").alias("repository")), "repository_id")


def pull_requests_at(requests: DataFrame, revisions: DataFrame) -> DataFrame:
    """id, sha and current of requests(id, revision_id, sha): whether the revision has that commit still."""
    known = revisions.select("revision_id", F.col("sha").alias("_sha"))
    return requests.join(known, "revision_id", "left").select("id", "sha", F.coalesce(F.col("sha") == F.col("_sha"), F.lit(False)).alias("current"))


def require_active(revisions: DataFrame, revision_id: str) -> None:
    """Raises unless revisions(revision_id, state) has this one as active."""
    if revisions.where((F.col("revision_id") == revision_id) & (F.col("state") == "active")).isEmpty():
        raise ValueError(f"revision {revision_id} is not active")


def closest_enclosing(places: DataFrame, declarations: DataFrame) -> DataFrame:
    """id and owner of places(id, path, line): the narrowest of declarations(stable_key, path, start_line, end_line)
    that holds the line, of equally wide ones the later, then the least key; null where none does.

    A declaration's lines are cut into aligned blocks of a power of two, twice as many as the logarithm of their number
    at most, and a block keeps its narrowest declaration only. A line lies in one block of each size, so it meets one
    row for each size, however many declarations stand around it; equal lines of a file are asked for once.
    """
    held = declarations.where("end_line >= start_line").select("stable_key", "path", F.col("start_line").cast("long").alias("a"), (F.col("end_line").cast("long") + 1).alias("b"))
    width = F.struct((F.col("b") - F.col("a")).alias("width"), (-F.col("a")).alias("later"), "stable_key").alias("w")
    sized = held.select("path", "a", "b", width, F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("b") - F.col("a")) + 1e-9).cast("int"))).alias("size"))
    low, high = -F.expr("shiftright(-a, size)"), F.expr("shiftright(b, size)")  # the blocks of this size that lie in [a, b)
    odd = lambda c: F.pmod(c, F.lit(2)) == 1
    ends = F.array_compact(F.array(F.when((low < high) & odd(low), low), F.when((low < high) & odd(high), high - 1)))  # of all but these a larger block has all
    blocks = sized.select("path", "size", F.explode(ends).alias("block"), "w").groupBy("path", "size", "block").agg(F.min("w").alias("w"))
    blocks = kept(blocks)
    sizes = blocks.groupBy().agg(F.array_sort(F.collect_set("size"))).first()[0]  # no more than a line number has bits
    asked = places.select("path", F.col("line").cast("long").alias("line")).distinct()
    asked = asked.select("path", "line", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("size")).withColumn("block", F.expr("shiftright(line, size)"))
    owner = asked.join(blocks.hint("merge"), ["path", "size", "block"]).groupBy("path", "line").agg(F.min("w").alias("w")).select("path", "line", F.col("w.stable_key").alias("owner"))
    return places.select("id", "path", F.col("line").cast("long").alias("line")).join(owner.hint("merge"), ["path", "line"], "left").select("id", "owner")


def root_lookup(entities: DataFrame, term: str, limit: int = 5) -> DataFrame:
    """The first entities, by name and key, whose name or attributes' text holds the term, whatever the case."""
    plain = term.replace("%", "").replace("_", "")
    return entities.where(F.col("name").ilike(f"%{plain}%") | F.coalesce(F.col("attributes").ilike(f"%{plain}%"), F.lit(False))).orderBy("name", "stable_key").limit(limit)
