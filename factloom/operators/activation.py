"""Making a revision's staged facts the active ones: every rule that forbids it as a join, and the tables after it.

The tables: runs(run_id, repository_id, revision_id, artifact_id, status), artifacts(artifact_id, repository_id,
active_revision), revisions(revision_id, repository_id, status), outbox(idempotency_key), entities(stable_key, artifact_id,
first_seen, last_seen, ...), relationships(kind, source_key, target_key, artifact_id, first_seen, last_seen, ...). A
request asks for runs(run_id) and deleted artifacts(artifact_id). Nothing is collected but whether there is a violation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans import kept

RULES = (
    "duplicate run", "unknown run", "run of another revision", "mixed status", "artifact staged twice", "artifact changed and deleted",
    "unknown artifact", "artifact of another repository", "unknown revision", "revision of another repository", "relationship without an end",
)


@dataclass
class Request:
    repository: str
    revision: str
    runs: DataFrame  # run_id
    deleted: DataFrame  # artifact_id


@dataclass
class Catalog:
    runs: DataFrame
    artifacts: DataFrame
    revisions: DataFrame
    outbox: DataFrame
    entities: DataFrame
    relationships: DataFrame


def _staged(request: Request, catalog: Catalog) -> DataFrame:
    return catalog.runs.join(request.runs.select("run_id").distinct(), "run_id", "left_semi")


def completed(request: Request, catalog: Catalog) -> bool:
    """Whether there is nothing to do: all runs are active already, or there are none and the event has been sent."""
    key = f"facts:{request.repository}:{request.revision}"
    n, active = _staged(request, catalog).agg(F.count("*"), F.count_if(F.col("status") == "active")).first()
    if n:
        return n == active
    return not catalog.outbox.where(F.col("idempotency_key") == key).isEmpty()


def violations(request: Request, catalog: Catalog, staged_entities: DataFrame, staged_relationships: DataFrame) -> DataFrame:
    """rule and subject of everything that forbids the activation; empty if it may go on.

    staged_entities has run_id and stable_key, staged_relationships run_id, source_key and target_key.
    """
    asked = request.runs.select("run_id")
    runs = kept(_staged(request, catalog))
    deleted = request.deleted.select("artifact_id").distinct()
    told = lambda rule, df, subject: df.select(F.lit(RULES[rule]).alias("rule"), F.col(subject).cast("string").alias("subject"))
    out = told(0, asked.groupBy("run_id").count().where("count > 1"), "run_id")
    out = out.union(told(1, asked.distinct().join(catalog.runs, "run_id", "left_anti"), "run_id"))
    out = out.union(told(2, runs.where(~(F.col("repository_id").eqNullSafe(request.repository) & F.col("revision_id").eqNullSafe(request.revision))), "run_id"))
    # all active is done already, any other status forbids
    wrong = runs.groupBy("status").count().where(~F.col("status").eqNullSafe("staged"))
    out = out.union(told(3, wrong.withColumn("status", F.coalesce("status", F.lit("null"))), "status"))
    out = out.union(told(4, runs.groupBy("artifact_id").count().where("count > 1"), "artifact_id"))
    changed = runs.select("artifact_id").distinct()
    out = out.union(told(5, changed.join(deleted, "artifact_id", "left_semi"), "artifact_id"))
    touched = changed.union(deleted).distinct()
    owned = touched.join(catalog.artifacts.select("artifact_id", "repository_id"), "artifact_id", "left")
    owned = owned.withColumn("_known", F.col("repository_id").isNotNull())
    out = out.union(told(6, owned.where("not _known"), "artifact_id")).union(told(7, owned.where(F.col("_known") & (F.col("repository_id") != request.repository)), "artifact_id"))
    revision = catalog.revisions.where(F.col("revision_id") == request.revision)
    one = revision.sparkSession.createDataFrame([(request.revision,)], "revision_id string").join(revision.select("revision_id", "repository_id"), "revision_id", "left")
    out = out.union(told(8, one.where("repository_id is null"), "revision_id")).union(told(9, one.where(F.col("repository_id") != request.repository), "revision_id"))
    there = entities_after(request, catalog, staged_entities, runs).select("stable_key")
    mine = runs.select("run_id")
    ends = staged_relationships.join(mine, "run_id", "left_semi").select(F.explode(F.array("source_key", "target_key")).alias("stable_key")).distinct()
    return out.union(told(10, ends.join(there, "stable_key", "left_anti"), "stable_key"))


def entities_after(request: Request, catalog: Catalog, staged_entities: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """stable_key, artifact_id, first_seen, last_seen: untouched artifacts keep their entities as they are, changed ones
    have what was staged, deleted ones none. A key that was there keeps when it was first seen."""
    runs = _staged(request, catalog) if runs is None else runs
    gone = runs.select("artifact_id").union(request.deleted.select("artifact_id")).distinct()
    new = staged_entities.join(runs.select("run_id", "artifact_id"), "run_id").groupBy("stable_key").agg(F.max_by("artifact_id", "run_id").alias("artifact_id"))
    before = catalog.entities.select("stable_key", F.col("first_seen").alias("_first"))
    new = new.join(before, "stable_key", "left").select("stable_key", "artifact_id", F.coalesce("_first", F.lit(request.revision)).alias("first_seen"), F.lit(request.revision).alias("last_seen"))
    stay = catalog.entities.select("stable_key", "artifact_id", "first_seen", "last_seen").join(gone, "artifact_id", "left_anti").join(new, "stable_key", "left_anti")
    return stay.unionByName(new)


def activate(request: Request, catalog: Catalog, staged_entities: DataFrame, staged_relationships: DataFrame) -> Catalog | None:
    """The catalog after the activation, None if it has been made already; raises, before anything is written, if any
    rule forbids it. The swap is one set of tables: a reader has all of them or none (snapshots.publish)."""
    if completed(request, catalog):
        return None
    wrong = violations(request, catalog, staged_entities, staged_relationships)
    if (first := wrong.orderBy("rule", "subject").first()) is not None:
        raise ValueError(f"{first['rule']}: {first['subject']}")
    runs = kept(_staged(request, catalog))
    touched = runs.select("artifact_id").union(request.deleted.select("artifact_id")).distinct()
    entities = kept(entities_after(request, catalog, staged_entities, runs))
    kinds = ("kind", "source_key", "target_key", "artifact_id", "first_seen", "last_seen")
    new = staged_relationships.join(runs.select("run_id", "artifact_id"), "run_id").select("kind", "source_key", "target_key", "artifact_id", F.lit(request.revision).alias("first_seen"), F.lit(request.revision).alias("last_seen"))
    stay = catalog.relationships.select(*kinds).join(touched, "artifact_id", "left_anti")
    for end in ("source_key", "target_key"):
        stay = stay.join(entities.select(F.col("stable_key").alias(end)), end, "left_semi")
    changed = runs.select("artifact_id", F.lit(True).alias("_changed")).distinct()
    artifacts = catalog.artifacts.join(request.deleted.select("artifact_id").distinct(), "artifact_id", "left_anti").join(changed, "artifact_id", "left")
    artifacts = artifacts.select("artifact_id", "repository_id", F.when(F.col("_changed"), request.revision).otherwise(F.col("active_revision")).alias("active_revision"))
    done = runs.select("run_id", F.lit(True).alias("_done"))
    all_runs = catalog.runs.join(done, "run_id", "left").select("run_id", "repository_id", "revision_id", "artifact_id", F.when(F.col("_done"), "active").otherwise(F.col("status")).alias("status"))
    own, this = F.col("repository_id") == request.repository, F.col("revision_id") == request.revision
    status = F.when(this, "active").when(own & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    revisions = catalog.revisions.select("revision_id", "repository_id", status.alias("status"))
    event = entities.sparkSession.createDataFrame([(f"facts:{request.repository}:{request.revision}",)], "idempotency_key string")
    outbox = catalog.outbox.select("idempotency_key").union(event.join(catalog.outbox, "idempotency_key", "left_anti"))
    return Catalog(all_runs, artifacts, revisions, outbox, entities, stay.select(*kinds).unionByName(new))
