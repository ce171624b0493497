"""What a catalog keeps, as merges of tables: parents with children, analyses of a revision, jobs and their stages.

A single writer is assumed: every function takes the present rows and what is asked for, and returns the rows after.
Compare-and-set becomes a join: a change is made where the row still has the state that it was asked for in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.diff import fingerprint


def replace_children(children: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """children with those of parents(key) replaced by new, none of which may belong to other parents."""
    mine = parents.select(key).distinct()
    return children.join(mine, key, "left_anti").unionByName(new.join(mine, key, "left_semi"))


def replace_revision(current: DataFrame, new: DataFrame, keys: Sequence[str] = ("repository_id", "revision_id")) -> DataFrame:
    """current with the rows of every (repository, revision) that new has replaced by new's."""
    return current.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def retained_pages(pages: DataFrame, active: DataFrame) -> DataFrame:
    """pages(page_id, ...) without those that active(page_id) lacks."""
    return pages.join(active.select("page_id").distinct(), "page_id", "left_semi")


def saved_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers(question, answer, citations, confidence) as the two tables that keep them: answers(answer_id, question,
    answer, confidence) and citations(answer_id, ordinal, evidence_id). Equal answers have equal ids."""
    ids = answers.withColumn("answer_id", F.substring(F.sha2(F.concat_ws("\x1f", "question", "answer"), 256), 1, 24))
    cited = ids.select("answer_id", F.posexplode("citations").alias("ordinal", "evidence_id"))
    return ids.select("answer_id", "question", "answer", "confidence"), cited


def overridden(base: Column, over: Column) -> Column:
    """A map with the entries of both; over's count where both have a key."""
    return F.map_zip_with(base, over, lambda k, a, b: F.coalesce(b, a))


# Incremental snapshots


def load_set(changes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The artifacts(path, kind, ...) to load: current paths of changes(path, change), and all build and configuration ones."""
    changed = changes.where("change <> 'deleted'").select("path")
    config = artifacts.where(F.col("kind").isin("build", "configuration")).select("path")
    return artifacts.join(changed.union(config).distinct(), "path", "left_semi")


def normalize_changes(changes: DataFrame, loaded: DataFrame) -> DataFrame:
    """changes(path, change) with those whose file failed to load set right: an added one is dropped, any other is deleted."""
    there = loaded.select("path", F.lit(True).alias("_there"))
    seen = changes.join(there, "path", "left")
    fails = F.col("_there").isNull() & (F.col("change") != "deleted")
    out = seen.where(~(fails & (F.col("change") == "added")))
    return out.select("path", F.when(fails, "deleted").otherwise(F.col("change")).alias("change"))


def assert_unchanged(before: DataFrame, after: DataFrame) -> str:
    """The fingerprint of two inventories(path, content_hash) of one tree; raises if they differ."""
    a, b = (fingerprint(x).first()["fingerprint"] for x in (before, after))
    if a != b:
        raise ValueError("the tree changed while it was read")
    return a


# Jobs


def submit_scans(requests: DataFrame, repositories: DataFrame, revisions: DataFrame, jobs: DataFrame) -> DataFrame:
    """outcome, job_id, parent and event_key for each of requests(repository_id, revision_id).

    unknown-repository and permanently-failed refuse; existing names the job that is there; created comes with the
    latest active revision as parent and the key of the event that asks for the scan. Of equal requests one counts.
    """
    asked = requests.select("repository_id", "revision_id").distinct()
    known = repositories.select("repository_id", F.lit(True).alias("_known"))
    parent = revisions.where("state = 'active'").groupBy("repository_id").agg(F.max_by("revision_id", F.struct("activated_at", "revision_id")).alias("parent"))
    old = jobs.select("repository_id", "revision_id", F.col("job_id").alias("_job"), F.col("state").alias("_state"), F.col("recoverable").alias("_recoverable"))
    both = asked.join(known, "repository_id", "left").join(parent, "repository_id", "left").join(old, ["repository_id", "revision_id"], "left")
    dead = (F.col("_state") == "failed") & ~F.coalesce("_recoverable", F.lit(False))
    outcome = F.when(F.col("_known").isNull(), "unknown-repository").when(dead, "permanently-failed").when(F.col("_job").isNotNull(), "existing").otherwise("created")
    job = F.coalesce("_job", F.concat_ws(":", F.lit("scan"), F.col("repository_id").cast("string"), F.col("revision_id").cast("string")))
    out = both.select("repository_id", "revision_id", outcome.alias("outcome"), job.alias("_id"), "parent")
    new, refused = F.col("outcome") == "created", F.col("outcome") == "unknown-repository"
    return out.select("repository_id", "revision_id", "outcome", F.when(~refused, F.col("_id")).alias("job_id"), F.when(new, F.col("parent")).alias("parent"), F.when(new, F.concat(F.lit("scan.requested:"), "_id", F.lit(":0"))).alias("event_key"))


def retry_scans(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """job_id, accepted, stage, attempt and event_key for asked(job_id, target) of jobs(job_id, state, recoverable,
    recoverable_stage, target, attempt): failed jobs that can be resumed where they stopped, if the target is the same."""
    both = asked.withColumnRenamed("target", "_target").join(jobs, "job_id")
    ok = (F.col("state") == "failed") & F.coalesce("recoverable", F.lit(False)) & F.col("recoverable_stage").isNotNull() & F.col("target").eqNullSafe(F.col("_target"))
    attempt = F.col("attempt") + F.when(ok, 1).otherwise(0)
    key = F.when(ok, F.concat_ws(":", F.lit("scan.requested"), F.col("job_id").cast("string"), attempt.cast("string")))
    return both.select("job_id", ok.alias("accepted"), F.when(ok, F.col("recoverable_stage")).alias("stage"), attempt.alias("attempt"), key.alias("event_key"))


def transition(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """jobs(job_id, state, stage) after updates(job_id, from_state, from_stage, to_state, to_stage), with applied: an update
    is made where the job still has the state and stage it was asked for in. Of a job's updates the least that fits counts."""
    asked = updates.join(jobs.select("job_id", "state", "stage"), "job_id").where("state = from_state and stage <=> from_stage")
    one = asked.groupBy("job_id").agg(F.min(F.struct("to_state", "to_stage")).alias("_to"))
    done = F.col("_to").isNotNull()
    others = [c for c in jobs.columns if c not in ("state", "stage")]
    return jobs.join(one, "job_id", "left").select(*others, F.when(done, F.col("_to.to_state")).otherwise(F.col("state")).alias("state"), F.when(done, F.col("_to.to_stage")).otherwise(F.col("stage")).alias("stage"), done.alias("applied"))


def merge_stages(results: DataFrame) -> DataFrame:
    """job, counts, reasons, diagnostics and milliseconds of results(job, ordinal, counts map, reasons array, diagnostics
    array, milliseconds), seven stages a job at most: of equal counts the last stage's, distinct reasons sorted,
    diagnostics in order of the stages."""
    last = results.select("job", "ordinal", F.explode("counts").alias("k", "v")).groupBy("job", "k").agg(F.max_by("v", "ordinal").alias("v"))
    counts = last.groupBy("job").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("counts"))
    rest = results.groupBy("job").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "diagnostics"))), lambda x: x["diagnostics"])).alias("diagnostics"),
        F.sum("milliseconds").alias("milliseconds"),
    )
    return rest.join(counts, "job", "left").select("job", "counts", "reasons", "diagnostics", "milliseconds")


def analysis_status(previous: DataFrame, runs: DataFrame) -> DataFrame:
    """repository_id, revision_id, state and recoverable after runs(repository_id, revision_id, ok): a failed run keeps the
    revision that was projected before, and can be tried again."""
    both = runs.join(previous.select("repository_id", F.col("revision_id").alias("_old")), "repository_id", "left")
    return both.select("repository_id", F.when(F.col("ok"), F.col("revision_id")).otherwise(F.col("_old")).alias("revision_id"), F.when(F.col("ok"), "ready").otherwise("failed").alias("state"), (~F.col("ok")).alias("recoverable"))


def restart_tasks(tasks: DataFrame) -> DataFrame:
    """tasks(task_id, state, error) when their worker starts anew: what was running was abandoned and has failed."""
    left = F.col("state") == "running"
    return tasks.withColumn("error", F.when(left, "abandoned").otherwise(F.col("error"))).withColumn("state", F.when(left, "failed").otherwise(F.col("state")))
