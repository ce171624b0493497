"""Stateful work queues as event logs: batch folds, and the same state kept by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A row's state after its events: (event, new state).
TRANSITIONS = {"request": "pending", "claim": "claimed", "release": "pending", "publish": "published"}


def fold(events: DataFrame) -> DataFrame:
    """key, state, attempts and last of events(key, event, at, event_id): what each key's events lead to.

    Published is final. Attempts are claims before it. Only aggregates: the last event that counts, and counts.
    """
    when = F.struct("at", "event_id")
    first = events.where(F.col("event") == "publish").groupBy("key").agg(F.min(when).alias("published"))
    e = events.join(first, "key", "left").where(F.col("published").isNull() | (when <= F.col("published")))
    state = F.coalesce(*[F.when(F.col("event") == k, v) for k, v in TRANSITIONS.items()], F.col("event"))
    return e.groupBy("key").agg(F.max_by(state, when).alias("state"), F.count_if(F.col("event") == "claim").alias("attempts"), F.max("at").alias("last"))


def claimable(outbox: DataFrame, now, *, timeout_seconds: int = 30, n: int = 20) -> DataFrame:
    """The oldest n rows that are unpublished, due, and unclaimed or claimed too long ago."""
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    free = F.col("claimed_at").isNull() | (F.col("claimed_at") <= now - F.expr(f"INTERVAL {timeout_seconds} SECONDS"))
    return outbox.where(F.col("published_at").isNull() & due & free).orderBy("created_at", "id").limit(n)


def backoff_seconds(attempts, base: int = 1, most: int = 300):
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), F.greatest(attempts - 1, F.lit(0)))).cast("long")


def leases(requests: DataFrame, now, owner: str, seconds: int = 60) -> DataFrame:
    """requests(id, lease_owner, lease_expires_at) after `owner` asks for each: acquired where free, expired or its own."""
    may = F.col("lease_owner").isNull() | (F.col("lease_expires_at") <= now) | (F.col("lease_owner") == owner)
    until = now + F.expr(f"INTERVAL {seconds} SECONDS")
    return requests.select("id", F.when(may, F.lit(owner)).otherwise(F.col("lease_owner")).alias("lease_owner"), F.when(may, until).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"), may.alias("acquired"))


#: The stages of a scan, in order.
STAGES = ("snapshot", "parse", "activate", "embed", "document", "impact", "complete")


def job_state(events: DataFrame) -> DataFrame:
    """job, stage, state, completed: events(job, stage, outcome, at) folded along STAGES.

    A stage counts once all before it have; a failed one is where the job resumes; cancelled is final.
    """
    done = F.collect_set(F.when(F.col("outcome") == "done", F.col("stage"))).alias("done")
    per_job = events.groupBy("job").agg(done, F.max_by("outcome", "at").alias("last"))  # seven stages at most
    stages = F.array(*map(F.lit, STAGES))
    n = F.aggregate(stages, F.lit(0), lambda k, s: F.when((k == F.array_position(stages, s).cast("int") - 1) & F.array_contains("done", s), k + 1).otherwise(k))
    out = per_job.select("job", n.alias("completed"), "last")
    state = F.when(F.col("last") == "cancelled", "cancelled").when(F.col("completed") == len(STAGES), "completed").when(F.col("last") == "failed", "failed").otherwise("running")
    return out.select("job", F.get(stages, F.least(F.col("completed"), F.lit(len(STAGES) - 1))).alias("stage"), state.alias("state"), "completed")


def projection_lag(projections: DataFrame, active: DataFrame) -> DataFrame:
    """repository, projection, fresh: whether a projection (repository, projection, revision) is at the active revision."""
    return projections.join(active.withColumnRenamed("revision", "active"), "repository", "left").select("repository", "projection", (F.col("revision") == F.col("active")).alias("fresh"))


def stream_fold(events: DataFrame) -> DataFrame:
    """fold() over an unbounded stream of events: update mode, one row a key and batch that changes it.

    State a key is its latest counting event and two counters, however many events it has had.
    """
    schema = "key string, state string, attempts long, last timestamp"
    state_schema = "state string, attempts long, last timestamp, published boolean"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        name, attempts, last, published = state.get if state.exists else (None, 0, None, False)
        rows = pd.concat([b[["event", "at", "event_id"]] for b in batches]).sort_values(["at", "event_id"], kind="stable")
        for event, at in zip(rows["event"], rows["at"], strict=True):
            if published:
                break
            name, last = TRANSITIONS.get(event, event), at
            attempts += event == "claim"
            published = event == "publish"
        state.update((name, int(attempts), None if last is None else pd.Timestamp(last).to_pydatetime(), published))
        yield pd.DataFrame({"key": [key[0]], "state": [name], "attempts": [int(attempts)], "last": [last]})

    return events.groupBy("key").applyInPandasWithState(update, schema, state_schema, "update", "NoTimeout")


def stream_once(events: DataFrame, key: str = "idempotency_key", late: str = "1 hour", at: str = "at") -> DataFrame:
    """Idempotent enqueue: the first event of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def renew(leases_: DataFrame, now, owner: str, seconds: int = 60) -> DataFrame:
    """leases_(id, lease_owner, lease_expires_at) after `owner` renews what is its own and hasn't expired; with renewed."""
    may = F.coalesce((F.col("lease_owner") == owner) & (F.col("lease_expires_at") > now), F.lit(False))
    until = now + F.expr(f"INTERVAL {seconds} SECONDS")
    return leases_.select("id", "lease_owner", F.when(may, until).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"), may.alias("renewed"))


def release(leases_: DataFrame, owner: str) -> DataFrame:
    """leases_(id, lease_owner, lease_expires_at) after `owner` gives back what is its own; with released."""
    mine = F.coalesce(F.col("lease_owner") == owner, F.lit(False))
    free = lambda c: F.when(~mine, F.col(c)).alias(c)
    return leases_.select("id", free("lease_owner"), free("lease_expires_at"), mine.alias("released"))


def settle(outbox: DataFrame, outcomes: DataFrame, now, *, most: int = 5) -> DataFrame:
    """id, state, attempts and next_attempt_at of outbox(id, claimed_by, attempts) after outcomes(id, owner, ok): who claimed
    a row may publish it or release it for later; after `most` attempts it is dead."""
    both = outbox.join(outcomes.select("id", "owner", "ok"), "id", "left")
    mine = F.coalesce(F.col("owner") == F.col("claimed_by"), F.lit(False))
    attempts = F.col("attempts") + F.when(mine & ~F.col("ok"), 1).otherwise(0)
    state = F.when(~mine, "claimed").when(F.col("ok"), "published").when(attempts >= most, "dead").otherwise("pending")
    out = both.select("id", state.alias("state"), attempts.alias("attempts"))
    wait = F.make_dt_interval(secs=backoff_seconds(F.col("attempts")).cast("decimal(18,6)"))
    return out.withColumn("next_attempt_at", F.when(F.col("state") == "pending", now + wait))
