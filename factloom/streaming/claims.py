"""Claims and leases as a stream: one small state a key, a timer that frees what its holder has let run out.

Events (key, event, owner, at, event_id, seconds) are claim, renew, release and publish. A claim is granted to a key that
is unpublished, due, and unclaimed or claimed too long ago - or claimed by the same owner, where claims are leases that
may be taken again. Every event gives a row that tells whether it was granted and what holds then; a claim that runs out
gives one of its own. What is granted depends on the events' own times alone, so a replay gives the same rows however
the stream was cut into batches; timers only tell of what has run out, and free the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "key string, event string, owner string, at timestamp, granted boolean, attempts long, holder string, until timestamp"


@dataclass(frozen=True)
class Held:
    """A key's state: who holds it until when, from when on it may be claimed, how often it was; times in ms."""

    owner: str | None = None
    until: int = 0
    due: int = 0
    attempts: int = 0
    published: bool = False


def step(held: Held, event: str, owner: str, at: int, seconds: int, again: bool) -> tuple[bool, Held]:
    """Whether an event is granted, and the state after it. seconds: how long a claim or renewal lasts, or a release
    waits. again: whether a holder may claim what it holds already."""
    free = held.owner is None or held.until <= at
    mine = held.owner == owner and not held.published
    if event == "claim":
        if held.published or at < held.due or not (free or again and mine):
            return False, held
        return True, replace(held, owner=owner, until=at + 1000 * seconds, attempts=held.attempts + 1)
    if event == "renew" and mine and not free:
        return True, replace(held, until=at + 1000 * seconds)
    if event == "release" and mine:
        return True, replace(held, owner=None, until=0, due=at + 1000 * seconds)
    if event == "publish" and mine:
        return True, replace(held, owner=None, until=0, published=True)
    return False, held


def _stamp(ms: int):
    return pd.Timestamp(ms, unit="ms") if ms else pd.NaT


class Claims(StatefulProcessor):
    def __init__(self, again: bool, keep_ms: int | None):
        self.again, self.keep_ms = again, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = "owner string, until long, due long, attempts long, published boolean"
        self.state = handle.getValueState("held", schema, self.keep_ms) if self.keep_ms else handle.getValueState("held", schema)

    def _held(self) -> Held:
        return Held(*self.state.get()) if self.state.exists() else Held()

    def _row(self, key: tuple, event: str, owner: str | None, at: int, granted: bool, held: Held) -> tuple:
        return key[0], event, owner, _stamp(at), granted, held.attempts, held.owner, _stamp(held.until)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at_ms", "event_id"], kind="stable")
        before = held = self._held()
        out = []
        for event, owner, at, seconds in zip(events["event"], events["owner"], events["at_ms"], events["seconds"], strict=True):
            at = int(at)
            if held.owner is not None and held.until <= at:
                out.append(self._row(key, "expired", held.owner, held.until, True, replace(held, owner=None, until=0)))
                held = replace(held, owner=None, until=0)
            granted, held = step(held, event, owner, at, int(seconds), self.again)
            out.append(self._row(key, event, owner, at, granted, held))
        self.state.update((held.owner, held.until, held.due, held.attempts, held.published))
        if before.until and before.until != held.until:
            self.handle.deleteTimer(before.until)
        if held.until and before.until != held.until:
            self.handle.registerTimer(held.until)
        yield pd.DataFrame(out, columns=["key", "event", "owner", "at", "granted", "attempts", "holder", "until"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held.owner is not None and held.until <= expiredTimerInfo.getExpiryTimeInMs():
            free = replace(held, owner=None, until=0)
            self.state.update((None, 0, free.due, free.attempts, free.published))
            yield pd.DataFrame([self._row(key, "expired", held.owner, held.until, True, free)], columns=["key", "event", "owner", "at", "granted", "attempts", "holder", "until"])

    def close(self) -> None:
        pass


def stream_claims(events: DataFrame, *, again: bool = False, late: str = "1 minute", live: bool = False, keep_days: int | None = None) -> DataFrame:
    """OUTCOME's rows for a stream of events(key, event, owner, at, event_id, seconds).

    Timers follow the watermark, `late` behind the events; live ones the clock, and a key's state may then go after
    keep_days without an event. The session's state store must be RocksDB's, as for any timers in Spark.
    """
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    rows = events.select(F.col("key").cast("string").alias("key"), "event", "owner", F.col("at").cast("timestamp").alias("at"), "event_id", "seconds", F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"))
    mode = "ProcessingTime" if live else "EventTime"
    if not live:
        rows = rows.withWatermark("at", late)
    processor = Claims(again, keep_days * 86_400_000 if live and keep_days else None)
    return rows.groupBy("key").transformWithStateInPandas(processor, OUTCOME, "append", mode)


def claim(outbox: DataFrame, now, owner: str, *, timeout_seconds: int = 30, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """(the rows claimed, with attempts + 1; the outbox after it) of outbox(id, created_at, published_at, next_attempt_at,
    claimed_at, claim_owner, attempts): the oldest n that may be claimed go to owner."""
    from factloom.streaming import claimable

    got = claimable(outbox, now, timeout_seconds=timeout_seconds, n=n).select("id").withColumn("_got", F.lit(True))
    after = outbox.join(F.broadcast(got), "id", "left")  # n rows
    mine = F.coalesce("_got", F.lit(False))
    after = after.withColumns({"claim_owner": F.when(mine, owner).otherwise(F.col("claim_owner")), "claimed_at": F.when(mine, now).otherwise(F.col("claimed_at")), "attempts": F.col("attempts") + mine.cast("int")})
    return after.where(mine).drop("_got"), after.drop("_got")
