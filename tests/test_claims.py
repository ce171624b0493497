import random
from datetime import datetime, timezone

import pytest
from factloom.streaming import claims as C
from pyspark.sql import functions as F


@pytest.fixture
def rocks(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", C.PROVIDER)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


def plain(events, again):
    """The rows that events give, key by key, and what runs out after them."""
    out, held = [], {}
    for key, event, owner, at, _, seconds in sorted(events, key=lambda e: (e[0], e[3], e[4])):
        h = held.get(key, {"owner": None, "until": 0, "due": 0, "n": 0, "done": False})
        if h["owner"] and h["until"] <= at:
            out.append((key, "expired", h["owner"], h["until"], True, h["n"], None))
            h = h | {"owner": None}
        mine = h["owner"] == owner and not h["done"]
        granted = False
        if event == "claim":
            granted = not h["done"] and at >= h["due"] and (h["owner"] is None or again and mine)
            h = h | {"owner": owner, "until": at + seconds, "n": h["n"] + 1} if granted else h
        elif event == "renew" and mine:
            granted, h = True, h | {"until": at + seconds}
        elif event == "release" and mine:
            granted, h = True, h | {"owner": None, "due": at + seconds}
        elif event == "publish" and mine:
            granted, h = True, h | {"owner": None, "done": True}
        out.append((key, event, owner, at, granted, h["n"], h["owner"]))
        held[key] = h
    return out, held


def run(session, tmp_path, events, files, again):
    rows = session.createDataFrame(events, "key string, event string, owner string, n long, event_id long, seconds int")
    rows = rows.withColumn("at", F.timestamp_seconds("n")).drop("n")
    cut = sorted({e[3] for e in events})
    for i in range(files):
        low, high = cut[len(cut) * i // files], cut[len(cut) * (i + 1) // files] if i + 1 < files else 1 << 40
        rows.where((F.unix_seconds("at") >= low) & (F.unix_seconds("at") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = session.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = C.stream_claims(stream, again=again, late="0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination(200)
    assert out.exception() is None
    got = session.read.parquet(str(tmp_path / "out")).withColumn("at", F.unix_seconds("at")).collect()
    return [(r["key"], r["event"], r["owner"], r["at"], r["granted"], r["attempts"], r["holder"]) for r in got]


@pytest.mark.parametrize("again,files", [(False, 1), (True, 3)])
def test_stream_equals_plain_replay(rocks, tmp_path, again, files):
    rng = random.Random(7)
    events = [(f"k{rng.randrange(6)}", rng.choice(["claim", "claim", "renew", "release", "publish"] if i % 9 else ["publish"]), rng.choice("ab"), 1000 + 10 * i, i, rng.choice([20, 60])) for i in range(120)]
    got = run(rocks, tmp_path, events, files, again)
    want, held = plain(events, again)
    # timers tell of what runs out, up to the watermark at the end; later events would have told of the same
    late = [(k, "expired", h["owner"], h["until"], True, h["n"], None) for k, h in held.items() if h["owner"]]
    assert sorted(x for x in got if x not in late) == sorted(want) and len(got) == len(set(got))
    assert {x for x in got if x in late} <= set(late)


def test_a_timer_frees_what_ran_out(rocks, tmp_path):
    events = [("k", "claim", "a", 1000, 1, 30), ("other", "claim", "a", 5000, 2, 30), ("k", "claim", "b", 6000, 3, 30)]
    got = run(rocks, tmp_path, events, 3, False)
    assert ("k", "expired", "a", 1030, True, 1, None) in got and ("k", "claim", "b", 6000, True, 2, "b") in got


def test_other_state_stores_are_refused(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'k' key", "'claim' event", "'a' owner", "timestamp at", "value event_id", "1 seconds")
    with pytest.raises(ValueError):
        C.stream_claims(stream)


def test_batch_claim(spark):
    t = lambda s: datetime.fromtimestamp(s, timezone.utc).replace(tzinfo=None)
    rows = [(1, t(1), None, None, None, None, 0), (2, t(2), None, None, t(95), "x", 1), (3, t(3), None, None, t(10), "x", 4), (4, t(0), t(5), None, None, None, 1), (5, t(4), None, t(500), None, None, 0), (6, t(5), None, t(50), None, None, 2)]
    outbox = spark.createDataFrame(rows, "id long, created_at timestamp, published_at timestamp, next_attempt_at timestamp, claimed_at timestamp, claim_owner string, attempts int")
    got, after = C.claim(outbox, F.timestamp_seconds(F.lit(100)), "me", n=2)
    assert {(r["id"], r["claim_owner"], r["attempts"]) for r in got.collect()} == {(1, "me", 1), (3, "me", 5)}
    assert {(r["id"], r["claim_owner"], r["attempts"]) for r in after.collect()} == {(1, "me", 1), (2, "x", 1), (3, "me", 5), (4, None, 1), (5, None, 0), (6, None, 2)}
