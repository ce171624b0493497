import re
from collections import defaultdict

import pytest
from factloom.llm import mixing as M
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights):
    """The level at which capped shares use up the budget, by bisection."""
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(w * mid, 2 * s) for s, w in zip(sizes, weights)) < 1.5 * sum(sizes) else (low, mid)
    return [min(w * low, 2 * s) for s, w in zip(sizes, weights)]


def holds(docs):
    got = M.in_training_order(M.mix(docs)).collect()
    sizes = defaultdict(int)
    rows = docs.select("doc_id", "source", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, brute_targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-6)
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= 1
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, M.in_training_order(M.mix(docs)).collect()))


def test_mix(documents, odd_documents, no_documents):
    holds(documents)
    holds(odd_documents)
    assert M.mix(no_documents).count() == 0


def test_positions_follow_the_schedule():
    rising = M._positions(lambda t: 2 * t)
    assert rising[M.GRID // 4] == pytest.approx(0.5, abs=1e-3)  # a quarter of the demand is asked for by half time


def test_documents_are_repeated_and_stay_whole(documents, odd_documents):
    for docs in (documents, odd_documents):
        out = M.mix_documents(docs)
        assert out.columns == docs.columns
        times = defaultdict(int)
        for r in out.collect():
            times[r["doc_id"], r["text"]] += 1
        want = defaultdict(int)
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        for r in M.mix(docs.withColumn("doc_id", row)).collect():
            want[r["doc_id"]["doc_id"], r["doc_id"]["text"]] += int(r["taken"] / max(1, r["size"]) + 0.5)
        assert times == {k: n for k, n in want.items() if n}


def test_both_passes_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "one two three four five", "a" if i < 400 else "b") for i in range(1200)], "doc_id long, text string, source string")
    rising = {"weights": (9, 1), "schedule": lambda i: lambda t: 2 * t}  # a gets twice its size
    rows = M.mix(docs, **rising).where("source = 'a'").collect()
    assert all(r["taken"] == 10 and r["position"] < r["second_position"] for r in rows)
    times = sorted(t for r in rows for t in (r["position"], r["second_position"]))
    for t in (0.25, 0.5, 0.75, 0.9):
        assert sum(x <= t for x in times) / 800 == pytest.approx(t * t, abs=0.02)
    order = [r["doc_id"] for r in M.mix_documents(docs, **rising).where("source = 'a'").collect()]
    assert len(order) == 800 and len(set(order[:400])) == 400 and order[:400] == order[400:]


def test_map_columns_are_carried(spark, odd_documents):
    docs = odd_documents.withColumn("m", F.create_map(F.lit("a"), F.col("n_chars"))).withColumn("s", F.struct("m", "text"))
    out = M.mix_documents(docs)
    assert out.columns == docs.columns
    assert all(r["m"] == {"a": r["n_chars"]} for r in out.collect())
    assert {r["text"] for r in out.collect()} <= {r["text"] for r in docs.collect()}


def test_every_ceiling_is_kept(spark):
    docs = spark.createDataFrame([(i, "one two three four five", "a" if i < 20 else "b") for i in range(120)], "doc_id long, text string, source string")
    for ceiling, weights in ((1, (50, 1)), (2, (50, 1)), (2.5, (50, 1)), (3, (50, 1)), (4, (50, 1))):
        rows = M.mix(docs, weights=weights, ceiling=ceiling, budget=1).where("source = 'a'").collect()
        assert sum(r["taken"] for r in rows) == rows[0]["target"] == ceiling * 100
        assert all(r["taken"] <= -(-ceiling // 1) * 5 and len(r["positions"]) == -(-ceiling // 1) for r in rows)
        assert all(p is None or 0 <= p <= 1 for r in rows for p in r["positions"])
    assert M.mix_documents(docs, weights=(50, 1), ceiling=3, budget=1).where("source = 'a'").count() == 60


def test_rows_of_one_id_are_spread(spark):
    """A row that recurs 20,000 times isn't one slice, nor is a null id, and reruns agree whatever the partitions."""
    docs = spark.range(20_000).selectExpr("if(id % 2 = 0, 7, null) doc_id", "'one two three' text", "'a' source").union(spark.createDataFrame([(i, "four five", "b") for i in range(100)], "doc_id int, text string, source string"))
    rows = M.mix(docs)
    positions = rows.where("source = 'a' and taken > 0").select("position").distinct().count()
    assert positions == rows.where("source = 'a' and taken > 0").count()
    keyed = docs.select("*", M._hash_of(docs).alias("_key"), F.spark_partition_id().alias("_part"), F.lit(3).alias("_size"))
    n = M._numbered(keyed, M.Scratch(spark, "t"))
    assert n.groupBy("_key").agg((F.countDistinct("_n") == F.count("*")).alias("ok"), (F.max("_n") == F.count("*") - 1).alias("last")).where("not ok or not last").isEmpty()
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(rows) == plain(M.mix(docs.repartition(5)))
