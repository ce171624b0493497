import math

import numpy as np
from factloom.llm import topk
from pyspark.sql import functions as F


def brute(rows, k, step):
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % step == 0}):
        asked = min(v for i, v in usable if i == q)
        found = sorted((-sum(a * b for a, b in zip(asked, v)), i) for i, v in usable if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return out


def test_driver_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = topk.search(vectors, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    assert [tuple(r) for r in got] == brute(rows, 5, 50)


def test_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(60)]
    rows += [(i, [0.5, 0.0, 0.0, 1.0]) for i in range(60, 90)]  # ties
    rows += [(90, None), (100, [1.0, None, 0.0, 0.0]), (110, [float("nan")] * 4), (120, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (130, []), (20, [0.1, 0.2]), (61, [0.5, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, v string, score int")
    want = brute([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5, 10)
    for queries, candidates in ((4096, 32768), (2, 7)):
        monkeypatch.setattr(topk, "QUERIES", queries)
        monkeypatch.setattr(topk, "CANDIDATES", candidates)
        got = topk.search(df, F.col("vec_id") % 10 == 0, 5).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == want
    assert topk.search(df.where("vec_id < -1"), F.col("vec_id") % 10 == 0, 5).count() == 0
    assert topk.search(df.where("vec_id = 20 or vec_id = 21"), F.col("vec_id") % 10 == 0, 5).count() == 1
