import math

import numpy as np
import pytest
from factloom.llm import neighbours as N
from pyspark.sql import functions as F


def score(a, b):
    total = 0.0
    for x, y in zip(a, b):  # sum() would compensate
        total += float(x) * float(y)
    return total


def brute(rows, k, step):
    """Every query's k best rows: (query, rank, id, score), scores added up in order."""
    good = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in sorted({i for i, _ in good if i % step == 0}):
        asked = min(v for i, v in good if i == q)
        found = sorted((-score(asked, v), i) for i, v in good if i != q)[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def got(df, k, step):
    out = {}
    for r in N.nearest(df, F.col("vec_id") % step == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(found, want):
    """Rows found that score at least what the last true one scores."""
    hit = sum(sum(s >= want[q][-1][1] for _, s in found.get(q, [])) for q in want)
    return hit / sum(map(len, want.values()))


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_driver_tables(spark, table):
    vectors = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    found, want = got(vectors, 20, 20), brute(rows, 20, 20)
    assert found.keys() == want.keys() and all(len(f) == 20 for f in found.values())
    assert recall(found, want) >= 0.97
    exact = dict(rows)
    for q, pairs in found.items():
        assert q not in dict(pairs)
        assert all(s == score(exact[q], exact[i]) for i, s in pairs)


@pytest.mark.parametrize("kind", ["clusters", "norms", "copies"])
def test_recall_on_other_shapes(spark, kind):
    rng = np.random.default_rng(3)
    n, d = 3000, 16
    x = rng.normal(size=(n, d))
    if kind == "clusters":  # tight and far apart
        x = rng.normal(size=(30, d))[rng.integers(0, 30, n)] * 10 + x * 0.05
    elif kind == "norms":
        x *= np.exp(rng.normal(size=(n, 1)))
    else:  # a third of all rows is one vector, a third are 40 others
        x[: n // 3] = x[0]
        x[n // 3 : 2 * n // 3] = x[n // 3 : n // 3 + 40][rng.integers(0, 40, n // 3)]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(n), x)]
    found, want = got(spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(3), 10, 20), brute(rows, 10, 20)
    assert all(len(f) == 10 for f in found.values()) and recall(found, want) >= 0.95
    if kind == "copies":  # ties go to the smaller ids
        shared = {q for q in want if x[[i for i, _ in rows].index(q)].tolist() == x[0].tolist()}
        assert shared and all(found[q] == want[q] for q in shared)


def test_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(60)]
    rows += [(i, [0.5, 0.0, 0.0, 1.0]) for i in range(60, 90)]
    rows += [(90, None), (100, [1.0, None, 0.0, 0.0]), (110, [float("nan")] * 4), (120, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (130, []), (140, [0.0, -0.0]), (20, [0.1, 0.2]), (60, [0.5, 0.0, 0.0, 1.0]), (60, [0.5, -0.0, 0.0, 1.0]), (150, [1e150, 1.0]), (160, [1e-300, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1.0, {"a": 1}, None) for r in rows], "vec_id long, embedding array<double>, v string, score double, ids map<string,int>, shard int")
    want = brute(rows, 7, 10)
    for shards, most, block in ((8, 262_144, 16_384), (1, 20, 2)):
        monkeypatch.setattr(N, "SHARDS", shards)
        monkeypatch.setattr(N, "SHARD_ROWS", most)
        monkeypatch.setattr(N, "QUERIES", block)
        assert got(df, 7, 10) == want
    assert got(df.where("vec_id < -1"), 7, 10) == {}
    assert got(df.where("vec_id = 20"), 7, 10) == {}
    assert got(df.where("vec_id in (20, 21)"), 7, 10) == brute([r for r in rows if r[0] in (20, 21)], 7, 10)


def test_pruning_keeps_diverse_edges():
    angles = np.array([0.0, 0.1, 0.11, 0.12, -0.2, -0.21, 1.5])
    points = np.stack((np.cos(angles), np.sin(angles)), 1).astype(np.float32)
    kept = N.robust_prune(points, np.array([0]), np.array([[1, 2, 3, 4, 5, 6, -1]]), degree=4)[0]
    assert kept.tolist() == [1, 4, 6, 2]  # diverse ones first, then the nearest
    assert N.robust_prune(points, np.array([0]), np.array([[0, -1, -1, -1, -1, -1, -1]]), degree=4)[0].tolist() == [-1] * 4
