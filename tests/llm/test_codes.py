import hashlib
import math

import numpy as np
from factloom.llm import codes


def brute(rows, parts, entries, rounds):
    """Plain Lloyd rounds in Python integers."""
    kept = [(i, [max(-codes.BOUND, min(codes.BOUND, math.floor(256 * float(x)))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max([len(v) for _, v, _ in kept], default=1) or 1
    w = -(-width // parts)
    kept = [(i, v + [0] * (w * parts - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * w : (p + 1) * w] for _, v, _ in first] for p in range(parts)]
    cost = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, v: min((cost(v[p * w : (p + 1) * w], c), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        labels = [[near(p, v)[1] for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for j in range(len(first)):
                if own := [v[p * w : (p + 1) * w] for (_, v, _), a in zip(kept, labels[p]) if a == j]:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    done = [(i, [near(p, v) for p in range(parts)], label) for i, v, label in kept]
    total = {}
    for _, found, label in done:
        total[label] = total.get(label, 0) + sum(d for d, _ in found)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((repr(i), "".join(f"{a:02x}" for _, a in found), sum(d for d, _ in found), total[label], digest) for i, found, label in done)


def got(df, *args):
    return sorted((repr(r["vec_id"]), *r[1:]) for r in codes.compress(df, *args).collect())


def test_driver_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").limit(200)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]
    assert got(vectors, 16, 64, 2) == brute(rows, 16, 64, 2)


def test_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=8), 1)], int(i) % 3 or None) for i in rng.permutation(150)]
    rows += [(i, [0.5, 0.0, 0.0, 1.0, 0.0, 0.0, 0.25, -0.25], 1) for i in range(150, 230)]  # copies and ties
    rows += [(300, None, 1), (301, [1.0, None] * 4, 1), (302, [float("nan")] * 8, 2), (303, [float("inf")] + [0.0] * 7, 1), (304, [], 9), (305, [0.1, -3.0], None), (None, [0.3] * 8, 1), (150, [9.0] * 8, 7), (306, [1e30, -1e30] * 4, 1), (307, [0.3] * 7, 1)]
    df = spark.createDataFrame([(*r, "x", 1.0, {"a": 1}) for r in rows], "vec_id long, embedding array<double>, label int, code string, error double, v map<string,int>")
    monkeypatch.setattr(codes, "BLOCK", 50)
    for parts, entries, rounds in ((4, 16, 2), (8, 64, 3), (3, 5, 1), (2, 256, 2), (4, 16, 0)):
        assert got(df, parts, entries, rounds) == brute(rows, parts, entries, rounds)
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    assert got(df, 4, 16, 2) == brute(rows, 4, 16, 2)
    assert codes.compress(df.where("vec_id < 0")).collect() == []
    assert got(df.where("vec_id = 304"), 4, 16, 2) == brute([(304, [], 9)], 4, 16, 2)


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(2)
    centres = rng.integers(-400, 400, size=(20, 4))
    x = (centres[rng.integers(0, 20, 3000)] + rng.integers(-9, 9, size=(3000, 4))).astype(np.int64)
    entries, before = x[:20].copy(), None
    code, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf), np.zeros((3000, 20))
    spent = []
    for _ in range(4):
        model = codes.Elkan(entries, before)
        code = model.assign(x, code, upper, lower)
        exact = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (code == exact.argmin(1)).all()
        root = np.sqrt(exact)
        assert (upper >= root[np.arange(3000), code]).all() and (lower <= root).all()
        packed, step = codes._pack_lower(lower[:, None, :])
        assert (packed[:, 0] * (step.astype(float) * codes._DOWN) <= root).all()
        spent.append(model.computed)
        before = entries
        entries = np.stack([x[code == j].sum(0) // (code == j).sum() if (code == j).any() else entries[j] for j in range(20)])
    assert spent[0] < 0.6 * 3000 * 20 and spent[-1] < 0.15 * 3000 * 20
