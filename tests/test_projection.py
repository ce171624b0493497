import random
from pathlib import Path

import pytest
from factloom.operators import projection as P


def plain(table, chunks, updated, removed, model, revision):
    out = {}
    for i, (parent, checksum, m, r) in table.items():
        if parent in removed or parent in updated and i not in chunks:
            continue
        out[i] = (parent, checksum, m, r)
    for i, (parent, checksum) in chunks.items():
        old = table.get(i)
        if old and parent in removed:
            continue
        out[i] = (parent, checksum, model, revision)
    return out


def test_two_revisions_equal_the_plain_table(spark, tmp_path):
    rng, root = random.Random(3), str(tmp_path / "chunks")
    table, schema = {}, "id string, parent string, checksum string, model string, revision string, vector array<double>"
    stored = spark.createDataFrame([], schema)
    for revision, model in (("r1", "m"), ("r2", "m"), ("r3", "m2")):
        parents = [f"p{i}" for i in range(40)] if revision == "r1" else [f"p{i}" for i in range(8)]
        chunks = {f"{p}:{n}": (p, rng.choice("xy")) for p in parents for n in range(rng.randrange(4))}
        removed = {"p38", "p39"} if revision == "r2" else set()
        frame = spark.createDataFrame([(i, *c) for i, c in chunks.items()], "id string, parent string, checksum string")
        one = lambda x: spark.createDataFrame([(p,) for p in x], "parent string")
        planned = P.kept(P.plan(stored, frame, one(parents), one(removed), model))
        asked = [r["id"] for r in planned.where("action = 'embed'").collect()]
        assert set(asked) == {i for i, (_, c) in chunks.items() if i not in table or table[i][1:3] != (c, model)}
        vectors = spark.createDataFrame([(i, [1.0]) for i in asked], "id string, vector array<double>")
        before = {f: f.stat().st_mtime_ns for f in Path(root).rglob("*.parquet")}
        n = P.write(P.merged(stored, frame, planned, vectors, model, revision), planned, root, parts=64)
        table = plain(table, chunks, set(parents), removed, model, revision)
        stored = spark.read.schema(schema).parquet(root)
        assert {r["id"]: tuple(r)[1:5] for r in stored.collect()} == table
        assert stored.where("vector is null").isEmpty()
        after = {f: f.stat().st_mtime_ns for f in Path(root).rglob("*.parquet")}
        if revision != "r1":
            assert n <= 10 and len(before.keys() & after.keys()) >= 15 and all(before[f] == after[f] for f in before.keys() & after.keys())
    assert P.write(stored, planned.where("action = 'keep'"), root) == 0


def test_a_missing_vector_is_told(spark):
    chunks = spark.createDataFrame([("a:0", "a", "x")], "id string, parent string, checksum string")
    none = spark.createDataFrame([], "id string, parent string, checksum string, model string, revision string, vector array<double>")
    planned = P.plan(none, chunks, chunks, none.select("parent"), "m")
    with pytest.raises(ValueError):
        P.merged(none, chunks, planned, none.select("id", "vector"), "m", "r1")
