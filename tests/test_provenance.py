import random
import sys
from pathlib import Path

from factloom import catalog_queries  # noqa: F401
from factloom import queries as Q
from factloom.operators.provenance import closest_enclosing, structural_references

sys.path.insert(0, str(Path(__file__).parent))
from plan_rows import most_rows, operators  # noqa: E402


def _plain(places, declarations):
    out = {}
    for i, path, line in places:
        around = [(e - s, -s, k) for k, p, s, e in declarations if p == path and s <= line <= e]
        out[i] = min(around)[2] if around else None
    return out


def test_closest_enclosing_equals_brute_force(spark):
    rng = random.Random(7)
    declarations = [(f"d{i}", rng.choice("ab"), s := rng.randrange(-5, 300), s + rng.choice([0, 0, 1, 3, 7, 8, 40, 255, -3])) for i in range(400)]
    declarations += [("z1", "c", 4, 4), ("z0", "c", 4, 4), ("y", "c", 3, 4), ("x", "c", 4, 5)]
    places = [(i, rng.choice("abc"), rng.randrange(-10, 320)) for i in range(600)] + [(1000, "c", 4), (1001, "none", 4)]
    found = closest_enclosing(spark.createDataFrame(places, "id long, path string, line int"), spark.createDataFrame(declarations, "stable_key string, path string, start_line int, end_line int"))
    assert {r["id"]: r["owner"] for r in found.collect()} == _plain(places, declarations)


def test_a_place_meets_no_row_for_each_declaration_around_it(spark):
    declarations = spark.range(2000).selectExpr("concat('d', id) stable_key", "'f' path", "cast(id % 40 as int) start_line", "cast(100 + id as int) end_line")
    places = spark.range(2000).selectExpr("id", "'f' path", "cast(40 + id % 60 as int) line")
    rows, most = most_rows(closest_enclosing(places, declarations))
    assert len(rows) == 2000 and {r["owner"] for r in rows} == {"d39"}
    assert most <= 20 * 2000


def test_keys_of_a_union_are_asked_for_once(spark):
    part = lambda i: spark.range(20).selectExpr(f"concat('k{i}:', id) stable_key", "concat('n', id) name")
    entities = part(0).union(part(1)).union(part(2)).union(part(3))
    places = entities.selectExpr("stable_key", "cast(substr(stable_key, 4) as long) artifact_id", "1 start_line", "2 end_line").where("artifact_id < 15")
    artifacts = spark.range(10).selectExpr("id artifact_id", "concat('f', id) path")
    found = structural_references(entities.where("stable_key like 'k1:%'").union(part(1)), places, entities, artifacts)
    names = operators(found)
    rows = sorted((r["stable_key"], r["name"], r["path"]) for r in found.collect())
    assert rows == sorted((f"k1:{i}", f"n{i}", f"f{i}") for i in range(10))
    assert not [n for n in names if n.startswith("Broadcast")]


def test_references_are_numbered_in_order_of_path_and_line(spark):
    rng = random.Random(3)
    files = {i: rng.choice("fghij") + str(i % 7) for i in range(40)}
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}", rng.randrange(50), line := rng.choice([None, *range(12)]), None if line is None else line + rng.randrange(4)) for _ in range(900)]
    names = {k: "n" + k for k, *_ in rows if k != "k7"}
    frame = spark.createDataFrame
    places = frame(rows, "stable_key string, artifact_id int, start_line int, end_line int").repartition(5)
    keys = frame([(k,) for k in {k for k, *_ in rows} - {"k3"}], "stable_key string")
    found = structural_references(keys, places, frame(list(names.items()), "stable_key string, name string"), frame(list(files.items()), "artifact_id int, path string"))
    last = lambda x: (x is None, x or 0)
    want, n = [], {}
    for k, a, s, e in sorted(((k, files[a], s, e) for k, a, s, e in rows if a in files and k in names and k != "k3"), key=lambda r: (r[1], last(r[2]), r[0], last(r[3]))):
        n[k] = n.get(k, 0) + 1
        want.append((k, names[k], a, s, e, n[k]))
    got = [(r["stable_key"], r["name"], r["path"], r["start_line"], r["end_line"], r["n"]) for r in found.collect()]
    assert got == want and max(n.values()) > 300


def test_the_query_of_references_keeps_their_order(spark):
    got = [(r["path"], r["start_line"]) for r in Q.QUERIES["structural_references"](spark, "/root/testdata/sf0.001").collect()]
    assert got == sorted(got) and len(set(got)) > 100
