"""Root lookup and the walks of many questions, against plain versions."""

import random
import sys
from pathlib import Path

from factloom.operators import asking

sys.path.insert(0, str(Path(__file__).parent))
from plan_rows import most_rows  # noqa: E402


def test_roots_equal_a_scan(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abC%_") for _ in range(rng.randint(1, 7)))
    entities = [(f"k{i}", word(), word() if i % 3 else None) for i in range(150)] + [("long", "x" * 5000 + "Needle", None), ("none", None, "needle")]
    terms = [(i, word()) for i in range(60)] + [(100, ""), (101, "%"), (102, None), (103, "NEEDLE"), (104, "ab"), (105, "c"), (106, "ab"), (107, "zzz")]
    got = {}
    for r in asking.find_roots(spark.createDataFrame(terms, "question int, term string"), spark.createDataFrame(entities, "stable_key string, name string, attributes string"), 4).collect():
        got.setdefault(r["question"], []).append((r["place"], r["stable_key"]))
    want = {}
    for q, term in terms:
        plain = None if term is None else term.replace("%", "").replace("_", "").lower()
        held = sorted([e for e in entities if plain is not None and any(plain in t.lower() for t in e[1:] if t is not None)], key=lambda e: (e[1] is not None, e[1] or "", e[0]))[:4]
        if held:
            want[q] = [(i, e[0]) for i, e in enumerate(held, 1)]
    assert {q: sorted(v) for q, v in got.items()} == want


def walk(starts, direction, kinds, max_depth, max_nodes, keys, edges):
    roots = sorted({s for s in starts if s in keys})
    depth_of, full = dict.fromkeys(roots[:max_nodes], 0), len(roots) > max_nodes
    for depth in range(1, max_depth + 1):
        if full:
            break
        edge = [e for e in edges if not kinds or e[0] in kinds]
        level = {k for k, d in depth_of.items() if d == depth - 1}
        new = {t for _, s, t in edge if s in level and direction != "incoming"} | {s for _, s, t in edge if t in level and direction != "outgoing"}
        new = sorted(k for k in new if k in keys and k not in depth_of)
        room = max_nodes - len(depth_of)
        full = len(new) > room
        depth_of |= dict.fromkeys(new[:room], depth)
    return depth_of, full


def test_walks_equal_plain_ones(spark):
    rng = random.Random(9)
    keys = [f"k{i:02d}" for i in range(40)]
    edges = [(rng.choice("AB"), rng.choice([*keys, "gone"]), "k00" if i % 3 == 0 else rng.choice(keys)) for i in range(90)]
    asks = [(q, rng.choice(["incoming", "outgoing", "both"]), rng.choice([[], ["A"], ["A", "B"]]), rng.randint(0, 4), rng.choice([1, 3, 8, 80])) for q in range(40)]
    starts = [(q, rng.choice([*keys, "gone"])) for q in range(40) for _ in range(q % 4)]
    nodes, limits = asking.neighbourhoods(
        spark.createDataFrame(starts, "question int, stable_key string"), spark.createDataFrame(asks, "question int, direction string, kinds array<string>, max_depth int, max_nodes int"),
        spark.createDataFrame([(k,) for k in keys], "stable_key string"), spark.createDataFrame(edges, "kind string, source_key string, target_key string"),
    )
    got, full = {q: {} for q in range(40)}, {r["question"]: r["truncated"] for r in limits.collect()}
    for r in nodes.collect():
        assert r["stable_key"] not in got[r["question"]]
        got[r["question"]][r["stable_key"]] = r["depth"]
    for q, direction, kinds, depth, most in asks:
        assert (got[q], full[q]) == walk([s for i, s in starts if i == q], direction, kinds, depth, most, set(keys), edges), q


def test_answers_without_chunks(spark):
    entities = spark.createDataFrame([("a", "class", "Pool", "app.Pool", None), ("b", "method", "take", None, None)], "stable_key string, kind string, name string, qualified_name string, attributes string")
    edges = spark.createDataFrame([("r", "CALLS", "b", "a")], "id string, kind string, source_key string, target_key string")
    places = spark.createDataFrame([("b", "x.ts", 3), ("b", "x.ts", 9)], "stable_key string, path string, start_line int")
    questions = spark.createDataFrame([(1, "who calls Pool"), (2, "who calls Nobody"), (3, "is it any good"), (4, ""), (5, None), (6, "where is Pool")], "question int, text string")
    rows = {r["question"]: r for r in asking.ask(questions, entities, edges, places).collect()}
    assert len(rows) == 6
    assert rows[1]["answer"] == "Confirmed structural evidence:\n- class app.Pool\n- method take [E1]"
    assert (rows[1]["citations"], rows[1]["confidence"], rows[1]["degraded"]) == (["E1", "E2"], "high", ["Semantic projection is unavailable"])
    assert rows[2]["degraded"] == ["No canonical entity matched Nobody", "Semantic projection is unavailable"] and rows[2]["confidence"] == "low"
    assert rows[3]["intent"] == "semantic_unknown" and rows[3]["degraded"] == ["Semantic projection is unavailable"]
    assert rows[4]["intent"] is None and rows[5]["confidence"] == "low"
    assert (rows[6]["answer"], rows[6]["confidence"]) == ("Confirmed structural evidence:\n- class app.Pool", "low")


def test_a_term_of_common_grams_meets_only_what_holds_it(spark):
    number = lambda n: f"lpad(bin({n}), 10, '0')"
    entities = spark.range(3000).selectExpr("concat('k', id) stable_key", f"concat('Customer#', {number('id % 1000')}) name", "'segment=A' attributes")
    terms = spark.range(1000).selectExpr("cast(id as int) question", f"concat('customer#', {number('id')}) term")
    rows, most = most_rows(asking.find_roots(terms, entities, 2))
    assert sorted((r["question"], r["place"]) for r in rows) == [(q, i) for q in range(1000) for i in (1, 2)]
    assert most <= 3000 * (18 + 9)  # no more than the texts have grams


def test_a_hub_gives_a_question_no_more_than_it_can_take(spark, monkeypatch):
    seen, plain = [], asking.kept
    monkeypatch.setattr(asking, "kept", lambda df: (seen.append(most_rows(df)[1]), plain(df))[1])
    entities = spark.range(1500).selectExpr("concat('k', id) stable_key").union(spark.sql("select 'hub'"))
    edges = spark.range(1500).selectExpr("'A' kind", "'hub' source_key", "concat('k', id) target_key")
    starts = spark.range(400).selectExpr("cast(id as int) question", "'hub' stable_key")
    asks = starts.selectExpr("question", "'outgoing' direction", "array('A') kinds", "2 max_depth", "4 max_nodes")
    nodes, limits = asking.neighbourhoods(starts, asks, entities, edges)
    first = sorted(f"k{i}" for i in range(1500))[:3]
    assert sorted((r["stable_key"]) for r in nodes.where("question = 7").collect()) == ["hub", *first] and nodes.count() == 1600
    assert limits.where("truncated").count() == 400 and max(seen) <= 10_000
