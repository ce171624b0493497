"""Documents written from facts, and reachability at any depth."""

from factloom.operators import documentation, graph, summary

ENTITY = "kind string, name string, qualified_name string, confidence double, attributes string"


def test_sections_without_facts_say_so(spark):
    empty = spark.createDataFrame([], ENTITY)
    for kind, titles in summary.SECTIONS.items():
        rows = summary.document_lines(empty, kind).collect()
        assert [(r["ordinal"], r["section"], r["line"]) for r in rows] == [(i, t, summary.EMPTY[t]) for i, t in enumerate(titles)]
    assert summary.document_overview(empty, "r").first()[0] == "This page is grounded in revision `r` and 0 selected canonical facts."


def test_null_and_broken_attributes(spark):
    rows = [("endpoint", "/a", None, None, None), ("endpoint", "/b", None, 0.5, "{"), ("endpoint", "/c", None, 1.0, '{"httpMethod": "PUT", "normalizedPath": "/x", "requestType": "In"}'), ("build_script", "s", None, None, '{"commands": 5}')]
    facts = spark.createDataFrame(rows, ENTITY)
    assert sorted(r["line"] for r in summary.document_lines(facts, "api").collect()) == ["- `PUT /x` — request: In", "- `UNKNOWN /a`", "- `UNKNOWN /b`"]
    commands = summary.document_lines(facts, "onboarding").where("section = 'Local commands'").collect()
    assert [r["line"] for r in commands] == [summary.EMPTY["Local commands"]]


def test_a_handler_of_many_endpoints_keeps_the_first(spark):
    entities = spark.createDataFrame([("h", "H")] + [(f"e{i}", f"/{i}") for i in range(5)], "stable_key string, name string")
    relationships = spark.createDataFrame([("HANDLES", "h", f"e{i}") for i in range(5)], "kind string, source_key string, target_key string")
    assert summary.api_document(entities, relationships, most=3).first()["document"] == "# H\n\n- `/0`\n- `/1`\n- `/2`\n- and 2 more"


def test_reachability_ends_with_the_graph(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(11)] + [("n11", "n0")]
    edges = spark.createDataFrame(chain, "source_key string, target_key string")
    start = spark.createDataFrame([("n0",)], "stable_key string")
    found = {r["stable_key"]: r["depth"] for r in graph.reachable(edges, start, merge_every=4).collect()}
    assert found == {f"n{i}": i for i in range(12)}
    assert graph.reachable(edges, start, max_depth=2).count() == 3


def test_pages_are_read_once_for_gaps_and_health(spark, monkeypatch):
    from factloom import queries as Q

    seen, gaps = [], documentation.detect_gaps
    monkeypatch.setattr(documentation, "detect_gaps", lambda entities, claims: seen.append(claims) or gaps(entities, claims))
    assert Q.documentation_health(spark, "/root/testdata/sf0.001").count() == 1
    assert "mapin" not in seen.pop()._jdf.queryExecution().optimizedPlan().toString().lower()
    monkeypatch.setattr(documentation, "compare_claims", None)  # gaps need no comparison, which reads all pages too
    assert Q.documentation_gaps(spark, "/root/testdata/sf0.001").count() > 0
