from factloom.operators import report as R


def test_a_small_change(spark):
    schema = "stable_key string, kind string, name string, attributes string"
    base = [("c:pay", "class", "Pay", "a"), ("m:shop", "module", "shop", None), ("e:get", "endpoint", "/pay", None), ("t:pay", "test", "PayTest", None), ("t:api", "test", "ApiTest", None), ("t:x", "test", "Other", None), ("c:old", "class", "Old", None), ("d:1", "documentation_page", "Guide", None)]
    target = [("c:pay", "class", "Pay", "b"), *base[1:6], base[7], ("c:new", "class", "AuthToken", None)]
    edges = "id string, kind string, source_key string, target_key string, confidence double"
    both = [("1", "TESTS", "t:pay", "c:pay", None), ("2", "HANDLES", "c:pay", "e:get", None), ("3", "CONTAINS", "m:shop", "c:pay", None), ("4", "TESTS", "t:api", "e:get", None), ("5", "DOCUMENTS", "d:1", "c:pay", None)]
    frame = spark.createDataFrame
    files = frame([("b.java",), ("a.java",), ("a.java",)], "path string")
    rows, cut = R.report(frame(base, schema), frame(target, schema), frame([*both, ("6", "CALLS", "c:old", "c:pay", None)], edges), frame(both, edges), files)
    got = {}
    for r in rows.orderBy("ordinal", "order").collect():
        got.setdefault(r["section"], []).append(r["line"])
    assert not cut and list(got) == list(R.SECTIONS)
    assert got["Changed files"] == ["- `a.java`", "- `b.java`"]
    assert got["Semantic changes"] == ["- **added** `c:new`", "- **removed** `c:old`", "- **modified** `c:pay` (attributes)"]
    assert got["Behavior changes"] == ["_None._"]
    assert (got["Affected APIs"], got["Affected modules"], got["Affected documentation"]) == (["- `e:get`"], ["- `m:shop`"], ["- `d:1`"])
    assert got["Suggested tests"] == ["- `t:pay` — Direct TESTS relationship to a changed entity (0.95, confirmed)", "- `t:api` — Covers an endpoint connected to a changed entity (0.90, inferred)"]
    assert got["Risk factors"][0] == "- **authentication-or-authorization (+25)**" and len(got["Suggested review focus"]) == min(5, len(got["Risk factors"]))


def test_nothing_changed(spark):
    one = spark.createDataFrame([("c", "class", "C", None)], "stable_key string, kind string, name string, attributes string")
    none = spark.createDataFrame([], "id string, kind string, source_key string, target_key string, confidence double")
    rows, cut = R.report(one, one, none, none, spark.createDataFrame([], "path string"))
    assert [r["line"] for r in rows.orderBy("ordinal").collect()] == ["_None._"] * 9 and not cut
