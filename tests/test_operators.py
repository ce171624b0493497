"""Small literal inputs with known results."""

import math
import re

import numpy as np
import pytest
from factloom import functions as X
from factloom import streaming
from factloom.operators import chunks, diff, documentation, graph, impact, relational
from factloom.sources import inventory, manifests, scanners
from pyspark.sql import functions as F


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column.alias("x")).first()["x"]


def test_redaction_counts_and_leaves_no_secret(spark):
    text = "password = sesame99\nAuthorization: Bearer abcdefgh12345\nmongodb://user:pw@host/db"
    r = one(spark, X.redact_secrets(F.col("c0")), text)
    assert r["count"] == 3 and not re.search("sesame99|abcdefgh12345|:pw@", r["content"])


def test_text_functions(spark):
    assert one(spark, X.normalize_endpoint_path(F.col("c0")), "/a/:id/b?x=1") == "/a/{id}/b"
    assert one(spark, X.slug(F.col("c0")), "PaymentService v2!") == "payment-service-v2"
    assert one(spark, X.title_from_path(F.col("c0")), "docs/getting-started_now.md") == "Getting Started Now"
    assert one(spark, X.normalize_test_name(F.col("c0")), "PaymentService_Tests") == "paymentservice"
    assert one(spark, X.canonical_json(F.col("c0")), '{"b": 1, "a": [2, 1]}') == '{"a":[2,1],"b":1}'
    assert one(spark, X.file_range(F.col("c0"), F.lit("1"), F.lit("3")), "a.ts") == "a.ts:1-3"
    assert one(spark, X.review_diff(F.col("c0"), F.col("c1")), "a\nb", "c") == "-a\n-b\n+c"


@pytest.mark.parametrize(
    "question,intent,term",
    [
        ("What happens when POST /api/restock is called?", "endpoint_flow", "POST /api/restock"),
        ("Which tests should I run after changing `ShelfPlanner`?", "test_impact", "ShelfPlanner"),
        ("Sing about rivers of data", "semantic_unknown", "Sing"),
    ],
)
def test_questions(spark, question, intent, term):
    assert one(spark, X.question_intent(F.col("c0")), question) == intent
    assert one(spark, X.search_term(F.col("c0")), question) == term


@pytest.fixture(scope="module")
def small_graph(spark):
    entities = spark.createDataFrame([("api", "endpoint"), ("service", "class"), ("repository", "class"), ("test", "test")], "stable_key string, kind string")
    edges = spark.createDataFrame([("e1", "CALLS", "api", "service"), ("e2", "CALLS", "service", "repository"), ("e3", "TESTS", "test", "service")], "id string, kind string, source_key string, target_key string")
    return entities, edges


def test_traversal(small_graph):
    t = graph.traverse(*small_graph, ["api"], mode="endpoint-flow", max_depth=2)
    assert {r["stable_key"] for r in t.nodes.collect()} == {"api", "service", "repository"}
    assert {r["id"] for r in t.edges.collect()} == {"e1", "e2"} and not t.truncated
    t = graph.traverse(*small_graph, ["api", "missing"], mode="endpoint-flow", max_depth=2, max_nodes=2)
    assert t.nodes.count() == 2 and t.missing == ["missing"] and t.truncated
    with pytest.raises(ValueError):
        graph.traverse(*small_graph, [])


def test_impact(spark):
    edges = [("1", "HANDLES", "stock-api", "stock-handler"), ("2", "CALLS", "stock-handler", "stock-ledger"), ("3", "TESTS", "stock-probe", "stock-handler"), ("4", "DOCUMENTS", "stock-note", "stock-api")]
    rel = spark.createDataFrame([(*e, None) for e in edges], "id string, kind string, source_key string, target_key string, confidence double")
    got = impact.affected(rel, spark.createDataFrame([("stock-handler",)], "stable_key string")).orderBy(F.desc("confidence"), "stable_key").collect()
    assert [(r["stable_key"], round(r["confidence"], 4)) for r in got] == [("stock-handler", 1.0), ("stock-api", 0.95), ("stock-probe", 0.95), ("stock-note", 0.855), ("stock-ledger", 0.45)]


def test_risk(spark):
    changed = spark.createDataFrame([("endpoint", "POST token restock")], "kind string, text string")
    none = spark.createDataFrame([], "is_root boolean, confidence double")
    factors = impact.score_risk(changed, none, changed_files=2, documentation_gaps=1, unresolved=1)
    got = [(r["factor"], r["weight"]) for r in factors.orderBy("ordinal").collect()]
    assert got == [("authentication-or-authorization", 25), ("public-api", 20), ("missing-tests", 15), ("documentation-gap", 5), ("unresolved-relationships", 2)]
    assert tuple(impact.risk_level(factors).first()) == (67, "High")
    assert impact.review_focus(factors, 2).count() == 2


def test_name_matches_recommend_tests(spark):
    tests = spark.createDataFrame([("t", "paymentservice", [])], "stable_key string, test_name string, path_kinds array<string>")
    none = spark.createDataFrame([], "stable_key string, confidence double")
    (r,) = impact.recommend_tests(tests, none, spark.createDataFrame([("paymentservice",)], "name string")).collect()
    assert (r["score"], r["level"]) == (0.55, "inferred")


def test_diff_ignores_sources_and_parallel_edges(spark):
    e = lambda a, line: spark.createDataFrame([("k", "f", a, line)], "stable_key string, name string, attributes string, line int")
    assert diff.entity_diff(e("login(a)", 1), e("login(a)", 9)).count() == 0
    (r,) = diff.entity_diff(e("login(a)", 1), e("login(a, b)", 1)).collect()
    assert (r["change"], r["changed_fields"]) == ("modified", ["attributes"])
    rel = spark.createDataFrame([("1", "CALLS", "a", "b", None), ("2", "CALLS", "a", "b", None)], "id string, kind string, source_key string, target_key string, confidence double")
    assert diff.relationship_diff(rel, rel.where("id = '2'")).count() == 0


def test_documentation(spark):
    page = "# Auth\n`OldTokenVault` and service PerhapsRelay\nGET /api/shelves/{id}\n`cache.ttlSeconds` = `30`\n[x](src/missing/StockController.java)\n```\npnpm test\n```\n"
    claims = documentation.extract_claims(documentation.parse_markdown(spark.createDataFrame([("docs/a.md", page)], "path string, content string")))
    frame = spark.createDataFrame
    found = documentation.compare_claims(
        claims,
        frame([("GET", "/api/v2/users/{id}")], "method string, path string"),
        frame([("Authentication", None)], "name string, qualified_name string"),
        frame([("cache.ttlSeconds", "15")], "key string, value string"),
        frame([("pnpm test",), ("pnpm build",)], "command string"),
        frame([("src/StockController.java",)], "path string"),
    ).collect()
    kinds = {r["finding"] for r in found}
    assert {"ambiguous_claim", "removed_entity", "stale_configuration", "stale_endpoint", "stale_source_link"} <= kinds and "stale_command" not in kinds


def windows(text, most=1800):
    """Lines are added until the next would not fit; three lines carry over."""
    out, held, size = [], [], 0
    for line in text.split("\n"):
        if held and size + len(line) + 1 > most:
            out.append("\n".join(held).strip(X.WHITE))
            held = held[-3:]
            size = len("\n".join(held))
        held.append(line)
        size += len(line) + 1
    last = "\n".join(held).strip(X.WHITE)
    return out + [last] * bool(last)


@pytest.mark.parametrize("text", ["", "a", "\n".join(f"line {i} " * (i % 40) for i in range(200)), "x" * 5000 + "\nend"])
def test_chunk_windows(spark, text):
    assert one(spark, chunks.windows(F.col("c0")), text) == windows(text)


def test_eligibility(spark):
    ok = lambda path, kind, text: one(spark, chunks.eligibility(F.col("c0"), F.col("c1"), F.col("c2")), path, kind, text)
    assert ok("src/a.ts", "code", "// explains\nexport function f() { return 1; }" + " " * 5 + "x" * 60) == "explanatory source span"
    assert ok("dist/a.ts", "code", "export class A {}" * 9) is None
    assert ok("docs/a.md", "documentation", "word " * 12) == "explanatory Markdown section"


def test_manifests(spark):
    files = [
        ("package.json", "{broken"),
        ("pom.xml", "<project><groupId>g</groupId><artifactId>a</artifactId><version>1</version><dependencies><dependency><groupId>o.s</groupId><artifactId>web</artifactId></dependency></dependencies><modules><module>m</module></modules></project>"),
        ("build.gradle.kts", 'plugins { id("java") }\ndependencies {\n  implementation("a:b:1")\n  implementation(libs.x)\n}'),
        ("application.properties", "a.b=1\na.b=2\ndb.password=x\n# c=3"),
    ]
    artifacts = spark.createDataFrame(files, "path string, content string")
    assert [r["kind"] for r in manifests.node_manifests(artifacts).collect()] == ["error"]
    assert {(r["kind"], r["name"], r["scope"]) for r in manifests.maven_manifests(artifacts).collect()} == {("module", "g:a", None), ("dependency", "o.s:web", "compile"), ("submodule", "m", None)}
    assert {(r["kind"], r["name"]) for r in manifests.gradle_manifests(artifacts).collect()} == {("dependency", "a:b:1"), ("plugin", "java"), ("dynamic", "implementation(libs.x)")}
    assert {(r["key"], r["value"]) for r in manifests.configuration_keys(artifacts).collect()} == {("a.b", "1"), ("db.password", "[REDACTED]")}


def test_routes(spark):
    files = [
        ("A.java", "java", '@RequestMapping("/api/bins")\nclass A {\n@PostMapping("/pick")\nString pick() {}\n}'),
        ("O.kt", "kotlin", 'routing {\n  route("/api") {\n    authenticate {\n      route("/orders") {\n        get("/{id}") {\n        }\n      }\n    }\n  }\n}'),
        ("V.java", "java", 'router.post("/notifications").handler(a).handler(b);'),
        ("p.ts", "typescript", '@Controller("payments")\nexport class P {\n@Get(":id")\nfind() {}\n}'),
        ("u.ts", "typescript", 'app.use("/api", router);\nrouter.get("/shelves/:id", auth, show);'),
    ]
    got = {(r["path"], r["framework"], r["method"], r["route"]) for r in scanners.endpoints(spark.createDataFrame(files, "path string, language string, content string")).collect()}
    assert got == {("A.java", "spring", "POST", "/api/bins/pick"), ("O.kt", "ktor", "GET", "/api/orders/{id}"), ("V.java", "vertx", "POST", "/notifications"), ("p.ts", "nest", "GET", "/payments/{id}"), ("u.ts", "express", "GET", "/api/shelves/{id}")}


def test_inventory(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("export const a = 1;")
    (tmp_path / "src" / "b.ts").write_bytes(b"\0\1")
    (tmp_path / ".env").write_text("X=1")
    got = {r["path"]: r["kind"] for r in inventory.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"src/a.ts": "code", "src/b.ts": "rejected:binary"}  # dot files aren't read
    status = spark.createDataFrame([("M\ta",), ("R100\told\tnew",), ("D\tgone",)], "value string")
    assert {tuple(r) for r in inventory.parse_name_status(status).collect()} == {("modified", "a", None), ("renamed", "new", "old"), ("deleted", "gone", None)}


def test_job_state_resumes_where_it_failed(spark):
    rows = [("a", s, "done", i) for i, s in enumerate(streaming.STAGES)] + [("b", "snapshot", "done", 0), ("b", "parse", "failed", 1), ("c", "parse", "done", 0)]
    got = {r["job"]: (r["stage"], r["state"], r["completed"]) for r in streaming.job_state(spark.createDataFrame(rows, "job string, stage string, outcome string, at int")).collect()}
    assert got == {"a": ("complete", "completed", 7), "b": ("parse", "failed", 1), "c": ("snapshot", "running", 0)}


def test_stream_converges_to_the_fold(spark, tmp_path):
    rows = [("k1", "request", 1), ("k1", "claim", 2), ("k1", "release", 3), ("k2", "request", 1), ("k1", "claim", 4), ("k1", "publish", 5), ("k2", "claim", 6), ("k1", "claim", 7)]
    events = spark.createDataFrame([(k, e, at, i) for i, (k, e, at) in enumerate(rows)], "key string, event string, n int, event_id long").select("key", "event", F.timestamp_seconds("n").alias("at"), "event_id")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.stream_fold(stream).writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("folded").select("key", "state", "attempts").collect()}
    assert got == {tuple(r) for r in streaming.fold(events).select("key", "state", "attempts").collect()} == {("k1", "published", 2), ("k2", "claimed", 1)}


def test_revisions_are_published_once(spark, tmp_path):
    from factloom.operators import snapshots

    root = str(tmp_path / "facts")
    for revision, n in (("r1", 3), ("r2", 5)):
        snapshots.write_revision(spark.range(n), root, "shop", revision)
        assert snapshots.publish(spark, root, "shop", revision) and not snapshots.publish(spark, root, "shop", revision)
        assert snapshots.read_revision(spark, root, "shop", snapshots.active_revision(spark, root, "shop")).count() == n
    assert snapshots.active_revision(spark, root, "other") is None


def test_project(spark):
    from factloom.sources import project

    files = [("package.json", '{"dependencies": {"express": "1"}}'), ("src/main/java/A.java", "x"), ("src/a.ts", None)]
    r = project.detect_project(spark.createDataFrame(files, "path string, content string")).first()
    assert (r["languages"], r["frameworks"], r["source_roots"]) == (["java", "typescript"], ["express"], ["src", "src/main/java"])


def test_semantic_search_of_many_queries_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=3 if i % 7 else 2).round(1).tolist()) for i in range(1500)]  # ties and two lengths
    vectors += [(1500, [0.0, 0.0, 0.0]), (1501, None), (1502, [1.0, None, 0.0])]
    asked = [(i, v) for i, v in vectors[:1200]]
    monkeypatch.setattr(chunks, "QUERIES", 500)
    monkeypatch.setattr(chunks, "VECTORS", 400)
    got = {}
    for r in chunks.semantic_search(spark.createDataFrame(asked, "query_id long, query array<double>"), spark.createDataFrame(vectors, "id long, embedding array<double>"), 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["similarity"])
    assert len(got) == len(asked)
    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b):  # sum() would compensate
            total += x * y
        return total

    for i, q in asked[::10]:
        of = [(c, dot(q, v) / (math.sqrt(dot(q, q)) * math.sqrt(dot(v, v))) if any(v) and any(q) else None) for c, v in vectors if v and None not in v and len(v) == len(q)]
        want = sorted(of, key=lambda p: (p[1] is None, -(p[1] or 0), p[0]))[:4]
        assert [got[i][n] for n in range(1, 5)] == want, i


def test_evidence_paths_equal_all_walks(spark):
    rng = np.random.default_rng(1)
    kinds = sorted(impact.RULES)
    edges = [(f"r{i:03d}", kinds[rng.integers(len(kinds))], f"n{a}", f"n{b}", None if rng.random() < 0.5 else round(float(rng.random()), 2)) for i, (a, b) in enumerate(rng.integers(0, 12, (30, 2)))]
    rel = spark.createDataFrame(edges, "id string, kind string, source_key string, target_key string, confidence double")
    got = {r["stable_key"]: r for r in impact.evidence_paths(rel, spark.createDataFrame([("n0",)], "stable_key string"), max_depth=3, max_fan_out=None).collect()}
    best, walks = {"n0": 1.0}, [("n0", 1.0)]
    for _ in range(3):
        walks = [(b, c * impact.RULES[k][i] * (1.0 if w is None else w)) for n, c in walks for _, k, s, t, w in edges for a, b, i in ((s, t, 1), (t, s, 0)) if a == n]
        walks = [(n, c) for n, c in walks if c >= 0.2]
        for n, c in walks:
            best[n] = max(best.get(n, 0), c)
    assert got.keys() == best.keys()
    for key, r in got.items():
        assert r["confidence"] == pytest.approx(best[key])
        assert r["depth"] == len(r["path"]) and np.prod([s["weight"] for s in r["path"]] or [1.0]) == pytest.approx(r["confidence"])
        at = "n0"
        for s in r["path"]:
            assert s["from"] == at
            at = s["to"]
        assert at == key


def test_base_counts_only_if_greater(spark):
    side = lambda *rows: spark.createDataFrame(rows, "stable_key string, confidence double, depth int, is_root boolean")
    got = {r["stable_key"]: (r["confidence"], r["revision"]) for r in impact.merged_candidates(side(("a", 0.5, 1, False), ("b", 0.5, 1, False)), side(("a", 0.5, 2, False), ("b", 0.6, 2, False), ("c", 0.3, 1, False))).collect()}
    assert got == {"a": (0.5, "target"), "b": (0.6, "base"), "c": (0.3, "base")}


def test_guards_of_the_catalog(spark):
    from factloom.operators import catalog, provenance

    tree = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_hash string")
    assert catalog.assert_unchanged(tree, tree.orderBy(F.desc("path")))
    with pytest.raises(ValueError):
        catalog.assert_unchanged(tree, tree.where("path = 'a'"))
    with pytest.raises(ValueError):
        provenance.require_active(spark.createDataFrame([("r1", "staged")], "revision_id string, state string"), "r1")
    with pytest.raises(ValueError):
        diff.require_same_repository("a", "b")
    held = documentation.select_findings(spark.createDataFrame([("high", "review"), ("low", "review")], "severity string, status string"), "high", "review")
    assert held.count() == 1


def test_white_space_at_the_ends(spark):
    assert one(spark, X.trimmed(F.col("c0")), "\ufeff \n\t a b\u00a0\r\n") == "a b"


def test_stream_takes_each_key_once(spark, tmp_path):
    rows = [("k1", "2024-01-01 00:00:00"), ("k1", "2024-01-01 00:00:05"), ("k2", "2024-01-01 00:00:01")]
    spark.createDataFrame(rows, "idempotency_key string, t string").select("idempotency_key", F.col("t").cast("timestamp").alias("at")).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("idempotency_key string, at timestamp").parquet(str(tmp_path / "in"))
    query = streaming.stream_once(events).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["idempotency_key"] for r in spark.table("once").collect()) == ["k1", "k2"]
    assert [one(spark, streaming.backoff_seconds(F.col("c0").cast("int")), str(n)) for n in (1, 2, 5, 20)] == [1, 2, 16, 300]


def test_nearest_match_across_ranges(spark):
    """Equal to a plain search, with a hot key, ties, keys of one side only and gaps longer than a range."""
    rng = np.random.default_rng(9)
    left = [(i, "hot" if i % 3 else f"k{i % 7}", int(rng.integers(0, 400))) for i in range(600)] + [(900, None, 3), (901, "left only", 3)]
    right = [(f"r{i:03d}", "hot" if i % 2 else f"k{i % 9}", int(rng.choice([*range(20), *range(300, 340)]))) for i in range(80)]
    frames = spark.createDataFrame(left, "id long, key string, line int").repartition(5), spark.createDataFrame(right, "id string, key string, line int")
    got = {r["left_id"]: (r["distance"], r["right_id"]) for r in relational.nearest_match(*frames, "key").collect()}
    assert set(got) == {i for i, _, _ in left}
    for i, key, line in left:
        mine = [(abs(at - line), at > line, at, r) for r, k, at in right if k == key]
        if not mine:
            assert got[i] == (None, None)
            continue
        distance, later = min(m[:2] for m in mine)
        ids = [m[3] for m in mine if m[:2] == (distance, later)]
        assert got[i] == (distance, min(ids) if later else max(ids))


def test_renames_of_one_content_across_ranges(spark):
    rows = [(f"old/{i:03d}", "deleted", "h", None) for i in range(50)] + [(f"new/{i:03d}", "added", None, "h") for i in range(40)] + [("x", "deleted", "g", None), ("y", "added", None, "g"), ("z", "modified", "a", "b")]
    got = diff.coalesce_renames(spark.createDataFrame(rows, "path string, change string, previous_hash string, current_hash string").repartition(4)).collect()
    renamed = {(r["previous_path"], r["path"]) for r in got if r["change"] == "renamed"}
    assert renamed == {(f"old/{i:03d}", f"new/{i:03d}") for i in range(40)} | {("x", "y")}
    assert {r["path"] for r in got if r["change"] == "deleted"} == {f"old/{i:03d}" for i in range(40, 50)}
