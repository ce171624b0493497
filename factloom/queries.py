"""A query for each operator over the driver tables, and the same in SQL where SQL can say it.

The tables become facts as in factloom.plans; what they have no example of (Markdown, manifests, sources) is written
from their rows, whole tables at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import functions as X
from factloom import streaming
from factloom.operators import answers as answering
from factloom.operators import chunks, diff, documentation, graph, impact, relational, summary
from factloom.plans import BASE_ENTITIES, ENTITIES, RELATIONSHIPS, TARGET_ENTITIES, facts, kept, revisions
from factloom.sources import manifests, project, scanners

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_E = f"WITH RECURSIVE entities AS ({ENTITIES}), relationships AS ({RELATIONSHIPS}), base_entities AS ({BASE_ENTITIES}), target_entities AS ({TARGET_ENTITIES})"


def query(sql: str | None = None, facts_sql: bool = True):
    """Registers a query under its name, with its SQL; the SQL sees entities and relationships first."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"{_E} {sql}" if facts_sql else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT kind, count(*) AS n FROM entities GROUP BY kind")
def entity_counts(spark, sf_dir):
    return relational.entity_counts(facts(spark, sf_dir)[0])


@query("SELECT string_agg(concat(n, ' ', kind), ', ' ORDER BY kind) AS kinds FROM (SELECT kind, count(*) AS n FROM entities GROUP BY kind) t")
def kind_list(spark, sf_dir):
    return relational.kind_list(facts(spark, sf_dir)[0])


@query("SELECT stable_key, kind, name, attributes FROM entities WHERE name ILIKE '%an%' ORDER BY name, stable_key LIMIT 25")
def entity_search(spark, sf_dir):
    return relational.entity_search(facts(spark, sf_dir)[0], "a%n_")


@query("SELECT r.id, r.kind, r.source_key, r.target_key, r.confidence, s.kind AS source_kind, s.name AS source_name, t.kind AS target_kind, t.name AS target_name FROM relationships r JOIN entities s ON r.source_key = s.stable_key JOIN entities t ON r.target_key = t.stable_key")
def snapshot_relationships(spark, sf_dir):
    entities, relationships = facts(spark, sf_dir)
    return relational.snapshot_relationships(relationships, entities).select("id", "kind", "source_key", "target_key", "confidence", "source_kind", "source_name", "target_kind", "target_name")


@query("SELECT kind, source_key, target_key, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY kind, source_key, target_key ORDER BY coalesce(confidence, 1) DESC, id) AS n FROM relationships) t WHERE n = 1")
def relationship_index(spark, sf_dir):
    return diff.relationship_index(facts(spark, sf_dir)[1])


_DIFF = """SELECT coalesce(b.stable_key, t.stable_key) AS stable_key,
    CASE WHEN b.stable_key IS NULL THEN 'added' WHEN t.stable_key IS NULL THEN 'removed' ELSE 'modified' END AS change,
    CASE WHEN b.stable_key IS NOT NULL AND t.stable_key IS NOT NULL THEN 'attributes' ELSE '' END AS changed_fields
    FROM base_entities b FULL OUTER JOIN target_entities t ON b.stable_key = t.stable_key
    WHERE b.stable_key IS NULL OR t.stable_key IS NULL OR b.attributes IS DISTINCT FROM t.attributes"""


@query(_DIFF)
def semantic_diff(spark, sf_dir):
    return diff.entity_diff(*revisions(spark, sf_dir)).withColumn("changed_fields", F.array_join("changed_fields", ","))


@query(f"SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'removed') AS removed FROM ({_DIFF}) d")
def diff_summary(spark, sf_dir):
    return diff.diff_summary(diff.entity_diff(*revisions(spark, sf_dir)))


def _relationship_revisions(relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = relationships.where("not (kind = 'TESTS' and source_key like '%7')")
    target = relationships.where("not (kind = 'HANDLES' and target_key like '%89')").withColumn("confidence", F.when(F.col("target_key").like("%3"), F.col("confidence") / 2).otherwise(F.col("confidence")))
    return base, target


@query("""SELECT coalesce(b.kind, t.kind) AS kind, coalesce(b.source_key, t.source_key) AS source_key, coalesce(b.target_key, t.target_key) AS target_key,
    CASE WHEN b.kind IS NULL THEN 'added' WHEN t.kind IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM (SELECT kind, source_key, target_key, max(confidence) AS c FROM relationships WHERE NOT (kind = 'TESTS' AND source_key LIKE '%7') GROUP BY ALL) b
    FULL OUTER JOIN (SELECT kind, source_key, target_key, max(CASE WHEN target_key LIKE '%3' THEN confidence / 2 ELSE confidence END) AS c FROM relationships WHERE NOT (kind = 'HANDLES' AND target_key LIKE '%89') GROUP BY ALL) t
    ON b.kind = t.kind AND b.source_key = t.source_key AND b.target_key = t.target_key
    WHERE b.kind IS NULL OR t.kind IS NULL OR b.c IS DISTINCT FROM t.c""")
def relationship_diff(spark, sf_dir):
    return diff.relationship_diff(*_relationship_revisions(facts(spark, sf_dir)[1]))


_FILES = """base AS (SELECT concat('source/doc_', doc_id) AS path, sha256(text) AS content_hash FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL),
    target AS (SELECT concat(CASE WHEN doc_id % 11 = 0 THEN 'moved' ELSE 'source' END, '/doc_', doc_id) AS path, sha256(CASE WHEN doc_id % 13 = 0 THEN concat(text, '!') ELSE text END) AS content_hash FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL),
    changes AS (SELECT coalesce(b.path, t.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'deleted' ELSE 'modified' END AS change, b.content_hash AS previous_hash, t.content_hash AS current_hash
        FROM base b FULL OUTER JOIN target t ON b.path = t.path WHERE b.path IS NULL OR t.path IS NULL OR b.content_hash <> t.content_hash)"""


def _inventories(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    path = lambda folder: F.concat(folder, F.lit("/doc_"), F.col("doc_id"))
    base = docs.where("doc_id % 7 <> 0").select(path(F.lit("source")).alias("path"), F.sha2("text", 256).alias("content_hash"))
    text = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    target = docs.where("doc_id % 5 <> 0").select(path(F.when(F.col("doc_id") % 11 == 0, "moved").otherwise("source")).alias("path"), F.sha2(text, 256).alias("content_hash"))
    return base, target


@query(f"WITH {_FILES} SELECT path, change, previous_hash, current_hash FROM changes", False)
def change_set(spark, sf_dir):
    return diff.change_set(*_inventories(spark, sf_dir))


@query(f"""WITH {_FILES}, gone AS (SELECT path, previous_hash AS hash, row_number() OVER (PARTITION BY previous_hash ORDER BY path) AS n FROM changes WHERE change = 'deleted'),
    new AS (SELECT path, current_hash AS hash, row_number() OVER (PARTITION BY current_hash ORDER BY path) AS n FROM changes WHERE change = 'added'),
    pairs AS (SELECT gone.path AS previous_path, new.path, gone.hash FROM gone JOIN new ON gone.hash = new.hash AND gone.n = new.n)
    SELECT path, 'renamed' AS change, hash AS previous_hash, hash AS current_hash, previous_path FROM pairs
    UNION ALL SELECT path, change, previous_hash, current_hash, NULL FROM changes
    WHERE NOT (change = 'deleted' AND path IN (SELECT previous_path FROM pairs)) AND NOT (change = 'added' AND path IN (SELECT path FROM pairs))""", False)
def rename_coalesce(spark, sf_dir):
    return diff.coalesce_renames(diff.change_set(*_inventories(spark, sf_dir)))


@query(f"""WITH {_FILES}, rows AS (SELECT sha256(concat_ws(chr(31), path, content_hash)) AS h FROM base)
    SELECT sha256(concat_ws(':', count(*), CAST(sum(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)) AS VARCHAR), CAST(sum(CAST(concat('0x', substr(h, 16, 15)) AS BIGINT)) AS VARCHAR))) AS fingerprint FROM rows""", False)
def fingerprint(spark, sf_dir):
    return diff.fingerprint(_inventories(spark, sf_dir)[0])


_NEIGHBOURS = """steps AS (SELECT source_key AS a, target_key AS b FROM relationships UNION SELECT target_key, source_key FROM relationships),
    found AS (SELECT 'module:1' AS stable_key, 0 AS depth UNION SELECT steps.b, found.depth + 1 FROM found JOIN steps ON found.stable_key = steps.a WHERE found.depth < 2),
    nodes AS (SELECT stable_key, min(depth) AS depth FROM found GROUP BY stable_key),
    ranked AS (SELECT *, row_number() OVER (ORDER BY depth, stable_key) AS n FROM nodes), visited AS (SELECT * FROM ranked WHERE n <= 1000)"""


@query(f", {_NEIGHBOURS} SELECT e.stable_key, e.kind, e.name, CAST(v.depth AS INTEGER) AS depth FROM visited v JOIN entities e USING (stable_key)")
def traverse_nodes(spark, sf_dir):
    return graph.traverse(*facts(spark, sf_dir), ["module:1", "missing"], max_depth=2, max_nodes=1000).nodes.select("stable_key", "kind", "name", "depth")


@query(f", {_NEIGHBOURS} SELECT r.id, r.kind, r.source_key, r.target_key FROM relationships r JOIN visited s ON r.source_key = s.stable_key JOIN visited t ON r.target_key = t.stable_key WHERE least(s.depth, t.depth) < 2")
def traverse_edges(spark, sf_dir):
    return graph.traverse(*facts(spark, sf_dir), ["module:1"], max_depth=2, max_nodes=1000).edges.select("id", "kind", "source_key", "target_key")


@query(""", found AS (SELECT stable_key, 0 AS depth FROM entities WHERE kind = 'module' UNION SELECT r.target_key, found.depth + 1 FROM found JOIN relationships r ON found.stable_key = r.source_key WHERE found.depth < 32)
    SELECT stable_key, CAST(min(depth) AS INTEGER) AS depth FROM found GROUP BY stable_key""")
def reachability(spark, sf_dir):
    entities, relationships = facts(spark, sf_dir)
    return graph.reachable(relationships, entities.where("kind = 'module'"))


def _affected_sql(depth: int, fan_out: int, least: float) -> str:
    rule = lambda i: "CASE kind " + " ".join(f"WHEN '{k}' THEN CAST({v[i]} AS DOUBLE)" for k, v in impact.RULES.items()) + " END"
    levels = ", ".join(f"l{d} AS (SELECT neighbour AS stable_key, max(confidence * weight) AS confidence FROM l{d - 1} JOIN steps ON stable_key = node GROUP BY neighbour HAVING max(confidence * weight) >= {least})" for d in range(1, depth + 1))
    all_ = " UNION ALL ".join(f"SELECT stable_key, confidence, {d} AS depth FROM l{d}" for d in range(depth + 1))
    return f""", both_ways AS (SELECT id, source_key AS node, target_key AS neighbour, {rule(1)} * coalesce(confidence, 1) AS weight FROM relationships
        UNION ALL SELECT id, target_key, source_key, {rule(0)} * coalesce(confidence, 1) FROM relationships),
    steps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, id) AS n FROM both_ways) t WHERE n <= {fan_out}),
    changed AS ({_DIFF}), l0 AS (SELECT stable_key, CAST(1 AS DOUBLE) AS confidence FROM changed), {levels},
    best AS (SELECT stable_key, max(confidence) AS confidence, min(depth) AS depth FROM ({all_}) a GROUP BY stable_key)"""


def _affected(spark, sf_dir, **options):
    entities, relationships = facts(spark, sf_dir)
    changed = diff.entity_diff(*revisions(spark, sf_dir))
    return impact.affected(relationships, changed, **options), changed


@query(f"{_affected_sql(4, 25, 0.2)} SELECT stable_key, round(confidence, 9) AS confidence, CAST(depth AS INTEGER) AS depth, depth = 0 AS is_root FROM best")
def affected_subgraph(spark, sf_dir):
    return _affected(spark, sf_dir, max_nodes=None)[0].withColumn("confidence", F.round("confidence", 9))


@query()
def affected_best_first(spark, sf_dir):
    """What a strongest-first queue finds from every changed entity, 200 nodes beside them; held against a plain queue."""
    entities, relationships = facts(spark, sf_dir)
    changed = kept(diff.entity_diff(*revisions(spark, sf_dir)))
    there = changed.join(entities, "stable_key", "left_semi")
    found, truncated = impact.best_first(relationships, entities, there, max_nodes=there.count() + 200)
    return found.select("stable_key", "confidence", "depth", "path", F.lit(truncated).alias("truncated"))


@query(f"""{_affected_sql(4, 25, 0.2)}, tests AS (SELECT b.stable_key, least(CAST(0.98 AS DOUBLE), b.confidence) AS score FROM best b JOIN entities e USING (stable_key) WHERE e.kind = 'class')
    SELECT stable_key, round(score, 9) AS score, CASE WHEN score >= 0.95 THEN 'confirmed' WHEN score >= 0.5 THEN 'inferred' ELSE 'tentative' END AS level FROM tests""")
def recommend_tests(spark, sf_dir):
    affected, _ = _affected(spark, sf_dir, max_nodes=None)
    tests = facts(spark, sf_dir)[0].where("kind = 'class'").select("stable_key", X.normalize_test_name(F.col("name")).alias("test_name"), F.array(F.lit("TESTS")).alias("path_kinds"))
    none = spark.createDataFrame([], "name string")
    return impact.recommend_tests(tests, affected, none).withColumn("score", F.round("score", 9))


@query(f"""{_affected_sql(4, 25, 0.2)}, f AS (
    SELECT 2 AS ordinal, 'public-api' AS factor, CASE WHEN count(*) > 0 THEN 20 ELSE 0 END AS weight FROM changed
    UNION ALL SELECT 5, 'downstream-impact', CAST(least(15, round(sum(confidence))) AS INTEGER) FROM best WHERE depth > 0
    UNION ALL SELECT 6, 'missing-tests', CASE WHEN count(*) > 0 THEN 15 ELSE 0 END FROM changed
    UNION ALL SELECT 7, 'documentation-gap', 10
    UNION ALL SELECT 9, 'change-size', CAST(least(15, floor((count(*) + 12) / 5) * 3) AS INTEGER) FROM changed)
    SELECT CAST(ordinal AS INTEGER) AS ordinal, factor, CAST(weight AS INTEGER) AS weight FROM f WHERE weight > 0""")
def risk_factors(spark, sf_dir):
    affected, changed = _affected(spark, sf_dir, max_nodes=None)
    text = changed.select(F.lit("endpoint").alias("kind"), F.col("stable_key").alias("text"))
    return impact.score_risk(text, affected, changed_files=12, documentation_gaps=3)


@query("SELECT event_id, CAST(json(props) AS VARCHAR) AS props FROM events", False)
def canonical_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.canonical_json(F.col("props")).alias("props"))


@query("SELECT c_custkey, concat('shop:interface:', substr(sha256(concat_ws(chr(31), 'shop', 'language-neutral', 'interface', concat('name:', trim(c_name)))), 1, 24)) AS stable_key FROM customer", False)
def entity_stable_key(spark, sf_dir):
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", X.entity_stable_key(F.lit("shop"), F.lit("interface"), none, F.col("c_name")).alias("stable_key"))


_CASES = " ".join(f"WHEN regexp_matches(trim(text), '{p.replace(chr(39), chr(39) * 2)}') THEN '{i}'" for i, p in X.INTENTS)


@query(f"SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN NULL {_CASES} WHEN text IS NOT NULL THEN 'semantic_unknown' END AS intent FROM conversations WHERE role = 'user'", False)
def route_question(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", X.question_intent(F.col("text")).alias("intent"))


_TERMS = (
    (r"""[`"']([^`"']{2,100})[`"']""", 1),
    (r"\b([A-Z][A-Za-z0-9_$]*(?:\.[A-Za-z_$][\w$]*)?)\b", 1),
    (r"(?i)\b(?:changing|configured|explain|uses?|calls?|for)[ \t\n\x0b\f\r]+(?:the[ \t\n\x0b\f\r]+)?([\w.$_/-]+)", 1),
)
_METHOD = r"(?i)\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)[ \t\n\x0b\f\r]+(/[^ \t\n\x0b\f\r?]+)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TERM = ", ".join(f"nullif(regexp_extract(q, {_quoted(p)}, {g}), '')" for p, g in _TERMS)


@query(
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches(q, {_quoted(_METHOD)}) THEN upper(regexp_extract(q, {_quoted(_METHOD)}, 1)) || ' ' || regexp_extract(q, {_quoted(_METHOD)}, 2)
    ELSE coalesce({_TERM}, q) END AS term FROM (SELECT conv_id, turn, trim(text) AS q FROM conversations WHERE role = 'user') t""",
    False,
)
def search_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", X.search_term(F.col("text")).alias("term"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Known ' || lang || ' [E1]' ELSE 'None' END AS text, CASE WHEN doc_id % 2 = 0 THEN 'E1' ELSE '' END AS ids, doc_id % 2 = 0 AS valid FROM documents WHERE lang IS NOT NULL", False)
def validate_citations(spark, sf_dir):
    answer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Known "), F.col("lang"), F.lit(" [E1][E9]"))).otherwise(F.lit("None[E8]"))
    v = X.validate_citations(answer, F.array(F.lit("E1"), F.lit("E2")))
    return table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", v.alias("v")).select("doc_id", "v.text", F.array_join("v.ids", ",").alias("ids"), "v.valid")


_PATHS = (
    ("src/main/App.java", "code"), ("src/test/AppTest.java", "test"), ("web/app.spec.ts", "test"), ("dist/app.ts", "rejected:generated"), (".env.local", "rejected:environment-secret"), (".env.example", "configuration"),
    ("pom.xml", "build"), ("docs/guide.mdx", "documentation"), ("conf/db.properties", "configuration"), ("img/logo.png", "rejected:unsupported"), (".\\lib\\Main.kt", "code"), ("settings.gradle.kts", "build"),
)


@query("SELECT doc_id, CASE WHEN n_chars > 8000 AND doc_id % 12 NOT IN (3, 4) THEN 'rejected:oversized' ELSE CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(_PATHS)) + " END END AS kind FROM documents", False)
def file_policy(spark, sf_dir):
    path = F.get(F.array(*[F.lit(p) for p, _ in _PATHS]), (F.col("doc_id") % len(_PATHS)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", X.file_policy(path, F.col("n_chars"), max_bytes=8000).alias("kind"))


def _redact_sql() -> str:
    """What each pattern leaves of the text, and how often it matched; quotes are spelt out where a match refers back."""
    space, value = r"[ \t\n\x0b\f\r]", r"""[^ \t\n\x0b\f\r,"'\]}]+"""
    steps = (
        (r"-----BEGIN [^-]*PRIVATE KEY-----[\s\S]*?-----END [^-]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
        (rf"""(?i)\b(api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|password|private[_-]?key|secret)\b({space}*[:=]{space}*)(?:"{value}"|'{value}'|{value})""", r"\1\2[REDACTED]"),
        (rf"(?i)\b(Bearer{space}+)[A-Za-z0-9._~+/=-]{{8,}}", r"\1[REDACTED]"),
        (r"(?i)(\b[a-z][a-z0-9+.-]*://[^ \t\n\x0b\f\r:/]+:)([^@ \t\n\x0b\f\r]+)(@)", r"\1[REDACTED]\3"),
    )
    parts = ["t0 AS (SELECT doc_id, replace(coalesce(text, ''), 'token =', 'auth_token =') AS t, 0 AS n FROM documents)"]
    for i, (pattern, instead) in enumerate(steps):
        p = _quoted(pattern)
        parts.append(f"t{i + 1} AS (SELECT doc_id, regexp_replace(t, {p}, '{instead}', 'g') AS t, n + len(regexp_extract_all(t, {p})) AS n FROM t{i})")
    return f"WITH {', '.join(parts)} SELECT doc_id, n AS count, sha256(t) AS content_hash FROM t{len(steps)}"


@query(_redact_sql(), False)
def redact_secrets(spark, sf_dir):
    r = X.redact_secrets(F.replace("text", F.lit("token ="), F.lit("auth_token =")))
    return table(spark, sf_dir, "documents").select("doc_id", r.alias("r")).select("doc_id", "r.count", F.sha2("r.content", 256).alias("content_hash"))


@query()
def semantic_chunks(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), F.lit("documentation").alias("kind"), F.coalesce("text", F.lit("")).alias("content"))
    return chunks.chunk(sources).select("id", "source_id", "position", "checksum", "redactions")


@query("SELECT concat('c', doc_id) AS id, CASE WHEN doc_id % 3 = 0 THEN 'embed' WHEN doc_id % 4 = 0 THEN 'stale' WHEN doc_id % 5 = 0 THEN 'embed' ELSE 'retain' END AS action FROM documents", False)
def chunk_projection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), "doc_id").alias("id"), F.col("doc_id").alias("n"), F.lit("m").alias("model"))
    existing = docs.where("n % 3 <> 0").select("id", F.lit("same").alias("checksum"), "model")
    new = docs.where("n % 3 = 0 or n % 4 <> 0").select("id", F.when(F.col("n") % 5 == 0, "new").otherwise("same").alias("checksum"))
    return chunks.project(existing, new, "m")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) / (q.norm * c.norm) AS similarity FROM n q JOIN n c ON q.vec_id % 20 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) t WHERE rank <= 8""", False)
def semantic_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return chunks.semantic_search(vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), vectors)


@query()
def semantic_search_twentieth(spark, sf_dir):
    """The whole job: every twentieth row asks for its like among all rows."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return chunks.semantic_search(vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), vectors)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'updated' ELSE c_name END AS c_name, c_mktsegment FROM customer UNION ALL SELECT -1 - c_custkey, 'updated', 'new' FROM customer WHERE c_custkey % 6 = 0", False)
def upsert(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit("updated").alias("c_name"), F.lit("new").alias("c_mktsegment"))
    return relational.upsert(customer, new.union(new.where("c_custkey % 6 = 0").withColumn("c_custkey", -1 - F.col("c_custkey"))), ["c_custkey"], ["c_name"])


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id", False)
def insert_if_absent(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    firsts = events.where("user_id % 2 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return relational.insert_if_absent(firsts, events, ["user_id"])


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) t WHERE n = 1", False)
def active_revision(spark, sf_dir):
    return relational.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", "o_orderdate")


@query("SELECT o_orderkey AS reference, concat('c', c.k) AS target FROM orders o JOIN (SELECT c_custkey % 1000 AS m, min(c_custkey) AS k FROM customer GROUP BY 1 HAVING count(*) = 1) c ON o.o_custkey % 1000 = c.m", False)
def resolve_unique(spark, sf_dir):
    symbols = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 1000).alias("name"), F.concat(F.lit("c"), "c_custkey").alias("stable_key"))
    return relational.resolve_unique(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference"), (F.col("o_custkey") % 1000).alias("name")), symbols)


@query("""SELECT left_id, right_id, distance FROM (
    SELECT l.event_id AS left_id, lpad(CAST(r.event_id AS VARCHAR), 12, '0') AS right_id, abs(epoch_us(l.ts) - epoch_us(r.ts)) AS distance,
        row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts > l.ts, CASE WHEN r.ts <= l.ts THEN -r.event_id ELSE r.event_id END) AS n
    FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'purchase' AND r.event_type = 'click') t WHERE n = 1""", False)
def nearest_match(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("line"))
    right = events.where("event_type = 'click'").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), "name", "line")
    return relational.nearest_match(events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "name", "line"), right, "name").where("right_id is not null")


@query("SELECT (count(*) FILTER (f AND e)) / count(*) FILTER (f) AS \"precision\", (count(*) FILTER (f AND e)) / count(*) FILTER (e) AS recall FROM (SELECT o_orderkey % 3 <> 0 AS f, o_orderkey % 5 <> 0 AS e FROM orders) t", False)
def precision_recall(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return relational.precision_recall(orders.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 5 <> 0"), ["o_orderkey"])


@query("SELECT stable_key, CASE WHEN r % 4 = 0 THEN 'new' ELSE 'old' END AS artifact, CASE WHEN r % 8 = 0 THEN 'r2' ELSE 'r1' END AS first_seen, 'r2' AS revision FROM (SELECT concat('e', o_orderkey) AS stable_key, o_orderkey AS r FROM orders) t WHERE r % 4 = 0 OR r % 5 <> 0", False)
def activation(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("e"), "o_orderkey").alias("stable_key"), F.col("o_orderkey").alias("r"))
    previous = orders.where("r % 8 <> 0").select("stable_key", F.when(F.col("r") % 5 == 0, "gone").otherwise("old").alias("artifact"), F.lit("r1").alias("first_seen"))
    staged = orders.where("r % 4 = 0").select("stable_key", F.lit("new").alias("artifact"))
    none = spark.createDataFrame([], "source_key string, target_key string")
    return relational.activate(previous, staged, spark.createDataFrame([("gone",)], "artifact string"), none, "r2")


def _queue(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "publish").when(F.col("event_type") == "error", "release").when(F.col("event_type") == "click", "claim").otherwise("request")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), kind.alias("event"), F.col("ts").alias("at"), "event_id")


_LOG = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'purchase' THEN 'publish' WHEN 'error' THEN 'release' WHEN 'click' THEN 'claim' ELSE 'request' END AS event, ts, event_id FROM events),
    p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM e), f AS (SELECT key, min(n) AS stop FROM p WHERE event = 'publish' GROUP BY key),
    c AS (SELECT p.* FROM p LEFT JOIN f USING (key) WHERE f.stop IS NULL OR p.n <= f.stop)"""


@query(f"{_LOG} SELECT key, CASE arg_max(event, n) WHEN 'publish' THEN 'published' WHEN 'claim' THEN 'claimed' ELSE 'pending' END AS state, count(*) FILTER (event = 'claim') AS attempts, max(ts) AS last FROM c GROUP BY key", False)
def outbox_fold(spark, sf_dir):
    return streaming.fold(_queue(spark, sf_dir))


@query("SELECT event_id AS id FROM events WHERE event_type <> 'purchase' AND (event_type <> 'click' OR ts <= (SELECT max(ts) FROM events) - INTERVAL 30 SECONDS) ORDER BY ts, event_id LIMIT 20", False)
def outbox_claim(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    only = lambda kind: F.when(F.col("event_type") == kind, F.col("ts"))
    outbox = events.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), only("purchase").alias("published_at"), only("click").alias("claimed_at"), F.lit(None).cast("timestamp").alias("next_attempt_at"))
    return streaming.claimable(outbox, now).select("id")


@query("SELECT event_id AS id, CASE WHEN event_type = 'click' AND ts > TIMESTAMP '2024-06-01' THEN 'other' ELSE 'me' END AS lease_owner, NOT (event_type = 'click' AND ts > TIMESTAMP '2024-06-01') AS acquired FROM events", False)
def lease_state(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    held = events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "other").alias("lease_owner"), F.col("ts").alias("lease_expires_at"))
    now = F.lit("2024-06-01").cast(events.schema["ts"].dataType)
    return streaming.leases(held, now, "me").select("id", "lease_owner", "acquired")


@query(
    f"""WITH j AS (SELECT l_orderkey AS job, coalesce(list(DISTINCT l_linenumber) FILTER (WHERE l_partkey % 50 <> 0), []) AS done, arg_max(CASE WHEN l_partkey % 50 = 0 THEN 'failed' ELSE 'done' END, l_linenumber::BIGINT * 1000000000 + l_partkey) AS last FROM lineitem GROUP BY 1),
    c AS (SELECT job, last, least(7, list_min(list_filter([1, 2, 3, 4, 5, 6, 7, 8], lambda x: NOT list_contains(done, x))) - 1) AS completed FROM j)
    SELECT job, ([{", ".join(f"'{x}'" for x in streaming.STAGES)}])[least(completed, 6) + 1] AS stage, CASE WHEN completed = 7 THEN 'completed' WHEN last = 'failed' THEN 'failed' ELSE 'running' END AS state, completed FROM c""",
    False,
)
def job_state(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    stage = F.get(F.array(*map(F.lit, streaming.STAGES)), (F.col("l_linenumber") - 1).cast("int"))
    outcome = F.when(F.col("l_partkey") % 50 == 0, "failed").otherwise("done")
    return streaming.job_state(lines.select(F.col("l_orderkey").alias("job"), stage.alias("stage"), outcome.alias("outcome"), F.struct("l_linenumber", "l_partkey").alias("at")))


@query("SELECT c_custkey AS repository, 'graph' AS projection, c_custkey % 2 = 0 AS fresh FROM customer", False)
def projection_lag(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    at = c.select(F.col("c_custkey").alias("repository"), F.lit("graph").alias("projection"), (F.col("c_custkey") % 2).alias("revision"))
    return streaming.projection_lag(at, c.select(F.col("c_custkey").alias("repository"), F.lit(0).cast("long").alias("revision")))


def _pages(spark, sf_dir):
    """A page for each order: its route, every tenth one wrong, and the same in a fence, which is no heading."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    route = F.when(F.col("o_orderkey") % 10 == 0, F.lit("/gone")).otherwise(F.lit("/orders"))
    content = F.concat(F.lit("# Order "), "o_orderkey", F.lit("\n\n```\n# fenced\n```\nSend GET "), route, F.lit("/"), "o_custkey", F.lit("/"), "o_orderkey", F.lit("\n## More\ntext\n"))
    return o.select(F.concat(F.lit("docs/"), "o_orderkey", F.lit(".md")).alias("path"), content.alias("content"))


@query("""SELECT concat('docs/', o_orderkey, '.md') AS path, concat('Order ', o_orderkey) AS title, 1 AS level, 1 AS line_start, 6 AS line_end FROM orders
    UNION ALL SELECT concat('docs/', o_orderkey, '.md'), 'More', 2, 7, 9 FROM orders""", False)
def parse_markdown(spark, sf_dir):
    return documentation.parse_markdown(_pages(spark, sf_dir)).select("path", "title", "level", "line_start", "line_end")


@query("SELECT concat('docs/', o_orderkey, '.md') AS path, 'endpoint' AS kind, 6 AS line, 'GET' AS subject, concat(CASE WHEN o_orderkey % 10 = 0 THEN '/gone/' ELSE '/orders/' END, o_custkey, '/', o_orderkey) AS value FROM orders", False)
def extract_claims(spark, sf_dir):
    return documentation.extract_claims(documentation.parse_markdown(_pages(spark, sf_dir))).select("path", "kind", "line", "subject", "value")


def _claims(spark, sf_dir):
    return documentation.extract_claims(documentation.parse_markdown(_pages(spark, sf_dir)))


def _findings(spark, sf_dir, claims):
    endpoints = table(spark, sf_dir, "orders").select(F.lit("GET").alias("method"), F.concat(F.lit("/orders/"), "o_custkey", F.lit("/"), "o_orderkey").alias("path"))
    empty = lambda schema: spark.createDataFrame([], schema)
    return documentation.compare_claims(claims, endpoints, empty("name string, qualified_name string"), empty("key string, value string"), empty("command string"), empty("path string"))


@query("SELECT concat('docs/', o_orderkey, '.md') AS path, 6 AS line, 'GET' AS subject, concat('/gone/', o_custkey, '/', o_orderkey) AS value, 'stale_endpoint' AS finding, 'high' AS severity, 'confirmed' AS status, NULL AS suggestion FROM orders WHERE o_orderkey % 10 = 0", False)
def documentation_findings(spark, sf_dir):
    return _findings(spark, sf_dir, _claims(spark, sf_dir))


@query("SELECT stable_key, kind AS gap FROM entities WHERE kind = 'module' OR (kind = 'endpoint' AND try_cast(substr(stable_key, 10) AS BIGINT) % 10 = 0)")
def documentation_gaps(spark, sf_dir):
    return documentation.detect_gaps(facts(spark, sf_dir)[0], _claims(spark, sf_dir))


@query("""SELECT n AS high, CAST(0 AS BIGINT) AS medium, CAST(0 AS BIGINT) AS low, CAST(0 AS BIGINT) AS informational, n AS findings, n AS confirmed, CAST(0 AS BIGINT) AS review, n + 5 AS gaps, CAST(greatest(0, 100 - 15 * n - (n + 5) - 5) AS INTEGER) AS score,
    concat('100 - ', 15 * n, ' finding penalty - ', n + 5, ' gap penalty - 5 indexing penalty = ', greatest(0, 100 - 15 * n - (n + 5) - 5)) AS explanation FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 10 = 0) t""", False)
def documentation_health(spark, sf_dir):
    claims = kept(_claims(spark, sf_dir))  # findings and gaps read the pages once
    return documentation.health(_findings(spark, sf_dir, claims), documentation.detect_gaps(facts(spark, sf_dir)[0], claims), 0.75)


@query(""", e AS (SELECT DISTINCT source_key AS s, kind AS k, target_key AS t FROM relationships ORDER BY ALL LIMIT 30),
    names AS (SELECT name, row_number() OVER (ORDER BY name) AS i FROM (SELECT s AS name FROM e UNION SELECT t FROM e) u)
    SELECT concat('flowchart LR', chr(10), (SELECT string_agg(concat('  E', i, '["', name, '"]'), chr(10) ORDER BY i) FROM names), chr(10),
        (SELECT string_agg(concat('  E', a.i, ' -->|', k, '| E', b.i), chr(10) ORDER BY s, k, t) FROM e JOIN names a ON a.name = s JOIN names b ON b.name = t)) AS diagram""")
def mermaid_diagram(spark, sf_dir):
    r = facts(spark, sf_dir)[1]
    return documentation.mermaid(r.select("kind", F.col("source_key").alias("source"), F.col("target_key").alias("target")))


@query("SELECT concat('p', p_partkey, '/package.json') AS path, 'module' AS kind, concat('part-', p_partkey) AS name, '1.0.0' AS value, NULL AS scope FROM part UNION ALL SELECT concat('p', p_partkey, '/package.json'), 'dependency', concat('size-', p_size), '^1', 'runtime' FROM part UNION ALL SELECT concat('p', p_partkey, '/package.json'), 'build_script', 'test', 'vitest', NULL FROM part", False)
def node_manifests(spark, sf_dir):
    content = F.concat(F.lit('{"name": "part-'), "p_partkey", F.lit('", "version": "1.0.0", "scripts": {"lint": "x", "test": "vitest"}, "dependencies": {"size-'), "p_size", F.lit('": "^1"}}'))
    return manifests.node_manifests(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit("/package.json")).alias("path"), content.alias("content")))


@query("SELECT concat('p', p_partkey, '.yaml') AS path, 2 AS line, 'part.size' AS key, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT concat('p', p_partkey, '.yaml'), 4, 'part.db.password', '[REDACTED]' FROM part", False)
def configuration_keys(spark, sf_dir):
    content = F.concat(F.lit("part:\n  size: "), "p_size", F.lit("\n  db:\n    password: 'p"), "p_partkey", F.lit("'\n"))
    return manifests.configuration_keys(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit(".yaml")).alias("path"), content.alias("content")))


@query("SELECT concat('S', s_suppkey, '.java') AS path, 5 AS line, 'spring' AS framework, 'POST' AS method, concat('/api/', s_suppkey, '/login') AS route FROM supplier", False)
def framework_endpoints(spark, sf_dir):
    content = F.concat(F.lit('package demo;\n@RequestMapping("/api/'), "s_suppkey", F.lit('")\npublic class S'), "s_suppkey", F.lit(' {\n  // routes\n  @PostMapping("/login")\n  public String login(String x) { return x; }\n}\n'))
    artifacts = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey", F.lit(".java")).alias("path"), F.lit("java").alias("language"), content.alias("content"))
    return scanners.endpoints(artifacts)


@query("SELECT concat('S', s_suppkey, '.ts') AS path, concat('Base', s_suppkey) AS name, concat('B', s_suppkey, '.ts') AS target_path FROM supplier", False)
def resolve_heritage(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    file = lambda letter, text: s.select(F.concat(F.lit(letter), "s_suppkey", F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), F.concat(*text).alias("content"))
    artifacts = file("S", [F.lit("export class Own"), F.col("s_suppkey"), F.lit(" extends Base"), F.col("s_suppkey"), F.lit(" {}\n")]).union(file("B", [F.lit("export class Base"), F.col("s_suppkey"), F.lit(" {}\n")]))
    rows = scanners.lines(artifacts)
    return scanners.resolved(scanners.heritage(rows), scanners.declarations(rows)).select("path", "name", "target_path")


@query(f"""{_affected_sql(4, 25, 0.2)}, named AS (SELECT DISTINCT CASE WHEN e.kind = 'endpoint' THEN 'apis' ELSE 'modules' END AS "group", e.name FROM best b JOIN entities e USING (stable_key) WHERE e.kind IN ('endpoint', 'module', 'package'))
    SELECT "group", name FROM named""")
def change_summary(spark, sf_dir):
    affected, _ = _affected(spark, sf_dir, max_nodes=None)
    return summary.change_summary(affected, facts(spark, sf_dir)[0])


@query("SELECT source_key, concat('# ', min(h.name), chr(10), chr(10), string_agg(concat('- `', e.name, '`'), chr(10) ORDER BY e.name)) AS document FROM relationships r JOIN entities e ON r.target_key = e.stable_key JOIN entities h ON r.source_key = h.stable_key WHERE r.kind = 'HANDLES' GROUP BY source_key")
def api_documents(spark, sf_dir):
    return summary.api_document(*facts(spark, sf_dir))



def _documented(spark, sf_dir) -> DataFrame:
    """Orders as endpoints, suppliers as configuration, parts as build scripts; some attributes missing or no texts."""
    o, s_, p = (table(spark, sf_dir, t) for t in ("orders", "supplier", "part"))
    none, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    method = F.when(F.col("o_orderkey") % 3 == 0, '{"httpMethod": 7}').when(F.col("o_orderkey") % 3 == 1, '{"httpMethod": "GET", "responseType": "Order"}').otherwise("no JSON")
    value = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('{"defaultValue": "'), "s_nationkey", F.lit('"}')))
    endpoints = o.select(F.lit("endpoint").alias("kind"), F.concat(F.lit("/orders/"), "o_orderkey").alias("name"), none.alias("qualified_name"), F.lit(0.75).alias("confidence"), method.alias("attributes"))
    keys = s_.select(F.lit("configuration_key"), F.concat(F.lit("key."), "s_suppkey"), none, sure, value)
    scripts = p.select(F.lit("build_script"), F.concat(F.lit("script"), "p_partkey"), F.concat(F.lit("part.script"), "p_partkey"), sure, F.concat(F.lit('{"commands": ["make '), "p_size", F.lit('", "test"]}')))
    return endpoints.union(keys).union(scripts)


_ROUTES = "SELECT concat('- `', CASE WHEN o_orderkey % 3 = 1 THEN 'GET' ELSE 'UNKNOWN' END, ' /orders/', o_orderkey, '`', CASE WHEN o_orderkey % 3 = 1 THEN ' \u2014 response: Order' ELSE '' END) AS line FROM orders"


@query(f"""SELECT 0 AS ordinal, 'Entry points' AS section, line FROM ({_ROUTES}) r
    UNION ALL SELECT 1, 'Local commands', concat('- `', c, '`') FROM (SELECT DISTINCT concat('make ', p_size) AS c FROM part UNION SELECT 'test' FROM part) t
    UNION ALL SELECT 2, 'Key entities', concat('- **endpoint** `/orders/', o_orderkey, '` \u2014 confidence 75%') FROM orders
    UNION ALL SELECT 2, 'Key entities', concat('- **configuration_key** `key.', s_suppkey, '` \u2014 confidence 100%') FROM supplier
    UNION ALL SELECT 2, 'Key entities', concat('- **build_script** `part.script', p_partkey, '` \u2014 confidence 100%') FROM part""", False)
def onboarding_document(spark, sf_dir):
    return summary.document_lines(_documented(spark, sf_dir), "onboarding").select("ordinal", "section", "line")


@query("SELECT 0 AS ordinal, 'Configuration' AS section, concat('- `key.', s_suppkey, '`', CASE WHEN s_suppkey % 2 = 0 THEN concat(' = `', s_nationkey, '`') ELSE '' END) AS line FROM supplier", False)
def configuration_document(spark, sf_dir):
    return summary.document_lines(_documented(spark, sf_dir), "configuration").select("ordinal", "section", "line")


@query("""SELECT concat('This page is grounded in revision `r2` and ', (SELECT count(*) FROM orders) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part), ' selected canonical facts (',
    (SELECT count(*) FROM part), ' build_script, ', (SELECT count(*) FROM supplier), ' configuration_key, ', (SELECT count(*) FROM orders), ' endpoint).') AS overview""", False)
def document_overview(spark, sf_dir):
    return summary.document_overview(_documented(spark, sf_dir), "r2")


@query("""SELECT o_orderkey AS question, concat('E', row_number() OVER (PARTITION BY o_orderkey ORDER BY turn, a, l)) AS evidence_id, kind, reference FROM (
    SELECT l_orderkey AS o_orderkey, 0 AS turn, concat('p', l_partkey) AS a, l_linenumber AS l, 'structural' AS kind, concat('p', l_partkey, ':', l_linenumber) AS reference FROM lineitem
    UNION ALL SELECT o_orderkey, 1, concat('c', o_custkey), 0, 'semantic', concat('c', o_custkey) FROM orders) t""", False)
def evidence_pack(spark, sf_dir):
    structural = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question"), F.concat(F.lit("p"), "l_partkey").alias("path"), F.col("l_linenumber").alias("start_line"))
    semantic = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question"), F.concat(F.lit("c"), "o_custkey").alias("id"), F.lit(0.5).alias("similarity"))
    return answering.evidence_pack(structural, semantic).select("question", "evidence_id", "kind", "reference")


@query("SELECT o_orderkey AS question, CASE WHEN o_orderkey % 2 = 0 THEN 'See [E1]' ELSE concat('- c', o_custkey, ' [E1]') END AS answer, 'E1' AS citations, 'medium' AS confidence FROM orders", False)
def grounded_answers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question"), F.concat(F.lit("c"), "o_custkey").alias("id"), F.lit(0.5).alias("similarity"))
    none = spark.createDataFrame([], "question long, path string, start_line int")
    said = orders.select("question", F.when(F.col("question") % 2 == 0, "See [E1][E7]").otherwise("Nothing cited [E7]").alias("answer"))
    return answering.answers(answering.evidence_pack(none, orders), said).withColumn("citations", F.array_join("citations", ","))


@query("SELECT o_orderkey AS reference, concat('c', c_custkey) AS target, CAST(0.8 AS DOUBLE) AS confidence FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0", False)
def cross_language_links(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference"), F.col("o_custkey").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, "java").otherwise("kotlin").alias("language"))
    symbols = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("stable_key"), F.col("c_custkey").alias("name"), F.lit("kotlin").alias("language"))
    return project.link_across(orders, symbols)
