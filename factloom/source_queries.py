"""Queries over source files that are written from the driver tables: nested declarations, symbols, frameworks, syntax.

Importing this module adds them to those of factloom.queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import activation, diff, impact, projection, report
from factloom.plans import facts, kept, revisions, shared_path
from factloom.queries import _affected_sql, query, table
from factloom.sources import enrichment, structure, symbols
from factloom.streaming import claims


def _files(rows: DataFrame, path: str, language: str, content: str) -> DataFrame:
    """A file for each row: path and content have the row's columns in {}, as {column}."""
    filled = lambda text: F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(text.replace("}}", "\x02").replace("{{", "\x01").replace("}", "{").split("{"))])
    plain = lambda text: F.translate(filled(text), "\x01\x02", "{}")
    return rows.select(plain(path).alias("path"), F.lit(language).alias("language"), plain(content).alias("content"))


_JAVA = """package p{n};

@Service("s{k} {{")
public class S{k} extends Base {{
  // class Ghost {{
  private int limit = {n}, other;
  public S{k}(int a) {{ }}
  static class Inner {{
    interface Deep {{
      int f{k}(String x, Map<String, Integer> y);
    }}
    String s = "}}";
  }}
  @Test
  void run() {{ if (x) {{ go(); }} }}
}}
"""
_KOTLIN = """package k{n}
class C{k}(val x: Int) {{
    val limit = 1
    object Inner {{
        fun deep(a: Int, b: Int): Int {{
            return 1
        }}
    }}
}}
fun top{k}() = 2
"""
_TYPESCRIPT = """@Controller("c")
export class T{k} {{
  constructor(private a: A) {{}}
  find(id: string): string {{
    const inner = (x) => {{ return `}}`; }};
    return inner(id);
  }}
}}
"""


def _declared_sql() -> str:
    rows = {
        "java": [("package", "'p' || n", "NULL", 1, 1, "NULL"), ("class", "'S' || k", "NULL", 3, 16, "NULL"), ("field", "'limit'", "'S' || k", 6, 6, "NULL"), ("field", "'other'", "'S' || k", 6, 6, "NULL"), ("constructor", "'S' || k", "'S' || k", 7, 7, "1"), ("class", "'Inner'", "'S' || k", 8, 13, "NULL"), ("interface", "'Deep'", "'Inner'", 9, 11, "NULL"), ("method", "'f' || k", "'Deep'", 10, 10, "2"), ("field", "'s'", "'Inner'", 12, 12, "NULL"), ("method", "'run'", "'S' || k", 14, 15, "0"), ("test", "'run'", "'run'", 14, 15, "0")],
        "kotlin": [("package", "'k' || n", "NULL", 1, 1, "NULL"), ("class", "'C' || k", "NULL", 2, 9, "NULL"), ("field", "'limit'", "'C' || k", 3, 3, "NULL"), ("object", "'Inner'", "'C' || k", 4, 8, "NULL"), ("method", "'deep'", "'Inner'", 5, 7, "2"), ("function", "'top' || k", "NULL", 10, 10, "0")],
        "typescript": [("class", "'T' || k", "NULL", 1, 8, "NULL"), ("constructor", "'T' || k", "'T' || k", 3, 3, "1"), ("method", "'find'", "'T' || k", 4, 7, "1"), ("function", "'inner'", "'find'", 5, 5, "1")],
    }
    tables = {"java": ("'S' || k || '.java'", "SELECT s_suppkey AS k, s_nationkey AS n FROM supplier"), "kotlin": ("'C' || k || '.kt'", "SELECT c_custkey AS k, c_nationkey AS n FROM customer"), "typescript": ("'T' || k || '.ts'", "SELECT p_partkey AS k, p_size AS n FROM part")}
    return " UNION ALL ".join(f"SELECT {tables[language][0]} AS path, '{kind}' AS kind, {name} AS name, {owner} AS owner, {a} AS start_line, {b} AS end_line, CAST({arity} AS INTEGER) AS arity FROM ({tables[language][1]}) t" for language, all_ in rows.items() for kind, name, owner, a, b, arity in all_)


def _three_languages(spark, sf_dir) -> DataFrame:
    java = _files(table(spark, sf_dir, "supplier").selectExpr("s_suppkey k", "s_nationkey n"), "S{k}.java", "java", _JAVA)
    kotlin = _files(table(spark, sf_dir, "customer").selectExpr("c_custkey k", "c_nationkey n"), "C{k}.kt", "kotlin", _KOTLIN)
    return java.union(kotlin).union(_files(table(spark, sf_dir, "part").selectExpr("p_partkey k", "p_size n"), "T{k}.ts", "typescript", _TYPESCRIPT))


@query(_declared_sql(), False)
def nested_declarations(spark, sf_dir):
    found = kept(structure.declared(_three_languages(spark, sf_dir)))
    owners = found.select(F.col("id").alias("owner"), F.col("name").alias("_owner"))
    return found.join(owners, "owner", "left").select("path", "kind", "name", F.col("_owner").alias("owner"), "start_line", "end_line", "arity")


@query("""SELECT 'S' || s_suppkey || '.java' AS path, 'S' || s_suppkey AS owner, 'Service' AS name, '"s' || s_suppkey || ' {"' AS arguments FROM supplier
    UNION ALL SELECT 'S' || s_suppkey || '.java', 'run', 'Test', NULL FROM supplier UNION ALL SELECT 'T' || p_partkey || '.ts', 'T' || p_partkey, 'Controller', '"c"' FROM part""", False)
def declared_annotations(spark, sf_dir):
    found = kept(structure.declared(_three_languages(spark, sf_dir)))
    names = found.select(F.col("id").alias("owner"), F.col("name").alias("_owner"))
    return structure.annotations(found).join(names, "owner").select("path", F.col("_owner").alias("owner"), "name", "arguments")


#: A quarter of the files each lacks a bracket, has one too many, closes another kind, or leaves a string open.
_FAULTS = """CASE s_suppkey % 5 WHEN 1 THEN concat('{', ' is never closed') WHEN 2 THEN '} closes nothing' WHEN 3 THEN '] closes ( of line 2' WHEN 4 THEN 'a string without an end' END"""


@query(f"SELECT 'S' || s_suppkey || '.java' AS path, CASE s_suppkey % 5 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 2 END AS line, 'error' AS severity, 'JAVA_SYNTAX_ERROR' AS code, {_FAULTS} AS message FROM supplier WHERE s_suppkey % 5 <> 0", False)
def syntax_diagnostics(spark, sf_dir):
    k = F.col("s_suppkey") % 5
    middle = F.when(k == 3, 'int a = f(1];').when(k == 4, 'String s = "open').otherwise("int a = f(1); // ]")
    end = F.when(k == 1, "").when(k == 2, "}\n}").otherwise("}")
    content = F.concat(F.lit("class A {\n  "), middle, F.lit("\n"), end)
    artifacts = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey", F.lit(".java")).alias("path"), F.lit("java").alias("language"), content.alias("content"))
    return structure.syntax_diagnostics(artifacts)


# Symbols: a class for each customer in its nation's package, a file for each supplier that names one

_SYMBOLS = """symbols AS (
        SELECT 'c' || c_custkey AS id, 'K' || (c_custkey % 40) AS name, 'n' || c_nationkey AS package FROM customer
    ), asked AS (
        SELECT s_suppkey AS k, 'n' || s_nationkey AS package, 'n' || ((s_nationkey + 1) % 25) AS other, 'K' || (s_suppkey % 40) AS real, s_suppkey % 5 AS way FROM supplier
    ), named AS (
        SELECT *, CASE way WHEN 3 THEN 'Alias' WHEN 4 THEN other || '.' || real ELSE real END AS name FROM asked
    ), seen AS (
        SELECT a.k, s.id, min(CASE WHEN a.way = 4 AND s.package = a.other THEN 0 WHEN a.way = 1 AND s.package = a.other THEN 1
            WHEN a.way IN (0, 1, 2) AND s.package = a.package THEN 2 WHEN a.way = 2 AND s.package = a.other THEN 3 WHEN a.way = 3 AND s.package = a.other THEN 4 END) AS rank
        FROM named a JOIN symbols s ON s.name = a.real GROUP BY a.k, s.id
    )"""


@query(f"""WITH {_SYMBOLS} SELECT a.k AS ref, count(s.rank) AS candidates, CASE min(s.rank) WHEN 0 THEN 'exact' WHEN 1 THEN 'import' WHEN 2 THEN 'package' WHEN 3 THEN 'wildcard' WHEN 4 THEN 'alias' END AS rank,
    CASE WHEN count(s.rank) = 1 THEN min(CASE WHEN s.rank IS NOT NULL THEN s.id END) END AS target FROM named a LEFT JOIN seen s USING (k) GROUP BY a.k""", False)
def jvm_symbols(spark, sf_dir):
    none = F.lit(None).cast("string")
    known = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) id", "'class' kind", "concat('K', c_custkey % 40) name", "concat('n', c_nationkey, '.K', c_custkey % 40) qualified_name", "concat('n', c_nationkey) package").select("*", none.alias("owner_name"), F.lit(None).cast("int").alias("arity"))
    asked = table(spark, sf_dir, "supplier").selectExpr("s_suppkey ref", "concat('s', s_suppkey) path", "concat('n', s_nationkey) package", "concat('n', (s_nationkey + 1) % 25) other", "concat('K', s_suppkey % 40) real", "s_suppkey % 5 way")
    name = F.when(F.col("way") == 3, "Alias").when(F.col("way") == 4, F.concat_ws(".", "other", "real")).otherwise(F.col("real"))
    imports = asked.where("way in (1, 2, 3)").select("path", F.when(F.col("way") == 2, F.col("other")).otherwise(F.concat_ws(".", "other", "real")).alias("qualified_name"), (F.col("way") == 2).alias("wildcard"), F.when(F.col("way") == 3, "Alias").alias("alias"))
    references = asked.select("ref", "path", "package", name.alias("name"), F.lit("type").alias("wants"), none.alias("owner_name"), F.lit(None).cast("int").alias("arity"))
    return symbols.resolve(references, known, imports).select("ref", F.size("candidates").cast("long").alias("candidates"), "rank", "target")


# Frameworks: a Spring controller for each supplier, an Express router for each nation

_SPRING = """package web;
@RestController
@RequestMapping("/s{k}")
@PreAuthorize("x")
public class S{k} {{
  @GetMapping("/one")
  public User one(String id) {{ return find(id); }}

  @Secured("ADMIN")
  @RequestMapping(value = "/all", method = {{RequestMethod.POST, RequestMethod.PUT}})
  public User all(@RequestBody User user) {{ return user; }}

  @DeleteMapping(PATH)
  public void remove() {{ }}
}}
"""
_EXPRESS = """const users = express.Router();
app.use("/n{k}", users);
function list(req, res) {{
  res.end();
}}
function auth(req, res, next) {{ next(); }}
users.get("/:id", auth, list);
app.post("/lost", gone);
"""


def _web(spark, sf_dir):
    java = _files(table(spark, sf_dir, "supplier").selectExpr("s_suppkey k"), "S{k}.java", "java", _SPRING)
    statements, declared = structure.read(java.union(_files(table(spark, sf_dir, "customer").selectExpr("c_custkey k"), "N{k}.ts", "typescript", _EXPRESS)))
    return declared, enrichment.enrich(enrichment.candidates(statements, declared), declared)


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier), n AS (SELECT c_custkey AS k FROM customer), r AS (
        SELECT 'S' || k || '.java' AS path, 'GET' AS method, '/s' || k || '/one' AS route, 'one' AS handler, ['PreAuthorize'] AS uses FROM s
        UNION ALL SELECT 'S' || k || '.java', m, '/s' || k || '/all', 'all', ['PreAuthorize', 'Secured'] FROM s, (VALUES ('POST'), ('PUT')) v(m)
        UNION ALL SELECT 'N' || k || '.ts', 'GET', '/n' || k || '/{id}', 'list', ['auth'] FROM n
    )
    SELECT path, 'HANDLES' AS kind, handler AS source, method || ' ' || route AS target, CAST(NULL AS INTEGER) AS ordinal FROM r
    UNION ALL SELECT path, 'USES_MIDDLEWARE', method || ' ' || route, uses[i], CAST(i - 1 AS INTEGER) FROM (SELECT *, unnest(range(1, len(uses) + 1)) AS i FROM r) u""", False)
def framework_edges(spark, sf_dir):
    declared, (endpoints, edges, _) = _web(spark, sf_dir)
    endpoints, edges = kept(endpoints), kept(edges)
    routes = endpoints.select(F.col("id").alias("_e"), "path", F.concat_ws(" ", "method", "route").alias("_route"))
    names = declared.select(F.col("id").alias("source"), F.col("name").alias("_name"))
    handles = edges.where("kind = 'HANDLES'").join(names, "source").join(routes, F.col("target") == F.col("_e")).select("path", "kind", F.col("_name").alias("source"), F.col("_route").alias("target"), "ordinal")
    uses = edges.where("kind = 'USES_MIDDLEWARE'").join(routes, F.col("source") == F.col("_e")).select("path", "kind", F.col("_route").alias("source"), F.regexp_replace("target", "^.*#middleware:", "").alias("target"), "ordinal")
    return handles.union(uses)


@query("""SELECT 'S' || s_suppkey || '.java' AS path, 13 AS line, 'warning' AS severity, 'SPRING_DYNAMIC_ROUTE' AS code, 'Route expression PATH is not a supported static string' AS message FROM supplier
    UNION ALL SELECT 'N' || c_custkey || '.ts', 8, 'warning', 'EXPRESS_FRAMEWORK_UNRESOLVED_HANDLER', 'Handler gone could not be resolved in the source artifact' FROM customer""", False)
def framework_diagnostics(spark, sf_dir):
    return _web(spark, sf_dir)[1][2]


# Activation: a run for each order stages its customer's artifact

_ACTIVATION = """asked AS (
        SELECT CAST(o_orderkey AS VARCHAR) AS run_id FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT CAST(-o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 101 = 0
    ), runs AS (
        SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_orderkey % 50 = 3 THEN 'other' ELSE 'shop' END AS repository_id, CAST(o_custkey AS VARCHAR) AS artifact_id, CASE WHEN o_orderkey % 60 = 5 THEN 'active' ELSE 'staged' END AS status FROM orders
    ), deleted AS (SELECT CAST(c_custkey AS VARCHAR) AS artifact_id FROM customer WHERE c_custkey % 41 = 0
    ), artifacts AS (SELECT CAST(c_custkey AS VARCHAR) AS artifact_id, CASE WHEN c_custkey % 47 = 0 THEN 'other' ELSE 'shop' END AS repository_id FROM customer WHERE c_custkey % 43 <> 0
    ), touched AS (SELECT artifact_id FROM runs UNION SELECT artifact_id FROM deleted
    ), known AS (
        SELECT 'e' || o_orderkey AS stable_key FROM orders UNION SELECT 'b' || c_custkey FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT artifact_id FROM touched)
    ), ends AS (SELECT 'e' || o_orderkey AS stable_key FROM orders UNION SELECT 'b' || o_custkey FROM orders UNION SELECT 'b' || (o_orderkey % 200) FROM orders)"""


def _catalog(spark, sf_dir, faults: bool):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, owner = F.col("o_orderkey").cast("string"), F.col("c_custkey").cast("string").alias("artifact_id")
    # without faults each customer's first order stages its artifact
    if not faults:
        orders = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    runs = orders.select(key.alias("run_id"), F.when(F.lit(faults) & (F.col("o_orderkey") % 50 == 3), "other").otherwise("shop").alias("repository_id"), F.lit("r2").alias("revision_id"), F.col("o_custkey").cast("string").alias("artifact_id"), F.when(F.lit(faults) & (F.col("o_orderkey") % 60 == 5), "active").otherwise("staged").alias("status"))
    artifacts = customer.where((F.col("c_custkey") % 43 != 0) | F.lit(not faults)).select(owner, F.when(F.lit(faults) & (F.col("c_custkey") % 47 == 0), "other").otherwise("shop").alias("repository_id"), F.lit("r1").alias("active_revision"))
    revisions = spark.createDataFrame([("r1", "shop", "active"), ("r2", "shop", "staged")], "revision_id string, repository_id string, status string")
    entities = customer.select(F.concat(F.lit("b"), "c_custkey").alias("stable_key"), owner, F.lit("r0").alias("first_seen"), F.lit("r1").alias("last_seen"))
    edges = customer.select(F.lit("CALLS").alias("kind"), F.concat(F.lit("b"), "c_custkey").alias("source_key"), F.concat(F.lit("b"), F.col("c_custkey") % 100 + 1).alias("target_key"), owner, F.lit("r1").alias("first_seen"), F.lit("r1").alias("last_seen"))
    catalog = activation.Catalog(runs, artifacts, revisions, spark.createDataFrame([], "idempotency_key string"), entities, edges)
    asked = runs.select("run_id")
    if faults:
        asked = asked.union(orders.where("o_orderkey % 97 = 0").select(key)).union(orders.where("o_orderkey % 101 = 0").select((-F.col("o_orderkey")).cast("string")))
    ordered = orders.select(F.col("o_custkey").alias("c_custkey")).distinct()
    deleted = (customer.where("c_custkey % 41 = 0") if faults else customer.where("c_custkey % 3 = 0").join(ordered, "c_custkey", "left_anti")).select(owner)
    return orders, catalog, activation.Request("shop", "r2", asked, deleted)


@query(f"""WITH {_ACTIVATION}
    SELECT 'duplicate run' AS rule, run_id AS subject FROM asked GROUP BY run_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'unknown run', run_id FROM asked WHERE run_id NOT IN (SELECT run_id FROM runs)
    UNION ALL SELECT 'run of another revision', run_id FROM runs WHERE repository_id = 'other'
    UNION ALL SELECT DISTINCT 'mixed status', status FROM runs WHERE status <> 'staged'
    UNION ALL SELECT 'artifact staged twice', artifact_id FROM runs GROUP BY artifact_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'artifact changed and deleted', artifact_id FROM runs WHERE artifact_id IN (SELECT artifact_id FROM deleted)
    UNION ALL SELECT 'unknown artifact', artifact_id FROM touched WHERE artifact_id NOT IN (SELECT artifact_id FROM artifacts)
    UNION ALL SELECT 'artifact of another repository', artifact_id FROM touched JOIN artifacts USING (artifact_id) WHERE repository_id = 'other'
    UNION ALL SELECT 'relationship without an end', stable_key FROM ends WHERE stable_key NOT IN (SELECT stable_key FROM known)""", False)
def activation_violations(spark, sf_dir):
    orders, catalog, request = _catalog(spark, sf_dir, True)
    run, own = F.col("o_orderkey").cast("string").alias("run_id"), F.concat(F.lit("e"), "o_orderkey")
    edge = lambda target: orders.select(run, F.lit("CALLS").alias("kind"), own.alias("source_key"), F.concat(F.lit("b"), target).alias("target_key"))
    return activation.violations(request, catalog, orders.select(run, own.alias("stable_key")), edge(F.col("o_custkey")).union(edge(F.col("o_orderkey") % 200)))


@query("""WITH first AS (SELECT o_custkey AS k, min(o_orderkey) AS o FROM orders GROUP BY o_custkey), stay AS (
        SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT k FROM first) AND c_custkey % 3 <> 0
    ), e AS (
        SELECT 'b' || k AS stable_key, 'r0' AS first_seen, 'r1' AS last_seen FROM stay UNION ALL SELECT 'b' || k, 'r0', 'r2' FROM first UNION ALL SELECT 'e' || o, 'r2', 'r2' FROM first
    )
    SELECT 'entity' AS what, stable_key AS source, NULL AS target, first_seen, last_seen FROM e
    UNION ALL SELECT 'CALLS', 'b' || k, 'b' || (k % 100 + 1), 'r1', 'r1' FROM stay WHERE 'b' || (k % 100 + 1) IN (SELECT stable_key FROM e)
    UNION ALL SELECT 'CALLS', 'e' || o, 'b' || k, 'r2', 'r2' FROM first""", False)
def activated_revision(spark, sf_dir):
    orders, catalog, request = _catalog(spark, sf_dir, False)
    run, own, old = F.col("o_orderkey").cast("string").alias("run_id"), F.concat(F.lit("e"), "o_orderkey"), F.concat(F.lit("b"), "o_custkey")
    staged = orders.select(run, F.explode(F.array(own, old)).alias("stable_key"))
    after = activation.activate(request, catalog, staged, orders.select(run, F.lit("CALLS").alias("kind"), own.alias("source_key"), old.alias("target_key")))
    entities = after.entities.select(F.lit("entity").alias("what"), F.col("stable_key").alias("source"), F.lit(None).cast("string").alias("target"), "first_seen", "last_seen")
    return entities.union(after.relationships.select("kind", "source_key", "target_key", "first_seen", "last_seen"))


# Queues: an outbox row for each order, and the events' users as keys that are claimed


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate, o_orderkey % 4 = 1 AS published, o_orderkey % 5 = 0 AS held, o_orderkey % 35 = 0 AS stale, o_orderkey % 3 AS attempts FROM orders), g AS (
        SELECT id FROM o WHERE NOT published AND (NOT held OR stale) ORDER BY o_orderdate, id LIMIT 20
    )
    SELECT id, CASE WHEN id IN (SELECT id FROM g) THEN 'me' WHEN held THEN 'other' END AS claim_owner, CAST(attempts + CASE WHEN id IN (SELECT id FROM g) THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM o""", False)
def claimed_outbox(spark, sf_dir):
    k = F.col("o_orderkey")
    now, none = F.to_timestamp(F.lit("2030-01-01 00:00:00")), F.lit(None).cast("timestamp")
    outbox = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(k % 4 == 1, now).alias("published_at"), none.alias("next_attempt_at"),
        F.when(k % 35 == 0, now - F.expr("INTERVAL 60 SECONDS")).when(k % 5 == 0, now).alias("claimed_at"), F.when(k % 5 == 0, "other").alias("claim_owner"), (k % 3).cast("int").alias("attempts"),
    )
    return claims.claim(outbox, now, "me")[1].select("id", "claim_owner", "attempts")


@query()
def claims_stream(spark, sf_dir):
    """Every user's events as claims, renewals, releases and publications of two owners, through the stateful stream and
    its timers; held against a plain replay in the tests."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", claims.PROVIDER)
    events = session.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as a stream takes no single file
    event = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "renew").when(F.col("event_type") == "error", "release").otherwise("publish")
    event = F.when((event == "publish") & (F.col("event_id") % 11 != 0), "claim").otherwise(event)
    rows = events.select(F.col("user_id").alias("key"), event.alias("event"), F.concat(F.lit("o"), F.col("event_id") % 2).alias("owner"), F.col("ts").alias("at"), "event_id", F.lit(86_400).alias("seconds"))
    out = shared_path(spark, "claims")
    claims.stream_claims(rows, late="1 hour").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


# Chunks: two to a document, of which every second document is updated and some are removed

_CHUNKS = """old AS (SELECT doc_id, n, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE 'm' END AS model FROM documents, (VALUES (0), (1)) v(n) WHERE doc_id % 3 <> 0
    ), new AS (SELECT doc_id, n, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'same' END AS checksum FROM documents, (VALUES (0), (1)) v(n) WHERE doc_id % 2 = 0 AND (n = 0 OR doc_id % 4 = 0))"""


@query(f"""WITH {_CHUNKS}
    SELECT 'c' || doc_id || ':' || n AS id, 'same' AS checksum, model, 'r1' AS revision FROM old WHERE doc_id % 2 = 1 AND doc_id % 11 <> 0
    UNION ALL SELECT 'c' || doc_id || ':' || n, checksum, 'm', 'r2' FROM new""", False)
def chunk_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("parent"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    docs = docs.withColumn("id", F.concat(F.lit("c"), "doc_id", F.lit(":"), "n"))
    k = F.col("doc_id")
    existing = docs.where(k % 3 != 0).select("id", "parent", F.lit("same").alias("checksum"), F.when(k % 7 == 0, "old").otherwise("m").alias("model"), F.lit("r1").alias("revision"), F.array(F.lit(0.0)).alias("vector"))
    chunks_ = docs.where((k % 2 == 0) & ((F.col("n") == 0) | (k % 4 == 0))).select("id", "parent", F.when(k % 5 == 0, "new").otherwise("same").alias("checksum"))
    planned = kept(projection.plan(existing, chunks_, docs.where(k % 2 == 0).select("parent").distinct(), docs.where((k % 2 == 1) & (k % 11 == 0)).select("parent").distinct(), "m"))
    vectors = planned.where("action = 'embed'").select("id", F.array(F.lit(1.0)).alias("vector"))
    return projection.merged(existing, chunks_, planned, vectors, "m", "r2").select("id", "checksum", "model", "revision")


# The report of the change between the two revisions


@query(f"""{_affected_sql(2, 25, 0.2)}, r AS (
        SELECT 0 AS ordinal, '- `' || s_name || '`' AS line FROM supplier
        UNION ALL SELECT 1, '- **' || change || '** `' || stable_key || '`' || CASE WHEN changed_fields <> '' THEN ' (' || changed_fields || ')' ELSE '' END FROM changed
        UNION ALL SELECT CASE kind WHEN 'endpoint' THEN 3 ELSE 4 END, '- `' || stable_key || '`' FROM best JOIN entities USING (stable_key) WHERE kind IN ('endpoint', 'module', 'package')
        UNION ALL SELECT 6, '- `c' || c_custkey || '` — ' || CASE c_custkey % 3 WHEN 0 THEN 'Direct TESTS relationship to a changed entity (0.90, inferred)' WHEN 1 THEN 'Calls or imports an affected code path (0.78, inferred)' ELSE 'Connected through the bounded affected subgraph (0.90, inferred)' END FROM customer
        UNION ALL SELECT 7, '- **' || n_name || ' (+' || n_nationkey || ')**' FROM nation
        UNION ALL SELECT 8, '- ' || n_name FROM (SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 5) t
        UNION ALL SELECT * FROM (VALUES (2, '_None._'), (5, '_None._')) v
    )
    SELECT CAST(ordinal AS INTEGER) AS ordinal, line FROM r""")
def change_report(spark, sf_dir):
    entities, relationships = facts(spark, sf_dir)
    changes = kept(diff.entity_diff(*revisions(spark, sf_dir)))
    affected = impact.affected(relationships, changes, max_depth=2, max_nodes=None).join(entities.select("stable_key", "kind"), "stable_key")
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("stable_key"), (F.col("c_custkey") % 3).cast("int").alias("k"))
    step = lambda kind: F.array(F.struct(F.lit(kind).alias("kind")))
    paths = customer.select("stable_key", F.lit(0.9).alias("confidence"), F.when(F.col("k") == 0, step("TESTS")).when(F.col("k") == 1, step("CALLS")).otherwise(step("CONTAINS")).alias("path"))
    tests = report.suggested_tests(customer.select("stable_key", F.col("stable_key").alias("test_name")), paths, spark.createDataFrame([], "name string"))
    factors = table(spark, sf_dir, "nation").select(F.col("n_name").alias("factor"), F.col("n_nationkey").cast("int").alias("weight"))
    return report.lines(changes, affected, tests, factors, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("path"))).select("ordinal", "line")
