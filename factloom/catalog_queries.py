"""More queries over the driver tables: provenance, the catalog's merges, whole analyses, extraction, documents.

Importing this module adds them to those of factloom.queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import functions as X
from factloom import streaming
from factloom.operators import answers as answering
from factloom.operators import asking, catalog, chunks, diff, documentation, impact, provenance, relational
from factloom.plans import facts, kept, revisions
from factloom.queries import _DIFF, QUERIES, _relationship_revisions, query, table
from factloom.sources import extraction, manifests, scanners

# Provenance

_PROVENANCE = """provenance AS (SELECT concat('endpoint:', o_orderkey) AS stable_key, o_custkey AS artifact_id, o_orderkey % 100 AS start_line, o_orderkey % 100 + 5 AS end_line FROM orders WHERE o_orderkey % 4 <> 0),
    artifacts AS (SELECT c_custkey AS artifact_id, concat('src/', c_custkey, '.java') AS path FROM customer WHERE c_custkey % 3 <> 0)"""


def _provenance(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    line = F.col("o_orderkey") % 100
    places = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.concat(F.lit("endpoint:"), "o_orderkey").alias("stable_key"), F.col("o_custkey").alias("artifact_id"), line.alias("start_line"), (line + 5).alias("end_line"))
    artifacts = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("artifact_id"), F.concat(F.lit("src/"), "c_custkey", F.lit(".java")).alias("path"))
    return places, artifacts


@query(f", {_PROVENANCE} SELECT stable_key, kind, path, start_line, end_line FROM entities LEFT JOIN provenance USING (stable_key) LEFT JOIN artifacts USING (artifact_id)")
def entity_sources(spark, sf_dir):
    return provenance.with_sources(facts(spark, sf_dir)[0], *_provenance(spark, sf_dir)).select("stable_key", "kind", "path", "start_line", "end_line")


@query(f", {_PROVENANCE} SELECT stable_key, name, path, start_line FROM entities JOIN provenance USING (stable_key) JOIN artifacts USING (artifact_id)")
def structural_references(spark, sf_dir):
    entities = facts(spark, sf_dir)[0]
    return provenance.structural_references(entities, _provenance(spark, sf_dir)[0], entities, _provenance(spark, sf_dir)[1]).select("stable_key", "name", "path", "start_line")


@query("SELECT concat('e', o_orderkey) AS stable_key, c_name AS owner_path, c_mktsegment AS owner_kind FROM orders JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0", False)
def owned_entities(spark, sf_dir):
    entities = table(spark, sf_dir, "orders").select(F.concat(F.lit("e"), "o_orderkey").alias("stable_key"), F.col("o_custkey").alias("artifact_id"))
    artifacts = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("artifact_id"), F.col("c_name").alias("path"), F.col("c_mktsegment").alias("kind"))
    return provenance.owned(entities, artifacts).select("stable_key", "owner_path", "owner_kind")


@query("SELECT o_orderkey AS revision_id, c_name AS repository FROM orders JOIN customer ON o_custkey = c_custkey", False)
def revision_repositories(spark, sf_dir):
    revisions_ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("revision_id"), F.col("o_custkey").alias("repository_id"))
    return provenance.revisions_of(revisions_, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repository_id"), F.col("c_name").alias("name"))).select("revision_id", "repository")


@query("SELECT concat(l_orderkey, ':', l_linenumber) AS id, concat('sha', l_partkey) AS sha, coalesce(o_orderkey % 2 = 0 AND l_partkey = o_custkey, false) AS current FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderkey % 2 = 0", False)
def pull_request_revisions(spark, sf_dir):
    requests = table(spark, sf_dir, "lineitem").select(F.concat("l_orderkey", F.lit(":"), "l_linenumber").alias("id"), F.col("l_orderkey").alias("revision_id"), F.concat(F.lit("sha"), "l_partkey").alias("sha"))
    known = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("revision_id"), F.concat(F.lit("sha"), "o_custkey").alias("sha"))
    return provenance.pull_requests_at(requests, known)


@query("""WITH d AS (SELECT concat('d', p_partkey) AS stable_key, p_partkey % 100 AS path, p_size * 7 AS start_line, p_size * 7 + p_partkey % 90 AS end_line FROM part)
    SELECT id, owner FROM (SELECT o_orderkey AS id, stable_key AS owner, row_number() OVER (PARTITION BY o_orderkey ORDER BY stable_key IS NULL, end_line - start_line, start_line DESC, stable_key) AS n
        FROM orders LEFT JOIN d ON o_custkey % 100 = path AND o_orderkey % 400 BETWEEN start_line AND end_line) t WHERE n = 1""", False)
def enclosing_declarations(spark, sf_dir):
    places = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("path"), (F.col("o_orderkey") % 400).alias("line"))
    start = F.col("p_size") * 7
    declared = table(spark, sf_dir, "part").select(F.concat(F.lit("d"), "p_partkey").alias("stable_key"), (F.col("p_partkey") % 100).alias("path"), start.alias("start_line"), (start + F.col("p_partkey") % 90).alias("end_line"))
    return provenance.closest_enclosing(places, declared)


@query("SELECT stable_key, name FROM entities WHERE name ILIKE '%1-urgent%' OR attributes ILIKE '%1-urgent%' ORDER BY name, stable_key LIMIT 5")
def question_roots(spark, sf_dir):
    return provenance.root_lookup(facts(spark, sf_dir)[0], "1-uRGent").select("stable_key", "name")


# The catalog


@query("SELECT l_orderkey AS report, l_linenumber AS factor FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 100 FROM orders WHERE o_orderkey % 3 = 0", False)
def report_children(spark, sf_dir):
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").cast("long").alias("factor"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report"), F.lit(100).cast("long").alias("factor"))
    return catalog.replace_children(children, orders, orders.where("report % 3 = 0"), "report")


@query("SELECT o_custkey AS repository_id, o_orderkey % 2 AS revision_id, o_orderkey AS finding FROM orders WHERE NOT (o_orderkey % 2 = 1 AND o_custkey % 5 = 0) UNION ALL SELECT c_custkey, 1, -1 FROM customer WHERE c_custkey % 5 = 0", False)
def replaced_analysis(spark, sf_dir):
    current = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repository_id"), (F.col("o_orderkey") % 2).alias("revision_id"), F.col("o_orderkey").alias("finding"))
    new = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("repository_id"), F.lit(1).cast("long").alias("revision_id"), F.lit(-1).cast("long").alias("finding"))
    return catalog.replace_revision(current, new)


_ANSWERS = "SELECT concat('q', o_orderkey) AS question, concat('a', o_custkey) AS answer FROM orders"


@query(f"SELECT substr(sha256(concat_ws(chr(31), question, answer)), 1, 24) AS answer_id, CAST(n AS INTEGER) AS ordinal, concat('E', n + 1) AS evidence_id FROM ({_ANSWERS}) t, (SELECT unnest(range(2)) AS n) c", False)
def saved_citations(spark, sf_dir):
    said = table(spark, sf_dir, "orders").select(F.concat(F.lit("q"), "o_orderkey").alias("question"), F.concat(F.lit("a"), "o_custkey").alias("answer"), F.array(F.lit("E1"), F.lit("E2")).alias("citations"), F.lit("high").alias("confidence"))
    return catalog.saved_answers(said)[1]


@query("SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 2 = 0 THEN 10 ELSE 1 END AS INTEGER) AS a, 2 AS b, CASE WHEN c_custkey % 2 = 0 THEN 30 END AS c FROM customer", False)
def overridden_metadata(spark, sf_dir):
    base = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    over = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("a"), F.lit(10), F.lit("c"), F.lit(30))).otherwise(F.create_map().cast("map<string,int>"))
    m = catalog.overridden(base, over)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *[F.try_element_at(m, F.lit(k)).alias(k) for k in "abc"])


_CHANGES = "CASE o_orderkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'deleted' END"


def _changes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    change = F.when(k % 3 == 0, "added").when(k % 3 == 1, "modified").otherwise("deleted")
    return orders.where(k % 2 == 0).select(k.alias("path"), change.alias("change")), orders.select(k.alias("path"), F.when(k % 5 == 0, "build").otherwise("code").alias("kind"))


@query("SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 5 = 0 OR (o_orderkey % 2 = 0 AND o_orderkey % 3 <> 2)", False)
def incremental_load_set(spark, sf_dir):
    return catalog.load_set(*_changes(spark, sf_dir)).select("path")


@query(f"SELECT o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'deleted' ELSE {_CHANGES} END AS change FROM orders WHERE o_orderkey % 2 = 0 AND NOT (o_orderkey % 7 = 0 AND o_orderkey % 3 = 0)", False)
def normalised_changes(spark, sf_dir):
    changes, artifacts = _changes(spark, sf_dir)
    return catalog.normalize_changes(changes, artifacts.where("path % 7 <> 0"))


@query("""WITH parent AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS parent FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT o_custkey AS repository_id, o_orderkey AS revision_id, outcome, CASE WHEN outcome = 'created' THEN concat('scan:', o_custkey, ':', o_orderkey) WHEN outcome <> 'unknown-repository' THEN concat('j', o_orderkey) END AS job_id,
        CASE WHEN outcome = 'created' THEN parent END AS parent, CASE WHEN outcome = 'created' THEN concat('scan.requested:scan:', o_custkey, ':', o_orderkey, ':0') END AS event_key
    FROM (SELECT *, CASE WHEN o_custkey % 11 = 0 THEN 'unknown-repository' WHEN o_orderkey % 3 <> 0 THEN 'created' WHEN o_orderkey % 2 = 0 THEN 'permanently-failed' ELSE 'existing' END AS outcome FROM orders) t LEFT JOIN parent USING (o_custkey)""", False)
def submitted_scans(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("revision_id"), "o_orderstatus", "o_orderdate")
    repositories = orders.where("repository_id % 11 <> 0").select("repository_id").distinct()
    done = orders.select("repository_id", "revision_id", F.when(F.col("o_orderstatus") == "F", "active").otherwise("staged").alias("state"), F.col("o_orderdate").alias("activated_at"))
    jobs = orders.where("revision_id % 3 = 0").select("repository_id", "revision_id", F.concat(F.lit("j"), "revision_id").alias("job_id"), F.when(F.col("revision_id") % 2 == 0, "failed").otherwise("running").alias("state"), F.lit(False).alias("recoverable"))
    return catalog.submit_scans(orders.union(orders), repositories, done, jobs)


@query("""SELECT o_orderkey AS job_id, ok AS accepted, CASE WHEN ok THEN 'parse' END AS stage, CAST(1 + CASE WHEN ok THEN 1 ELSE 0 END AS INTEGER) AS attempt, CASE WHEN ok THEN concat('scan.requested:', o_orderkey, ':2') END AS event_key
    FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AS ok FROM orders) t""", False)
def retried_scans(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    jobs = orders.select(k.alias("job_id"), F.when(k % 2 == 0, "failed").otherwise("running").alias("state"), (k % 3 == 0).alias("recoverable"), F.lit("parse").alias("recoverable_stage"), F.lit("t").alias("target"), F.lit(1).alias("attempt"))
    return catalog.retry_scans(jobs, orders.select(k.alias("job_id"), F.when(k % 5 == 0, "other").otherwise("t").alias("target")))


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 0 THEN 'running' ELSE 'queued' END AS state, CASE WHEN o_orderkey % 4 = 0 THEN 'parse' END AS stage, o_orderkey % 4 = 0 AS applied FROM orders", False)
def job_transitions(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    jobs = orders.select(k.alias("job_id"), F.lit("queued").alias("state"), none.alias("stage"))
    updates = orders.where(k % 2 == 0).select(k.alias("job_id"), F.when(k % 4 == 0, "queued").otherwise("running").alias("from_state"), none.alias("from_stage"), F.lit("running").alias("to_state"), F.lit("parse").alias("to_stage"))
    return catalog.transition(jobs, updates)


#: One line for each stage of a job.
_STAGED = "SELECT l_orderkey AS job, l_linenumber AS n, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2"


def _staged(spark, sf_dir) -> DataFrame:
    least = [F.min(c).alias(n) for c, n in (("l_partkey", "part"), ("l_suppkey", "supp"), ("l_returnflag", "flag"))]
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("n")).agg(*least)


@query(f"""SELECT job, max_by(part, n) AS last_part, string_agg(DISTINCT flag, ',' ORDER BY flag) AS reasons, string_agg(concat('d', supp), ',' ORDER BY n) AS diagnostics, CAST(sum(n) AS BIGINT) AS milliseconds FROM ({_STAGED}) t GROUP BY 1""", False)
def merged_stages(spark, sf_dir):
    lines = _staged(spark, sf_dir).select("job", F.col("n").alias("ordinal"), F.create_map(F.lit("part"), "part").alias("counts"), F.array("flag").alias("reasons"), F.array(F.concat(F.lit("d"), "supp")).alias("diagnostics"), F.col("n").alias("milliseconds"))
    return catalog.merge_stages(lines).select("job", F.col("counts")["part"].alias("last_part"), F.array_join("reasons", ",").alias("reasons"), F.array_join("diagnostics", ",").alias("diagnostics"), "milliseconds")


@query("SELECT c_custkey AS repository_id, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 1 END ELSE 2 END AS revision_id, CASE WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'ready' END AS state, c_custkey % 3 = 0 AS recoverable FROM customer", False)
def analysis_states(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repository_id"))
    return catalog.analysis_status(c.where("repository_id % 2 = 0").withColumn("revision_id", F.lit(1)), c.select("repository_id", F.lit(2).alias("revision_id"), (F.col("repository_id") % 3 != 0).alias("ok")))


@query("SELECT event_id AS task_id, CASE WHEN event_type = 'click' THEN 'failed' ELSE 'done' END AS state, CASE WHEN event_type = 'click' THEN 'abandoned' END AS error FROM events", False)
def restarted_tasks(spark, sf_dir):
    return catalog.restart_tasks(table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("state"), F.lit(None).cast("string").alias("error")))


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 <> 0 THEN 'claimed' WHEN event_id % 2 = 0 THEN 'published' WHEN event_id % 5 = 4 THEN 'dead' ELSE 'pending' END AS state,
    event_id % 5 + CASE WHEN event_id % 3 = 0 AND event_id % 2 = 1 THEN 1 ELSE 0 END AS attempts FROM events""", False)
def settled_outbox(spark, sf_dir):
    k = F.col("event_id")
    events = table(spark, sf_dir, "events")
    outbox = events.select(k.alias("id"), F.lit("me").alias("claimed_by"), (k % 5).alias("attempts"))
    outcomes = events.select(k.alias("id"), F.when(k % 3 == 0, "me").otherwise("other").alias("owner"), (k % 2 == 0).alias("ok"))
    return streaming.settle(outbox, outcomes, F.lit("2024-06-01").cast("timestamp")).select("id", "state", "attempts")


@query("SELECT event_id AS id, event_id % 3 = 0 AND event_id % 2 = 0 AS renewed, CASE WHEN event_id % 3 <> 0 THEN 'other' END AS owner_after FROM events", False)
def renewed_leases(spark, sf_dir):
    k = F.col("event_id")
    at = lambda text: F.lit(text).cast("timestamp")
    held = table(spark, sf_dir, "events").select(k.alias("id"), F.when(k % 3 == 0, "me").otherwise("other").alias("lease_owner"), F.when(k % 2 == 0, at("2024-07-01")).otherwise(at("2024-05-01")).alias("lease_expires_at"))
    renewed = streaming.renew(held, at("2024-06-01"), "me")
    return renewed.select("id", "renewed").join(streaming.release(held, "me").select("id", F.col("lease_owner").alias("owner_after")), "id")


# Impact

_REVISIONS = """base_rel AS (SELECT * FROM relationships WHERE NOT (kind = 'TESTS' AND source_key LIKE '%7')),
    target_rel AS (SELECT id, kind, source_key, target_key, CASE WHEN target_key LIKE '%3' THEN confidence / 2 ELSE confidence END AS confidence FROM relationships WHERE NOT (kind = 'HANDLES' AND target_key LIKE '%89')),
    edge_diff AS (SELECT coalesce(b.kind, t.kind) AS kind, coalesce(b.source_key, t.source_key) AS source_key, coalesce(b.target_key, t.target_key) AS target_key, CASE WHEN b.kind IS NULL THEN 'added' WHEN t.kind IS NULL THEN 'removed' ELSE 'modified' END AS change
        FROM (SELECT kind, source_key, target_key, max(confidence) AS c FROM base_rel GROUP BY ALL) b FULL OUTER JOIN (SELECT kind, source_key, target_key, max(confidence) AS c FROM target_rel GROUP BY ALL) t
        ON b.kind = t.kind AND b.source_key = t.source_key AND b.target_key = t.target_key WHERE b.kind IS NULL OR t.kind IS NULL OR b.c IS DISTINCT FROM t.c)"""
_ROOTS = f"""{_REVISIONS}, changed AS ({_DIFF}), gone AS (SELECT stable_key FROM changed WHERE change = 'removed'),
    live AS (SELECT * FROM edge_diff WHERE change <> 'removed' OR (source_key NOT IN (SELECT * FROM gone) AND target_key NOT IN (SELECT * FROM gone))),
    roots AS (SELECT stable_key, change FROM changed UNION ALL SELECT k, min(change) FROM (SELECT source_key AS k, change FROM live UNION ALL SELECT target_key, change FROM live) e WHERE k NOT IN (SELECT stable_key FROM changed) GROUP BY k)"""


@query(f", {_ROOTS} SELECT stable_key, change FROM roots")
def impact_roots(spark, sf_dir):
    edges = diff.relationship_diff(*_relationship_revisions(facts(spark, sf_dir)[1]))
    return impact.changed_roots(kept(diff.entity_diff(*revisions(spark, sf_dir))), edges)


def _levels_sql(name: str, edges: str, roots: str, depth: int = 2, fan_out: int = 25, least: float = 0.2) -> str:
    rule = lambda i: "CASE kind " + " ".join(f"WHEN '{k}' THEN CAST({v[i]} AS DOUBLE)" for k, v in impact.RULES.items()) + " END"
    levels = ", ".join(f"{name}{d} AS (SELECT neighbour AS stable_key, max(confidence * weight) AS confidence FROM {name}{d - 1} JOIN {name}_steps ON stable_key = node GROUP BY neighbour HAVING max(confidence * weight) >= {least})" for d in range(1, depth + 1))
    all_ = " UNION ALL ".join(f"SELECT stable_key, confidence, {d} AS depth FROM {name}{d}" for d in range(depth + 1))
    return f"""{name}_both AS (SELECT id, source_key AS node, target_key AS neighbour, {rule(1)} * coalesce(confidence, 1) AS weight FROM {edges} UNION ALL SELECT id, target_key, source_key, {rule(0)} * coalesce(confidence, 1) FROM {edges}),
    {name}_steps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, id) AS n FROM {name}_both) t WHERE n <= {fan_out}),
    {name}0 AS (SELECT stable_key, CAST(1 AS DOUBLE) AS confidence FROM ({roots}) r), {levels},
    {name} AS (SELECT stable_key, max(confidence) AS confidence, min(depth) AS depth FROM ({all_}) a GROUP BY stable_key)"""


@query(f""", {_ROOTS}, {_levels_sql('t', 'target_rel', 'SELECT stable_key FROM roots WHERE stable_key IN (SELECT stable_key FROM target_entities)')}, {_levels_sql('b', 'base_rel', "SELECT stable_key FROM roots WHERE change = 'removed'")},
    kept AS (SELECT * FROM t WHERE stable_key IN (SELECT stable_key FROM target_entities)),
    merged AS (SELECT coalesce(kept.stable_key, b.stable_key) AS stable_key, CASE WHEN kept.confidence IS NULL OR b.confidence > kept.confidence THEN b.confidence ELSE kept.confidence END AS confidence, CASE WHEN kept.confidence IS NULL OR b.confidence > kept.confidence THEN 'base' ELSE 'target' END AS revision FROM kept FULL OUTER JOIN b ON kept.stable_key = b.stable_key)
    SELECT m.stable_key, round(confidence, 9) AS confidence, revision, change, coalesce(te.kind, be.kind) AS kind FROM merged m LEFT JOIN roots USING (stable_key) LEFT JOIN target_entities te USING (stable_key) LEFT JOIN base_entities be USING (stable_key) WHERE te.kind IS NOT NULL OR be.kind IS NOT NULL""")
def affected_by_change(spark, sf_dir):
    (base, target), relationships = revisions(spark, sf_dir), facts(spark, sf_dir)[1]
    base_edges, target_edges = _relationship_revisions(relationships)
    roots = impact.changed_roots(kept(diff.entity_diff(base, target)), diff.relationship_diff(base_edges, target_edges))
    out = impact.affected_by_change(roots, base_edges, target_edges, target, base, max_nodes=None, max_depth=2)
    return out.select("stable_key", F.round("confidence", 9).alias("confidence"), "revision", "change", "kind")


@query()
def evidence_paths(spark, sf_dir):
    changed = diff.entity_diff(*revisions(spark, sf_dir))
    found = impact.evidence_paths(facts(spark, sf_dir)[1], changed, max_depth=3)
    return found.select("stable_key", "confidence", "depth", F.array_join(F.transform("path", lambda s: s["id"]), " ").alias("path"))


@query()
def analyze(spark, sf_dir):
    relationships = facts(spark, sf_dir)[1]
    return impact.analyze(*revisions(spark, sf_dir), *_relationship_revisions(relationships), max_depth=2)


# Extraction


def _sources(spark, sf_dir) -> DataFrame:
    """A class for each part: it extends that of its size and calls a method of the next part's."""
    k, text = F.col("p_partkey"), lambda s: F.lit(s)
    content = F.concat(text("class P"), k, text(" extends P"), "p_size", text(" {\n  public void run"), k, text("() {\n    run"), k + 1, text("();\n  }\n}"))
    return table(spark, sf_dir, "part").select(F.concat(text("src/P"), k, text(".java")).alias("path"), text("java").alias("language"), content.alias("content"))


@query("""SELECT 'class' AS kind, concat('P', p_partkey) AS name, concat('src/P', p_partkey, '.java') AS path, 1 AS start_line, 5 AS end_line FROM part
    UNION ALL SELECT 'method', concat('run', p_partkey), concat('src/P', p_partkey, '.java'), 2, 4 FROM part""", False)
def extracted_entities(spark, sf_dir):
    return extraction.extract(_sources(spark, sf_dir), "shop").entities.select("kind", "name", "path", "start_line", "end_line")


@query("""SELECT 'CALLS' AS kind, concat('run', p_partkey) AS source, concat('run', p_partkey + 1) AS target FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'EXTENDS', concat('P', p_partkey), concat('P', p_size) FROM part WHERE p_size <> p_partkey AND p_size IN (SELECT p_partkey FROM part)""", False)
def extracted_relationships(spark, sf_dir):
    e = extraction.extract(_sources(spark, sf_dir), "shop")
    name = lambda side: e.entities.select(F.col("stable_key").alias(f"{side}_key"), F.col("name").alias(side))
    return e.relationships.join(name("source"), "source_key").join(name("target"), "target_key").select("kind", "source", "target")


@query("""SELECT 'CALLS' AS kind, concat('src/P', p_partkey, '.java') AS path, 3 AS line, concat('run', p_partkey + 1) AS target, CAST(0 AS BIGINT) AS candidates FROM part WHERE p_partkey + 1 NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'EXTENDS', concat('src/P', p_partkey, '.java'), 1, concat('P', p_size), 0 FROM part WHERE p_size NOT IN (SELECT p_partkey FROM part)""", False)
def unresolved_references(spark, sf_dir):
    return extraction.extract(_sources(spark, sf_dir), "shop").unresolved


@query("SELECT concat('src/P', p_partkey, '.java') AS path FROM part WHERE p_partkey % 10 = 0 OR ((p_partkey + 1) % 10 = 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part)) OR (p_size % 10 = 0 AND p_size IN (SELECT p_partkey FROM part))", False)
def incremental_extraction(spark, sf_dir):
    artifacts = _sources(spark, sf_dir)
    e = extraction.extract(artifacts, "shop")
    changes = artifacts.where(F.col("path").rlike("0\\.java$")).select("path")
    return extraction.incremental(artifacts, changes, e.relationships, e.entities).select("path")


# Documents


def _claims(spark, sf_dir) -> tuple[DataFrame, ...]:
    """A page for each part with a claim of every kind, and the facts that some of them rest on."""
    k, text = F.col("p_partkey"), lambda s: F.lit(s)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    content = F.concat(text("# Part "), k, text("\n`Thing"), k, text("` stands\nservice Maybe"), k, text("\n`size.p"), k, text("` = `"), "p_size", text("`\nnpm run b"), k, text("\n[x](src/F"), k, text(".java)\nGET /p/"), k, text("\n"))
    pages = part.select(F.concat(text("d/"), k, text(".md")).alias("path"), content.alias("content"))
    endpoints = part.where(k % 8 != 0).select(text("get").alias("method"), F.concat(text("/p/"), k).alias("path"))
    name = lambda letters: F.concat(text(letters), k)
    names = part.where(k % 2 == 0).select(name("Thing").alias("name"), F.concat(text("a.b.Thing"), k).alias("qualified_name")).union(part.where(k % 3 == 0).select(text("x"), F.concat(text("a.b.Maybe"), k)))
    keyed = part.where(k % 5 != 0).select(F.concat(text("size.p"), k).alias("key"), F.when(k % 4 == 0, "zz").otherwise(F.col("p_size").cast("string")).alias("value"), F.lit(0).alias("ordinal"))
    keyed = keyed.union(keyed.select("key", text("aa"), F.lit(1)))  # a later definition counts for nothing
    commands = part.where(k % 6 != 0).select(F.concat(text("npm  run b"), k).alias("command"))
    paths = part.where(k % 7 != 0).select(F.concat(text("src/F"), k, text(".java")).alias("path"))
    return pages, endpoints, names, keyed, commands, paths


_P = "concat('d/', p_partkey, '.md') AS path"


@query(f"""SELECT {_P}, 7 AS line, 'GET' AS subject, concat('/p/', p_partkey) AS value, 'stale_endpoint' AS finding, 'high' AS severity, 'confirmed' AS status, NULL AS suggestion FROM part WHERE p_partkey % 8 = 0
    UNION ALL SELECT {_P}, 3, concat('Maybe', p_partkey), NULL, 'ambiguous_claim', 'informational', 'review', NULL FROM part WHERE p_partkey % 3 <> 0
    UNION ALL SELECT {_P}, 2, concat('Thing', p_partkey), NULL, 'removed_entity', 'low', 'confirmed', NULL FROM part WHERE p_partkey % 2 <> 0
    UNION ALL SELECT {_P}, 4, concat('size.p', p_partkey), CAST(p_size AS VARCHAR), 'stale_configuration', 'high', 'confirmed', CASE WHEN p_partkey % 5 <> 0 THEN 'zz' END FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 4 = 0
    UNION ALL SELECT {_P}, 5, concat('npm run b', p_partkey), NULL, 'stale_command', 'medium', 'confirmed', NULL FROM part WHERE p_partkey % 6 = 0
    UNION ALL SELECT {_P}, 6, concat('src/F', p_partkey, '.java'), NULL, 'stale_source_link', 'low', 'confirmed', NULL FROM part WHERE p_partkey % 7 = 0""", False)
def claim_findings(spark, sf_dir):
    pages, *known = _claims(spark, sf_dir)
    return documentation.compare_claims(documentation.extract_claims(documentation.parse_markdown(pages)), *known)


@query(f"SELECT {_P}, concat('Part ', p_partkey) AS title FROM part", False)
def page_titles(spark, sf_dir):
    pages = _claims(spark, sf_dir)[0]
    return documentation.page_titles(documentation.parse_markdown(pages), pages)


@query(f"SELECT {_P} FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0", False)
def reusable_pages(spark, sf_dir):
    k = F.regexp_extract("path", "[0-9]+", 0).cast("long")
    pages = _claims(spark, sf_dir)[0].select("path", F.sha2("content", 256).alias("content_hash"))
    previous = pages.withColumn("content_hash", F.when(k % 2 == 0, F.col("content_hash")).otherwise("other"))
    return documentation.reusable_pages(previous, pages, pages.where(k % 3 == 0)).select("path")


@query("SELECT concat('s', o_orderkey) AS source_id FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0", False)
def removed_sources(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    changes = orders.where(k % 3 == 0).select(F.lit("deleted").alias("change"), k.cast("string").alias("path"), F.lit(None).cast("string").alias("previous_path"))
    changes = changes.union(orders.where(k % 5 == 0).select(F.lit("renamed"), F.concat(F.lit("new"), k), k.cast("string")))
    return chunks.removed_sources(orders.select(F.concat(F.lit("s"), k).alias("source_id"), k.cast("string").alias("path")), changes)


@query("SELECT concat('code:', p_partkey) AS source_id FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0", False)
def code_sources(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    artifacts = part.select(k.cast("string").alias("path"), F.when(k % 2 == 0, "code").otherwise("test").alias("kind"), F.col("p_name").alias("content"))
    entities = part.select(k.cast("string").alias("path"), F.lit("class").alias("kind"), F.when(k % 3 == 0, "private").alias("visibility"))
    return chunks.code_sources(artifacts, entities).select("source_id")


@query("SELECT 'degraded' AS state, count(*) AS sources, count(*) FILTER (vec_id % 3 <> 0) AS embedded FROM embeddings", False)
def projection_status(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return chunks.projection_status(e, e.where("id % 3 <> 0"), True)


# Functions and folds whose first queries have no SQL


@query(f"""WITH d AS (SELECT job, coalesce(list(n) FILTER (part % 50 <> 0), []) AS done, max_by(part % 50 = 0, n) AS failed FROM ({_STAGED}) t GROUP BY 1),
    j AS (SELECT job, failed, coalesce(list_min(list_filter(range(1, 8), lambda i: NOT list_contains(done, i))) - 1, 7) AS n FROM d)
    SELECT job, ['snapshot', 'parse', 'activate', 'embed', 'document', 'impact', 'complete'][CAST(least(n, 6) + 1 AS INTEGER)] AS stage, CASE WHEN n = 7 THEN 'completed' WHEN failed THEN 'failed' ELSE 'running' END AS state, CAST(n AS INTEGER) AS completed FROM j""", False)
def job_stages(spark, sf_dir):
    stage = F.get(F.array(*map(F.lit, streaming.STAGES)), (F.col("n") - 1).cast("int"))
    outcome = F.when(F.col("part") % 50 == 0, "failed").otherwise("done")
    return streaming.job_state(_staged(spark, sf_dir).select("job", stage.alias("stage"), outcome.alias("outcome"), F.col("n").alias("at")))


@query(""", e AS (SELECT DISTINCT source_key, kind, target_key FROM relationships ORDER BY source_key, kind, target_key LIMIT 30), n AS (SELECT DISTINCT unnest([source_key, target_key]) AS k FROM e), i AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM n)
    SELECT concat('flowchart LR', chr(10), (SELECT string_agg(concat('  E', n, '["', k, '"]'), chr(10) ORDER BY n) FROM i), chr(10), (SELECT string_agg(concat('  E', s.n, ' -->|', e.kind, '| E', t.n), chr(10) ORDER BY e.source_key, e.kind, e.target_key) FROM e JOIN i s ON e.source_key = s.k JOIN i t ON e.target_key = t.k)) AS diagram""")
def relationship_diagram(spark, sf_dir):
    return QUERIES["mermaid_diagram"](spark, sf_dir)


@query("SELECT n_name AS name, concat(chr(65), chr(769), n_name) <> concat(chr(193), n_name) AS differ, concat(chr(193), n_name) AS normal FROM nation", False)
def normalised_names(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("Á"), "n_name").alias("normal"))
    given = rows.withColumn("given", F.col("normal"))
    return X.normalised(given, "normal").select("name", (F.col("given") != F.col("normal")).alias("differ"), "normal")


# Every branch of scanners and scores


@query("""SELECT concat('n', p_partkey, '.ts') AS path, 3 AS line, 'nest' AS framework, 'GET' AS method, concat('/c', p_partkey, '/{id}') AS route FROM part
    UNION ALL SELECT concat('e', p_partkey, '.ts'), 2, 'express', 'GET', concat('/api/u', p_partkey, '/{id}') FROM part
    UNION ALL SELECT concat('v', p_partkey, '.java'), 1, 'vertx', 'POST', concat('/n', p_partkey) FROM part
    UNION ALL SELECT concat('o', p_partkey, '.kt'), 3, 'ktor', 'GET', concat('/api/k', p_partkey, '/{id}') FROM part""", False)
def other_framework_endpoints(spark, sf_dir):
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    file = lambda letter, end, language, *text: part.select(F.concat(F.lit(letter), k, F.lit(end)).alias("path"), F.lit(language).alias("language"), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("content"))
    artifacts = file("n", ".ts", "typescript", '@Controller("c', k, '")\nexport class C {\n@Get(":id")\nfind() {}\n}')
    artifacts = artifacts.union(file("e", ".ts", "typescript", 'app.use("/api", router);\nrouter.get("/u', k, '/:id", show);'))
    artifacts = artifacts.union(file("v", ".java", "java", 'router.post("/n', k, '").handler(a);'))
    artifacts = artifacts.union(file("o", ".kt", "kotlin", 'routing {\n  route("/api") {\n    get("/k', k, '/{id}") {\n    }\n  }\n}'))
    return scanners.endpoints(artifacts)


@query("""WITH t AS (SELECT concat('t', p_partkey) AS stable_key, p_partkey % 5 AS m, CASE WHEN p_partkey % 2 = 0 THEN CAST(0.97 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS c FROM part WHERE NOT (p_partkey % 5 = 3 AND p_partkey % 2 = 0)),
    s AS (SELECT stable_key, CASE m WHEN 0 THEN least(CAST(0.98 AS DOUBLE), c) WHEN 1 THEN least(CAST(0.9 AS DOUBLE), c) WHEN 2 THEN least(CAST(0.78 AS DOUBLE), c) WHEN 3 THEN CAST(0.55 AS DOUBLE) ELSE c END AS score FROM t)
    SELECT *, CASE WHEN score >= 0.95 THEN 'confirmed' WHEN score >= 0.5 THEN 'inferred' ELSE 'tentative' END AS level FROM s""", False)
def test_scores(spark, sf_dir):
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    kinds = [F.array(*map(F.lit, x)) for x in (["TESTS"], ["TESTS", "HANDLES"], ["CALLS", "DOCUMENTS"], ["DEPENDS_ON"], ["DEPENDS_ON"])]
    name = F.concat(F.lit("part"), k, F.lit("q"))
    tests = part.select(F.concat(F.lit("t"), k).alias("stable_key"), name.alias("test_name"), F.get(F.array(*kinds), (k % 5).cast("int")).alias("path_kinds"))
    found = part.where(k % 5 != 3).select(F.concat(F.lit("t"), k).alias("stable_key"), F.when(k % 2 == 0, 0.97).otherwise(0.4).alias("confidence"))
    return impact.recommend_tests(tests, found, part.where((k % 5 == 3) & (k % 2 == 1)).select(name.alias("name")))


@query("""SELECT * FROM (VALUES (1, 'authentication-or-authorization', 25), (2, 'public-api', 20), (3, 'configuration', 12), (4, 'persistence', 15), (5, 'downstream-impact', 15), (6, 'missing-tests', 15), (7, 'documentation-gap', 5), (8, 'unresolved-relationships', 4), (9, 'change-size', 15)) f(ordinal, factor, weight)""", False)
def all_risk_factors(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    changed = nation.select(F.when(F.col("n_nationkey") % 2 == 0, "endpoint").otherwise("configuration_key").alias("kind"), F.concat("n_name", F.lit(" token sql")).alias("text"))
    found = table(spark, sf_dir, "orders").select(F.lit(False).alias("is_root"), F.lit(0.5).alias("confidence"))
    return impact.score_risk(changed, found, changed_files=3, documentation_gaps=1, unresolved=2, changed_relationships=2)


@query("SELECT stable_key, artifact, first_seen, revision FROM (SELECT concat('e', o_orderkey) AS stable_key, 'new' AS artifact, CASE WHEN o_orderkey % 8 = 0 THEN 'r2' ELSE 'r1' END AS first_seen, 'r2' AS revision FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT concat('e', o_orderkey), 'old', 'r1', 'r2' FROM orders WHERE o_orderkey % 4 <> 0) t", False)
def closed_activation(spark, sf_dir):
    """An activation whose relationships all have their ends."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("e"), "o_orderkey").alias("stable_key"), F.col("o_orderkey").alias("r"))
    previous = orders.where("r % 8 <> 0").select("stable_key", F.lit("old").alias("artifact"), F.lit("r1").alias("first_seen"))
    staged = orders.where("r % 4 = 0").select("stable_key", F.lit("new").alias("artifact"))
    edges = staged.select(F.col("stable_key").alias("source_key")).withColumn("target_key", F.col("source_key")).union(previous.select("stable_key", "stable_key"))
    return relational.activate(previous, staged, spark.createDataFrame([("gone",)], "artifact string"), edges, "r2")


# Questions from text to answer, sources of documents, repeated keys


def _asked_sql() -> str:
    """Three levels of the walk, written out: a recursive query can't count what a question holds already."""
    kinds = "['CONTAINS', 'DECLARES', 'DEPENDS_ON', 'HANDLES']"
    out = f""", q AS (SELECT c_custkey AS question, CASE c_custkey % 4 WHEN 0 THEN 'module_explanation' WHEN 1 THEN 'endpoint_flow' WHEN 2 THEN 'entity_lookup' ELSE 'callers' END AS intent,
        CASE WHEN c_custkey % 4 = 3 THEN concat('zz', c_custkey) ELSE c_name END AS term, CASE c_custkey % 4 WHEN 0 THEN {kinds} ELSE ['HANDLES', 'CALLS', 'USES_MIDDLEWARE', 'READS_CONFIG'] END AS kinds, CASE WHEN c_custkey % 4 = 2 THEN 0 ELSE 3 END AS most FROM customer),
    rooted AS (SELECT question, stable_key, row_number() OVER (PARTITION BY question ORDER BY name, stable_key) AS n FROM q JOIN entities ON contains(lower(name), lower(term)) OR contains(coalesce(lower(attributes), ''), lower(term))),
    edg AS (SELECT kind, source_key AS a, target_key AS b FROM relationships UNION ALL SELECT kind, target_key, source_key FROM relationships),
    v0 AS (SELECT question, stable_key, 0 AS depth, false AS packed FROM rooted WHERE n <= 5)"""
    for d in range(1, 4):
        out += f""",
    f{d} AS (SELECT DISTINCT v.question, e.b AS stable_key FROM v{d - 1} v JOIN q USING (question) JOIN edg e ON e.a = v.stable_key SEMI JOIN entities x ON e.b = x.stable_key WHERE v.depth = {d - 1} AND q.most >= {d} AND list_contains(q.kinds, e.kind) AND v.question NOT IN (SELECT question FROM v{d - 1} WHERE packed)),
    n{d} AS (SELECT f.question, f.stable_key, {d} AS depth, row_number() OVER (PARTITION BY f.question ORDER BY f.stable_key) + h.c > 80 AS packed FROM (SELECT * FROM f{d} ANTI JOIN v{d - 1} USING (question, stable_key)) f JOIN (SELECT question, count(*) AS c FROM v{d - 1} GROUP BY 1) h USING (question)),
    v{d} AS (SELECT * FROM v{d - 1} UNION ALL SELECT * FROM n{d})"""
    return (
        out
        + """,
    c AS (SELECT question, kind, source, row_number() OVER (PARTITION BY question ORDER BY turn, path, line, source) AS n FROM (
        SELECT question, 0 AS turn, 'structural' AS kind, concat('src/', o_custkey) AS path, o_orderkey % 100 AS line, stable_key AS source FROM v3 JOIN orders ON stable_key = concat('endpoint:', o_orderkey) WHERE NOT packed AND o_orderkey % 4 <> 0
        UNION ALL SELECT c_custkey, 1, 'semantic', '', 0, concat('chunk', c_custkey) FROM customer WHERE c_custkey % 5 <> 0) t),
    l AS (SELECT question, stable_key, row_number() OVER (PARTITION BY question ORDER BY depth, stable_key) AS place FROM v3 WHERE NOT packed),
    s AS (SELECT question, source, min(n) AS n FROM c WHERE kind = 'structural' GROUP BY ALL),
    w AS (SELECT l.question, string_agg(concat('- ', e.kind, ' ', e.name, CASE WHEN s.n IS NULL THEN '' ELSE concat(' [E', s.n, ']') END), chr(10) ORDER BY place) AS lines FROM l JOIN entities e USING (stable_key) LEFT JOIN s ON s.question = l.question AND s.source = l.stable_key WHERE place <= 12 GROUP BY 1),
    i AS (SELECT question, string_agg(concat('E', n), ',' ORDER BY n) FILTER (kind = 'structural') AS st, string_agg(concat('E', n), ',' ORDER BY n) FILTER (kind = 'semantic') AS se FROM c GROUP BY 1)
    SELECT q.question, intent, CASE WHEN lines IS NOT NULL THEN concat('Confirmed structural evidence:', chr(10), lines) WHEN se IS NOT NULL THEN concat('Semantic evidence was found, but natural-language synthesis is unavailable. Review [', replace(se, ',', '], ['), '].')
            ELSE 'No supported canonical or semantic evidence matched this question.' END AS answer,
        coalesce(CASE WHEN lines IS NOT NULL THEN st ELSE se END, '') AS citations, CASE WHEN lines IS NOT NULL AND st IS NOT NULL THEN 'high' WHEN lines IS NULL AND se IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence,
        q.question IN (SELECT question FROM v3 WHERE packed) AS truncated, CASE WHEN lines IS NULL THEN concat('No canonical entity matched ', term) ELSE '' END AS degraded
    FROM q LEFT JOIN w ON w.question = q.question LEFT JOIN i ON i.question = q.question"""
    )


def _questions(spark, sf_dir) -> DataFrame:
    k, quoted = F.col("c_custkey"), F.concat(F.lit('"'), "c_name", F.lit('"'))
    text = F.when(k % 4 == 0, F.concat(F.lit("Explain "), quoted, F.lit(" as a module"))).when(k % 4 == 1, F.concat(F.lit("What happens in "), quoted, F.lit("?"))).when(k % 4 == 2, F.concat(F.lit("Where is "), quoted, F.lit("?")))
    return table(spark, sf_dir, "customer").select(k.alias("question"), text.otherwise(F.concat(F.lit("Who calls 'zz"), k, F.lit("'?"))).alias("text"))


@query("SELECT c_custkey AS question, CASE c_custkey % 4 WHEN 3 THEN 'incoming' ELSE 'both' END AS direction, CASE c_custkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 0 ELSE 3 END AS kinds, CASE WHEN c_custkey % 4 = 2 THEN 0 ELSE 3 END AS max_depth, 80 AS max_nodes FROM customer", False)
def question_policies(spark, sf_dir):
    asked = _questions(spark, sf_dir).select("question", X.question_intent(F.col("text")).alias("intent"))
    return asked.join(F.broadcast(answering.policies(spark)), "intent").select("question", "direction", F.size("kinds").alias("kinds"), "max_depth", "max_nodes")


@query(_asked_sql())
def answered_questions(spark, sf_dir):
    k, customers, orders = F.col("c_custkey"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    places = orders.where("o_orderkey % 4 <> 0").select(F.concat(F.lit("endpoint:"), "o_orderkey").alias("stable_key"), F.concat(F.lit("src/"), "o_custkey").alias("path"), (F.col("o_orderkey") % 100).cast("int").alias("start_line"))
    semantic = customers.where(k % 5 != 0).select(k.alias("question"), F.concat(F.lit("chunk"), k).alias("id"), F.lit(0.5).alias("similarity"))
    out = asking.ask(_questions(spark, sf_dir), *facts(spark, sf_dir), places, semantic)
    return out.withColumns({c: F.array_join(c, ",") for c in ("citations", "degraded")})


@query(r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(replace(text, '. ', concat('.', chr(10), '## ')), chr(10)) AS x FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, r, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM d), h AS (SELECT *, regexp_matches(line, '^#{1,6}\s+\S') AS head FROM l),
    s AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY r ORDER BY n) AS i, bool_or(head) OVER (PARTITION BY r) AS headed, bool_or(regexp_matches(line, '\S')) OVER (PARTITION BY r) AS ink FROM h)
    SELECT concat('d', doc_id, '.md#section-', CASE WHEN headed THEN i ELSE 1 END) AS source_id, CAST(min(n) AS INTEGER) AS start_line, CAST(max(n) AS INTEGER) AS end_line, md5(string_agg(line, chr(10) ORDER BY n)) AS digest
    FROM s WHERE i > 0 OR (NOT headed AND ink) GROUP BY doc_id, r, i, headed""", False)
def document_sources(spark, sf_dir):
    content = F.replace("text", F.lit(". "), F.lit(".\n## "))
    pages = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("path"), F.lit("documentation").alias("kind"), content.alias("content"))
    return chunks.document_sources(pages).select("source_id", "start_line", "end_line", F.md5("content").alias("digest"))


@query("""SELECT concat('p', p_partkey, '.properties') AS path, 3 AS line, 'CONFIGURATION_DUPLICATE_KEY' AS code, 'warning' AS severity, concat('Duplicate configuration key a.', p_size, ' was ignored') AS message FROM part
    UNION ALL SELECT concat('p', p_partkey, '.yaml'), 4, 'CONFIGURATION_DUPLICATE_KEY', 'warning', 'Duplicate configuration key db.size was ignored' FROM part WHERE p_partkey % 2 = 0""", False)
def configuration_diagnostics(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    key = F.concat(F.lit("a."), "p_size")
    flat = part.select(F.concat(F.lit("p"), k, F.lit(".properties")).alias("path"), F.concat(key, F.lit("=1\n# a note\n"), key, F.lit(": 2\nother=3")).alias("content"))
    nested = part.select(F.concat(F.lit("p"), k, F.lit(".yaml")).alias("path"), F.concat(F.lit("db:\n  size: "), k, F.lit("\n  name: x\n  "), F.when(k % 2 == 0, "size").otherwise("length"), F.lit(": 5\n")).alias("content"))
    return manifests.configuration_diagnostics(flat.union(nested))
