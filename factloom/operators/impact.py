"""Weighted change impact, test recommendation, risk and the change summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import diff
from factloom.plans import kept, kept_by, top_per_key

#: The weight of walking an edge against and along its direction, by kind.
RULES = {
    "CALLS": (0.85, 0.45),
    "IMPORTS": (0.75, 0.3),
    "CONTAINS": (0.8, 0.8),
    "DECLARES": (0.8, 0.8),
    "HANDLES": (0.95, 0.95),
    "USES_MIDDLEWARE": (0.75, 0.55),
    "READS_CONFIG": (0.9, 0.35),
    "TESTS": (0.95, 0.25),
    "DOCUMENTS": (0.9, 0.2),
    "DEPENDS_ON": (0.7, 0.35),
    "EXTENDS": (0.7, 0.55),
    "IMPLEMENTS": (0.7, 0.55),
}


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in RULES.items()], "kind string, incoming double, outgoing double")


def _ruled(relationships: DataFrame) -> DataFrame:
    """relationships with their rule's weights and their factor: without a confidence, unresolved calls count .35, calls
    and tests found by name .75 and .55."""
    by = F.col("resolution") if "resolution" in relationships.columns else F.lit(None).cast("string")
    factor = F.coalesce("confidence", F.when((F.col("kind") == "CALLS") & (by == "unresolved"), 0.35).when((F.col("kind") == "CALLS") & (by == "name"), 0.75).when((F.col("kind") == "TESTS") & (by == "naming"), 0.55).otherwise(1.0))
    return relationships.join(F.broadcast(rules(relationships.sparkSession)), "kind").withColumn("factor", factor)  # twelve rules


def _steps() -> list[Column]:
    """A relationship's step along its direction and the one against it."""
    step = lambda node, neighbour, weight: F.struct(F.col(node).alias("node"), F.col(neighbour).alias("neighbour"), (F.col(weight) * F.col("factor")).alias("weight"), (F.col("source_key") == F.col(node)).alias("outgoing"))
    return [step("source_key", "target_key", "outgoing"), step("target_key", "source_key", "incoming")]


def weighted_steps(relationships: DataFrame, max_fan_out: int | None) -> DataFrame:
    """node, neighbour, id, kind, weight and outgoing for both directions of every edge; of each node the heaviest max_fan_out."""
    steps = _ruled(relationships).select("id", "kind", F.explode(F.array(*_steps())).alias("s")).select("id", "kind", "s.*")
    return steps if max_fan_out is None else top_per_key(steps, ["node"], [F.desc("weight"), F.col("id")], max_fan_out)


def affected(relationships: DataFrame, roots: DataFrame, *, max_depth: int = 4, max_fan_out: int | None = 25, min_confidence: float = 0.2, max_nodes: int | None = 200) -> DataFrame:
    """stable_key, confidence, depth and is_root of what roots(stable_key) affect.

    Level by level: a level holds the best confidence of every node that paths of its length reach, the product of
    the steps' weights; the result has each node's best over all levels. A node's strongest path is thus found even
    where a longer path would have settled the node first.
    """
    # a node's strongest steps are the same at every level: ranked once, and kept by node, so that no level shuffles them
    steps = kept_by([weighted_steps(relationships, max_fan_out).select("node", "neighbour", "weight")], "node")
    level = kept(roots.select("stable_key").distinct().withColumn("confidence", F.lit(1.0)))
    levels = level.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        taken = steps.join(level.select(F.col("stable_key").alias("node"), F.col("confidence").alias("_so_far")), "node")
        reached = taken.groupBy(F.col("neighbour").alias("stable_key")).agg(F.max(F.col("_so_far") * F.col("weight")).alias("confidence"))
        level = kept(reached.where(F.col("confidence") >= min_confidence))
        levels = levels.union(level.withColumn("depth", F.lit(depth)))
    best = levels.groupBy("stable_key").agg(F.max("confidence").alias("confidence"), F.min("depth").alias("depth"))
    best = best.withColumn("is_root", F.col("depth") == 0)
    return best if max_nodes is None else best.orderBy(F.desc("confidence"), "stable_key").limit(max_nodes)


def best_first(relationships: DataFrame, entities: DataFrame, roots: DataFrame, *, max_depth: int = 4, max_fan_out: int = 25, min_confidence: float = 0.2, max_nodes: int | None = 200) -> tuple[DataFrame, bool]:
    """(stable_key, confidence, depth, path of what roots(stable_key) affect; whether anything was cut off), as a queue
    finds it that always goes on from its strongest candidate, of equal ones from the least key.

    A candidate is taken if it is stronger than the node's so far; the fan-out is cut before that is asked, and a node
    beyond max_nodes isn't let in. A step weighs less than 1, say `top` at most: candidates above top times the strongest
    are a bucket that nothing found from it can join. So a bucket's candidates are expanded at once; what each node is
    offered lies in the queue's order, and a running maximum tells what the queue would have taken. There are as many
    rounds as buckets have candidates, ln(min_confidence) / ln(top) at most.
    """
    weighted = weighted_steps(relationships, None).where("weight > 0")
    known = entities.select("stable_key").distinct()
    crowded = kept(weighted.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > max_fan_out).select("node"))
    first = top_per_key(weighted, ["node"], [F.desc("weight"), F.col("id")], max_fan_out)
    turn = Window.partitionBy("node").orderBy(F.desc("weight"), "id")  # at most max_fan_out rows
    steps = kept_by([first.withColumn("turn", F.row_number().over(turn)).withColumn("direction", F.when(F.col("outgoing"), "outgoing").otherwise("incoming")).drop("outgoing")], "node")
    # most graphs have an entity at every end: then the steps stay as they were written
    strange = kept(steps.select("neighbour").distinct().join(known.withColumnRenamed("stable_key", "neighbour"), "neighbour", "left_anti"))
    if not strange.isEmpty():
        steps = kept_by([steps.join(strange, "neighbour", "left_anti")], "node")
    top = steps.agg(F.max("weight")).first()[0] or 0.5
    if top >= 1:
        raise ValueError("every step must weigh less than 1")
    none = F.array().cast("array<struct<id:string,kind:string,direction:string,from:string,to:string,weight:double>>")
    entries = kept(roots.select("stable_key").distinct().join(entities.select("stable_key").distinct(), "stable_key", "left_semi").select("stable_key", F.lit(1.0).alias("confidence"), none.alias("path")))
    size, least, truncated = entries.count(), float("inf"), False
    while (m := entries.where(F.col("confidence") <= least).agg(F.max("confidence")).first()[0]) is not None:
        bucket = entries.where((F.col("confidence") <= least) & (F.col("confidence") > top * m) & (F.size("path") < max_depth))
        least = top * m
        bucket = bucket.select(F.col("stable_key").alias("node"), F.col("confidence").alias("_from"), F.col("path").alias("_path"))
        truncated = truncated or not bucket.join(crowded, "node", "left_semi").isEmpty()
        step = F.struct("id", "kind", "direction", F.col("node").alias("from"), F.col("neighbour").alias("to"), "weight")
        offered = bucket.join(steps, "node").select(F.col("neighbour").alias("stable_key"), (F.col("_from") * F.col("weight")).alias("confidence"), F.array_append("_path", step).alias("path"), F.struct((-F.col("_from")).alias("a"), F.col("node").alias("b"), F.col("turn").alias("c")).alias("_at"))
        offered = offered.where(F.col("confidence") >= min_confidence)
        best = entries.groupBy("stable_key").agg(F.max("confidence").alias("_best"))
        offered = offered.join(best, "stable_key", "left")
        before = F.max("confidence").over(Window.partitionBy("stable_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
        taken = kept(offered.withColumn("_before", before).where(F.col("confidence") > F.greatest(F.coalesce("_best", F.lit(-1.0)), F.coalesce("_before", F.lit(-1.0)))).drop("_before"))
        fresh = taken.where("_best is null").groupBy("stable_key").agg(F.min("_at").alias("_at"))
        n = fresh.count()
        if max_nodes is not None and size + n > max_nodes:
            truncated = True
            let_in = fresh.orderBy("_at").limit(max(0, max_nodes - size)).select("stable_key").withColumn("_in", F.lit(True))
            taken = kept(taken.join(let_in, "stable_key", "left").where("_best is not null or _in"))
            n = max(0, max_nodes - size)
        size += n
        entries = entries.union(taken.select("stable_key", "confidence", "path"))
    out = entries.groupBy("stable_key").agg(F.max_by("path", "confidence").alias("path"), F.max("confidence").alias("confidence"))
    return out.select("stable_key", "confidence", F.size("path").alias("depth"), "path"), truncated


def recommend_tests(tests: DataFrame, affected_: DataFrame, changed_names: DataFrame) -> DataFrame:
    """stable_key, score and level for tests(stable_key, name, path_kinds array): affected ones, and ones named after
    what changed: a changed name of any length that the normalised test name holds. Of a test name only those pieces are
    exploded, to an equi-join, that are as long as some changed name; affected_ has stable_key and confidence,
    changed_names has name (normalised)."""
    kinds, n = F.col("path_kinds"), F.size("path_kinds")
    has = lambda k: F.array_contains(kinds, k)
    names = changed_names.select("name").where(F.length("name") > 0).distinct()
    lengths = names.select(F.length("name").alias("n")).distinct().agg(F.array_sort(F.collect_list("n"))).first()[0]  # no more than the longest name has characters
    size = F.length("test_name")
    pieces_of = lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.substring(F.col("test_name"), i, m))
    pieces = F.array_distinct(F.flatten(F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda m: m <= size), pieces_of)))
    pieces = tests.select("stable_key", F.explode(pieces).alias("name"))
    named = pieces.join(names, "name", "left_semi").select("stable_key").distinct().withColumn("named", F.lit(True))
    all_ = tests.join(affected_.select("stable_key", "confidence"), "stable_key", "left").join(named, "stable_key", "left")
    base = F.when((n == 1) & has("TESTS"), 0.98).when(has("TESTS") & has("HANDLES"), 0.9).when(has("CALLS") | has("IMPORTS"), 0.78).when(F.col("named"), 0.55).otherwise(F.greatest(F.lit(0.5), F.col("confidence")))
    score = F.least(base, F.coalesce("confidence", F.lit(0.55)))
    out = all_.where("confidence is not null or named").select("stable_key", score.alias("score"))
    return out.withColumn("level", F.when(F.col("score") >= 0.95, "confirmed").when(F.col("score") >= 0.5, "inferred").otherwise("tentative"))


#: What texts of an entity tell of authentication and of persistence.
AUTH = r"auth|security|jwt|token|permission|guard"
PERSISTENCE = r"repository|database|persistence|mongo|postgres|sql"


def score_risk(changed: DataFrame, affected_: DataFrame, *, changed_files: int = 0, tests: int = 0, documentation_gaps: int = 0, unresolved: int = 0, changed_relationships: int = 0) -> DataFrame:
    """ordinal, factor and weight of the factors that weigh anything; changed has kind and text (JSON of the entity).

    Two one-row aggregates; the nine factors are arithmetic on them.
    """
    text = F.lower("text")
    a = changed.agg(F.count("*").alias("entities"), F.count_if(text.rlike(AUTH)).alias("auth"), F.count_if(F.col("kind") == "endpoint").alias("api"), F.count_if(F.col("kind") == "configuration_key").alias("configuration"), F.count_if(text.rlike(PERSISTENCE)).alias("persistence"))
    b = affected_.where("not is_root").agg(F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("downstream"))
    one = a.withColumn("_", F.lit(1)).join(b.withColumn("_", F.lit(1)), "_")  # one row each
    some = lambda c, w: F.when(F.col(c) > 0, w).otherwise(0)
    factors = [
        ("authentication-or-authorization", some("auth", 25)),
        ("public-api", some("api", 20)),
        ("configuration", some("configuration", 12)),
        ("persistence", some("persistence", 15)),
        ("downstream-impact", F.least(F.lit(15), F.round("downstream"))),
        ("missing-tests", F.when((F.col("entities") > 0) & F.lit(tests == 0), 15).otherwise(0)),
        ("documentation-gap", F.lit(min(10, 5 * documentation_gaps))),
        ("unresolved-relationships", F.lit(min(8, 2 * unresolved))),
        ("change-size", F.least(F.lit(15), F.floor((F.col("entities") + changed_relationships + changed_files) / 5) * 3)),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("factor"), w.cast("int").alias("weight")) for i, (n, w) in enumerate(factors, 1)])
    return one.select(F.explode(rows).alias("f")).select("f.*").where("weight > 0")


def risk_level(factors: DataFrame) -> DataFrame:
    total = factors.agg(F.least(F.lit(100), F.coalesce(F.sum("weight"), F.lit(0))).cast("int").alias("score"))
    return total.withColumn("level", F.when(F.col("score") >= 55, "High").when(F.col("score") >= 25, "Medium").otherwise("Low"))


def review_focus(factors: DataFrame, n: int = 5) -> DataFrame:
    return factors.orderBy(F.desc("weight"), "factor").limit(n)


#: What can have happened, in order.
CHANGES = ("added", "modified", "removed")


def changed_roots(entity_changes: DataFrame, relationship_changes: DataFrame) -> DataFrame:
    """stable_key and change: every changed entity, and the ends of changed relationships that aren't changed themselves,
    with the relationship's change (the least of several). Removed relationships that touch a removed entity add none."""
    own = entity_changes.select("stable_key", "change")
    removed = own.where("change = 'removed'").select("stable_key")
    gone = relationship_changes.where("change = 'removed'")
    for side in ("source_key", "target_key"):
        gone = gone.join(removed.withColumnRenamed("stable_key", side), side, "left_anti")
    live = relationship_changes.where("change <> 'removed'").unionByName(gone.select(relationship_changes.columns))
    ends = live.select(F.explode(F.array("source_key", "target_key")).alias("stable_key"), "change").join(own.select("stable_key"), "stable_key", "left_anti")
    least = F.min(F.array_position(F.array(*map(F.lit, CHANGES)), F.col("change")))  # a number, which is combined without a sort
    return own.union(ends.groupBy("stable_key").agg(F.get(F.array(*map(F.lit, CHANGES)), (least - 1).cast("int")).alias("change")))


def merged_candidates(target: DataFrame, base: DataFrame) -> DataFrame:
    """stable_key, confidence, depth, is_root and revision of two candidates' tables: base's counts only if strictly greater."""
    side = lambda df, name, turn: df.select("stable_key", F.struct("confidence", F.lit(turn).alias("turn"), "depth", "is_root", F.lit(name).alias("revision")).alias("c"))
    both = side(target, "target", 1).union(side(base, "base", 0)).groupBy("stable_key").agg(F.max("c").alias("c"))
    return both.select("stable_key", "c.confidence", "c.depth", "c.is_root", "c.revision")


def affected_by_change(roots: DataFrame, base_relationships: DataFrame, target_relationships: DataFrame, target_entities: DataFrame, base_entities: DataFrame, *, max_nodes: int | None = 200, **options) -> DataFrame:
    """stable_key, confidence, depth, is_root, revision, change, kind and name of what roots(stable_key, change) affect.

    What is there is followed along the target's relationships, what was removed along the base's; bodies come from
    the target, else from the base. In order of confidence, then key, at most max_nodes.
    """
    roots = kept(roots)
    there = roots.join(target_entities.select("stable_key"), "stable_key", "left_semi")
    target = affected(target_relationships, there, max_nodes=None, **options).join(target_entities.select("stable_key"), "stable_key", "left_semi")
    base = affected(base_relationships, roots.where("change = 'removed'"), max_nodes=None, **options)
    merged = merged_candidates(target, base).join(roots.select("stable_key", "change"), "stable_key", "left")
    body = target_entities.select("stable_key", F.lit(1).alias("turn"), "kind", "name").union(base_entities.select("stable_key", F.lit(0), "kind", "name"))
    body = body.groupBy("stable_key").agg(F.max(F.struct("turn", "kind", "name")).alias("b")).select("stable_key", "b.kind", "b.name")
    out = merged.join(body, "stable_key")
    return out if max_nodes is None else out.orderBy(F.desc("confidence"), "stable_key").limit(max_nodes)


def evidence_paths(relationships: DataFrame, roots: DataFrame, *, max_depth: int = 4, max_fan_out: int | None = None, min_confidence: float = 0.2) -> DataFrame:
    """stable_key, confidence, depth and path of what roots(stable_key) affect: the steps (relationship, kind, from, to,
    weight) of its strongest path, of equally strong ones the shorter, then the one of least relationship ids.

    All steps of a node are followed, unless a fan-out is asked for: a level has a node once, so it meets a step once.
    """
    columns = ["id", "kind", "node", "neighbour", "weight"]
    if max_fan_out is None:  # each direction by itself, so that half of the shuffle is there at a time
        ruled = _ruled(relationships)
        parts = [ruled.select("id", "kind", step.alias("s")).select("id", "kind", "s.*").select(columns) for step in _steps()]
    else:
        parts = [weighted_steps(relationships, max_fan_out).select(columns)]
    steps = kept_by(parts, "node")
    none = F.array().cast("array<struct<id:string,kind:string,from:string,to:string,weight:double>>")
    level = kept(roots.select("stable_key").distinct().select("stable_key", F.lit(1.0).alias("confidence"), F.lit(0).alias("depth"), none.alias("path")))
    levels = level
    for depth in range(1, max_depth + 1):
        taken = steps.join(level.select(F.col("stable_key").alias("node"), F.col("confidence").alias("_so_far"), F.col("path").alias("_path")), "node")
        step = F.struct("id", "kind", F.col("node").alias("from"), F.col("neighbour").alias("to"), "weight")
        found = taken.select(F.col("neighbour").alias("stable_key"), F.struct((-F.col("_so_far") * F.col("weight")).alias("less"), F.array_append("_path", step).alias("path")).alias("f")).where(-F.col("f.less") >= min_confidence)
        best = found.groupBy("stable_key").agg(F.min("f").alias("f"))
        level = kept(best.select("stable_key", (-F.col("f.less")).alias("confidence"), F.lit(depth).alias("depth"), "f.path"))
        levels = levels.union(level)
    one = levels.groupBy("stable_key").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "depth", "path")).alias("b"))
    return one.select("stable_key", (-F.col("b.less")).alias("confidence"), "b.depth", "b.path")


def analyze(base_entities: DataFrame, target_entities: DataFrame, base_relationships: DataFrame, target_relationships: DataFrame, **options) -> DataFrame:
    """section, name and value: the whole analysis of a change as one small table - what was added, modified and removed,
    how much is affected by kind, risk factors, score and level."""
    entities, edges = kept(diff.entity_diff(base_entities, target_entities)), kept(diff.relationship_diff(base_relationships, target_relationships))
    roots = kept(changed_roots(entities, edges))
    found = kept(affected_by_change(roots, base_relationships, target_relationships, target_entities, base_entities, **options))
    body = target_entities.select("stable_key", "kind", F.to_json(F.struct("kind", "name", "attributes")).alias("text")).unionByName(base_entities.join(entities.where("change = 'removed'"), "stable_key", "left_semi").select("stable_key", "kind", F.to_json(F.struct("kind", "name", "attributes")).alias("text")))
    changed = body.join(entities.select("stable_key"), "stable_key", "left_semi")
    tests = found.where("kind = 'test'").count()
    factors = kept(score_risk(changed, found, tests=tests, changed_relationships=edges.count()))
    row = lambda section, df, name, value: df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value"))
    out = row("entities", entities.groupBy("change").count(), "change", "count")
    out = out.union(row("relationships", edges.groupBy("change").count(), "change", "count"))
    out = out.union(row("affected", found.groupBy("kind").count(), "kind", "count"))
    out = out.union(row("risk", factors, "factor", "weight"))
    return out.union(row("level", risk_level(factors), "level", "score"))
