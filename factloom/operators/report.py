"""A change's report: nine sections of Markdown lines as rows, and the analysis that they come from.

Lines are rows in order of section and line, so that no section outgrows a row or a task; a section without any says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import normalize_test_name
from factloom.operators import diff, impact
from factloom.plans import kept

SECTIONS = ("Changed files", "Semantic changes", "Behavior changes", "Affected APIs", "Affected modules", "Affected documentation", "Suggested tests", "Risk factors", "Suggested review focus")
#: Which section an affected entity's kind belongs to.
_KINDS = {"endpoint": 3, "module": 4, "package": 4, "documentation_page": 5, "documentation_section": 5}
#: Why a test is suggested, by the steps that lead to it.
_REASONS = ("Direct TESTS relationship to a changed entity", "Covers an endpoint connected to a changed entity", "Calls or imports an affected code path", "Test name matches a changed entity", "Connected through the bounded affected subgraph")


def suggested_tests(tests: DataFrame, paths: DataFrame, changed_names: DataFrame) -> DataFrame:
    """stable_key, score, level and reason of tests(stable_key, test_name): those that paths(stable_key, confidence,
    path) of the affected lead to, scored by the kinds of their steps, and those named after what changed."""
    of = paths.select("stable_key", "confidence", F.transform("path", lambda s: s["kind"]).alias("path_kinds"))
    rows = kept(tests.select("stable_key", "test_name").join(of, "stable_key", "left").withColumn("path_kinds", F.coalesce("path_kinds", F.array().cast("array<string>"))))
    scored = impact.recommend_tests(rows.select("stable_key", "test_name", "path_kinds"), rows.where("confidence is not null").select("stable_key", "confidence"), changed_names)
    has = lambda k: F.array_contains("path_kinds", k)
    direct = (F.size("path_kinds") == 1) & has("TESTS")
    reason = F.when(direct, _REASONS[0]).when(has("TESTS") & has("HANDLES"), _REASONS[1]).when(has("CALLS") | has("IMPORTS"), _REASONS[2]).when(F.col("confidence").isNull(), _REASONS[3]).otherwise(_REASONS[4])
    return scored.join(rows.select("stable_key", reason.alias("reason")), "stable_key")


def lines(entity_changes: DataFrame, affected: DataFrame, tests: DataFrame, factors: DataFrame, changed_files: DataFrame, behavior: DataFrame | None = None) -> DataFrame:
    """ordinal, section, line of entity_changes(stable_key, change, changed_fields), affected(stable_key, kind), tests
    (stable_key, score, level, reason), factors(factor, weight), changed_files(path) and behavior(statement, inferred)."""
    spark = entity_changes.sparkSession
    tick = lambda c: F.concat(F.lit("- `"), F.col(c), F.lit("`"))
    row = lambda i, df, line, order=None: df.select(F.lit(i).alias("ordinal"), (order if order is not None else line).cast("string").alias("order"), line.alias("line"))
    fields = F.array_join("changed_fields", ", ")
    changed = F.concat(F.lit("- **"), "change", F.lit("** `"), "stable_key", F.lit("`"), F.when(fields != "", F.concat(F.lit(" ("), fields, F.lit(")"))).otherwise(""))
    section = F.coalesce(*[F.when(F.col("kind") == k, i) for k, i in _KINDS.items()])
    groups = affected.select(section.alias("ordinal"), F.col("stable_key").alias("order"), tick("stable_key").alias("line")).where("ordinal is not null").distinct()
    # in order of score, the highest first
    rank = lambda c: F.format_string("%020.9f", F.lit(1e6) - F.col(c))
    test = F.concat(tick("stable_key"), F.lit(" — "), "reason", F.lit(" ("), F.format_string("%.2f", F.col("score").cast("double")), F.lit(", "), "level", F.lit(")"))
    factor = F.concat(F.lit("- **"), "factor", F.lit(" (+"), F.col("weight").cast("string"), F.lit(")**"))
    parts = [
        row(0, changed_files.select("path").distinct(), tick("path"), F.col("path")), row(1, entity_changes, changed, F.col("stable_key")), groups,
        row(6, tests, test, F.concat(rank("score"), "stable_key")), row(7, factors, factor, F.concat(rank("weight"), "factor")),
        row(8, impact.review_focus(factors), F.concat(F.lit("- "), "factor"), F.concat(rank("weight"), "factor")),
    ]
    if behavior is not None:
        parts.append(row(2, behavior, F.concat(F.lit("- **"), F.when(F.col("inferred"), "Inferred").otherwise("Declared"), F.lit(":** "), "statement"), F.col("statement")))
    found = kept(reduce(DataFrame.union, parts))
    empty = spark.createDataFrame([(i,) for i in range(len(SECTIONS))], "ordinal int").join(found.select("ordinal").distinct(), "ordinal", "left_anti")
    out = found.union(empty.select("ordinal", F.lit(""), F.lit("_None._")))
    return out.select("ordinal", F.get(F.array(*map(F.lit, SECTIONS)), F.col("ordinal")).alias("section"), "order", "line")


def report(base_entities: DataFrame, target_entities: DataFrame, base_relationships: DataFrame, target_relationships: DataFrame, changed_files: DataFrame, *, max_nodes: int | None = 200, max_depth: int = 4, max_fan_out: int = 25, **counts) -> tuple[DataFrame, bool]:
    """(lines() of a whole change, whether the affected were cut off): the diff, what its roots affect in the target and,
    for what was removed, in the base, tests scored from the paths that lead to them, and risk. counts as score_risk's."""
    entities, edges = kept(diff.entity_diff(base_entities, target_entities)), kept(diff.relationship_diff(base_relationships, target_relationships))
    roots = kept(impact.changed_roots(entities, edges))
    options = {"max_nodes": max_nodes, "max_depth": max_depth, "max_fan_out": max_fan_out}
    target, cut = impact.best_first(target_relationships, target_entities, roots, **options)
    base, cut_too = impact.best_first(base_relationships, base_entities, roots.where("change = 'removed'"), **options)
    side = lambda df, turn: df.select("stable_key", F.struct("confidence", F.lit(turn).alias("turn"), "depth", "path").alias("c"))
    found = side(target, 1).union(side(base, 0)).groupBy("stable_key").agg(F.max("c").alias("c")).select("stable_key", "c.confidence", "c.depth", "c.path")
    bodies = target_entities.select("stable_key", "kind", "name", F.lit(1).alias("turn")).union(base_entities.select("stable_key", "kind", "name", F.lit(0)))
    bodies = kept(bodies.groupBy("stable_key").agg(F.max(F.struct("turn", "kind", "name")).alias("b")).select("stable_key", "b.kind", "b.name"))
    found = kept(found.join(bodies, "stable_key").withColumn("is_root", F.col("depth") == 0))
    tests = target_entities.where("kind = 'test'").select("stable_key", normalize_test_name(F.col("name")).alias("test_name"))
    names = entities.join(bodies, "stable_key").select(normalize_test_name(F.col("name")).alias("name"))
    advised = kept(suggested_tests(tests, found, names))
    text = F.to_json(F.struct("kind", "name"))
    changed = entities.join(bodies, "stable_key").select("kind", text.alias("text"))
    factors = kept(impact.score_risk(changed, found, tests=advised.count(), changed_files=changed_files.distinct().count(), changed_relationships=edges.count(), **counts))
    return lines(entities, found, advised, factors, changed_files), cut or cut_too
