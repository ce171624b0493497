"""What a project is made of, and links across languages and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import language_of

#: Words in a manifest that tell of a framework.
FRAMEWORKS = {"spring": "springframework", "ktor": "io.ktor", "vertx": "io.vertx", "nest": "@nestjs/", "express": '"express"'}


def detect_project(artifacts: DataFrame) -> DataFrame:
    """One row: languages, frameworks and source roots of artifacts(path, content), from aggregates over all files."""
    path, content = F.col("path"), F.coalesce("content", F.lit(""))
    manifest = path.rlike(r"(^|/)(pom\.xml|build\.gradle(\.kts)?|package\.json)$")
    found = F.array_compact(F.array(*[F.when(manifest & content.contains(word), F.lit(name)) for name, word in FRAMEWORKS.items()]))
    root = F.regexp_extract(path, r"^((?:.*/)?src(?:/(?:main|test)/(?:java|kotlin))?)/", 1)
    rows = artifacts.select(language_of(path).alias("language"), F.when(root != "", root).alias("root"), found.alias("found"))
    return rows.agg(F.array_sort(F.collect_set("language")).alias("languages"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("frameworks"), F.array_sort(F.collect_set("root")).alias("source_roots"))


def link_across(references: DataFrame, symbols: DataFrame, confidence: float = 0.8) -> DataFrame:
    """reference, target, confidence: references(reference, name, language) with the one symbol (stable_key, name,
    language) of another language that has the name. Counts are made once a name and language, on symbols alone."""
    per = symbols.groupBy("name", "language").agg(F.count("*").alias("n"), F.min("stable_key").alias("target"))
    all_ = per.groupBy("name").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("own"), F.map_from_entries(F.collect_list(F.struct("language", "target"))).alias("targets"))
    r = references.join(all_, "name")
    others = F.col("total") - F.coalesce(F.try_element_at("own", F.col("language")), F.lit(0))
    target = F.get(F.map_values(F.map_filter("targets", lambda k, v: k != F.col("language"))), F.lit(0))
    return r.where(others == 1).select("reference", target.alias("target"), F.lit(confidence).alias("confidence"))


def link_configuration(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """reference, target, confidence: uses(reference, key) with the one definition (stable_key, key) of the key."""
    only = definitions.groupBy("key").agg(F.count("*").alias("n"), F.min("stable_key").alias("target")).where("n = 1")
    return uses.join(only, "key").select("reference", "target", F.lit(0.9).alias("confidence"))
