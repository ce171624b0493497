"""Facts of source files: entities and relationships, unresolved references and diagnostics.

Declarations become entities, heritage, calls and imports references of the declaration that they stand in; a
reference that one declaration answers to becomes a relationship, any other stays unresolved with the number of its
candidates. Declarations nest; a reference's owner is the closest one around its line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import entity_stable_key
from factloom.operators.provenance import closest_enclosing
from factloom.plans import kept
from factloom.sources import scanners, structure

#: How sure a relationship is that was resolved by name alone.
BY_NAME = 0.75


@dataclass
class Extraction:
    entities: DataFrame  # stable_key, kind, name, qualified_name, language, path, start_line, end_line
    relationships: DataFrame  # id, kind, source_key, target_key, confidence, resolution
    unresolved: DataFrame  # kind, path, line, target, candidates
    diagnostics: DataFrame  # path, severity, message


def extract(artifacts: DataFrame, repository: str) -> Extraction:
    """Facts of artifacts(path, language, content)."""
    rows = scanners.lines(artifacts)
    found = structure.read(artifacts)[1]
    place = F.concat_ws("#", "path", "kind", "name", F.col("start_line").cast("string"))
    entities = found.select(entity_stable_key(F.lit(repository), F.col("kind"), F.col("language"), place).alias("stable_key"), "kind", "name", "qualified_name", "language", "path", "start_line", "end_line")
    entities = kept(entities.dropDuplicates(["stable_key"]))
    references = scanners.heritage(rows).select("kind", "path", "line", "target")
    references = references.union(scanners.calls(rows).select(F.lit("CALLS"), "path", "line", "target")).union(scanners.imports(rows).select(F.lit("IMPORTS"), "path", "line", "target"))
    # a declaration's own line isn't a call of it
    own = entities.select("path", F.col("start_line").alias("line"), F.col("name").alias("target"))
    references = references.join(own.hint("merge"), ["path", "line", "target"], "left_anti").distinct()
    references = references.withColumn("id", F.sha2(F.concat_ws("\x1f", "kind", "path", F.col("line").cast("string"), "target"), 256))
    owners = closest_enclosing(references.select("id", "path", "line"), entities.where(~F.col("kind").isin("package", "field", "test")).select("stable_key", "path", "start_line", "end_line"))
    answers = entities.where(~F.col("kind").isin("package", "field", "test", "constructor")).groupBy("name").agg(F.count("*").alias("candidates"), F.min("stable_key").alias("target_key"))
    named = references.withColumn("name", F.substring_index("target", ".", -1)).join(answers.hint("merge"), "name", "left").join(owners.hint("merge"), "id")
    known = (F.col("candidates") == 1) & F.col("owner").isNotNull() & (F.col("owner") != F.col("target_key"))
    relationships = named.where(known).select("id", "kind", F.col("owner").alias("source_key"), "target_key", F.lit(BY_NAME).alias("confidence"), F.lit("name").alias("resolution"))
    unresolved = named.where(F.coalesce("candidates", F.lit(0)) != 1).select("kind", "path", "line", "target", F.coalesce("candidates", F.lit(0)).alias("candidates"))
    empty = artifacts.where(F.col("content").isNull()).select("path", F.lit("error").alias("severity"), F.lit("no content").alias("message"))
    many = unresolved.where("candidates > 1").groupBy("path").agg(F.count("*").alias("n")).select("path", F.lit("information").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" ambiguous references")).alias("message"))
    return Extraction(entities, relationships, unresolved, empty.union(many).union(structure.syntax_diagnostics(artifacts).select("path", "severity", "message")))


def incremental(artifacts: DataFrame, changes: DataFrame, relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """The artifacts to extract anew after changes(path, change): changed ones, and those with a relationship to an
    entity of a changed or deleted file."""
    changed = changes.select("path").distinct()
    # all of these grow with the files: merged, as a driver can't hold what a broadcast would send through it
    moved = entities.join(changed.hint("merge"), "path", "left_semi").select(F.col("stable_key").alias("target_key"))
    sources = relationships.join(moved.hint("merge"), "target_key", "left_semi").select(F.col("source_key").alias("stable_key"))
    touched = entities.join(sources.distinct().hint("merge"), "stable_key", "left_semi").select("path")
    return artifacts.join(changed.union(touched).distinct().hint("merge"), "path", "left_semi")
