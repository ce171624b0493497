"""Change summaries and documents written from facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans import top_per_key


def change_summary(affected: DataFrame, entities: DataFrame) -> DataFrame:
    """group, name: affected APIs, documents and modules, a row for each distinct name, so that no list outgrows a row."""
    group = F.when(F.col("kind") == "endpoint", "apis").when(F.col("kind").isin("documentation_page", "documentation_section"), "documents").when(F.col("kind").isin("module", "package"), "modules")
    named = affected.select("stable_key").join(entities.select("stable_key", "kind", "name"), "stable_key").select(group.alias("group"), "name").where("group is not null")
    return named.distinct()


def api_document(entities: DataFrame, relationships: DataFrame, most: int | None = None) -> DataFrame:
    """source_key, document: for each handler the endpoints that it handles, in order; all of them, or the first `most`
    and how many more there are. A document is one value, so for very large handlers `most` bounds its size."""
    handled = relationships.where("kind = 'HANDLES'").join(entities.select(F.col("stable_key").alias("target_key"), F.col("name").alias("endpoint")), "target_key")
    named = handled.join(entities.select(F.col("stable_key").alias("source_key"), F.col("name").alias("handler")), "source_key")
    lines = named.groupBy("source_key", "endpoint").agg(F.min("handler").alias("handler"))
    sizes = lines.groupBy("source_key").agg(F.count("*").alias("_all"))
    first = lines if most is None else top_per_key(lines, ["source_key"], [F.col("endpoint")], most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("endpoint")), lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n")
    written = first.groupBy("source_key").agg(F.min("handler").alias("handler"), text.alias("lines")).join(sizes, "source_key")
    more = F.lit("") if most is None else F.when(F.col("_all") > most, F.concat(F.lit("\n- and "), F.col("_all") - most, F.lit(" more"))).otherwise("")
    return written.select("source_key", F.concat(F.lit("# "), "handler", F.lit("\n\n"), "lines", more).alias("document"))


#: What a section without lines says instead.
EMPTY = {"Entry points": "- No endpoint facts selected.", "Configuration": "- No configuration facts selected.", "Local commands": "- No build commands were inferred.", "Key entities": "- No facts selected."}
#: The sections of a document by its kind.
SECTIONS = {
    "api": ("Entry points",),
    "architecture": ("Key entities",),
    "change": ("Key entities",),
    "configuration": ("Configuration",),
    "module": ("Key entities",),
    "onboarding": ("Entry points", "Local commands", "Key entities"),
}


def _text_attribute(name: str) -> Column:
    """An attribute if it is a text; null if it is missing or of another type."""
    value = F.try_variant_get(F.try_parse_json("attributes"), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def document_lines(entities: DataFrame, kind: str) -> DataFrame:
    """ordinal, section, order_kind, order_name, line: the facts of a document of one of the SECTIONS kinds, written from
    entities(kind, name, qualified_name, confidence, attributes as JSON), a row for each line.

    Null attributes, or ones that aren't JSON, count as none; without a confidence 100 % is said. A section without
    facts has one line that says so. Nothing is gathered: a document of any size is a table.
    """
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    typed = F.concat_ws(", ", F.concat(F.lit("request: "), _text_attribute("requestType")), F.concat(F.lit("response: "), _text_attribute("responseType")))
    route = F.concat_ws(" ", F.coalesce(_text_attribute("httpMethod"), F.lit("UNKNOWN")), F.coalesce(_text_attribute("normalizedPath"), "name"))
    default = _text_attribute("defaultValue")
    sure = F.round(F.coalesce("confidence", F.lit(1.0)) * 100).cast("int").cast("string")
    of = lambda k: entities.where(F.col("kind") == k)

    def lines(title: str) -> DataFrame:
        if title == "Local commands":
            runs = F.explode(F.from_json(F.get_json_object("attributes", "$.commands"), "array<string>"))
            commands = of("build_script").select(runs.alias("command")).where("command is not null").distinct()
            return commands.select(F.lit("build_script").alias("order_kind"), F.col("command").alias("order_name"), F.concat(F.lit("- "), tick(F.col("command"))).alias("line"))
        rows, text = {
            "Entry points": (of("endpoint"), F.concat(tick(route), F.when(typed != "", F.concat(F.lit(" \u2014 "), typed)).otherwise(""))),
            "Configuration": (of("configuration_key"), F.concat(tick(F.coalesce(_text_attribute("key"), "name")), F.coalesce(F.concat(F.lit(" = "), tick(default)), F.lit("")))),
            "Key entities": (entities, F.concat(F.lit("**"), "kind", F.lit("** "), tick(F.coalesce("qualified_name", "name")), F.lit(" \u2014 confidence "), sure, F.lit("%"))),
        }[title]
        return rows.select(F.col("kind").alias("order_kind"), F.col("name").alias("order_name"), F.concat(F.lit("- "), text).alias("line"))

    spark, out = entities.sparkSession, None
    for ordinal, title in enumerate(SECTIONS[kind]):
        found = lines(title)
        # one row each: the placeholder, and whether there is any line
        none = spark.range(1).select(F.lit("").alias("order_kind"), F.lit("").alias("order_name"), F.lit(EMPTY[title]).alias("line"), F.lit(True).alias("_"))
        empty = found.agg((F.count("*") == 0).alias("_"))
        both = found.union(none.join(F.broadcast(empty), "_", "left_semi").drop("_"))
        both = both.select(F.lit(ordinal).alias("ordinal"), F.lit(title).alias("section"), "order_kind", "order_name", "line")
        out = both if out is None else out.union(both)
    return out


def document_overview(entities: DataFrame, revision: str) -> DataFrame:
    """One row: overview, which names the revision and counts the facts by kind."""
    counts = entities.groupBy("kind").agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["kind"])), ", ")
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("string")
    kinds = F.when(F.count("*") > 0, F.concat(F.lit(" ("), listed, F.lit(")."))).otherwise(".")
    return counts.agg(F.concat(F.lit(f"This page is grounded in revision `{revision}` and "), total, F.lit(" selected canonical facts"), kinds).alias("overview"))
