"""Question answering: an intent's traversal policy, evidence packs and the deterministic answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import validate_citations

#: Direction and relationship kinds that a question's intent is answered along, to depth 3 and 80 nodes.
POLICIES = {
    "callers": ("incoming", ("CALLS", "IMPORTS", "DEPENDS_ON")),
    "callees": ("outgoing", ("CALLS", "IMPORTS", "DEPENDS_ON")),
    "endpoint_flow": ("both", ("HANDLES", "CALLS", "USES_MIDDLEWARE", "READS_CONFIG")),
    "configuration_usage": ("incoming", ("READS_CONFIG",)),
    "test_impact": ("incoming", ("TESTS", "CALLS", "IMPORTS")),
    "documentation_impact": ("incoming", ("DOCUMENTS",)),
    "module_explanation": ("both", ("CONTAINS", "DECLARES", "DEPENDS_ON", "HANDLES")),
    "entity_lookup": ("both", ()),
}


def policies(spark: SparkSession) -> DataFrame:
    rows = [(i, d, list(k), 0 if i == "entity_lookup" else 3, 80) for i, (d, k) in POLICIES.items()]
    return spark.createDataFrame(rows, "intent string, direction string, kinds array<string>, max_depth int, max_nodes int")


def evidence_pack(structural: DataFrame, semantic: DataFrame, k: int = 6) -> DataFrame:
    """question, evidence_id, kind, reference, similarity: structural references in order of (path, start_line), then the
    k best semantic ones, numbered E1.. within each question. A question's references are bounded by its traversal."""
    one = structural.select("question", F.lit("structural").alias("kind"), F.lit(0).alias("turn"), F.struct(F.lit(0.0).alias("less"), "path", "start_line").alias("order"), F.concat_ws(":", "path", F.col("start_line").cast("string")).alias("reference"), F.lit(None).cast("double").alias("similarity"))
    by_likeness = Window.partitionBy("question").orderBy(F.desc("similarity"), "id")
    near = semantic.withColumn("_n", F.row_number().over(by_likeness)).where(F.col("_n") <= k)
    likeness = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("similarity")))
    two = near.select("question", F.lit("semantic").alias("kind"), F.lit(1).alias("turn"), F.struct((-F.col("similarity")).alias("less"), F.col("id").alias("path"), F.lit(0).alias("start_line")).alias("order"), F.col("id").alias("reference"), likeness.alias("similarity"))
    n = F.row_number().over(Window.partitionBy("question").orderBy("turn", "order", "reference"))
    return one.union(two).select("question", F.concat(F.lit("E"), n).alias("evidence_id"), "kind", "reference", "similarity")


def answers(packs: DataFrame, generated: DataFrame | None = None, lines: int = 12) -> DataFrame:
    """question, answer, citations, confidence: what was generated where its citations hold, else the evidence itself.

    generated has question and answer; confidence is high with structural evidence, medium with semantic only.
    """
    number = F.substring("evidence_id", 2, 9).cast("int")
    all_ = packs.groupBy("question").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), "evidence_id", "kind", "reference"))).alias("e"))
    first = F.slice("e", 1, lines)
    plain = F.array_join(F.transform(first, lambda x: F.concat(F.lit("- "), x["reference"], F.lit(" ["), x["evidence_id"], F.lit("]"))), "\n")
    ids = F.transform("e", lambda x: x["evidence_id"])
    structural = F.exists("e", lambda x: x["kind"] == "structural")
    if generated is None:
        checked = all_.withColumn("g", F.lit(None).cast("struct<text:string,ids:array<string>,valid:boolean>"))
    else:
        checked = all_.join(generated.select("question", "answer"), "question", "left").withColumn("g", F.when(F.col("answer").isNotNull(), validate_citations(F.col("answer"), ids)))
    ok = F.coalesce(F.col("g.valid"), F.lit(False))
    return checked.select("question", F.when(ok, F.col("g.text")).otherwise(plain).alias("answer"), F.when(ok, F.col("g.ids")).otherwise(F.transform(first, lambda x: x["evidence_id"])).alias("citations"), F.when(structural, "high").otherwise("medium").alias("confidence"))
