"""Revisions as partitions, and the rows that make one active."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_revision(facts: DataFrame, root: str, repository: str, revision: str) -> str:
    """Writes facts as one revision's partition; an unfinished write of the same revision is replaced."""
    path = f"{root}/repository_id={repository}/revision_id={revision}"
    facts.write.mode("overwrite").parquet(path)
    return path


def read_revision(spark: SparkSession, root: str, repository: str, revision: str) -> DataFrame:
    """One partition: the scan sees neither other repositories nor other revisions."""
    return spark.read.parquet(f"{root}/repository_id={repository}/revision_id={revision}")


_ACTIVATIONS = "repository string, revision string, n long"


def active_revision(spark: SparkSession, root: str, repository: str) -> str | None:
    """The revision that was activated last."""
    rows = spark.read.schema(_ACTIVATIONS).option("ignoreMissingFiles", True).parquet(f"{root}/activations*")
    return rows.where(F.col("repository") == repository).agg(F.max_by("revision", "n")).first()[0]


def publish(spark: SparkSession, root: str, repository: str, revision: str) -> bool:
    """Makes a written revision active by adding a row; False if it was active already.

    Spark commits the row's file at once: readers see the old revision or the new one. A single writer is assumed.
    """
    spark.createDataFrame([], _ACTIVATIONS).write.mode("append").parquet(f"{root}/activations")
    if active_revision(spark, root, repository) == revision:
        return False
    n = spark.read.schema(_ACTIVATIONS).parquet(f"{root}/activations").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    spark.createDataFrame([(repository, revision, n + 1)], _ACTIVATIONS).coalesce(1).write.mode("append").parquet(f"{root}/activations")
    return True
