"""Plans that operators share: tables that cut lineage, top rows of a key, the driver tables as a fact graph."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@cache
def _own_folder() -> str:
    """Where the cluster names no shared folder (one machine, tests)."""
    return f"file://{tempfile.mkdtemp(prefix='factloom-')}"


def shared_path(spark: SparkSession, name: str = "plans") -> str:
    """A new folder below spark.checkpoint.dir."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files: without it they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame) -> DataFrame:
    """df, written below spark.checkpoint.dir and read again: iterations restart from files, not from lineage."""
    path = shared_path(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_by(parts: Sequence[DataFrame], *keys: str) -> DataFrame:
    """The rows of parts as kept() gives them, in as many buckets of their keys as a shuffle has partitions: a join on the
    keys doesn't shuffle them again. Parts are written in turn, so only one's shuffle is there at a time. The table leaves
    the catalog at once, its files stay as kept()'s do."""
    spark = parts[0].sparkSession
    path, n = shared_path(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with shuffles_freed(spark):
        for df in parts:
            df.repartition(n, *keys).write.mode("append").bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def delete_kept(spark: SparkSession, hours: float = 24) -> int:
    """Deletes the tables that kept() and its like wrote below spark.checkpoint.dir more than so many hours ago, when
    nothing reads them any more; how many."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    root = spark._jvm.org.apache.hadoop.fs.Path(shared or _own_folder())
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    before, n = 1000 * (time.time() - 3600 * hours), 0
    for s in files.listStatus(root) if files.exists(root) else []:
        if re.search(r"-[0-9a-f]{32}$", s.getPath().getName()) and s.getModificationTime() < before:
            n += bool(files.delete(s.getPath(), True))
    return n


#: Up to how many rows of a key Spark cuts a ranked window to before its shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, parts: int = 32) -> DataFrame:
    """The first k rows of each key. Every task cuts its rows of a hub to k before they are shuffled, which Spark does
    itself for a small k; for others a hub's rows are cut in each of `parts` parts before they meet."""
    n = F.row_number()
    if k > GROUP_LIMIT:
        part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(parts))
        df = df.withColumn("_part", part).withColumn("_n", n.over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_n") <= k).drop("_part")
    return df.withColumn("_n", n.over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


#: The driver tables as entities and relationships; the text runs on Spark and on DuckDB alike.
ENTITIES = """
    SELECT concat('module:', r_regionkey) AS stable_key, 'module' AS kind, r_name AS name, CAST(NULL AS STRING) AS attributes FROM region
    UNION ALL SELECT concat('package:', n_nationkey), 'package', n_name, CAST(NULL AS STRING) FROM nation
    UNION ALL SELECT concat('class:', s_suppkey), 'class', s_name, CAST(NULL AS STRING) FROM supplier
    UNION ALL SELECT concat('interface:', c_custkey), 'interface', c_name, concat('segment=', c_mktsegment) FROM customer
    UNION ALL SELECT concat('endpoint:', o_orderkey), 'endpoint', concat('/orders/', o_custkey, '/', o_orderkey), concat('status=', o_orderstatus, ' priority=', o_orderpriority) FROM orders
    UNION ALL SELECT concat('dependency:', p_partkey), 'dependency', p_name, concat('brand=', p_brand) FROM part"""
RELATIONSHIPS = """
    SELECT concat('contains:', n_nationkey) AS id, 'CONTAINS' AS kind, concat('module:', n_regionkey) AS source_key, concat('package:', n_nationkey) AS target_key, CAST(NULL AS DOUBLE) AS confidence FROM nation
    UNION ALL SELECT concat('contains:c', c_custkey), 'CONTAINS', concat('package:', c_nationkey), concat('interface:', c_custkey), CAST(NULL AS DOUBLE) FROM customer
    UNION ALL SELECT concat('contains:s', s_suppkey), 'CONTAINS', concat('package:', s_nationkey), concat('class:', s_suppkey), CAST(NULL AS DOUBLE) FROM supplier
    UNION ALL SELECT concat('handles:', o_orderkey), 'HANDLES', concat('interface:', o_custkey), concat('endpoint:', o_orderkey), CAST(NULL AS DOUBLE) FROM orders
    UNION ALL SELECT concat('depends:', l_orderkey, ':', l_linenumber), 'DEPENDS_ON', concat('endpoint:', l_orderkey), concat('dependency:', l_partkey), round(1 - l_discount, 2) FROM lineitem
    UNION ALL SELECT concat('tests:', l_suppkey, ':', l_partkey), 'TESTS', concat('class:', l_suppkey), concat('dependency:', l_partkey), CAST(NULL AS DOUBLE) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) d"""
#: Two revisions: the base lacks every 97th order, the target every 89th; the target's every 83rd has another attribute.
BASE_ENTITIES = "SELECT * FROM entities WHERE NOT (kind = 'endpoint' AND try_cast(substr(stable_key, 10) AS BIGINT) % 97 = 0)"
TARGET_ENTITIES = """
    SELECT stable_key, kind, name, CASE WHEN kind = 'endpoint' AND try_cast(substr(stable_key, 10) AS BIGINT) % 83 = 0 THEN concat(attributes, ' changed') ELSE attributes END AS attributes
    FROM entities WHERE NOT (kind = 'endpoint' AND try_cast(substr(stable_key, 10) AS BIGINT) % 89 = 0)"""
TABLES = ("region", "nation", "supplier", "customer", "orders", "part", "lineitem")


def with_views(spark: SparkSession, sf_dir: str, tables: Sequence[str] = TABLES) -> SparkSession:
    """A session of its own in which the driver tables are views."""
    session = spark.newSession()
    for t in tables:
        session.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return session


def run_sql(spark: SparkSession, sf_dir: str, sql: str, tables: Sequence[str] = TABLES) -> DataFrame:
    """sql over the driver tables."""
    return with_views(spark, sf_dir, tables).sql(sql)


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of the driver tables."""
    session = with_views(spark, sf_dir)
    return session.sql(ENTITIES), session.sql(RELATIONSHIPS)


def revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The entities of the base and of the target revision."""
    session = with_views(spark, sf_dir)
    return tuple(session.sql(f"WITH entities AS ({ENTITIES}) {text}") for text in (BASE_ENTITIES, TARGET_ENTITIES))
