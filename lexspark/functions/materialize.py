"""Lineage cuts and distributed numbering through tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a local session may fall back to a temp folder."""
    context = spark.sparkContext
    configured = context.getConf().get(CHECKPOINT_KEY) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    if context.applicationId not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[context.applicationId] = tempfile.mkdtemp(prefix="lexspark-")
    return _LOCAL_FALLBACK[context.applicationId]


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lexspark/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and read it back: the plan restarts from files that survive executor loss."""
    path = new_table_path(df.sparkSession, label)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def ordered_index(df: DataFrame, order: list[Column], name: str, label: str = "index") -> DataFrame:
    """Consecutive numbers from 0 in global order, without moving all rows to one task.

    Rows are range-partitioned, numbered inside each range, and shifted by the row counts of the
    ranges before it; only those per-range counts are summed together.
    """
    # A user-given partition count keeps AQE from merging ranges, so the range id is stable.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(ranged, label)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.withColumn("_pos", F.row_number().over(inside))
        .join(offsets, "_range")
        .withColumn(name, F.col("_base") + F.col("_pos") - 1)
        .drop("_range", "_pos", "_base")
    )
