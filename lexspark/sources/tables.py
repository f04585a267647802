"""Record tables: scan, overwrite, append of alternative answers, embedding cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.encode import Encoder

RECORD_COLUMNS = ("id", "content", "raw_text", "level")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a small input over all cores before CPU-heavy text work.

    An input with at least as many partitions as cores (any large table) is left as it is, so no
    shuffle of raw text happens at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def scan_records(df: DataFrame) -> DataFrame:
    """The four record columns of rows that have content; the filter reaches the Parquet scan."""
    return df.select(*RECORD_COLUMNS).where(F.col("content").isNotNull())


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return scan_records(spark.read.parquet(path))


def write_records(records: DataFrame, path: str) -> None:
    """Replace the record table."""
    records.select(*RECORD_COLUMNS).write.mode("overwrite").parquet(path)


def new_answers(existing: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a batch ``(text, foreign_id)`` into rows to append and rejected rows.

    ``text`` alone is unique: a wording already stored, or given twice in the batch, is accepted
    once, for the smallest ``foreign_id``. The reference raises on a duplicate; rejects are rows.
    """
    # Counted per (text, foreign_id) first, so a wording repeated a billion times combines map-side.
    grouped = batch.groupBy("text", "foreign_id").agg(F.count("*").alias("copies"))
    unseen = grouped.join(existing.select("text"), "text", "left_anti")
    accepted = unseen.groupBy("text").agg(F.min("foreign_id").alias("foreign_id"))
    kept = accepted.select("text", "foreign_id", F.lit(1).alias("used"))
    # Null-safe on foreign_id; text is the equi-join key.
    joined = grouped.alias("g").join(
        kept.alias("k"),
        (F.col("g.text") == F.col("k.text")) & F.col("g.foreign_id").eqNullSafe(F.col("k.foreign_id")),
        "left",
    )
    rejected = (
        joined.select("g.text", "g.foreign_id", (F.col("g.copies") - F.coalesce("k.used", F.lit(0))).alias("rejected"))
        .where("rejected > 0")
    )
    return accepted, rejected


def append_answers(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """Append the new wordings of ``batch`` to the table at ``path``; returns the rejected rows.

    The rejects are computed against the stored answers before the write changes them.
    """
    from lexspark.functions.materialize import cut_lineage

    accepted, rejected = new_answers(spark.read.parquet(path), batch)
    accepted, rejected = cut_lineage(accepted, "accepted"), cut_lineage(rejected, "rejected")
    accepted.write.mode("append").parquet(path)
    return rejected


def with_content_hash(texts: DataFrame) -> DataFrame:
    return texts.withColumn("content_hash", F.sha2(F.col("text"), 256))


def texts_to_encode(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct ``(content_hash, text)`` that the cache lacks for ``model``."""
    hashed = with_content_hash(texts.select("text"))
    cached = cache.where(F.col("model") == model).select("content_hash")
    return hashed.join(cached, "content_hash", "left_anti").groupBy("content_hash").agg(
        F.any_value("text").alias("text")
    )


def refresh_embedding_cache(spark: SparkSession, path: str, texts: DataFrame, encoder: Encoder) -> DataFrame:
    """Encode what is missing, append it to the cache, return the vectors of ``encoder``'s model.

    A changed text has a new hash, so the cache never serves a stale vector.
    """
    schema = "content_hash string, embedding array<double>, model string"
    try:
        cache = spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        cache = spark.createDataFrame([], schema)
    missing = texts_to_encode(texts, cache, encoder.name)
    encoded = missing.select(
        "content_hash", encoder(F.col("text")).alias("embedding"), F.lit(encoder.name).alias("model")
    )
    encoded.write.mode("append").partitionBy("model").parquet(path)
    return spark.read.schema(schema).parquet(path).where(F.col("model") == encoder.name)
