"""Record filters and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyword_prefilter(docs: DataFrame, keyword: str, column: str = "text") -> DataFrame:
    """Rows whose text contains ``keyword``; the filter is pushed into the scan."""
    return docs.where(F.contains(F.col(column), F.lit(keyword)))


def sample_records(records: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """A reproducible random sample of ``n`` records: the smallest seeded hashes of the key."""
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return records.withColumn("_draw", draw).orderBy("_draw", key).limit(n).drop("_draw")


def dedup_content(records: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per distinct text, the smallest key kept. Copies combine map-side."""
    return records.groupBy(column).agg(F.min(key).alias(key)).select(key, column)
