"""Driver-table fixtures shared by the registered queries, and the same fixtures in oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.stopwords import FRENCH_STOPWORDS
from lexspark.sources.tables import spread
from lexspark.functions.text import NORMALIZED_STOPWORDS, PUNCTUATION, WHITESPACE, WORD_PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return spread(found, "doc_id")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(sql_text(w) for w in words) + "]"


STOPWORDS_SQL = sql_list(FRENCH_STOPWORDS)
NORMALIZED_STOPWORDS_SQL = sql_list(NORMALIZED_STOPWORDS)


def bm25_tokens_sql(text: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array(lower({text}), {sql_text(WHITESPACE)}), "
        f"lambda t: trim(t, {sql_text(PUNCTUATION)})), "
        f"lambda t: t <> '' AND NOT list_contains({STOPWORDS_SQL}, t))"
    )


def word_tokens_sql(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({text})), {sql_text(WORD_PATTERN)})"


# Hashed encoder, long form: (id, bucket, weight) with unit L2 norm, zero components left out.
def encode_sql(name: str, source: str, key: str, text: str, dim: int = 64) -> str:
    return f"""
{name}_tok AS (SELECT {key} AS id, md5(unnest({word_tokens_sql(text)})) AS h FROM {source}),
{name}_raw AS (
  SELECT id, ('0x' || substr(h, 1, 8))::BIGINT % {dim} AS bucket,
         sum(CASE WHEN ('0x' || substr(h, 9, 1))::INT % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) AS x
  FROM {name}_tok GROUP BY 1, 2),
{name} AS (
  SELECT id, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM {name}_raw WHERE x <> 0)"""
