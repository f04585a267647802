"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded coin.

Every source gets a share of all words in proportion to its weight, but never more than ``max_rate`` times its own
words; what a source cannot take is shared again among the others by weight, until none is above its limit. A document
is then taken floor(rate) times, and once more when a coin seeded by its id and text falls below the fraction.

Defined cases: a null text has no words; a null source is a source of its own, ordered last; documents without words
are taken by the same rule and add nothing; equal rows draw equal coins; an empty table gives an empty mix; columns
besides ``doc_id``, ``text`` and ``source`` are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.materialize import cut_lineage
from lexspark.llm.common import hash_fraction, table, words

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = "mix"
# One row per source; beyond this many the sources meet the documents in a salted shuffle join instead.
BROADCAST_SOURCES = 50_000
SALTS = 32


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """``(source, source_size, target)`` from rows of ``(source, size)``; sizes are summed before they move.

    The shares have a closed form: with sources ordered by size over weight, the ones that stop at their limit are a
    prefix, so running sums over one row per source find it without iterating.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = totals.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    )
    everything = Window.partitionBy()
    filled = Window.orderBy(
        (F.col("source_size").cast("double") / F.col("weight")), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    big = "decimal(38,0)"
    running = weighted.select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(everything) - max_rate * F.coalesce(F.sum("source_size").over(filled), F.lit(0)))
        .alias("left_size"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0))).alias("left_weight"),
    ).withColumn(
        "capped",
        (F.col("left_size").cast(big) * F.col("weight")) > (F.col("source_size").cast(big) * F.col("left_weight") * max_rate),
    )
    # The first source that is not capped holds what is left to share and the weight that shares it.
    level = F.max(F.when(~F.col("capped"), F.struct("left_weight", "left_size"))).over(everything)
    return running.withColumn("level", level).select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("source_size").cast("double") * max_rate)
        .otherwise(F.col("level.left_size").cast("double") * F.col("weight") / F.col("level.left_weight"))
        .alias("target"),
    )


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED
) -> DataFrame:
    """Every row of ``docs`` with a struct ``__mix`` of its size, source size, target and number of copies."""
    spark = docs.sparkSession
    sizes = docs.select("source", F.size(words(F.col("text"))).alias("size"))
    targets = cut_lineage(source_targets(sizes, weights, max_rate), "mix-targets").select(
        F.col("source").alias("__mix_source"), F.struct("source_size", "target").alias("__mix_target")
    )
    same = F.col("source").eqNullSafe(F.col("__mix_source"))
    if targets.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(targets), same, "left")
    else:
        salted = docs.withColumn("__mix_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)))
        spread = targets.withColumn("__mix_salts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        joined = salted.join(spread, same & (F.col("__mix_salt") == F.col("__mix_salts")), "left").drop("__mix_salts", "__mix_salt")
    size = F.size(words(F.col("text"))).cast("long")
    rate = F.when(F.col("__mix_target.source_size") > 0, F.col("__mix_target.target") / F.col("__mix_target.source_size")).otherwise(0.0)
    coin = hash_fraction(F.lit(seed), F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))))
    copies = F.floor("__mix_rate") + (coin < F.col("__mix_rate") - F.floor("__mix_rate")).cast("long")
    return (
        joined.withColumn("__mix_rate", rate)
        .withColumn("__mix", F.struct(size.alias("size"), "__mix_target.source_size", "__mix_target.target", copies.alias("copies")))
        .drop("__mix_source", "__mix_target", "__mix_rate")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document as many times as its plan says, with the columns of ``docs``."""
    planned = plan_mix(docs, weights, max_rate, seed)
    return planned.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("__mix.copies").cast("int")))).drop("__mix", "__mix_copy")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select(
        "doc_id", "__mix.size", "__mix.source_size", "__mix.target",
        (F.col("__mix.size") * F.col("__mix.copies")).alias("taken"), F.col("__mix.copies").alias("copies"),
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat('mix|', coalesce(doc_id::VARCHAR, chr(0) || 'null'), '|', md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM totals),
-- A source stops at its limit exactly when the sources that are no fuller than it leave too much for its weight.
levels AS (
  SELECT a.source, a.source_size, a.weight,
         (SELECT sum(source_size) FROM weighted)
           - 3 * coalesce((SELECT sum(b.source_size) FROM weighted b WHERE b.source_size * a.weight < a.source_size * b.weight), 0) AS left_size,
         (SELECT sum(weight) FROM weighted)
           - coalesce((SELECT sum(b.weight) FROM weighted b WHERE b.source_size * a.weight < a.source_size * b.weight), 0) AS left_weight
  FROM weighted a),
capped AS (SELECT *, left_size * weight > 3 * source_size * left_weight AS is_capped FROM levels),
rest AS (
  SELECT (SELECT sum(source_size) FROM capped) - 3 * coalesce(sum(source_size) FILTER (is_capped), 0) AS size,
         sum(weight) FILTER (NOT is_capped) AS weight FROM capped),
targets AS (
  SELECT c.source, c.source_size,
         CASE WHEN is_capped THEN c.source_size::DOUBLE * 3 ELSE r.size::DOUBLE * c.weight / r.weight END AS target
  FROM capped c, rest r),
rated AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM counted
"""
