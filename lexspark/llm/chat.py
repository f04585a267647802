"""Chat formatting: collapse of cumulative snapshots, then rendering.

Logged conversations are often snapshots of a longer one. Every turn gets a rolling hash of the turns up to it; a
conversation whose last hash is also a hash inside a longer conversation is a prefix of it and is dropped by an
anti-join. Of equal conversations the one with the smallest id stays. The rest is rendered turn by turn.

The rolling hash adds the MD5 of (position, role, text) in four 32-bit lanes, so a prefix is a running sum. Turns are
range-partitioned by (conversation, turn) and sums run inside a range; one row per conversation and range carries them
over, so a conversation of any length is spread over many tasks. For the same reason a rendering comes in parts of at
most ``TURNS_PER_PART`` turns; joined in the order of ``part`` they are the whole conversation.

Defined cases: turns order by number, null first, ties by content; a row repeated exactly counts once; a null
conversation id is one conversation of its own; a null role renders as ``unknown`` and a null text as empty, while both
stay different from those strings in comparisons; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.materialize import cut_lineage
from lexspark.llm.common import table

TURNS_PER_PART = 256
LANES = tuple(f"lane{k}" for k in range(4))
# The marks around a turn.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def _content(role: Column, text: Column) -> Column:
    known = [F.when(c.isNull(), "0").otherwise(F.concat(F.lit("1"), c)) for c in (role, text)]
    return F.md5(F.concat_ws("\u001f", *known))


def _carried(ranged: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Running sums of ``values`` over each conversation, over all its ranges, and ``turns``, its number of turns."""
    inside = Window.partitionBy("rng", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "content")
    totals = ranged.groupBy("conv_id", "rng").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"sum_{k}") for k, v in values.items()])
    before = Window.partitionBy("conv_id").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.col("conv_id").alias("c_id"), F.col("rng").alias("c_rng"), F.sum("n").over(Window.partitionBy("conv_id")).alias("turns"),
        *[F.coalesce(F.sum(f"sum_{k}").over(before), F.lit(0)).alias(f"carry_{k}") for k in values],
    )
    local = ranged.withColumns({k: F.sum(v).over(inside) for k, v in values.items()})
    joined = local.join(carry, (F.col("rng") == F.col("c_rng")) & F.col("conv_id").eqNullSafe(F.col("c_id")))
    return joined.withColumns({k: F.col(k) + F.col(f"carry_{k}") for k in values}).drop("c_id", "c_rng", *[f"carry_{k}" for k in values])


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with ``rng``, position ``pos`` from 1, number of ``turns`` and the lanes of the rolling hash."""
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("content")]
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("content", _content(F.col("role"), F.col("text")))
    ranged = cut_lineage(rows.repartitionByRange(parts, *order).withColumn("rng", F.spark_partition_id()), "chat-ranges")
    # Equal rows fall into one range, next to each other.
    inside = Window.partitionBy("rng", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "content")
    again = F.lag(F.struct("turn", "content")).over(inside).eqNullSafe(F.struct("turn", "content"))
    distinct = ranged.withColumn("again", again).where(~F.col("again")).drop("again")
    placed = _carried(distinct, {"pos": F.lit(1).cast("long")})
    digest = F.md5(F.concat_ws("|", F.col("pos").cast("string"), "content"))
    lanes = {lane: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k, lane in enumerate(LANES)}
    return cut_lineage(_carried(cut_lineage(placed.drop("turns"), "chat-positions"), lanes), "chat-turns")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` of conversations that are no proper prefix of another, one of each set of equal ones."""
    ends = turns.where(F.col("pos") == F.col("turns")).groupBy("turns", *LANES).agg(F.min("conv_id").alias("conv_id"))
    inner = turns.where(F.col("pos") < F.col("turns")).groupBy("pos", *LANES).agg(F.count(F.lit(1)).alias("seen"))
    return ends.join(inner.withColumnRenamed("pos", "turns"), ["turns", *LANES], "left_anti").select("conv_id")


def render(turns: DataFrame, kept: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """``(conv_id, part, turns, text)`` of the conversations in ``kept``."""
    keys = turns.groupBy("conv_id", "rng").agg(F.count(F.lit(1)).alias("n"))
    chosen = keys.join(kept.select(F.col("conv_id").alias("k_id")), F.col("conv_id").eqNullSafe(F.col("k_id")), "left_semi")
    chosen = chosen.select(F.col("conv_id").alias("k_id"), F.col("rng").alias("k_rng"))
    picked = turns.join(chosen, (F.col("rng") == F.col("k_rng")) & F.col("conv_id").eqNullSafe(F.col("k_id")), "left_semi")
    line = F.concat(
        F.lit(TURN_START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(TURN_END + "\n")
    )
    part = F.floor((F.col("pos") - 1) / turns_per_part)
    grouped = picked.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return grouped.select("conv_id", "part", F.size("lines").cast("long").alias("turns"), F.array_join("lines.line", "").alias("text"))


def format_chats(conversations: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    turns = hashed_turns(conversations)
    return render(turns, maximal_conversations(turns), turns_per_part)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH told AS (
  SELECT DISTINCT conv_id, turn, role, text,
         md5(concat(coalesce('1' || role, '0'), chr(31), coalesce('1' || text, '0'))) AS content FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, content) AS pos FROM told),
whole AS (SELECT conv_id, list(content ORDER BY pos) AS turns FROM placed GROUP BY conv_id),
inner_prefixes AS (SELECT DISTINCT array_to_string(turns[1:k], '') AS p FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM whole)),
kept AS (
  SELECT min(conv_id) AS conv_id FROM (SELECT conv_id, array_to_string(turns, '') AS p FROM whole)
  WHERE p NOT IN (SELECT p FROM inner_prefixes) GROUP BY p)
SELECT placed.conv_id, ((pos - 1) // {TURNS_PER_PART})::BIGINT AS part, count(*)::BIGINT AS turns,
       string_agg(concat('{TURN_START}', coalesce(role, 'unknown'), chr(10), coalesce(text, ''), '{TURN_END}', chr(10)), '' ORDER BY pos) AS text
FROM placed JOIN kept ON placed.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY 1, 2
"""
