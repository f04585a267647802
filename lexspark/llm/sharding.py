"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly, equal texts kept together.

Groups of equal texts are the items. Groups that hold more than a ``LARGE``-th of any total are items of their own;
all others are gathered by the hash of their text into ``LOTS`` lots, so the packing sees a bounded number of vectors
however many documents there are. Items are placed largest first, each on the shard whose residual capacity has the
highest dot product with it, among the shards that still have bytes for it. The law that holds is ``bytes``.

A large group is numbered in pieces by the hash of its ids, none over a ``LARGE``-th of the rows. It stays on one shard
if it has no more bytes than a shard's equal part. With more it cannot stay whole under the law, so its pieces are placed
one by one. ``tokens`` are the words of the text, which need no vocabulary.

Defined cases: a null text is grouped and measured as an empty one; an empty table gives no rows; equal rows are placed
alike and numbered in any order; rows without an id share one piece; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.materialize import cut_lineage
from lexspark.llm.common import table, words

N_SHARDS = 8
LOTS = 4096
LARGE = 1024
# Bytes a shard may hold above its equal part before the next one is tried.
SLACK = 0.002

MEASURES = ("size", "tokens", "rows")


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def pack(items: list[tuple[str, tuple[float, ...]]], n_shards: int) -> dict[str, int]:
    """Place vectors, given as shares of the totals, on shards of equal capacity."""
    residual = [[1.0 / n_shards] * len(MEASURES) for _ in range(n_shards)]
    placed = {}
    for name, vector in sorted(items, key=lambda x: (-sum(x[1]), x[0])):
        room = [s for s in range(n_shards) if residual[s][0] + SLACK / n_shards >= vector[0]]
        if room:
            best = max(room, key=lambda s: (sum(a * b for a, b in zip(vector, residual[s])), residual[s][0], -s))
        else:
            best = max(range(n_shards), key=lambda s: (residual[s][0], -s))
        placed[name] = best
        residual[best] = [r - v for r, v in zip(residual[best], vector)]
    return placed


class ShardPlan:
    """Where every group of equal texts goes. Fitted once over all documents; its size does not grow with them."""

    def __init__(self, docs: DataFrame, n_shards: int = N_SHARDS):
        spark = docs.sparkSession
        self.measured = cut_lineage(docs.select(
            "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.size(words(F.col("text"))).cast("long").alias("tokens"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            _key(F.col("text")).alias("key"),
        ), "shard-sizes")
        sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
        totals = self.measured.agg(*sums).first()
        total = [max(1, totals[m] or 0) for m in MEASURES]
        share = F.greatest(*[F.col(m) / t for m, t in zip(MEASURES, total)])
        groups = self.measured.groupBy("key").agg(*sums)
        # At most LARGE groups can hold over a LARGE-th of each measure.
        large = groups.where(share > 1.0 / LARGE).select(F.col("key").alias("__s_key"), F.ceil(share * LARGE).cast("long").alias("__s_pieces"), "size").collect()
        self.large = spark.createDataFrame([(r[0], r[1]) for r in large], "__s_key string, __s_pieces long")
        self.split = {r[0] for r in large if r["size"] * n_shards > total[0]}
        units = self._tag(self.measured, F.col("key")).groupBy("__s_unit").agg(*sums).collect()
        vectors: dict[str, list[float]] = {}
        for u in units:
            vector = vectors.setdefault(self._item(u["__s_unit"]), [0.0] * len(MEASURES))
            for i, m in enumerate(MEASURES):
                vector[i] += u[m] / total[i]
        placed = pack([(k, tuple(v)) for k, v in vectors.items()], n_shards)
        offset, rows = [0] * n_shards, []
        for u in sorted(units, key=lambda u: u["__s_unit"]):
            shard = placed[self._item(u["__s_unit"])]
            rows.append((u["__s_unit"], shard, offset[shard]))
            offset[shard] += u["rows"]
        self.places = spark.createDataFrame(rows, "__s_unit string, shard int, __s_offset long")

    def _item(self, unit: str) -> str:
        group = unit.split("/")[0]
        return unit if group in self.split else group

    def _tag(self, df: DataFrame, key: Column) -> DataFrame:
        lot = F.concat(F.lit("lot"), F.pmod(F.xxhash64(key), F.lit(LOTS)).cast("string"))
        piece = F.concat_ws("/", "__s_key", F.pmod(F.xxhash64("doc_id"), F.col("__s_pieces")).cast("string"))
        joined = df.join(F.broadcast(self.large), key == F.col("__s_key"), "left")
        return joined.withColumn("__s_unit", F.coalesce(F.when(F.col("__s_key").isNotNull(), piece), lot)).drop("__s_key", "__s_pieces")

    def slots(self) -> DataFrame:
        """Every document's measures, shard and place in it; numbers come from one window per unit and known offsets."""
        placed = self._tag(self.measured, F.col("key")).join(F.broadcast(self.places), "__s_unit")
        order = Window.partitionBy("__s_unit").orderBy("doc_id", "text_crc32", "size")
        return placed.withColumn("slot", F.col("__s_offset") + F.row_number().over(order) - 1).drop("__s_unit", "__s_offset")

    def assign(self, docs: DataFrame) -> DataFrame:
        """``docs`` with their shard, without moving a row: the plan is looked up in two bounded broadcast tables."""
        tagged = self._tag(docs.withColumn("__s_text", _key(F.col("text"))), F.col("__s_text"))
        places = self.places.drop("__s_offset").withColumnRenamed("shard", "__s_shard")
        return tagged.join(F.broadcast(places), "__s_unit").withColumn("shard", F.col("__s_shard")).select(*dict.fromkeys([*docs.columns, "shard"]))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = ShardPlan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return plan.slots().select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
