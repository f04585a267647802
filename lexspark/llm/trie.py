"""Conversation prefix trie, folded bottom-up by time-forward processing.

A node stands for one distinct sequence of first turns. Its key is ``(conv_id, depth)`` with the smallest conversation that
starts so; a parent is the node one turn shorter. Prefixes are told apart by four running sums of 32-bit lanes of an MD5 over
(position, role, text), so a node is one group of an aggregation, and a parent's sums are a node's sums less its last turn.

Subtree totals (leaves, saved bytes) flow from nodes to parents. Nodes are sorted in reverse level order, deepest first, and
every node sends its total ahead to the place of its parent in that order, through a priority queue that spills sorted files
(``ForwardQueue``). A shard is a subtree of at most ``shard_rows`` turn rows, so a whole subtree lies in one task and one pass
folds it; groups of equal or alike conversations above that size only make the tree above the shards larger. This upper tree
has at most (rows / shard_rows) nodes a level. It takes the totals of the shard roots, summed by parent before, and is folded
likewise, in bands of levels from the deepest up; more than ``MAX_BANDS`` bands are never made. ``shard_rows`` is a share
of the rows, a quarter of an even partition, and at least ``MIN_SHARD_ROWS``.

A node's list of conversations that end there may be a third of all, so its digest is made in two steps: range partitions in
the order of (node, conversation) join ids into pieces, and a second pass, sorted alike, feeds the pieces of a node to SHA-256.

Defined cases: turns order by number, null first, then by role, then by text; a null role or text is empty; a repeated row is
a turn of its own; rows without a conversation id belong to no conversation; an empty table has no trie, not even a root;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.materialize import cut_lineage
from lexspark.llm.common import table

LANES = [f"lane{k}" for k in range(4)]
UP = [f"up{k}" for k in range(4)]
MIN_SHARD_ROWS = 64
LEVELS_PER_BAND, MAX_BANDS = 4096, 64
QUEUE_ITEMS = 200_000
IDS_PER_PIECE = 400


class ForwardQueue:
    """Messages ``(-depth, -conv_id, leaves, saved, children)`` in order of their receiver; beyond ``limit`` they spill.

    A spilled file is a sorted run read back in blocks, so memory holds ``limit`` messages and one block a file.
    """

    RECORD = struct.Struct("<5q")

    def __init__(self, limit: int = QUEUE_ITEMS):
        self.limit, self.held, self.spilled, self.folder = limit, [], [], None

    def send(self, message: tuple[int, int, int, int, int]) -> None:
        heapq.heappush(self.held, message)
        if len(self.held) > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory()
        path = os.path.join(self.folder.name, f"run{len(os.listdir(self.folder.name))}")
        with open(path, "wb") as file:
            for message in sorted(self.held):
                file.write(self.RECORD.pack(*message))
        self.held = []
        run = self._read(path)
        heapq.heappush(self.spilled, (next(run), len(os.listdir(self.folder.name)), run))

    def _read(self, path: str) -> Iterator[tuple]:
        with open(path, "rb") as file:
            while block := file.read(self.RECORD.size * 1024):
                yield from self.RECORD.iter_unpack(block)
        os.truncate(path, 0)

    def receive(self, receiver: tuple[int, int]) -> tuple[int, int, int]:
        """Sums of ``(leaves, saved, children)`` sent to ``receiver``; receivers ask in ascending order."""
        leaves = saved = children = 0
        while self.held and self.held[0][:2] == receiver:
            message = heapq.heappop(self.held)
            leaves, saved, children = leaves + message[2], saved + message[3], children + message[4]
        while self.spilled and self.spilled[0][0][:2] == receiver:
            message, number, run = self.spilled[0]
            leaves, saved, children = leaves + message[2], saved + message[3], children + message[4]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.spilled)
            else:
                heapq.heapreplace(self.spilled, (following, number, run))
        return leaves, saved, children

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


def fold(stream: Iterator[pa.RecordBatch], queue_items: int = QUEUE_ITEMS) -> Iterator[pa.RecordBatch]:
    """Nodes of whole (sub)trees in reverse level order, with ``leaves, saved, children`` completed.

    On arrival these hold what came from outside of the task, and the node's own bytes in ``saved``. ``inside`` says
    whether the parent is in this task too.
    """
    queue = ForwardQueue(queue_items)
    try:
        for batch in stream:
            names = ("conv_id", "depth", "parent_conv_id", "inside", "leaves", "saved", "children")
            done = []
            for conv_id, depth, parent, inside, leaves, saved, children in zip(*(batch.column(n).to_pylist() for n in names)):
                more = queue.receive((-depth, -conv_id))
                leaves, saved, children = leaves + more[0], saved + more[1], children + more[2]
                leaves = leaves if children else 1
                if inside:
                    queue.send((1 - depth, -parent, leaves, saved, 1))
                done.append((leaves, saved, children))
            columns = list(zip(*done)) or [(), (), ()]
            totals = dict(zip(("leaves", "saved", "children"), columns))
            yield pa.RecordBatch.from_arrays(
                [pa.array(totals[n], pa.int64()) if n in totals else batch.column(n) for n in batch.schema.names], batch.schema.names
            )
    finally:
        queue.close()


def numbered(conversations: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Turns with ``rng``, position ``pos`` from 1 and the number of ``turns``; and the ranges that conversations span.

    Rows are range-partitioned in turn order and numbered inside a range. All ranges but the first can go on with one
    conversation of the range before, so the table of what to carry over has fewer rows than twice the number of ranges,
    and is broadcast for that reason.
    """
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ranged = rows.repartitionByRange(parts, "conv_id", *order).withColumn("rng", F.spark_partition_id())
    ranged = cut_lineage(ranged, f"{label}-ranges")
    sizes = ranged.groupBy("conv_id", "rng").agg(F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy("conv_id")
    before = each.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.select(
        "conv_id", "rng", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(each).alias("total"),
        F.count(F.lit(1)).over(each).alias("ranges"),
    ).where("ranges > 1").drop("ranges")
    spans = cut_lineage(spans, f"{label}-spans")
    inside = Window.partitionBy("rng", "conv_id")
    placed = ranged.withColumn("pos", F.row_number().over(inside.orderBy(*order)).cast("long"))
    placed = placed.withColumn("turns", F.count(F.lit(1)).over(inside)).join(F.broadcast(spans), ["conv_id", "rng"], "left")
    placed = placed.withColumns({"pos": F.col("pos") + F.coalesce("base", F.lit(0)), "turns": F.coalesce("total", "turns")})
    return placed.drop("base", "total"), spans


def _prefixes(conversations: DataFrame) -> DataFrame:
    """``(conv_id, depth, turns, bytes, lane0..3, up0..3)`` of every turn: sums up to it and up to the turn before."""
    placed, spans = numbered(conversations, "trie")
    # The lengths keep (role, text) pairs apart that join to the same string.
    told = F.md5(F.concat_ws("|", "pos", F.char_length("role"), "role", "text"))
    own = {f"own{k}": F.conv(F.substring("told", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)}
    hashed = placed.select("conv_id", "rng", F.col("pos").alias("depth"), "turns", F.octet_length("text").cast("long").alias("bytes"), told.alias("told"))
    hashed = cut_lineage(hashed.withColumns(own).drop("told"), "trie-turns")
    keys = spans.select("conv_id", "rng")
    sums = hashed.join(F.broadcast(keys), ["conv_id", "rng"]).groupBy("conv_id", "rng").agg(*[F.sum(f"own{k}").alias(f"s{k}") for k in range(4)])
    before = Window.partitionBy("conv_id").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("conv_id", "rng", *[F.sum(f"s{k}").over(before).alias(f"c{k}") for k in range(4)])
    running = Window.partitionBy("rng", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = hashed.withColumns({lane: F.sum(f"own{k}").over(running) for k, lane in enumerate(LANES)})
    joined = joined.join(F.broadcast(carry), ["conv_id", "rng"], "left")
    lanes = {lane: F.col(lane) + F.coalesce(f"c{k}", F.lit(0)) for k, lane in enumerate(LANES)}
    whole = joined.withColumns(lanes).withColumns({up: F.col(LANES[k]) - F.col(f"own{k}") for k, up in enumerate(UP)})
    return cut_lineage(whole.select("conv_id", "depth", "turns", "bytes", *LANES, *UP), "trie-prefixes")


def _pieces(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(depth, lanes, conv_id)`` rows to pieces of at most ``IDS_PER_PIECE`` joined ids."""
    names = ["depth", *LANES]

    def batch_of(pieces):
        columns = list(zip(*pieces))
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*names, "first", "n", "ids"])

    node, ids, ready = None, [], []
    for batch in stream:
        for *key, conv_id in zip(*(batch.column(n).to_pylist() for n in [*names, "conv_id"])):
            if ids and (key != node or len(ids) == IDS_PER_PIECE):
                ready.append((*node, ids[0], len(ids), ",".join(map(str, ids))))
                ids = []
            node = key
            ids.append(conv_id)
        if ready:
            yield batch_of(ready)
            ready = []
    if ids:
        yield batch_of([(*node, ids[0], len(ids), ",".join(map(str, ids)))])


def _digests(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id to one SHA-256 a node."""
    names = ["depth", *LANES]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()])], [*names, "ends_sha256"])

    node, state, ready = None, None, []
    for batch in stream:
        for *key, ids in zip(*(batch.column(n).to_pylist() for n in [*names, "ids"])):
            if key != node:
                if node is not None:
                    ready.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if ready:
            yield batch_of(ready)
            ready = []
    if node is not None:
        yield batch_of([(*node, state.hexdigest())])


def _end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, lanes, ends_sha256)`` of rows ``(depth, lanes, conv_id)``."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["depth", *LANES]
    longs = ", ".join(f"{c} bigint" for c in key)
    ranged = ends.select(*key, "conv_id").repartitionByRange(parts, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    pieces = ranged.mapInArrow(_pieces, f"{longs}, first bigint, n bigint, ids string")
    return pieces.repartition(parts, *key).sortWithinPartitions(*key, "first").mapInArrow(_digests, f"{longs}, ends_sha256 string")


def _fold(nodes: DataFrame, queue_items: int) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold(stream, queue_items)

    return nodes.sortWithinPartitions(F.desc("depth"), F.desc("conv_id")).mapInArrow(run, nodes.schema)


def _with_messages(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Add what children outside of the task sent; they are summed by receiver first, of which the root has most."""
    to = messages.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.sum("leaves").alias("m_leaves"), F.sum("saved").alias("m_saved"), F.count(F.lit(1)).alias("m_children")
    )
    joined = nodes.join(to, ["conv_id", "depth"], "left")
    added = {c: (F.col(c) + F.coalesce(f"m_{c}", F.lit(0))).cast("long") for c in ("leaves", "saved", "children")}
    return joined.withColumns(added).select(*nodes.columns)


def prefix_trie(
    conversations: DataFrame, turnless: DataFrame | None = None, shard_rows: int | None = None,
    levels_per_band: int = LEVELS_PER_BAND, queue_items: int = QUEUE_ITEMS,
) -> DataFrame:
    """One row a node of the trie over ``(conv_id, turn, role, text)``; ``turnless`` has ids of conversations without turns.

    Columns: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    spark = conversations.sparkSession
    rows = _prefixes(conversations)
    zero = [F.lit(0).cast("long").alias(c) for c in (*LANES, *UP)]
    empty = spark.createDataFrame([], "conv_id long") if turnless is None else turnless.select("conv_id")
    empty = empty.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("turns"), *zero)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = shard_rows or max(MIN_SHARD_ROWS, rows.count() // (4 * parts))

    convs = rows.where("depth = 1").select("conv_id").unionByName(empty.select("conv_id"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), *zero, "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("heavy"))
    grouped = rows.groupBy("depth", *LANES).agg(
        *[F.max(up).alias(up) for up in UP], F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
        (F.sum(F.col("turns") - F.col("depth") + 1) > size).alias("heavy"),
    )
    nodes = cut_lineage(grouped.unionByName(root), "trie-nodes")

    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(lane).alias(up) for lane, up in zip(LANES, UP)],
                         F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("parent_heavy"))
    linked = nodes.join(above, ["depth", *UP], "left")
    ends = rows.where("depth = turns").select("depth", *LANES, "conv_id").unionByName(empty.select("depth", *LANES, "conv_id"))
    linked = linked.join(_end_digests(ends), ["depth", *LANES], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "heavy", "parent_heavy", *LANES,
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), F.lit(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.lit(0).cast("long").alias("children"),
    )
    linked = cut_lineage(linked, "trie-linked")

    # The rows of a subtree only fall on the way down, so a conversation leaves the upper tree at one depth: its shard.
    upper = linked.where("heavy").select("depth", *LANES)
    stay = rows.select("conv_id", "depth", *LANES).join(upper, ["depth", *LANES], "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).alias("levels"))
    shards = rows.select("conv_id", "depth", *LANES).join(stay, "conv_id", "left").where(F.col("depth") == F.coalesce("levels", F.lit(0)) + 1)
    shards = shards.select("conv_id", F.xxhash64("depth", *LANES).alias("shard"))
    lower = linked.where(~F.col("heavy")).withColumn("inside", ~F.col("parent_heavy")).drop(*LANES, "heavy", "parent_heavy")
    folded = _fold(lower.join(shards, "conv_id").repartition(parts, "shard").drop("shard"), queue_items)
    folded = cut_lineage(folded, "trie-shards")

    upper = linked.where("heavy").drop(*LANES, "heavy", "parent_heavy")
    upper = cut_lineage(_with_messages(upper, folded.where(~F.col("inside"))), "trie-upper")
    results, deepest = [folded], upper.agg(F.max("depth")).first()[0]
    levels = max(levels_per_band, -(-(deepest or 0) // MAX_BANDS))
    pending = None
    for lowest in range((deepest or 0) // levels * levels, -1, -levels):
        band = upper.where(F.col("depth").between(lowest, lowest + levels - 1))
        if pending is not None:
            band = _with_messages(band, pending)
        band = band.withColumn("inside", F.col("depth") > lowest)
        pending = cut_lineage(_fold(band.repartition(1), queue_items), "trie-band")
        results.append(pending)
        pending = pending.where(F.col("depth") == lowest)
    whole = results[0]
    for part in results[1:]:
        whole = whole.unionByName(part)
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def _head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations of the contract, ``(conv_id, turn, role, text)``, and the ids of those left without turns.

    At most eight turns of a conversation are copied, to at most four others.
    """
    placed = cut_lineage(numbered(conversations, "rebuild")[0].select("conv_id", "pos", "turns", "role", "text"), "rebuild-turns")
    convs = placed.where("pos = 1").select("conv_id", "turns", _head_length(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    convs = cut_lineage(convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_turns", F.lit(0)))), "rebuild-convs")
    heads = placed.where("pos <= 8").select(F.col("conv_id").alias("base"), F.col("pos").alias("turn"), "role", "text")
    copied = convs.where("head > 0").join(heads, "base").where(F.col("turn") <= F.col("head")).select("conv_id", "turn", "role", "text")
    own = placed.select("conv_id", "pos", "role", "text").join(convs.select("conv_id", "h", "head"), "conv_id").where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("turn"), "role", "text")
    return copied.unionByName(own), convs.where("head = 0 AND turns <= h").select("conv_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, turnless = _rebuilt(table(spark, sf_dir, "conversations"))
    return prefix_trie(turns, turnless)


ORACLE = """
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda u, i: xor(u >> 1, (u & 1) * 3988292384::BIGINT))),
           4294967295::BIGINT) % 9 AS h
  FROM placed WHERE pos = 1),
rebuilt AS (
  SELECT c.conv_id, p.pos AS k, 0 AS part, role, text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.pos <= c.h
  UNION ALL SELECT c.conv_id, p.pos, 1, role, text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.pos > c.h),
turn_lists AS (
  SELECT convs.conv_id, coalesce(t, []) AS t FROM convs LEFT JOIN (
    SELECT conv_id, list(struct_pack(c := md5(concat(length(role), '|', role, text)), b := strlen(text)) ORDER BY part, k) AS t FROM rebuilt GROUP BY conv_id
  ) USING (conv_id)),
steps AS (
  SELECT conv_id, d, len(t) AS n, CASE WHEN d = 0 THEN 0 ELSE t[d].b END AS b,
         md5(array_to_string(list_transform(t[1:d], lambda x: x.c), ',')) AS key,
         CASE WHEN d > 0 THEN md5(array_to_string(list_transform(t[1:d - 1], lambda x: x.c), ',')) END AS up
  FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM turn_lists)),
nodes AS (
  SELECT key, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM steps GROUP BY key, d),
children AS (SELECT up AS key, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
sized AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (key, d)),
subtrees AS (
  SELECT s.key, s.d, count(*) FILTER (v.n_children = 0) AS n_leaves, sum(v.own) AS saved_tokens
  FROM sized v JOIN steps s ON s.conv_id = v.conv_id AND s.d <= v.d GROUP BY 1, 2)
SELECT sized.conv_id, sized.d::BIGINT AS depth, p.conv_id AS parent_conv_id, sized.n_convs::BIGINT AS n_convs, sized.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sized.ends_sha256
FROM sized JOIN subtrees USING (key, d) LEFT JOIN nodes p ON p.key = sized.up AND p.d = sized.d - 1
"""
