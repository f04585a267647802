"""Benchmark decontamination by CGK random-walk embedding and bit sampling.

A document leaks an item if a window of its words, as long as the item, lies within ``MAX_EDITS`` of the item's words in
edit distance (words are lower-cased runs of letters, digits and underscores). Windows are compared through the CGK
embedding: a random walk that repeats or advances over the words turns edit distance into Hamming distance, and tables
of a few sampled steps of it collide for near pairs. The number of tables is fitted so that simulated pairs at the
distance limit reach ``TARGET_RECALL``; if ``MAX_TABLES`` do not reach it, as with odd items, windows meet all items
with enough of their pairs instead. Every candidate is verified by the exact distance. An item-sized window within
e edits keeps all but 2e of the item's neighbouring word pairs, so windows with fewer known pairs are passed over
before the walk, which loses none.

The items are the stated query set: they are read in blocks of ``BLOCK_BYTES``, each block is shipped with the tasks,
and documents meet every block in place, so texts are never shuffled.

Defined cases: null and empty texts leak nothing; items without an id are passages like others and reported under a null id; items under ``MIN_ITEM_WORDS`` words are no passages and never leak;
equal items are reported under each id; equal documents alike; empty tables give no leaks; other columns are carried
along; windows never cross documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import release_memory, table

MAX_EDITS = 0.2
MIN_ITEM_WORDS = 5
TARGET_RECALL = 0.99
MAX_TABLES = 256
SAMPLED_STEPS = 3
TABLES_PER_WALK = 4
SIMULATED_PAIRS = 400
BLOCK_BYTES = 4_000_000
BATCH_WORDS = 250_000
BATCH_ROWS = 1_000
BATCH_WINDOWS = 2_000
WORDS = re.compile(r"\w+")
PAD = -1


def max_edits(size: int) -> int:
    return int(MAX_EDITS * size)


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of every row of ``a`` to the same row of ``b``."""
    row = np.broadcast_to(np.arange(b.shape[1] + 1), (len(a), b.shape[1] + 1)).copy()
    steps = np.arange(b.shape[1] + 1)
    for i in range(a.shape[1]):
        fresh = np.empty_like(row)
        fresh[:, 0] = i + 1
        fresh[:, 1:] = np.minimum(row[:, :-1] + (b != a[:, i:i + 1]), row[:, 1:] + 1)
        # Insertions run along the row: a running minimum after taking the column number off.
        row = np.minimum.accumulate(fresh - steps, axis=1) + steps
    return row[:, -1]


class Embedding:
    """Tables of sampled steps of CGK walks over rows of word numbers."""

    def __init__(self, n_tables: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.steps = rng.random((n_tables, SAMPLED_STEPS))  # as shares of two item lengths, the mean length of a walk
        self.mix = rng.integers(1, 1 << 62, SAMPLED_STEPS, dtype=np.int64) | 1

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """One code per table and row. All walks take a step at once; what they read is kept for the tables."""
        n, size = rows.shape
        padded = np.concatenate([rows, np.full((n, 1), PAD, rows.dtype)], axis=1)
        steps = np.minimum((self.steps * 2 * size).astype(int), 2 * size - 1)
        walks = len(steps) // TABLES_PER_WALK
        salts = np.random.default_rng(13).integers(1, 1 << 62, (walks, 1), dtype=np.uint64)
        each, scale = np.arange(n), np.uint64(0x9E3779B97F4A7C15)
        at, read = np.zeros((walks, n), np.int64), np.empty((2 * size, walks, n), np.int64)
        for j in range(2 * size):
            read[j] = word = padded[each, at]
            # One pseudo-random bit per walk, step and word decides whether the walk advances.
            bits = (word.astype(np.uint64) ^ (salts * np.uint64(2 * j + 1))) * scale
            bits = (bits ^ (bits >> np.uint64(32))) * scale >> np.uint64(63)
            at = np.minimum(at + bits.astype(np.int64), size)
        walk = np.arange(len(steps)) // TABLES_PER_WALK
        return sum((read[steps[:, k], walk] + 2) * self.mix[k] for k in range(SAMPLED_STEPS))


def fit_tables(items: list[np.ndarray], n_words: int, target: float = TARGET_RECALL) -> int | None:
    """Number of tables at which pairs at the distance limit collide often enough, if any; from ``SIMULATED_PAIRS`` pairs."""
    rng = np.random.default_rng(11)
    trial, pairs, hits = Embedding(MAX_TABLES), {}, []
    for n in range(SIMULATED_PAIRS):
        item = items[n % len(items)]
        changed = item.tolist()
        for _ in range(max_edits(len(item))):
            at, kind = int(rng.integers(len(changed))), int(rng.integers(3))
            new = int(rng.integers(n_words + 1))
            changed[at:at + (kind != 0)] = [] if kind == 1 and len(changed) > 1 else [new]
        pairs.setdefault(len(item), []).append((item, (changed + [0] * len(item))[: len(item)]))
    for size, same in pairs.items():
        a, b = (np.array([pair[k] for pair in same], np.int64) for k in range(2))
        # Cutting the end to the window's length can take a pair over the limit; such pairs are not asked for.
        near = edit_distances(a, b) <= max_edits(size)
        hits += list((trial.codes(a[near]) == trial.codes(b[near])).T)
    if not hits:
        return TABLES_PER_WALK
    found = np.logical_or.accumulate(np.array(hits), axis=1).mean(axis=0)
    enough = np.flatnonzero(found >= target)
    if not len(enough):
        return None
    return -(-(int(enough[0]) + 1) // TABLES_PER_WALK) * TABLES_PER_WALK


class ItemBlock:
    """One block of benchmark items, ready to scan texts."""

    def __init__(self, items: list[tuple[int, str]]):
        split = [(item_id, WORDS.findall((text or "").lower())) for item_id, text in items]
        split = [(item_id, ws) for item_id, ws in split if len(ws) >= MIN_ITEM_WORDS]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        self.width = len(self.number) + 1
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, ws in split:
            by_size.setdefault(len(ws), []).append((item_id, np.array([self.number[w] for w in ws], np.int64)))
        every = [a for same in by_size.values() for _, a in same]
        pairs = [a[:-1] * self.width + a[1:] for a in every]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        tables = fit_tables(every, self.width) if every else None
        self.embedding = Embedding(tables) if tables else None
        self.sizes = {}
        for size, same in sorted(by_size.items()):
            rows = np.stack([a for _, a in same])
            codes = self.embedding.codes(rows) if self.embedding else np.zeros((1, len(rows)), np.int64)
            order = np.argsort(codes, axis=1, kind="stable")
            own = np.zeros(len(self.pairs), bool)
            own[np.searchsorted(self.pairs, (rows[:, :-1] * self.width + rows[:, 1:]).ravel())] = True
            self.sizes[size] = ([i for i, _ in same], rows, np.take_along_axis(codes, order, axis=1), order, own)

    def _known_pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where neighbouring words are a pair of some item, and which pair."""
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        keys = ids[both] * self.width + ids[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        known = self.pairs[at] == keys
        return both[known], at[known]

    def _candidates(self, size: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items of one size that share a table's code."""
        _, rows, codes, order, _ = self.sizes[size]
        if self.embedding is None:
            return self._sharing_pairs(rows, windows)
        found = []
        for own, sorted_codes, item in zip(self.embedding.codes(windows), codes, order):
            low, high = np.searchsorted(sorted_codes, own, "left"), np.searchsorted(sorted_codes, own, "right")
            hit = np.flatnonzero(high > low)
            n = high[hit] - low[hit]
            at = np.repeat(low[hit] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            found.append(np.repeat(hit, n) * len(rows) + item[at])
        both = np.unique(np.concatenate(found))
        return both // len(rows), both % len(rows)

    def _sharing_pairs(self, rows: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All windows and items that share as many neighbouring pairs as the distance limit leaves; loses none."""
        size = rows.shape[1]
        held = np.unique((rows[:, :-1] * self.width + rows[:, 1:]) * len(rows) + np.arange(len(rows))[:, None])
        pairs, items = held // len(rows), held % len(rows)
        found = []
        for at, window in enumerate(windows):
            asked = window[:-1] * self.width + window[1:]
            low, high = np.searchsorted(pairs, asked, "left"), np.searchsorted(pairs, asked, "right")
            n = high - low
            item = items[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            near = np.flatnonzero(np.bincount(item, minlength=len(rows)) >= size - 1 - 2 * max_edits(size))
            found.append(at * len(rows) + near)
        both = np.concatenate(found)
        return both // len(rows), both % len(rows)

    def scan(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """``(text, item_id, distance, first word, words)`` of the nearest window of every leaked item."""
        if not self.sizes:
            return []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        held, owners, total = [], [], 0
        get = self.number.get
        for i, text in enumerate(texts):
            ws = WORDS.findall(text.lower())
            held.append(np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)))
            owners.append(i)
            total += len(ws)
            if total >= BATCH_WORDS or i + 1 == len(texts):
                self._scan_words(held, owners, best)
                held, owners, total = [], [], 0
        return [(text, item, *rest) for (text, item), rest in best.items()]

    def _scan_words(self, held: list[np.ndarray], owners: list[int], best: dict) -> None:
        ids = np.concatenate(held)
        ends = np.cumsum([len(h) for h in held])
        if not len(ids):
            return
        at, pair = self._known_pairs(ids)

        def before(known: np.ndarray) -> np.ndarray:
            marks = np.zeros(len(ids), np.int32)
            marks[known] = 1
            marks[ends[ends > 0] - 1] = 0
            return np.concatenate([[0], np.cumsum(marks, dtype=np.int32)])

        upto = before(at)
        for size, (item_ids, rows, _, _, own) in self.sizes.items():
            if len(ids) < size:
                continue
            least = size - 1 - 2 * max_edits(size)
            starts = np.flatnonzero(upto[size - 1:len(ids)] - upto[:len(ids) - size + 1] >= least)
            if not len(starts):
                continue
            own_upto = before(at[own[pair]])  # pairs of the items of this size alone
            starts = starts[own_upto[starts + size - 1] - own_upto[starts] >= least]
            owner = np.searchsorted(ends, starts, side="right")
            whole = starts + size <= ends[owner]
            starts, owner = starts[whole], owner[whole]
            for low in range(0, len(starts), BATCH_WINDOWS):
                first = starts[low:low + BATCH_WINDOWS]
                windows = ids[first[:, None] + np.arange(size)]
                which, item = self._candidates(size, windows)
                distance = edit_distances(windows[which], rows[item])
                for k in np.flatnonzero(distance <= max_edits(size)):
                    doc = int(owner[low + which[k]])
                    key = (owners[doc], item_ids[item[k]])
                    start = int(first[which[k]]) - (int(ends[doc - 1]) if doc else 0)
                    best[key] = min(best.get(key, (size + 1, 0, size)), (int(distance[k]), start, size))


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[ItemBlock]:
    """The items in blocks of about ``block_bytes``, one at a time."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    for block in range(n_blocks):
        chosen = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        yield ItemBlock(sorted(map(tuple, chosen.collect()), key=lambda item: (item[0] is None, item[0] or 0, item[1])))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``BATCH_ROWS`` at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(low, BATCH_ROWS)
    release_memory()


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [(b or b"").decode("utf-8", "replace") for b in batch.column("text").cast(pa.binary()).to_pylist()]


LEAK_SCHEMA = "doc_id long, item_id long, distance long, first_word long, n_words long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and leaked item, with the distance, first word and length of the nearest window."""
    names = [f.split()[0] for f in LEAK_SCHEMA.split(", ")]

    def scan_with(block: ItemBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _small(batches):
                doc_ids = batch.column("doc_id").to_pylist()
                rows = [(doc_ids[i], *rest) for i, *rest in block.scan(_texts(batch))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        return docs.select("doc_id", "text").mapInArrow(run, LEAK_SCHEMA)

    return reduce(DataFrame.unionByName, [scan_with(block) for block in item_blocks(benchmark, block_bytes)])


def drop_leaking(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that leak no item, with all their columns."""

    def keep_with(block: ItemBlock, rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _small(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[i for i, *_ in block.scan(_texts(batch))]] = False
                yield batch.filter(pa.array(clean))

        return rows.mapInArrow(run, rows.schema)

    return reduce(lambda rows, block: keep_with(block, rows), item_blocks(benchmark, block_bytes), docs)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
