"""Periodic runs of words inside documents, by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period ``q`` and at least ``max(min_words, repeats * q)`` words that neither
neighbour extends. Each of its words occurs at least ``repeats`` times in it. So a word that occurs less often inside the
current segment is in no run: it splits the segment, and the parts are counted anew until nothing changes or a part is too
short. What survives is scanned lag by lag. A run of period ``q`` holds a stretch of matching pairs (words ``q`` apart) at
least twice as long as ``step``, so two consecutive multiples of ``step`` are such pairs: only those are compared, which
makes m log m comparisons for all lags of m words. Where two meet, the stretch between is compared word by word and then
extended. Lags rise, so the first lag that finds a stretch is its smallest period; multiples of it are recognised by the
runs that already cover them.

Documents are independent: the scan is one narrow pass, batches are cut by bytes, and a task holds the words of one batch,
or of one document longer than a batch.

Defined cases: words are runs of anything but the six ASCII blanks; a null or empty text has no words and no runs; rows
with equal ids are results of their own; a null id passes through; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import table

MIN_WORDS, REPEATS = 24, 3
BATCH_BYTES = 1 << 21
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
# Places inside a stretch, as shares of it, that are compared before all of it is.
PROBES = (0.5, 0.25, 0.75, 0.125, 0.375, 0.625, 0.875, 0.0625, 0.3125, 0.6875)


def surviving_segments(ids: np.ndarray, low: np.ndarray, high: np.ndarray, min_words: int, repeats: int) -> list[tuple[int, int]]:
    """Split the segments ``[low, high)`` at words rarer than ``repeats`` in them, again and again until stable."""
    stable: list[tuple[int, int]] = []
    n_ids = int(ids.max(initial=0)) + 1
    while True:
        long_enough = high - low >= min_words
        low, high = low[long_enough], high[long_enough]
        if not len(low):
            return stable
        size = high - low
        segment = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(segment)) - np.repeat(np.cumsum(size) - size, size) + low[segment]
        _, inverse, counts = np.unique(segment * n_ids + ids[at], return_inverse=True, return_counts=True)
        rare = counts[inverse] < repeats
        split = np.zeros(len(low), bool)
        split[segment[rare]] = True
        stable += zip(low[~split].tolist(), high[~split].tolist())
        kept = ~rare & split[segment]
        at, segment = at[kept], segment[kept]
        if not len(at):
            return stable
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(segment) != 0)]))
        low, high = at[begins], at[np.append(begins[1:], len(at)) - 1] + 1


def _matches(left: np.ndarray, right: np.ndarray) -> int:
    """Number of equal leading elements, found in chunks that double."""
    done, chunk, most = 0, 64, min(len(left), len(right))
    while done < most:
        unequal = np.flatnonzero(left[done:done + chunk] != right[done:done + chunk])
        if len(unequal):
            return min(done + int(unequal[0]), most)
        done, chunk = done + chunk, 2 * chunk
    return most


def lag_scan(words: np.ndarray, min_words: int, repeats: int) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of one segment."""
    m, found = len(words), []
    reach = np.zeros(m, np.int64)  # end of the furthest known run that contains a word
    for q in range(1, m // repeats + 1):
        step = (max(min_words, repeats * q) - q) // 2
        at = np.arange(0, m - q, step)
        hit = words[at] == words[at + q]
        at = at[:-1][hit[:-1] & hit[1:]]
        at = at[reach[at] <= at + step + q]
        for share in PROBES if len(at) else ():
            place = at + int(share * step)
            at = at[words[place] == words[place + q]]
        for s in at.tolist():
            if reach[s] > s + step + q or _matches(words[s:s + step + 1], words[s + q:s + q + step + 1]) <= step:
                continue
            right = s + _matches(words[s:m - q], words[s + q:])
            left = s - _matches(words[:s][::-1], words[q:s + q][::-1])
            if right + q - left >= max(min_words, repeats * q):
                found.append((left, right + q - left, q))
                np.maximum(reach[left:right + q], right + q, out=reach[left:right + q])
    return found


def runs_of(texts: list[list[bytes]], min_words: int = MIN_WORDS, repeats: int = REPEATS) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words, by start, then period."""
    if repeats < 3:
        raise ValueError("a run needs its period three times, or the steps of the scan would miss some")
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), np.int64)
    high = np.cumsum([len(words) for words in texts], dtype=np.int64)
    low = high - np.array([len(words) for words in texts], np.int64)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in surviving_segments(ids, low, high, min_words, repeats):
        text = int(np.searchsorted(high, a, side="right"))
        runs[text] += [(a - int(low[text]) + start, length, q) for start, length, q in lag_scan(ids[a:b], min_words, repeats)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that only repeat the first period of a run."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, q in runs:
            kept[start + q:start + length] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(words)


def periodic_runs(rows: DataFrame, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of rows ``(doc_id, text)``; ``collapsed`` keeps one period of each run."""

    def batches(column: pa.Array) -> Iterator[list[list[bytes]]]:
        held, size = [], 0
        for value in column:
            text = value.as_py() or b""
            if held and size + len(text) > BATCH_BYTES:
                yield held
                held, size = [], 0
            held.append(text.split())
            size += len(text)
        if held:
            yield held

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        for batch in stream:
            at = 0
            for texts in batches(batch.column("text").cast(pa.binary())):
                runs = runs_of(texts, min_words, repeats)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, len(texts)), pa.array([len(w) for w in texts], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs], kind),
                    pa.array([_collapsed(w, r) for w, r in zip(texts, runs)], pa.binary()),
                ], ["doc_id", "n_words", "runs", "collapsed"])
                at += len(texts)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, n_words bigint, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def _planted(rows: DataFrame) -> DataFrame:
    """The texts of the contract: in a tenth of the documents the words from one on repeat with a period. Both follow from
    the checksum of the decimal id; a document without an id stays as it is."""

    def plant(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
                if h is not None and h % 10 == 0 and (words := (text.as_py() or b"").split()):
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts.append(b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]))
                else:
                    texts.append(text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return rows.select("doc_id", "text").mapInArrow(plant, "doc_id bigint, text binary")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_planted(table(spark, sf_dir, "documents")))
    # Runs come by start, then period, so that the first of equal exponents is the one wanted.
    best = F.reduce(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
        lambda top, run: F.when(run["length"] * top["period"] > top["length"] * run["period"], run).otherwise(top),
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
