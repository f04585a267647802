"""Removal of long repeated strings by suffixes in buckets over a difference cover.

A byte goes if a string of ``LENGTH`` bytes around it also starts elsewhere in the corpus. The cover holds 12 residues
modulo 133 of which some pair has every difference. So two equal windows of ``LENGTH`` bytes, wherever they start, meet
at one of 133 shifts at two cover positions whose strings of ``LENGTH - 132`` bytes are equal too. The cover sample is
ranked first, as repeated or not. Only suffixes with a repeated sample in reach are then dealt to suffix buckets, sorted
one bucket at a time, and a suffix stays tied to a neighbour if all ``LENGTH`` bytes agree.

Copied stretches are folded before that. Texts are cut where eight bytes hash low, at most ``LENGTH`` positions apart, and a
stretch with all windows that begin in it is one key. Of equal stretches all are repeated, and one stands for all in what
follows: a window that equals one of a folded stretch equals the same window of the one that stands for it. So long copies
cost keys only where they end.

Equality is all that removal needs, so buckets are ranges of a 62-bit fingerprint of the bytes compared, with 16 more
bits of another one for the windows, and not of the alphabet: alphabetic order would have to carry 133 bytes and 12 ranks
with each suffix. Among 10 billion windows the chance of any false tie is below one in a thousand. A block sends each
distinct key once, so a passage that a third of all texts share is one key per block; a bucket's memory is bounded by its
share of keys and a block's by its bytes or by its one longest text.

Defined cases: a null text is empty; texts below ``LENGTH`` bytes lose nothing; rows with equal or null ids stay rows of
their own; repeats inside a text count, also overlapping ones; strings never cross texts; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.materialize import cut_lineage
from lexspark.llm.blocks import (
    KEY_SCHEMA, ask_buckets, block_rows, block_texts, bucket_edges, n_buckets_for, pack_sorted, store_blocks, with_answers,
)
from lexspark.llm.common import table
from lexspark.llm.neardup import mix

LENGTH = 400
# A perfect difference set modulo 133.
PERIOD = 133
COVER = [1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121]
KEY_BITS = 62
SLICE = 1 << 19
# A cut every 128 positions on average.
CUT_BITS = 7
# Keys of samples only choose suffixes: so many bits more than their number needs, and few are taken for repeated wrongly.
SPARE_BITS = 13

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        held = np.full(n, base, np.uint64)
        held[0] = 1
        _POWERS[base] = np.cumprod(held, dtype=np.uint64)
    return _POWERS[base][:n]


def fingerprints(data: np.ndarray, width: int, at: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit fingerprints of the strings of ``width`` bytes at the ascending positions ``at``."""
    out = np.empty(len(at), np.uint64)
    for low in range(0, len(data), SLICE):
        i, j = np.searchsorted(at, [low, low + SLICE])
        if j > i:
            part = data[low:low + SLICE + width]
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[which][part] * _powers(_BASE, SLICE + width)[:len(part)], dtype=np.uint64)])
            begin = at[i:j] - low
            # A difference of prefix sums, shifted back to where the string begins.
            out[i:j] = mix((upto[begin + width] - upto[begin]) * _powers(pow(_BASE, -1, 1 << 64), SLICE)[begin])
    return out


def _fitting(sizes: np.ndarray, width: int) -> np.ndarray:
    """Which positions of the joined texts begin a string of ``width`` bytes inside their text."""
    fits = np.ones(int(sizes.sum()), bool)
    ends = np.cumsum(sizes)
    for end, size in zip(ends.tolist(), sizes.tolist()):
        fits[max(end - size, end - width + 1):end] = False
    return fits


def _stretches(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of positions where windows begin, cut by content."""
    fits = _fitting(sizes, length)
    low = np.zeros(len(data), bool)
    for r in range(min(8, len(data))):
        part = data[r:r + (len(data) - r) // 8 * 8].view("<u8")
        low[r:r + 8 * len(part):8] = (part * np.uint64(_BASE)) >> np.uint64(64 - CUT_BITS) == 0
    before = np.concatenate([[False], fits[:-1]])
    marks = np.flatnonzero((fits & (low | ~before)) | (~fits & before))
    begin, end = marks[:-1], marks[1:]
    begin, end = begin[fits[begin]], end[fits[begin]]
    # Where no cut comes, one after every ``length`` positions: two windows then hold all bytes of a stretch.
    pieces = -(-(end - begin) // length)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(begin, pieces) + nth * length
    return begin, np.minimum(begin + length, np.repeat(end, pieces))


def _stretch_keys(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, which: int) -> np.ndarray:
    first, last = fingerprints(data, length, begin, which), fingerprints(data, length, end - 1, which)
    return mix(first * np.uint64(_BASE) + mix(last + (end - begin).astype(np.uint64)))


def _between(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, begin, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth[:-1]) > 0


def _folded(data: np.ndarray, sizes: np.ndarray, length: int, replies: dict[int, bytes], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which positions begin windows that are still to be compared, and which begin windows of a copied stretch."""
    begin, end = _stretches(data, sizes, length)
    key = _stretch_keys(data, begin, end, length, 0) >> np.uint64(64 - KEY_BITS)
    copied, stands = _told(key, replies, 0, n_buckets, KEY_BITS, 2)
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    kept = stands & first
    return _between(len(data), begin[kept], end[kept]), _between(len(data), begin[copied], end[copied])


def _sample(data: np.ndarray, sizes: np.ndarray, length: int, active: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions inside the windows to be compared, and the keys of their strings."""
    covered = np.zeros(PERIOD, bool)
    covered[COVER] = True
    width = length - PERIOD + 1
    at = np.flatnonzero(_fitting(sizes, width) & np.resize(covered, len(data)))
    upto = np.concatenate([[0], np.cumsum(active)])
    at = at[upto[at + 1] > upto[np.maximum(0, at - PERIOD + 1)]]
    return at, fingerprints(data, width, at) >> np.uint64(64 - bits)


def _suffixes(data: np.ndarray, active: np.ndarray, length: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions with a repeated sample in reach, and the keys of their windows."""
    at = np.flatnonzero(_between(len(data), np.maximum(0, repeated - PERIOD + 1), repeated + 1) & active)
    return at, fingerprints(data, length, at) >> np.uint64(64 - KEY_BITS)


def _key_rows(unit: int, key: np.ndarray, check: np.ndarray | None, n_buckets: int, bits: int = KEY_BITS) -> dict[str, pa.Array]:
    """Distinct keys by bucket; the extra holds which occur twice in the block, and the check values if any."""
    keys, first, times = np.unique(key, return_index=True, return_counts=True)
    edges = bucket_edges(keys, n_buckets, bits)
    rows = [
        (b, unit, pack_sorted(keys[i:j]), np.packbits(times[i:j] > 1).tobytes() + (b"" if check is None else check[first[i:j]].astype("<u2").tobytes()))
        for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i
    ]
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = {"bucket": pa.int32(), "unit": pa.int64(), "data": pa.binary(), "extra": pa.binary()}
    return {name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns)}


def _sorted(keys: list[np.ndarray], extras: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort a bucket: which keys occur twice in their block, the order, and which are tied to the one before in it."""
    every = np.concatenate(keys)
    twice = np.concatenate([np.unpackbits(np.frombuffer(e, np.uint8, -(-len(k) // 8)), count=len(k)) for k, e in zip(keys, extras)]).astype(bool)
    checks = [np.frombuffer(e, "<u2", offset=-(-len(k) // 8)) for k, e in zip(keys, extras)]
    check = np.concatenate(checks) if len(checks[0]) else np.zeros(len(every), np.uint16)
    order = np.lexsort((check, every))
    tied = np.zeros(len(every), bool)
    tied[1:] = (every[order][1:] == every[order][:-1]) & (check[order][1:] == check[order][:-1])
    return twice, order, tied


def _bits(flags: np.ndarray, keys: list[np.ndarray]) -> list[bytes]:
    return [np.packbits(t).tobytes() for t in np.split(flags, np.cumsum([len(k) for k in keys])[:-1])]


def _repeated(keys: list[np.ndarray], extras: list[bytes]) -> list[bytes | None]:
    """One bit for each key sent: does it occur again, in its own block or another one."""
    twice, order, tied = _sorted(keys, extras)
    twice[order] |= tied | np.append(tied[1:], False)
    return _bits(twice, keys)


def _copies(keys: list[np.ndarray], extras: list[bytes]) -> list[bytes | None]:
    """Two bits for each key sent: does it occur again, and does its block stand for all that have it."""
    _, order, tied = _sorted(keys, extras)
    stands = np.zeros(len(order), bool)
    stands[order] = ~tied
    return [a + b for a, b in zip(_repeated(keys, extras), _bits(stands, keys))]


def _told(key: np.ndarray, replies: dict[int, bytes], base: int, n_buckets: int, bits: int = KEY_BITS, n_flags: int = 1) -> np.ndarray:
    """The flags of each key, from the replies to the distinct ones."""
    keys, where = np.unique(key, return_inverse=True)
    edges = bucket_edges(keys, n_buckets, bits)
    flags = np.zeros((n_flags, len(keys)), bool)
    for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
        if j > i:
            rows = np.frombuffer(replies[base + b], np.uint8).reshape(n_flags, -1)
            flags[:, i:j] = np.unpackbits(rows, axis=1, count=j - i)
    return flags[:, where]


def _joined(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    texts = block_texts(data)
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)


RESULT_SCHEMA = "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` per row of ``docs``: the maximal removed runs and the bytes that remain."""
    if length < 2 * PERIOD:
        raise ValueError(f"the cover serves strings of at least {2 * PERIOD} bytes")
    blocks = store_blocks(docs.select(F.col("doc_id").cast("long"), "text"))
    total = int(blocks.agg(F.sum("n_bytes")).first()[0] or 0)
    in_samples = total * len(COVER) // PERIOD
    n_copies, n_sample, n_suffix = (n_buckets_for(n) for n in (total >> CUT_BITS, in_samples, total // 4))
    sample_bits = min(KEY_BITS, in_samples.bit_length() + SPARE_BITS)

    def emit_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, block in zip(batch.column("unit").to_pylist(), batch.column("data")):
                data, sizes = _joined(block.as_py())
                begin, end = _stretches(data, sizes, length)
                key, check = (_stretch_keys(data, begin, end, length, which) for which in (0, 1))
                yield pa.RecordBatch.from_pydict(_key_rows(unit, key >> np.uint64(64 - KEY_BITS), check & np.uint64(0xFFFF), n_copies))

    def emit_sample(unit: int, block: bytes, replies: dict[int, bytes]) -> pa.Table:
        data, sizes = _joined(block)
        active, _ = _folded(data, sizes, length, replies, n_copies)
        return pa.table(_key_rows(unit, _sample(data, sizes, length, active, sample_bits)[1], None, n_sample, sample_bits))

    def tied_suffixes(data: np.ndarray, sizes: np.ndarray, replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        active, copied = _folded(data, sizes, length, replies, n_copies)
        at, key = _sample(data, sizes, length, active, sample_bits)
        return copied, *_suffixes(data, active, length, at[_told(key, replies, n_copies, n_sample, sample_bits)[0]])

    def emit_suffixes(unit: int, block: bytes, replies: dict[int, bytes]) -> pa.Table:
        data, sizes = _joined(block)
        _, at, key = tied_suffixes(data, sizes, replies)
        return pa.table(_key_rows(unit, key, fingerprints(data, length, at, 1) & np.uint64(0xFFFF), n_suffix))

    def cut(unit: int, block: bytes, replies: dict[int, bytes]) -> pa.Table:
        data, sizes = _joined(block)
        copied, at, key = tied_suffixes(data, sizes, replies)
        copied[at[_told(key, replies, n_copies + n_sample, n_suffix)[0]]] = True
        begins = np.flatnonzero(copied)
        depth = np.zeros(len(data) + 1, np.int32)
        depth[begins] += 1
        depth[begins + length] -= 1
        gone = np.cumsum(depth[:-1]) > 0
        spans, kept = [], []
        for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
            mine = gone[end - size:end]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]])))
            spans.append([{"begin": b, "end": e} for b, e in edges.reshape(-1, 2).tolist()])
            kept.append(data[end - size:end][~mine].tobytes() if len(edges) else data[end - size:end].tobytes())
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.table({
            "doc_id": block_rows(block).column("doc_id"), "n_bytes": pa.array(sizes), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary()),
        })

    def shifted(answers: DataFrame, by: int) -> DataFrame:
        return answers.withColumn("bucket", (F.col("bucket") + by).cast("int"))

    of_copies = cut_lineage(ask_buckets(blocks.mapInArrow(emit_stretches, KEY_SCHEMA), _copies), "copies")
    of_sample = cut_lineage(ask_buckets(with_answers(blocks, of_copies, emit_sample, KEY_SCHEMA), _repeated), "cover-ranks")
    known = of_copies.union(shifted(of_sample, n_copies))
    of_suffix = ask_buckets(with_answers(blocks, known, emit_suffixes, KEY_SCHEMA), _repeated)
    answers = known.union(shifted(of_suffix, n_copies + n_sample))
    return with_answers(blocks, answers, cut, RESULT_SCHEMA)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("spans") > 0).alias("has_repeats"),
    )
