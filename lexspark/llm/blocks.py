"""Documents in blocks of a few megabytes, and exchanges of many small keys as packed arrays.

A block is one row that holds whole rows of a table, compressed, under a unit number; it is stored once, so a document
is known by its unit and position even where ids repeat or are null. Facts about all words or bytes of a corpus are
gathered by sending each block's sorted keys to buckets of the key range as packed differences, and come back to the
block in the same order. One row then stands for thousands of keys, which keeps shuffles small and free of hot rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.materialize import cut_lineage
from lexspark.llm.common import release_memory

BLOCK_BYTES = 4_000_000
BLOCK_SCHEMA = "unit long, n_rows long, n_bytes long, data binary"
KEYS_PER_BUCKET = 1_500_000


def store_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` as a stored table of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unit, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for part in held:
                    writer.write_batch(part)
            columns = [unit, sum(p.num_rows for p in held), size, sink.getvalue().to_pybytes()]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], ["unit", "n_rows", "n_bytes", "data"])

        for batch in batches:
            low = 0
            # Every row weighs something, so a block's row numbers stay below 2 ** 20.
            sizes = np.cumsum([len(t or b"") + 16 for t in batch.column("text").cast(pa.binary()).to_pylist()])
            while low < batch.num_rows:
                done = int(sizes[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(sizes, done + BLOCK_BYTES - size, "right")))
                held.append(batch.slice(low, high - low))
                size += int(sizes[min(high, batch.num_rows) - 1]) - done
                low = high
                if size >= BLOCK_BYTES:
                    yield flush()
                    unit, held, size = unit + 1, [], 0
        if held:
            yield flush()

    return cut_lineage(rows.mapInArrow(run, BLOCK_SCHEMA), "blocks")


def block_rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def block_texts(data: bytes) -> list[bytes]:
    """Texts of a block as UTF-8 bytes, null ones empty."""
    return [t or b"" for t in block_rows(data).column("text").cast(pa.binary()).to_pylist()]


def n_buckets_for(n_keys: int) -> int:
    """A power of two, so buckets are ranges of the highest bits; it grows with the number of keys."""
    return 1 << max(4, (max(1, n_keys) // KEYS_PER_BUCKET).bit_length())


def planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of unsigned values by significance; the high planes of small values compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, n: int, width: int, at: int = 0) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return wide.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)), 8)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, len(data) // 8, 8), dtype=np.uint64)


def bucket_edges(keys: np.ndarray, n_buckets: int, bits: int) -> np.ndarray:
    """Where the buckets of sorted ``keys`` below ``2 ** bits`` begin and end."""
    width = 1 << (bits - (n_buckets.bit_length() - 1))
    return np.searchsorted(keys, np.arange(n_buckets + 1, dtype=np.uint64) * np.uint64(width))


KEY_SCHEMA = "bucket int, unit long, data binary, extra binary"
ANSWER_SCHEMA = "u_id long, bucket int, answer binary"


def ask_buckets(
    keys: DataFrame, answer: Callable[[list[np.ndarray], list[bytes]], list[bytes | None]]
) -> DataFrame:
    """Bring the key rows of each bucket together; ``answer`` maps their keys and extras to one reply per row or None."""

    def run(rows: pa.Table) -> pa.Table:
        replies = answer([unpack_sorted(d) for d in rows.column("data").to_pylist()], rows.column("extra").to_pylist())
        release_memory()
        kept = pa.array([r is not None for r in replies])
        return pa.table({"u_id": rows.column("unit"), "bucket": rows.column("bucket"), "answer": pa.array(replies, pa.binary())}).filter(kept)

    return keys.groupBy("bucket").applyInArrow(run, ANSWER_SCHEMA)


def with_answers(
    blocks: DataFrame, answers: DataFrame, run: Callable[[int, bytes, dict[int, bytes]], pa.Table], schema: str
) -> DataFrame:
    """Every block together with the replies to its keys, by bucket; blocks without replies are met too."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = dict(zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist()))
        found = pa.concat_tables([run(u, d, replies) for u, d in zip(left.column("unit").to_pylist(), left.column("data").to_pylist())])
        release_memory()
        return found

    return (
        blocks.select("unit", "data").groupBy("unit")
        .cogroup(answers.select(F.col("u_id"), "bucket", "answer").groupBy("u_id")).applyInArrow(meet, schema)
    )
