"""Dense scoring: top-k by cosine and pairs above a threshold, in Arrow blocks.

Scores are rounded before ranking and ties go to the smaller id, so results do not depend on the
order of additions or on how rows are split.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.ranking import top_k
from lexspark.operators.cells import ROWS_PER_LEAF, BlockPairs

SCORE_DIGITS = 6
# A query batch up to this size is broadcast to every task; a larger one is joined block by block.
MAX_BROADCAST_QUERIES = 4096
BLOCK_ROWS = 50_000
PAIR_BLOCK_ROWS = 2048
# Similarities a task holds at a time, and corpus rows of an Arrow batch scored together.
SCORE_CELLS, SCORE_ROWS = 1 << 20, 4096


def _field_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _arrow_type(df: DataFrame, column: str):
    return df.select(column).limit(0).toArrow().schema.field(0).type


def _make_kernel(k: int, digits: int):
    """Functions shared by all plans; nested, so they travel with the task instead of being imported."""
    import numpy as np
    import pyarrow as pa

    cells = SCORE_CELLS

    def as_array(column):
        return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column

    def ids_of(column):
        values = as_array(column).to_numpy(zero_copy_only=False)
        return values.astype(str) if values.dtype == object else values

    def unit_rows(column):
        column = as_array(column)
        if len(column) == 0:
            return np.zeros((0, 1))
        rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return rows / np.where(norms > 0, norms, 1.0)

    def keep_best(rows, ids, scores):
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        index = np.arange(len(rows))
        first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
        kept = index - np.maximum.accumulate(np.where(first, index, 0)) < k
        return rows[kept], ids[kept], scores[kept]

    def merge(parts):
        return keep_best(*[np.concatenate(columns) for columns in zip(*parts)])

    def score(query_rows, query_units, ids, units):
        """Best ``k`` ids for each query row, a slice of queries at a time to bound memory."""
        parts = []
        step = max(1, cells // max(len(units), 1))
        for lo in range(0, len(query_rows), step):
            sims = query_units[lo : lo + step] @ units.T
            np.round(sims, digits, out=sims)
            sims += 0.0
            width = sims.shape[1]
            if width > k:
                kth = np.partition(sims, width - k, axis=1)[:, width - k]
                r, c = np.nonzero(sims >= kth[:, None])
            else:
                r, c = np.divmod(np.arange(sims.size), width)
            parts.append(keep_best(query_rows[lo + r], ids[c], sims[r, c]))
        return merge(parts)

    return ids_of, unit_rows, merge, score


def dense_top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    celled: bool = False,
    max_broadcast: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the ``k`` nearest ``corpus(doc_id, embedding)`` rows.

    With ``celled`` the corpus has a ``cell`` column and queries an array ``cells``; a query sees
    only the rows of its cells.
    """
    # Rows without a vector are dropped inside the tasks: a filter here would be pushed below a
    # Python encoder and run it twice.
    # Only the query batch is looked at here, and never more than one row beyond the bound.
    head = queries.limit(max_broadcast + 1).toArrow()
    head = head.filter(head.column("embedding").is_valid()) if head.num_rows <= max_broadcast else head
    plan = _broadcast_plan if head.num_rows <= max_broadcast else _block_plan
    hits = plan(corpus, queries, head, k, celled)
    return top_k(hits, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def _broadcast_plan(corpus, queries, head, k, celled):
    """One narrow pass over the corpus: each task keeps its own top k per query."""
    schema = f"query_id {_field_type(queries, 'query_id')}, doc_id {_field_type(corpus, 'doc_id')}, score double"
    if head.num_rows == 0:
        return corpus.sparkSession.createDataFrame([], schema)
    columns = ["doc_id", "embedding"]
    if celled:
        columns.append("cell")
        probed = sorted({cell for cells in head.column("cells").to_pylist() for cell in cells})
        # Prunes partitions of a corpus stored by cell.
        corpus = corpus.where(F.col("cell").isin(probed))
    shared = corpus.sparkSession.sparkContext.broadcast(head.select(
        ["query_id", "embedding"] + (["cells"] if celled else [])).to_pydict())
    ids_of, unit_rows, merge, score = _make_kernel(k, SCORE_DIGITS)
    query_type, at_once = head.schema.field("query_id").type, SCORE_ROWS

    def run(batches):
        import numpy as np
        import pyarrow as pa

        query_ids = shared.value["query_id"]
        units = unit_rows(pa.array(shared.value["embedding"], type=pa.list_(pa.float64())))
        rows = np.arange(len(query_ids))
        probing = {}
        for row, cells in enumerate(shared.value["cells"] if celled else []):
            for cell in cells:
                probing.setdefault(cell, []).append(row)
        best = None
        for batch in (whole.slice(low, at_once) for whole in batches for low in range(0, whole.num_rows, at_once)):
            doc_type = batch.schema.field(0).type
            batch = batch.filter(batch.column(1).is_valid())
            if batch.num_rows == 0:
                continue
            ids, dense = ids_of(batch.column(0)), unit_rows(batch.column(1))
            parts = [] if best is None else [best]
            if celled:
                cells = batch.column(2).to_numpy(zero_copy_only=False)
                for cell in np.unique(cells):
                    asking = np.array(probing.get(int(cell), []), dtype=np.int64)
                    if len(asking):
                        inside = cells == cell
                        parts.append(score(asking, units[asking], ids[inside], dense[inside]))
            else:
                parts.append(score(rows, units, ids, dense))
            if parts:
                best = merge(parts)
        if best is not None and len(best[0]):
            found, ids, scores = best
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([query_ids[r] for r in found], type=query_type),
                    pa.array(ids.tolist(), type=doc_type),
                    pa.array(scores),
                ],
                names=["query_id", "doc_id", "score"],
            )

    return corpus.select(*columns).mapInArrow(run, schema)


def _block_plan(corpus, queries, head, k, celled):
    """Both sides too large to broadcast: hash blocks of bounded size meet in co-grouped tasks.

    A hot cell is split into as many corpus blocks as its row count asks for.
    """
    corpus = corpus.where(F.col("embedding").isNotNull())
    queries = queries.where(F.col("embedding").isNotNull())
    dim = max(len(v.as_py() or ()) for v in head.column("embedding"))
    n_query_blocks = math.ceil(queries.count() / MAX_BROADCAST_QUERIES)
    rows_per_block = max(1, BLOCK_ROWS * 64 // max(dim, 1))
    if celled:
        per_cell = corpus.groupBy("cell").agg(F.count("*").alias("n"))
        sized = per_cell.select("cell", F.ceil(F.col("n") / rows_per_block).cast("int").alias("n_blocks"))
        right = corpus.join(sized, "cell").withColumn(
            "cb", F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int"))
        left = (
            queries.withColumn("cell", F.explode("cells")).drop("cells").join(sized, "cell")
            .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        )
    else:
        n_blocks = max(1, math.ceil(corpus.count() / rows_per_block))
        right = corpus.withColumn("cell", F.lit(0)).withColumn(
            "cb", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))
        left = queries.withColumn("cell", F.lit(0)).withColumn(
            "cb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    left = left.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_query_blocks)).cast("int"))
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    keys = ["cell", "cb", "qb"]
    ids_of, unit_rows, _, score = _make_kernel(k, SCORE_DIGITS)
    query_type, id_type = head.schema.field("query_id").type, _arrow_type(corpus, "doc_id")

    def run(query_block, corpus_block):
        import numpy as np
        import pyarrow as pa

        if not (query_block.num_rows and corpus_block.num_rows):
            return pa.table({
                "query_id": pa.array([], type=query_type), "doc_id": pa.array([], type=id_type),
                "score": pa.array([], type=pa.float64()),
            })
        query_ids = query_block.column("query_id")
        found, ids, scores = score(
            np.arange(query_block.num_rows), unit_rows(query_block.column("embedding")),
            ids_of(corpus_block.column("doc_id")), unit_rows(corpus_block.column("vector")),
        )
        return pa.table({
            "query_id": query_ids.take(pa.array(found, type=pa.int64())),
            "doc_id": pa.array(ids.tolist(), type=id_type),
            "score": pa.array(scores, type=pa.float64()),
        })

    schema = f"query_id {_field_type(queries, 'query_id')}, doc_id {_field_type(corpus, 'doc_id')}, score double"
    left = left.select("query_id", "embedding", *keys)
    # Names of its own, should both sides come from one frame.
    right = right.select("doc_id", F.col("embedding").alias("vector"), *[F.col(c).alias(f"right_{c}") for c in keys])
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"right_{c}" for c in keys])).applyInArrow(run, schema)


def pairs_above(vectors: DataFrame, threshold: float, block_rows: int = PAIR_BLOCK_ROWS, rows_per_leaf: int = ROWS_PER_LEAF) -> DataFrame:
    """``(id_a, id_b, cosine)`` with ``id_a < id_b`` and cosine at or above ``threshold``; exact.

    Vectors meet in the block pairs of :mod:`lexspark.operators.cells`; each is one matrix product, and only pairs that pass
    the threshold leave a task. Give one row per distinct vector (see :func:`distinct_vectors`), so a group of copies
    costs one row.
    """
    id_type = _arrow_type(vectors, "doc_id")
    ids_of, unit_rows, _, _ = _make_kernel(1, SCORE_DIGITS)
    cells = SCORE_CELLS

    def run(same, left_block, right_block):
        import numpy as np
        import pyarrow as pa

        a_ids, b_ids = ids_of(left_block.column("doc_id")), ids_of(right_block.column("r_doc_id"))
        ups, downs = unit_rows(left_block.column("embedding")), unit_rows(right_block.column("r_embedding"))
        found = [(a_ids[:0], b_ids[:0], np.zeros(0))]
        step = max(1, cells // max(len(b_ids), 1))
        for low in range(0, len(a_ids), step):
            sims = np.round(ups[low : low + step] @ downs.T, SCORE_DIGITS) + 0.0
            near = sims >= threshold
            if same:
                near &= a_ids[low : low + step, None] < b_ids[None, :]
            r, c = np.nonzero(near)
            found.append((a_ids[low + r], b_ids[c], sims[r, c]))
        a, b, cosine = (np.concatenate(x) for x in zip(*found))
        swap = a > b
        return pa.table({
            "id_a": pa.array(np.where(swap, b, a), type=id_type),
            "id_b": pa.array(np.where(swap, a, b), type=id_type),
            "cosine": pa.array(cosine, type=pa.float64()),
        })

    kind = _field_type(vectors, "doc_id")
    pairs = BlockPairs(vectors, threshold, block_rows=block_rows, rows_per_leaf=rows_per_leaf)
    return pairs.apply(run, f"id_a {kind}, id_b {kind}, cosine double")


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """``(doc_id, embedding, weight)``: one row per distinct vector, its smallest id and its copies."""
    return vectors.groupBy("embedding").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("weight")
    ).select("doc_id", "embedding", "weight")
