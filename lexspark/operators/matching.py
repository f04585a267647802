"""Lexical scoring of a forward index by a bounded batch of queries: narrow passes in which each task keeps its own best.

A score is the sum, over the terms a query and a document share, of the query's weight of the term times the document's gain. A
document has all its terms in its own row, so its scores against the whole batch are summed where it lies, and no row per query
and document is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.ranking import top_k
from lexspark.operators.dense import MAX_BROADCAST_QUERIES, _arrow_type, _field_type, _make_kernel

# Products of weights and gains, and sums, that a task holds at a time.
MATCH_CELLS = 1 << 20


def is_small_batch(queries: DataFrame, most: int = MAX_BROADCAST_QUERIES) -> bool:
    """Whether every task may hold the weights of ``queries``; never more than one row beyond the bound is looked at."""
    return queries.limit(most + 1).count() <= most


def shared_terms(forward: DataFrame, terms: list[str], keep: list[str] = ()) -> DataFrame:
    """``(doc_id, *keep, numbers, tfs)`` of documents with any of ``terms``, by their places in it; narrow."""
    rows = forward.select("doc_id", *keep, F.col("counts.term").alias("names"), F.col("counts.tf").alias("tfs"))
    shared = forward.sparkSession.sparkContext.broadcast(terms)

    def find(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        value_set = pa.array(shared.value, pa.string())
        for batch in batches:
            names, tfs = batch.column("names"), batch.column("tfs")
            lengths = pc.fill_null(names.value_lengths(), 0).to_numpy(zero_copy_only=False)
            place = pc.index_in(names.flatten(), value_set=value_set)
            hit = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
            per_row = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[hit], minlength=len(lengths))
            found = pa.array(np.flatnonzero(per_row))
            offsets = pa.array(np.r_[0, np.cumsum(per_row[per_row > 0])].astype(np.int32))
            kept = [batch.column(name).take(found) for name in ("doc_id", *keep)]
            hits = pa.array(hit)
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (place.take(hits), tfs.flatten().take(hits))]
            yield pa.RecordBatch.from_arrays(kept + lists, names=["doc_id", *keep, "numbers", "tfs"])

    kinds = ", ".join(f"{name} {_field_type(forward, name)}" for name in ("doc_id", *keep))
    return rows.mapInArrow(find, f"{kinds}, numbers array<int>, tfs array<int>")


def best_matches(gained: DataFrame, weights, query_kind: str, terms: list[str], k: int, digits: int) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the ``k`` best rows of ``gained(doc_id, numbers, gains)``, ties by id.

    ``weights`` is an Arrow table ``(query_id, term, weight)``, its ids of Spark's type ``query_kind``; only rows that share a term with a query are among its best.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    coded = weights.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    query_ids, query_type = coded.dictionary.to_pylist(), weights.schema.field("query_id").type
    number = pc.index_in(weights.column("term").combine_chunks(), value_set=pa.array(terms, pa.string())).to_numpy()
    order = np.argsort(number, kind="stable")
    per_term = np.bincount(number, minlength=len(terms))
    asked = coded.indices.to_numpy()[order], weights.column("weight").to_numpy()[order], np.cumsum(per_term) - per_term, per_term
    shared = gained.sparkSession.sparkContext.broadcast((query_ids, *asked))
    ids_of, _, merge, _ = _make_kernel(k, digits)
    doc_type, cells = _arrow_type(gained, "doc_id"), MATCH_CELLS

    def run(batches):
        names, query, weight, first, count = shared.value
        n = len(names)
        best, least = None, np.full(n, -np.inf)
        for batch in batches:
            lengths = batch.column("numbers").value_lengths().to_numpy(zero_copy_only=False)
            numbers, gains = (batch.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("numbers", "gains"))
            ids, ends = ids_of(batch.column("doc_id")), np.cumsum(lengths)
            # Products before each row; sums take part in the bound as well.
            products = np.r_[0, np.cumsum(count[numbers])][np.r_[0, ends]]
            filled = products + np.arange(len(ids) + 1) * n
            low = 0
            while low < len(ids):
                high = max(low + 1, int(np.searchsorted(filled, filled[low] + cells, side="right")) - 1)
                at = slice(ends[low] - lengths[low], ends[high - 1])
                term, times = numbers[at], count[numbers[at]]
                row = np.repeat(np.repeat(np.arange(high - low), lengths[low:high]), times)
                place = np.repeat(first[term] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                cell = row * n + query[place]
                sums = np.bincount(cell, weights=np.repeat(gains[at], times) * weight[place], minlength=(high - low) * n)
                met = np.bincount(cell, minlength=(high - low) * n) > 0
                sums = np.round(sums, digits) + 0.0
                met = np.flatnonzero(met & (sums.reshape(-1, n) >= least).ravel())
                if len(met):
                    part = met % n, ids[low + met // n], sums[met]
                    best = merge([part] if best is None else [best, part])
                    full = np.bincount(best[0], minlength=n) == k
                    worst = np.full(n, np.inf)
                    np.minimum.at(worst, best[0], best[2])
                    least = np.where(full, worst, -np.inf)
                low = high
        if best is not None:
            found, ids, scores = best
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[q] for q in found], type=query_type), pa.array(ids.tolist(), type=doc_type), pa.array(scores)],
                names=["query_id", "doc_id", "score"],
            )

    hits = gained.select("doc_id", "numbers", "gains").mapInArrow(run, f"query_id {query_kind}, doc_id {_field_type(gained, 'doc_id')}, score double")
    return top_k(hits, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def best_documents(forward: DataFrame, weights: DataFrame, gain, k: int, digits: int, extra: DataFrame | None = None, keep: list[str] = ()) -> DataFrame:
    """:func:`best_matches` of a forward index for the batch ``weights(query_id, term, weight)``.

    ``gain`` makes a column of a document's term frequency; it may read columns of ``forward`` named in ``keep`` and those that
    ``extra`` has for each ``doc_id``. Only the terms of the batch go into that join.
    """
    table = weights.select("query_id", "term", "weight").toArrow()
    terms = sorted(set(table.column("term").to_pylist()))
    rows = shared_terms(forward, terms, list(keep))
    rows = rows if extra is None else rows.join(extra, "doc_id")
    gained = rows.select("doc_id", "numbers", F.transform("tfs", lambda tf: gain(tf).cast("double")).alias("gains"))
    return best_matches(gained, table, _field_type(weights, "query_id"), terms, k, digits)

