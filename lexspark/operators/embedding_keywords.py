"""Keywords by embedding similarity: per-document phrases, and anchors found in token windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.rows import unnest, unnest_structs, unnest_with_position
from lexspark.functions.encode import Encoder, HashedTokenEncoder
from lexspark.functions.ranking import top_k
from lexspark.functions.stopwords import FRENCH_STOPWORDS
from lexspark.functions.text import (
    Tokenizer, ngrams, remove_stopwords, token_windows, word_only_tokens, wordpunct_tokens,
)

SIM_DIGITS = 6
# The reference's extractor and annotation settings.
N_CANDIDATES, TOP_N, MAX_WORDS = 20, 5, 2
WINDOW, THRESHOLD = 4, 0.7
MAX_ANCHORS = 512
# Elements whose vectors a task holds at a time, and documents whose phrases it compares.
STRETCH, DOCS_AT_ONCE = 4096, 256
# Scores closer than this to the last place are left to the exact ranking of rounded scores.
SLACK = 1e-5


def keyword_candidates(
    docs: DataFrame, encoder: Encoder, n_candidates: int = N_CANDIDATES, max_words: int = MAX_WORDS,
    stopwords=FRENCH_STOPWORDS,
) -> DataFrame:
    """``(doc_id, phrase, score, rank)``: the phrases nearest to their own document.

    Stopwords leave before n-grams are formed. Scoring is narrow; only a partial top list per
    document is exchanged. Where a phrase has the tokens of its words, the vectors of words are added up on Arrow batches.
    """
    tokens = remove_stopwords(word_only_tokens(F.col("text")), stopwords)
    if isinstance(encoder, HashedTokenEncoder) and encoder.parts(tokens) is not None:
        scored = _best_phrases(docs.select("doc_id", encoder(F.col("text")).alias("unit"), tokens.alias("tokens")).select(
            "doc_id", "unit", "tokens", encoder.parts(F.col("tokens")).alias("parts")), encoder, n_candidates, max_words)
        scored = scored.select("doc_id", "phrase", F.round("score", SIM_DIGITS).alias("score"))
        return top_k(scored, ["doc_id"], [F.desc("score"), F.asc("phrase")], n_candidates)
    phrases = F.array_distinct(F.transform(ngrams(tokens, 1, max_words), lambda g: F.array_join(g, " ")))
    listed = docs.select("doc_id", encoder(F.col("text")).alias("unit"), phrases.alias("phrases"))
    scored = unnest(listed, ["doc_id", "unit"], "phrases", "phrase").select(
        "doc_id", "phrase", F.round(encoder.similarity(F.col("phrase"), F.col("unit")), SIM_DIGITS).alias("score")
    )
    return top_k(scored, ["doc_id"], [F.desc("score"), F.asc("phrase")], n_candidates)


def _best_phrases(words: DataFrame, encoder: HashedTokenEncoder, n: int, max_words: int) -> DataFrame:
    """``(doc_id, phrase, score)`` of ``words(doc_id, unit, tokens, parts)``: phrases that may be among the ``n`` best of a document.

    Scores are not rounded; those within ``SLACK`` of the n-th best stay, so rounding and ties decide afterwards.
    """
    reader, stretch, at_once, slack = encoder.vector_reader(), STRETCH, DOCS_AT_ONCE, SLACK

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def best(batch):
            ids, unit, tokens, parts = batch.columns
            sizes = pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = tokens.flatten().dictionary_encode()
            word, n_words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(flat.dictionary)
            docs, units = np.repeat(np.arange(len(sizes)), sizes), unit.fill_null([]).flatten().to_numpy(zero_copy_only=False)
            if len(docs) == 0:
                return None
            # A null text has neither tokens nor a unit.
            known = np.cumsum(unit.is_valid().to_numpy(zero_copy_only=False)) - 1
            units = units.reshape(known[-1] + 1, -1)
            vectors = reader(parts, sizes)
            scores = np.zeros((max_words, len(docs)))
            for low in range(0, len(docs), stretch):
                high = min(low + stretch, len(docs))
                ahead = vectors(low, min(high + max_words - 1, len(docs)))
                along, total = units[known[docs[low:high]]], np.zeros((high - low, ahead.shape[1]))
                for size in range(max_words):
                    rows = ahead[size : size + high - low]
                    total[: len(rows)] += rows
                    norm = np.sqrt((total * total).sum(axis=1))
                    scores[size, low:high] = np.where(norm > 0, (total * along).sum(axis=1) / np.where(norm > 0, norm, 1.0), 0.0)
            code, base, found = np.zeros(len(docs), np.int64), 0, []
            for size in range(1, max_words + 1):
                start = np.arange(max(len(docs) - size + 1, 0))
                start = start[docs[start] == docs[start + size - 1]]
                code = docs[start]
                for j in range(size):
                    code = np.unique(code, return_inverse=True)[1] * n_words + word[start + j]
                at = start[np.unique(code, return_index=True)[1]]
                found.append((at, np.full(len(at), size), scores[size - 1, at]))
            at, size, score = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((-score, docs[at]))
            at, size, score = at[order], size[order], score[order]
            doc = docs[at]
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            last = np.minimum(first + n, np.r_[first[1:], len(doc)]) - 1
            floor = np.repeat(score[last], np.diff(np.r_[first, len(doc)])) - slack
            kept = score >= floor
            at, size, score = at[kept], size[kept], score[kept]
            ends = np.cumsum(size)
            places = np.repeat(at - (ends - size), size) + np.arange(ends[-1])
            spelled = flat.dictionary.take(pa.array(word[places])).cast(pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), spelled)
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(docs[at])), pc.binary_join(lists, " "), pa.array(score)], names=["doc_id", "phrase", "score"])

        for batch in batches:
            for low in range(0, batch.num_rows, at_once):
                result = best(batch.slice(low, at_once))
                if result is not None:
                    yield result

    kind = words.schema["doc_id"].dataType.simpleString()
    return words.mapInArrow(run, f"doc_id {kind}, phrase string, score double")


def embedding_keywords(
    docs: DataFrame, encoder: Encoder, n_candidates: int = N_CANDIDATES, top_n: int = TOP_N,
    max_words: int = MAX_WORDS, stopwords=FRENCH_STOPWORDS,
) -> DataFrame:
    """``(doc_id, phrase, score)``: of the best candidates, the ``top_n`` least similar to each other.

    All subsets of the at most ``n_candidates`` phrases of a document are compared by the sum of
    their pairwise similarities; the first smallest sum in candidate order wins.
    """
    ranked = keyword_candidates(docs, encoder, n_candidates, max_words, stopwords)
    vectors = ranked.withColumn("v", encoder(F.col("phrase")))
    # At most n_candidates rows per document reach the list.
    packed = vectors.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "phrase", "score", "v"))).alias("c")
    )

    @F.arrow_udf("array<int>")
    def least_similar(candidates):
        import itertools

        import numpy as np
        import pyarrow as pa

        subsets = {}
        picks = []
        for rows in candidates.to_pylist():
            n = len(rows)
            if n <= top_n:
                picks.append(list(range(n)))
                continue
            if n not in subsets:
                chosen = np.array(list(itertools.combinations(range(n), top_n)))
                # Where the similarities of each couple of a subset stand in the flat table of all.
                subsets[n] = chosen, [chosen[:, i] * n + chosen[:, j] for i, j in itertools.combinations(range(top_n), 2)]
            units = np.array(rows)
            norms = np.sqrt((units * units).sum(axis=1, keepdims=True))
            units = units / np.where(norms > 0, norms, 1.0)
            sims = (units @ units.T).ravel()
            chosen, couples = subsets[n]
            total = np.zeros(len(chosen))
            for couple in couples:
                total += sims.take(couple)
            picks.append(chosen[int(np.argmin(np.round(total, 9)))].tolist())
        return pa.array(picks, type=pa.list_(pa.int32()))

    chosen = packed.withColumn("picks", least_similar(F.col("c.v")))
    kept = F.transform("picks", lambda i: F.struct(F.get("c", i)["phrase"].alias("phrase"), F.get("c", i)["score"].alias("score")))
    return unnest_structs(chosen, ["doc_id"], kept)


def annotate_keywords(
    docs: DataFrame, anchors: DataFrame, encoder: Encoder, threshold: float = THRESHOLD, window: int = WINDOW,
    tokenizer: Tokenizer = wordpunct_tokens, max_anchors: int = MAX_ANCHORS,
) -> DataFrame:
    """``(doc_id, chunk_no, anchor_id, chunk, similarity)`` of token windows close to an anchor.

    ``anchors`` is ``(anchor_id, anchor)``. Up to ``max_anchors`` vectors travel with the plan; more
    anchors are taken in hash groups of about half that size, each one narrow pass.
    """
    encoded = anchors.select("anchor_id", encoder(F.col("anchor")).alias("unit"))
    head = encoded.limit(max_anchors + 1).collect()
    if len(head) <= max_anchors:
        return _annotate(docs, head, encoder, threshold, window, tokenizer)
    n_groups = -(-2 * anchors.count() // max_anchors)
    group = F.pmod(F.xxhash64("anchor_id"), F.lit(n_groups))
    found = None
    for number in range(n_groups):
        part = annotate_keywords(
            docs, anchors.where(group == number), encoder, threshold, window, tokenizer, 2 * max_anchors
        )
        found = part if found is None else found.unionByName(part)
    return found


def _annotate(docs, anchors, encoder, threshold, window, tokenizer):
    if not anchors:
        key = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {key}, chunk_no int, anchor_id long, chunk string, similarity double"
        return docs.sparkSession.createDataFrame([], schema)
    ids = F.array(*[F.lit(row.anchor_id) for row in anchors])
    if isinstance(encoder, HashedTokenEncoder) and tokenizer is wordpunct_tokens and encoder.parts(F.array()) is not None:
        words = docs.select("doc_id", tokenizer(F.col("text")).alias("tokens"))
        words = words.select("doc_id", "tokens", encoder.parts(F.col("tokens")).alias("parts"))
        near = _near_windows(words, [list(row.unit) for row in anchors], encoder, threshold, window)
        return near.select(
            "doc_id", "chunk_no", F.get(ids, F.col("anchor")).alias("anchor_id"), "chunk", F.round("similarity", SIM_DIGITS).alias("similarity")
        ).where(F.col("similarity") > threshold)
    units = F.array(*[F.array(*[F.lit(float(x)) for x in row.unit]) for row in anchors])
    windows = token_windows(tokenizer(F.col("text")), window, 1, drop_empty=True)
    chunks = unnest_with_position(docs, ["doc_id"], windows, "chunk_no", "tokens").select(
        "doc_id", "chunk_no", F.array_join("tokens", " ").alias("chunk")
    )
    scores = chunks.withColumn("scores", encoder.similarities(F.col("chunk"), units))
    near = F.filter(
        F.transform(
            "scores", lambda s, i: F.struct(F.get(ids, i).alias("anchor_id"), F.round(s, SIM_DIGITS).alias("similarity"))
        ),
        lambda hit: hit["similarity"] > threshold,
    )
    return unnest_structs(scores, ["doc_id", "chunk_no", "chunk"], near).select(
        "doc_id", "chunk_no", "anchor_id", "chunk", "similarity"
    )


def _near_windows(words: DataFrame, units: list, encoder: HashedTokenEncoder, threshold: float, window: int) -> DataFrame:
    """``(doc_id, chunk_no, anchor, chunk, similarity)`` of the windows of ``words(doc_id, tokens, parts)`` close to a unit vector.

    ``anchor`` is the vector's number in ``units``. Each token's vector is made once and added up in its windows, which meet all
    anchors in one matrix product. Similarities are not rounded; those within ``SLACK`` below the threshold stay.
    """
    reader, stretch, floor, shared = encoder.vector_reader(), STRETCH, threshold - SLACK, units

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        anchors = np.array(shared, np.float64)
        for batch in batches:
            ids, tokens, parts = batch.columns
            sizes = pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ends = tokens.flatten(), np.cumsum(sizes)
            docs = np.repeat(np.arange(len(sizes)), sizes)
            vectors = reader(parts, sizes)
            for low in range(0, len(docs), stretch):
                high = min(low + stretch, len(docs))
                doc = docs[low:high]
                start = np.arange(low, high)
                number, width = start - (ends - sizes)[doc], np.minimum(window, ends[doc] - start)
                ahead = vectors(low, min(high + window - 1, len(docs)))
                total = np.zeros((high - low, ahead.shape[1]))
                for shift in range(window):
                    inside = np.flatnonzero(width > shift)
                    total[inside] += ahead[inside + shift]
                norm = np.sqrt((total * total).sum(axis=1))
                sims = (total / np.where(norm > 0, norm, 1.0)[:, None]) @ anchors.T
                # One window follows the last whole one: the remainder.
                sims[number > np.maximum(sizes[doc] - window, 0) + 1] = -np.inf
                row, anchor = np.nonzero(sims > floor)
                if len(row):
                    stop = np.cumsum(width[row])
                    places = np.repeat(start[row] - (stop - width[row]), width[row]) + np.arange(stop[-1])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, stop], pa.int32()), flat.take(pa.array(places)))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(doc[row])), pa.array(number[row], pa.int32()), pa.array(anchor, pa.int32()),
                         pc.binary_join(lists, " "), pa.array(sims[row, anchor])],
                        names=["doc_id", "chunk_no", "anchor", "chunk", "similarity"])

    kind = words.schema["doc_id"].dataType.simpleString()
    return words.mapInArrow(run, f"doc_id {kind}, chunk_no int, anchor int, chunk string, similarity double")
