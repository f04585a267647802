"""Semantic search, retrieve-then-rerank and method comparison for batches of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.rows import unnest
from lexspark.functions.encode import Encoder
from lexspark.functions.ranking import top_k
from lexspark.functions.text import Tokenizer, word_tokens
from lexspark.operators.bm25 import BM25Index
from lexspark.operators.dense import dense_top_k
from lexspark.operators.records import keyword_prefilter

SCORE_DIGITS = 6
# Takes rows (query_id, doc_id, score, query, text) and returns (query_id, doc_id, rerank_score).
PairScorer = Callable[[DataFrame], DataFrame]


def encode_texts(df: DataFrame, encoder: Encoder, key: str, text: str) -> DataFrame:
    return df.select(key, encoder(F.col(text)).alias("embedding"))


def semantic_search(corpus: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact top ``k`` by cosine of ``corpus(doc_id, embedding)`` for ``queries(query_id, embedding)``."""
    return dense_top_k(corpus, queries, k)


def keyword_filtered_search(
    docs: DataFrame, queries: DataFrame, keyword: str, encoder: Encoder, k: int = 5
) -> DataFrame:
    """Semantic search among the texts that contain ``keyword``; only those are encoded."""
    candidates = encode_texts(keyword_prefilter(docs, keyword), encoder, "doc_id", "text")
    return semantic_search(candidates, encode_texts(queries, encoder, "query_id", "query"), k)


def overlap_scorer(index: DataFrame, n_docs: DataFrame, tokenizer: Tokenizer = word_tokens) -> PairScorer:
    """Default pair scorer: the idf share of the query's distinct terms found in the passage.

    ``index`` is ``(term, df)`` and ``n_docs`` a one-row frame ``(n)``; a term outside the corpus
    weighs as one of frequency zero.
    """

    def score(pairs: DataFrame) -> DataFrame:
        terms = unnest(
            pairs.select("query_id", "query").distinct(), ["query_id"],
            F.array_distinct(tokenizer(F.col("query"))), "term",
        )
        n = n_docs.select("n").scalar()
        weight = F.ln((n + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
        weighted = terms.join(index.select("term", "df"), "term", "left").select(
            "query_id", F.struct("term", weight.alias("idf")).alias("item")
        )
        # One row per query; its list is as long as the query has distinct terms.
        per_query = weighted.groupBy("query_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
        scored = pairs.join(per_query, "query_id", "left")

        def total(items):
            return F.aggregate(items, F.lit(0.0), lambda acc, i: acc + i["idf"])

        # The passage is bound as a lambda variable, so it is tokenised once per pair.
        hits = F.transform(
            F.array(tokenizer(F.col("text"))),
            lambda passage: total(F.filter("items", lambda i: F.array_contains(passage, i["term"]))),
        )
        value = F.when(F.size("items") > 0, F.element_at(hits, 1) / total(F.col("items"))).otherwise(0.0)
        return scored.select("query_id", "doc_id", F.round(value, SCORE_DIGITS).alias("rerank_score"))

    return score


def retrieve_rerank(hits: DataFrame, docs: DataFrame, queries: DataFrame, scorer: PairScorer) -> DataFrame:
    """Re-order retrieved ``hits`` by a pair scorer; keeps both scores and both ranks."""
    # Hits are at most pool_size rows per query, so the joins move few rows.
    pairs = hits.join(queries.select("query_id", "query"), "query_id").join(docs.select("doc_id", "text"), "doc_id")
    rescored = hits.join(scorer(pairs), ["query_id", "doc_id"])
    order = [F.desc("rerank_score"), F.asc("rank")]
    ranked = top_k(rescored, ["query_id"], order, 2**31 - 1, rank="rerank_rank")
    return ranked.select("query_id", "doc_id", "score", "rank", "rerank_score", "rerank_rank")


def compare_search(
    docs: DataFrame, queries: DataFrame, encoder: Encoder, scorer: PairScorer, k: int = 5,
    pool_size: int | None = None,
) -> DataFrame:
    """``(query_id, method, rank, doc_id, score)`` of lexical, semantic and reranked lists."""
    lexical = BM25Index.build(docs).search(queries, k)
    corpus = encode_texts(docs, encoder, "doc_id", "text")
    pool = semantic_search(corpus, encode_texts(queries, encoder, "query_id", "query"), pool_size or k)
    reranked = retrieve_rerank(pool, docs, queries, scorer).where(F.col("rerank_rank") <= k)
    columns = ["query_id", "method", "rank", "doc_id", "score"]
    return (
        lexical.withColumn("method", F.lit("bm25")).select(columns)
        .unionByName(pool.where(F.col("rank") <= k).withColumn("method", F.lit("bi_encoder")).select(columns))
        .unionByName(
            reranked.select(
                "query_id", F.lit("reranked").alias("method"), F.col("rerank_rank").alias("rank"), "doc_id",
                F.col("rerank_score").alias("score"),
            )
        )
    )
