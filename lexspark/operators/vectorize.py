"""Count and TF-IDF vectors as relational postings ``(doc_id, term, weight)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.rows import unnest, unnest_structs
from lexspark.functions.ranking import top_k
from lexspark.functions.text import Tokenizer, term_counts, word_tokens
from lexspark.operators.matching import best_documents, is_small_batch
from lexspark.operators.postings import forward_index

SIM_DIGITS = 6


@dataclass
class TermVectorizer:
    """A fitted vocabulary ``(term, df, idf)`` over ``n_docs`` documents.

    ``kind`` is ``"tfidf"`` (smooth idf, L2-normalised rows) or ``"count"`` (raw counts).
    """

    vocabulary: DataFrame
    kind: str = "tfidf"
    tokenizer: Tokenizer = word_tokens
    n_docs: int = 0

    @classmethod
    def fit(cls, docs: DataFrame, kind: str = "tfidf", tokenizer: Tokenizer = word_tokens) -> TermVectorizer:
        kind = kind.strip().lower()
        if kind not in ("count", "tfidf"):
            raise ValueError("kind must be 'count' or 'tfidf'")
        counts = docs if "counts" in docs.columns else forward_index(docs, tokenizer)
        distinct = unnest(counts, [], "counts.term", "term")
        n_docs = counts.count()
        idf = F.ln((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1
        vocabulary = distinct.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf)
        return cls(vocabulary, kind, tokenizer, n_docs)

    def save(self, path: str) -> None:
        """The vocabulary, and one row ``(kind, n_docs)``; the tokeniser is code and is given again on loading."""
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        settings = self.vocabulary.sparkSession.createDataFrame([(self.kind, self.n_docs)], "kind string, n_docs long")
        settings.write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokenizer: Tokenizer = word_tokens) -> TermVectorizer:
        settings = spark.read.parquet(f"{path}/settings").first()
        return cls(spark.read.parquet(f"{path}/vocabulary"), settings["kind"], tokenizer, settings["n_docs"])

    def counts(self, texts: DataFrame, key: str = "doc_id") -> DataFrame:
        """Raw term counts of texts, or of a forward index; narrow."""
        if "counts" in texts.columns:
            return unnest_structs(texts, [key], "counts")
        return unnest_structs(texts, [key], term_counts(self.tokenizer(F.col("text"))))

    def weighted(self, texts: DataFrame, key: str = "doc_id") -> DataFrame:
        """Unnormalised weights ``(key, term, w)`` of terms in the vocabulary.

        The vocabulary has one row per term, so a term that fills a third of the postings is
        skewed on one side only and AQE can split it.
        """
        known = self.counts(texts, key).join(self.vocabulary.select("term", "idf"), "term")
        weight = F.col("tf") * F.col("idf") if self.kind == "tfidf" else F.col("tf").cast("double")
        return known.select(key, "term", weight.alias("w"))

    def transform(self, texts: DataFrame, key: str = "doc_id") -> DataFrame:
        """Row vectors ``(key, term, weight)``."""
        weighted = self.weighted(texts, key)
        if self.kind == "count":
            return weighted.select(key, "term", F.col("w").cast("int").alias("weight"))
        norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return weighted.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))

    def similarities(self, docs: DataFrame, queries: DataFrame) -> DataFrame:
        """``(query_id, doc_id, sim)`` of every query and document that share a term.

        ``docs`` is a text table or its forward index.
        """
        q = self.weighted(queries.select("query_id", F.col("query").alias("text")), "query_id")
        q_norm = q.groupBy("query_id").agg(F.sum(F.col("w") * F.col("w")).alias("qq"))
        d = self.weighted(docs)
        d_norm = d.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("dd"))
        dots = (
            d.join(q.withColumnRenamed("w", "qw"), "term")
            .groupBy("query_id", "doc_id")
            .agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
        )
        sim = F.round(F.col("dot") / (F.sqrt("dd") * F.sqrt("qq")), SIM_DIGITS)
        return (
            dots.join(q_norm, "query_id").join(d_norm, "doc_id").select("query_id", "doc_id", sim.alias("sim"))
        )

    def _best(self, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, doc_id, sim, rank)``: the ``k`` most similar documents; for a usual batch each task keeps its own best."""
        if not is_small_batch(queries):
            return top_k(self.similarities(docs, queries), ["query_id"], [F.desc("sim"), F.asc("doc_id")], k)
        forward = docs if "counts" in docs.columns else self.index(docs)
        q = self.weighted(queries.select("query_id", F.col("query").alias("text")), "query_id")
        q = q.join(self.vocabulary.select("term", "idf"), "term")
        q_norm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        own = F.col("idf") if self.kind == "tfidf" else F.lit(1.0)
        weights = q.join(q_norm, "query_id").select("query_id", "term", (F.col("w") * own / F.col("norm")).alias("weight"))
        d_norm = self.weighted(forward).groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        best = best_documents(forward, weights, lambda tf: tf / F.col("norm"), k, SIM_DIGITS, extra=d_norm)
        return best.withColumnRenamed("score", "sim")

    def terms_of(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, text, terms)``: the non-zero terms of each row, sorted."""
        terms = F.sort_array(F.array_distinct(self.tokenizer(F.col("text"))))
        return docs.select("doc_id", "text", terms.alias("terms"))

    def index(self, docs: DataFrame) -> DataFrame:
        """Forward index of ``docs`` in this vectoriser's tokens, to score many batches against."""
        return forward_index(docs, self.tokenizer)

    def top_n(
        self, docs: DataFrame, queries: DataFrame, n: int = 1, index: DataFrame | None = None
    ) -> DataFrame:
        """The ``n`` most similar texts per query, with their terms; ties by doc_id."""
        best = self._best(docs if index is None else index, queries, n)
        return best.join(self.terms_of(docs), "doc_id").select(
            "query_id", "rank", "doc_id", "sim", "text", "terms"
        )

    def has_match(
        self, docs: DataFrame, queries: DataFrame, threshold: float = 0.8, index: DataFrame | None = None
    ) -> DataFrame:
        """Per query: does any text exceed ``threshold``, the best similarity, its text and terms.

        A query that shares no term with the corpus gets similarity 0 and the first text.
        """
        best = self._best(docs if index is None else index, queries, 1)
        first_doc = docs.agg(F.min("doc_id").alias("first")).scalar()
        filled = queries.select("query_id").join(best, "query_id", "left").select(
            "query_id",
            F.coalesce("doc_id", first_doc).alias("doc_id"),
            F.coalesce("sim", F.lit(0.0)).alias("max_sim"),
        )
        return filled.join(self.terms_of(docs), "doc_id").select(
            "query_id", (F.col("max_sim") > threshold).alias("has_match"), "max_sim", "doc_id", "text", "terms"
        )

    def pairwise(self, pairs: DataFrame) -> DataFrame:
        """``(pair_id, sim)`` of two strings ``(pair_id, text_a, text_b)`` in the fitted space."""
        sides = pairs.select("pair_id", F.explode(F.array(
            F.struct(F.lit("a").alias("side"), F.col("text_a").alias("text")),
            F.struct(F.lit("b").alias("side"), F.col("text_b").alias("text")),
        )).alias("s")).select(F.struct("pair_id", "s.side").alias("key"), "s.text")
        w = self.weighted(sides, "key").select("key.pair_id", "key.side", "term", "w")
        per_term = w.groupBy("pair_id", "term").agg(
            F.sum(F.when(F.col("side") == "a", F.col("w")).otherwise(0.0)).alias("wa"),
            F.sum(F.when(F.col("side") == "b", F.col("w")).otherwise(0.0)).alias("wb"),
        )
        sums = per_term.groupBy("pair_id").agg(
            F.sum(F.col("wa") * F.col("wb")).alias("ab"),
            F.sum(F.col("wa") * F.col("wa")).alias("aa"),
            F.sum(F.col("wb") * F.col("wb")).alias("bb"),
        )
        norm = F.sqrt("aa") * F.sqrt("bb")
        sim = F.when(norm > 0, F.round(F.col("ab") / norm, SIM_DIGITS)).otherwise(F.lit(0.0))
        return pairs.select("pair_id").join(
            sums.select("pair_id", sim.alias("sim")), "pair_id", "left"
        ).select("pair_id", F.coalesce("sim", F.lit(0.0)).alias("sim"))
