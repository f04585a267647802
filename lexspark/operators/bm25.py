"""BM25 index and batch search over a document table ``(doc_id, text)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.rows import unnest_structs
from lexspark.functions.materialize import cut_lineage, ordered_index
from lexspark.functions.ranking import top_k
from lexspark.functions.text import Tokenizer, bm25_tokens, term_counts
from lexspark.operators.matching import best_documents, is_small_batch
from lexspark.operators.postings import forward_index

# The standard Okapi parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
SCORE_DIGITS = 4
# Folders of a stored index, and document numbers listed at a time.
TERM_BUCKETS, FILL_CHUNK = 256, 65_536


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _gain(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


@dataclass
class BM25Index:
    """``documents(doc_id, dl)``, ``postings(doc_id, dl, term, tf)`` and ``terms(term, df, idf)``.

    ``build`` tokenises the corpus once into a stored forward index; the rest is lazy over it.
    ``write`` stores everything for later search jobs: postings in one folder per bucket of terms,
    sorted by term, so a search reads the folders of its terms only; documents with their number in
    ``doc_id`` order. ``stats`` holds one row ``(n_docs, avgdl, mean_idf)``.
    """

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    tokenizer: Tokenizer
    forward: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, tokenizer: Tokenizer = bm25_tokens) -> BM25Index:
        counted = forward_index(docs, tokenizer)
        documents = counted.select("doc_id", "dl")
        postings = unnest_structs(counted, ["doc_id", "dl"], "counts")
        sizes = documents.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
        # A term occurs once per document in postings, so its row count is its document frequency.
        frequencies = postings.groupBy("term").agg(F.count("*").alias("df"))
        n_docs = sizes.select("n_docs").scalar()
        raw = frequencies.withColumn(
            "raw_idf", F.ln(n_docs - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
        )
        mean_idf = raw.agg(F.avg("raw_idf").alias("mean_idf"))
        floored = F.when(F.col("raw_idf") < 0, EPSILON * mean_idf.scalar()).otherwise(F.col("raw_idf"))
        terms = raw.select("term", "df", floored.alias("idf"))
        stats = sizes.select("n_docs", "avgdl", mean_idf.scalar().alias("mean_idf"))
        return cls(documents, postings, terms, stats, tokenizer, counted)

    def write(self, path: str, buckets: int = TERM_BUCKETS, files_per_bucket: int = 8) -> None:
        """Store the index. A term in very many documents is spread over the files of its bucket."""
        self._numbered().write.mode("overwrite").parquet(f"{path}/documents")
        bucketed = self.postings.withColumn("bucket", _bucket(F.col("term"), buckets))
        spread = F.pmod(F.xxhash64("doc_id"), F.lit(files_per_bucket))
        bucketed.repartition("bucket", spread).sortWithinPartitions("bucket", "term", "doc_id").write.mode(
            "overwrite"
        ).partitionBy("bucket").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark, path: str, tokenizer: Tokenizer = bm25_tokens) -> BM25Index:
        read = spark.read.parquet
        return cls(
            read(f"{path}/documents"), read(f"{path}/postings"), read(f"{path}/terms"),
            read(f"{path}/stats"), tokenizer,
        )

    def _query_terms(self, queries: DataFrame) -> DataFrame:
        """``(query_id, term, qtf)``; a repeated query token counts as often as it occurs."""
        counts = term_counts(self.tokenizer(F.col("query")))
        return unnest_structs(queries, ["query_id"], counts).withColumnRenamed("tf", "qtf")

    def scores(self, queries: DataFrame) -> DataFrame:
        """``(query_id, doc_id, score)`` for every document that shares a term with the query."""
        weighted = self._query_terms(queries).join(self.terms.select("term", "idf"), "term")
        contribution = F.col("qtf") * F.col("idf") * _gain(F.col("tf"), F.col("dl"), self.stats.select("avgdl").scalar())
        # The query side is small in the usual case and Catalyst broadcasts it on its size; when it
        # is not, the equi-join on term shuffles and AQE splits the frequent terms.
        return (
            self._postings_of(weighted).join(weighted, "term")
            .groupBy("query_id", "doc_id")
            .agg(F.round(F.sum(contribution), SCORE_DIGITS).alias("score"))
        )

    def _postings_of(self, weighted: DataFrame) -> DataFrame:
        """Postings of a stored index without the buckets no query term is in; the list has one number a bucket at most."""
        if "bucket" not in self.postings.columns:
            return self.postings
        buckets = self.stats.select("buckets").first()["buckets"]
        asked = weighted.select(_bucket(F.col("term"), buckets).alias("bucket")).distinct().collect()
        return self.postings.where(F.col("bucket").isin([row["bucket"] for row in asked])).drop("bucket")

    def _numbered(self) -> DataFrame:
        """Documents with ``number``, from 0 in the order of ``doc_id``."""
        return self.documents if "number" in self.documents.columns else ordered_index(self.documents, [F.asc("doc_id")], "number")

    def search(self, queries: DataFrame, k: int = 5, zero_fill: bool = True) -> DataFrame:
        """Top ``k`` documents per query: ``(query_id, doc_id, score, rank)``, ties by doc_id.

        Every document has a score, so when fewer than ``k`` score above zero the result is filled
        with zero-score documents in doc_id order.
        """
        order = [F.desc("score"), F.asc("doc_id")]
        if not zero_fill:
            return self._best(queries, k)
        best = cut_lineage(self._best(queries, k), "best")
        positive = best.where("score > 0").groupBy("query_id").agg(F.count("*").alias("positive"))
        short = queries.join(positive, "query_id", "left").where(F.coalesce("positive", F.lit(0)) < k).drop("positive")
        if short.isEmpty():
            return best
        return top_k(best.drop("rank").unionByName(self._zero_fill(short, k)), ["query_id"], order, k)

    def _best(self, queries: DataFrame, k: int) -> DataFrame:
        """Top ``k`` of the documents that share a term; for a usual batch over a built index each task keeps its own best."""
        if self.forward is None or not is_small_batch(queries):
            return top_k(self.scores(queries), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
        weights = self._query_terms(queries).join(self.terms.select("term", "idf"), "term")
        weights = weights.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
        avgdl = F.lit(self.stats.first()["avgdl"])
        return best_documents(self.forward, weights, lambda tf: _gain(tf, F.col("dl"), avgdl), k, SCORE_DIGITS, keep=["dl"])

    def _zero_fill(self, short: DataFrame, k: int) -> DataFrame:
        """The first ``k`` documents that match nothing of a query, for each query of ``short``.

        Of the first ``matched + k`` documents at least ``k`` match nothing, if there are so many at all. Their
        numbers are listed in chunks and those that match are taken out by an anti-join, so this costs each query
        about as many rows as it has matches, also where a negative floor lets it match nearly everything.
        """
        documents = cut_lineage(self._numbered().select("doc_id", "number"), "numbers")
        matched = self.scores(short).join(documents, "doc_id").select("query_id", "number")
        matched = cut_lineage(matched, "matched")
        sizes = matched.groupBy("query_id").agg(F.count("*").alias("matched"))
        last = F.least(F.coalesce("matched", F.lit(0)) + k, F.lit(documents.count())) - 1
        wanted = short.select("query_id").distinct().join(sizes, "query_id", "left").select("query_id", last.alias("last")).where("last >= 0")
        chunks = wanted.select("query_id", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last", F.lit(FILL_CHUNK).cast("long"))).alias("low"))
        numbers = chunks.select("query_id", F.explode(F.sequence("low", F.least("last", F.col("low") + FILL_CHUNK - 1))).alias("number"))
        free = top_k(numbers.join(matched, ["query_id", "number"], "left_anti"), ["query_id"], [F.asc("number")], k)
        return free.join(documents, "number").select("query_id", "doc_id", F.lit(0.0).alias("score"))
