"""Registered queries: encoders, vector expressions, semantic and approximate search, rerank."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions.rows import unnest, unnest_with_position
from lexspark.functions.encode import HashedTokenEncoder
from lexspark.functions.materialize import cut_lineage
from lexspark.functions.text import word_tokens
from lexspark.functions.vector import l2_normalize
from lexspark.operators import ann, search
from lexspark.operators.grading import pair_similarity
from lexspark.operators.postings import forward_index
from lexspark.plans.common import documents, encode_sql, queries_table, table, vectors, word_tokens_sql
from lexspark.plans.lexical import BM25_SQL

ENCODER = HashedTokenEncoder()


def encoded_documents(spark, sf):
    return search.encode_texts(documents(spark, sf), ENCODER, "doc_id", "text")


def encoded_queries(spark, sf):
    return search.encode_texts(queries_table(spark, sf), ENCODER, "query_id", "query")


def encode_hashed(spark, sf):
    long = unnest_with_position(encoded_documents(spark, sf), ["doc_id"], "embedding", "bucket", "x")
    return long.where("x <> 0").select("doc_id", "bucket", F.round("x", 6).alias("weight"))


def l2_normalized(spark, sf):
    doubled = F.transform("embedding", lambda x: x * 2)
    unit = vectors(spark, sf).select("doc_id", l2_normalize(doubled).alias("v"))
    return unnest_with_position(unit, ["doc_id"], "v", "pos", "x").withColumn("x", F.round("x", 6))


def pair_sims(spark, sf):
    """Each vector against its successor by id."""
    v = vectors(spark, sf)
    following = v.select((F.col("doc_id") - 1).alias("doc_id"), F.col("embedding").alias("other"))
    return pair_similarity(v.join(following, "doc_id"), "embedding", "other").select("doc_id", "cosine", "dot")


def semantic(spark, sf):
    return search.semantic_search(encoded_documents(spark, sf), encoded_queries(spark, sf), 5)


def keyword_filtered(spark, sf):
    return search.keyword_filtered_search(documents(spark, sf), queries_table(spark, sf), "tion", ENCODER, 5)


def label_centroids(spark, sf):
    """Unit mean vector of each label: fixed centroids that make the cell queries deterministic."""
    v = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = v.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    arrays = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return arrays.select(F.col("label").alias("cell"), l2_normalize(F.col("p.x")).alias("centroid"))


def _vector_queries(spark, sf):
    return vectors(spark, sf).withColumnRenamed("doc_id", "query_id")


def ivf_train(spark, sf):
    cells = ann.train_cells(vectors(spark, sf))
    return cells.select("cell", F.size("centroid").alias("dim"))


def ivf_assign(spark, sf):
    return ann.assign_cells(vectors(spark, sf), label_centroids(spark, sf)).select("doc_id", "cell")


def ivf_hits(spark, sf):
    index = ann.CellIndex.build(vectors(spark, sf), label_centroids(spark, sf))
    return index.search(_vector_queries(spark, sf))


def exact_hits(spark, sf):
    return search.semantic_search(vectors(spark, sf), _vector_queries(spark, sf), 5)


def ann_mean_recall(spark, sf):
    return ann.mean_recall(ivf_hits(spark, sf), exact_hits(spark, sf))


def _scorer(docs):
    index = forward_index(docs, word_tokens)
    frequencies = unnest(index, [], "counts.term", "term").groupBy("term").agg(F.count("*").alias("df"))
    return search.overlap_scorer(frequencies, index.agg(F.count("*").alias("n")))


def rerank(spark, sf):
    docs = documents(spark, sf)
    hits = search.semantic_search(encoded_documents(spark, sf), encoded_queries(spark, sf), 5)
    hits = cut_lineage(hits, "hits")
    return search.retrieve_rerank(hits, docs, queries_table(spark, sf), _scorer(docs))


def compare(spark, sf):
    docs = documents(spark, sf)
    return search.compare_search(docs, queries_table(spark, sf), ENCODER, _scorer(docs), k=5)


QUERIES = {
    "encode_hashed": encode_hashed,
    "l2_normalize": l2_normalized,
    "pair_similarity": pair_sims,
    "semantic_search": semantic,
    "keyword_filtered_search": keyword_filtered,
    "ivf_train": ivf_train,
    "ivf_assign": ivf_assign,
    "ivf_search": ivf_hits,
    "ann_recall": lambda spark, sf: ann.recall(ivf_hits(spark, sf), exact_hits(spark, sf)),
    "ann_mean_recall": ann_mean_recall,
    "ann_missing": lambda spark, sf: ann.missing_hits(ivf_hits(spark, sf), exact_hits(spark, sf)),
    "retrieve_rerank": rerank,
    "compare_search": compare,
}

_ENC = f"""{encode_sql('dv', 'documents', 'doc_id', 'text')}, {encode_sql('qv', 'benchmark', 'item_id', 'text')}"""


def _semantic_sql(where: str = "TRUE") -> str:
    return f"""{_ENC},
sims AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.w * d.w) AS s FROM qv q JOIN dv d USING (bucket) GROUP BY 1, 2),
sem AS (
  SELECT * FROM (
    SELECT item_id AS query_id, d.doc_id, round(coalesce(s, 0), 6) + 0.0::DOUBLE AS score,
           row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(s, 0), 6) DESC, d.doc_id) AS rank
    FROM benchmark CROSS JOIN documents d LEFT JOIN sims ON sims.query_id = item_id AND sims.doc_id = d.doc_id
    WHERE {where})
  WHERE rank <= 5)"""


_KEYWORD_SEM_SQL = _semantic_sql("contains(d.text, 'tion')")
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_EXACT_SQL = f"""
exact AS (
  SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({_COS}, 6) AS score FROM embeddings a CROSS JOIN embeddings b))
  WHERE rank <= 5)"""
_CELLS_SQL = """
comp AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, pos, avg(x) AS x FROM comp GROUP BY 1, 2),
cent AS (SELECT label AS cell, list(x / n ORDER BY pos) AS centroid
         FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM means) GROUP BY 1),
near AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id
           ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) DESC, cell) AS rn
         FROM embeddings CROSS JOIN cent)"""
_IVF_SQL = _CELLS_SQL + f""",
ivf AS (
  SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({_COS}, 6) AS score
          FROM embeddings a JOIN near p ON p.vec_id = a.vec_id AND p.rn <= 3
          JOIN near c ON c.cell = p.cell AND c.rn = 1 JOIN embeddings b ON b.vec_id = c.vec_id))
  WHERE rank <= 5)"""
_RECALL_SQL = "SELECT e.query_id, round(count(i.doc_id) / count(*), 4) AS recall FROM exact e LEFT JOIN ivf i ON i.query_id = e.query_id AND i.doc_id = e.doc_id GROUP BY 1"
_RERANK_SQL = f"""
dw AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({word_tokens_sql('text')}) AS term FROM documents) GROUP BY 1),
qw AS (SELECT DISTINCT item_id AS query_id, unnest({word_tokens_sql('text')}) AS term FROM benchmark),
qi AS (SELECT query_id, term, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (coalesce(df, 0) + 1)) + 1 AS idf FROM qw LEFT JOIN dw USING (term)),
pass AS (SELECT query_id, doc_id, score, rank, {word_tokens_sql('text')} AS toks FROM sem JOIN documents USING (doc_id)),
scored2 AS (SELECT query_id, doc_id, any_value(score) AS score, any_value(rank) AS rank,
       round(coalesce(sum(CASE WHEN list_contains(toks, term) THEN idf ELSE 0 END) / sum(idf), 0), 6) AS rerank_score
     FROM pass LEFT JOIN qi USING (query_id) GROUP BY 1, 2),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank_rank FROM scored2)"""

ORACLES = {
    "encode_hashed": f"WITH {encode_sql('v', 'documents', 'doc_id', 'text')} SELECT id AS doc_id, bucket, round(w, 6) AS weight FROM v",
    "l2_normalize": "WITH c AS (SELECT vec_id AS doc_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE * 2 AS x FROM embeddings) SELECT doc_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM c",
    "pair_similarity": f"SELECT a.vec_id AS doc_id, round({_COS}, 6) AS cosine, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "semantic_search": f"WITH {_semantic_sql()} SELECT query_id, doc_id, score, rank FROM sem",
    "keyword_filtered_search": f"WITH {_KEYWORD_SEM_SQL} SELECT query_id, doc_id, score, rank FROM sem",
    "ivf_assign": f"WITH {_CELLS_SQL} SELECT vec_id AS doc_id, cell FROM near WHERE rn = 1",
    "ivf_search": f"WITH {_IVF_SQL} SELECT query_id, doc_id, score, rank FROM ivf",
    "ann_recall": f"WITH {_IVF_SQL}, {_EXACT_SQL} {_RECALL_SQL}",
    "ann_mean_recall": f"WITH {_IVF_SQL}, {_EXACT_SQL} SELECT round(avg(recall), 4) AS mean_recall FROM ({_RECALL_SQL})",
    "ann_missing": f"WITH {_IVF_SQL}, {_EXACT_SQL} SELECT query_id, doc_id, score, rank FROM exact e WHERE NOT EXISTS (SELECT 1 FROM ivf i WHERE i.query_id = e.query_id AND i.doc_id = e.doc_id)",
    "retrieve_rerank": f"WITH {_semantic_sql()}, {_RERANK_SQL} SELECT query_id, doc_id, score, rank, rerank_score, rerank_rank FROM rr",
    "compare_search": f"""WITH {BM25_SQL}, {_semantic_sql()}, {_RERANK_SQL}
SELECT query_id, 'bm25' AS method, rank, doc_id, score FROM bm25_hits
UNION ALL SELECT query_id, 'bi_encoder', rank, doc_id, score FROM sem
UNION ALL SELECT query_id, 'reranked', rerank_rank, doc_id, rerank_score FROM rr""",
}
