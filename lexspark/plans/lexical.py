"""Registered queries: tokenisers, term vectors, BM25."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions.rows import unnest_with_position
from lexspark.functions import text as T
from lexspark.functions.materialize import new_table_path
from lexspark.functions.text import PUNCTUATION, WHITESPACE
from lexspark.operators.bm25 import BM25Index
from lexspark.operators.postings import forward_index
from lexspark.operators.vectorize import TermVectorizer
from lexspark.plans.common import (
    NORMALIZED_STOPWORDS_SQL, STOPWORDS_SQL, bm25_tokens_sql, documents, queries_table, sql_text, table, word_tokens_sql,
)


def _tokens(expression):
    def run(spark, sf):
        docs = documents(spark, sf)
        return unnest_with_position(docs, ["doc_id"], expression(F.col("text")), "pos", "token")
    return run


def _tokens_sql(expression: str) -> str:
    return f"""
WITH t AS (SELECT doc_id, {expression} AS toks FROM documents)
SELECT doc_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token FROM t"""


def bm25_index(spark, sf):
    return BM25Index.build(documents(spark, sf)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_search(spark, sf):
    return BM25Index.build(documents(spark, sf)).search(queries_table(spark, sf), k=5)


def count_vectors(spark, sf):
    index = forward_index(documents(spark, sf), T.word_tokens)
    return TermVectorizer.fit(index, "count").transform(index)


def tfidf_vectors(spark, sf):
    index = forward_index(documents(spark, sf), T.word_tokens)
    return TermVectorizer.fit(index).transform(index).withColumn("weight", F.round("weight", 6))


def vectorizer_roundtrip(spark, sf):
    path = new_table_path(spark, "vectorizer")
    TermVectorizer.fit(documents(spark, sf)).save(path)
    unseen = queries_table(spark, sf).select("query_id", F.col("query").alias("text"))
    out = TermVectorizer.load(spark, path).transform(unseen, "query_id")
    return out.withColumn("weight", F.round("weight", 6))


def tfidf_top_n(spark, sf):
    docs = documents(spark, sf)
    index = forward_index(docs, T.word_tokens)
    best = TermVectorizer.fit(index).top_n(docs, queries_table(spark, sf), n=3, index=index)
    return best.select("query_id", "rank", "doc_id", "sim", "text", F.array_join("terms", " ").alias("terms"))


def tfidf_has_match(spark, sf):
    docs = documents(spark, sf)
    index = forward_index(docs, T.word_tokens)
    out = TermVectorizer.fit(index).has_match(docs, queries_table(spark, sf), threshold=0.8, index=index)
    return out.withColumn("terms", F.array_join("terms", " "))


def qa_pairs(spark, sf):
    """User turns joined with the assistant turn that follows them."""
    conversations = table(spark, sf, "conversations")
    user = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = conversations.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return user.join(reply, ["conv_id", "turn"]).withColumn(
        "pair_id", F.concat_ws("-", "conv_id", "turn")
    )


QA_SQL = """
qa AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer,
         u.conv_id || '-' || u.turn AS pair_id
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def tfidf_pairwise(spark, sf):
    pairs = qa_pairs(spark, sf).select(
        "pair_id", F.col("question").alias("text_a"), F.col("answer").alias("text_b")
    )
    return TermVectorizer.fit(documents(spark, sf)).pairwise(pairs)


def _normalize(spark, sf):
    return documents(spark, sf).select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


def _truncate(spark, sf):
    kept = T.truncate_tokens(T.word_tokens(F.col("text")), 128)
    return documents(spark, sf).select("doc_id", F.array_join(kept, " ").alias("tokens"))


def _flatten(spark, sf):
    return documents(spark, sf).select("doc_id", T.flatten_newlines(F.col("text")).alias("line"))


def _windows(spark, sf):
    docs = documents(spark, sf)
    tokens = T.wordpunct_tokens(F.col("text"))
    chunks = unnest_with_position(docs, ["doc_id"], T.token_windows(tokens, 4, 2), "chunk_no", "chunk")
    return chunks.withColumn("chunk", F.array_join("chunk", " "))


def _paragraphs(spark, sf):
    docs = documents(spark, sf)
    windows = T.paragraph_windows(F.col("text"), 2, 1)
    return unnest_with_position(docs, ["doc_id"], windows, "chunk_no", "chunk").withColumn(
        "chunk", F.array_join("chunk", "\n")
    )


QUERIES = {
    "bm25_search": bm25_search,
    "bm25_index": bm25_index,
    "tokenize_bm25": _tokens(T.bm25_tokens),
    "tokenize_words": _tokens(T.word_tokens),
    "tokenize_wordpunct": _tokens(T.wordpunct_tokens),
    "tokens_no_stopwords": _tokens(lambda c: T.remove_stopwords(T.word_tokens(c), T.NORMALIZED_STOPWORDS)),
    "normalize_text": _normalize,
    "truncate_tokens": _truncate,
    "flatten_newlines": _flatten,
    "chunk_windows": _windows,
    "chunk_paragraphs": _paragraphs,
    "count_vectors": count_vectors,
    "tfidf_vectors": tfidf_vectors,
    "vectorizer_roundtrip": vectorizer_roundtrip,
    "tfidf_top_n": tfidf_top_n,
    "tfidf_has_match": tfidf_has_match,
    "tfidf_pairwise": tfidf_pairwise,
}

BM25_SQL = f"""
pieces AS (SELECT doc_id, trim(unnest(regexp_split_to_array(lower(text), {sql_text(WHITESPACE)})), {sql_text(PUNCTUATION)}) AS term FROM documents),
tf AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM pieces ANTI JOIN (SELECT unnest({STOPWORDS_SQL}) AS term) s USING (term) WHERE term <> '' GROUP BY 1, 2),
docs AS MATERIALIZED (SELECT documents.doc_id, coalesce(n, 0) AS dl FROM documents LEFT JOIN (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY 1) USING (doc_id)),
raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM docs) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS r
        FROM tf GROUP BY 1),
terms AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25::DOUBLE * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT item_id AS query_id, unnest({bm25_tokens_sql('text')}) AS term FROM benchmark),
scored AS (
  SELECT query_id, tf.doc_id,
         sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(dl) FROM docs)))) AS s
  FROM qt JOIN tf USING (term) JOIN terms USING (term) JOIN docs ON docs.doc_id = tf.doc_id GROUP BY 1, 2),
allscores AS (
  SELECT b.item_id AS query_id, d.doc_id, round(coalesce(s, 0), 4) AS score
  FROM benchmark b CROSS JOIN docs d LEFT JOIN scored ON scored.query_id = b.item_id AND scored.doc_id = d.doc_id),
bm25_hits AS (
  SELECT * FROM (SELECT query_id, doc_id, score,
                        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM allscores)
  WHERE rank <= 5)"""


def tfidf_sql(texts: str) -> str:
    """``texts`` is a relation (key, text); the vocabulary comes from documents."""
    return f"""
dtok AS (SELECT doc_id, unnest({word_tokens_sql('text')}) AS term FROM documents),
vocab AS (SELECT term, ln((SELECT count(*) + 1.0::DOUBLE FROM documents) / (count(DISTINCT doc_id) + 1)) + 1 AS idf
          FROM dtok GROUP BY 1),
xtok AS (SELECT key, unnest({word_tokens_sql('text')}) AS term FROM ({texts})),
x AS (SELECT key, term, count(*) * any_value(idf) AS w FROM xtok JOIN vocab USING (term) GROUP BY 1, 2),
d AS (SELECT doc_id, term, count(*) * any_value(idf) AS w FROM dtok JOIN vocab USING (term) GROUP BY 1, 2)"""


_SIMS_SQL = f"""WITH {tfidf_sql('SELECT item_id AS key, text FROM benchmark')},
qn AS (SELECT key, sqrt(sum(w * w)) AS n FROM x GROUP BY 1),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM d GROUP BY 1),
sims AS (SELECT key AS query_id, doc_id, round(s / (dn.n * qn.n), 6) AS sim
         FROM (SELECT key, doc_id, sum(x.w * d.w) AS s FROM x JOIN d USING (term) GROUP BY 1, 2)
         JOIN qn USING (key) JOIN dn USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM sims)"""
_TERMS_SQL = f"array_to_string(list_sort(list_distinct({word_tokens_sql('text')})), ' ')"

_WP_SQL = f"regexp_extract_all(text, {sql_text(T.WORDPUNCT_PATTERN)})"


def windows_sql(tokens: str, source: str, key: str, window: int, offset: int) -> str:
    """(key, chunk_no, chunk array); the trailing remainder is included, possibly empty."""
    return f"""
SELECT {key}, j AS chunk_no, toks[j * {offset} + 1 : j * {offset} + {window}] AS chunk
FROM (SELECT {key}, toks, unnest(range(0, greatest(0, floor((len(toks) - {window}) / {offset})::BIGINT) + 2)) AS j
      FROM (SELECT {key}, {tokens} AS toks FROM {source}))"""


ORACLES = {
    "bm25_search": f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM bm25_hits",
    "bm25_index": f"WITH {BM25_SQL} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "tokenize_bm25": _tokens_sql(bm25_tokens_sql("text")),
    "tokenize_words": _tokens_sql(word_tokens_sql("text")),
    "tokenize_wordpunct": _tokens_sql(_WP_SQL),
    "tokens_no_stopwords": _tokens_sql(
        f"list_filter({word_tokens_sql('text')}, lambda t: NOT list_contains({NORMALIZED_STOPWORDS_SQL}, t))"
    ),
    "normalize_text": f"SELECT doc_id, strip_accents(lower(regexp_replace(text, {sql_text('^' + T.WHITESPACE + '|' + T.WHITESPACE + '$')}, '', 'g'))) AS normalized FROM documents",
    "truncate_tokens": f"SELECT doc_id, coalesce(array_to_string(({word_tokens_sql('text')})[1:128], ' '), '') AS tokens FROM documents",
    "flatten_newlines": "SELECT doc_id, replace(text, chr(10), ' ') AS line FROM documents",
    "chunk_windows": f"SELECT doc_id, chunk_no, coalesce(array_to_string(chunk, ' '), '') AS chunk FROM ({windows_sql(_WP_SQL, 'documents', 'doc_id', 4, 2)})",
    "chunk_paragraphs": f"""
WITH c AS ({windows_sql("list_filter(regexp_split_to_array(text, chr(10) || '+'), lambda p: trim(p, ' ') <> '')", 'documents', 'doc_id', 2, 1)}),
kept AS (SELECT doc_id, chunk_no, chunk FROM c WHERE len(chunk) > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1 AS chunk_no,
       array_to_string(chunk, chr(10)) AS chunk FROM kept""",
    "count_vectors": f"SELECT doc_id, term, count(*) AS weight FROM (SELECT doc_id, unnest({word_tokens_sql('text')}) AS term FROM documents) GROUP BY 1, 2",
    "tfidf_vectors": f"WITH {tfidf_sql('SELECT doc_id AS key, text FROM documents')} SELECT key AS doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 6) AS weight FROM x",
    "vectorizer_roundtrip": f"WITH {tfidf_sql('SELECT item_id AS key, text FROM benchmark')} SELECT key AS query_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 6) AS weight FROM x",
    "tfidf_top_n": f"{_SIMS_SQL} SELECT query_id, rank, doc_id, sim, text, {_TERMS_SQL} AS terms FROM ranked JOIN documents USING (doc_id) WHERE rank <= 3",
    "tfidf_has_match": f"""{_SIMS_SQL}, best AS (
  SELECT item_id AS query_id, coalesce(doc_id, (SELECT min(doc_id) FROM documents)) AS doc_id, coalesce(sim, 0) AS max_sim
  FROM benchmark LEFT JOIN ranked ON ranked.query_id = item_id AND rank = 1)
SELECT query_id, max_sim > 0.8 AS has_match, max_sim, doc_id, text, {_TERMS_SQL} AS terms FROM best JOIN documents USING (doc_id)""",
    "tfidf_pairwise": f"""WITH {QA_SQL}, {tfidf_sql("SELECT pair_id || '|a' AS key, question AS text FROM qa UNION ALL SELECT pair_id || '|b', answer FROM qa")},
n AS (SELECT key, sqrt(sum(w * w)) AS n FROM x GROUP BY 1),
s AS (SELECT a.key[:-3] AS pair_id, sum(a.w * b.w) AS ab FROM x a JOIN x b ON a.term = b.term AND b.key = a.key[:-3] || '|b'
      WHERE a.key LIKE '%|a' GROUP BY 1)
SELECT pair_id, round(coalesce(ab / (na.n * nb.n), 0), 6) AS sim
FROM qa LEFT JOIN s USING (pair_id) LEFT JOIN n na ON na.key = pair_id || '|a' LEFT JOIN n nb ON nb.key = pair_id || '|b'""",
}
