"""Registered queries: Markdown sources, record tables, answers, grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions.encode import HashedTokenEncoder
from lexspark.functions.materialize import new_table_path
from lexspark.operators import grading, records
from lexspark.plans.common import documents, encode_sql, sql_text, table
from lexspark.plans.lexical import QA_SQL, qa_pairs
from lexspark.sources import markdown, tables

ENCODER = HashedTokenEncoder()


def markdown_segments(spark, sf):
    """Casebook text per question-answer pair: most with a quote, some without, some untitled."""
    shape = F.col("conv_id") % 5
    title = F.when(shape == 4, F.lit("conv ")).otherwise(F.concat(F.lit("**conv "), "pair_id", F.lit("**\n")))
    quote = F.when(shape == 3, F.lit("")).otherwise(F.concat(F.lit("\n>*"), "answer", F.lit("\\")))
    text = F.concat(F.lit("###"), title, F.col("question"), quote)
    return markdown.split_segments(qa_pairs(spark, sf).select("pair_id", text.alias("text")), "pair_id")


MARKDOWN_SQL = QA_SQL + r""",
md AS (
  SELECT pair_id, '###' || CASE WHEN conv_id % 5 = 4 THEN 'conv ' ELSE '**conv ' || pair_id || '**' || chr(10) END
         || question || CASE WHEN conv_id % 5 = 3 THEN '' ELSE chr(10) || '>*' || answer || '\' END AS text
  FROM qa),
seg AS (SELECT pair_id, generate_subscripts(s, 1) - 1 AS seg_no, unnest(s) AS segment
        FROM (SELECT pair_id, string_split(text, '###') AS s FROM md)),
m AS (
  SELECT pair_id, seg_no, segment,
         CASE WHEN regexp_matches(segment, '(?s)(\*{2}[^*]+\*{2})([^>]+?)(>.*)') THEN 1
              WHEN regexp_matches(segment, '(?s)(\*{2}[^*]+\*{2})([^>]+?)') THEN 2 END AS parse_pass
  FROM seg),
parsed AS (
  SELECT pair_id, seg_no, parse_pass,
    CASE parse_pass WHEN 1 THEN regexp_extract(segment, '(?s)(\*{2}[^*]+\*{2})([^>]+?)(>.*)', 1)
                    ELSE regexp_extract(segment, '(?s)(\*{2}[^*]+\*{2})([^>]+?)', 1) END AS title,
    CASE parse_pass WHEN 1 THEN regexp_extract(segment, '(?s)(\*{2}[^*]+\*{2})([^>]+?)(>.*)', 2)
                    ELSE regexp_extract(segment, '(?s)(\*{2}[^*]+\*{2})([^>]+?)', 2) END AS content,
    CASE parse_pass WHEN 1 THEN regexp_extract(segment, '(?s)(\*{2}[^*]+\*{2})([^>]+?)(>.*)', 3) END AS raw_text
  FROM m WHERE parse_pass IS NOT NULL)"""


def casebooks(spark, sf):
    """Two level-5 cases per pair; for even conversations a lone '#' separates them."""
    block = F.when(F.col("turn") % 4 == 0, F.lit("```alpha, beta,gamma```\n")).otherwise("")
    gap = F.when(F.col("conv_id") % 2 == 0, F.lit("#\n")).otherwise("")
    text = F.concat(
        F.lit("##### conv "), "pair_id", F.lit("\n"), "question", F.lit("\n"), block, F.lit("> "), "answer",
        F.lit("\n> fin\n"), gap, F.lit("##### suite "), "pair_id", F.lit("\n"), "answer", F.lit("\n"), gap,
    )
    return qa_pairs(spark, sf).select("pair_id", text.alias("text"))


BOOKS_SQL = QA_SQL + """,
books AS (
  SELECT pair_id, '##### conv ' || pair_id || chr(10) || question || chr(10)
    || CASE WHEN turn % 4 = 0 THEN '```alpha, beta,gamma```' || chr(10) ELSE '' END
    || '> ' || answer || chr(10) || '> fin' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN '#' || chr(10) ELSE '' END
    || '##### suite ' || pair_id || chr(10) || answer || chr(10)
    || CASE WHEN conv_id % 2 = 0 THEN '#' || chr(10) ELSE '' END AS text
  FROM qa),
found AS (SELECT pair_id, generate_subscripts(b, 1) - 1 AS case_no, unnest(b) AS body
          FROM (SELECT pair_id, regexp_extract_all(text, '(?s)(#{5})([^#]+)(#)', 2) AS b FROM books))"""


def md_cases(spark, sf):
    cases = markdown.parse_cases(casebooks(spark, sf), "pair_id")
    return cases.withColumn("keywords", F.array_join("keywords", "|"))


def md_cases_lenient(spark, sf):
    cases = markdown.parse_cases(casebooks(spark, sf), "pair_id", lenient=True)
    return cases.select("pair_id", "case_no", "title")


def source_records(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"),
        F.lit(None).cast("string").alias("raw_text"), F.lit(0).alias("level"),
    )


_RECORDS_SQL = "SELECT doc_id::VARCHAR AS id, text AS content, NULL::VARCHAR AS raw_text, 0 AS level FROM documents WHERE text IS NOT NULL"


def roundtrip_sources(spark, sf):
    path = new_table_path(spark, "records")
    tables.write_records(source_records(spark, sf), path)
    return tables.read_records(spark, path)


def _answers(spark, sf):
    conversations = table(spark, sf, "conversations")
    batch = conversations.select("text", F.col("conv_id").cast("string").alias("foreign_id"))
    existing = conversations.where("role = 'assistant' AND turn = 1").select(
        "text", F.col("conv_id").cast("string").alias("foreign_id")
    )
    return existing, batch


def append_alt_answers(spark, sf):
    existing, batch = _answers(spark, sf)
    accepted, rejected = tables.new_answers(existing, batch)
    return accepted.select("text", "foreign_id", F.lit(0).alias("rejected")).unionByName(rejected)


def embedding_cache_delta(spark, sf):
    docs = table(spark, sf, "documents")
    path = new_table_path(spark, "cache")
    cache = tables.refresh_embedding_cache(spark, path, docs.where("lang = 'fr'").select("text"), ENCODER)
    return tables.texts_to_encode(docs.select("text"), cache, ENCODER.name).select("content_hash")


def embedding_cache(spark, sf):
    """First load the French texts, then all: the second run encodes only the rest."""
    docs = table(spark, sf, "documents")
    path = new_table_path(spark, "cache")
    tables.refresh_embedding_cache(spark, path, docs.where("lang = 'fr'").select("text"), ENCODER)
    cache = tables.refresh_embedding_cache(spark, path, docs.select("text"), ENCODER)
    return cache.select("content_hash", F.posexplode("embedding").alias("bucket", "x")).where("x <> 0").select(
        "content_hash", "bucket", F.round("x", 6).alias("weight")
    )


def quiz(spark, sf):
    """Sources titled after their pair, and answers of three kinds: right, padded, wrong."""
    pairs = qa_pairs(spark, sf).withColumn("id", F.concat(F.lit("conv "), "pair_id"))
    kind = F.col("conv_id") % 3
    answer = F.when(kind == 0, F.col("answer")).when(
        kind == 1, F.concat_ws(" ", "answer", "question")).otherwise(F.col("question"))
    mandatory = F.slice(F.split(F.col("answer"), " "), 1, 2)
    sources = pairs.select("id", F.col("answer").alias("content"))
    answers = pairs.select("id", answer.alias("answer"), mandatory.alias("mandatory"))
    titles = pairs.select("id", F.when(kind == 0, F.col("id")).when(kind == 1, F.concat_ws(" ", F.lit("le"), "id"))
                          .otherwise(F.lit("conversation")).alias("answer"))
    return sources, answers, titles


_QUIZ_SQL = QA_SQL + """,
quiz AS (
  SELECT 'conv ' || pair_id AS id, answer AS content,
    CASE conv_id % 3 WHEN 0 THEN answer WHEN 1 THEN answer || ' ' || question ELSE question END AS answer,
    CASE conv_id % 3 WHEN 0 THEN 'conv ' || pair_id WHEN 1 THEN 'le conv ' || pair_id ELSE 'conversation' END AS title_answer,
    string_split(answer, ' ')[1:2] AS mandatory
  FROM qa)"""


def _grade_sql(reference: str, answer: str, mandatory: str = "") -> str:
    check = f"AND len(list_filter(mandatory, lambda m: NOT list_contains(regexp_split_to_array(trim({answer}, ' ' || chr(10)), '\\s+'), m))) = 0" if mandatory else ""
    return f"""WITH {_QUIZ_SQL}, {encode_sql('r', 'quiz', 'id', reference)}, {encode_sql('a', 'quiz', 'id', answer)},
sims AS (SELECT id, sum(r.w * a.w) AS s FROM r JOIN a USING (id, bucket) GROUP BY 1),
graded AS (
  SELECT quiz.id, {answer} AS answer, round(coalesce(s, 0), 6) AS cosine, round(coalesce(s, 0), 6) AS dot,
         round(coalesce(s, 0), 6) >= 0.8 {check} AS is_correct
  FROM quiz LEFT JOIN sims USING (id))"""


def grade_by_content(spark, sf):
    sources, answers, _ = quiz(spark, sf)
    return grading.quiz_round(sources, answers, ENCODER, "content").select("id", "is_correct", "cosine", "dot")


def grade_by_title(spark, sf):
    sources, _, titles = quiz(spark, sf)
    return grading.quiz_round(sources, titles, ENCODER, "id").select("id", "is_correct", "cosine", "dot")


def grade_answers(spark, sf):
    """One text against another, without mandatory tokens."""
    sources, answers, _ = quiz(spark, sf)
    pairs = sources.join(answers.drop("mandatory"), "id").withColumnRenamed("content", "reference")
    return grading.grade(pairs, ENCODER, 0.8).select("id", "is_correct", "cosine", "dot")


def answers_to_review(spark, sf):
    sources, answers, _ = quiz(spark, sf)
    return grading.answers_to_review(grading.quiz_round(sources, answers, ENCODER, "content"))


def _sample(spark, sf):
    return records.sample_records(tables.scan_records(source_records(spark, sf)), 20, seed=7).select("id", "content")


QUERIES = {
    "md_segments": lambda spark, sf: markdown.split_segments(documents(spark, sf)),
    "md_parse": lambda spark, sf: markdown.parse_segments(markdown_segments(spark, sf)),
    "md_rejects": lambda spark, sf: markdown.rejected_segments(markdown_segments(spark, sf)),
    "md_clean": lambda spark, sf: markdown.clean_records(markdown.parse_segments(markdown_segments(spark, sf))),
    "md_cases": md_cases,
    "md_cases_lenient": md_cases_lenient,
    "roundtrip_sources": roundtrip_sources,
    "records_scan": lambda spark, sf: tables.scan_records(source_records(spark, sf)),
    "append_alt_answers": append_alt_answers,
    "embedding_cache_delta": embedding_cache_delta,
    "embedding_cache": embedding_cache,
    "keyword_prefilter": lambda spark, sf: records.keyword_prefilter(documents(spark, sf), "tion"),
    "sample_questions": _sample,
    "dedup_corpus": lambda spark, sf: records.dedup_content(documents(spark, sf)),
    "grade_answers": grade_answers,
    "grade_by_content": grade_by_content,
    "grade_by_title": grade_by_title,
    "answers_to_review": answers_to_review,
}

_CLEAN = "translate({}, '*>' || chr(10) || '\\', '')"

ORACLES = {
    "md_segments": "SELECT doc_id, generate_subscripts(s, 1) - 1 AS seg_no, unnest(s) AS segment FROM (SELECT doc_id, string_split(text, '###') AS s FROM documents)",
    "md_parse": f"WITH {MARKDOWN_SQL} SELECT * FROM parsed",
    "md_rejects": f"WITH {MARKDOWN_SQL} SELECT pair_id, seg_no, segment FROM m WHERE parse_pass IS NULL",
    "md_clean": f"WITH {MARKDOWN_SQL} SELECT pair_id, seg_no, translate(title, '*', '') AS id, {_CLEAN.format('content')} AS content, {_CLEAN.format('raw_text')} AS raw_text, 0 AS level FROM parsed",
    "md_cases": f"""WITH {BOOKS_SQL}
SELECT pair_id, case_no, split_part(body, chr(10), 1) AS title,
  CASE WHEN regexp_matches(body, '(?s)`{{3}}(.*?)`{{3}}') THEN replace(regexp_extract(body, '(?s)`{{3}}(.*?)`{{3}}', 1), ',', '|') END AS keywords,
  split_part(CASE WHEN contains(body, chr(10)) THEN substr(body, strpos(body, chr(10)) + 1) ELSE '' END, '>', 1) AS content,
  coalesce(array_to_string(regexp_extract_all(body, '(?s)>.*?' || chr(10)), chr(10)), '') AS quotes
FROM found""",
    # Every heading counts, so splitting at the heading marker finds the same cases.
    "md_cases_lenient": f"""WITH {BOOKS_SQL}
SELECT pair_id, generate_subscripts(b, 1) - 1 AS case_no, unnest(list_transform(b, lambda x: split_part(x, chr(10), 1))) AS title
FROM (SELECT pair_id, string_split(text, '#####')[2:] AS b FROM books)""",
    "roundtrip_sources": _RECORDS_SQL,
    "records_scan": _RECORDS_SQL,
    "append_alt_answers": """
WITH g AS (SELECT text, conv_id::VARCHAR AS foreign_id, count(*) AS copies FROM conversations GROUP BY 1, 2),
acc AS (SELECT text, min(foreign_id) AS foreign_id FROM g
        WHERE text NOT IN (SELECT text FROM conversations WHERE role = 'assistant' AND turn = 1) GROUP BY 1)
SELECT text, foreign_id, 0 AS rejected FROM acc
UNION ALL
SELECT * FROM (SELECT g.text, g.foreign_id, copies - CASE WHEN acc.text IS NULL THEN 0 ELSE 1 END AS rejected
  FROM g LEFT JOIN acc ON acc.text = g.text AND acc.foreign_id = g.foreign_id) WHERE rejected > 0""",
    "embedding_cache_delta": "SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'fr')",
    "embedding_cache": f"WITH {encode_sql('v', '(SELECT DISTINCT text FROM documents)', 'sha256(text)', 'text')} SELECT id AS content_hash, bucket, round(w, 6) AS weight FROM v",
    "keyword_prefilter": "SELECT doc_id, text FROM documents WHERE contains(text, 'tion')",
    "sample_questions": "SELECT doc_id::VARCHAR AS id, text AS content FROM documents WHERE text IS NOT NULL ORDER BY md5('7|' || doc_id), doc_id::VARCHAR LIMIT 20",
    "dedup_corpus": "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text",
    "grade_answers": f"{_grade_sql('content', 'answer')} SELECT id, is_correct, cosine, dot FROM graded",
    "grade_by_content": f"{_grade_sql('content', 'answer', 'mandatory')} SELECT id, is_correct, cosine, dot FROM graded",
    "grade_by_title": f"{_grade_sql('id', 'title_answer')} SELECT id, is_correct, cosine, dot FROM graded",
    "answers_to_review": f"{_grade_sql('content', 'answer', 'mandatory')} SELECT answer AS text, id AS foreign_id FROM graded WHERE NOT is_correct",
}
