"""Quality rules: base counts of a document, and the divergence of its histograms from language references.

A document's characters are counted in six classes and its words on a list of common words (all others together). Both
histograms are compared with the references of each language by the Jensen-Shannon distance (square root of the
divergence in bits); the nearest language counts, so a wrong language label rejects nothing. References are the summed
histograms of all documents of a language with at least ``MIN_WORDS`` words. Guards: the character distance speaks from
``MIN_CHARS`` characters on, and the limit of the word distance falls with the number of words, as sampling noise does.

Everything is a row expression over built-in functions, so the text is neither shuffled nor sent to Python; only the
references, five rows at most, come to the driver.

Defined cases: a null or empty text has no words and fails the base rules; a null or unknown ``lang`` belongs to the
reference ``other``; without any reference (an empty table, or only short documents) no distance speaks; equal rows get
equal verdicts; further columns are carried along, whatever their names (internal ones start with ``__q_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.materialize import cut_lineage
from lexspark.llm.common import table, words

MIN_WORDS = 50
MIN_CHARS = 200
MAX_REPEAT_PERCENT = 50
CHAR_LIMIT = 0.25
WORD_LIMIT, WORD_NOISE = 0.17, 1.0

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with be as by",
    "fr": "de la le et les des en un une du est que dans qui pour au",
    "de": "der die und in den von zu das mit sich des auf für ist im dem",
    "es": "de la que el en y a los del se las por un para con no",
}
LANGUAGES = tuple(COMMON_WORDS)
VOCABULARY = tuple(dict.fromkeys(w for text in COMMON_WORDS.values() for w in text.split()))
# Character classes counted by removal; white space follows from the words, the rest is one more class.
CHAR_CLASSES = (r"[^\p{Lu}]+", r"[^\p{Ll}]+", r"[^\p{Nd}]+", r"[^.,;:!?'\"()-]+")
SYMBOLS = r"[^#*$%&|<>]+"


def _size_where(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, F.lit(others), F.lit(""))).cast("long")


def _histograms(docs: DataFrame) -> DataFrame:
    """``docs`` with words, counts of character classes and counts of common words."""
    text = F.coalesce("text", F.lit(""))
    counted = docs.withColumn("__q_words", words(F.col("text"))).withColumns({
        "__q_n": F.size("__q_words").cast("long"),
        "__q_chars": F.length(F.concat_ws("", "__q_words")).cast("long"),
        "__q_common": F.filter(F.transform("__q_words", F.lower), lambda w: w.isin(*VOCABULARY)),
    })
    classes = [_size_where(text, others) for others in CHAR_CLASSES]
    known = [F.size("__q_common") - F.size(F.array_remove("__q_common", w)) for w in VOCABULARY]
    return counted.withColumn(
        "__q_class", F.array(*classes, F.length(text).cast("long") - F.col("__q_chars"))
    ).withColumns({
        "__q_class": F.concat("__q_class", F.array(F.length(text) - F.aggregate("__q_class", F.lit(0).cast("long"), lambda a, x: a + x))),
        "__q_word": F.array(*[k.cast("long") for k in known], F.col("__q_n") - F.size("__q_common")),
    }).drop("__q_common")


def _with_base(docs: DataFrame) -> DataFrame:
    """Base counts. Repeated windows are found by sorting one long per window: hash above, position below."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " \t\u000b\u000c\r", "")) > 0)

    def window(i: Column) -> Column:
        hashed = F.xxhash64(*[F.get(F.col("__q_words"), i + k) for k in range(3)])
        return hashed.bitwiseAND(F.col("__q_high")).bitwiseOR(i.cast("long"))

    def equal_windows(x: Column, y: Column) -> Column:
        position = [F.bitwise_not(F.col("__q_high")).bitwiseAND(v).cast("int") for v in (x, y)]
        same = [F.get(F.col("__q_words"), position[0] + k) == F.get(F.col("__q_words"), position[1] + k) for k in range(3)]
        return (x.bitwiseAND(F.col("__q_high")) == y.bitwiseAND(F.col("__q_high"))) & same[0] & same[1] & same[2]

    def repeated(x: Column, i: Column) -> Column:
        after = F.get(F.col("__q_sorted"), i + 1)
        before = F.get(F.col("__q_sorted"), i - 1)
        return F.coalesce(equal_windows(x, after), F.lit(False)) | F.coalesce(equal_windows(x, before), F.lit(False))

    # The position takes as many low bits as the number of words needs; the hash keeps the others.
    bits = F.length(F.bin(F.col("__q_n")))
    gaps = F.transform(
        "__q_at", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(F.col("__q_at"), i + 1) - p, F.lit(3).cast("long")))
    )
    return (
        docs.withColumns({
            "__q_symbols": _size_where(text, SYMBOLS),
            "__q_lines": lines,
            "__q_high": F.expr("shiftleft(-1L, length(bin(__q_n)))"),
        })
        .withColumn("__q_lines", (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"))
        .withColumn("__q_sorted", F.when(F.col("__q_n") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.col("__q_n") - 3, F.lit(0)).cast("int")), window))).otherwise(F.array().cast("array<bigint>")))
        .withColumn("__q_at", F.filter("__q_sorted", repeated))
        .withColumn("__q_at", F.sort_array(F.transform("__q_at", lambda x: x.bitwiseAND(F.bitwise_not(F.col("__q_high"))))))
        .withColumn("__q_repeat", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x))
        .drop("__q_sorted", "__q_at", "__q_high", "__q_words")
    )


def fit_references(histograms: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """Summed histograms by language of all documents with enough words; at most one row per listed language and one more."""
    lang = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise("other")
    n_class, n_word = len(CHAR_CLASSES) + 2, len(VOCABULARY) + 1
    sums = [F.sum(F.get("__q_class", F.lit(i))) for i in range(n_class)] + [F.sum(F.get("__q_word", F.lit(i))) for i in range(n_word)]
    rows = histograms.where(F.col("__q_n") >= MIN_WORDS).groupBy(lang.alias("lang")).agg(F.array(*sums).alias("sums")).collect()
    return {r["lang"]: (r["sums"][:n_class], r["sums"][n_class:]) for r in sorted(rows, key=lambda r: r["lang"])}


def _plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def js_distance(counts: Column, references: list[list[int]]) -> Column:
    """Distance of a histogram to the nearest of ``references``; null without any or for an empty histogram."""
    if not references:
        return F.lit(None).cast("double")
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    # Bound as lambda variables, so the total and the shares are computed once.
    bound = F.transform(F.array(F.struct(counts.alias("c"), total.alias("t"))), lambda s: F.transform(s["c"], lambda c: c / s["t"]))

    def nearest(p: Column) -> Column:
        own = F.aggregate(p, F.lit(0.0), lambda a, x: a + _plogp(x))
        found = []
        for reference in references:
            weight = [c / sum(reference) for c in reference]
            q = F.array(*map(F.lit, weight))
            both = F.aggregate(F.zip_with(p, q, lambda x, y: _plogp(x + y)), F.lit(0.0), lambda a, x: a + x)
            alone = F.aggregate(q, F.lit(0.0), lambda a, x: a + _plogp(x))
            found.append(1.0 - both / 2 + (own + alone) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), F.least(*found) if len(found) > 1 else found[0]))

    return F.when(total > 0, F.element_at(F.transform(bound, nearest), 1))


def score(docs: DataFrame, references: dict[str, tuple[list[int], list[int]]]) -> DataFrame:
    """Add distances and verdict to rows that have histograms and base counts."""
    scored = docs.withColumns({
        "__q_class_js": js_distance(F.col("__q_class"), [c for c, _ in references.values()]),
        "__q_word_js": js_distance(F.col("__q_word"), [w for _, w in references.values()]),
    })
    n, repeat = F.col("__q_n"), F.col("__q_repeat")
    size = F.aggregate("__q_class", F.lit(0).cast("long"), lambda a, x: a + x)
    odd = ((size >= MIN_CHARS) & (F.col("__q_class_js") > CHAR_LIMIT)) | (
        (n >= MIN_WORDS) & (F.col("__q_word_js") > WORD_LIMIT + WORD_NOISE / F.sqrt(n.cast("double")))
    )
    return scored.withColumn("__q_failed", (n < MIN_WORDS) | (repeat * 100 > n * MAX_REPEAT_PERCENT)).withColumn(
        "__q_kept", ~F.col("__q_failed") & ~F.coalesce(odd, F.lit(False))
    )


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``: one pass for the references, one for the verdicts."""
    references = fit_references(_histograms(docs.select("text", "lang")))
    # A filter over plain columns would be pushed down with every count written out in it; it stops at a row number.
    counted = _with_base(_histograms(docs)).withColumn("__q_row", F.monotonically_increasing_id())
    return score(counted, references).where(F.col("__q_kept") & (F.col("__q_row") >= 0)).select(*docs.columns)


def measure_quality(docs: DataFrame) -> DataFrame:
    """One row per document of its counts, distances and verdict; the counts are stored once, without the text."""
    counted = _with_base(_histograms(docs.select("doc_id", "text", "lang"))).drop("text")
    counted = cut_lineage(counted, "quality")
    scored = score(counted, fit_references(counted))
    return scored.select(
        "doc_id", F.col("__q_n").alias("n_words"), F.col("__q_chars").alias("word_chars"), F.col("__q_symbols").alias("n_symbols"),
        F.col("__q_lines").alias("n_dup_lines"), F.col("__q_repeat").alias("n_repeat_words"), F.col("__q_failed").alias("base_failed"),
        F.col("__q_kept").alias("kept"), F.round("__q_class_js", 6).alias("class_distance"), F.round("__q_word_js", 6).alias("word_distance"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_quality(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    word_list = "[" + ", ".join(f"'{w}'" for w in VOCABULARY) + "]"
    classes = ", ".join("len(regexp_replace(t, '{}', '', 'g'))".format(c.replace("'", "''")) for c in CHAR_CLASSES)

    def distance(own: str, ref: str) -> str:
        plogp = "CASE WHEN {0} > 0 THEN ({0}) * log2({0}) ELSE 0 END"
        share = f"{own}[i] / list_sum({own})::DOUBLE"
        other = f"{ref}[i] / list_sum({ref})::DOUBLE"
        part = "list_sum([" + plogp + " FOR i IN range(1, len({own}) + 1)])"
        both, p, q = (part.format(x, own=own) for x in (f"{share} + {other}", share, other))
        return f"CASE WHEN list_sum({own}) > 0 THEN sqrt(greatest(0, 1 - {both} / 2 + ({p} + {q}) / 2)) END"

    n_class, n_word = len(CHAR_CLASSES) + 2, len(VOCABULARY) + 1
    sums = "[" + ", ".join(f"sum(cls[{i + 1}])" for i in range(n_class)) + "] AS rc, [" + ", ".join(f"sum(wrd[{i + 1}])" for i in range(n_word)) + "] AS rw"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lang FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tok AS (SELECT rid, unnest(ws) AS a, unnest(range(len(ws))) AS p FROM w),
tri AS (SELECT *, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY rid ORDER BY p)),
dup AS (SELECT *, c IS NOT NULL AND count(*) OVER (PARTITION BY rid, a, b, c) > 1 AS twice FROM tri),
cov AS (SELECT rid, max(twice::INT) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM dup),
rep AS (SELECT rid, sum(hit)::BIGINT AS n_repeat_words FROM cov GROUP BY rid),
base AS (
  SELECT w.rid, doc_id, lang, t, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         list_filter(list_transform(ws, lambda x: lower(x)), lambda x: list_contains({word_list}, x)) AS common,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.rid = rep.rid),
hist AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, [{classes}, len(t) - word_chars] AS c5,
         list_append(list_transform({word_list}, lambda v: len(list_filter(common, lambda x: x = v))), n_words - len(common)) AS wrd
  FROM base),
full_hist AS (SELECT *, list_append(c5, len(t) - list_sum(c5)) AS cls FROM hist),
refs AS (
  SELECT CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE 'other' END AS l, {sums}
  FROM full_hist WHERE n_words >= {MIN_WORDS} GROUP BY 1),
scored AS (
  SELECT h.rid, min({distance("cls", "rc")}) AS cd, min({distance("wrd", "rw")}) AS wd
  FROM full_hist h LEFT JOIN refs ON true GROUP BY h.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND NOT coalesce((len(t) >= {MIN_CHARS} AND cd > {CHAR_LIMIT})
                          OR (n_words >= {MIN_WORDS} AND wd > {WORD_LIMIT} + {WORD_NOISE} / sqrt(n_words)), false) AS kept,
       round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
FROM full_hist JOIN scored USING (rid)
"""


ORACLE = _oracle()
