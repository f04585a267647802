"""Markdown casebook sources: segments cut at ``###``, and cases under level-5 headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.materialize import cut_lineage
from lexspark.functions.rows import unnest_with_position

# The two accepted segment shapes and the level-5 case shape.
SEGMENT_WITH_QUOTE = r"(?s)(\*{2}[^*]+\*{2})([^>]+?)(>.*)"
SEGMENT_NO_QUOTE = r"(?s)(\*{2}[^*]+\*{2})([^>]+?)"
SEGMENT_NO_QUOTE_FULL = r"(?s)(\*{2}[^*]+\*{2})([^>]+)"
CASE = r"(?s)(#{5})([^#]+)(#)"
CASE_LENIENT = r"(?s)(#{5})([^#]+)(?=#|\z)"
KEYWORD_BLOCK = r"(?s)`{3}(.*?)`{3}"
QUOTE = r"(?s)>.*?\n"
SEPARATOR = "###"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of Markdown files. The reader itself splits on the separator, so a large file is
    read by many tasks."""
    return spark.read.option("lineSep", SEPARATOR).text(path).withColumnRenamed("value", "segment")


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``(path, block, row, value, size)``: what lies between separators, with a sortable place in its file.

    A large file is read in blocks by many tasks; ``row`` rises inside a block. ``size`` is the file's, in bytes.
    """
    rows = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value", F.col("_metadata.file_size").alias("size"),
    )
    return cut_lineage(rows, "records")


def _block_windows() -> tuple:
    """Inside a block in order, and over the blocks before; no window holds more rows than a block has."""
    return Window.partitionBy("path", "block").orderBy("row"), Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _numbered(records: DataFrame, name: str) -> DataFrame:
    """Add ``name``: the number of each record in its file, from 0."""
    inside, before = _block_windows()
    counts = records.groupBy("path", "block").agg(F.count("*").alias("n"))
    first = counts.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return records.join(first, ["path", "block"]).withColumn(name, F.col("first") + F.row_number().over(inside) - 1).drop("first")


def read_numbered_segments(spark: SparkSession, path: str) -> DataFrame:
    """``(path, seg_no, segment)`` of Markdown files, numbered in file order from 0 without reading a file as a whole."""
    return _numbered(_records(spark, path, SEPARATOR), "seg_no").select("path", "seg_no", F.col("value").alias("segment"))


def split_segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, seg_no, segment)`` of a text column."""
    return unnest_with_position(docs, [key], F.split(text, SEPARATOR), "seg_no", "segment")


def _parse_columns(full_content: bool) -> dict[str, Column]:
    segment = F.col("segment")
    # regexp_extract gives '' on no match, so each pass is guarded by rlike.
    parse_pass = F.when(segment.rlike(SEGMENT_WITH_QUOTE), 1).when(segment.rlike(SEGMENT_NO_QUOTE), 2)
    second = SEGMENT_NO_QUOTE_FULL if full_content else SEGMENT_NO_QUOTE

    def group(n: int) -> Column:
        return F.when(F.col("parse_pass") == 1, F.regexp_extract(segment, SEGMENT_WITH_QUOTE, n)).when(
            F.col("parse_pass") == 2, F.regexp_extract(segment, second, n)
        )

    raw_text = F.when(F.col("parse_pass") == 1, F.regexp_extract(segment, SEGMENT_WITH_QUOTE, 3))
    return {"parse_pass": parse_pass, "title": group(1), "content": group(2), "raw_text": raw_text}


def parse_segments(segments: DataFrame, full_content: bool = False) -> DataFrame:
    """Title, content and quoted text of well-formed segments.

    ``parse_pass`` is 1 with a quote, 2 without; the reference lists all pass-1 rows first. Without
    a quote the content is one character, as in the reference; ``full_content`` takes all of it.
    """
    columns = _parse_columns(full_content)
    tried = segments.withColumn("parse_pass", columns.pop("parse_pass"))
    return tried.where("parse_pass IS NOT NULL").withColumns(columns).drop("segment")


def rejected_segments(segments: DataFrame) -> DataFrame:
    """Segments that neither shape matches."""
    return segments.where(~F.col("segment").rlike(SEGMENT_NO_QUOTE))


def clean_records(parsed: DataFrame, newline: str = "") -> DataFrame:
    """Record table ``(id, content, raw_text, level)`` with Markdown markers removed.

    Newlines are deleted by default, which glues the words around them, as in the reference;
    ``newline=" "`` keeps them apart.
    """

    def clean(column: str) -> Column:
        if newline:
            return F.translate(column, "\n*>\\", newline)
        return F.translate(column, "*>\n\\", "")

    keep = [c for c in parsed.columns if c not in ("title", "content", "raw_text", "parse_pass")]
    return parsed.select(
        *keep,
        F.translate("title", "*", "").alias("id"),
        clean("content").alias("content"),
        clean("raw_text").alias("raw_text"),
        F.lit(0).alias("level"),
    )


def read_casebooks(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(path, text)`` per Markdown file, for :func:`parse_cases`."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text")
    )


def read_cases(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """The cases of Markdown files of any size: as :func:`parse_cases`, from pieces between ``#`` read in blocks.

    A piece is a case if at least five marks that no case has taken stand right before it, and one after it, which the case
    takes. So with more than five marks before it nothing else matters; with five, the piece before must be no case: of a
    row of such pieces every second one is a case, counted from the last piece with another number of marks.
    """
    inside, before = _block_windows()
    records = _numbered(_records(spark, path, "#"), "k")
    ends = records.groupBy("path").agg(
        F.count("*").alias("n"), (F.max("size") == F.sum(F.octet_length("value")) + F.count("*")).alias("closed")
    )
    pieces = cut_lineage(records.where("value != ''").drop("size"), "pieces")
    held = pieces.groupBy("path", "block").agg(F.max("k").alias("last"))
    earlier = held.select("path", "block", F.max("last").over(before).alias("earlier"))
    marked = pieces.join(earlier, ["path", "block"]).join(ends, "path")
    previous = F.coalesce(F.lag("k").over(inside), F.col("earlier"), F.lit(0))
    marked = marked.withColumn("marks", F.col("k") - previous)
    followed = (F.col("k") < F.col("n") - 1) | F.col("closed")
    marked = marked.select("path", "block", "row", F.col("value").alias("body"), "marks", (followed | F.lit(lenient)).alias("followed"))
    if lenient:
        cases = marked.where("marks >= 5")
    else:
        placed = cut_lineage(_numbered(marked, "i"), "pieces")
        # The last piece that is decided by its own marks, as (its number, whether it is a case).
        own = F.when(F.col("marks") != 5, F.struct("i", (F.col("marks") > 5).alias("case")))
        reset = placed.groupBy("path", "block").agg(F.max(own).alias("reset"))
        carried = reset.select("path", "block", F.max("reset").over(before).alias("carried"))
        start = F.struct(F.lit(-1).cast("long").alias("i"), F.lit(False).alias("case"))
        base = F.coalesce(F.max(own).over(inside), F.col("carried"), start)
        judged = placed.join(carried, ["path", "block"]).withColumn("base", base)
        case = F.col("base.case") != ((F.col("i") - F.col("base.i")) % 2 == 1)
        cases = judged.where(case & F.col("followed"))
    return _described(_numbered(cases, "case_no"), "path")


def parse_cases(books: DataFrame, key: str = "path", lenient: bool = False) -> DataFrame:
    """``(key, case_no, title, keywords, content, quotes)`` of level-5 headings.

    The case pattern consumes the next ``#``, so of two adjacent headings the second is lost, as in
    the reference; ``lenient`` finds every heading and a last case without a following ``#``.
    """
    pattern = CASE_LENIENT if lenient else CASE
    found = unnest_with_position(
        books, [key], F.regexp_extract_all("text", F.lit(pattern), F.lit(2)), "case_no", "body"
    )
    return _described(found, key)


def _described(cases: DataFrame, key: str) -> DataFrame:
    """Title, keywords, content and quotes of ``(key, case_no, body)``."""
    body = F.col("body")
    after_title = F.when(
        F.instr(body, "\n") > 0, F.substring(body, F.instr(body, "\n") + 1, F.length(body))
    ).otherwise("")
    keywords = F.when(
        body.rlike(KEYWORD_BLOCK), F.split(F.regexp_extract(body, KEYWORD_BLOCK, 1), ",")
    )
    return cases.select(
        key,
        "case_no",
        F.substring_index(body, "\n", 1).alias("title"),
        keywords.alias("keywords"),
        F.substring_index(after_title, ">", 1).alias("content"),
        F.array_join(F.regexp_extract_all(body, F.lit(QUOTE), F.lit(0)), "\n").alias("quotes"),
    )
