"""WARC archives with revisit records.

Headers meet by payload digest: of records with equal payloads of at least ``MIN_PAYLOAD`` bytes the one with the
largest page id keeps its payload and the others become revisit records that refer to it. Records get fresh headers and
are written by Spark's text writer, one record per row, so the archives are gzip files that Spark commits and that any
store of Spark's can hold. Reading takes whole files of at most ``RECORDS_PER_FILE`` records, follows Content-Length,
and joins revisits to their responses by digest again.

Defined cases: a null html is an empty payload; a null url an empty target; a null page id is the smallest one; rows
with the same largest page id and the same payload are all responses; if no id is known all are responses; an empty
table gives empty archives; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.materialize import new_table_path
from lexspark.llm.common import table

MIN_PAYLOAD = 1000
RECORDS_PER_FILE = 4096
# A payload shared by a third of all pages is one key; its rows meet copies of the one header row under many keys.
SALTS = 16
# Names of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
RECORD_SCHEMA = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to_id string, url string"


def resolve_by_digest(rows: DataFrame, originals: DataFrame, salt: Column) -> DataFrame:
    """Left join of ``rows`` to one original per (digest, length), spread over ``SALTS`` keys per digest."""
    spread = originals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(salt, F.lit(SALTS))).join(spread, ["payload_digest", "payload_bytes", "salt"], "left").drop("salt")


def with_revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``(page_id, url, payload, payload_digest, payload_bytes, refers_to)``; ``refers_to`` is null for responses."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes")
    )
    originals = (
        rows.where(F.col("payload_bytes") >= min_payload).groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    )
    joined = resolve_by_digest(rows, originals, F.xxhash64("page_id", "url"))
    return joined.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("original")), F.col("original"))).drop("original")


def _uuid(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write one record per page under ``path``."""
    rows = with_revisits(pages, min_payload)
    target = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7f]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    head = F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", _uuid(F.col("page_id"), F.col("payload_digest"))), header("WARC-Date", F.lit(DATE)), header("WARC-Target-URI", target),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")), header("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(revisit, F.concat(header("WARC-Profile", F.lit(REVISIT_PROFILE)), header("WARC-Refers-To", _uuid(F.col("refers_to"), F.col("payload_digest"))))).otherwise(""),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.when(revisit, "0").otherwise((F.octet_length(http) + F.col("payload_bytes")).cast("string"))), F.lit("\r\n"),
    )
    block = F.when(revisit, "").otherwise(F.concat(http, F.col("payload")))
    # The writer ends every row with the line feed that also ends a record.
    rows.select(F.concat(head, block, F.lit("\r\n\r")).alias("value")).write.option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file
    ).mode("overwrite").text(path)


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of one gzip file, which may have one or many members."""
    data = bytearray()
    while content:
        member = zlib.decompressobj(31)
        data += member.decompress(content)
        content = member.unused_data
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = bytes(view[at:end]).decode("utf-8", "replace").split("\r\n")
        fields = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
        start, length = end + 4, int(fields["content-length"])
        yield fields, bytes(view[start:start + length])
        at = start + length + 4


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64() if f.endswith("long") else pa.string() for f in RECORD_SCHEMA.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in _records(content.as_py()):
                page_id = int(fields["x-page-id"]) if fields.get("x-page-id", "") != "" else None
                if fields["warc-type"] == "revisit":
                    size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                else:
                    payload = block[block.index(b"\r\n\r\n") + 4:]
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                rows.append((page_id, fields["warc-type"], size, digest, fields.get("warc-refers-to"), fields.get("warc-target-uri")))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``; revisits are resolved to the response with their digest."""
    files = spark.read.format("binaryFile").load(path).select("content")
    records = files.mapInArrow(_parse, RECORD_SCHEMA)
    originals = records.where("record_type = 'response'").groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"))
    found = resolve_by_digest(records.where("record_type = 'revisit'"), originals, F.xxhash64("page_id", "url"))
    return records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM p),
r AS (SELECT *, payload_bytes >= {MIN_PAYLOAD} AND original IS NOT NULL AND (page_id IS NULL OR page_id < original) AS revisit FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN original END AS refers_to, regexp_replace(coalesce(url, ''), '[\\x00-\\x20\\x7f]', '%20', 'g') AS url
FROM r
"""
