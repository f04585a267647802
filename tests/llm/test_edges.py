"""Odd and empty tables: queries with oracle SQL against it, the others against plain counts."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle_check import compare, connect

from lexspark.llm import registry, sharding, transducer

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("shard", pa.string())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("payload_digest", pa.string())])
TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("rng", pa.int64())])
LONG = "so they say that it is good to go home, and we go. " * 400
DOC_ROWS = [
    (1, "tie", "en", "a", 3, "x"), (1, "tie", "en", "a", 3, "x"), (2, None, None, None, None, None), (3, "", "en", "b", 0, "x"), (4, " \t\n\x0b\r ", "en", "b", 1, None),
    (5, LONG, "en", "a", 1, "x"), (6, LONG * 20, "en", "c", 1, "x"), (7, "é # * ß\n\né # * ß\n", "fr", None, 2, "x"), (8, "one two three " * 30, "en", "b", 1, "x"),
]
PAGE_ROWS = [(1, "u", "p" * 1500, "x"), (2, None, "p" * 1500, None), (3, "u", "p" * 999, "x"), (4, "u", "p" * 999, "x"), (5, "u", None, "x"), (6, "u", "é" * 500, "x"), (7, "u", "é" * 500, "x")]
TURN_ROWS = [(1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (1, None, None, None, 2), (2, 0, "user", "a", 1), (2, 1, "x", "", None), (3, 0, "user", "a", 1)]


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(request, tmp_path_factory):
    path = tmp_path_factory.mktemp(request.param)
    for name, schema, rows in (("documents", DOCS, DOC_ROWS), ("pages", PAGES, PAGE_ROWS), ("conversations", TURNS, TURN_ROWS)):
        columns = list(zip(*rows)) if request.param == "odd" else [()] * len(schema)
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema), path / f"{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["op1_chat", "op4_mixing", "op9_warc", "op10_quality", "op13_prefix_trie"])
def test_queries_equal_their_oracles(spark, folder, name):
    ok, message = compare(spark, connect(folder), registry.QUERIES[name], registry.ORACLES[name], folder)
    assert ok, message


def test_counts_and_shards(spark, folder):
    rows = DOC_ROWS if "odd" in folder else []
    sizes = sorted((r[0], len((r[1] or "").encode())) for r in rows)
    counted = transducer.op5_token_counts(spark, folder).collect()
    assert sorted((r["doc_id"], r["n_bytes"]) for r in counted) == sizes
    assert all((r["n_tokens"] == 0) == (r["n_bytes"] == 0) for r in counted)
    placed = sharding.op6_sharding(spark, folder).collect()
    assert sorted((r["doc_id"], r["size"] - 1) for r in placed) == sizes
    for shard in {r["shard"] for r in placed}:
        slots = sorted(r["slot"] for r in placed if r["shard"] == shard)
        assert slots == list(range(len(slots)))
