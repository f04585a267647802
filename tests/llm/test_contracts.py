"""Token counts, token files and shards against the library and a plain count, on whole tables."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexspark.llm import sharding, token_files, transducer

SF = "/root/testdata/sf0.001"


def texts():
    return duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet' order by doc_id").fetchall()


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    library.no_truncation()
    library.no_padding()
    want = {d: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for d, t in texts()}
    got = transducer.op5_token_counts(spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)


def test_token_files_round_trip(spark):
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation()
    library.no_padding()
    want, start = {}, 0
    for d, t in texts():
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = token_files.op3_token_files(spark, SF).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want


def test_shards_are_near_equal_and_gapless(spark):
    rows = sharding.op6_sharding(spark, SF).collect()
    sizes = {d: len(t.encode()) + 1 for d, t in texts()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    assert {r["law"] for r in rows} == {"bytes"} and {r["shard"] for r in rows} == set(range(8))
    held = Counter()
    for r in rows:
        held[r["shard"]] += r["size"]
    assert max(held.values()) - min(held.values()) <= max(sizes.values())
    for shard in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
