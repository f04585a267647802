"""Removal of long repeats against a brute-force version."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from lexspark.llm import suffixes

SF = "/root/testdata/sf0.001"


def brute(texts, length=suffixes.LENGTH):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def digest(row):
    return row["n_bytes"], row["n_bytes"] - len(row["kept"]), len(row["spans"]), hashlib.sha256(bytes(row["kept"])).hexdigest()


def test_cover_has_every_difference():
    cover = suffixes.COVER
    assert {(a - b) % suffixes.PERIOD for a in cover for b in cover} == set(range(suffixes.PERIOD))


@pytest.mark.parametrize("parts", [1, 5])
def test_shared_passages(spark, parts):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh \né€") for _ in range(n))
    long, edge = noise(900), "".join(rng.choice("abcd") for _ in range(400))
    texts = [
        noise(50) + long + noise(70), noise(333) + long, long[100:700], noise(10) + edge + noise(9), "x" + edge + "y",
        edge[:399] + "!", None, "", "z" * 2000, "q" * 400, noise(400), noise(20_000) + edge, long + noise(5) + long,
    ]
    texts += [texts[4], texts[10]]
    rows = [(None if i == 3 else i % 12, t, "other") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(parts)
    found = Counter((r["doc_id"], *digest(r)) for r in suffixes.remove_repeats(docs).collect())
    assert found == Counter((r[0], *b) for r, b in zip(rows, brute([(t or "").encode() for t in texts])))
    for row in suffixes.remove_repeats(docs).where("n_bytes = 2000").collect():
        assert [tuple(s) for s in row["spans"]] == [(0, 2000)]


def test_copied_stretches_are_folded(spark, monkeypatch):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh \né€") for _ in range(n))
    base = [noise(3000) for _ in range(6)]
    texts = [t for b in base for t in (b, b, noise(30) + b[:2500], b[200:], b[:1400] + "!" + b[1401:], noise(700))] + ["ab" * 900, "z" * 1500]
    blocks, active, keys = [], 0, 0
    for part in (texts[:20], texts[20:]):
        encoded = [t.encode() for t in part]
        blocks.append((np.frombuffer(b"".join(encoded), np.uint8), np.array([len(t) for t in encoded])))
    sent = [suffixes._stretch_keys(d, *suffixes._stretches(d, s, 400), 400, 0) >> np.uint64(2) for d, s in blocks]
    told = suffixes._copies([np.unique(k) for k in sent], [np.packbits(np.unique(k, return_counts=True)[1] > 1).tobytes() for k in sent])
    for (data, sizes), key, reply in zip(blocks, sent, told):
        begin, end = suffixes._stretches(data, sizes, 400)
        # Every window begins in one stretch, and none is longer than a window.
        assert sum((end - begin).tolist()) == sum(max(0, n - 399) for n in sizes.tolist()) and (end - begin).max() <= 400
        monkeypatch.setattr(suffixes, "bucket_edges", lambda keys, n, bits: np.array([0, len(keys)]))
        open_, copied = suffixes._folded(data, sizes, 400, {0: reply}, 1)
        active, keys = active + int(open_.sum()), keys + int(suffixes._fitting(sizes, 400).sum())
    assert active < 0.55 * keys
    monkeypatch.undo()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: digest(r) for r in suffixes.remove_repeats(docs).collect()}
    assert found == dict(enumerate(brute([t.encode() for t in texts])))


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table_against_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = {r[0]: b for r, b in zip(rows, brute([(r[1] or "").encode() for r in rows]))}
    rows = suffixes.op2_suffix_dedup(spark, SF).collect()
    assert {r[0]: tuple(r)[1:5] for r in rows} == want and rows[0].__fields__[5:] == ["has_repeats"]
    assert all(r["has_repeats"] == (r["n_removed"] > 0) for r in rows)
    assert any(b[1] for b in want.values())
