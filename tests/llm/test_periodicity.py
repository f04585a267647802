"""Periodic runs against every lag and every stretch, one by one."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.llm import periodicity

SF = "/root/testdata/sf0.001"


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def plain_runs(words, min_words=24, repeats=3):
    found = []
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            stretch = words[i:j + q]
            if j > i and len(stretch) >= max(min_words, repeats * q) and smallest_period(stretch) == q:
                found.append((i, len(stretch), q))
            i = max(j, i + 1) if j > i else i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


periodic = st.lists(
    st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), min_size=1, max_size=14), st.integers(1, 12)), min_size=1, max_size=5,
).map(lambda parts: [w for unit, times in parts for w in unit * times])


@settings(max_examples=300, deadline=None)
@given(st.lists(periodic, min_size=1, max_size=3))
def test_runs_equal_plain_search(texts):
    assert periodicity.runs_of(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(periodic, st.integers(2, 9), st.integers(3, 5))
def test_other_limits(words, min_words, repeats):
    assert periodicity.runs_of([words], min_words, repeats) == [plain_runs(words, min_words, repeats)]


def test_long_texts_stay_cheap():
    rng = np.random.default_rng(5)
    coin = [b"x" if c else b"y" for c in rng.integers(0, 2, 60_000)]
    assert all(length >= 24 for _, length, _ in periodicity.runs_of([coin])[0])
    assert periodicity.runs_of([[b"x"] * 200_000])[0] == [(0, 200_000, 1)]
    unit = [str(c).encode() for c in rng.permutation(20_000)]
    assert periodicity.runs_of([unit * 3 + unit[:7]])[0] == [(0, 60_007, 20_000)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-(r[1] / r[2]), r[0], r[2]), default=(None,) * 3)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def answer(row):
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return tuple(row[name] for name in names)


def test_query_equals_plain_search(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    short = {d: t for d, t in rows if len((t or "").split()) <= 2500}
    got = {r["doc_id"]: answer(r) for r in periodicity.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows) and len(short) > 0.9 * len(rows)
    assert {d: got[d] for d in short} == {d: expected(d, t) for d, t in short.items()}
    assert sum(a[0] > 0 for a in got.values()) > 10


@pytest.fixture
def odd(spark, tmp_path):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n\x0b\x0c\r ", None), (None, "a b " * 30, "x"), (7, "a b " * 30, "x"), (7, "a b " * 30, "x"),
        (9, "é è " * 40 + "tail", "y"), (10, "one", "y"), (11, "w " * 50_000, "y"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([], "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/none/documents.parquet")
    return rows, tmp_path


def test_nulls_blanks_repeats_and_empty_tables(spark, odd):
    rows, path = odd
    got = periodicity.op11_periodic_runs(spark, f"{path}/some").collect()
    assert len(got) == len(rows)
    want = [(d, *expected(d, t)) for d, t, _ in rows if d is not None and d != 11]
    assert sorted((r["doc_id"], *answer(r)) for r in got if r["doc_id"] not in (None, 11)) == sorted(want)
    assert [answer(r)[:4] for r in got if r["doc_id"] is None] == [(1, 0, 60, 2)]
    assert periodicity.op11_periodic_runs(spark, f"{path}/none").collect() == []
