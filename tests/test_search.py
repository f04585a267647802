"""Lexical, exact and approximate search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.functions.encode import HashedTokenEncoder, ModelEncoder
from lexspark.functions.materialize import ordered_index
from lexspark.functions.vector import cosine
from lexspark.operators import ann, dense
from lexspark.operators.bm25 import BM25Index
from lexspark.operators.vectorize import TermVectorizer

DOCS = [(0, "chat noir chat"), (1, "chien noir"), (2, "oiseau bleu rapide"), (3, ""), (4, "chat bleu"), (5, None)]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def bm25_by_hand(query):
    corpus = [(t or "").split() for _, t in DOCS]
    n, avg = len(corpus), sum(map(len, corpus)) / len(corpus)
    df = {t: sum(t in d for d in corpus) for d in corpus for t in d}
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    scores = []
    for i, d in enumerate(corpus):
        s = sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query.split())
        scores.append((-round(s, 4) + 0.0, i))
    return [(i, -s + 0.0) for s, i in sorted(scores)]


def test_bm25_matches_formula_with_zero_fill_and_repeats(spark, docs, tmp_path):
    texts = {10: "chat bleu", 11: "noir noir", 12: "inconnu", 13: "chat"}
    queries = spark.createDataFrame(list(texts.items()), "query_id long, query string")
    index = BM25Index.build(docs)
    index.write(str(tmp_path / "bm25"))
    for source in (index, BM25Index.load(spark, str(tmp_path / "bm25"))):
        hits = source.search(queries, k=4).orderBy("query_id", "rank").collect()
        for query_id, text in texts.items():
            assert [(r.doc_id, r.score) for r in hits if r.query_id == query_id] == bm25_by_hand(text)[:4]
    assert index.search(queries, k=4, zero_fill=False).where("query_id = 12").count() == 0


def test_best_matches_in_small_slices_make_no_row_per_query_and_document(spark, monkeypatch):
    """Each task gives at most ``k`` rows a query, and the same best as all scores ranked."""
    from lexspark.functions.ranking import top_k
    from lexspark.operators import matching

    rng, words = np.random.default_rng(1), [f"mot{i}" for i in range(12)]
    texts = [(i, " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", " ".join(words[i : i + 3])) for i in range(9)] + [("q9", None)], "query_id string, query string")
    made, best = [], matching.top_k
    monkeypatch.setattr(matching, "top_k", lambda df, *rest: (made.append(df.count()), best(df, *rest))[1])
    order = [F.asc("doc_id")]
    for cells in (1, 64, 1 << 20):
        monkeypatch.setattr(matching, "MATCH_CELLS", cells)
        index, vectorizer = BM25Index.build(docs), TermVectorizer.fit(docs)
        for got, scored, name in (
            (index.search(queries, 4, zero_fill=False), index.scores(queries), "score"),
            (vectorizer._best(docs, queries, 4), vectorizer.similarities(docs, queries), "sim"),
        ):
            expected = top_k(scored, ["query_id"], [F.desc(name), *order], 4)
            columns = ["query_id", "doc_id", name, "rank"]
            assert sorted(got.select(*columns).collect()) == sorted(expected.select(*columns).collect())
    assert len(made) == 6 and max(made) <= 4 * 9 * 8


def test_bm25_fill_where_the_mean_idf_is_negative(spark, tmp_path, monkeypatch):
    """Words in nearly all documents score below zero, so documents that match nothing come before those that match."""
    texts = {i: "commun partout toujours" if i not in (3, 11) else "" for i in range(14)} | {20: "rare", 21: None}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(1, "commun"), (2, "rien"), (3, "rare commun"), (4, None)], "query_id long, query string")
    from lexspark.operators import bm25

    monkeypatch.setattr(bm25, "FILL_CHUNK", 4)
    index = BM25Index.build(frame)
    assert index.stats.first()["mean_idf"] < 0
    index.write(str(tmp_path / "negative"), buckets=4)
    for source in (index, BM25Index.load(spark, str(tmp_path / "negative"))):
        for k in (3, 6, 40):
            rows = source.search(queries, k).collect()
            every = {(r.query_id, r.doc_id): r.score for r in source.scores(queries).collect()}
            for query_id in (1, 2, 3, 4):
                want = sorted(texts, key=lambda d: (-every.get((query_id, d), 0.0), d))[:k]
                assert [r.doc_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == query_id] == want


def test_bm25_search_reads_only_the_buckets_asked(spark, docs, tmp_path):
    path = str(tmp_path / "buckets")
    BM25Index.build(docs).write(path, buckets=64)
    stored = BM25Index.load(spark, path)
    one = spark.createDataFrame([(1, "chien")], "query_id long, query string")
    files = {f.split("/bucket=")[1].split("/")[0] for f in stored._postings_of(one.select(F.lit("chien").alias("term"))).inputFiles()}
    plan = stored.scores(one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = stored._postings_of(one.select(F.lit("chien").alias("term")))
    assert read.select("term").distinct().count() < stored.postings.select("term").distinct().count() and files
    assert [r.doc_id for r in stored.search(one, 1).collect()] == [1]


def test_vectorizer_options(spark, docs):
    with pytest.raises(ValueError):
        TermVectorizer.fit(docs, "other")
    counts = TermVectorizer.fit(docs, "count").transform(docs).where("doc_id = 0").collect()
    assert {r.term: r.weight for r in counts} == {"chat": 2, "noir": 1}
    queries = spark.createDataFrame([(1, "chat"), (2, "zzz")], "query_id long, query string")
    found = {r.query_id: r for r in TermVectorizer.fit(docs).has_match(docs, queries, 0.5).collect()}
    assert found[1].has_match and found[1].doc_id == 0 and not found[2].has_match and found[2].doc_id == 0


def test_vectorizer_round_trip_keeps_kind_and_size(spark, docs, tmp_path):
    for kind, frame in (("count", docs), ("tfidf", docs), ("count", docs.limit(0))):
        fitted = TermVectorizer.fit(frame, kind)
        fitted.save(str(tmp_path / "v"))
        loaded = TermVectorizer.load(spark, str(tmp_path / "v"))
        assert (loaded.kind, loaded.n_docs) == (kind, frame.count())
        assert sorted(loaded.transform(docs).collect()) == sorted(fitted.transform(docs).collect())


def vectors_frame(spark, matrix, name="doc_id"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def brute(q, c, k, allowed=None):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n > 0, n, 1)

    sims = np.round(unit(q) @ unit(c).T, 6) + 0.0
    out = {}
    for i, row in enumerate(sims):
        ids = [j for j in range(len(row)) if allowed is None or allowed(i, j)]
        out[i] = [(j, row[j]) for j in sorted(ids, key=lambda j: (-row[j], j))[:k]]
    return out


def collect_hits(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc_id, r.score))
    return out


def test_dense_top_k_plans_agree_with_brute_force(spark):
    rng = np.random.default_rng(0)
    corpus = rng.normal(size=(200, 8)).astype(np.float32)
    corpus[50:120] = corpus[50]  # a third of the rows are copies
    corpus[7] = 0
    queries = rng.normal(size=(9, 8)).astype(np.float32)
    queries[3] = corpus[50]
    c, q = vectors_frame(spark, corpus), vectors_frame(spark, queries, "query_id")
    expected = brute(queries.astype(float), corpus.astype(float), 4)
    assert collect_hits(dense.dense_top_k(c.repartition(3), q, 4)) == expected
    assert collect_hits(dense.dense_top_k(c, q, 4, max_broadcast=2)) == expected
    with_null = c.unionByName(spark.createDataFrame([(999, None)], c.schema))
    assert collect_hits(dense.dense_top_k(with_null, q, 4)) == expected


def test_block_plan_splits_cells(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_ROWS", 2)
    monkeypatch.setattr(dense, "MAX_BROADCAST_QUERIES", 3)
    rng = np.random.default_rng(1)
    corpus, queries = rng.normal(size=(60, 4)), rng.normal(size=(7, 4))
    cell = lambda j: 0 if j < 40 else j % 3  # noqa: E731  one hot cell
    c = vectors_frame(spark, corpus).withColumn("cell", F.when(F.col("doc_id") < 40, 0).otherwise(F.col("doc_id") % 3).cast("int"))
    q = vectors_frame(spark, queries, "query_id").withColumn("cells", F.array(F.lit(0), F.lit(2)))
    expected = brute(queries, corpus.astype(np.float32).astype(float), 3, lambda i, j: cell(j) in (0, 2))
    for bound in (100, 3):
        got = collect_hits(dense.dense_top_k(c, q, 3, celled=True, max_broadcast=bound))
        assert {k: [d for d, _ in v] for k, v in got.items()} == {k: [d for d, _ in v] for k, v in expected.items()}


def test_cell_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(150, 6))
    v = vectors_frame(spark, matrix)
    q = v.withColumnRenamed("doc_id", "query_id").where("query_id < 20")
    index = ann.CellIndex.build(v, n_cells=8)
    index.write(str(tmp_path / "ivf"))
    stored = ann.CellIndex.load(spark, str(tmp_path / "ivf"))
    exact = dense.dense_top_k(v, q, 5)
    everything = stored.search(q, 5, n_probe=8)
    assert collect_hits(everything) == collect_hits(exact)
    approximate = stored.search(q, 5, n_probe=2)
    shares = [r.recall for r in ann.recall(approximate, exact).collect()]
    assert len(shares) == 20 and all(0 <= s <= 1 for s in shares)
    missing = ann.missing_hits(approximate, exact).count()
    assert round(100 - missing) == round(sum(shares) * 5)
    assert ann.mean_recall(everything, exact).first().mean_recall == 1.0
    norms = [np.linalg.norm(r.centroid) for r in index.centroids.collect()]
    assert len(norms) == 8 and np.allclose(norms, 1)


def test_more_cells_than_a_task_holds(spark, monkeypatch):
    """70,000 cells, searched in groups: every row gets the cells a scan of all centroids gives, ties included."""
    rng = np.random.default_rng(4)
    points = rng.normal(size=(70_000, 3))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[5000:5010] = points[17]
    matrix = rng.normal(size=(400, 3)).astype(np.float32).astype(float)
    matrix[0], matrix[1] = 0, points[17]
    centroids = spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())], "cell int, centroid array<double>")
    monkeypatch.setattr(ann, "CENTROID_BYTES", 1000)
    monkeypatch.setattr(ann, "GROUP_ROWS", 7)
    frame = vectors_frame(spark, matrix)
    frame = frame.unionByName(spark.createDataFrame([(999, None)], frame.schema))
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = matrix.astype(np.float32).astype(float)
    unit = unit / np.where(norms > 0, np.linalg.norm(unit, axis=1, keepdims=True), 1)
    sims = np.round(unit @ points.T, 6) + 0.0
    want = {i: np.lexsort((np.arange(70_000), -row))[:4].tolist() for i, row in enumerate(sims)}
    got = {r.doc_id: r.cells for r in ann.with_nearest(frame, centroids, 4, "cells").collect()}
    assert got == want
    assert {r.doc_id: r.cell for r in ann.assign_cells(frame, centroids).collect()} == {i: c[0] for i, c in want.items()}


def test_two_level_training(spark, monkeypatch):
    """Two levels find cells as good as one level's: members lie as close, and probing finds at least as much."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 12))
    matrix = (centres[rng.integers(0, 60, 1500)] + rng.normal(scale=0.4, size=(1500, 12))).astype(np.float32)
    v = vectors_frame(spark, matrix)
    q = v.withColumnRenamed("doc_id", "query_id").where("query_id % 10 = 0")
    exact = dense.dense_top_k(v, q, 5)
    flat = ann.CellIndex.build(v, n_cells=49)
    monkeypatch.setattr(ann, "FLAT_CELLS", 8)
    deep = ann.CellIndex.build(v, n_cells=49)
    points = {r.cell: np.array(r.centroid) for r in deep.centroids.collect()}
    assert sorted(points) == list(range(len(points))) and 40 <= len(points) <= 58
    assert all(abs(np.linalg.norm(p) - 1) < 1e-9 for p in points.values())
    unit = matrix.astype(float) / np.linalg.norm(matrix.astype(float), axis=1, keepdims=True)
    sims = np.round(unit @ np.stack([points[c] for c in range(len(points))]).T, 6)
    assert {r.doc_id: r.cell for r in deep.vectors.collect()} == dict(enumerate(sims.argmax(axis=1).tolist()))
    found = [ann.mean_recall(index.search(q, 5, 2), exact).first().mean_recall for index in (flat, deep)]
    print("recall of one and of two levels:", found)
    assert found[1] >= max(0.9, found[0] - 0.02)


def test_encoders(spark):
    encoder = HashedTokenEncoder(16)
    texts = spark.createDataFrame([("chat noir",), ("",), (None,), ("chat chat bleu rouge vert",)], "text string")
    rows = texts.withColumn("v", encoder(F.col("text"))).withColumn(
        "unit", encoder(F.lit("chat bleu"))
    ).select("v", cosine(F.col("v"), F.col("unit")).alias("dense"), encoder.similarity(F.col("text"), F.col("unit")).alias("sparse"))
    got = rows.collect()
    assert [row.v is None for row in got] == [False, False, True, False]
    for row in got:
        assert row.v is None or np.isclose(np.linalg.norm(row.v), 1) or not any(row.v)
        assert row.sparse is None or np.isclose(row.dense, row.sparse)

    def make():
        return lambda batch: np.stack([np.array([len(t), 1.0]) for t in batch])

    model = ModelEncoder("lengths", make)
    out = spark.createDataFrame([("ab",), ("abcd",)], "text string").select(model(F.col("text")).alias("v"))
    assert sorted(r.v for r in out.collect()) == [[2.0, 1.0], [4.0, 1.0]]


def test_ordered_index(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    got = ordered_index(df, [F.desc("x")], "n").collect()
    assert all(r.n == 999 - r.x for r in got) and len(got) == 1000


def test_similarities_held_at_a_time_are_bounded():
    import tracemalloc

    from lexspark.operators import dense

    rng = np.random.default_rng(0)
    queries, units = rng.normal(size=(256, 4)), rng.normal(size=(50_000, 4))
    score = dense._make_kernel(5, 6)[3]
    tracemalloc.start()
    rows, ids, scores = score(np.arange(256), queries, np.arange(50_000), units)
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    print(f"peak {peak:.0f} MB")
    sims = np.round(queries @ units.T, 6) + 0.0
    best = np.argsort(-sims, axis=1, kind="stable")[:, :5]
    assert (ids.reshape(256, 5) == best).all() and (scores == np.take_along_axis(sims, best, 1).ravel()).all()
    assert peak < 64
