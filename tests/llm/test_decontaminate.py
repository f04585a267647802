"""Leaks against every window and every item."""

import re

import numpy as np
import pytest

from lexspark.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item_id long, distance string"


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        fresh = [i]
        for j, y in enumerate(b, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (x != y)))
        row = fresh
    return row[-1]


def plain_leaks(docs, items):
    """``{(doc_id, item_id): least distance}`` over all item-sized windows."""
    found = {}
    for item_id, text in items:
        item = words(text)
        if text is None or len(item) < 5:
            continue
        limit, known = int(0.2 * len(item)), set(item)
        for doc_id, doc in docs:
            ws = words(doc)
            for at in range(len(ws) - len(item) + 1):
                window = ws[at:at + len(item)]
                if sum(w in known for w in window) >= len(item) - limit and (d := distance(window, item)) <= limit:
                    found[doc_id, item_id] = min(d, found.get((doc_id, item_id), d))
    return found


def make(seed=5, n_docs=150, n_items=30):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(600)] + ["Été", "x_1"]

    def some(n):
        return rng.choice(vocabulary, n).tolist()

    items = [(i, " ".join(some(int(rng.integers(8, 30))))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        ws = some(int(rng.integers(10, 120)))
        if d % 2 == 0:
            item = words(items[int(rng.integers(n_items))][1])
            for _ in range(int(rng.integers(0, int(0.2 * len(item)) + 2))):
                at, kind = int(rng.integers(len(item))), int(rng.integers(3))
                item[at:at + (kind != 0)] = [] if kind == 1 else [str(rng.choice(vocabulary))]
            at = int(rng.integers(len(ws)))
            ws[at:at] = item
        docs.append((d, ", ".join(ws)))
    return docs, items


def find(spark, docs, items, **options):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], SCHEMA)
    return [tuple(r) for r in D.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), **options).collect()]


@pytest.mark.parametrize("block_bytes", [4_000_000, 900])
def test_recall_with_edits(spark, block_bytes):
    docs, items = make()
    want = plain_leaks(docs, items)
    got = {(d, i): dist for d, i, dist, _, _ in find(spark, docs, items, block_bytes=block_bytes)}
    assert got.items() <= want.items()
    edited = [k for k, d in want.items() if d > 0]
    recall = len(got) / len(want)
    print(f"recall {recall:.4f} of {len(want)} leaks, {len(edited)} with edits")
    assert len(edited) > 25 and recall >= 0.95 and {k for k, d in want.items() if d == 0} <= got.keys()


def test_without_enough_tables_nothing_is_lost(spark, monkeypatch):
    docs, items = make(6, 60, 12)
    monkeypatch.setattr(D, "fit_tables", lambda *args: None)
    texts = [t for _, t in docs]
    found = {(docs[text][0], item): d for text, item, d, _, _ in D.ItemBlock(items).scan(texts)}
    assert found == plain_leaks(docs, items)


def test_tables_that_cannot_reach_the_target_are_reported():
    assert D.fit_tables([np.arange(1, 21)], 50, target=1.1) is None


def test_query_finds_all_planted_passages(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.distance for r in D.op7_decontamination(spark, sf).collect()}
    assert got == plain_leaks(docs, items) and got


def test_nulls_ties_repeats_and_empty_tables(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = [(1, f"so {passage} it is"), (1, f"so {passage} it is"), (None, passage.upper()), (3, None), (4, ""), (5, "one two"), (6, "x " * 50_000 + passage)]
    items = [(7, passage), (8, passage), (None, passage), (9, None), (10, ""), (11, "one two")]
    got = sorted(find(spark, docs, items), key=str)
    want = [(d, i, 0, at, 10) for d, at in ((1, 1), (1, 1), (None, 0), (6, 50_000)) for i in (7, 8, None)]
    assert got == sorted(want, key=str)
    assert find(spark, [], items) == [] and find(spark, docs, []) == []
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], SCHEMA)
    kept = D.drop_leaking(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
