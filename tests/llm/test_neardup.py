"""Near-duplicate classes against all pairs computed one by one."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexspark.llm import neardup
from lexspark.llm.blocks import from_planes, planes

SCHEMA = "doc_id long, text string, root long, vector string"


def shingle_counts(text):
    words = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute_classes(rows):
    counted = [shingle_counts(text) for _, text in rows]
    df = Counter(s for c in counted for s in c)
    n = len(rows)
    weight = [{s: k * (1 + math.log(n / df[s]) / math.log(n + 1)) for s, k in c.items()} for c in counted]
    holders = defaultdict(list)
    for i, w in enumerate(weight):
        for s in w:
            holders[s].append(i)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = {(i, j) for members in holders.values() for i in members for j in members if i < j}
    for i, j in pairs:
        least = sum(min(w, weight[j][s]) for s, w in weight[i].items() if s in weight[j])
        if least / (sum(weight[i].values()) + sum(weight[j].values()) - least) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(i)
    return groups


def classes_of(rows):
    groups = brute_classes(rows)
    return sorted((rows[i][0], min((rows[k][0] for k in g if rows[k][0] is not None), default=None), len(g)) for g in groups.values() for i in g)


def make_rows(seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for base in range(25):
        words = list(rng.choice(vocabulary, 160))
        for copy in range(int(rng.integers(1, 6))):
            changed = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(0, 3))):
                changed[at] = "changed"
            rows.append((len(rows) * 3, " ".join(changed)))
    rows += [(9000 + i, t) for i, t in enumerate(["", "", "  ", None, "one two", "One, two!", "one three", "x " * 4000, "x " * 4000])]
    return rows


def test_classes_equal_all_pairs(spark):
    rows = make_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, neardup.near_duplicate_classes(docs).collect()))
    assert got == classes_of(rows)


def test_large_group_and_chain(spark):
    # Each text differs from the next by one word: neighbours are near, the ends are not.
    words = [f"k{i}" for i in range(200)]
    rows = []
    for i in range(40):
        words[5 * i % 200] = f"z{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, neardup.near_duplicate_classes(docs).collect()))
    assert got == classes_of(rows)


def test_one_of_each_class_stays_with_all_columns(spark):
    rows = [(1, "a b c d e f g", "x", 5), (1, "a b c d e f g", "y", 6), (None, "q w e r t y", None, None), (None, "q w e r t y", "z", 7), (4, None, "n", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string, vid long").coalesce(1)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "") for r in kept.collect()) == ["", "a b c d e f g", "q w e r t y"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicate_classes(empty).collect() == []
    assert neardup.drop_near_duplicates(empty).collect() == []


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(1)
    key = rng.integers(0, 1 << 56, 300, dtype=np.uint64)
    a, b = rng.random(300) + 0.1, rng.random(300) + 0.1
    order = np.argsort(key)
    draws = [neardup.weighted_samples(np.zeros(300, int), key[order], w[order], 1500)[:, 0] for w in (a, b)]
    expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((draws[0] == draws[1]).mean() - expected) < 0.05


@pytest.mark.parametrize("width", [7, 8])
def test_planes_round_trip(width):
    values = np.array([0, 1, 255, 1 << 40, (1 << 56) - 1], np.uint64)
    assert (from_planes(planes(values, width), len(values), width) == values).all()
