"""run() and each of its stages, each judged on its own input, against plain statements of what it keeps."""

from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest
from test_decontaminate import plain_leaks
from test_neardup import brute_classes

from lexspark.functions.materialize import cut_lineage
from lexspark.llm import quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF), f"test-{name}")
        seen.append(docs.collect())
        assert docs.columns == (COLUMNS if name != "sharding" else [*COLUMNS, "shard"])
    return seen


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_stages_and_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_rejected_documents_go(spark, stages):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id FROM ({quality.ORACLE}) WHERE kept ORDER BY doc_id").fetchall()
    assert ids(stages[1]) == [d for d, in want] and 0 < len(want) < len(stages[0])


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1]]
    kept = set(ids(stages[2]))
    groups = brute_classes(rows)
    assert all(sum(rows[i][0] in kept for i in group) == 1 for group in groups.values())
    assert len(kept) == len(groups) < len(rows)


def test_leaking_documents_go(stages):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    leaking = {d for d, _ in plain_leaks([(r["doc_id"], r["text"]) for r in stages[2]], items)}
    assert ids(stages[3]) == [d for d in ids(stages[2]) if d not in leaking] and leaking


def targets_of(sizes):
    """Water filling: sources share all words 5, 2, 1, …, and stop at three times their own."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        capped = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not capped:
            return target | {s: left * weight[s] / total for s in free}
        for s in capped:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= capped
    return target


def test_sources_meet_their_targets(stages):
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in stages[3]}
    source = {r["doc_id"]: r["source"] for r in stages[3]}
    sizes = defaultdict(int)
    for d, n in size.items():
        sizes[source[d]] += n
    target = targets_of(sizes)
    copies = Counter(ids(stages[4]))
    taken = defaultdict(int)
    for d, n in size.items():
        rate = target[source[d]] / sizes[source[d]]
        assert copies[d] in (int(rate), int(rate) + 1) and copies[d] <= 3
        taken[source[d]] += copies[d] * n
    # One coin a document: a source is off by about what its documents' coins can be off, at most three deviations.
    for s, goal in target.items():
        rate = goal / sizes[s] % 1
        deviation = (rate * (1 - rate) * sum(n * n for d, n in size.items() if source[d] == s)) ** 0.5
        assert abs(taken[s] - goal) <= 3 * deviation + 1
    assert {(r["doc_id"], r["text"]) for r in stages[4]} <= {(r["doc_id"], r["text"]) for r in stages[3]}


def test_shards_hold_everything_near_equally(spark, stages):
    rows = stages[5]
    assert ids(rows) == ids(stages[4])
    held, texts = Counter(), defaultdict(set)
    for r in rows:
        held[r["shard"]] += len((r["text"] or "").encode()) + 1
        texts[r["text"]].add(r["shard"])
    assert set(held) == set(range(8)) and all(len(s) == 1 for s in texts.values())
    largest = max(len((r["text"] or "").encode()) * n for r, n in ((r, sum(x["text"] == r["text"] for x in rows)) for r in rows))
    assert max(held.values()) - min(held.values()) <= largest
    assert Counter((r["doc_id"], r["shard"]) for r in corpus_pipeline.run(spark, SF).collect()) == Counter((r["doc_id"], r["shard"]) for r in rows)


def test_odd_tables_run_through(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int"
    text = "plain words that read well and say that the house is old but the garden is new and green, so they go there often. " * 8
    rows = [(1, text, "en", "a", 1, 5), (1, text, "en", "a", 1, 5), (None, None, None, None, None, None), (2, "", "en", None, 0, 1), (3, text + "more", None, "b", 2, 2)]
    for name, some in (("some", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "nothing of this"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in out} <= {1, 3, None}
