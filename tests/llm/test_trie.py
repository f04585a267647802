"""The prefix trie against nested dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest

from lexspark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, rng string, depth int"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(convs):
    """Rows of the trie over ``{conv_id: [(role, text), ...]}``."""
    members = defaultdict(list)
    for conv_id in sorted(convs):
        for d in range(len(convs[conv_id]) + 1):
            members[tuple(convs[conv_id][:d])].append(conv_id)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[:len(path)] == path]
        ends = ",".join(str(c) for c in ids if len(convs[c]) == len(path))
        out.append((
            ids[0], len(path), members[path[:-1]][0] if path else None, len(ids), sum(len(p) == len(path) + 1 for p in below),
            sum(not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def lists(rows):
    out = defaultdict(list)
    for conv_id, turn, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if conv_id is not None:
            out[conv_id].append((role or "", text or ""))
    return dict(out)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def rows_of(df):
    assert df.columns == list(COLUMNS)
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_rows(rng, n_convs, most_turns):
    """A third of the conversations are copies, another third starts alike."""
    shared = [(f"r{k % 2}", f"shared é {k}") for k in range(most_turns)]
    rows = []
    for c in range(n_convs):
        turns = shared if c % 3 == 0 else shared[:2] if c % 3 == 1 else []
        turns = turns + ([] if c % 3 == 0 else [(rng.choice("ab"), rng.choice(["x", "y", "zz", ""])) for _ in range(rng.randint(1, most_turns))])
        rows += [(c, t, role, text, "x", 1) for t, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_rows, levels, queue", [(None, 4096, 1000), (5, 3, 2), (1, 1, 1), (10_000, 2, 3)])
def test_shards_bands_and_spills(spark, shard_rows, levels, queue):
    rows = some_rows(random.Random(1), 90, 9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = trie.prefix_trie(df, None, shard_rows, levels, queue)
    assert rows_of(got) == plain_trie(lists(rows))


def test_one_conversation_with_most_rows(spark):
    rows = [(4, t, "user", f"turn {t % 3}", "x", 1) for t in range(600)] + [(c, t, "user", f"turn {t % 3}", "x", 1) for c in range(5, 25) for t in range(c)]
    got = rows_of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), None, 30, 100, 10))
    convs = lists(rows)
    # The plain search is quadratic in the nodes; here they are one chain, so the sums are known.
    n = {d: sum(len(c) >= d for c in convs.values()) for d in range(601)}
    for conv_id, depth, _, n_convs, children, leaves, saved, _ in got:
        assert (n_convs, children, leaves) == (n[depth], int(depth < 600), 1)
        assert saved == sum((n[d] - 1) * 6 for d in range(max(depth, 1), 601))
    assert len(got) == 601


def test_queue_spills_and_keeps_order():
    rng = random.Random(2)
    queue = trie.ForwardQueue(7)
    want = defaultdict(lambda: (0, 0, 0))
    for _ in range(500):
        receiver, saved = (-rng.randint(0, 20), -rng.randint(0, 5)), rng.randint(0, 9)
        queue.send((*receiver, 2, saved, 1))
        want[receiver] = tuple(a + b for a, b in zip(want[receiver], (2, saved, 1)))
        assert len(queue.held) <= 7
    for receiver in ((depth, conv) for depth in range(-20, 1) for conv in range(-5, 1)):
        assert queue.receive(receiver) == want[receiver]
    queue.close()
    assert not queue.held and not queue.spilled


def test_fold_of_nothing():
    schema = pa.schema([(n, pa.bool_() if n == "inside" else pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "inside", "leaves", "saved", "children")])
    empty = pa.RecordBatch.from_pylist([], schema)
    assert [b.num_rows for b in trie.fold(iter([empty]))] == [0]


def test_query_equals_plain_trie(spark):
    rows = duckdb.sql("select conv_id, turn, role, text from '/root/testdata/sf0.01/conversations.parquet'").fetchall()
    got = rows_of(trie.op13_prefix_trie(spark, "/root/testdata/sf0.01"))
    assert got == plain_trie(rebuilt(lists(rows)))


def test_nulls_ties_repeats_and_turnless_conversations(spark, tmp_path):
    rows = [
        (0, None, "user", "first", "x", 1), (0, 0, None, "second", "x", 1), (0, 1, "user", None, "x", 1), (0, 1, "user", None, "x", 1),
        (1, 0, "b", "tie", "x", 1), (1, 0, "a", "tie", "x", 1), (1, 0, "a", "b|tie", "x", 1), (1, 5, "ab", "", "x", 1), (None, 0, "user", "lost", "x", 1),
        (6, 0, "user", "absent base", None, 1), (7, 0, "user", "é" * 3000, "x", 1), (13, 2, "a", "b", "x", 1), (10, 9, "a", "b", "x", 1), (10, 10, None, None, None, None),
    ]
    rows += [(2, t, "user", "x", "x", 1) for t in range(300)] + [(3, t, "user", "x", "x", 1) for t in range(300)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/some/conversations.parquet")
    convs = rebuilt(lists(rows))
    assert any(not turns for turns in convs.values())
    got = rows_of(trie.op13_prefix_trie(spark, f"{tmp_path}/some"))
    assert got == plain_trie(convs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/some/conversations.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.ORACLE})").fetchall(), key=str) == got


def test_empty_table_and_only_turnless(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert trie.op13_prefix_trie(spark, f"{tmp_path}/none").collect() == []
    none = spark.createDataFrame([], SCHEMA)
    ids = spark.createDataFrame([(5,), (3,)], "conv_id long")
    assert rows_of(trie.prefix_trie(none, ids)) == plain_trie({3: [], 5: []})
