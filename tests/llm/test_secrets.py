"""Pattern spans against plain scans; the models by held-out accuracy."""

import base64
import hashlib
import random
import re

import duckdb
import pytest

from lexspark.llm import secrets

SF = "/root/testdata/sf0.01"
PLAIN = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(1)) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
)


def plain(text):
    spans = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(PLAIN) for m in re.finditer(p, text or "", re.ASCII) if ok(m)]
    names = [PLAIN[k][0] for _, k, _ in spans]
    return [names.count(name) for name, *_ in PLAIN], ",".join(s for *_, s in sorted(spans))


def check(row, text):
    counts, listed = plain(text)
    assert [row["n_assign"], row["n_access"], row["n_hex"]] == counts
    assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    kept = [s for s in row["spans"].split(",") if s and not s.startswith("model:")]
    assert ",".join(kept) == listed
    starts = [int(s.split(":")[1]) for s in row["spans"].split(",") if s]
    assert starts == sorted(starts)


def test_base_equals_plain_scan(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    rows = secrets.op12_secret_scan(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for row in rows:
        check(row, texts[row["doc_id"]])
    assert sum(row["n_hex"] for row in rows) > 0


# Ordinary identifiers of the held-out set come from words the training texts do not hold.
TRAIN = """user account buffer index parser connect handle request socket stream config table column reader writer filter active
address archive balance binary cache channel client closed cluster command compare counter create current database default delete
device display document domain element enable engine error event example execute factory failure feature field first format frame
function global group height hidden history image initial input insert instance integer internal item language length library limit
local logger manager member memory message method module monitor network number object option order output package parent pattern
""".split()
HELD = "session record payload header cursor window vector matrix signal folder branch commit review export import layout".split()


def identifier(rng, pool):
    parts = [rng.choice(pool) for _ in range(rng.randint(3, 5))]
    name = rng.choice(("_", "-", "")).join(p.capitalize() if rng.random() < 0.3 else p for p in parts)
    return name + str(rng.randint(0, 99))


def key(rng):
    raw = rng.randbytes(rng.randint(18, 30))
    return rng.choice((base64.b64encode(raw).decode().rstrip("="), "".join(rng.choices(secrets.ALPHABET[:62], k=rng.randint(24, 40)))))


@pytest.fixture
def trained(spark):
    rng = random.Random(3)
    rows = [(i, f"call {identifier(rng, TRAIN)} with {identifier(rng, TRAIN)} é secret: {key(rng)} done") for i in range(1500)]
    return secrets.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_held_out_accuracy(trained):
    rng = random.Random(4)
    random_strings = [k for k in (key(rng) for _ in range(1200)) if len(k) >= secrets.MIN_TOKEN and any(c.isdigit() for c in k)]
    ordinary = [n for n in (identifier(rng, HELD) for _ in range(1200)) if len(n) >= secrets.MIN_TOKEN]
    caught = [s for _, s in secrets.score(random_strings, trained)]
    wrong = [s for _, s in secrets.score(ordinary, trained)]
    print(f"caught {sum(caught) / len(caught):.3f}, wrong {sum(wrong) / len(wrong):.3f}")
    assert sum(caught) / len(caught) > 0.95 and sum(wrong) / len(wrong) < 0.02


def test_counts_do_not_depend_on_the_split(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (sorted(map(tuple, secrets.count_transitions(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == many and len(one) <= 2 * secrets.SYMBOLS ** 2


def test_spans_of_both_sorts(spark, trained):
    rng = random.Random(9)
    hidden = next(k for k in iter(lambda: key(rng), None) if len(k) > 30 and any(c.isdigit() for c in k))
    text = f"é {hidden} and password = 'abcdefgh' plus {'0a' * 16} on {identifier(rng, TRAIN)} AKIA{'Z9' * 8}"
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), trained).first()
    assert [s["kind"] for s in row["spans"]] == ["model", "assign", "hex", "access"]
    model = row["spans"][0]
    assert text[model["start"]:model["end"]] == hidden and model["ratio"] > 0


def test_nulls_repeats_long_texts_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, spans string, label int"
    rows = [
        (1, None, "x", 1), (2, "", None, 1), (None, "api_key=AKIAABCDEFGH1234567", "x", 1), (3, "token: ab token: 12345678", "x", 1),
        (3, "token: ab token: 12345678", "x", 1), (4, "TOKEN=\"" + "f" * 40 + "\" ſecret=abcdefghij Key", "x", 1), (5, "token: secret: abcdefghij", "x", 1),
        (6, "pad " * 100_000 + "0123456789abcdef" * 3, "x", 1), (7, "AKIAAKIAAKIA AKIA" + "B" * 12, "x", 1),
    ]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/some/documents.parquet")
    got = secrets.op12_secret_scan(spark, f"{tmp_path}/some").collect()
    assert len(got) == len(rows)
    key_of = {(d, t) for d, t, *_ in rows}
    for row in got:
        texts = [t for d, t in key_of if d == row["doc_id"]]
        assert len(texts) == 1
        check(row, texts[0])
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert secrets.op12_secret_scan(spark, f"{tmp_path}/none").collect() == []
