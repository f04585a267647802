"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

The patterns give spans of three kinds, and at the same time the labels: the value of a pattern match is a sample of random
strings, any other token of at least ``MIN_SAMPLE`` characters a sample of ordinary identifiers. Both models hold first-order
transition counts over ``ALPHABET`` with one symbol for start and end. Tasks count the transitions of all documents; what
meets in one place is a sum per transition and label, at most ``2 * SYMBOLS ** 2`` rows whatever the input. Smoothing differs,
since the classes do: a random string may follow any character with any other, so its model starts from equal counts, while the
identifiers' model falls back to the frequency of the next character, the more the more different followers a character has
(Witten and Bell), and no single transition counts for more than ``MAX_EVIDENCE``. A token of at least ``MIN_TOKEN`` characters outside
of all pattern spans becomes a span of kind ``model`` if it holds a letter, a digit and ``MIN_DISTINCT`` different characters,
and its log-likelihood ratio is at least ``MIN_RATIO`` nats and ``MIN_RATE`` nats for each transition.

Defined cases: a null text is empty and has no spans; without a single labelled random string the model adds no span, and
without identifiers neither; rows with equal ids are results of their own; a null id passes through; an empty table gives no
rows; further columns are ignored. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import table

# The patterns of the three kinds, and the least length of a value, a key and a digest.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "model")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOLS = len(ALPHABET) + 1
MIN_SAMPLE, MIN_TOKEN, MIN_DISTINCT = 12, 20, 8
MIN_RATIO, MIN_RATE = 12.0, 0.5
# One transition that no identifier has shown yet says no more than this, in nats.
MAX_EVIDENCE = 3.0
# The names of ASSIGN in lower case; a text without any of them has no match.
NAMES = (b"passw", b"secret", b"token", b"api")
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_SAMPLE},}}")
# A digest or a key is part of a token, so a text without tokens has neither.
LONG_HEX = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")

_CODES = np.full(256, SYMBOLS - 1, np.int64)
_CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
SPANS = "array<struct<kind: string, start: bigint, end: bigint, ratio: double>>"


def pattern_spans(text: str, raw: bytes, tokens: list[re.Match]) -> list[tuple[int, int, int, str]]:
    """``(start, kind number, end, value)`` of the fixed patterns, in order."""
    found = []
    lower = raw.lower()
    if any(name in lower for name in NAMES):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if tokens:
        if b"AKIA" in raw:
            found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        if any(len(t[0]) >= MIN_HEX for t in tokens):
            found += [(m.start(), 2, m.end(), m[0]) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def outside(tokens: list[re.Match], found: list[tuple[int, int, int, str]]) -> list[re.Match]:
    """Tokens that overlap no span of ``found``, which is ordered by start."""
    kept, at, reach = [], 0, 0
    for token in tokens:
        while at < len(found) and found[at][0] < token.end():
            reach = max(reach, found[at][2])
            at += 1
        if reach <= token.start():
            kept.append(token)
    return kept


def _read(batch: pa.RecordBatch) -> Iterator[tuple[str, list[re.Match], list[tuple[int, int, int, str]]]]:
    for value in batch.column("text").cast(pa.binary()):
        raw = value.as_py() or b""
        text = raw.decode("utf-8", "replace")
        tokens = list(TOKEN.finditer(text))
        yield text, tokens, pattern_spans(text, raw, tokens)


def transitions(samples: list[str]) -> np.ndarray:
    """Codes ``previous * SYMBOLS + next`` of all samples, each between two end symbols."""
    codes = _CODES[np.frombuffer(("\n" + "\n".join(samples) + "\n").encode("ascii", "replace"), np.uint8)]
    return codes[:-1] * SYMBOLS + codes[1:]


def count_transitions(docs: DataFrame) -> DataFrame:
    """``(label, code, n)``: transition counts of random strings (label 1) and ordinary identifiers (0) over all documents."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
        for batch in stream:
            samples: tuple[list[str], list[str]] = ([], [])
            for _, tokens, found in _read(batch):
                samples[0].extend(t[0] for t in outside(tokens, found))
                samples[1].extend(value for *_, value in found)
            for label in (0, 1):
                if samples[label]:
                    totals[label] += np.bincount(transitions(samples[label]), minlength=SYMBOLS * SYMBOLS)
        label, code = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (label, code, totals[label, code])], ["label", "code", "n"])

    counted = docs.select("text").mapInArrow(count, "label bigint, code bigint, n bigint")
    return counted.groupBy("label", "code").agg(F.sum("n").alias("n"))


def log_ratios(counts: dict[tuple[int, int], int]) -> np.ndarray | None:
    """Log-likelihood ratio (random against ordinary) of each transition; None if a class has no sample."""
    tables = np.zeros((2, SYMBOLS, SYMBOLS))
    for (label, code), n in counts.items():
        tables[label, code // SYMBOLS, code % SYMBOLS] = n
    ordinary, random = tables
    if not ordinary.sum() or not random.sum():
        return None
    share = (ordinary.sum(0) + 1) / (ordinary.sum() + SYMBOLS)
    followers = (ordinary > 0).sum(1, keepdims=True) + 1
    ordinary = (ordinary + followers * share) / (ordinary.sum(1, keepdims=True) + followers)
    random = (random + 1) / (random.sum(1, keepdims=True) + SYMBOLS)
    return np.clip(np.log(random) - np.log(ordinary), -MAX_EVIDENCE, MAX_EVIDENCE)


def fit(docs: DataFrame) -> np.ndarray | None:
    """The table of :func:`log_ratios` over the labelled samples of all ``docs``; it has ``SYMBOLS ** 2`` numbers."""
    return log_ratios({(r["label"], r["code"]): r["n"] for r in count_transitions(docs).collect()})


def score(tokens: list[str], ratios: np.ndarray) -> list[tuple[float, bool]]:
    """Log-likelihood ratio of each token, and whether it counts as a secret."""
    out = []
    for token in tokens:
        path = transitions([token])
        ratio = float(ratios.ravel()[path].sum())
        varied = len(set(token)) >= MIN_DISTINCT and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)
        out.append((ratio, varied and len(token) >= MIN_TOKEN and ratio >= max(MIN_RATIO, MIN_RATE * len(path))))
    return out


def find_secrets(docs: DataFrame, ratios: np.ndarray | None) -> DataFrame:
    """``(doc_id, spans)``: pattern spans and, with fitted ``ratios``, model spans, by start, then kind."""

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())]))
        for batch in stream:
            rows = []
            for _, tokens, found in _read(batch):
                spans = [(start, k, end, None) for start, k, end, _ in found]
                long = [t for t in outside(tokens, found) if len(t[0]) >= MIN_TOKEN] if ratios is not None else []
                for token, (ratio, secret) in zip(long, score([t[0] for t in long], ratios) if long else ()):
                    if secret:
                        spans.append((token.start(), 3, token.end(), ratio))
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "ratio": r} for s, k, e, r in sorted(spans, key=lambda x: x[:2])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, spans {SPANS}")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, fit(docs))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))
