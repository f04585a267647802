"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words (runs of letters, digits, underscores and non-ASCII characters, lower-cased); a text of fewer
words is one shingle. A shingle weighs its count in the document times 1 + ln(N / df) / ln(N + 1), from exact document
frequencies. A partner at similarity t shares shingles of at least t times a document's weight, and a shared shingle has
df of two or more, so documents with less of those are alone and go no further. The others draw ``BANDS`` x ``ROWS``
consistent weighted samples; documents whose samples agree in a band are compared by exact weighted Jaccard similarity,
and classes are the connected components of the verified links.

Copies of a text are folded first. The heads of a document are the first ones of its bands' buckets. Each document is
compared with the smallest of its heads, then with those heads that this has not connected it to; then the documents
outside the head's component are in turn compared with all of other components, until no two components of a bucket are
left uncompared. Pairs whose shared weight by classes of shingles cannot reach the similarity are passed over, which
loses none. So a bucket of thousands of linked near copies costs about one comparison each, and no link between
different components is lost. Near copies that share buckets but stay below the similarity still meet pair by pair.

Defined cases: null, empty and word-less texts are one class; equal words make one class whatever the spacing, case and
punctuation; rows with equal or null ids stay separate rows; the class id is the smallest known doc_id in it; an empty
table gives no rows; other columns are ignored, or carried along by ``drop_near_duplicates``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.materialize import cut_lineage
from lexspark.llm.blocks import (
    KEY_SCHEMA, ask_buckets, block_rows, block_texts, bucket_edges, from_planes, n_buckets_for, pack_sorted, planes,
    store_blocks, with_answers,
)
from lexspark.llm.common import table

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
HASH_BITS = 56
TEXT_BATCH = 1_000_000
# Classes of shingles whose weights bound what two documents can have in common.
PARTS = 16
# Documents of a bucket that meet all others in the first round, and how many times more do in each next one.
LEADERS, GROWTH = 8, 8
# Links that one task turns into stars at once; more links are dealt to more tasks.
LINKS_PER_TASK = 1_000_000
SAMPLED_AT_ONCE = 1 << 16

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.array([chr(b).isalnum() or b == 95 or b >= 128 for b in range(256)])
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(n, base, np.uint64)
        held[0] = 1
        _POWERS[base] = held = np.cumprod(held, dtype=np.uint64)
    return held[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word in turn, and how many words each text has."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    inside = np.concatenate([[False], _IS_WORD[data]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[0::2], edges[1::2]
    # Prefix sums of a polynomial; a word is a difference, shifted back to where it begins.
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
    hashed = mix((upto[end] - upto[begin]) * _powers(_INVERSE, len(data))[begin])
    stops = np.cumsum([len(t) + 1 for t in texts])
    return hashed, np.diff(np.searchsorted(begin, stops), prepend=0)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) in order, as text numbers, shingle hashes and counts."""
    found = ([], [], [])
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (size < TEXT_BATCH or high == low):
            size += len(texts[high])
            high += 1
        lowered = [t.decode("utf-8", "replace").lower().encode() for t in texts[low:high]]
        for out, part in zip(found, _shingles(lowered)):
            out.append(part if out is not found[0] else part + low)
        low = high
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64 if f is found[0] else np.uint64) for f in found)


def _shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashed, n_words = word_hashes(texts)
    # Short texts are padded to one shingle, so all have at least one.
    short = np.maximum(0, SHINGLE - n_words)
    total = n_words + short
    stops = np.cumsum(total)
    filled = np.zeros(int(stops[-1]), np.uint64)
    owner_of_word = np.repeat(np.arange(len(texts)), n_words)
    filled[np.arange(len(hashed)) + (np.cumsum(short) - short)[owner_of_word]] = hashed
    combined = np.zeros(len(filled) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        combined = combined * np.uint64(_BASE) + filled[k:len(filled) - SHINGLE + 1 + k]
    owner = np.repeat(np.arange(len(texts)), total - SHINGLE + 1)
    at = np.arange(len(owner)) + (owner * (SHINGLE - 1))
    key = mix(combined[at]) >> np.uint64(64 - HASH_BITS)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
    return owner[first], key[first], np.diff(np.append(first, len(key)))


def _emit_keys(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, data in zip(batch.column("unit").to_pylist(), batch.column("data")):
                _, key, _ = shingles(block_texts(data.as_py()))
                keys, local = np.unique(key, return_counts=True)
                edges = bucket_edges(keys, n_buckets, HASH_BITS)
                rows = [(b, unit, pack_sorted(keys[i:j]), zlib.compress(local[i:j].astype("<u4").tobytes(), 1)) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "unit", "data", "extra"])

    return run


def _frequencies(keys: list[np.ndarray], extras: list[bytes]) -> list[bytes | None]:
    """Document frequency over all blocks for every key, in the order in which it was asked."""
    every = np.concatenate(keys)
    local = np.concatenate([np.frombuffer(zlib.decompress(e), "<u4") for e in extras])
    order = np.argsort(every, kind="stable")
    first = np.concatenate([[True], np.diff(every[order]) != 0])
    group = np.cumsum(first) - 1
    total = np.bincount(group, weights=local[order]).astype(np.int64)
    answer = np.empty(len(every), np.int64)
    answer[order] = total[group]
    cuts = np.cumsum([len(k) for k in keys])
    return [zlib.compress(a.astype("<u4").tobytes(), 1) for a in np.split(answer, cuts[:-1])]


def weighted_samples(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, n_samples: int) -> np.ndarray:
    """Improved consistent weighted samples, as one hash per sample and owner; ``owner`` counts from 0 without gaps.

    Owners are independent, so they are sampled in groups of about ``SAMPLED_AT_ONCE`` shingles to bound the scratch memory.
    """
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    group = starts // SAMPLED_AT_ONCE
    firsts = starts[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))]
    parts = [slice(a, b) for a, b in zip(firsts, np.append(firsts[1:], len(owner)))]
    return np.concatenate([_weighted_samples(owner[p], key[p], weight[p], n_samples) for p in parts], axis=1)


def _weighted_samples(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, n_samples: int) -> np.ndarray:
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    sizes = np.diff(np.append(starts, len(owner)))
    log_weight = np.log(weight)
    out = np.empty((n_samples, len(starts)), np.uint64)
    unit = 1.0 / (1 << 32)
    for k in range(n_samples):
        a = mix(key ^ np.uint64(mix(np.array([3 * k + 1], np.uint64))[0]))
        b = mix(a ^ np.uint64(0xD6E8FEB86659FD93))
        c = mix(b ^ np.uint64(0xA5A5A5A55A5A5A5B))
        low = np.uint64(0xFFFFFFFF)
        u = [((x + 0.5) * unit) for x in (a >> np.uint64(32), a & low, b >> np.uint64(32), b & low, c >> np.uint64(32))]
        r, log_c, beta = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]
        t = np.floor(log_weight / r + beta)
        score = log_c - r * (t - beta) - r
        least = np.minimum.reduceat(score, starts)
        hit = np.flatnonzero(score == np.repeat(least, sizes))
        hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]
        out[k] = mix(key[hit] ^ (t[hit].astype(np.int64).view(np.uint64) * np.uint64(_BASE)))
    return out


VECTOR_SCHEMA = "vid long, doc_id long, same string, total double, shared array<float>, bands array<long>, vector binary"


def _vectors(n_docs: int, n_buckets: int):
    def run(unit: int, data: bytes, replies: dict[int, bytes]) -> pa.Table:
        texts = block_texts(data)
        doc_ids = block_rows(data).column("doc_id").to_pylist() if "doc_id" in block_rows(data).column_names else [None] * len(texts)
        owner, key, count = shingles(texts)
        df = np.concatenate([np.frombuffer(zlib.decompress(replies[b]), "<u4") for b in sorted(replies)])
        df = df[np.unique(key, return_inverse=True)[1]].astype(np.float64)
        weight = count * (1.0 + np.log(n_docs / df) / math.log(n_docs + 1.0))
        total = np.bincount(owner, weights=weight, minlength=len(texts))
        shared = np.bincount(owner, weights=weight * (df > 1), minlength=len(texts))
        chosen = np.flatnonzero(shared >= SIMILARITY * total * (1 - 1e-9))
        bands, vectors, same, parts = ([None] * len(texts) for _ in range(4))
        if len(chosen):
            use = np.zeros(len(texts), bool)
            use[chosen] = True
            mine = use[owner]
            o = np.cumsum(use)[owner[mine]] - 1
            samples = weighted_samples(o, key[mine], weight[mine], BANDS * ROWS).reshape(BANDS, ROWS, -1)
            folded = np.zeros((BANDS, len(chosen)), np.uint64)
            for row in range(ROWS):
                folded = mix(folded * np.uint64(_BASE) + samples[:, row])
            kept = mine & (df > 1)
            edges = np.searchsorted(owner[kept], np.concatenate([chosen, [len(texts)]]))
            k, w = key[kept], weight[kept].astype("<f4")
            everything = np.searchsorted(owner, np.concatenate([chosen, [len(texts)]]))
            for n, doc in enumerate(chosen):
                part = slice(edges[n], edges[n + 1])
                vectors[doc] = planes(np.diff(k[part], prepend=np.uint64(0)), 7) + w[part].tobytes()
                bands[doc] = folded[:, n].view(np.int64).tolist()
                parts[doc] = np.bincount((k[part] % np.uint64(PARTS)).astype(np.int64), w[part], PARTS).astype(np.float32)
                low, high = everything[n], everything[n] + np.searchsorted(owner[everything[n]:], doc, "right")
                same[doc] = _digest(key[low:high], count[low:high])
        vid = unit * (1 << 20) + np.arange(len(texts))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.float32()), pa.list_(pa.int64()), pa.binary()]
        columns = [vid, doc_ids, same, total, parts, bands, vectors]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in VECTOR_SCHEMA.split(", ")])

    return run


def _digest(key: np.ndarray, count: np.ndarray) -> str:
    import hashlib

    return hashlib.md5(key.tobytes() + count.astype("<i8").tobytes()).hexdigest()


def weighted_jaccard(a: bytes, b: bytes, total_a: float, total_b: float) -> float:
    (ka, wa), (kb, wb) = (_unpack(v) for v in (a, b))
    at = np.minimum(np.searchsorted(kb, ka), max(0, len(kb) - 1))
    both = np.flatnonzero(kb[at] == ka) if len(kb) else np.zeros(0, int)
    least = float(np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64))
    return least / (total_a + total_b - least)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 11
    return np.cumsum(from_planes(data, n, 7), dtype=np.uint64), np.frombuffer(data, "<f4", n, 7 * n)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("v_a", "v_b", "t_a", "t_b")]
        near = [weighted_jaccard(*row) >= SIMILARITY - 1e-6 for row in zip(*columns)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))


def verified(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` at the similarity or above, each once. They are stored first: their size decides the joins."""
    pairs = cut_lineage(pairs.distinct(), "pairs")
    of_b = vectors.select(F.col("vid").alias("b"), F.col("vector").alias("v_b"), F.col("total").alias("t_b"))
    of_a = vectors.select(F.col("vid").alias("a"), F.col("vector").alias("v_a"), F.col("total").alias("t_a"))
    return pairs.join(of_b, "b").join(of_a, "a").mapInArrow(_verify, "a long, b long")


def possible(a: str, b: str) -> Column:
    """Whether two documents, structs of ``(vid, shared, total)``, can reach the similarity: in no class of shingles
    they have more in common than the smaller weight of shared ones."""
    least = F.zip_with(F.col(f"{a}.shared"), F.col(f"{b}.shared"), lambda x, y: F.least(x, y))
    common = F.aggregate(least, F.lit(0.0), lambda total, x: total + x.cast("double"))
    return common * (1 + SIMILARITY) >= (F.col(f"{a}.total") + F.col(f"{b}.total")) * (SIMILARITY * (1 - 1e-5))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as stars: every node and the smallest one it is connected to by them."""
    ends = [[batch.column(c).to_numpy() for c in ("u", "v")] for batch in batches]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate([u for u, _ in ends] + [v for _, v in ends]), return_inverse=True)
    u, v = at[:len(at) // 2], at[len(at) // 2:]
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    inner = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(nodes[root[inner]])], ["u", "v"])


def _tangled(edges: DataFrame) -> bool:
    """Whether some node points to two others, or to one that points on."""
    out = edges.select(F.col("u").alias("n"), F.lit(1).alias("points"), F.lit(0).alias("met"))
    into = edges.select(F.col("v").alias("n"), F.lit(0).alias("points"), F.lit(1).alias("met"))
    nodes = out.union(into).groupBy("n").agg(F.sum("points").alias("points"), F.max("met").alias("met"))
    return bool(nodes.agg(F.max((F.col("points") > 1) | ((F.col("points") > 0) & (F.col("met") > 0)))).first()[0])


def components(links: DataFrame, links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``.

    Each task first turns the links it holds into stars; large-star and small-star rounds of joins and minima then
    connect the stars of different tasks, until no node points to two others or to one that points on.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    n_tasks = max(1, math.ceil(edges.count() / links_per_task))
    edges = cut_lineage(edges.coalesce(n_tasks).mapInArrow(_forest, "u long, v long"), "forest")
    while _tangled(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "n"), F.col("u") == F.col("n")).select("v", "m")
        edges = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut_lineage(edges, "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _connected(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(node, root)`` over verified links that connect all that can be connected in the buckets ``(bucket, doc)``."""
    first = members.groupBy("bucket").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    shared = cut_lineage(members.join(first, "bucket").withColumn("vid", F.col("doc.vid")).withColumn("head_vid", F.col("head.vid")), "shared-buckets")

    def labels(roots: DataFrame) -> DataFrame:
        found = shared.join(roots.withColumnRenamed("node", "vid"), "vid", "left").withColumn("label", F.coalesce("root", "vid")).drop("root")
        heads = roots.select(F.col("node").alias("head_vid"), F.col("root").alias("head_root"))
        found = found.join(heads, "head_vid", "left").withColumn("head_label", F.coalesce("head_root", "head_vid")).drop("head_root")
        return cut_lineage(found, "labelled")

    # A document meets the smallest of its heads, then those of other components, then whatever they leave open.
    of_head = shared.where("vid <> head_vid").where(possible("doc", "head"))
    nearest = of_head.groupBy("vid").agg(F.min("head_vid").alias("a")).select("a", F.col("vid").alias("b"))
    nearest = cut_lineage(nearest, "nearest")
    links = cut_lineage(verified(nearest, vectors), "links")
    rest = labels(components(links)).where("label <> head_label").where(possible("doc", "head"))
    rest = rest.select(F.col("head_vid").alias("a"), F.col("vid").alias("b")).join(nearest, ["a", "b"], "left_anti")
    more = cut_lineage(verified(rest, vectors), "links")
    led, n_leaders = None, LEADERS
    while True:
        links = links.union(more)
        roots = components(links)
        labelled = labels(roots)
        open_ones = labelled.where("label <> head_label").select("bucket", "vid", "doc", "label")
        if led is not None:
            open_ones = open_ones.join(led, ["bucket", "vid"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("vid"))
        leaders = cut_lineage(open_ones.withColumn("n", rank).where(F.col("n") <= n_leaders).drop("n"), "leaders")
        if leaders.isEmpty():
            return roots
        others = labelled.select("bucket", F.col("vid").alias("b"), F.col("doc").alias("doc_b"), F.col("label").alias("label_b"))
        met = leaders.select(F.col("bucket").alias("in"), F.col("vid").alias("a"), "doc", "label").join(
            others, (F.col("in") == F.col("bucket")) & (F.col("label") != F.col("label_b")) & possible("doc", "doc_b"))
        more = cut_lineage(verified(met.select("a", "b"), vectors), "links")
        new = leaders.select("bucket", "vid")
        led, n_leaders = new if led is None else led.union(new), GROWTH * n_leaders


def classify(blocks: DataFrame) -> DataFrame:
    """``(vid, doc_id, root)`` of all documents of ``blocks``; ``root`` is the smallest vid of the class."""
    sums = blocks.agg(F.sum("n_rows").alias("n"), F.sum("n_bytes").alias("b")).first()
    n_docs, n_buckets = int(sums["n"] or 0), n_buckets_for(int(sums["b"] or 0) // 6)
    keys = blocks.mapInArrow(_emit_keys(n_buckets), KEY_SCHEMA)
    answers = ask_buckets(keys, _frequencies)
    vectors = cut_lineage(with_answers(blocks, answers, _vectors(n_docs, n_buckets), VECTOR_SCHEMA), "vectors")
    # Texts with the same shingles are one vertex.
    near = vectors.where(F.col("bands").isNotNull())
    copies = near.groupBy("same").agg(F.min("vid").alias("first_vid"))
    heads = copies.select(F.col("first_vid").alias("vid"))
    unique = cut_lineage(near.join(heads, "vid", "left_semi"), "unique-vectors")
    doc = F.struct("vid", "shared", "total").alias("doc")
    members = unique.select(doc, F.posexplode("bands").alias("band", "code")).select("doc", F.xxhash64("band", "code").alias("bucket"))
    roots = _connected(members, unique)
    of_copy = near.select("vid", "same").join(copies, "same").select("vid", "first_vid")
    classed = of_copy.join(roots, of_copy["first_vid"] == roots["node"], "left").select("vid", F.coalesce("root", "first_vid").alias("root"))
    return vectors.select("vid", "doc_id").join(classed, "vid", "left").withColumn("root", F.coalesce("root", "vid"))


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """One row per document: ``(doc_id, class_id, class_size)``."""
    found = cut_lineage(classify(store_blocks(docs.select("doc_id", "text"))), "classes")
    sizes = found.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    shared = sizes.where("class_size > 1")
    return found.join(shared, "root", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The first document of each class, with all columns of ``docs``."""
    blocks = store_blocks(docs)
    found = classify(blocks)
    dropped = found.where("vid <> root").groupBy(F.shiftright("vid", 20).alias("u_id")).agg(F.collect_list(F.expr("vid & 1048575")).alias("rows"))
    schema = docs.schema

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for data in left.column("data").to_pylist():
            rows = block_rows(data)
            mask = np.ones(rows.num_rows, bool)
            for gone in right.column("rows").to_pylist():
                mask[gone] = False
            parts.append(rows.filter(pa.array(mask)))
        return pa.concat_tables(parts)

    return blocks.select("unit", "data").groupBy("unit").cogroup(dropped.groupBy("u_id")).applyInArrow(keep, schema)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
