"""Token ids in binary shards compressed by Re-Pair.

Documents are range-partitioned and sorted by id, encoded with the tokenizers library, and cut into shards of about
``SHARD_TOKENS`` ids. In every shard the most frequent pairs of neighbouring ids are replaced by nonterminals, never across
a document's end: in ``ROUNDS`` rounds, each of which replaces up to ``PAIRS_PER_ROUND`` pairs seen ``MIN_COUNT`` times or more
at once, where one pair at a time until none repeats would need a pass for each. That stops within a few symbols in a
thousand of the fixed point of these rounds. A shard stores its rules with the length each expands to, the remaining
sequence, and where every document ends in it, so one document, or one id of it, is decoded without the rest.

The format of a shard, little-endian: the magic ``RPAIR1``, one byte for the width of a sequence symbol (2 or 4) and one
of padding; uint32 counts of terminals (T), rules (R), symbols (S) and documents (D); R pairs of uint32; R uint32
expansion lengths; S symbols, of which T + i stands for rule i; D uint32 ends of the documents among the symbols;
D int64 document ids; D bytes that are 1 where the id is null. Shards are rows of a Parquet table that Spark writes.

The library's model encodes every word of a text once and a bounded table keeps its ids (``PieceEncoder``).

Defined cases: a null text is an empty one and consists of the end id; null document ids come first; rows with the same
id follow the hash of their text; an empty table has no shards; other columns are ignored; a very long text is one
document of one shard, whatever its length.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.materialize import new_table_path
from lexspark.llm.common import table

MAGIC = b"RPAIR1"
END_ID = 2
SHARD_TOKENS = 3 << 19
ROUNDS = 5
MIN_COUNT = 8
PAIRS_PER_ROUND = 4096
HASH_BITS = 20
BATCH_CHARS = 500_000
CACHED_WORDS, CACHED_CHARS = 1_000_000, 12_000_000
TABLE_BITS = 19
# Kinds of bytes: 0 blanks, 1 ASCII letters and digits, 2 ASCII punctuation but for the apostrophe, 3 all others.
_KINDS = np.array([0 if c <= 32 else 3 if c >= 127 or c == 39 else 1 if chr(c).isalnum() else 2 for c in range(256)], np.uint8)

# The configuration that pieces are cut for, its pattern over lower-case Latin letters, and the texts for which
# that is the same: printable characters up to U+017F, but for the no-break space, I with a dot, and control characters.
KNOWN = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
PLAIN = re.compile(r"[\t\n\r\x20-~\u00a1-\u012f\u0131-\u017f]*")
_LETTERS, _NUMBERS = r"a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PIECE = re.compile(rf"[{_LETTERS}]+|[{_NUMBERS}]|'s|'t|'re|'ve|'m|'ll|'d|[^\t\n\r\x20{_LETTERS}{_NUMBERS}]+")
BLANKS = re.compile(r"[ \t\n\r]")
# The word that stands for the end of a text: plain texts hold no control character.
END = b"\x7f"


class Numbers(dict):
    """Numbers its keys as they come; ``taken`` gives the keys numbered since the last call, in order."""

    def __init__(self, start: dict):
        super().__init__(start)
        self.new: list = []

    def __missing__(self, key):
        self.new.append(key)
        number = self[key] = len(self)
        return number

    def taken(self) -> list:
        new, self.new = self.new, []
        return new


def cut_words(array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of plain lower-case UTF-8 text begin and end, which has blanks around it.

    Words are cut at blanks, and where a letter or an ASCII digit meets ASCII punctuation other than the apostrophe: no
    match of the pattern goes on there.
    """
    kind = _KINDS[array]
    # Letters of two bytes: all but the signs for multiplication and division, from U+00C0.
    lead = np.flatnonzero(array >= 0xC3)
    second = array[lead + 1]
    letter = lead[(array[lead] != 0xC3) | ((second != 0x97) & (second != 0xB7))]
    kind[letter] = kind[letter + 1] = 1
    left, right = kind[:-1], kind[1:]
    at = np.flatnonzero((left != right) & ((left == 0) | (right == 0) | (left * right == 2)))
    return at[right[at] > 0] + 1, at[left[at] > 0] + 1


class WordTable:
    """Numbers of words of up to ``2 * 8`` bytes, for whole arrays of words at once.

    A word is its own key, two integers of eight bytes each, so what is found is exact. Each word has one place; a word that
    takes it puts out the one before, which is then unknown here until it is put again.
    """

    MOST = 16
    _MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self, bits: int = TABLE_BITS):
        self.shift = np.uint64(64 - bits)
        self.keys, self.numbers = np.zeros((1 << bits, 2), np.uint64), np.zeros(1 << bits, np.int64)

    def keys_of(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keys of the words at ``begins`` of ``data``, which goes on for ``MOST`` bytes after the last of them."""
        keys = np.lib.stride_tricks.sliding_window_view(data, self.MOST)[begins].view("<u8")
        keys[:, 0] &= self._MASKS[np.minimum(sizes, 8)]
        keys[:, 1] &= self._MASKS[np.clip(sizes - 8, 0, 8)]
        return keys

    def _places(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words, and which of them are known."""
        places = self._places(keys)
        held = self.keys[places]
        return self.numbers[places], (held[:, 0] == keys[:, 0]) & (held[:, 1] == keys[:, 1])

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        # Two words of one call may share a place: one writer is chosen, so that its key and number stay together.
        places, last = np.unique(self._places(keys)[::-1], return_index=True)
        last = len(keys) - 1 - last
        self.keys[places], self.numbers[places] = keys[last], numbers[last]


class PieceEncoder:
    """Ids of texts by way of their words, in one Python worker.

    With the configuration ``KNOWN`` the library lower-cases a text and runs its model on every match of a pattern, none of
    which spans a blank. Both are done here for texts of ``PLAIN`` characters only, where Python and the library agree on
    letters and case. Words between blanks are cut and looked up as arrays; only a word not in the array table goes through
    the dictionary, and the model sees the pieces of a word once as long as the bounded dictionary has room; a batch that
    would overfill it is forgotten. Chunks between blanks of any other text go through the library, which drops white space,
    so no token spans a blank. Another configuration takes whole texts.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        # Two bytes make a character from U+0080 to U+07FF: the library says what the model wants to see for either.
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        seen = {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xA1, 0x180))}
        self.shown = {b: m for c, both in seen.items() for b, m in zip(c.encode(), both)}
        described = json.loads(self.library.to_str())
        self.by_piece = (described["normalizer"], described["pre_tokenizer"]) == KNOWN and described["model"].get("dropout") is None
        special = sorted({t["content"][:2] for t in described["added_tokens"]})
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.terminals = max(self.library.get_vocab_size(with_added_tokens=True), end_id + 1)
        # Keys are words of plain texts as bytes, and strings for the library.
        self.index = Numbers({END: 0})
        self.chars = 0
        self.table = WordTable()
        self.lengths = np.zeros(1 << 16, np.int64)
        self.offsets = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.flat[0], self.lengths[0], self.used = end_id, 1, 1

    def _plain_numbers(self, texts: list[str], known: int) -> np.ndarray:
        """Numbers of the words of plain lower-case texts, 0 after each text; those below ``known`` are stored already."""
        data = ("\n" + "".join(f"{text}\n{END.decode()}\n" for text in texts)).encode()
        array = np.frombuffer(data + bytes(WordTable.MOST), np.uint8)
        begins, ends = cut_words(array)
        sizes = ends - begins
        keys = self.table.keys_of(array, begins, sizes)
        numbers, hit = self.table.find(keys)
        missed = np.flatnonzero(~hit | (sizes > WordTable.MOST))
        words = [data[a:b] for a, b in zip(begins[missed].tolist(), ends[missed].tolist())]
        numbers[missed] = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        # A word comes into the table when a second batch has it: most words of a large corpus occur once.
        again = missed[(numbers[missed] < known) & (sizes[missed] <= WordTable.MOST)]
        self.table.put(keys[again], numbers[again])
        return numbers

    def _numbers(self, texts: list[str]) -> np.ndarray:
        known, found, plain = len(self.index), [], []
        for text in texts:
            if self.by_piece and PLAIN.fullmatch(text) and not self.special.search(text):
                plain.append(text.lower())
                continue
            if plain:
                found.append(self._plain_numbers(plain, known))
                plain = []
            chunks = [*(BLANKS.split(text) if self.by_piece else [text]), END]
            found.append(np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks)))
        if plain:
            found.append(self._plain_numbers(plain, known))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _model_ids(self, piece: str) -> list[int]:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
        return [token.id for token in self.model.tokenize(shown)]

    def _store(self, words: list[bytes | str], first: int) -> None:
        sizes, encoded = np.zeros(len(words), np.int64), []
        tokenize = self.model.tokenize
        for i, word in enumerate(words):
            before = len(encoded)
            if isinstance(word, str):
                encoded += self.library.encode(word, add_special_tokens=False).ids
            elif word.isalpha():
                encoded += [token.id for token in tokenize(word.decode())]
            elif len(pieces := PIECE.findall(word.decode())) == 1:
                encoded += self._model_ids(pieces[0])
            else:
                for piece in pieces:
                    stored = self.index.get(piece.encode(), first)
                    if stored < first:
                        begin = self.offsets[stored]
                        encoded += self.flat[begin:begin + self.lengths[stored]].tolist()
                    else:
                        encoded += self._model_ids(piece)
            sizes[i] = len(encoded) - before
        total = int(sizes.sum())
        while first + len(words) > len(self.lengths):
            self.lengths, self.offsets = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.offsets))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.lengths[first:first + len(words)] = sizes
        self.offsets[first:first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used:self.used + total] = encoded
        self.used += total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with an end id after each text, and where each text ends."""
        mark, known = self.used, len(self.index)
        found = self._numbers(texts)
        unknown = self.index.taken()
        chars = sum(map(len, unknown))
        if unknown:
            self._store(unknown, known)
        sizes = self.lengths[found]
        upto = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.offsets[found] - upto + sizes, sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]
        if len(self.index) > CACHED_WORDS or self.chars + chars > CACHED_CHARS:
            for word in unknown:
                del self.index[word]
            self.used = mark
        else:
            self.chars += chars
        return ids, upto[found == 0]


def leading_keys(which: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` slots one key, and which of the entries have the key of their slot.

    It is the key of the slot's last entry, or of the last that differs from it, whichever occurs more often: nearly always
    the slot's most frequent one, found without a sort. What it misses is left to the next round.
    """
    first = np.zeros(n, np.uint64)
    first[which] = keys
    same = keys == first[which]
    rest = np.flatnonzero(~same)
    second = first.copy()
    second[which[rest]] = keys[rest]
    again = rest[keys[rest] == second[which[rest]]]
    better = np.bincount(which[again], minlength=n) > np.bincount(which[same], minlength=n)
    first[better] = second[better]
    return first, keys == first[which]


def repair(ids: np.ndarray, ends: np.ndarray, terminals: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules, expansion lengths, remaining sequence, and document ends in it."""
    sequence = ids.astype(np.uint32)
    stops = np.unique(ends[ends > 0])  # one past the last symbol of each document
    rules, lengths, n_rules = [], np.ones(terminals, np.uint32), 0
    for _ in range(rounds):
        if len(sequence) < 2 * MIN_COUNT:
            break
        left, right = sequence[:-1], sequence[1:]
        bins = left * np.uint32(0x9E3779B1)
        bins ^= right * np.uint32(0x85EBCA77)
        bins >>= np.uint32(32 - HASH_BITS)
        bins[stops[:-1] - 1] = 0  # a pair never spans two documents; bin 0 is left to them
        counts = np.bincount(bins, minlength=1 << HASH_BITS)
        counts[0] = 0
        frequent = np.flatnonzero(counts >= MIN_COUNT)
        if len(frequent) > PAIRS_PER_ROUND:
            least = int(np.partition(counts[frequent], -PAIRS_PER_ROUND)[-PAIRS_PER_ROUND])
            frequent = frequent[counts[frequent] >= least]
        slots = np.full(1 << HASH_BITS, -1, np.int32)
        slots[frequent] = np.arange(len(frequent))
        which = slots[bins]
        at = np.flatnonzero(which >= 0)
        which = which[at]
        keys = left[at].astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= right[at]
        pairs, same = leading_keys(which, keys, len(frequent))
        often = same & (np.bincount(which[same], minlength=len(frequent)) >= MIN_COUNT)[which]
        at, which = at[often], which[often]
        if not len(at):
            break
        # Of overlapping pairs every second one is replaced, counted from the left.
        begin = np.where(np.diff(at, prepend=-2) != 1, at, 0)
        taken = (at - np.maximum.accumulate(begin)) & 1 == 0
        at, which = at[taken], which[taken]
        used = np.bincount(which, minlength=len(pairs)) >= 2
        number = np.cumsum(used) - 1
        twice = used[which]
        at, which = at[twice], number[which[twice]]
        pairs = pairs[used]
        if not len(at):
            break
        pair = np.stack([(pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)], axis=1)
        rules.append(pair)
        lengths = np.concatenate([lengths, lengths[pair].sum(axis=1, dtype=np.uint32)])
        sequence[at] = terminals + n_rules + which
        n_rules += len(pair)
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        sequence = sequence[keep]
        stops = stops - np.searchsorted(at, stops - 1)
    new_ends = np.zeros(len(ends), np.int64)
    new_ends[ends > 0] = stops[np.searchsorted(np.unique(ends[ends > 0]), ends[ends > 0])]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), lengths[terminals:], sequence, new_ends


def pack_shard(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, terminals: int) -> bytes:
    rules, lengths, sequence, new_ends = repair(ids, ends, terminals)
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    return b"".join([
        MAGIC, struct.pack("<BxIIII", width, terminals, len(rules), len(sequence), len(doc_ids)), rules.astype("<u4").tobytes(),
        lengths.astype("<u4").tobytes(), sequence.astype(f"<u{width}").tobytes(), new_ends.astype("<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
    ])


class Shard:
    """Random access to a packed shard."""

    def __init__(self, data: bytes):
        if data[:6] != MAGIC:
            raise ValueError("not a shard")
        width, self.terminals, n_rules, n_symbols, n_docs = struct.unpack_from("<BxIIII", data, 6)
        at = 6 + struct.calcsize("<BxIIII")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(self.terminals, np.uint32), take("<u4", n_rules)])
        self.sequence, self.ends = take(f"<u{width}", n_symbols), take("<u4", n_docs)
        doc_ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if x else d for d, x in zip(doc_ids.tolist(), null.tolist())]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.uint32)
        while len(compound := np.flatnonzero(symbols >= self.terminals)):
            sizes = np.ones(len(symbols), np.int64)
            sizes[compound] = 2
            starts = np.cumsum(sizes) - sizes
            wider = np.repeat(symbols, sizes)
            pair = self.rules[symbols[compound] - self.terminals]
            wider[starts[compound]], wider[starts[compound] + 1] = pair[:, 0], pair[:, 1]
            symbols = wider
        return symbols

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        return self._expand(self.sequence[self.ends[i - 1] if i else 0:self.ends[i]])

    def token(self, i: int, k: int) -> int:
        """Id k of the i-th document: expansion lengths lead to the one symbol that holds it, and down its rules."""
        symbols = self.sequence[self.ends[i - 1] if i else 0:self.ends[i]]
        upto = np.cumsum(self.lengths[symbols])
        at = int(np.searchsorted(upto, k, side="right"))
        symbol, k = int(symbols[at]), k - int(upto[at - 1] if at else 0)
        while symbol >= self.terminals:
            a, b = map(int, self.rules[symbol - self.terminals])
            symbol, k = (a, k) if k < self.lengths[a] else (b, k - int(self.lengths[a]))
        return symbol

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Every rule is expanded once, then each symbol copies its stretch of ids."""
        lengths = self.lengths.astype(np.int64)
        flat = np.concatenate([np.arange(self.terminals, dtype=np.uint32), self._expand(np.arange(self.terminals, len(lengths), dtype=np.uint32))])
        sizes = lengths[self.sequence]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat((np.cumsum(lengths) - lengths)[self.sequence] - upto[:-1], sizes) + np.arange(upto[-1])]
        low = 0
        for doc_id, high in zip(self.doc_ids, upto[self.ends].tolist()):
            yield doc_id, ids[low:high]
            low = high


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}
SHARD_SCHEMA = "part int, shard int, before long, n_tokens long, n_docs long, data binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` in ascending order of ``doc_id`` into a table of shards under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, end_id) not in _ENCODERS:
            _ENCODERS[tokenizer, end_id] = PieceEncoder(tokenizer, end_id)
        encoder = _ENCODERS[tokenizer, end_id]
        part, shard, before = 0, 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, before, held
            doc_ids = [d for x in held for d in x[0]]
            ids = np.concatenate([x[1] for x in held])
            shift = np.cumsum([0] + [len(x[1]) for x in held])
            ends = np.concatenate([x[2] + s for x, s in zip(held, shift)])
            row = [part, shard, before, len(ids), len(doc_ids), pack_shard(doc_ids, ids, ends, encoder.terminals)]
            shard, before, held = shard + 1, before + len(ids), []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["part", "shard", "before", "n_tokens", "n_docs", "data"])

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            doc_ids = batch.column("doc_id").to_pylist()
            texts = [(b or b"").decode("utf-8", "replace") for b in batch.column("text").cast(pa.binary()).to_pylist()]
            low = 0
            while low < len(texts):
                high, chars = low, 0
                while high < len(texts) and chars < BATCH_CHARS:
                    chars += len(texts[high])
                    high += 1
                held.append((doc_ids[low:high], *encoder.encode(texts[low:high])))
                low = high
                if sum(len(x[1]) for x in held) >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, SHARD_SCHEMA).write.mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the shards."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # One row per range partition: its first id comes after those of the partitions before it.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = shards.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("start"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                rows = []
                for doc_id, ids in Shard(data.as_py()).documents():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = new_table_path(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, path)
