"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer.

Two deterministic machines are compiled. The first reads character classes and finds where pre-tokens begin; each
transition says whether one begins at this character or, one step late, at the one before. A text is cut into chunks,
every chunk's map from each possible entry state to its exit state is computed at once, and the maps compose through a
parallel prefix scan, which gives every chunk its true entry state. The second reads the bytes of a pre-token; its last
transition emits the number of tokens. It is built as pre-tokens appear, asking the library once for each, and holds a
bounded number of states; pre-tokens beyond it go through a bounded dictionary, so counts always equal the library's.

The classes of all code points are probed from the library's own pre-tokenizer, so they follow its Unicode tables.

Defined cases: a null text counts as empty and has no tokens; bytes that are no UTF-8 are read as U+FFFD; special strings
inside a text count as one token, the library's default; equal rows count alike; an empty table gives no rows; very long
texts are cut where a pre-token surely begins (at a space after a letter), which changes no count.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexspark.llm.common import table

TOKEN_LIMIT = 512
# Character classes of the pre-tokenizer, and its states (what the characters before leave open).
SPACE, WHITE, LETTER, STMD, R, V, L, E, NUMBER, OTHER, APOSTROPHE = range(11)
N_CLASSES = 11
DONE, LETTERS, NUMBERS, OTHERS, AFTER_SPACE, AFTER_WHITE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(10)
N_STATES = 16  # ten in use; a power of two for indexing
STATES_USED = 10
HERE, BEFORE = 1, 2  # what a transition emits: a pre-token begins at this character, at the one before

CHUNK = 64
PIECE_CHARS = 2_000_000
TRIE_STATES = 1 << 16
TRIE_DEPTH = 64
OVERFLOW_ENTRIES = 200_000


def _fresh(c: int) -> int:
    if LETTER <= c <= E:
        return LETTERS
    return {SPACE: AFTER_SPACE, WHITE: AFTER_WHITE, NUMBER: NUMBERS, OTHER: OTHERS, APOSTROPHE: QUOTE}[c]


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and emission for one character."""
    letter, other, white = LETTER <= c <= E, c in (OTHER, APOSTROPHE), c in (SPACE, WHITE)
    if state in (AFTER_SPACE, AFTER_WHITE):
        if white:
            return _fresh(c), 0
        if state == AFTER_WHITE:
            return _fresh(c), HERE | BEFORE
        return (OTHERS if other else _fresh(c)), BEFORE  # the space opens this pre-token
    if (state == LETTERS and letter) or (state == NUMBERS and c == NUMBER) or (state == OTHERS and other):
        return state, 0
    if state == QUOTE:
        if c == STMD:
            return DONE, 0
        if c in (R, V, L):
            return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
        if other:
            return OTHERS, 0
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if c == (L if state == QUOTE_L else E):
            return DONE, 0
        return (LETTERS, BEFORE) if letter else (_fresh(c), HERE | BEFORE)
    return _fresh(c), HERE


def compile_pretokenizer() -> tuple[np.ndarray, np.ndarray]:
    """Next states and emissions, indexed by class * N_STATES + state. The upper classes begin a new text."""
    follow = np.zeros((2 * N_CLASSES, N_STATES), np.uint8)
    emit = np.zeros((2 * N_CLASSES, N_STATES), np.uint8)
    for c in range(N_CLASSES):
        for s in range(STATES_USED):
            follow[c, s], emit[c, s] = _step(s, c)
            follow[N_CLASSES + c, s] = _fresh(c)
            emit[N_CLASSES + c, s] = HERE | (BEFORE if s in (QUOTE_R, QUOTE_V, QUOTE_L) else 0)
    return follow.ravel(), emit.ravel()


def probe_classes(tokenizer) -> np.ndarray:
    """Class of every code point, read off the library's pre-tokenizer: "A", the character, "1", the character, "."."""
    classes = np.full(0x110000, OTHER, np.uint8)
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    for low in range(0, 0x110000, 0x4000):
        codes = [c for c in range(low, low + 0x4000) if not 0xD800 <= c < 0xE000]
        if not codes:
            continue
        begins = np.zeros(5 * len(codes) + 1, bool)
        begins[[span[0] for _, span in split("".join(f"A{chr(c)}1{chr(c)}." for c in codes))]] = True
        unit = begins[:-1].reshape(-1, 5)
        found = np.where(~unit[:, 1], LETTER, np.where(~unit[:, 3], NUMBER, np.where(~unit[:, 4], OTHER, WHITE)))
        classes[codes] = found
    for text, c in ((" ", SPACE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), ("'", APOSTROPHE)):
        classes[[ord(x) for x in text]] = c
    return classes


class Transducers:
    """Both machines of one tokenizer, in one Python worker."""

    def __init__(self, path: str, classes: np.ndarray):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.classes = classes
        self.follow, self.emit = compile_pretokenizer()
        with open(path, encoding="utf-8") as file:
            special = [t["content"] for t in json.load(file)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.next = np.zeros(TRIE_STATES * 256, np.int32)  # 0: no transition
        self.tokens = np.full(TRIE_STATES, -1, np.int32)  # emitted by the transition that enters the state; -1: none yet
        self.used = 2  # state 0 is dead, 1 the root
        self.overflow: dict[bytes, int] = {}

    # -- first machine -------------------------------------------------------------------------------------------
    def boundaries(self, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Positions where pre-tokens begin in texts laid end to end; ``firsts``: where each text begins."""
        n = len(codes)
        symbols = self.classes[codes]
        symbols[firsts] += N_CLASSES
        width = -(-(n + 1) // CHUNK)
        grid = np.full(width * CHUNK, N_CLASSES, np.uint8)  # the padding begins a text, which closes the last one
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(width, CHUNK).T).astype(np.int16) * N_STATES
        maps = np.broadcast_to(np.arange(STATES_USED, dtype=np.uint8), (width, STATES_USED))
        for j in range(CHUNK):
            maps = self.follow[grid[j][:, None] + maps]
        entry = self._entry_states(maps)
        emitted = np.empty((CHUNK, width), np.uint8)
        for j in range(CHUNK):
            at = grid[j] + entry
            emitted[j] = self.emit[at]
            entry = self.follow[at]
        flat = np.ascontiguousarray(emitted.T).ravel()[: n + 1]
        begins = (flat[:-1] & HERE) | ((flat[1:] & BEFORE) >> 1)
        return np.flatnonzero(begins)

    @staticmethod
    def _entry_states(maps: np.ndarray) -> np.ndarray:
        """Inclusive prefix scan of state maps by doubling; then what state each chunk is entered in from DONE."""
        scanned, step = maps.copy(), 1
        while step < len(scanned):
            scanned[step:] = np.take_along_axis(scanned[step:], scanned[:-step], axis=1)
            step *= 2
        return np.concatenate([np.array([DONE], np.uint8), scanned[:-1, DONE]])

    # -- second machine ------------------------------------------------------------------------------------------
    def _walk(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of every pre-token, -1 where the machine does not know it."""
        order = np.argsort(-length.astype(np.int16), kind="stable")
        at, state = begin[order], np.ones(len(order), np.int32)
        left = len(order) - np.concatenate([[0], np.cumsum(np.bincount(length, minlength=1))])
        for j in range(int(length.max(initial=0))):
            k = int(left[j + 1])  # pre-tokens longer than j bytes
            state[:k] = self.next[(state[:k] << 8) + data[at[:k] + j]]
        found = np.empty(len(order), np.int32)
        found[order] = self.tokens[state]
        return found

    def _learn(self, word: bytes, tokens: int) -> None:
        if len(word) > TRIE_DEPTH or self.used + len(word) > TRIE_STATES:
            if len(self.overflow) >= OVERFLOW_ENTRIES:
                self.overflow.clear()
            self.overflow[word] = tokens
            return
        state = 1
        for byte in word:
            at = (state << 8) + byte
            if not self.next[at]:
                self.next[at] = self.used
                self.used += 1
            state = int(self.next[at])
        self.tokens[state] = tokens

    def pretoken_counts(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        short = np.where(length <= TRIE_DEPTH, length, 0)
        counts = self._walk(data, begin, short)
        missing = np.flatnonzero(counts < 0)
        if len(missing):
            raw = data.tobytes()
            found = [raw[b:b + n] for b, n in zip(begin[missing].tolist(), length[missing].tolist())]
            answers = {w: self.overflow[w] for w in set(found) if w in self.overflow}
            fresh = [w for w in set(found) if w not in answers]
            for low in range(0, len(fresh), 20_000):
                part = fresh[low:low + 20_000]
                encoded = self.library.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
                for word, tokens in zip(part, map(len, encoded)):
                    answers[word] = tokens
                    self._learn(word, tokens)
            counts[missing] = [answers[w] for w in found]
        return counts

    # -- texts ---------------------------------------------------------------------------------------------------
    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text."""
        totals = np.zeros(len(texts), np.int64)
        pieces, owner, size = [], [], 0
        for i, text in enumerate(texts):
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                totals[i] += len(parts) - 1
            for part in parts:
                for piece in self._pieces(part):
                    pieces.append(piece)
                    owner.append(i)
                    size += len(piece)
                    if size >= PIECE_CHARS:
                        self._add(totals, pieces, owner)
                        pieces, owner, size = [], [], 0
        self._add(totals, pieces, owner)
        return totals

    def _pieces(self, text: str) -> Iterator[str]:
        low = 0
        while len(text) - low > PIECE_CHARS:
            cut = low + PIECE_CHARS
            while cut < len(text) and not (text[cut] == " " and LETTER <= self.classes[ord(text[cut - 1])] <= E and self.classes[ord(text[cut - 2])] in (LETTER, STMD, R, V, L, E)):
                cut += 1
            yield text[low:cut]
            low = cut
        if low < len(text):
            yield text[low:]

    def _add(self, totals: np.ndarray, pieces: list[str], owner: list[int]) -> None:
        if not pieces:
            return
        joined = "".join(pieces)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        firsts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        begins = self.boundaries(codes, firsts[:-1])
        data = np.frombuffer(joined.encode(), np.uint8)
        ends_at = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)])
        at = ends_at[begins]
        counts = self.pretoken_counts(data, at, np.diff(np.append(at, len(data))))
        text_of = np.searchsorted(firsts, begins, side="right") - 1
        np.add.at(totals, np.asarray(owner), np.bincount(text_of, weights=counts, minlength=len(pieces)).astype(np.int64))


_LOADED: dict[str, Transducers] = {}
_PROBED: dict[str, bytes] = {}


class TokenCounter:
    """Counts tokens per row; the class table is the only thing shipped with a task (some kilobytes)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        before = described["pre_tokenizer"] or {}
        if described["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
            raise ValueError("a byte-level tokenizer with its own pattern, without normalizer or prefix space, is needed")
        self.path = path
        if path not in _PROBED:
            _PROBED[path] = zlib.compress(probe_classes(Tokenizer.from_file(path)).tobytes())
        self.packed = _PROBED[path]

    def transducers(self) -> Transducers:
        if self.path not in _LOADED:
            _LOADED[self.path] = Transducers(self.path, np.frombuffer(zlib.decompress(self.packed), np.uint8))
        return _LOADED[self.path]

    def annotate(self, rows: DataFrame) -> DataFrame:
        """``(doc_id, n_bytes, n_tokens)`` of rows ``(doc_id, text)``."""
        counter = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines = counter.transducers()
            for batch in batches:
                raw = [b or b"" for b in batch.column("text").cast(pa.binary()).to_pylist()]
                tokens = machines.count([b.decode("utf-8", "replace") for b in raw])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(tokens, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

        return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op5_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    counter = TokenCounter(path or public_tokenizers.path("byte_bpe_50k.json"))
    counted = counter.annotate(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", counted.n_tokens > TOKEN_LIMIT)
