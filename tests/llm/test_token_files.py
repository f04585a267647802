"""Token files on odd texts and odd tables against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexspark.llm import token_files

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
BITS = (
    "'s 'T 're l'l <|endoftext|> <| |> İ ſ ß É ª ² ½ × ÷ ́ e E Z 9 don't --'s !! « Ǆ 中 ŉ ­ Ÿ ​ abc the \x00x K Å ﬁ Σ ς".split(" ")
    + [" ", "\n", "\t", "\x0b", "\x85", "\xa0", "\x1c", "\r\n", ""]
)


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def test_odd_texts_equal_the_library(library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(8000)]
    texts += [f"{chr(c)}a b{chr(c)}" for c in range(0x3000)]
    encoder = token_files.PieceEncoder(PATH)
    assert encoder.by_piece
    ids, ends = encoder.encode(texts)
    begin = 0
    for text, end in zip(texts, ends.tolist()):
        assert ids[begin:end].tolist() == library.encode(text, add_special_tokens=False).ids + [token_files.END_ID], repr(text)
        begin = end


def test_a_full_table_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 5)
    encoder = token_files.PieceEncoder(PATH)
    for texts in (["one two three four", "five six"], ["seven one two", "", "x" * 100]):
        ids, ends = encoder.encode(texts)
        want = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
    assert len(encoder.index) <= token_files.CACHED_WORDS


def test_words_that_share_a_place_of_the_table(library):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdéz9'-", k=rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(900)] + ["\x7f", "a\x7fb", "n'est", "it's,"]
    encoder = token_files.PieceEncoder(PATH)
    encoder.table = token_files.WordTable(4)
    for _ in range(6):
        texts = [" ".join(rng.choices(words, k=200)) for _ in range(8)]
        ids, ends = encoder.encode(texts)
        want = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
    assert np.count_nonzero(encoder.table.numbers) > 8


def test_another_configuration_takes_whole_texts():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, plain = token_files.PieceEncoder(path), Tokenizer.from_file(path)
    text = "Two  blanks,\nand a line; Straße"
    assert not encoder.by_piece
    assert encoder.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids + [2]


def test_nulls_ties_repeats_long_texts_and_empty_tables(spark, library, tmp_path):
    schema = "doc_id long, text string, part int, shard string"
    rows = [(5, "tie one", 1, "x"), (5, "tie two", 1, "x"), (3, None, 1, None), (None, "no id", 1, "x"), (4, "", 1, "x"), (9, "again", 1, "x"),
            (9, "again", 1, "x"), (7, "many words " * 60_000, 1, "x"), (-2, "before", 1, "x")]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/some/documents.parquet")
    got = sorted(token_files.op3_token_files(spark, f"{tmp_path}/some").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, -2, 3, 4, 5, 5, 7, 9, 9]
    start = 0
    for r in got:
        encoded = [library.encode(t or "", add_special_tokens=False).ids + [2] for d, t, *_ in rows if d == r["doc_id"]]
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in encoded]
        assert r["start"] == start
        start += r["n_tokens"]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert token_files.op3_token_files(spark, f"{tmp_path}/none").collect() == []


def test_random_access():
    rng = np.random.default_rng(3)
    unit = rng.integers(0, 40, 30).astype(np.uint32)
    parts = [np.concatenate([np.resize(unit, n), rng.integers(0, 50, 5).astype(np.uint32), [2]]).astype(np.uint32) for n in rng.integers(0, 400, 60)]
    ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    data = token_files.pack_shard(list(range(60)), ids, ends, 64)
    shard = token_files.Shard(data)
    assert len(shard.sequence) < len(ids) / 2 and len(data) < 4 * len(ids)
    for i, part in enumerate(parts):
        assert shard.document(i).tolist() == part.tolist()
        assert [shard.token(i, k) for k in range(0, len(part), 7)] == part[::7].tolist()
