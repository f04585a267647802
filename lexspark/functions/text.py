"""Text and token expressions. Every function maps Columns to Columns and stays inside the JVM."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.stopwords import FRENCH_STOPWORDS

Tokenizer = Callable[[Column], Column]

# Whitespace as Unicode defines it, spelled out because regex dialects differ.
_SPACES = (
    r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WHITESPACE = f"[{_SPACES}]+"
# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
WORDPUNCT_PATTERN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACES}]+"


def normalize_word(word: str) -> str:
    """Trim, lower-case and strip accents of a literal, used to prepare stopword lists."""
    return _without_marks(word.strip().lower())


def _without_marks(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text)
    return "".join(c for c in decomposed if not unicodedata.combining(c))


# Hangul syllables decompose by arithmetic: fixed values of the Unicode standard.
_HANGUL, _LEAD, _VOWEL, _TRAIL, _N_VOWELS, _N_TRAILS = 0xAC00, 0x1100, 0x1161, 0x11A7, 21, 28
_HANGUL_LAST = 0xD7A3
# A character of no text, put in place of those that become several others.
_SEVERAL = "\uffff"


@functools.cache
def _accent_levels() -> list[tuple[str, str]]:
    """For j = 1, 2, …: the characters that become at least j others (the first level: that change), and their j-th.

    Combining marks stand at the end of the first level: ``translate`` deletes characters beyond the replacement.
    """
    changed = {}
    for code in (*range(0x80, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
        char = chr(code)
        if (unicodedata.decomposition(char) or unicodedata.combining(char)) and (plain := _without_marks(char)) != char:
            changed[char] = plain
    marks = "".join(c for c, plain in changed.items() if not plain)
    levels = []
    while rest := {c: plain for c, plain in changed.items() if len(plain) > len(levels)}:
        levels.append(("".join(rest), "".join(plain[len(levels)] for plain in rest.values())))
    return [(levels[0][0] + marks, levels[0][1]), *levels[1:]]


def _code_point(offset: Column, first: int) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(offset + first), 4, "0")), "UTF-16BE")


def strip_accents(text: Column) -> Column:
    """Compatibility-decompose (NFKD) and drop combining marks, for every character of Unicode; stays in the JVM.

    Most texts hold characters only that become one character or none, which is one ``translate``. Others are taken
    apart into characters, and what a character becomes is put together position by position.
    """
    first, *further = _accent_levels()
    several = further[0][0] + "".join(map(chr, range(_HANGUL, _HANGUL_LAST + 1)))
    # The marks to delete stay last, beyond the replacement; the first rule for a character holds.
    quick = F.translate(text, several + first[0], _SEVERAL * len(several) + first[1])

    def whole(c: Column) -> Column:
        more = [F.when(F.instr(F.lit(source), c) > 0, F.translate(c, source, target)).otherwise("") for source, target in further]
        index = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int") - _HANGUL
        trail = index % _N_TRAILS
        syllable = F.concat(
            _code_point((index / (_N_VOWELS * _N_TRAILS)).cast("int"), _LEAD), _code_point((index / _N_TRAILS).cast("int") % _N_VOWELS, _VOWEL),
            F.when(trail > 0, _code_point(trail, _TRAIL)).otherwise(""),
        )
        return F.when(c.between(chr(_HANGUL), chr(_HANGUL_LAST)), syllable).otherwise(F.concat(F.translate(c, *first), *more))

    taken_apart = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), whole), "")
    return F.when(F.instr(quick, F.lit(_SEVERAL)) > 0, taken_apart).otherwise(quick)


def normalize_text(text: Column) -> Column:
    """Trim, lower-case and strip accents."""
    trimmed = F.regexp_replace(text, f"^{WHITESPACE}|{WHITESPACE}$", "")
    return strip_accents(F.lower(trimmed))


NORMALIZED_STOPWORDS: tuple[str, ...] = tuple(dict.fromkeys(map(normalize_word, FRENCH_STOPWORDS)))


def remove_stopwords(tokens: Column, stopwords: Iterable[str] = FRENCH_STOPWORDS) -> Column:
    """Drop tokens found in ``stopwords``; order and repeats of the others are kept."""
    words = list(stopwords)
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(words))


def bm25_tokens(text: Column, stopwords: Iterable[str] = FRENCH_STOPWORDS) -> Column:
    """Lower-cased whitespace tokens, ASCII punctuation stripped at both ends, no stopwords."""
    words = list(stopwords)
    stripped = F.transform(
        F.split(F.lower(text), WHITESPACE), lambda t: F.btrim(t, F.lit(PUNCTUATION))
    )
    return F.filter(stripped, lambda t: (t != "") & ~t.isin(words) if words else t != "")


def word_tokens(text: Column) -> Column:
    """Words of two or more word characters, lower-cased, accents stripped."""
    return F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(WORD_PATTERN), F.lit(0))


def word_only_tokens(text: Column) -> Column:
    """Words of two or more word characters, lower-cased, accents kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def wordpunct_tokens(text: Column) -> Column:
    """Runs of word characters and runs of punctuation, in reading order, case kept."""
    return F.regexp_extract_all(text, F.lit(WORDPUNCT_PATTERN), F.lit(0))


def truncate_tokens(tokens: Column, max_tokens: int = 128) -> Column:
    """The first ``max_tokens`` tokens, the input bound of an encoder."""
    return F.slice(tokens, 1, max_tokens)


def flatten_newlines(text: Column) -> Column:
    """Newlines become spaces, for one-line display."""
    return F.translate(text, "\n", " ")


def token_windows(tokens: Column, window: int, offset: int = 1, drop_empty: bool = False) -> Column:
    """Sliding windows over a token array, with the trailing remainder as last window.

    The remainder may be empty; ``drop_empty`` removes empty windows. An offset above the
    window skips tokens. ``offset`` must be positive, else no window sequence would end.
    """
    if window < 1 or offset < 1:
        raise ValueError("window and offset must be at least 1")
    # Bound as a lambda variable so the token array is built once, not once per window.
    def windows_of(bound: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(bound) - window) / F.lit(offset)).cast("int")) + 1

        def one(j: Column) -> Column:
            width = F.least(F.lit(window), F.size(bound) - j * offset)
            # get() reads one element; slice() would copy the whole array for every window.
            return F.when(
                width > 0,
                F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda x: F.get(bound, j * offset + x)),
            ).otherwise(F.slice(bound, 1, 0))

        return F.transform(F.sequence(F.lit(0), last), one)

    chunks = F.element_at(F.transform(F.array(tokens), windows_of), 1)
    return F.filter(chunks, lambda c: F.size(c) > 0) if drop_empty else chunks


def paragraphs(text: Column) -> Column:
    """Non-empty paragraphs, separated by one or more newlines."""
    return F.filter(F.split(text, "\n+"), lambda p: F.btrim(p) != "")


def paragraph_windows(text: Column, n_paragraphs: int = 1, offset: int = 1) -> Column:
    """Sliding windows of ``n_paragraphs`` paragraphs."""
    return token_windows(paragraphs(text), n_paragraphs, offset, drop_empty=True)


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of one token array, without a shuffle.

    Sorted tokens are cut where the value changes, so a document's postings are known inside
    its own row and cost no exchange on (document, term).
    """

    def starts_of(words: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(words) - 1),
            lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)),
        )

    def runs(pair: Column) -> Column:
        words, starts = pair["words"], pair["starts"]
        return F.transform(
            starts,
            lambda p, j: F.struct(
                F.get(words, p).alias("term"),
                (F.coalesce(F.get(starts, j + 1), F.size(words)) - p).alias("tf"),
            ),
        )

    bound = F.transform(
        F.array(F.sort_array(tokens)),
        lambda w: F.struct(w.alias("words"), starts_of(w).alias("starts")),
    )
    empty = F.array().cast("array<struct<term:string,tf:int>>")
    counted = F.element_at(F.transform(bound, runs), 1)
    return F.when(F.size(tokens) > 0, counted).otherwise(empty)


def ngrams(tokens: Column, n_min: int, n_max: int) -> Column:
    """All n-grams of ``n_min``..``n_max`` tokens as arrays."""

    def of_size(bound: Column, n: int) -> Column:
        count = F.size(bound) - (n - 1)
        return F.when(
            count > 0,
            F.transform(
                F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
                lambda i: F.array(*[F.get(bound, i + j) for j in range(n)]),
            ),
        ).otherwise(F.array().cast("array<array<string>>"))

    return F.element_at(
        F.transform(
            F.array(tokens), lambda b: F.concat(*[of_size(b, n) for n in range(n_min, n_max + 1)])
        ),
        1,
    )
