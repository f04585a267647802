"""Sentence encoders: a user's model, or a deterministic model-free encoder of hashed tokens."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.text import WORD_PATTERN, Tokenizer, strip_accents, truncate_tokens, word_tokens
from lexspark.functions.vector import cosine

# Digests a task remembers, and texts turned into vectors at a time.
KNOWN_TOKENS, ENCODE_ROWS = 200_000, 1024


class Encoder(Protocol):
    """Maps a text column to an ``array<double>`` column."""

    name: str

    def __call__(self, text: Column) -> Column: ...

    def similarity(self, text: Column, embedding: Column) -> Column: ...

    def similarities(self, text: Column, embeddings: Column) -> Column: ...


class HashedTokenEncoder:
    """Signed feature hashing of tokens, then L2 normalisation.

    The md5 digest of a token gives its bucket (first 8 hex digits) and sign (9th digit). Tokens
    are cut in the JVM; digests of distinct tokens and the scatter-add into dense vectors run on
    Arrow batches, so encoding is narrow: no shuffle, whatever the corpus size.
    """

    def __init__(self, dim: int = 64, tokenizer: Tokenizer = word_tokens, max_tokens: int | None = None):
        self.dim, self.tokenizer, self.max_tokens = dim, tokenizer, max_tokens
        self.name = f"hashed-{dim}"

    def _signed_buckets(self, text: Column) -> Column:
        tokens = self._tokens(text)

        def signed(digest: Column) -> Column:
            bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % self.dim + 1
            odd = F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 1
            return F.when(odd, -bucket).otherwise(bucket).cast("int")

        return F.transform(F.transform(tokens, F.md5), signed)

    def _tokens(self, text: Column) -> Column:
        tokens = self.tokenizer(text)
        return tokens if self.max_tokens is None else truncate_tokens(tokens, self.max_tokens)

    def parts(self, words: Column) -> Column | None:
        """The tokens of each element of ``words`` in one array, a newline between elements; None if these are not encoded alone.

        Elements hold no newline. A text of elements joined by spaces then has the tokens of its elements.
        """
        if self.tokenizer is not word_tokens or self.max_tokens is not None:
            return None
        plain = strip_accents(F.lower(F.array_join(words, "\n")))
        return F.regexp_extract_all(plain, F.lit(f"{WORD_PATTERN}|\n"), F.lit(0))

    def vector_reader(self) -> Callable:
        """For use inside tasks: a function from an Arrow array of :meth:`parts` and the number of elements of each row.

        It gives ``vectors(low, high)``: the sums of signed buckets of elements ``low`` to ``high`` of all rows, as dense rows.
        """
        dim, read = self.dim, self.bucket_reader()

        def reader(parts, sizes):
            import numpy as np
            import pyarrow.compute as pc

            flat = parts.flatten()
            lengths = pc.fill_null(parts.value_lengths(), 0).to_numpy(zero_copy_only=False)
            first = np.cumsum(lengths) - lengths
            breaks = pc.equal(flat, "\n").to_numpy(zero_copy_only=False)
            passed = np.r_[0, np.cumsum(breaks)]
            inside = passed[:-1] - np.repeat(passed[first], lengths)
            element = np.repeat(np.cumsum(sizes) - sizes, lengths) + inside
            element, signed = element[~breaks], read(flat.filter(pc.invert(pc.equal(flat, "\n"))))

            def vectors(low, high):
                a, b = np.searchsorted(element, [low, high])
                cells = (element[a:b] - low) * dim + np.abs(signed[a:b]) - 1
                return np.bincount(cells, weights=np.sign(signed[a:b]), minlength=(high - low) * dim).reshape(high - low, dim)

            return vectors

        return reader

    def bucket_reader(self) -> Callable:
        """A function from an Arrow array of tokens to their signed buckets, for use inside tasks.

        It takes the digest of each distinct token of an array once, and remembers those of earlier arrays.
        """
        dim, most, known = self.dim, KNOWN_TOKENS, {}

        def digest(token):
            import hashlib

            digits = hashlib.md5(token.encode()).hexdigest()
            bucket = int(digits[:8], 16) % dim + 1
            return -bucket if int(digits[8], 16) % 2 else bucket

        def read(tokens):
            import numpy as np

            if len(tokens) == 0:
                return np.zeros(0, np.int64)
            coded = tokens.dictionary_encode()
            if len(known) > most:
                known.clear()
            words = coded.dictionary.to_pylist()
            values = [known.get(word) for word in words]
            for i, value in enumerate(values):
                if value is None:
                    values[i] = known[words[i]] = digest(words[i])
            return np.array(values, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

        return read

    def __call__(self, text: Column) -> Column:
        dim, most, read = self.dim, ENCODE_ROWS, self.bucket_reader()

        @F.arrow_udf("array<double>")
        def scatter(tokens):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            def units(part):
                n = len(part)
                lengths = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                flat = read(pc.list_flatten(part))
                cells = np.repeat(np.arange(n), lengths) * dim + np.abs(flat) - 1
                dense = np.bincount(cells, weights=np.sign(flat), minlength=n * dim).reshape(n, dim)
                norms = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
                return (dense / np.where(norms > 0, norms, 1.0)).ravel()

            dense = [units(tokens.slice(low, most)) for low in range(0, len(tokens), most)]
            offsets = pa.array(np.arange(len(tokens) + 1) * dim, type=pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(dense) if dense else np.zeros(0)))

        return F.when(text.isNotNull(), scatter(self._tokens(text)))

    def similarities(self, text: Column, embeddings: Column) -> Column:
        """Cosines of a *short* text to an array of unit vectors, from the buckets the text touches.

        Never builds the text's dense vector, so scoring many short phrases stays in the JVM.
        """

        def score(s: Column) -> Column:
            signed = s["signed"]

            def along(unit: Column) -> Column:
                return F.aggregate(
                    signed, F.lit(0.0), lambda acc, b: acc + F.signum(b) * F.get(unit, F.abs(b) - 1)
                )

            # |v|^2 sums, over token pairs that share a bucket, the product of their signs.
            square = F.aggregate(
                signed,
                F.lit(0.0),
                lambda acc, b: acc
                + F.aggregate(
                    signed,
                    F.lit(0.0),
                    lambda inner, c: inner + F.when(c == b, 1.0).when(c == -b, -1.0).otherwise(0.0),
                ),
            )
            norm = F.element_at(F.transform(F.array(square), lambda q: F.sqrt(q)), 1)
            return F.transform(
                F.array(F.struct(norm.alias("n"))),
                lambda m: F.transform(
                    s["units"], lambda u: F.when(m["n"] > 0, along(u) / m["n"]).otherwise(F.lit(0.0))
                ),
            )

        packed = F.array(
            F.struct(self._signed_buckets(text).alias("signed"), embeddings.alias("units"))
        )
        return F.element_at(F.element_at(F.transform(packed, score), 1), 1)

    def similarity(self, text: Column, embedding: Column) -> Column:
        return F.element_at(self.similarities(text, F.array(embedding)), 1)


class ModelEncoder:
    """A user's sentence model behind ``predict_batch_udf``.

    ``make_predict_fn`` is called once per Python worker, loads the model and returns a function
    from a NumPy array of strings to a 2-D NumPy array.
    """

    def __init__(self, name: str, make_predict_fn: Callable, batch_size: int = 64):
        self.name, self.make_predict_fn, self.batch_size = name, make_predict_fn, batch_size

    def __call__(self, text: Column) -> Column:
        from pyspark.ml.functions import predict_batch_udf
        from pyspark.sql.types import ArrayType, DoubleType

        predict = predict_batch_udf(
            self.make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=self.batch_size
        )
        return predict(text)

    def similarities(self, text: Column, embeddings: Column) -> Column:
        return F.transform(
            F.array(self(text)), lambda v: F.transform(embeddings, lambda e: cosine(v, e))
        ).getItem(0)

    def similarity(self, text: Column, embedding: Column) -> Column:
        return cosine(self(text), embedding)
