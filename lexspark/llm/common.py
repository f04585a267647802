"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def hash_fraction(*parts: Column) -> Column:
    """A number in [0, 1) drawn from 52 bits of an MD5 over ``parts``; nulls count as a text of their own."""
    seed = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\u0000null")) for p in parts])
    return F.conv(F.substring(F.md5(seed), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def release_memory() -> None:
    """Give memory that a finished block no longer needs back to the system: workers wait for tasks beside a full heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)
