"""Array to rows.

The outer generators are used, with the empty rows filtered after, because the optimiser adds a
``size(array) > 0`` filter under a plain generator. That filter would repeat the array's whole
expression, and for array expressions over other computed arrays repeat it once per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array: Column | str, name: str) -> DataFrame:
    """``keep`` columns and one row per array element."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def unnest_with_position(df: DataFrame, keep: list, array: Column | str, position: str, name: str) -> DataFrame:
    """Like :func:`unnest`, with the element's position from 0."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    return rows.where(F.col(position).isNotNull())


def unnest_structs(df: DataFrame, keep: list, array: Column | str) -> DataFrame:
    """``keep`` columns and the fields of each struct of the array."""
    rows = df.select(*keep, F.explode_outer(array).alias("_item")).where(F.col("_item").isNotNull())
    return rows.select(*rows.columns[:-1], "_item.*")
