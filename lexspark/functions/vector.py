"""Dense-vector expressions on array columns, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def l2_norm(v: Column) -> Column:
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def l2_normalize(v: Column) -> Column:
    """Unit-length vector; a zero vector stays zero."""
    scaled = F.transform(
        F.array(F.struct(v.alias("v"), l2_norm(v).alias("n"))),
        lambda s: F.transform(
            s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(F.lit(0.0))
        ),
    )
    return F.element_at(scaled, 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector is zero."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))
