"""Forward index: one row per document with its term counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.materialize import cut_lineage
from lexspark.functions.text import Tokenizer, term_counts


def forward_index(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id") -> DataFrame:
    """``(key, dl, counts)`` of every text, tokenised once and stored.

    Building it is narrow. It is stored because every consumer reads the corpus several times
    (frequencies, norms, scores) and tokenising is the costly part.
    """
    tokens = docs.select(key, tokenizer(F.coalesce(F.col("text"), F.lit(""))).alias("tokens"))
    counted = tokens.select(key, F.size("tokens").alias("dl"), term_counts(F.col("tokens")).alias("counts"))
    return cut_lineage(counted, "forward")
