"""Grading of free-text answers by similarity and mandatory tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.encode import Encoder
from lexspark.functions.text import WHITESPACE
from lexspark.functions.vector import cosine, dot
from lexspark.operators.records import sample_records

SIM_DIGITS = 6


def pair_similarity(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Add ``cosine`` and ``dot`` of two vector columns."""
    a, b = F.col(left), F.col(right)
    return pairs.withColumns(
        {"cosine": F.round(cosine(a, b), SIM_DIGITS), "dot": F.round(dot(a, b), SIM_DIGITS)}
    )


def grade(pairs: DataFrame, encoder: Encoder, threshold: float = 0.8) -> DataFrame:
    """Grade ``(reference, answer[, mandatory])``: adds ``is_correct``, ``cosine`` and ``dot``.

    Correct means cosine at or above ``threshold`` and every mandatory token among the answer's
    whitespace tokens (case-sensitive); a null or empty list asks for nothing. Narrow: it runs
    unchanged on a stream.
    """
    encoded = pairs.withColumns(
        {"_ref": encoder(F.col("reference")), "_ans": encoder(F.col("answer"))}
    )
    scored = pair_similarity(encoded, "_ref", "_ans").drop("_ref", "_ans")
    correct = F.col("cosine") >= threshold
    if "mandatory" in pairs.columns:
        missing = F.array_except("mandatory", F.split("answer", WHITESPACE))
        correct = correct & (F.coalesce(F.size(missing), F.lit(0)) <= 0)
    return scored.withColumn("is_correct", F.coalesce(correct, F.lit(False)))


def quiz_round(
    sources: DataFrame,
    answers: DataFrame,
    encoder: Encoder,
    target: str = "content",
    threshold: float = 0.8,
    n_questions: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Grade ``answers(id, answer[, mandatory])`` against the ``content`` or the ``id`` of sources.

    ``n_questions`` draws that many sources at random; None asks all.
    """
    if target not in ("content", "id"):
        raise ValueError("target must be 'content' or 'id'")
    asked = sources if n_questions is None else sample_records(sources, n_questions, seed)
    questions = asked.select("id", F.col(target).alias("reference"))
    return grade(answers.join(questions, "id"), encoder, threshold)


def answers_to_review(graded: DataFrame) -> DataFrame:
    """Wrong answers as candidates ``(text, foreign_id)`` for the alternative-answer table."""
    return graded.where(~F.col("is_correct")).select(
        F.col("answer").alias("text"), F.col("id").alias("foreign_id")
    )
