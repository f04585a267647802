"""Grading of an answer stream against a static source table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexspark.functions.encode import Encoder
from lexspark.operators.grading import quiz_round


def grade_stream(
    sources: DataFrame, answers: DataFrame, encoder: Encoder, target: str = "content", threshold: float = 0.8
) -> DataFrame:
    """Graded rows of ``answers``, a streaming frame ``(id, answer[, mandatory])``.

    A stream-static join followed by narrow scoring: no state is kept, so no watermark is needed
    and any output mode that appends rows works.
    """
    return quiz_round(sources, answers, encoder, target, threshold)
