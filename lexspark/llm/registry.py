"""Queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lexspark.llm import (
    chat, decontaminate, mixing, neardup, periodicity, quality, secrets, sharding, suffixes, token_files, transducer, trie, warc,
)

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _shipped(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Let Python workers import this package from where the driver found it, whatever folder they start in."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
        if ROOT not in known.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
        return run(spark, sf_dir)

    return call


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_chat": chat.op1_chat,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_token_files": token_files.op3_token_files,
    "op4_mixing": mixing.op4_mixing,
    "op5_token_counts": transducer.op5_token_counts,
    "op6_sharding": sharding.op6_sharding,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_warc": warc.op9_warc,
    "op10_quality": quality.op10_quality,
    "op11_periodic_runs": periodicity.op11_periodic_runs,
    "op12_secret_scan": secrets.op12_secret_scan,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
QUERIES = {name: _shipped(run) for name, run in QUERIES.items()}
ORACLES = {
    "op1_chat": chat.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_quality": quality.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
