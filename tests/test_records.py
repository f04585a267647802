"""Record tables, embedding cache, grading in batch and on a stream."""

from pyspark.sql import functions as F

from lexspark.functions.encode import HashedTokenEncoder
from lexspark.operators import grading
from lexspark.sources import tables
from lexspark.streaming.grading import grade_stream

ENCODER = HashedTokenEncoder()


def test_append_answers(spark, tmp_path):
    path = str(tmp_path / "answers")
    spark.createDataFrame([("a", "1")], "text string, foreign_id string").write.parquet(path)
    batch = spark.createDataFrame([("a", "2"), ("b", "3"), ("b", "2"), ("b", "2"), ("c", None)], "text string, foreign_id string")
    rejected = tables.append_answers(spark, path, batch)
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == sorted([("a", "1"), ("b", "2"), ("c", None)], key=str)
    assert {tuple(r) for r in rejected.collect()} == {("a", "2", 1), ("b", "2", 1), ("b", "3", 1)}


def test_scan_pushes_the_filter(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = spark.createDataFrame([("1", "x", None, 0), ("2", None, "r", 0)], "id string, content string, raw_text string, level int")
    tables.write_records(rows, path)
    scanned = tables.read_records(spark, path)
    assert [r.id for r in scanned.collect()] == ["1"]
    assert "IsNotNull(content)" in scanned._jdf.queryExecution().executedPlan().toString()


def test_embedding_cache_encodes_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "cache")
    first = spark.createDataFrame([("chat",), ("chien",), ("chat",)], "text string")
    assert tables.refresh_embedding_cache(spark, path, first, ENCODER).count() == 2
    more = spark.createDataFrame([("chat",), ("oiseau",)], "text string")
    missing = tables.texts_to_encode(more, tables.refresh_embedding_cache(spark, path, first, ENCODER), ENCODER.name)
    assert [r.text for r in missing.collect()] == ["oiseau"]
    assert tables.refresh_embedding_cache(spark, path, more, ENCODER).count() == 3


ANSWERS = [
    ("1", "le juge administratif", ["juge"]), ("2", "le juge administratif", ["absent"]), ("3", "le juge administratif", []),
    ("4", "le juge administratif", None), ("5", "tout autre chose", None), ("6", "", ["juge"]),
]


def expected():
    return {"1": True, "2": False, "3": True, "4": True, "5": False, "6": False}


def frames(spark):
    sources = spark.createDataFrame([(str(i), "le juge administratif") for i in range(1, 7)], "id string, content string")
    return sources, spark.createDataFrame(ANSWERS, "id string, answer string, mandatory array<string>")


def test_grading(spark):
    sources, answers = frames(spark)
    graded = grading.quiz_round(sources, answers, ENCODER)
    assert {r.id: r.is_correct for r in graded.collect()} == expected()
    assert {r.foreign_id for r in grading.answers_to_review(graded).collect()} == {"2", "5", "6"}
    assert grading.quiz_round(sources, answers, ENCODER, n_questions=2, seed=3).count() == 2


def test_grading_a_stream(spark, tmp_path):
    sources, answers = frames(spark)
    inbox = str(tmp_path / "inbox")
    answers.write.parquet(inbox)
    stream = spark.readStream.schema(answers.schema).parquet(inbox)
    query = (
        grade_stream(sources, stream, ENCODER).select("id", "is_correct").writeStream.format("memory")
        .queryName("graded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert {r.id: r.is_correct for r in spark.table("graded").collect()} == expected()
