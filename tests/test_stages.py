"""Stages around external work when something breaks."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import alignment, stages
from marlstone.operators.durable import durable


def save(df):
    return durable(df, "test-stage")


def jobs(spark, rows):
    return spark.createDataFrame(rows, "id long, fingerprint string, text string, options array<string>, planned string, target double")


def spoken(rows):
    return rows.withColumn("seconds", F.length("text") / 2.0).withColumn("error", F.lit(None).cast("string"))


def test_a_planned_engine_must_be_ready(spark):
    df = jobs(spark, [(1, "a", "x" * 20, [], "f5tts", 10.0)])
    none = spark.createDataFrame([], "id long, fingerprint string, status string, model string, text string, seconds double")
    with pytest.raises(RuntimeError, match="f5tts"):
        stages.run_router(df, none, {"f5tts": spoken}, lambda name: False, save)
    assert stages.run_router(df.limit(0), none, {"f5tts": spoken}, lambda name: False, save).count() == 0


def test_broken_engines_fail_their_rows_only(spark):
    def broken(rows):
        raise OSError("no device")

    df = jobs(spark, [(1, "a", "x" * 20, [], "f5tts", 10.0), (2, "b", "x" * 20, [], "indextts2", 10.0), (3, "c", "x" * 20, [], "nothing", 10.0), (4, "d", "x" * 90, [], "f5tts", 10.0)])
    got = {r["id"]: (r["status"], r["quality"], r["error"]) for r in stages.execute(df.withColumn("model", F.col("planned")), {"f5tts": spoken, "indextts2": broken}).collect()}
    assert got[1] == ("success", "passed", None) and got[2] == ("failed", None, "OSError: no device") and got[3] == ("failed", None, "no engine nothing")
    assert got[4][:2] == ("failed", "failed") and got[4][2].startswith("duration 45")


def test_retries_by_other_texts_then_other_engines(spark):
    none = spark.createDataFrame([], "id long, fingerprint string, status string, model string, text string, seconds double")

    def silent(rows):
        return spoken(rows).withColumn("seconds", F.lit(None).cast("double")).withColumn("error", F.lit("silent"))

    df = jobs(spark, [(1, "a", "x" * 60, ["x" * 60, "y" * 22, "z" * 2], "confucius4", 10.0), (2, "b", "x" * 20, [], "indextts2", 10.0), (3, "c", None, None, "f5tts", 10.0)])
    engines = {"confucius4": spoken, "f5tts": silent, "indextts2": silent, "cosyvoice3": spoken}
    got = {r["id"]: r for r in stages.run_router(df, none, engines, lambda name: True, save, chains={"indextts2": ["f5tts", "cosyvoice3"], "f5tts": ["cosyvoice3"]}).collect()}
    assert (got[1]["text"], got[1]["status"], got[1]["fallbacks"]) == ("y" * 22, "success", 0)
    assert (got[2]["model"], got[2]["status"], got[2]["fallbacks"], got[2]["tried_engines"]) == ("cosyvoice3", "success", 2, ["indextts2", "f5tts", "cosyvoice3"])
    assert (got[3]["status"], got[3]["model"]) == ("failed", "cosyvoice3")


def test_a_broken_batch_of_a_worker(spark):
    calls = []

    def work(rows):
        calls.append(1)
        if len(calls) == 2:
            raise ValueError("worker gone\nat line 3")
        return spoken(rows)

    rows = spark.createDataFrame([(i, "m", "p", "ab") for i in range(40)], "id long, model string, fingerprint string, text string")
    none = spark.createDataFrame([], "id long, fingerprint string, status string, seconds double")
    got = stages.run_worker(rows, "m", none, work, save, batches=4).collect()
    bad = [r for r in got if r["status"] == "failed"]
    assert len(got) == 40 and 0 < len(bad) < 40 and {r["error"] for r in bad} == {"ValueError: worker gone"}


def test_correctors_keep_all_on_failure(spark):
    rows = spark.createDataFrame([(i, f"t{i}", "raw") for i in range(20)], "id long, heard string, raw string")
    with pytest.raises(ValueError, match="unknown mode"):
        stages.correct(rows, "other", {}, save)

    def late(x):
        return x.select("id", F.raise_error(F.lit("boom")).cast("string").alias("corrected_text"), F.lit(True).alias("accepted"), F.lit("r").alias("reason"))

    got = stages.correct(rows, "late", {"late": late}, save).collect()
    assert len(got) == 20 and all(r["corrected_text"] == f"t{r['id']}" and not r["accepted"] and r["reason"].startswith("failed") for r in got)
    short = lambda x: x.where("id <> 7").select("id", F.upper("heard").alias("corrected_text"))
    got = {r["id"]: r for r in stages.correct_in_batches(rows, 4, short, save).collect()}
    assert len(got) == 20 and got[7]["corrected_text"] == "t7" and got[7]["reason"] == "batch failed: ValueError"
    assert {r["reason"] for r in got.values()} == {"answered", "batch failed: ValueError"}
    double = lambda x: x.select("id", "heard").unionByName(x).select("id", F.col("heard").alias("corrected_text"))
    assert {r["reason"] for r in stages.correct_in_batches(rows, 2, double, save).collect()} == {"batch failed: ValueError"}


def test_sanitised_regions(spark):
    kind = "id string, source_language string, place int, line_id string, text string"
    df = spark.createDataFrame([("a", "en", 0, "L1", "Hi(1,2),(3,4)  you  (5,6),(7,8) tail"), ("a", "en", 1, "L2", "Hi"), ("b", "zh", 0, "L1", "字(1,2),(3,4)"), ("b", "zh", 1, "L2", "")], kind)
    got = [(r["id"], r["line_id"], r["text"], r["bbox"], r["status"]) for r in alignment.sanitize(df).orderBy("id", "line_id").collect()]
    assert got == [("a", "L1S01", "Hi", [1, 2, 3, 4], "kept"), ("a", "L1S02", "you", [5, 6, 7, 8], "kept"), ("a", "L1S03", "tail", None, "kept"), ("a", "L2S01", "Hi", None, "dropped_exact_duplicate"), ("b", "L1S01", "字", [1, 2, 3, 4], "kept"), ("b", "L2S01", "", None, "dropped_non_content")]
    with pytest.raises(Exception, match="unsupported source language"):
        alignment.sanitize(spark.createDataFrame([("a", "fr", 0, "L1", "x")], kind)).collect()
