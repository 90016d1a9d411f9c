"""Queries over stages around external work, with engines, workers and correctors whose answers follow from the identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.adapters import table
from marlstone.operators import stages
from marlstone.operators.durable import durable
from marlstone.operators.incremental import content_id
from marlstone.plans.registry import query


def save(df: DataFrame) -> DataFrame:
    return durable(df, "stage")


def spoken(rows: DataFrame) -> DataFrame:
    """An engine: two characters a second."""
    return rows.withColumn("seconds", F.length("text") / 2.0).withColumn("error", F.lit(None).cast("string"))


def moody(rows: DataFrame) -> DataFrame:
    """As `spoken`, but every second identifier fails."""
    return spoken(rows).withColumn("seconds", F.when(F.col("id") % 2 != 0, F.col("seconds"))).withColumn("error", F.when(F.col("id") % 2 == 0, "no voice"))


@query("""WITH j AS (SELECT doc_id, doc_id % 3 AS g, doc_id % 5 <= 1 AS fits, doc_id % 7 <> 0 AS other, doc_id % 3 = 2 AND doc_id % 2 = 0 AS mute, doc_id % 11 = 0 AS r FROM documents)
SELECT doc_id AS id, CASE WHEN r THEN 'f5tts' WHEN mute THEN CASE WHEN fits THEN 'f5tts' ELSE 'indextts2' END WHEN fits OR other THEN CASE g WHEN 0 THEN 'f5tts' WHEN 1 THEN 'indextts2' ELSE 'confucius4' END WHEN g = 0 THEN 'not ready: cosyvoice3' WHEN g = 1 THEN 'f5tts' ELSE 'indextts2' END AS model,
CASE WHEN r OR fits OR other AND NOT mute THEN 'success' ELSE 'failed' END AS status, CASE WHEN r THEN 0 WHEN mute THEN CASE WHEN fits THEN 1 ELSE 2 END WHEN fits OR other THEN 0 WHEN g = 2 THEN 2 ELSE 1 END AS fallbacks, r AS reused,
CASE WHEN r THEN 3 WHEN NOT fits AND other AND NOT mute THEN 18 ELSE 20 + doc_id % 5 * 5 END AS chars FROM j""")
def q104_router(spark: SparkSession, d: str) -> DataFrame:
    """Jobs through reuse, engines, other texts and other engines."""
    i = F.col("doc_id")
    said = F.repeat(F.lit("a"), (F.lit(20) + i % 5 * 5).cast("int"))
    options = F.when(i % 7 == 0, F.array(said)).otherwise(F.array(said, F.repeat(F.lit("x"), F.lit(10)), F.repeat(F.lit("z"), F.lit(18)), F.repeat(F.lit("y"), F.lit(60))))
    planned = F.when(i % 3 == 0, "f5tts").when(i % 3 == 1, "indextts2").otherwise("confucius4")
    jobs = table(spark, d, "documents").select(i.alias("id"), F.concat(F.lit("p"), i.cast("string")).alias("fingerprint"), said.alias("text"), options.alias("options"), planned.alias("planned"), F.lit(10.0).alias("target"))
    marked = F.when(F.col("id") % 11 == 0, F.col("fingerprint")).otherwise("changed")
    old = jobs.where("id % 11 <= 1").select("id", marked.alias("fingerprint"), F.lit("success").alias("status"), F.lit("f5tts").alias("model"), F.lit("old").alias("text"), F.lit(10.5).alias("seconds"))
    engines = {"f5tts": spoken, "indextts2": spoken, "confucius4": moody}
    done = stages.run_router(jobs, old, engines, lambda name: name != "cosyvoice3", save)
    return done.select("id", "model", "status", "fallbacks", "reused", F.length("text").alias("chars"))


@query("""SELECT doc_id AS id, 'success' AS status, CASE WHEN doc_id % 4 = 0 THEN 1.5 ELSE length(lang) / 2.0 END AS seconds FROM documents WHERE doc_id % 3 = 1""")
def q105_worker(spark: SparkSession, d: str) -> DataFrame:
    """One model's jobs in saved batches; earlier successes stand, failures are done again."""
    i = F.col("doc_id")
    jobs = table(spark, d, "documents").select(i.alias("id"), F.when(i % 3 == 1, "f5tts").otherwise("other").alias("model"), F.lit("p").alias("fingerprint"), F.col("lang").alias("text"))
    old = jobs.where("id % 4 <= 1").select("id", "fingerprint", F.when(F.col("id") % 4 == 0, "success").otherwise("failed").alias("status"), F.lit(1.5).alias("seconds"))
    return stages.run_worker(jobs, "f5tts", old, spoken, save).select("id", "status", "seconds")


@query("""SELECT CASE doc_id % 4 WHEN 0 THEN 'segment' WHEN 1 THEN 'checkpoint' ELSE 'pending' END AS source, CASE doc_id % 4 WHEN 0 THEN 'happy' WHEN 1 THEN 'sad' ELSE 'none' END AS emotion, count(*) AS n FROM documents GROUP BY ALL""")
def q106_three_ways(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose emotion stands in the segment, in a checkpoint of the same fingerprint, or nowhere."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("id"), F.lit("p").alias("fingerprint"), F.when(i % 4 == 0, "happy").alias("emotion"))
    kept = rows.select("id", F.when(F.col("id") % 4 == 2, "older").otherwise("p").alias("fingerprint"), F.when(F.col("id") % 4 != 3, "sad").alias("emotion"))
    whole, left = stages.three_ways(rows, kept, "emotion")
    pending = left.select(F.lit("pending").alias("source"), F.lit("none").alias("emotion"))
    return whole.select("source", "emotion").unionByName(pending).groupBy("source", "emotion").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new ' || lang END AS heard FROM documents""")
def q107_resume(spark: SparkSession, d: str) -> DataFrame:
    """Finished rows that are still wanted and the others as they are made, in order."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    done = rows.where("id % 2 = 0").select("id", F.lit("old").alias("heard")).unionByName(rows.select((-F.col("id") - 1).alias("id"), F.lit("gone").alias("heard")))
    return stages.resume(rows, done, "id", lambda x: x.withColumn("heard", F.concat(F.lit("new "), "lang")), ["id"]).select("id", "heard")


@query("""SELECT doc_id AS id, CASE WHEN lang = 'de' THEN 'own' ELSE 'translated' END AS translation FROM documents""")
def q108_same_language(spark: SparkSession, d: str) -> DataFrame:
    """Rows in the target language pass as they are."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.lit("own").alias("text"))
    passed, left = stages.pass_same_language(rows, F.col("lang"), F.lit("German"))
    return passed.select("id", "translation").unionByName(left.select("id", F.lit("translated").alias("translation")))


@query("""SELECT mode, corrected_text, reason, accepted, count(*) AS n FROM (SELECT v.mode, CASE WHEN v.mode IN ('frozen', 'batches') THEN lang || '!' ELSE lang END AS corrected_text, CASE v.mode WHEN 'frozen' THEN 'L002 ' || lang WHEN 'legacy' THEN 'failed: ValueError' WHEN 'batches' THEN 'answered' ELSE 'off' END AS reason, v.mode IN ('frozen', 'batches') AS accepted
FROM documents, (VALUES ('off'), ('legacy'), ('frozen'), ('batches')) AS v(mode)) GROUP BY ALL""")
def q109_correctors(spark: SparkSession, d: str) -> DataFrame:
    """Texts under four correctors, one of which fails and so keeps all."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("heard"), F.concat(F.lit("first\n"), "lang").alias("raw"))

    def legacy(x: DataFrame) -> DataFrame:
        raise ValueError("not there")

    def frozen(x: DataFrame) -> DataFrame:
        second = F.element_at("lines", 2)
        return x.select("id", F.concat(second["text"], F.lit("!")).alias("corrected_text"), F.lit(True).alias("accepted"), F.concat_ws(" ", second["line_id"], second["text"]).alias("reason"))

    made = {mode: stages.correct(rows, mode, {"legacy": legacy, "frozen": frozen}, save) for mode in ("off", "legacy", "frozen")}
    made["batches"] = stages.correct_in_batches(rows, 3, lambda x: x.select("id", F.concat("heard", F.lit("!")).alias("corrected_text")), save)
    out = None
    for mode, df in made.items():
        df = df.withColumn("mode", F.lit(mode))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("mode", "corrected_text", "reason", "accepted").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT problem, count(*) AS n FROM (SELECT CASE doc_id % 7 WHEN 0 THEN 'missing_id' WHEN 1 THEN 'unsupported_language' WHEN 2 THEN 'missing_text' WHEN 3 THEN 'broken_line' WHEN 4 THEN 'repeated_line_id' WHEN 5 THEN 'repeated_id' END AS problem FROM documents) WHERE problem IS NOT NULL GROUP BY problem""")
def q110_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests that must not go on, with the first problem of each."""
    i = F.col("doc_id")
    line = lambda a, b: F.struct(F.lit(a).alias("line_id"), F.lit(b).cast("string").alias("text"))
    lines = F.when(i % 7 == 3, F.array(line("L1", "x"), line("L2", None))).when(i % 7 == 4, F.array(line("L1", "x"), line("L1", "y"))).otherwise(F.array(line("L1", "x")))
    ident = F.when(i % 7 == 0, "").when(i % 7 == 5, "same").otherwise(i.cast("string"))
    rows = table(spark, d, "documents").select(ident.alias("id"), F.when(i % 7 == 1, "fr").otherwise("en").alias("source_language"), F.when(i % 7 != 2, "heard").alias("heard"), lines.alias("lines"))
    return stages.request_problems(rows).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 8 WHEN 0 THEN 'unknown_request' WHEN 1 THEN 'outside_text' WHEN 2 THEN 'other_text' WHEN 3 THEN 'no_lines' WHEN 4 THEN 'unknown_line' WHEN 5 THEN 'unknown_status' ELSE 'other_identifier' END AS problem FROM documents WHERE doc_id % 8 <> 7""")
def q111_inventories(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that don't fit their request."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", i.cast("string").alias("id"))
    asked = docs.where("doc_id % 8 <> 0").select("id", F.lit("the red hause").alias("heard"), F.array(F.struct(F.lit("L01").alias("line_id"), F.lit("the red house").alias("text"))).alias("lines"))
    given = docs.select(
        "doc_id", "id", F.lit(8).alias("start"), F.when(i % 8 == 1, 99).otherwise(13).alias("end"), F.when(i % 8 == 2, "horse").otherwise("hause").alias("original"), F.lit("house").alias("replacement"),
        F.when(i % 8 == 3, F.array().cast("array<string>")).when(i % 8 == 4, F.array(F.lit("L01"), F.lit("L09"))).otherwise(F.array(F.lit("L01"))).alias("lines"), F.when(i % 8 == 5, "odd").otherwise("classifiable").alias("status"),
    )
    given = given.withColumn("candidate_id", F.when(i % 8 == 6, "c_0").otherwise(content_id("c", "id", "start", "end", "replacement")))
    return stages.inventory_problems(asked, given.drop("doc_id")).select("id", "problem")
