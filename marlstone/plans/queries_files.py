"""Queries over files: stage tables, results, JSON, CSV, RTTM, listings. Each writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.adapters import LINE, SPAN, lines, spans, table
from marlstone.functions import text, unicode
from marlstone.operators import incremental
from marlstone.operators.durable import new_path
from marlstone.plans.registry import query
from marlstone.sources import readers, writers


@query("""SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, 'none' AS missing, count(*) AS saved, CAST(2 * sum(n_chars) AS BIGINT) AS twice FROM documents""")
def q67_stage_files(spark: SparkSession, d: str) -> DataFrame:
    """A stage's table replaced as a whole, and a JSON document with a key that it lacks."""
    root, docs = new_path(spark, "stages"), table(spark, d, "documents").select("doc_id", "n_chars")
    writers.save_stage(docs, root, "asr")
    writers.save_stage(docs.withColumn("n_chars", F.col("n_chars") * 2), root, "asr")
    docs.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"))).alias("value")).write.text(f"{root}/state")
    state = readers.json_document(spark, f"{root}/state", "n long, total long, missing string")
    return state.crossJoin(spark.read.parquet(f"{root}/asr").agg(F.count(F.lit(1)).alias("saved"), F.sum("n_chars").alias("twice"))).withColumn("missing", F.coalesce("missing", F.lit("none")))


@query("""SELECT CAST(item_id AS VARCHAR) AS segment_id, length(text) AS n FROM benchmark UNION ALL SELECT 'm' || item_id, length(text) FROM benchmark""")
def q68_result_forms(spark: SparkSession, d: str) -> DataFrame:
    """Results that come as a list of rows and as a map by id."""
    path, items = new_path(spark, "results"), table(spark, d, "benchmark").select("item_id", F.length("text").alias("n"))
    items.agg(F.to_json(F.collect_list(F.struct(F.col("item_id").alias("segment_id"), "n"))).alias("value")).write.text(path)
    named = F.struct(F.concat(F.lit("m"), F.col("item_id").cast("string")).alias("key"), F.struct("n").alias("value"))
    items.agg(F.to_json(F.map_from_entries(F.collect_list(named))).alias("value")).write.mode("append").text(path)
    return readers.results(spark, path, "n:long")


@query("""SELECT candidates, selections, count(*) AS n FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS candidates, CASE doc_id % 3 WHEN 0 THEN 2 ELSE 0 END AS selections FROM documents) GROUP BY ALL""")
def q69_checkpoint_maps(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints of two maps, some without one of them and some broken."""
    i = F.col("doc_id")
    kept = F.when(i % 3 == 0, '{"candidates":{"a":"1"},"selections":{"b":"x","c":"y"}}').when(i % 3 == 1, '{"candidates":{"a":"1","b":"2"}}').otherwise("broken{")
    got = table(spark, d, "documents").select(readers.checkpoint_maps(kept).alias("m"))
    return got.groupBy(F.size("m.candidates").alias("candidates"), F.size("m.selections").alias("selections")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, n_chars, lang FROM documents""")
def q70_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines written in two appends and read strictly."""
    path, docs = new_path(spark, "lines"), table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    writers.append_json(docs.where("doc_id % 3 = 0"), path)
    writers.append_json(docs.where("doc_id % 3 <> 0"), path)
    return readers.json_lines(spark, path, docs.schema)


@query("""SELECT lang, CAST(doc_id AS VARCHAR) AS doc_id, 'a "' || source || '", b' AS quoted, '' AS missing FROM documents""")
def q71_csv_strings(spark: SparkSession, d: str) -> DataFrame:
    """Named columns in order with a header, quoted values, and a field that rows lack."""
    path = new_path(spark, "csv")
    rows = table(spark, d, "documents").select("doc_id", "lang", F.concat(F.lit('a "'), "source", F.lit('", b')).alias("quoted"), F.lit(1).alias("left_out"))
    writers.save_csv(rows, path, ["lang", "doc_id", "quoted", "missing"])
    return readers.csv_strings(spark, path).withColumn("missing", F.coalesce("missing", F.lit("")))


ALIASED = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE 'u' || (doc_id % 50) END AS utt, 'd' || (doc_id % 20) AS key2, CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' ' || lang || ' ' END AS language, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS final FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 3 <> 0"


@query(f"""WITH a AS ({ALIASED}), n AS (SELECT doc_id, coalesce(nullif(trim(utt), ''), key2) AS id, coalesce(nullif(trim(language), ''), 'auto') AS language, coalesce(nullif(trim(final), ''), '') AS text FROM a)
SELECT id, language, text FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) = 1""")
def q72_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Fields under one of several names, with defaults; the last row of a key wins."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").where("doc_id % 11 <> 0 OR doc_id % 3 <> 0").select(
        "doc_id",
        F.when(i % 3 == 0, " ").otherwise(F.concat(F.lit("u"), (i % 50).cast("string"))).alias("utt"),
        F.concat(F.lit("d"), (i % 20).cast("string")).alias("key2"),
        F.when(i % 2 == 0, "").otherwise(F.concat(F.lit(" "), "lang", F.lit(" "))).alias("language"),
        F.when(i % 5 == 0, F.lit(None)).otherwise(F.col("source")).alias("final"),
    )
    return readers.aliased(rows, {"id": ["utterance", "utt", "key2"], "language": ["language"], "text": ["final", "text"]}, "id", {"language": "auto"}, "doc_id").select("id", "language", "text")


@query(f"""WITH {SPAN} SELECT start_ms, end_ms, speaker FROM span WHERE pos % 4 <> 0""")
def q73_rttm(spark: SparkSession, d: str) -> DataFrame:
    """Speaker lines of RTTM files; short lines and other kinds go."""
    path, s = new_path(spark, "rttm"), spans(table(spark, d, "events"))
    line = F.format_string("%s m 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.when(F.col("pos") % 8 == 0, "LEXEME").otherwise("SPEAKER"), F.col("start_ms") / 1000, (F.col("end_ms") - F.col("start_ms")) / 1000, F.col("speaker"))
    s.select(F.when(F.col("pos") % 8 == 4, F.lit("SPEAKER m 1 2.0")).otherwise(line).alias("value")).write.text(path)
    return readers.rttm(spark, path).select("start_ms", "end_ms", "speaker")


@query(f"""WITH {LINE} SELECT CASE WHEN regexp_matches(line, '(?i)^the\\b') OR regexp_matches(line, '(?i)tion\\.$') THEN 'external_watermark_pattern' ELSE '' END AS reason, count(*) AS n FROM line GROUP BY reason""")
def q74_watermarks(spark: SparkSession, d: str) -> DataFrame:
    """Lines that one of a file's patterns finds."""
    path = new_path(spark, "patterns")
    spark.createDataFrame([("# comment",), ("",), (r"^the\b",), (r"tion\.$",)], "value string").coalesce(1).write.text(path)
    reason = text.watermark_reason(F.col("line"), readers.pattern_lines(spark, path))
    return lines(table(spark, d, "pages")).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS "Pty", lower(substr(n_name, 1, 2)) AS "Language", n_name AS "VoiceName" FROM nation WHERE n_name NOT LIKE '% %'""")
def q75_voices(spark: SparkSession, d: str) -> DataFrame:
    """A listing in columns with a header and blank lines."""
    rows = table(spark, d, "nation").where("n_name NOT LIKE '% %'")
    listed = rows.select(F.concat_ws("   ", F.lit(" "), F.col("n_nationkey").cast("string"), F.lower(F.substring("n_name", 1, 2)), "n_name").alias("value"))
    head = spark.createDataFrame([("Pty Language VoiceName",), ("  ",)], "value string")
    return readers.columns_table(head.unionByName(listed), ["Pty", "Language", "VoiceName"])


@query("""SELECT CASE WHEN doc_id % 4 = 3 THEN '' ELSE lang END AS language, count(*) AS n, CAST(sum(CASE WHEN doc_id % 4 = 3 THEN 0 ELSE length(source) END) AS BIGINT) AS letters, CAST(sum(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END) AS BIGINT) AS stamps,
round(sum(CASE doc_id % 4 WHEN 0 THEN doc_id % 10 + 1.5 WHEN 1 THEN doc_id % 10 WHEN 2 THEN 0.123 ELSE 0 END), 3) AS starts FROM documents GROUP BY 1""")
def q76_recognition(spark: SparkSession, d: str) -> DataFrame:
    """Recognisers' replies whose stamps go by two names, as a list or in items, and broken ones."""
    i = F.col("doc_id")
    head = F.concat(F.lit('{"text":"'), "source", F.lit('","language":"'), "lang", F.lit('",'))
    at = (i % 10).cast("string")
    reply = (
        F.when(i % 4 == 0, F.concat(head, F.lit('"time_stamps":[{"text":"a","start":'), at, F.lit(',"end":2},{"text":"b","start":1.5,"end":2}]}')))
        .when(i % 4 == 1, F.concat(head, F.lit('"timestamps":[{"text":"a","start":'), at, F.lit(',"end":2}]}')))
        .when(i % 4 == 2, F.concat(head, F.lit('"time_stamps":{"items":[{"text":"a","start":0.12345,"end":2}]}}')))
        .otherwise("not json")
    )
    r = table(spark, d, "documents").select(readers.recognition(reply).alias("r"))
    starts = F.aggregate(F.transform("r.stamps", lambda s: s["start"]), F.lit(0.0), lambda a, x: a + x)
    return r.groupBy(F.col("r.language").alias("language")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("r.text")).alias("letters"), F.sum(F.size("r.stamps")).alias("stamps"), F.round(F.sum(starts), 3).alias("starts"))


@query("""SELECT doc_id FROM documents WHERE doc_id % 4 = 0""")
def q77_resume(spark: SparkSession, d: str) -> DataFrame:
    """Earlier rows whose every frame succeeded."""
    i = F.col("doc_id")
    frames = F.when(i % 4 == 0, '[{"timestamp":1.0,"text":"a"},{"timestamp":2.0,"text":"","error":""}]').when(i % 4 == 1, '[{"timestamp":1.0,"text":"a"},{"timestamp":2.0,"error":"late"}]').when(i % 4 == 2, "[]").otherwise("broken")
    return readers.complete_rows(table(spark, d, "documents").select("doc_id", frames.alias("frames_json"))).select("doc_id")


@query("""SELECT 'a' || (doc_id % 9) AS id, arg_max('p' || doc_id, doc_id) AS proposal FROM documents GROUP BY ALL
UNION ALL SELECT 'b' || (doc_id % 4), arg_max('q' || doc_id, doc_id) FROM documents GROUP BY ALL UNION ALL SELECT 'c' || doc_id, 'r' || doc_id FROM documents WHERE doc_id % 2 = 0""")
def q78_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposals of nested responses and retries, the last of an id wins."""
    said = lambda letter, n, mark: F.struct(F.concat(F.lit(letter), n.cast("string")).alias("id"), F.concat(F.lit(mark), F.col("doc_id").cast("string")).alias("proposal"))
    i = F.col("doc_id")
    kind = "array<struct<id:string,proposal:string>>"
    rows = table(spark, d, "documents").select(i.alias("pos"), F.array(said("a", i % 9, "p"), said("b", i % 4, "q")).alias("rows"), F.when(i % 2 == 0, F.array(said("c", i, "r"))).cast(kind).alias("retries"))
    return readers.proposals(rows, strict=False)


@query("""SELECT canon, count(*) AS n FROM (SELECT CASE doc_id % 6 WHEN 0 THEN '{"a":[1,2.5],"b":{"c":null}}' WHEN 3 THEN '"é"' WHEN 5 THEN '[]' ELSE 'refused' END AS canon FROM documents) GROUP BY canon""")
def q79_strict_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON in canonical form; repeated keys, NaN and broken texts are refused."""
    i = F.col("doc_id")
    said = F.when(i % 6 == 0, '{ "b": {"c": null}, "a": [1, 2.5] }').when(i % 6 == 1, '{"a":1,"a":2}').when(i % 6 == 2, '{"a":NaN}').when(i % 6 == 3, '"\\u00e9"').when(i % 6 == 4, "[1, 2").otherwise(" [ ] ")
    rows = table(spark, d, "documents").select(unicode.strict_json(said).alias("canon"))
    return rows.groupBy(F.coalesce("canon", F.lit("refused")).alias("canon")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'asr' AS stage, count(*) AS rows FROM documents""")
def q80_stale_stages(spark: SparkSession, d: str) -> DataFrame:
    """Stages left after what depends on a changed one was dropped."""
    root, docs = new_path(spark, "stages"), table(spark, d, "documents").select("doc_id")
    for stage in ("asr", "ocr", "translation", "speech"):
        writers.save_stage(docs.withColumn("stage", F.lit(stage)), root, stage)
    incremental.drop_stale(spark, root, incremental.StageGraph({"ocr": ["asr"], "translation": ["ocr"], "speech": ["translation"]}), "asr")
    left = spark.read.option("recursiveFileLookup", "true").parquet(root)
    return left.groupBy("stage").agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT DISTINCT 'shard-' || (doc_id % 30) AS name FROM documents WHERE doc_id % 30 IN (4, 9, 14, 19, 24, 29) OR doc_id % 30 >= 25""")
def q81_missing_shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards of a weight map that are missing or empty."""
    shard = F.concat(F.lit("shard-"), (F.col("doc_id") % 30).cast("string"))
    docs = table(spark, d, "documents")
    manifest = docs.select(F.create_map(F.concat(F.lit("w"), F.col("doc_id").cast("string")), shard).alias("weight_map"))
    files = docs.where("doc_id % 30 < 25").select(shard.alias("name"), F.when(F.col("doc_id") % 5 == 4, 0).otherwise(10).alias("size")).distinct()
    return readers.shards_present(manifest, files)


@query("""SELECT 'utt' || n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'wav' WHEN 1 THEN 'mp3' ELSE 'flac' END AS extension FROM nation""")
def q82_media_files(spark: SparkSession, d: str) -> DataFrame:
    """For each recording the file with the first extension in order that is there."""
    root = new_path(spark, "media")
    options = {0: ("wav", "flac", "txt"), 1: ("wav", "mp3"), 2: ("ogg", "flac")}
    for i in (r[0] for r in table(spark, d, "nation").select("n_nationkey").collect()):
        for extension in options[i % 3]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/sub{i % 2}/utt{i}.{extension}")
            stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
            stream.write(1)
            stream.close()
    return readers.media_files(spark, root).select("id", F.regexp_extract("path", r"\.([^.]+)$", 1).alias("extension"))
