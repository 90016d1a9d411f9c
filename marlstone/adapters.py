"""Timed-text tables derived from the driver's tables by integer arithmetic, in Spark and in SQL.

The inputs hold no audio, so times follow from lengths and keys. Both forms give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of an Arrow batch for a Python worker, which may make several times as much of it.
BATCH_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table; batches that Python workers get are bounded by bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where they come in fewer partitions, for work that is heavy by the row; larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows._jdf.queryExecution().toRdd().getNumPartitions() >= cores else rows.repartition(cores)


def segments(conversations: DataFrame) -> DataFrame:
    """media, pos, text, speaker, start_ms, end_ms, one row a turn."""
    conv, turn = F.col("conv_id"), F.col("turn")
    dur = F.lit(200) + (F.length("text") * 7) % 2000
    gap = F.when((conv + turn) % 2 == 0, 0).otherwise((conv * 7 + turn) % 5 * 200)
    rows = conversations.select(conv.alias("media"), turn.alias("pos"), "text", F.concat(F.lit("SPEAKER_0"), ((conv + turn * turn) % 3).cast("string")).alias("speaker"), dur.cast("long").alias("dur"), gap.cast("long").alias("gap"))
    before = Window.partitionBy("media").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0))
    return rows.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + F.col("dur")).select("media", "pos", "text", "speaker", "start_ms", "end_ms")


SEG = """seg AS (
  SELECT conv_id AS media, turn AS pos, text, 'SPEAKER_0' || ((conv_id + turn * turn) % 3) AS speaker,
         CAST(coalesce(sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
         CAST(coalesce(sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + dur AS end_ms
  FROM (SELECT conv_id, turn, text, 200 + (length(text) * 7) % 2000 AS dur,
               CASE WHEN (conv_id + turn) % 2 = 0 THEN 0 ELSE (conv_id * 7 + turn) % 5 * 200 END AS gap FROM conversations))"""


def spans(events: DataFrame) -> DataFrame:
    """media (date), pos, start_ms, end_ms, speaker, kind, one row an event."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("media"),
        F.col("event_id").alias("pos"),
        ms.alias("start_ms"),
        (ms + F.floor(F.col("value") * 1000)).alias("end_ms"),
        F.concat(F.lit("spk"), (F.col("user_id") % 5).cast("string")).alias("speaker"),
        F.col("event_type").alias("kind"),
    )


SPAN = """span AS (
  SELECT strftime(ts, '%Y-%m-%d') AS media, event_id AS pos, epoch_us(ts) // 1000 AS start_ms,
         epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) AS end_ms, 'spk' || (user_id % 5) AS speaker, event_type AS kind FROM events)"""

#: Labels that emotion rows go through in turn.
EMOTIONS = ("anger", "happiness", "surprise", "other", "neutral", "happy/sad")


def emotions(conversations: DataFrame) -> DataFrame:
    """Segments with a label and a score."""
    seg = segments(conversations)
    label = F.element_at(F.array(*map(F.lit, EMOTIONS)), ((F.col("media") + F.col("pos")) % 6 + 1).cast("int"))
    return seg.withColumn("label", label).withColumn("score", (F.col("media") * 13 + F.col("pos") * 7) % 101 / 100.0)


EMO = SEG + f""", emo AS (
  SELECT *, list_extract({list(EMOTIONS)}, CAST((media + pos) % 6 + 1 AS INTEGER)) AS label, (media * 13 + pos * 7) % 101 / 100.0 AS score FROM seg)"""


def lines(pages: DataFrame) -> DataFrame:
    """media (page), pos, line: tags become line ends."""
    return pages.select(F.col("page_id").alias("media"), F.posexplode(F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n", -1)).alias("pos", "line"))


LINE = r"""line AS (
  SELECT media, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS line
  FROM (SELECT page_id AS media, string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)) AS l FROM pages))"""


def evaluation(documents: DataFrame) -> DataFrame:
    """id, lang, source, reference and two hypotheses of whole texts' ASCII characters, as a recogniser and its correction would give."""
    base = F.regexp_replace("text", r"[^\x20-\x7e]", "")
    rows = spread(documents.select("doc_id", "lang", "source", "text")).select(F.col("doc_id").alias("id"), "lang", "source", base.alias("reference"))
    heard = F.regexp_replace(F.regexp_replace("reference", "the", "teh"), "o", "0")
    fixed = F.when(F.col("id") % 4 == 0, F.col("baseline")).when(F.col("id") % 4 == 1, F.regexp_replace("baseline", "0", "o")).when(F.col("id") % 4 == 2, F.col("reference")).otherwise(F.regexp_replace("baseline", "e", ""))
    return rows.withColumn("baseline", heard).withColumn("corrected", fixed)


EVAL = r"""eval AS (
  SELECT *, CASE id % 4 WHEN 0 THEN baseline WHEN 1 THEN replace(baseline, '0', 'o') WHEN 2 THEN reference ELSE replace(baseline, 'e', '') END AS corrected
  FROM (SELECT *, replace(replace(reference, 'the', 'teh'), 'o', '0') AS baseline
        FROM (SELECT doc_id AS id, lang, source, regexp_replace(text, '[^\x20-\x7e]', '', 'g') AS reference FROM documents)))"""


def vectors(embeddings: DataFrame) -> DataFrame:
    """utt, key, vector."""
    return embeddings.select(F.col("label").alias("utt"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
