"""Writers: stage tables, reports, segment lists. Spark's commit protocol makes a job's output appear whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.policy import EMOTIONS, ENGINES, LANGUAGES


def save_stage(df: DataFrame, root: str, stage: str) -> None:
    """Replace one stage's table, leaving the others."""
    df.write.mode("overwrite").parquet(f"{root}/{stage}")


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines (K05, K06). NaN is refused."""
    checks = [F.when(F.isnan(c), F.raise_error(F.lit(f"NaN in {c}"))).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*checks).write.mode("append").json(path)


def save_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Named columns in order with a header (K07, K12); others are left out, missing ones are empty, quotes are doubled."""
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields)).write.mode("overwrite").csv(path, header=True, escape='"')


def segment_problems(rows: DataFrame) -> DataFrame:
    """(id, problem) of segments that must not be written."""
    p = (
        F.when(F.col("text").isNull() | F.col("speaker").isNull() | F.col("start").isNull() | F.col("end").isNull(), "missing_field")
        .when(F.col("end") <= F.col("start"), "end_not_after_start")
        .when(~F.coalesce(F.col("source_lang").isin(*LANGUAGES), F.lit(False)), "invalid_source_lang")
        .when(~F.coalesce(F.col("target_lang").isin(*LANGUAGES), F.lit(False)), "invalid_target_lang")
        .when(~F.coalesce(F.col("emotion").isin(*EMOTIONS), F.lit(False)), "invalid_emotion")
        .when(~F.coalesce(F.col("tts_engine").isin(*ENGINES), F.lit(False)), "invalid_tts_engine")
    )
    return rows.select("id", p.alias("problem")).where("problem IS NOT NULL")


def save_segments(rows: DataFrame, path: str) -> None:
    """Check and write segments as JSON lines (K08, F06); the first problems are named in the error."""
    bad = segment_problems(rows).limit(10).collect()
    if bad:
        raise ValueError("invalid segments: " + ", ".join(f"{r['id']}: {r['problem']}" for r in bad))
    rows.write.mode("overwrite").json(path)


def segment_list(segments: DataFrame) -> DataFrame:
    """Lines of `segment utterance start end` for rows that end after they start."""
    rows = segments.where("end_ms > start_ms")
    seg = F.format_string("%s-%08d-%08d", F.col("media").cast("string"), "start_ms", "end_ms")
    return rows.select(F.concat_ws(" ", seg, F.col("media").cast("string"), F.format_string("%.3f", F.col("start_ms") / 1000), F.format_string("%.3f", F.col("end_ms") / 1000)).alias("value"))


def mix_plan(clips: DataFrame, gain: float = -6.0) -> DataFrame:
    """Where each clip goes on the time line, and the background's gain (K11); mixing itself is elsewhere."""
    return clips.select("segment_id", "file", F.greatest(F.lit(0), F.col("start_ms")).alias("offset_ms"), F.lit(gain).alias("background_db"))
