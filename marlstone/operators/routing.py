"""Rows on their way to speech: routed segments, checked translations, jobs, replayed decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.config import Complexity, Emotion
from marlstone.functions import policy
from marlstone.functions.guards import boundary_reason
from marlstone.functions.text import candidates, is_tiny, script_error
from marlstone.operators import evaluate


def route_segments(segments: DataFrame, source: str, target: str, complexity: Complexity = Complexity(), emotion: Emotion = Emotion()) -> DataFrame:
    """Segments with languages, emotion, engine and complexity.

    segments: media, pos, text, start, end (seconds), label, score; optional id, speaker, reliable,
    source_lang. A reliable flag, if there, decides over the score. Lengths count to the microsecond. A range that doesn't move ahead
    raises. Other columns stay.
    """
    has = lambda c: c in segments.columns
    lang = policy.normalize_language(F.lit(target))
    by_score = policy.normalize_emotion(F.col("label"), F.col("score"), policy.seconds_between(F.col("start"), F.col("end")), emotion)
    mood = F.when(F.col("reliable").isNull(), by_score).when(F.col("reliable"), policy.emotion_label(F.col("label"))).otherwise("neutral") if has("reliable") else by_score
    bad = F.raise_error(F.format_string("segment %s has no range", F.col("pos").cast("string")))
    rows = segments.withColumn("end", F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(bad)).withColumn("text", policy.strip(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("id", F.coalesce(F.col("id").cast("string"), F.col("pos").cast("string")) if has("id") else F.col("pos").cast("string"))
    rows = rows.withColumn("speaker", F.coalesce("speaker", F.lit("SPEAKER_00")) if has("speaker") else F.lit("SPEAKER_00"))
    rows = rows.withColumn("source_lang", policy.normalize_language(F.coalesce("source_lang", F.lit(source)) if has("source_lang") else F.lit(source))).withColumn("target_lang", lang)
    rows = rows.withColumn("emotion", mood).withColumn("complexity", policy.complexity(F.col("text"), lang, complexity)).withColumn("engine", policy.route(lang, F.col("emotion"), F.col("text"), complexity))
    raw = F.replace(F.lower(F.trim(F.lit(target))), F.lit("_"), F.lit("-"))
    return rows.withColumn("target_lang_raw", F.when(lang == "other", raw))


def check_translations(rows: DataFrame, target: str, source: str) -> DataFrame:
    """With error (null if good), distinct candidates and warning.

    rows: original, text, raw array<string>; optional allow_identity. Every raw candidate is checked before
    they are made distinct; tiny originals need one candidate, others three, none more than five.
    """
    allow = F.col("allow_identity") if "allow_identity" in rows.columns else F.lit(False)
    wrong = lambda t: script_error(t, F.lit(target), F.col("original"), F.lit(source), allow)
    first_bad = F.try_element_at(F.filter(F.transform("raw", wrong), lambda e: e.isNotNull()), F.lit(1))
    rows = rows.withColumn("candidates", candidates(F.col("raw"), F.lit("")))
    least = F.when(is_tiny(F.coalesce("original", F.lit(""))), 1).otherwise(3)
    count = F.when((F.size("candidates") < least) | (F.size("raw") > 5), F.format_string("candidate_count:%d required:%d-5", F.size("candidates"), least))
    none = F.when(F.coalesce(F.size("raw"), F.lit(0)) <= 0, "missing_candidates")
    lengths = F.size(F.array_distinct(F.transform("candidates", F.length)))
    rows = rows.withColumn("error", F.coalesce(wrong(F.col("text")), none, first_bad, count))
    return rows.withColumn("warning", F.when(F.col("error").isNull() & (lengths < F.least(F.lit(3), F.size("candidates"))), "candidate_lengths_similar"))


def require_good(rows: DataFrame, error: str = "error", key: str = "id") -> None:
    """Raise once with all failing keys, the first hundred named."""
    bad = rows.where(F.col(error).isNotNull())
    named = bad.select(key, error).orderBy(key).limit(100).collect()
    if named:
        raise ValueError(f"{bad.count()} rows failed: " + ", ".join(f"{r[0]}: {r[1]}" for r in named))


def jobs(segments: DataFrame, references: DataFrame) -> DataFrame:
    """Synthesis jobs of routed segments: planned engine, attempts so far, voice reference, paths.

    references: media, speaker, ref_audio, ref_text.
    """
    rows = segments.join(references, ["media", "speaker"], "left").withColumn("model", F.col("engine"))
    name = F.concat(F.lit("segment_"), policy.safe_id(F.col("id")), F.lit("_"), F.col("model"), F.lit(".wav"))
    return rows.select("media", "id", "text", "emotion", "speaker", "ref_audio", "ref_text", F.col("engine").alias("planned_engine"), "model", F.array("engine").alias("attempted_engines"), F.array("text").alias("attempted_texts"), F.lit(0).alias("fallback_count"), (F.col("end") - F.col("start")).alias("target_duration"), name.alias("file"))


def next_jobs(open_jobs: DataFrame, chains: dict[str, list[str]] | None = None) -> DataFrame:
    """Failed jobs with the next engine of their chain; jobs whose chain is used up go."""
    model = policy.next_engine(F.col("planned_engine"), F.col("attempted_engines"), chains)
    rows = open_jobs.withColumn("model", model).where("model IS NOT NULL")
    return rows.withColumn("attempted_engines", F.array_append("attempted_engines", F.col("model"))).withColumn("fallback_count", F.col("fallback_count") + 1)


def replay(rows: DataFrame, candidates_in_order: dict[str, bool], ceiling: float) -> DataFrame:
    """Re-score frozen decisions under candidate policies and mark the first that passes all gates.

    rows: as for `evaluate.gates`, with accepted, latin_removed and declared. The value of a candidate says
    whether declared rewrites are refused.
    """
    out = None
    for k, (name, strict) in enumerate(candidates_in_order.items()):
        reason = boundary_reason(F.col("accepted"), F.col("latin_removed"), F.col("declared"), strict)
        scored = evaluate.gates(evaluate.apply_decision(rows, reason == "accepted", reason), ceiling).withColumn("candidate", F.lit(name)).withColumn("place", F.lit(k))
        out = scored if out is None else out.unionByName(scored)
    first = F.min(F.when(F.col("pass"), F.col("place"))).over(Window.partitionBy(F.lit(1)))  # a row per candidate policy
    return out.withColumn("selected", F.coalesce(F.col("place") == first, F.lit(False))).drop("place")


def keep(text: Column, reason: str) -> Column:
    """The decision to leave a text as it is."""
    return F.struct(text.alias("corrected_text"), F.lit(False).alias("accepted"), F.lit(reason).alias("reason"))


def flat_once(values: Column) -> Column:
    """The inner array of an array that holds one."""
    return F.when(F.size(values) == 1, F.element_at(values, 1)).otherwise(F.flatten(values))


def by_position(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("media", "pos")) -> DataFrame:
    """Rows of two tables with equal positions; a position that only one has raises."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), list(keys), "full_outer")
    lone = F.col("_l").isNull() | F.col("_r").isNull()
    return both.where(F.when(lone, F.raise_error(F.lit("tables differ in positions")).cast("boolean")).otherwise(True)).drop("_l", "_r")
