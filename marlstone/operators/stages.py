"""Stages around external work: engines in rounds, workers that resume, correctors that fail safely, validation.

Engines, workers and correctors are functions that the caller gives. The loops run on the driver over a
bounded number of rounds or batches; what a round found is saved before the next begins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.config import Quality
from marlstone.functions.policy import ENGINES, duration_quality, language_code, next_engine
from marlstone.functions.text import closest_by_length, split_lines
from marlstone.operators.incremental import content_id, error_chain

Work = Callable[[DataFrame], DataFrame]


# --- engines ---------------------------------------------------------------------------------------


def execute(jobs: DataFrame, engines: dict[str, Work], order: Iterable[str] = ENGINES, cfg: Quality = Quality()) -> DataFrame:
    """Jobs with status, quality, seconds and error of one attempt, each by the engine it names.

    jobs: model, target. An engine adds seconds (null if it failed) and error to its rows. An engine that
    is not there or can't be planned fails its rows only. Engines go in a fixed order.
    """
    rows = jobs.drop("status", "quality", "seconds", "error")
    out = None
    for name in (*order, None):
        own = rows.where(F.col("model") == name) if name else rows.where(~F.coalesce(F.col("model").isin(*order), F.lit(False)))
        try:
            done = engines[name](own)
        except Exception as e:
            done = own.withColumn("seconds", F.lit(None).cast("double")).withColumn("error", F.concat(F.lit("no engine "), F.coalesce("model", F.lit("null"))) if isinstance(e, KeyError) else F.lit(error_chain(e)))
        done = done.select(*rows.columns, F.col("seconds").cast("double").alias("seconds"), F.col("error").cast("string").alias("error"))
        out = done if out is None else out.unionByName(done)
    quality = F.when(F.col("seconds").isNotNull(), duration_quality(F.col("seconds"), F.col("target"), cfg)["duration_quality"])
    failed = F.when(F.col("seconds").isNull(), F.coalesce("error", F.lit("engine failed"))).when(quality == "failed", F.format_string("duration %.3f for %.3f", "seconds", "target"))
    return out.withColumn("quality", quality).withColumn("error", failed).withColumn("status", F.when(failed.isNull(), "success").otherwise("failed"))


def run_router(jobs: DataFrame, finished: DataFrame, engines: dict[str, Work], ready: Callable[[str], bool], save: Work, retries: int = 1, rounds: int = 4, chains: dict[str, list[str]] | None = None, order: Iterable[str] = ENGINES) -> DataFrame:
    """Jobs to their end: reuse, engines, other texts for bad durations, other engines for failures.

    jobs: id, fingerprint, text, options array<string>, planned (engine), target. finished: id,
    fingerprint, status, model, text, seconds. A planned engine that is not ready raises before any work;
    a fallback engine that is not ready fails the rows that need it. `save` writes each round and reads it
    back. Out: the jobs with model, tried_engines, tried_texts, fallbacks, reused, status, quality, seconds, error.
    """
    order = tuple(order)
    usable = [name for name in order if ready(name)]
    if missing := [r[0] for r in jobs.select("planned").distinct().collect() if r[0] not in usable]:
        raise RuntimeError(f"engines not ready: {sorted(missing)}")
    known = finished.where("status = 'success'").select("id", "fingerprint", F.col("model").alias("old_model"), F.col("text").alias("old_text"), F.col("seconds").alias("old_seconds")).dropDuplicates(["id", "fingerprint"])
    rows = jobs.join(known, ["id", "fingerprint"], "left").withColumn("reused", F.coalesce(duration_quality(F.col("old_seconds"), F.col("target"))["duration_quality"] == "passed", F.lit(False)))
    rows = rows.withColumn("model", F.when(F.col("reused"), F.col("old_model")).otherwise(F.col("planned"))).withColumn("text", F.when(F.col("reused"), F.col("old_text")).otherwise(F.col("text")))
    rows = rows.withColumn("tried_engines", F.array("model")).withColumn("tried_texts", F.array("text")).withColumn("fallbacks", F.lit(0))
    old = rows.where("reused").withColumn("status", F.lit("success")).withColumn("quality", F.lit("passed")).withColumn("seconds", F.col("old_seconds")).withColumn("error", F.lit(None).cast("string"))
    gone = ("old_model", "old_text", "old_seconds")
    state = save(old.drop(*gone).unionByName(execute(rows.where("NOT reused").drop(*gone), engines, order)))

    def again(state: DataFrame, chosen: DataFrame) -> DataFrame:
        tried = execute(chosen, engines, order)
        return save(state.join(tried.select("id"), "id", "left_anti").unionByName(tried))

    left = F.array_except("options", "tried_texts")
    fitting = closest_by_length(F.col("left"), F.length("text") * F.col("target") / F.greatest(F.lit(0.1), F.coalesce("seconds", F.lit(0.1))))
    for _ in range(retries):
        chosen = state.where("status = 'failed' AND quality = 'failed'").withColumn("left", left).where(F.size("left") > 0)
        if not chosen.take(1):
            break
        chosen = chosen.withColumn("text", fitting).withColumn("tried_texts", F.array_append("tried_texts", F.col("text"))).drop("left")
        state = again(state, chosen)
    for _ in range(rounds):
        chosen = state.where("status = 'failed'").withColumn("next", next_engine(F.col("planned"), F.col("tried_engines"), chains)).where("next IS NOT NULL")
        if not chosen.take(1):
            break
        chosen = chosen.withColumn("model", F.col("next")).withColumn("tried_engines", F.array_append("tried_engines", F.col("next"))).withColumn("fallbacks", F.col("fallbacks") + 1).drop("next")
        state = again(state, _named_if_ready(chosen, usable))
    return state


def _named_if_ready(chosen: DataFrame, usable: list[str]) -> DataFrame:
    """Rows whose engine is not ready say so in its place, and so fail in `execute`."""
    return chosen.withColumn("model", F.when(F.col("model").isin(*usable), F.col("model")).otherwise(F.concat(F.lit("not ready: "), "model")))


# --- workers that resume ---------------------------------------------------------------------------


def run_worker(jobs: DataFrame, model: str, finished: DataFrame, work: Work, save: Work, batches: int = 4) -> DataFrame:
    """One model's jobs in batches: earlier results stand, each batch is saved, a broken batch fails its rows only.

    jobs: id, model, fingerprint. finished: id, fingerprint, status, seconds. work adds seconds. Out: id, fingerprint, status, seconds, error.
    """
    kind = "id", "fingerprint", "status", "seconds", "error"
    own = jobs.where(F.col("model") == model).select("id", "fingerprint", *[c for c in jobs.columns if c not in ("id", "fingerprint")])
    old = finished.where("status = 'success'").dropDuplicates(["id", "fingerprint"])
    kept = old.join(own, ["id", "fingerprint"], "left_semi").withColumn("error", F.lit(None).cast("string")).select(*kind)
    pending = own.join(old, ["id", "fingerprint"], "left_anti")
    out = save(kept)
    for k in range(batches):
        part = pending.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k)
        try:
            made = save(work(part).withColumn("status", F.lit("success")).withColumn("error", F.lit(None).cast("string")).select(*kind))
        except Exception as e:  # the batch's rows say what became of it
            made = save(part.select("id", "fingerprint", F.lit("failed").alias("status"), F.lit(None).cast("double").alias("seconds"), F.lit(error_chain(e).split("\n")[0][:200]).alias("error")))
        out = out.unionByName(made)
    return out


def has_emotion(status: Column, emotion: Column, score: Column) -> Column:
    """Whether a segment's emotion stands and need not be found again."""
    return F.coalesce((status == "success") & (emotion != "") & score.isNotNull(), F.lit(False))


def three_ways(segments: DataFrame, checkpoint: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows that have their value, in themselves or from a checkpoint of the same id and fingerprint; rows that need work).

    segments: id, fingerprint and the value (null if open). Out: with source, segment or checkpoint.
    """
    open_rows = segments.where(F.col(value).isNull()).drop(value)
    done = checkpoint.where(F.col(value).isNotNull()).select("id", "fingerprint", value).dropDuplicates(["id", "fingerprint"])
    whole = segments.where(F.col(value).isNotNull()).withColumn("source", F.lit("segment"))
    found = open_rows.join(done, ["id", "fingerprint"]).withColumn("source", F.lit("checkpoint"))
    return whole.unionByName(found.select(*whole.columns)), open_rows.join(done, ["id", "fingerprint"], "left_anti")


def resume(rows: DataFrame, done: DataFrame, key: str, work: Work, order: list[str]) -> DataFrame:
    """Finished rows that are still wanted and the others as `work` makes them, in order."""
    left = done.join(rows.select(key).distinct(), key, "left_semi")
    made = work(rows.join(done, key, "left_anti"))
    return left.unionByName(made.select(*left.columns)).orderBy(*order)


def pass_same_language(rows: DataFrame, source: Column, target: Column, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows whose languages agree, translated by their own text; rows to translate)."""
    same = language_code(source) == language_code(target)
    return rows.where(same).withColumn("translation", F.col(text)).withColumn("status", F.lit("success")), rows.where(~F.coalesce(same, F.lit(False)))


# --- correctors ------------------------------------------------------------------------------------


def keep_all(rows: DataFrame, reason: str) -> DataFrame:
    """Every text as it is."""
    return rows.select("id", F.col("heard").alias("corrected_text"), F.lit(False).alias("accepted"), F.lit(reason).alias("reason"))


def correct(rows: DataFrame, mode: str, correctors: dict[str, Work], save: Work) -> DataFrame:
    """(id, corrected_text, accepted, reason) by a mode's corrector; off, or any failure, keeps all texts.

    rows: id, heard, raw (recognised text). Its lines get ids L001, L002 and so on. An unknown mode raises.
    """
    if mode == "off":
        return keep_all(rows, "off")
    if mode not in correctors:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(correctors)}")
    lines = F.transform(split_lines(F.col("raw")), lambda x, i: F.struct(F.format_string("L%03d", i + 1).alias("line_id"), x.alias("text")))
    try:
        return save(correctors[mode](rows.withColumn("lines", lines)).select("id", "corrected_text", "accepted", "reason"))
    except Exception as e:
        return keep_all(rows, f"failed: {type(e).__name__}")


def correct_in_batches(rows: DataFrame, batches: int, ask: Work, save: Work) -> DataFrame:
    """As `correct`, batch by batch: a batch whose answer is broken or doesn't cover it keeps its texts.

    ask gets (id, heard) and gives (id, corrected_text).
    """
    out = None
    for k in range(batches):
        part = rows.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k)
        try:
            answer = save(ask(part.select("id", "heard")).select("id", "corrected_text"))
            wrong = part.select("id").join(answer.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "full_outer").where("n IS NULL OR n <> 1")
            if answer.join(part, "id", "left_anti").take(1) or wrong.take(1):
                raise ValueError("the answer doesn't cover the batch")
            done = part.join(answer, "id").select("id", "corrected_text", (F.col("corrected_text") != F.col("heard")).alias("accepted"), F.lit("answered").alias("reason"))
        except Exception as e:
            done = keep_all(part, f"batch failed: {type(e).__name__}")
        out = done if out is None else out.unionByName(done)
    return out


# --- validation ------------------------------------------------------------------------------------


def request_problems(requests: DataFrame, languages: tuple[str, ...] = ("en", "zh")) -> DataFrame:
    """(id, problem) of requests that must not go on: the first that holds.

    requests: id, source_language, heard, lines array<struct<line_id,text>>.
    """
    ids = F.transform("lines", lambda x: x["line_id"])
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    p = (
        F.when(F.col("id").isNull() | (F.col("id") == ""), "missing_id")
        .when(n > 1, "repeated_id")
        .when(~F.coalesce(F.col("source_language").isin(*languages), F.lit(False)), "unsupported_language")
        .when(F.col("heard").isNull(), "missing_text")
        .when(F.col("lines").isNull() | F.exists("lines", lambda x: x["line_id"].isNull() | (x["line_id"] == "") | x["text"].isNull()), "broken_line")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_line_id")
    )
    return requests.withColumn("problem", p).where("problem IS NOT NULL").select("id", "problem")


def inventory_problems(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, candidate_id, problem) of candidates that don't fit their request: its slice, identifier, lines and status."""
    asked = requests.select("id", "heard", F.transform("lines", lambda x: x["line_id"]).alias("known"))
    own = content_id("c", "id", "start", "end", "replacement")
    both = candidates.join(asked, "id", "left").withColumn("own", own)
    p = (
        F.when(F.col("heard").isNull(), "unknown_request")
        .when((F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.length("heard")), "outside_text")
        .when(F.substring("heard", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("original"), "other_text")
        .when(F.size("lines") == 0, "no_lines")
        .when(F.size(F.array_except("lines", "known")) > 0, "unknown_line")
        .when(~F.col("status").isin("classifiable", "diagnostic_only", "conflicting", "over_capacity"), "unknown_status")
        .when(F.col("own") != F.col("candidate_id"), "other_identifier")
    )
    return both.withColumn("problem", p).where("problem IS NOT NULL").select("id", "candidate_id", "problem")
