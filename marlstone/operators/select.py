"""Deduplication, ranking and picking with ties broken by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.config import Evidence
from marlstone.functions.policy import text_seconds
from marlstone.functions.text import noise_reason, subtitle_score, watermark_reason
from marlstone.functions.unicode import match_text, similarity
from marlstone.operators.sequence import budget_prefix


def first_per_key(rows: DataFrame, partition: list[str], key: Column, order: list[str]) -> DataFrame:
    """The first row of each key, by an aggregate that combines before the shuffle."""
    cols = [c for c in rows.columns if c not in partition]
    picked = rows.withColumn("_key", key).groupBy(*partition, "_key").agg(F.min(F.struct(*order, F.struct(*cols).alias("row"))).alias("m"))
    return picked.select(*partition, *(F.col(f"m.row.{c}").alias(c) for c in cols))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the one with the largest order; null keys go."""
    cols = [c for c in rows.columns if c not in (key, order)]
    picked = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *cols)).alias("m"))
    return picked.select(key, *(F.col(f"m.{c}").alias(c) for c in rows.columns if c != key))


def drop_repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once."""
    once = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(key)
    return rows.join(once, key, "left_semi")


def evidence(lines: DataFrame, cfg: Evidence = Evidence(), patterns: tuple[str, ...] = (), budget: bool = True) -> DataFrame:
    """Evidence lines of each media (T01): media, rank, line_id, line, lexical, subtitle, selection.

    lines: media, pos, line, heard (what the lines are compared with). Noise and watermarks go, equal
    normalised lines count once; the quota goes to the lexically nearest, the rest to the most
    subtitle-like; `budget` bounds the characters.
    """
    keyed = lines.withColumn("key", match_text(F.col("line"))).where((noise_reason(F.col("line")) == "") & (F.col("key") != ""))
    once = first_per_key(keyed, ["media"], F.col("key"), ["pos"]).where(watermark_reason(F.col("line"), list(patterns)) == "")
    scored = once.withColumn("lexical", F.round(similarity(F.col("line"), F.col("heard")), 6)).withColumn("subtitle", F.round(subtitle_score(F.col("line")), 6))
    by = Window.partitionBy("media")
    lex, sub = F.col("lexical").desc(), F.col("subtitle").desc()
    ranked = scored.withColumn("by_lexical", F.row_number().over(by.orderBy(lex, sub, "pos")))
    ranked = ranked.withColumn("taken", (F.col("by_lexical") <= cfg.lexical_quota) & (F.col("lexical") >= cfg.least_lexical))
    ranked = ranked.withColumn("rank", F.row_number().over(by.orderBy(F.col("taken").desc(), F.when(F.col("taken"), F.col("by_lexical")), sub, lex, "pos"))).where(F.col("rank") <= cfg.max_lines)
    if budget:
        ranked = budget_prefix(ranked.drop("used_chars"), [F.col("rank")], cfg.max_chars)
    return ranked.select("media", "rank", F.format_string("L%02d", F.col("rank").cast("int")).alias("line_id"), "line", "lexical", "subtitle", F.when(F.col("taken"), "lexical").otherwise("subtitle_candidate").alias("selection"))


def closest_duration(candidates: DataFrame) -> DataFrame:
    """Per segment the candidate with the least duration error, ties to the first.

    candidates: media, pos, idx, text, target, measured (null: failed). Where all of a segment failed, the
    text's estimate counts and status is fallback.
    """
    any_ok = F.max(F.col("measured").isNotNull()).over(Window.partitionBy("media", "pos"))
    rows = candidates.withColumn("_ok", any_ok).where("measured IS NOT NULL OR NOT _ok")
    actual = F.coalesce("measured", text_seconds(F.col("text")))
    best = rows.groupBy("media", "pos").agg(F.min(F.struct(F.abs(actual - F.col("target")).alias("err"), "idx", "text", actual.alias("actual"), F.when(F.col("_ok"), "success").otherwise("fallback").alias("status"))).alias("m"))
    return best.select("media", "pos", F.col("m.idx").alias("idx"), "m.text", "m.actual", F.col("m.err").alias("duration_error"), "m.status")


def fallback_gate(share: float = 0.5) -> Column:
    """An aggregate over `status`: whether two or more rows, and more than the share, fell back."""
    bad, n = F.count_if(F.col("status") == "fallback"), F.count(F.lit(1))
    return (bad >= 2) & (bad / F.greatest(n, F.lit(1)) > share)


def too_many_fallbacks(selections: DataFrame, share: float = 0.5) -> bool:
    """The gate over all selections."""
    return bool(selections.agg(fallback_gate(share)).first()[0])


def pick_strategy(options: DataFrame) -> DataFrame:
    """Per utterance the clustering run to use (T10): eom runs of two clusters or more by most clusters, else leaf runs
    of three to five, else leaf runs, else the most clusters; the first of equals. options: utt, run, method, clusters."""
    level = F.when((F.col("method") == "eom") & (F.col("clusters") >= 2), 0).when((F.col("method") == "leaf") & F.col("clusters").between(3, 5), 1).when((F.col("method") == "leaf") & (F.col("clusters") >= 2), 2).otherwise(3)
    best = options.groupBy("utt").agg(F.min(F.struct(level.alias("level"), (-F.col("clusters")).alias("many"), "run", "method")).alias("m"))
    return best.select("utt", F.col("m.run").alias("run"), F.col("m.method").alias("method"), (-F.col("m.many")).alias("clusters"))


def batches(rows: DataFrame, size: int, order: str = "pos", by: str = "media") -> DataFrame:
    """Fixed-size batches in order within each media."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size))
