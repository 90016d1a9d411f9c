"""Operators over the order of rows in a media: neighbours, runs, fills, folds.

Folds whose state depends on what they have merged so far run as `aggregate` over the media's ordered
array of rows, inside the JVM. A media is one recording, so its array is small whatever the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marlstone.config import Emotion, Speech, Turns
from marlstone.functions.policy import EMOTION_ALIASES, emotion_label, emotion_parts
from marlstone.functions.text import is_tiny


def order() -> WindowSpec:
    """Rows of a media in order."""
    return Window.partitionBy("media").orderBy("pos")


def neighbours(segments: DataFrame) -> DataFrame:
    """With previous_text, next_text ("" at the ends) and merge_suggested: a tiny text before the same speaker."""
    out = segments.withColumn("previous_text", F.lag("text", 1, "").over(order())).withColumn("next_text", F.lead("text", 1, "").over(order()))
    return out.withColumn("merge_suggested", F.coalesce(is_tiny(F.col("text")) & (F.lead("speaker").over(order()) == F.col("speaker")), F.lit(False)))


def runs(segments: DataFrame) -> DataFrame:
    """(media, run, speaker, first_pos, n, start_ms, end_ms) of consecutive equal speakers."""
    new = F.coalesce((F.lag("speaker").over(order()) != F.col("speaker")).cast("int"), F.lit(1))
    numbered = segments.withColumn("_new", new).withColumn("run", F.sum("_new").over(order().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy("media", "run", "speaker").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def renumber(rows: DataFrame, to: str = "id") -> DataFrame:
    """Positions from 0 in media order."""
    return rows.withColumn(to, F.row_number().over(order()) - 1)


def forward_fill(segments: DataFrame, blank: str = "SPEAKER_00") -> DataFrame:
    """`filled`: the speaker, or where it is the blank one the last other before it."""
    known = F.nullif(F.col("speaker"), F.lit(blank))
    return segments.withColumn("filled", F.coalesce(F.last(known, ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(blank)))


def emotion_reliability(rows: DataFrame, cfg: Emotion = Emotion()) -> DataFrame:
    """With emotion, emotion_score, status and reliable (I07). rows: label, score, start_ms, end_ms; optional failed."""
    label = emotion_label(F.col("label"))
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
    failed = F.col("failed") if "failed" in rows.columns else F.lit(False)
    finite = F.coalesce(F.col("score"), F.lit(0.0))
    known = F.exists(emotion_parts(F.col("label")), lambda p: p.isin(*EMOTION_ALIASES))
    status = (
        F.when(failed, "failed")
        .when(seconds < cfg.min_duration, "too_short")
        .when(F.isnan(finite) | (finite < 0) | (finite > 1) | (finite < cfg.min_score), "low_confidence")
        .when(F.lower("label").isin("unknown", "other") | ~known, "unknown_label")
        .otherwise("success")
    )
    rows = rows.withColumn("status", status).withColumn("reliable", F.col("status") == "success")
    return rows.withColumn("emotion", F.when(F.col("reliable"), label).otherwise("neutral")).withColumn("emotion_score", F.when(F.col("reliable"), F.col("score")).otherwise(0.0))


def smooth_emotions(rows: DataFrame, cfg: Emotion = Emotion()) -> DataFrame:
    """Short or unsure rows take the emotion of the adjacent reliable rows of their speaker, if those agree.

    Neighbours are the rows before and after in the media, whoever speaks, as they were before
    smoothing. The better score is taken, the earlier of equal ones. `source` is model, fallback or neighbour.
    """
    me = F.struct("speaker", "reliable", "start_ms", "end_ms", "emotion", "emotion_score")
    rows = rows.withColumn("_b", F.lag(me).over(order())).withColumn("_a", F.lead(me).over(order()))
    gap = cfg.context_gap * 1000

    def usable(n: Column, apart: Column) -> Column:
        return F.coalesce((F.col("speaker") != "") & (n["speaker"] == F.col("speaker")) & n["reliable"] & (F.abs(apart) <= gap), F.lit(False))

    b, a = F.col("_b"), F.col("_a")
    use_b, use_a = usable(b, F.col("start_ms") - b["end_ms"]), usable(a, a["start_ms"] - F.col("end_ms"))
    open_row = ~F.col("reliable") & F.col("status").isin("too_short", "low_confidence")
    agree = ~(use_b & use_a) | (b["emotion"] == a["emotion"])
    take = open_row & (use_b | use_a) & agree
    anchor = F.when(use_b & (~use_a | (b["emotion_score"] >= a["emotion_score"])), b).otherwise(a)
    rows = rows.withColumn("_take", F.coalesce(take, F.lit(False))).withColumn("_anchor", anchor)
    return (
        rows.withColumn("source", F.when(F.col("_take"), "neighbour").when(F.col("reliable"), "model").otherwise("fallback"))
        .withColumn("emotion", F.when(F.col("_take"), F.col("_anchor.emotion")).otherwise(F.col("emotion")))
        .withColumn("emotion_score", F.when(F.col("_take"), F.col("_anchor.emotion_score")).otherwise(F.col("emotion_score")))
        .withColumn("reliable", F.col("reliable") | F.col("_take"))
        .drop("_a", "_b", "_take", "_anchor")
    )


def _ordered(segments: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per media with its rows in order: `rows`."""
    return segments.groupBy("media").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("rows"))


def merge_adjacent(segments: DataFrame, cfg: Turns = Turns()) -> DataFrame:
    """Merge neighbours of one speaker at most merge_gap_ms apart while what is merged so far or the next is short.

    The end is that of the later row; texts are joined by a space. Rows: media, id, first_pos, speaker, text, start_ms, end_ms, parts.
    The fold over a media keeps the open row and a character a row that says where a new one begins.
    """
    kind = "struct<speaker:string,start_ms:bigint,end_ms:bigint,begins:string>"

    def step(acc: Column, x: Column) -> Column:
        short = (acc["end_ms"] - acc["start_ms"] < cfg.short_ms) | (x["end_ms"] - x["start_ms"] < cfg.short_ms)
        join = F.coalesce((acc["speaker"] == x["speaker"]) & (x["start_ms"] - acc["end_ms"] <= cfg.merge_gap_ms) & short, F.lit(False))
        start = F.when(join, acc["start_ms"]).otherwise(x["start_ms"])
        return F.struct(x["speaker"].alias("speaker"), start.alias("start_ms"), x["end_ms"].alias("end_ms"), F.concat(acc["begins"], F.when(join, "0").otherwise("1")).alias("begins")).cast(kind)

    empty = F.struct(F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("bigint").alias("start_ms"), F.lit(None).cast("bigint").alias("end_ms"), F.lit("").alias("begins"))
    folded = _ordered(segments, ("speaker", "text", "start_ms", "end_ms")).withColumn("begins", F.aggregate("rows", empty, step)["begins"])
    each = folded.select("media", "begins", F.posexplode("rows").alias("k", "r"))
    each = each.withColumn("id", F.sum((F.substring("begins", F.col("k") + 1, F.lit(1)) == "1").cast("int")).over(Window.partitionBy("media").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    first, last = F.min(F.struct("k", "r")), F.max(F.struct("k", F.col("r.end_ms").alias("end_ms")))
    merged = each.groupBy("media", "id").agg(first.alias("f"), last.alias("l"), F.array_sort(F.collect_list(F.struct("k", F.col("r.text").alias("text")))).alias("t"), F.count(F.lit(1)).cast("int").alias("parts"))
    later = F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(1)))
    said = F.when(F.size("t") == 1, F.element_at("t", 1)["text"]).otherwise(F.aggregate(later, F.element_at("t", 1)["text"], lambda acc, x: F.trim(F.concat_ws(" ", acc, x["text"]))))
    return merged.select("media", F.col("id").cast("int").alias("id"), F.col("f.r.pos").alias("first_pos"), F.col("f.r.speaker").alias("speaker"), said.alias("text"), F.col("f.r.start_ms").alias("start_ms"), F.col("l.end_ms").alias("end_ms"), "parts")


def smooth_islands(spans: DataFrame, cfg: Turns = Turns(), keep: int | None = None) -> DataFrame:
    """Collapse A-B-A where B is short and close to both, looking again after each collapse.

    The fold keeps a stack; when the row that closes an island comes, the island's two top rows become
    one with it, and that may close the one below. Rows: media, id, speaker, start_ms, end_ms.
    """
    kind = "array<struct<speaker:string,start_ms:bigint,end_ms:bigint>>"
    limit = cfg.island_ms if keep is None else keep

    def closes(acc: Column, x: Column) -> Column:
        left, mid = F.try_element_at(acc, F.lit(-2)), F.try_element_at(acc, F.lit(-1))
        near = (mid["start_ms"] - left["end_ms"] <= cfg.island_gap_ms) & (x["start_ms"] - mid["end_ms"] <= cfg.island_gap_ms)
        return F.coalesce((left["speaker"] == x["speaker"]) & (mid["speaker"] != x["speaker"]) & (mid["end_ms"] - mid["start_ms"] <= limit) & near, F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        # After a collapse the grown row is on top; the row below it may be an island only when the next
        # equal speaker comes, which the same test sees then.
        left = F.try_element_at(acc, F.lit(-2))
        grown = F.struct(left["speaker"].alias("speaker"), left["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"))
        own = F.struct(x["speaker"].alias("speaker"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"))
        return F.when(closes(acc, x), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 2, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(own))).cast(kind)

    ordered = spans.groupBy("media").agg(F.array_sort(F.collect_list(F.struct("start_ms", "pos", "end_ms", "speaker"))).alias("rows"))
    out = ordered.select("media", F.posexplode(F.aggregate("rows", F.array().cast(kind), step)).alias("id", "m"))
    return out.select("media", "id", "m.speaker", "m.start_ms", "m.end_ms")


def pick_references(clips: DataFrame, total_ms: int = 10_000, least_ms: int = 500) -> DataFrame:
    """Per media and speaker the clips of a voice reference: best first, skipping what would go beyond total_ms.

    clips: media, pos, speaker, start_ms, end_ms, score. Clips longer than total_ms serve only if there
    are no others. Rows: media, speaker, n, total_ms, positions in time order.
    """
    dur = F.col("end_ms") - F.col("start_ms")
    usable = clips.withColumn("ms", dur).where(F.col("ms") >= least_ms)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k1"), (-F.col("ms")).alias("k2"), "pos", "ms", "start_ms")))
    per = usable.groupBy("media", "speaker").agg(ranked.alias("all"))
    bounded = F.filter("all", lambda c: c["ms"] <= total_ms)
    per = per.withColumn("c", F.when(F.size(bounded) > 0, bounded).otherwise(F.col("all")))
    kind = "struct<total:bigint,chosen:array<struct<start_ms:bigint,pos:bigint>>>"

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["chosen"]) == 0) | (acc["total"] + x["ms"] <= total_ms)
        grown = F.struct((acc["total"] + x["ms"]).alias("total"), F.concat(acc["chosen"], F.array(F.struct(x["start_ms"].alias("start_ms"), x["pos"].alias("pos")))).alias("chosen"))
        return F.when((acc["total"] < total_ms) & fits, grown).otherwise(acc).cast(kind)

    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<start_ms:bigint,pos:bigint>>").alias("chosen"))
    done = per.withColumn("r", F.aggregate("c", start, step))
    return done.select("media", "speaker", F.size("r.chosen").alias("n"), F.col("r.total").alias("total_ms"), F.transform(F.array_sort("r.chosen"), lambda x: x["pos"]).alias("positions"))


def reference_prefix(clips: DataFrame, total_ms: int = 10_000) -> DataFrame:
    """Clips in time order up to and with the one that goes beyond total_ms."""
    order = Window.partitionBy("media", "speaker").orderBy("start_ms", "pos")
    before = F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return clips.withColumn("before_ms", before).where(F.col("before_ms") <= total_ms)


def split_on_pauses(ranges: DataFrame, cfg: Speech = Speech()) -> DataFrame:
    """Cut ranges at the pause nearest the soft target; a cut at the hard limit is marked unsafe.

    ranges: media, pos, start_ms, end_ms, pauses array<struct<a:bigint,b:bigint>>. Rows with part,
    part_start, part_end and reason (natural_pause, unsafe_continuous_speech, range_end).
    """
    kind = "struct<cursor:bigint,done:boolean,cuts:array<struct<s:bigint,e:bigint,reason:string>>>"
    # Each cut moves at least 350 ms or the search start ahead, which bounds the number of steps.
    least = max(350, cfg.max_chunk_ms - cfg.search_ms)
    steps = F.sequence(F.lit(0), F.floor((F.col("end_ms") - F.col("start_ms")) / least).cast("int") + 1)

    def step(acc: Column, _: Column) -> Column:
        c, end = acc["cursor"], F.col("end_ms")
        target = c + cfg.max_chunk_ms
        fits = lambda p: (p["a"] >= c + least) & (p["b"] <= F.least(end, c + cfg.hard_limit_ms, target + cfg.search_ms))
        options = F.transform(F.filter("pauses", fits), lambda p, i: F.struct(F.abs(F.floor((p["a"] + p["b"]) / 2) - target).alias("d"), i.alias("i"), F.floor((p["a"] + p["b"]) / 2).alias("cut")))
        cut = F.array_min(options)["cut"]
        stop = acc["done"] | (end - c <= cfg.max_chunk_ms) | (cut.isNull() & (end - c <= cfg.hard_limit_ms))
        at = F.coalesce(cut, c + cfg.hard_limit_ms)
        reason = F.when(cut.isNotNull(), "natural_pause").otherwise("unsafe_continuous_speech")
        moved = F.struct(at.alias("cursor"), F.lit(False).alias("done"), F.concat(acc["cuts"], F.array(F.struct(c.alias("s"), at.alias("e"), reason.alias("reason")))).alias("cuts"))
        stay = F.struct(c.alias("cursor"), F.lit(True).alias("done"), acc["cuts"].alias("cuts"))
        return F.when(stop, stay).otherwise(moved).cast(kind)

    start = F.struct(F.col("start_ms").alias("cursor"), F.lit(False).alias("done"), F.array().cast("array<struct<s:bigint,e:bigint,reason:string>>").alias("cuts"))
    out = ranges.where(F.col("end_ms") > F.col("start_ms")).withColumn("r", F.aggregate(steps, start, step))
    last = F.array(F.struct(F.col("r.cursor").alias("s"), F.col("end_ms").alias("e"), F.lit("range_end").alias("reason")))
    out = out.select("media", "pos", F.posexplode(F.concat("r.cuts", last)).alias("part", "p"))
    return out.select("media", "pos", "part", F.col("p.s").alias("part_start"), F.col("p.e").alias("part_end"), "p.reason")


def update_stamps(segments: DataFrame) -> DataFrame:
    """With text, stamp_status and stamps after a decision.

    segments: text, corrected, accepted, start, end, stamps array<struct<text,start,end>>. Stamps go if the
    text changed or one is not finite, out of order or outside the segment.
    """
    new = F.when(F.col("accepted"), F.coalesce("corrected", "text")).otherwise(F.col("text"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    walk = F.aggregate(
        "stamps",
        F.struct(F.col("start").alias("at"), F.lit(True).alias("ok")),
        lambda acc, s: F.struct(s["end"].alias("at"), (acc["ok"] & good(s["start"]) & good(s["end"]) & F.coalesce((acc["at"] <= s["start"]) & (s["start"] <= s["end"]) & (s["end"] <= F.col("end")), F.lit(False))).alias("ok")),
    )
    changed = new != F.col("text")
    status = F.when(F.size("stamps") <= 0, F.lit(None)).when(changed, "invalidated_text_changed").when(~walk["ok"], "invalidated_invalid_bounds").otherwise("unchanged_valid_bounds")
    out = segments.withColumn("stamp_status", status).withColumn("original_text", F.col("text")).withColumn("text", new)
    return out.withColumn("original_stamps", F.when(F.col("stamp_status").startswith("invalidated"), F.col("stamps"))).withColumn("stamps", F.when(F.col("original_stamps").isNull(), F.col("stamps")))


def budget_prefix(rows: DataFrame, order: list[Column], budget: int, text: str = "line") -> DataFrame:
    """Best rows of a media while their characters, with one separator between, stay in the budget.

    The first row always stays, cut to the budget.
    """
    w = Window.partitionBy("media").orderBy(*order)
    n = F.row_number().over(w)
    used = F.sum(F.length(text) + F.when(F.col("_n") > 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("_n", n).withColumn("used_chars", used).where((F.col("_n") == 1) | (F.col("used_chars") <= budget))
    return kept.withColumn("rank", F.col("_n")).withColumn(text, F.when(F.col("_n") == 1, F.substring(text, 1, budget)).otherwise(F.col(text))).drop("_n")
