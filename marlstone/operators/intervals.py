"""Joins and islands over intervals: overlap, containment, nearest, merging, conflicts.

`overlap_join` buckets time, so an interval theta join becomes an equi-join with a residual condition;
no nested loop is planned whatever the sizes. A pair is kept only in the bucket where the later of the
two starts lies, so no pair appears twice and nothing has to be deduplicated. Very long intervals fall
into many buckets; choose the bucket near their usual length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.config import Speech, Turns


def _buckets(start: Column, end: Column, size: int) -> Column:
    """The buckets that a range touches, its end included."""
    lo = F.floor(start / size)
    return F.explode(F.sequence(lo, F.greatest(F.floor(end / size), lo)))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: int, closed: bool = False, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Inner join of rows with equal keys whose ranges overlap (closed: touching ends count).

    Columns of `right` other than the keys get the prefix r_. Rows with a null key, start or end match
    nothing (J06).
    """
    r = right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys))
    a = left.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_bucket", _buckets(F.col(start), F.col(end), bucket))
    b = r.where(F.col(f"r_{start}").isNotNull() & F.col(f"r_{end}").isNotNull()).withColumn("_bucket", _buckets(F.col(f"r_{start}"), F.col(f"r_{end}"), bucket))
    later = F.greatest(F.col(start), F.col(f"r_{start}"))
    sooner = F.least(F.col(end), F.col(f"r_{end}"))
    meets = (later <= sooner) if closed else (later < sooner)
    return a.join(b, [*keys, "_bucket"]).where(meets & (F.floor(later / bucket) == F.col("_bucket"))).drop("_bucket")


def running(rows: DataFrame, name: str, value: Column, at: Column, order: Sequence[str], agg: Callable[[Column], Column] = F.max, join: Callable[[Column, Column], Column] = F.greatest, ahead: bool = False, own: bool = True, bucket: int = 600_000) -> DataFrame:
    """Rows with `name`: a running aggregate over their media in the order given, through time buckets.

    A window stays within one bucket of a media; what earlier (ahead: later) buckets come to is one row
    a bucket and joins it, so a long recording is many tasks. `at` is the time that the order begins with.
    own: the row itself counts. Nulls don't count. Rows are read twice; write down what is costly to make.
    """
    first, last = (0 if own else 1, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, 0 if own else -1)
    outer = (1, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, -1)
    dealt = rows.withColumn("_b", F.floor(at / bucket)).withColumn("_v", value)
    carried = dealt.groupBy("media", "_b").agg(agg(F.col("_v")).alias("_top"))
    carried = carried.select("media", "_b", agg(F.col("_top")).over(Window.partitionBy("media").orderBy("_b").rowsBetween(*outer)).alias("_carry"))
    within = agg(F.col("_v")).over(Window.partitionBy("media", "_b").orderBy(*order).rowsBetween(first, last))
    return dealt.join(carried, ["media", "_b"]).withColumn("_in", within).withColumn(name, join(F.col("_carry"), F.col("_in"))).drop("_b", "_v", "_carry", "_in")


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def overlaps_by_speaker(segments: DataFrame, spans: DataFrame, bucket: int = 60_000) -> DataFrame:
    """(media, pos, speaker, overlap_ms, first_pos) of segments and the speakers that overlap them."""
    ms = F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")
    return (
        overlap_join(segments.select("media", "pos", "start_ms", "end_ms"), spans.select("media", "pos", "start_ms", "end_ms", "speaker"), ["media"], bucket)
        .groupBy("media", "pos", F.col("r_speaker").alias("speaker"))
        .agg(F.sum(ms).alias("overlap_ms"), F.min(F.struct("r_start_ms", "r_pos")).alias("first"))
    )


def dominant_speaker(segments: DataFrame, spans: DataFrame, fallback: str = "SPEAKER_00", bucket: int = 60_000) -> DataFrame:
    """Each segment with the speaker that overlaps it most; ties to the one that begins first, none: fallback."""
    best = overlaps_by_speaker(segments, spans, bucket).groupBy("media", "pos").agg(F.min(F.struct((-F.col("overlap_ms")).alias("most"), "first", "speaker")).alias("b"))
    return segments.join(best, ["media", "pos"], "left").withColumn("dominant", F.coalesce("b.speaker", F.lit(fallback))).drop("b")


def priority_speaker(items: DataFrame, spans: DataFrame, fallback: str = "SPEAKER_00", bucket: int = 60_000) -> DataFrame:
    """Each item with a speaker: of the span that holds its start if others overlap too, else the one with
    most overlap, else of the span that holds its middle, else the fallback (J08)."""
    narrow, s = items.select("media", "pos", "start_ms", "end_ms"), spans.select("media", "pos", "start_ms", "end_ms", "speaker")
    first = F.min(F.struct("r_start_ms", "r_pos", "r_speaker"))
    probe = F.least("end_ms", F.col("start_ms") + 1)
    pairs = overlap_join(narrow, s, ["media"], bucket, closed=True)
    long = F.col("end_ms") > F.col("start_ms")
    amount = F.greatest(F.lit(0), F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms"))
    by_speaker = pairs.withColumn("ms", amount).groupBy("media", "pos", "start_ms", "end_ms", "r_speaker").agg(
        F.sum("ms").alias("ms"),
        F.min(F.when(F.col("ms") > 0, F.struct("r_start_ms", "r_pos"))).alias("first"),
        F.min(F.when((F.col("r_start_ms") <= probe) & (probe < F.col("r_end_ms")), F.struct("r_start_ms", "r_pos", "r_speaker"))).alias("at_start"),
        F.min(F.when((F.col("r_start_ms") * 2 <= F.col("start_ms") + F.col("end_ms")) & (F.col("start_ms") + F.col("end_ms") <= F.col("r_end_ms") * 2), F.struct("r_start_ms", "r_pos", "r_speaker"))).alias("at_mid"),
    )
    chosen = by_speaker.groupBy("media", "pos", "start_ms", "end_ms").agg(
        F.min("at_start").alias("s"),
        F.min(F.when(F.col("ms") > 0, F.struct((-F.col("ms")).alias("most"), "first", "r_speaker"))).alias("m"),
        F.min("at_mid").alias("c"),
        F.collect_set(F.when(F.col("ms") > 0, F.col("r_speaker"))).alias("heard"),
    )
    other = F.size(F.array_except("heard", F.array("s.r_speaker"))) > 0
    pick = F.coalesce(F.when(long & F.col("s").isNotNull() & other, F.col("s.r_speaker")), F.col("m.r_speaker"), F.col("c.r_speaker"))
    return items.join(chosen.select("media", "pos", pick.alias("_p")), ["media", "pos"], "left").withColumn("chosen", F.coalesce("_p", F.lit(fallback))).drop("_p")


def nearest_span(items: DataFrame, spans: DataFrame, bucket: int = 60_000) -> DataFrame:
    """Each item with the first span that holds its middle, else the span with the nearest end or start.

    The nearest boundary behind and ahead are running aggregates over the media's spans and items in time
    order, not found by comparing all pairs. Distances are in half milliseconds; ties go to the span that
    begins first.
    """
    mid = (F.col("start_ms") + F.col("end_ms")).alias("t2")
    points = items.select("media", "pos", mid)
    inside = overlap_join(points.select("media", "pos", F.floor(F.col("t2") / 2).alias("start_ms"), F.ceil(F.col("t2") / 2).alias("end_ms"), "t2"), spans.select("media", "pos", "start_ms", "end_ms", "speaker"), ["media"], bucket, closed=True)
    inside = inside.where((F.col("r_start_ms") * 2 <= F.col("t2")) & (F.col("t2") <= F.col("r_end_ms") * 2)).groupBy("media", "pos").agg(F.min(F.struct("r_start_ms", "r_pos", "r_speaker")).alias("inside"))
    edge = lambda c: spans.select("media", (F.col(c) * 2).alias("t2"), F.lit(None).cast("long").alias("pos"), F.struct(F.col("start_ms").alias("s"), F.col("pos").alias("p"), "speaker").alias("e"))
    # Of edges at one time the span that begins first counts.
    edges = edge("start_ms").unionByName(edge("end_ms")).groupBy("media", "t2").agg(F.min("e").alias("e")).withColumn("pos", F.lit(None).cast("long"))
    line = points.withColumn("e", F.lit(None).cast(edges.schema["e"].dataType)).unionByName(edges).withColumn("kind", F.col("pos").isNotNull())
    edge_here = F.when(~F.col("kind"), F.struct("t2", "e"))
    line = running(line, "b", edge_here, F.col("t2"), ("t2", "kind", "pos"), bucket=20 * bucket)
    line = running(line, "a", edge_here, F.col("t2"), ("t2", "kind", "pos"), F.min, F.least, ahead=True, bucket=20 * bucket)
    near = line.where("kind")
    best = F.least(F.when(F.col("b").isNotNull(), F.struct((F.col("t2") - F.col("b.t2")).alias("d"), F.col("b.e").alias("e"))), F.when(F.col("a").isNotNull(), F.struct((F.col("a.t2") - F.col("t2")).alias("d"), F.col("a.e").alias("e"))))
    found = near.select("media", "pos", best.alias("n")).join(inside, ["media", "pos"], "left")
    found = found.select("media", "pos", F.coalesce("inside.r_speaker", "n.e.speaker").alias("nearest"), F.when(F.col("inside").isNotNull(), F.lit(0)).otherwise(F.col("n.d")).cast("long").alias("half_ms"))
    return items.join(found, ["media", "pos"], "left")


def merge_ranges(ranges: DataFrame, cfg: Speech = Speech(), pad: bool = True) -> DataFrame:
    """(media, island, start_ms, end_ms, parts): ranges padded, short ones dropped, near ones merged.

    Ranges at most merge_gap_ms apart merge; the end is the largest.
    """
    by = cfg.keep_silence_ms if pad else 0
    rows = ranges.select("media", "pos", F.greatest(F.lit(0), F.col("start_ms") - by).alias("start_ms"), (F.col("end_ms") + by).alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= cfg.min_chunk_ms)
    order = ("start_ms", "pos")
    rows = running(rows, "reach", F.col("end_ms"), F.col("start_ms"), order, own=False)
    rows = rows.withColumn("new", (F.col("reach").isNull() | (F.col("start_ms") - F.col("reach") > cfg.merge_gap_ms)).cast("int"))
    rows = running(rows, "island", F.col("new"), F.col("start_ms"), order, F.sum, _added)
    return rows.groupBy("media", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("parts"))


def chunks(ranges: DataFrame, cfg: Speech = Speech()) -> DataFrame:
    """Ranges cut into pieces of max_chunk_ms, the last one shorter; an empty range gives none."""
    starts = F.sequence("start_ms", F.greatest(F.col("end_ms") - 1, F.col("start_ms")), F.lit(cfg.max_chunk_ms).cast("long"))
    cut = ranges.where(F.col("end_ms") > F.col("start_ms")).withColumn("chunk_start", F.explode(starts))
    return cut.withColumn("chunk_end", F.least(F.col("chunk_start") + cfg.max_chunk_ms, F.col("end_ms")))


def conflict_groups(ranges: DataFrame) -> DataFrame:
    """Ranges with the group of strictly overlapping ranges that they are connected to, and its size.

    Equal empty ranges conflict with one another. Groups are numbered in time order within a media.
    """
    order = ("start_ms", "end_ms", "pos")
    rows = running(ranges, "_reach", F.col("end_ms"), F.col("start_ms"), order, own=False)
    # Equal empty ranges stand together; one that has another before it opens no group.
    point = F.col("start_ms") == F.col("end_ms")
    again = point & (F.count(F.lit(1)).over(Window.partitionBy("media", "start_ms", "end_ms").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)) > 0)
    new = F.col("_reach").isNull() | ((F.col("start_ms") >= F.col("_reach")) & ~again)
    rows = running(rows.withColumn("_new", new.cast("int")), "conflict_group", F.col("_new"), F.col("start_ms"), order, F.sum, _added).drop("_new", "_reach")
    return rows.withColumn("conflict_size", F.count(F.lit(1)).over(Window.partitionBy("media", "conflict_group")))


def fragments(segments: DataFrame, cfg: Turns = Turns()) -> DataFrame:
    """(media, speaker, dur_ms, n, mid, first_pos, is_fragment): speakers with little time or few segments."""
    dur = F.col("end_ms") - F.col("start_ms")
    per = segments.groupBy("media", "speaker").agg(F.sum(dur).alias("dur_ms"), F.count(F.lit(1)).alias("n"), F.try_divide(F.sum((F.col("start_ms") + F.col("end_ms")) / 2 * dur), F.sum(dur)).alias("mid"), F.min("pos").alias("first_pos"))
    total = F.sum("dur_ms").over(Window.partitionBy("media"))
    return per.withColumn("is_fragment", (F.col("dur_ms") < F.greatest(F.lit(cfg.fragment_ms), total * cfg.fragment_share)) | (F.col("n") < cfg.fragment_count))


def merge_fragments(segments: DataFrame, cfg: Turns = Turns()) -> DataFrame:
    """Segments of fragment speakers go to the major speaker whose mean time is nearest, ties to the one seen
    first (J10). `merged_from` keeps the speaker before. Media without fragments or majors stay as they are."""
    stats = fragments(segments, cfg)
    majors = stats.where("NOT is_fragment").groupBy("media").agg(F.sort_array(F.collect_list(F.struct("first_pos", "speaker", "mid"))).alias("majors"))  # speakers of one media
    small = stats.where("is_fragment").select("media", "speaker", F.lit(True).alias("small"))
    rows = segments.join(small, ["media", "speaker"], "left").join(majors, "media", "left")
    t = (F.col("start_ms") + F.col("end_ms")) / 2
    near = F.array_min(F.transform("majors", lambda m: F.struct(F.abs(m["mid"] - t).alias("d"), m["first_pos"].alias("p"), m["speaker"].alias("speaker"))))["speaker"]
    moved = F.coalesce(F.col("small"), F.lit(False)) & (F.size("majors") > 0)
    rows = rows.withColumn("_to", F.when(moved, near)).withColumn("merged_from", F.when(moved, F.col("speaker"))).withColumn("speaker", F.coalesce("_to", "speaker"))
    return rows.drop("_to", "small", "majors")
