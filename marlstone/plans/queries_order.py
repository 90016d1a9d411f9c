"""Queries over time and order: neighbours, intervals, islands, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.adapters import EMO, SEG, SPAN, emotions, segments, spans, table
from marlstone.config import Turns
from marlstone.functions import policy
from marlstone.operators import intervals, select, sequence, turns
from marlstone.plans.registry import query
from marlstone.sources import writers

LABEL = "CASE label WHEN 'anger' THEN 'angry' WHEN 'happiness' THEN 'happy' WHEN 'surprise' THEN 'surprised' WHEN 'happy/sad' THEN 'sad' ELSE 'neutral' END"


def seg(spark: SparkSession, d: str) -> DataFrame:
    return segments(table(spark, d, "conversations"))


def span(spark: SparkSession, d: str) -> DataFrame:
    return spans(table(spark, d, "events"))


def emo(spark: SparkSession, d: str) -> DataFrame:
    return emotions(table(spark, d, "conversations"))


@query(f"""WITH {EMO} SELECT emotion, count(*) AS n, round(min(score), 6) AS least, round(max(score), 6) AS most, round(avg(score), 6) AS mean
FROM (SELECT CASE WHEN score < 0.5 OR (end_ms - start_ms) / 1000.0 < 0.8 THEN 'neutral' ELSE {LABEL} END AS emotion, score FROM emo) GROUP BY emotion""")
def q04_emotion_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Canonical emotions with thresholds, and their scores."""
    e = emo(spark, d)
    label = policy.normalize_emotion(F.col("label"), F.col("score"), (F.col("end_ms") - F.col("start_ms")) / 1000)
    return e.groupBy(label.alias("emotion")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most"), F.round(F.avg("score"), 6).alias("mean"))


RELIABLE = f"""rel AS (SELECT *, status = 'success' AS reliable, CASE WHEN status = 'success' THEN {LABEL} ELSE 'neutral' END AS emotion, CASE WHEN status = 'success' THEN score ELSE 0.0 END AS emotion_score
  FROM (SELECT *, CASE WHEN (end_ms - start_ms) / 1000.0 < 0.8 THEN 'too_short' WHEN score < 0.5 OR score > 1 THEN 'low_confidence' WHEN label = 'other' THEN 'unknown_label' ELSE 'success' END AS status FROM emo))"""


@query(f"WITH {EMO}, {RELIABLE} SELECT media, pos, status, emotion, reliable FROM rel")
def q05_emotion_reliability(spark: SparkSession, d: str) -> DataFrame:
    """The status ladder of emotion rows."""
    return sequence.emotion_reliability(emo(spark, d)).select("media", "pos", "status", "emotion", "reliable")


@query(f"""WITH {EMO}, {RELIABLE}, n AS (SELECT *, lag(speaker) OVER w AS bs, lag(reliable) OVER w AS br, lag(end_ms) OVER w AS be, lag(emotion) OVER w AS bm, lag(emotion_score) OVER w AS bx,
  lead(speaker) OVER w AS ns, lead(reliable) OVER w AS nr, lead(start_ms) OVER w AS nst, lead(emotion) OVER w AS nm, lead(emotion_score) OVER w AS nx FROM rel WINDOW w AS (PARTITION BY media ORDER BY pos)),
u AS (SELECT *, coalesce(bs = speaker AND br AND abs(start_ms - be) <= 1500, false) AS ub, coalesce(ns = speaker AND nr AND abs(nst - end_ms) <= 1500, false) AS un FROM n),
t AS (SELECT *, NOT reliable AND status IN ('too_short', 'low_confidence') AND (ub OR un) AND (NOT (ub AND un) OR bm = nm) AS take FROM u)
SELECT media, pos, CASE WHEN NOT take THEN emotion WHEN ub AND (NOT un OR bx >= nx) THEN bm ELSE nm END AS emotion, CASE WHEN take THEN 'neighbour' WHEN reliable THEN 'model' ELSE 'fallback' END AS source FROM t""")
def q06_emotion_smoothing(spark: SparkSession, d: str) -> DataFrame:
    """Unsure rows take the emotion of reliable neighbours of their speaker."""
    return sequence.smooth_emotions(sequence.emotion_reliability(emo(spark, d))).select("media", "pos", "emotion", "source")


@query(f"""WITH {SEG} SELECT media, pos, length(lag(text, 1, '') OVER w) AS before, length(lead(text, 1, '') OVER w) AS after, coalesce(len(regexp_extract_all(text, '[\\pL\\pN_]+')) <= 2 AND lead(speaker) OVER w = speaker, false) AS merge_suggested FROM (SELECT media, pos, speaker, substr(text, 1, 9) AS text FROM seg) WINDOW w AS (PARTITION BY media ORDER BY pos)""")
def q07_neighbor_context(spark: SparkSession, d: str) -> DataFrame:
    """Texts before and after, and whether a tiny text could join the next."""
    rows = sequence.neighbours(seg(spark, d).withColumn("text", F.substring("text", 1, 9)))
    return rows.select("media", "pos", F.length("previous_text").cast("long").alias("before"), F.length("next_text").cast("long").alias("after"), "merge_suggested")


PAIRS = SPAN + """, pair AS (SELECT a.media, a.pos, a.start_ms, a.end_ms, b.pos AS r_pos, b.start_ms AS r_start, b.end_ms AS r_end, b.speaker AS r_speaker, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS ms
  FROM span a JOIN span b ON a.media = b.media AND a.kind = 'view' AND b.kind = 'purchase' AND b.start_ms <= a.end_ms AND a.start_ms <= b.end_ms)"""


def views(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = span(spark, d)
    return s.where("kind = 'view'"), s.where("kind = 'purchase'")


@query(f"WITH {PAIRS} SELECT media, pos, r_speaker AS speaker, CAST(sum(ms) AS BIGINT) AS overlap_ms FROM pair WHERE ms > 0 GROUP BY ALL")
def q26_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap by speaker of intervals."""
    return intervals.overlaps_by_speaker(*views(spark, d)).select("media", "pos", "speaker", "overlap_ms")


@query(f"""WITH {PAIRS}, o AS (SELECT media, pos, r_speaker, sum(ms) AS ms, min(r_start) AS s, arg_min(r_pos, (r_start, r_pos)) AS p FROM pair WHERE ms > 0 GROUP BY ALL),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY media, pos ORDER BY ms DESC, s, p) = 1)
SELECT a.media, a.pos, coalesce(r_speaker, 'SPEAKER_00') AS dominant FROM span a LEFT JOIN b ON a.media = b.media AND a.pos = b.pos WHERE a.kind = 'view'""")
def q27_dominant_speaker(spark: SparkSession, d: str) -> DataFrame:
    """The speaker that overlaps each interval most."""
    return intervals.dominant_speaker(*views(spark, d)).select("media", "pos", "dominant")


@query(f"""WITH {PAIRS}, o AS (SELECT media, pos, r_speaker, sum(ms) AS ms, min((r_start, r_pos)) AS f FROM pair WHERE ms > 0 GROUP BY ALL),
m AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY media, pos ORDER BY ms DESC, f) = 1),
st AS (SELECT media, pos, r_speaker FROM pair WHERE end_ms > start_ms AND r_start <= least(end_ms, start_ms + 1) AND least(end_ms, start_ms + 1) < r_end QUALIFY row_number() OVER (PARTITION BY media, pos ORDER BY r_start, r_pos) = 1),
s AS (SELECT st.* FROM st WHERE EXISTS (SELECT 1 FROM o WHERE o.media = st.media AND o.pos = st.pos AND o.r_speaker <> st.r_speaker)),
c AS (SELECT media, pos, r_speaker FROM pair WHERE r_start * 2 <= start_ms + end_ms AND start_ms + end_ms <= r_end * 2 QUALIFY row_number() OVER (PARTITION BY media, pos ORDER BY r_start, r_pos) = 1)
SELECT a.media, a.pos, coalesce(s.r_speaker, m.r_speaker, c.r_speaker, 'SPEAKER_00') AS chosen FROM span a LEFT JOIN s USING (media, pos) LEFT JOIN m USING (media, pos) LEFT JOIN c USING (media, pos) WHERE a.kind = 'view'""")
def q28_priority_speaker(spark: SparkSession, d: str) -> DataFrame:
    """A speaker by start, overlap, middle or fallback, in this order."""
    return intervals.priority_speaker(*views(spark, d)).select("media", "pos", "chosen")


@query(f"""WITH {SPAN}, x AS (SELECT a.media, a.pos, b.speaker, CASE WHEN b.start_ms * 2 <= a.start_ms + a.end_ms AND a.start_ms + a.end_ms <= b.end_ms * 2 THEN 0 ELSE least(abs(a.start_ms + a.end_ms - 2 * b.start_ms), abs(a.start_ms + a.end_ms - 2 * b.end_ms)) END AS half_ms,
  NOT (b.start_ms * 2 <= a.start_ms + a.end_ms AND a.start_ms + a.end_ms <= b.end_ms * 2) AS outside, b.start_ms, b.pos AS r_pos FROM span a JOIN span b ON a.media = b.media AND a.kind = 'view' AND b.kind = 'purchase')
SELECT a.media, a.pos, x.speaker AS nearest, CAST(x.half_ms AS BIGINT) AS half_ms FROM span a LEFT JOIN (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY media, pos ORDER BY outside, half_ms, start_ms, r_pos) = 1) x ON a.media = x.media AND a.pos = x.pos WHERE a.kind = 'view'""")
def q29_nearest_span(spark: SparkSession, d: str) -> DataFrame:
    """The span around or nearest to the middle of each interval."""
    return intervals.nearest_span(*views(spark, d)).select("media", "pos", "nearest", "half_ms")


@query(f"""WITH {SEG}, st AS (SELECT media, speaker, sum(end_ms - start_ms) AS dur, count(*) AS n, sum((start_ms + end_ms) / 2 * (end_ms - start_ms)) / sum(end_ms - start_ms) AS mid, min(pos) AS f FROM seg GROUP BY ALL),
fr AS (SELECT *, dur < greatest(1500, sum(dur) OVER (PARTITION BY media) * 0.03) OR n < 2 AS frag FROM st)
SELECT seg.media, seg.pos, coalesce(m.speaker, seg.speaker) AS speaker, CASE WHEN m.speaker IS NOT NULL THEN seg.speaker END AS merged_from
FROM seg JOIN fr USING (media, speaker) LEFT JOIN (SELECT seg.media, seg.pos, fr.speaker FROM seg JOIN fr mine USING (media, speaker) JOIN fr ON fr.media = seg.media AND NOT fr.frag WHERE mine.frag QUALIFY row_number() OVER (PARTITION BY seg.media, seg.pos ORDER BY abs(fr.mid - (seg.start_ms + seg.end_ms) / 2), fr.f) = 1) m ON m.media = seg.media AND m.pos = seg.pos""")
def q30_nearest_major(spark: SparkSession, d: str) -> DataFrame:
    """Speakers with little time join the major speaker nearest in time."""
    return intervals.merge_fragments(seg(spark, d)).select("media", "pos", "speaker", "merged_from")


@query(f"""WITH {SPAN}, p AS (SELECT media, pos, greatest(0, start_ms - 180) AS s, end_ms + 180 AS e FROM span), q AS (SELECT *, CASE WHEN coalesce(s - max(e) OVER (PARTITION BY media ORDER BY s, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 350, false) THEN 0 ELSE 1 END AS new FROM p WHERE e - s >= 350),
g AS (SELECT *, sum(new) OVER (PARTITION BY media ORDER BY s, pos ROWS UNBOUNDED PRECEDING) AS island FROM q)
SELECT media, CAST(island AS BIGINT) AS island, min(s) AS start_ms, max(e) AS end_ms, count(*) AS parts FROM g GROUP BY media, island""")
def q31_silence_merge(spark: SparkSession, d: str) -> DataFrame:
    """Speech ranges padded and merged over short silences."""
    return intervals.merge_ranges(span(spark, d))


@query(f"""WITH {SPAN} SELECT media, pos, CAST(c AS BIGINT) AS chunk_start, CAST(least(c + 25000, end_ms) AS BIGINT) AS chunk_end FROM (SELECT media, pos, end_ms, unnest(range(start_ms, end_ms, 25000)) AS c FROM span WHERE end_ms > start_ms)""")
def q32_chunking(spark: SparkSession, d: str) -> DataFrame:
    """Long ranges cut to fixed size."""
    return intervals.chunks(span(spark, d)).select("media", "pos", "chunk_start", "chunk_end")


@query(f"""WITH {SPAN}, q AS (SELECT media, pos, CASE WHEN coalesce(start_ms < max(end_ms) OVER w, false) THEN 0 ELSE 1 END AS new, start_ms, end_ms FROM span WINDOW w AS (PARTITION BY media ORDER BY start_ms, end_ms, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY media ORDER BY start_ms, end_ms, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS conflict_group FROM q)
SELECT media, pos, conflict_group, count(*) OVER (PARTITION BY media, conflict_group) AS conflict_size FROM g""")
def q33_conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of overlapping ranges."""
    return intervals.conflict_groups(span(spark, d)).select("media", "pos", "conflict_group", "conflict_size")


@query(f"""WITH {SEG}, q AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS new FROM seg WINDOW w AS (PARTITION BY media ORDER BY pos)), g AS (SELECT *, sum(new) OVER (PARTITION BY media ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS run FROM q)
SELECT media, CAST(run AS BIGINT) AS run, speaker, min(pos) AS first_pos, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY media, run, speaker""")
def q34_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one speaker."""
    return sequence.runs(seg(spark, d))


@query(f"""WITH {SEG} SELECT media, pos, coalesce(last_value(nullif(speaker, 'SPEAKER_00') IGNORE NULLS) OVER (PARTITION BY media ORDER BY pos ROWS UNBOUNDED PRECEDING), 'SPEAKER_00') AS filled FROM seg""")
def q35_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """Unknown speakers take the last known one."""
    return sequence.forward_fill(seg(spark, d)).select("media", "pos", "filled")


@query(f"""WITH RECURSIVE {SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY pos) AS k FROM seg),
f AS (SELECT media, k, pos AS first_pos, speaker, start_ms, end_ms, 1 AS parts, 0 AS id FROM n WHERE k = 1
  UNION ALL SELECT n.media, n.k, CASE WHEN j THEN first_pos ELSE n.pos END, n.speaker, CASE WHEN j THEN f_start ELSE n.start_ms END, n.end_ms, CASE WHEN j THEN parts + 1 ELSE 1 END, CASE WHEN j THEN id ELSE id + 1 END
  FROM (SELECT f.media AS fm, f.k AS fk, f.first_pos, f.parts, f.id, f.start_ms AS f_start, m.pos AS mp, f.speaker = m.speaker AND m.start_ms - f.end_ms <= 500 AND (f.end_ms - f.start_ms < 1500 OR m.end_ms - m.start_ms < 1500) AS j FROM f JOIN n m ON m.media = f.media AND m.k = f.k + 1) x JOIN n ON n.media = x.fm AND n.pos = x.mp)
SELECT media, id, first_pos, speaker, start_ms, end_ms, parts FROM f QUALIFY row_number() OVER (PARTITION BY media, id ORDER BY k DESC) = 1""")
def q36_adjacent_merge(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring segments of a speaker merged while short."""
    return sequence.merge_adjacent(seg(spark, d)).drop("text")


@query(f"""WITH RECURSIVE {SEG}, n AS (SELECT media, speaker, start_ms, end_ms, row_number() OVER (PARTITION BY media ORDER BY start_ms, pos) AS k FROM seg),
f AS (SELECT preset, most, gap, media, k, [{{'speaker': speaker, 'start_ms': start_ms, 'end_ms': end_ms}}] AS st FROM n, (VALUES ('narrow', 500, 150), ('wide', 1500, 600)) AS p(preset, most, gap) WHERE k = 1
  UNION ALL SELECT preset, most, gap, f.media, n.k,
    CASE WHEN len(st) >= 2 AND st[-2].speaker = n.speaker AND st[-1].speaker <> n.speaker AND st[-1].end_ms - st[-1].start_ms <= most AND st[-1].start_ms - st[-2].end_ms <= gap AND n.start_ms - st[-1].end_ms <= gap
      THEN list_append(st[1:len(st) - 2], {{'speaker': n.speaker, 'start_ms': st[-2].start_ms, 'end_ms': n.end_ms}}) ELSE list_append(st, {{'speaker': n.speaker, 'start_ms': n.start_ms, 'end_ms': n.end_ms}}) END
  FROM f JOIN n ON n.media = f.media AND n.k = f.k + 1)
SELECT preset, media, CAST(i AS INTEGER) AS id, x.speaker AS speaker, x.start_ms AS start_ms, x.end_ms AS end_ms
FROM (SELECT preset, media, unnest(range(len(st))) AS i, unnest(st) AS x FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY preset, media ORDER BY k DESC) = 1))""")
def q37_island_smoothing(spark: SparkSession, d: str) -> DataFrame:
    """Short A-B-A islands collapsed, with the preset and with a wider one."""
    rows = seg(spark, d)
    wide = Turns(island_ms=1500, island_gap_ms=600)
    return sequence.smooth_islands(rows).withColumn("preset", F.lit("narrow")).unionByName(sequence.smooth_islands(rows, wide).withColumn("preset", F.lit("wide")))


@query(f"""WITH RECURSIVE {SPAN}, c AS (SELECT media, speaker, pos, start_ms, end_ms - start_ms AS ms, pos % 10 AS score FROM span WHERE end_ms - start_ms >= 500),
b AS (SELECT * FROM (SELECT *, count(*) FILTER (ms <= 10000) OVER (PARTITION BY media, speaker) AS nb FROM c) WHERE nb = 0 OR ms <= 10000),
n AS (SELECT *, row_number() OVER (PARTITION BY media, speaker ORDER BY score DESC, ms DESC, pos) AS k FROM b),
f AS (SELECT media, speaker, k, ms AS total, [pos] AS chosen FROM n WHERE k = 1
  UNION ALL SELECT f.media, f.speaker, n.k, CASE WHEN total < 10000 AND total + n.ms <= 10000 THEN total + n.ms ELSE total END, CASE WHEN total < 10000 AND total + n.ms <= 10000 THEN list_append(chosen, n.pos) ELSE chosen END FROM f JOIN n ON n.media = f.media AND n.speaker = f.speaker AND n.k = f.k + 1)
SELECT media, speaker, len(chosen) AS n, total AS total_ms, CAST(list_sum(chosen) AS BIGINT) AS ids FROM f QUALIFY row_number() OVER (PARTITION BY media, speaker ORDER BY k DESC) = 1""")
def q38_greedy_reference(spark: SparkSession, d: str) -> DataFrame:
    """Clips of a voice reference, best first and skipping what is too long."""
    out = sequence.pick_references(span(spark, d).withColumn("score", F.col("pos") % 10))
    return out.select("media", "speaker", F.col("n").cast("long").alias("n"), "total_ms", F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))


@query(f"""WITH {SPAN} SELECT media, speaker, pos, CAST(before_ms AS BIGINT) AS before_ms FROM (SELECT *, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY media, speaker ORDER BY start_ms, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ms FROM span) WHERE before_ms <= 10000""")
def q39_prefix_reference(spark: SparkSession, d: str) -> DataFrame:
    """Clips in time order until the length is reached."""
    return sequence.reference_prefix(span(spark, d)).select("media", "speaker", "pos", "before_ms")


@query(f"""WITH RECURSIVE {SPAN}, r AS (SELECT media, pos, start_ms, end_ms, list_filter(list_transform(range(1, (end_ms - start_ms) // 7000 + 1), lambda i: {{'a': start_ms + i * 7000 + pos % 900, 'b': start_ms + i * 7000 + pos % 900 + 300}}), lambda p: (p.a - start_ms) % 3 <> 0) AS pauses FROM span WHERE end_ms - start_ms > 20000),
f AS (SELECT media, pos, end_ms, pauses, start_ms AS c, -1 AS part, false AS done, start_ms AS s, start_ms AS e, '' AS reason FROM r
  UNION ALL SELECT media, pos, end_ms, pauses, cut, part + 1, stop, c, CASE WHEN stop THEN end_ms ELSE cut END, CASE WHEN stop THEN 'range_end' WHEN near IS NULL THEN 'unsafe_continuous_speech' ELSE 'natural_pause' END
  FROM (SELECT *, end_ms - c <= 25000 OR near IS NULL AND end_ms - c <= 45000 AS stop, coalesce(near, c + 45000) AS cut
    FROM (SELECT *, (list_sort(list_transform(list_filter(pauses, lambda p: p.a >= c + 20000 AND p.b <= least(end_ms, c + 30000)), lambda p: {{'d': abs((p.a + p.b) // 2 - c - 25000), 'a': p.a, 'cut': (p.a + p.b) // 2}}))[1]).cut AS near FROM f WHERE NOT done)))
SELECT media, pos, part, s AS part_start, e AS part_end, reason FROM f WHERE part >= 0""")
def q40_pause_split(spark: SparkSession, d: str) -> DataFrame:
    """Long ranges cut at pauses near a soft target."""
    rows = span(spark, d).where("end_ms - start_ms > 20000")
    pauses = F.transform(F.sequence(F.lit(1), F.floor((F.col("end_ms") - F.col("start_ms")) / 7000).cast("int")), lambda i: F.struct((F.col("start_ms") + i * 7000 + F.col("pos") % 900).alias("a"), (F.col("start_ms") + i * 7000 + F.col("pos") % 900 + 300).alias("b")))
    return sequence.split_on_pauses(rows.withColumn("pauses", F.filter(pauses, lambda p: (p["a"] - F.col("start_ms")) % 3 != 0)))


def _words(rows: DataFrame) -> DataFrame:
    """Words of segments with times in proportion to their place."""
    listed = rows.select("media", "pos", "start_ms", "end_ms", F.split(F.trim("text"), r"\s+").alias("all"))
    w = listed.select("media", "pos", "start_ms", "end_ms", F.size("all").alias("n"), F.posexplode("all").alias("word", "said"))
    at = lambda k: (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * k / F.col("n"))).cast("long")
    return w.select("media", "pos", "word", "said", at(F.col("word")).alias("start_ms"), at(F.col("word") + 1).alias("end_ms"))


@query()
def q41_turn_split(spark: SparkSession, d: str) -> DataFrame:
    """Segments split where their words change speaker, and the whole assignment."""
    rows = seg(spark, d)
    half = rows.select("media", (F.col("pos") * 2).alias("pos"), "start_ms", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("end_ms"), "speaker")
    rest = rows.select("media", (F.col("pos") * 2 + 1).alias("pos"), F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("start_ms"), "end_ms", F.concat(F.lit("SPEAKER_0"), (F.col("pos") % 3).cast("string")).alias("speaker"))
    return turns.assign_speakers(rows.drop("speaker"), _words(rows), half.unionByName(rest))


@query(f"""WITH {SPAN}, t AS (SELECT media, pos, (end_ms - start_ms) / 1000.0 AS a, (end_ms - start_ms + (pos % 9 - 4) * 250) / 1000.0 AS b FROM span)
SELECT media, pos, CASE WHEN a > 0 AND b > 0 AND abs(a - b) <= greatest(0.6, b * 0.25) THEN 'passed' ELSE 'failed' END AS quality, round(CASE WHEN b <= 0.1 OR abs(a - b) < 0.2 THEN 1.0 ELSE greatest(0.6, least(2.0, a / b)) END, 6) AS tempo FROM t""")
def q45_duration_quality(spark: SparkSession, d: str) -> DataFrame:
    """Whether durations fit, and the tempo that makes them fit."""
    a = (F.col("end_ms") - F.col("start_ms")) / 1000
    b = (F.col("end_ms") - F.col("start_ms") + (F.col("pos") % 9 - 4) * 250) / 1000
    return span(spark, d).select("media", "pos", policy.duration_quality(a, b)["duration_quality"].alias("quality"), F.round(policy.tempo_factor(a, b), 6).alias("tempo"))


@query(f"""WITH {SEG} SELECT media, pos, len(t) AS n, round(list_sum(t), 3) AS total FROM (SELECT media, pos, list_distinct(list_transform([0.2, 0.5, 0.8], lambda f: round(start_ms / 1000.0 + (end_ms - start_ms) / 1000.0 * CAST(f AS DOUBLE), 1))) AS t FROM seg)""")
def q54_frame_times(spark: SparkSession, d: str) -> DataFrame:
    """Sampling times inside segments."""
    t = policy.frame_times(F.col("start_ms") / 1000, F.col("end_ms") / 1000, digits=1)
    return seg(spark, d).select("media", "pos", t.alias("t")).select("media", "pos", F.size("t").cast("long").alias("n"), F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query(f"""WITH {SEG} SELECT problem, count(*) AS n FROM (SELECT CASE WHEN end_ms <= start_ms THEN 'empty' WHEN start_ms < lag(end_ms) OVER w THEN 'overlap' WHEN end_ms > 4000 THEN 'beyond' END AS problem FROM seg WINDOW w AS (PARTITION BY media ORDER BY pos)) WHERE problem IS NOT NULL GROUP BY problem""")
def q55_segment_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break the order and range of segments."""
    w = sequence.order()
    p = F.when(F.col("end_ms") <= F.col("start_ms"), "empty").when(F.col("start_ms") < F.lag("end_ms").over(w), "overlap").when(F.col("end_ms") > 4000, "beyond")
    return seg(spark, d).withColumn("problem", p).where("problem IS NOT NULL").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SEG} SELECT printf('%d-%08d-%08d', media, start_ms, end_ms) || ' ' || media || ' ' || printf('%.3f', start_ms / 1000.0) || ' ' || printf('%.3f', end_ms / 1000.0) AS value FROM seg WHERE end_ms > start_ms""")
def q60_segment_list(spark: SparkSession, d: str) -> DataFrame:
    """Segment lists as diarisation programs read them."""
    return writers.segment_list(seg(spark, d))


@query(f"""WITH {SEG} SELECT media, pos, CAST(floor((row_number() OVER (PARTITION BY media ORDER BY pos) - 1) / 3) AS BIGINT) AS batch FROM seg""")
def q61_batches(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-size batches in order."""
    return select.batches(seg(spark, d), 3).select("media", "pos", "batch")


@query(rf"""WITH {SEG} SELECT CASE WHEN pos % 3 = 0 AND upper(replace(text, 'ß', 'ss')) <> text THEN 'invalidated_text_changed' WHEN pos % 5 = 4 AND len(string_split_regex(trim(text), '\s+')) >= 2 THEN 'invalidated_invalid_bounds' ELSE 'unchanged_valid_bounds' END AS stamp_status, count(*) AS n FROM seg GROUP BY 1""")
def q62_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Word times dropped where the text changed or a time is out of order."""
    rows = seg(spark, d)
    stamps = _words(rows).groupBy("media", "pos").agg(F.array_sort(F.collect_list(F.struct("word", "said", "start_ms", "end_ms"))).alias("w"))
    listed = F.transform("w", lambda x: F.struct(x["said"].alias("text"), (x["start_ms"] / 1000).alias("start"), (x["end_ms"] / 1000 + F.when((F.col("pos") % 5 == 4) & (x["word"] == 1), 9.0).otherwise(0.0)).alias("end")))
    given = rows.join(stamps, ["media", "pos"]).select("media", "pos", "text", F.upper("text").alias("corrected"), (F.col("pos") % 3 == 0).alias("accepted"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), listed.alias("stamps"))
    return sequence.update_stamps(given).groupBy("stamp_status").agg(F.count(F.lit(1)).alias("n"))
