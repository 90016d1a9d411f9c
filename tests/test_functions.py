"""Column functions and operators on small cases."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.config import Complexity, Emotion, Speech, Turns
from marlstone.functions import guards, policy, text, unicode
from marlstone.operators import alignment, clustering, evaluate, incremental, intervals, select, sequence, turns


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("language", "emotion", "said", "engine"),
    [
        ("zh", "neutral", "你好", "f5tts"),
        ("zh-CN", "anger", "你好", "indextts2"),
        ("chinese", "happy", "你好", "cosyvoice3"),
        ("en_US", "sad", "hello", "indextts2"),
        ("English", "surprise", "hello", "cosyvoice3"),
        ("en", "neutral", "one, two, three", "confucius4"),
        ("en", "anger", " ".join(["word"] * 20), "confucius4"),
        ("zh", "neutral", "字" * 28, "confucius4"),
        ("ja", "anger", "hello", "omnivoice"),
        ("fr", "neutral", "one, two, three", "omnivoice"),
        (None, None, None, "omnivoice"),
        ("en", "unknown", "hello", "f5tts"),
        ("en", "happy/sad", "hello", "indextts2"),
    ],
)
def test_routes(spark, language, emotion, said, engine):
    assert one(spark, policy.route(F.lit(language).cast("string"), F.lit(emotion).cast("string"), F.lit(said).cast("string")))[0] == engine


def test_emotion_thresholds(spark):
    rows = spark.createDataFrame([("happy", 0.49, 1.0), ("happy", 0.5, 1.0), ("happy", 0.9, 0.79), ("happy", 0.9, 0.8), ("happy", float("nan"), 1.0), ("happy", None, None)], "l string, s double, d double")
    got = [r[0] for r in rows.select(policy.normalize_emotion(F.col("l"), F.col("s"), F.col("d"))).collect()]
    assert got == ["neutral", "happy", "neutral", "happy", "happy", "happy"]


def test_saved_engine_stands_and_bad_one_raises(spark):
    resolve = lambda saved, has: one(spark, policy.resolve_engine(F.lit(saved).cast("string"), F.lit(has), F.lit("f5tts")))[0]
    assert tuple(resolve("omnivoice", True)) == ("omnivoice", "f5tts", False)
    assert tuple(resolve(None, False)) == ("f5tts", "f5tts", True)
    for bad in (None, "", "F5TTS"):
        with pytest.raises(Exception, match="invalid engine"):
            resolve(bad, True)


def test_names_and_numbers(spark):
    assert column(spark, ["spk3", "Speaker-12", "7", "anna", None, "speaker_100"], policy.normalize_speaker) == ["SPEAKER_03", "SPEAKER_12", "SPEAKER_07", "anna", "SPEAKER_00", "SPEAKER_100"]
    assert column(spark, ["a b/c", "é"], policy.safe_id) == ["a_b_c", "_"]
    assert column(spark, ["1", " TRUE ", "yes", "no", None], policy.truthy) == [True, True, True, False, False]
    assert column(spark, ["1.5", "x", "", None], policy.lenient_double) == [1.5, 0.0, 0.0, 0.0]


def test_duration_quality(spark):
    q = lambda a, t: one(spark, policy.duration_quality(F.lit(a), F.lit(t)))[0]["duration_quality"]
    assert (q(2.49, 5.68), q(5.6, 5.68), q(0.0, 1.0)) == ("failed", "passed", "failed")


def test_noise_and_lines(spark):
    got = column(spark, ["", " ", "see www.x.org now", "[01:22]", "12.5", "—!?", "text 1"], text.noise_reason)
    assert got == ["empty", "empty", "url", "timecode", "pure_number", "pure_symbol", ""]
    assert column(spark, ["a\n\n - b |\nc", "<ref>one</ref><quad>1</quad><ref> two </ref>", "hi(1,2),(3,4)yo(5,6),(7,8)", None], text.split_lines) == [["a", "b", "c"], ["one", "two"], ["hi", "yo"], []]
    regions = column(spark, ["hi(1,2),(3,4)"], text.regions)[0]
    assert [(r["text"], r["bbox"]) for r in regions] == [("hi", [1, 2, 3, 4])]


def test_ngrams_digits_occurrences(spark):
    assert column(spark, ["", "a", "abab"], text.ngrams) == [[], ["a"], ["ab", "ba"]]
    assert column(spark, ["at 12:30 or 12:30 or ٣", None], text.digit_tokens) == [["12:30", "٣"], []]
    assert one(spark, text.occurrences(F.lit("aaa"), F.lit("aa")))[0] == [0, 1]
    assert one(spark, text.occurrences(F.lit("😀a😀"), F.lit("😀")))[0] == [0, 2]


def test_splice(spark):
    s = lambda *a: one(spark, text.splice(*map(F.lit, a)))[0]
    assert s("a😀b", 1, 2, "😀", "X") == "aXb"
    assert s("abc", 1, 2, "x", "Y") is None
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("AA").alias("replacement")), F.struct(F.lit(2).alias("start"), F.lit(3).alias("end"), F.lit("").alias("replacement")))
    assert one(spark, text.splice_all(F.lit("abc"), edits))[0] == "AAb"


def test_candidates(spark):
    raw = [["a ", "b", "a", "", None, "c", "d", "e", "f"], [], None]
    got = column(spark, raw, lambda x: text.candidates(x, F.lit(" z ")), "array<string>")
    assert got == [["a", "b", "c", "d", "e"], ["z"], ["z"]]


def test_scripts(spark):
    e = lambda t, lang: one(spark, text.script_error(F.lit(t), F.lit(lang)))[0]
    assert e("你好", "zh") is None and e("hello", "zh").startswith("target_zh")
    assert e("hello", "english") is None and e("你好 hello", "en").startswith("target_en")
    assert e("こんにちは", "ja") is None and e("hallo", "ko") == "target_ko_missing_script"
    assert e("...", "en") == "empty_or_nonlinguistic_text"


def test_json(spark):
    assert column(spark, ['```json\n{"a":1}\n```', 'x {"a":{}} y', "none"], text.lenient_object) == ['{"a":1}', '{"a":{}}', None]
    assert column(spark, ['{"b":1,"a":[1.5]}', '{"k":1,"k":2}', "NaN", "{", None], unicode.strict_json) == ['{"a":[1.5],"b":1}', None, None, None, None]


def test_unicode(spark):
    assert column(spark, ["Ｆｕｌｌ Straße!", None], unicode.match_text) == ["fullstrasse", ""]
    assert [t["raw"] for t in unicode.tokens_of("it's 42 中文.")] == ["it's", "42", "中", "文", "."]
    rows = spark.createDataFrame([("the cat", "the bat"), ("", "x"), ("中文", "中国")], "a string, b string")
    got = [(round(r[0][0], 3), round(r[0][1], 3)) for r in rows.select(unicode.error_rates("a", "b")).collect()]
    assert got == [(0.5, 0.167), (1.0, 1.0), (0.5, 0.5)]


@given(st.text(alphabet="ab ", max_size=9), st.text(alphabet="ab ", max_size=9))
def test_distance_is_a_metric(a, b):
    d = unicode.distance(a, b)
    assert d == unicode.distance(b, a) and (d == 0) == (a == b) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))


def spans_df(spark, rows):
    return spark.createDataFrame(rows, "media long, pos long, start_ms long, end_ms long, speaker string")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 30), st.sampled_from("AB")), max_size=9), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 30), st.sampled_from("AB")), max_size=9))
def test_overlap_join_is_the_nested_loop(spark, left, right):
    a = [(1, i, s, s + n, who) for i, (s, n, who) in enumerate(left)]
    b = [(1, i, s, s + n, who) for i, (s, n, who) in enumerate(right)]
    got = sorted((r["pos"], r["r_pos"]) for r in intervals.overlap_join(spans_df(spark, a), spans_df(spark, b), ["media"], 7).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if max(x[2], y[2]) < min(x[3], y[3]))
    near = {r["pos"]: (r["nearest"], r["half_ms"]) for r in intervals.nearest_span(spans_df(spark, a).drop("speaker"), spans_df(spark, b), 7).collect()}
    for x in a:
        t = x[2] + x[3]
        inside = min(((y[2], y[1], y[4]) for y in b if 2 * y[2] <= t <= 2 * y[3]), default=None)
        best = (inside[2], 0) if inside else min(((min(abs(t - 2 * y[2]), abs(t - 2 * y[3])), y[2], y[1], y[4]) for y in b), default=None)
        assert near[x[1]] == (best if inside else (best[3], best[0]) if best else (None, None))


def seg_df(spark, rows):
    return spark.createDataFrame(rows, "media long, pos long, text string, speaker string, start_ms long, end_ms long")


def test_merge_adjacent_and_islands(spark):
    rows = [(1, 0, "a", "A", 0, 1000), (1, 1, "b", "A", 1200, 1500), (1, 2, "c", "B", 1500, 1800), (1, 3, "d", "A", 1850, 9000), (1, 4, "e", "A", 9100, 19000)]
    got = [(r["text"], r["start_ms"], r["end_ms"]) for r in sequence.merge_adjacent(seg_df(spark, rows)).orderBy("id").collect()]
    assert got == [("a b", 0, 1500), ("c", 1500, 1800), ("d", 1850, 9000), ("e", 9100, 19000)]
    spans = seg_df(spark, rows).drop("text")
    got = [(r["speaker"], r["start_ms"], r["end_ms"]) for r in sequence.smooth_islands(spans).orderBy("id").collect()]
    assert got == [("A", 0, 1000), ("A", 1200, 9000), ("A", 9100, 19000)]


def island_model(rows, limit, gap):
    out, i = [list(r) for r in rows], 1
    while i < len(out) - 1:
        a, b, c = out[i - 1 : i + 2]
        if a[0] == c[0] != b[0] and b[2] - b[1] <= limit and b[1] - a[2] <= gap and c[1] - b[2] <= gap:
            out[i - 1 : i + 2] = [[a[0], a[1], c[2]]]
            i = max(1, i - 1)
        else:
            i += 1
    return [tuple(r) for r in out]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 2), st.integers(1, 8)), min_size=3, max_size=9))
def test_islands_like_the_model(spark, parts):
    rows, t = [], 0
    for who, gap, n in parts:
        rows.append((who, t + gap * 100, t + gap * 100 + n * 100))
        t = rows[-1][2]
    df = spans_df(spark, [(1, i, s, e, w) for i, (w, s, e) in enumerate(rows)])
    got = [(r["speaker"], r["start_ms"], r["end_ms"]) for r in sequence.smooth_islands(df, Turns(island_ms=400, island_gap_ms=100)).orderBy("id").collect()]
    assert got == island_model(rows, 400, 100)


def test_pause_split(spark):
    pauses = [(24200, 24500), (30000, 30400)]
    df = spark.createDataFrame([(1, 0, 0, 62000, pauses), (1, 1, 0, 120000, []), (1, 2, 0, 30000, [])], "media long, pos long, start_ms long, end_ms long, pauses array<struct<a:long,b:long>>")
    got = {}
    for r in sequence.split_on_pauses(df).orderBy("pos", "part").collect():
        got.setdefault(r["pos"], []).append((r["part_start"], r["part_end"], r["reason"]))
    assert got[0] == [(0, 24350, "natural_pause"), (24350, 62000, "range_end")]
    assert got[1] == [(0, 45000, "unsafe_continuous_speech"), (45000, 90000, "unsafe_continuous_speech"), (90000, 120000, "range_end")]
    assert got[2] == [(0, 30000, "range_end")]


def test_references_prefer_short_clips(spark):
    df = spark.createDataFrame([(1, 0, "A", 0, 21000, 9.0), (1, 1, "A", 30000, 37000, 1.0), (1, 2, "A", 40000, 44000, 0.5), (1, 3, "A", 50000, 53000, 0.1)], "media long, pos long, speaker string, start_ms long, end_ms long, score double")
    r = sequence.pick_references(df).first()
    assert (r["positions"], r["total_ms"]) == ([1, 3], 10000)


def test_smoothing_fails_closed(spark):
    rows = [(1, 0, "t", "A", 0, 1000, "happy", 0.95), (1, 1, "t", "A", 1000, 1300, "angry", 1.0), (1, 2, "t", "B", 1300, 2300, "sad", 0.9), (1, 3, "t", "B", 2300, 4300, "sad", math.nan)]
    df = spark.createDataFrame(rows, "media long, pos long, text string, speaker string, start_ms long, end_ms long, label string, score double")
    got = {r["pos"]: (r["emotion"], r["source"], r["status"]) for r in sequence.smooth_emotions(sequence.emotion_reliability(df, Emotion())).collect()}
    assert got == {0: ("happy", "model", "success"), 1: ("happy", "neighbour", "too_short"), 2: ("sad", "model", "success"), 3: ("sad", "neighbour", "low_confidence")}


def test_stamps(spark):
    kind = "text string, corrected string, accepted boolean, start double, end double, stamps array<struct<text:string,start:double,end:double>>"
    rows = [("a", "b", True, 0.0, 1.0, [("a", 0.0, 0.5)]), ("a", "b", False, 0.0, 1.0, [("a", 0.0, 0.5)]), ("a", None, False, 0.0, 1.0, [("a", 0.0, 1.5)]), ("a", None, False, 0.0, 1.0, [])]
    got = [(r["text"], r["stamp_status"]) for r in sequence.update_stamps(spark.createDataFrame(rows, kind)).collect()]
    assert got == [("b", "invalidated_text_changed"), ("a", "unchanged_valid_bounds"), ("a", "invalidated_invalid_bounds"), ("a", None)]


def test_snap_and_split(spark):
    texts = ["So", "we", "go.", "Now", "you", "do"]
    starts = [0, 200, 400, 600, 800, 1000]
    assert turns.snap(texts, starts, [s + 150 for s in starts], list("AABBBB")) == list("AAABBB")
    assert unicode.share_out("So we go. Now", [6, 3]) == ["So we go.", "Now"]
    assert unicode.share_out("ab cd ef", [1, 1, 1]) == ["ab", "cd", "ef"] and unicode.share_out(" x ", [1]) == ["x"]
    assert unicode.share_out("", [1, 2]) == ["", ""] and unicode.share_out("?!", [1, 2]) == ["?!", ""] and unicode.share_out("abc", [0, 0]) == ["abc", ""]
    assert unicode.share_out("abcdef", [9, 0, 1]) == ["abcde", "", "f"] and unicode.share_out("(a)", [1, 1]) == ["(", "a)"]


def test_alignment(spark):
    got = alignment.gaps("we like the red hause on the hill", "we like the red house on the hill")
    assert [(g[2], g[3], g[4]) for g in got] == [("hause", "house", "replace")]
    ask = spark.createDataFrame([("1", "we like the red hause on a hill", [("L01", "we like the red house on a hill")]), ("2", "same text", [("L01", "same text")]), ("3", "", [])], "id string, heard string, lines array<struct<line_id:string,text:string>>")
    out = {r["id"]: (r["corrected_text"], r["accepted"]) for r in alignment.decide(ask, alignment.inventory(ask)).collect()}
    assert out == {"1": ("we like the red house on a hill", True), "2": ("same text", False), "3": ("", False)}


def test_guards(spark):
    base = {"changed": True, "confidence": 0.9, "role": "subtitle", "evidence": ["L01"], "heard": "the red hause", "proposed": "the red house"}
    cases = [
        ({}, "accepted"), ({"changed": False}, "model_changed_false"), ({"proposed": " "}, "empty_proposal"), ({"confidence": 0.5}, "confidence_below_0.85"), ({"evidence": []}, "missing_or_invalid_evidence"),
        ({"evidence": ["L09"]}, "missing_or_invalid_evidence"), ({"role": "uncertain"}, "unsafe_evidence_role:uncertain"), ({"proposed": "the red house 7"}, "introduced_digits:7"), ({"proposed": "The red hause!"}, "punctuation_or_case_only"),
    ]
    rows = [{**base, **c, "want": w} for c, w in cases]
    df = spark.createDataFrame(rows, "changed boolean, confidence double, role string, evidence array<string>, heard string, proposed string, want string")
    reason = guards.proposal_reason(F.col("heard"), F.col("proposed"), unicode.match_text("heard"), unicode.match_text("proposed"), F.col("changed"), F.col("confidence"), F.col("role"), F.col("evidence"), F.array(F.lit("L01")))
    assert all(r[0] == r[1] for r in df.select(reason, "want").collect())


def test_budget_counts_calls_and_attempts():
    keys, cache, ledger, asked = [str(i) for i in range(9)], {}, [], []

    def ask(batch):
        asked.append(batch)
        return {k: k.upper() for k in batch}

    b = incremental.Budget()
    assert len(b.run(keys, cache, ledger, ask)) == 9 and len(asked) == 2
    assert len(b.run(keys, cache, ledger, ask)) == 9 and len(asked) == 2
    failing = incremental.Budget(calls=3, attempts=2)
    log = []
    assert failing.run(["x"], {}, log, lambda _: 1 / 0) == {} and sum(e["event"] == "start" for e in log) == 2
    graph = incremental.StageGraph({"b": ["a"], "c": ["b"], "d": ["a", "c"]})
    assert graph.stale("a") == ["b", "d", "c"] and graph.stale("d") == []


def test_retries():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("HTTP 503")
        return "ok"

    assert incremental.with_retries(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0]


def test_clusters():
    import numpy as np

    x = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99]])
    assert clustering.average_linkage(x).tolist() == [0, 0, 1, 1]
    assert clustering.average_linkage(x[:1]).tolist() == [0]


def test_empty_tables(spark):
    seg = seg_df(spark, [])
    for op in (sequence.merge_adjacent, sequence.runs, sequence.neighbours, sequence.forward_fill, intervals.fragments, intervals.merge_fragments):
        assert op(seg).count() == 0
    spans = spans_df(spark, [])
    for op in (intervals.merge_ranges, intervals.chunks, intervals.conflict_groups, sequence.smooth_islands):
        assert op(spans).count() == 0
    assert evaluate.summarize(spark.createDataFrame([], "baseline_cer double, corrected_cer double, cer_delta double, accepted boolean")).first()["samples"] == 0


def test_config_from_environment():
    assert Complexity.from_env(env={"MARLSTONE_ZH_LONG_CHARS": "5"}).zh_long_chars == 5
    assert Speech.from_env(env={}).max_chunk_ms == 25_000


def test_evidence_and_budget(spark):
    df = spark.createDataFrame([(1, 0, "the red house", "the red hause"), (1, 1, "THE RED HOUSE", "the red hause"), (1, 2, "12:30", "the red hause"), (1, 3, "zzz", "the red hause")], "media long, pos int, line string, heard string")
    got = [(r["line_id"], r["line"], r["selection"]) for r in select.evidence(df).orderBy("rank").collect()]
    assert got == [("L01", "the red house", "lexical"), ("L02", "zzz", "subtitle_candidate")]


def test_frame_times_round_as_doubles(spark):
    """A double below a half is rounded by its product, and the length of a range has no noise of binary fractions."""
    df = spark.createDataFrame([(0.032, 2.122), (0.005, 2.095)], "a double, b double")
    got = [list(r[0]) for r in df.select(policy.frame_times(F.col("a"), F.col("b"), digits=1)).collect()]
    want = [[math.floor((s / 1000 + (e - s) / 1000 * f) * 10 + 0.5) / 10 for f in (0.2, 0.5, 0.8)] for s, e in ((32, 2122), (5, 2095))]
    assert got == want and got[0][0] == 0.5 and got[1][1] == 1.0


def test_token_counts_without_tokens(spark):
    texts = ["", "It's 12 o'clock, don't!", "中文 abc 42 é ñ ...", "x' 'y 7a", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = [tuple(r[0]) for r in df.orderBy("i").select(unicode.count_tokens("text")).collect()]
    kinds = [[t["kind"] for t in unicode.tokens_of(t)] for t in texts]
    assert got == [(*(k.count(n) for n in ("word", "number", "cjk", "punct")), len(unicode.content_of(t))) for k, t in zip(kinds, texts, strict=True)]
    from marlstone.plans import registry

    # No task of q96 makes rows of tokens: a worker hands back five numbers a text.
    plan = registry.queries()["q96_tokens"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "count_tokens" in plan and "tokenize" not in plan and "content_keys" not in plan
