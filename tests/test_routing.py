"""Routed segments, translations, jobs, replays and seams."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import routing, select
from marlstone.sources import clients


def test_route_segments(spark):
    kind = "media long, pos long, text string, start double, end double, label string, score double, extra string"
    df = spark.createDataFrame([(1, 7, " hello ", 1.2, 3.8, "anger", 0.9, "x"), (1, 8, None, 0.0, 0.5, "anger", 0.9, "x")], kind)
    got = {r["pos"]: r for r in routing.route_segments(df, "zh", "en_US").collect()}
    assert (got[7]["id"], got[7]["text"], got[7]["engine"], got[7]["extra"], got[7]["speaker"]) == ("7", "hello", "indextts2", "x", "SPEAKER_00")
    assert (got[8]["emotion"], got[8]["text"], got[8]["target_lang_raw"]) == ("neutral", "", None)
    assert routing.route_segments(df, "zh", "pt_BR").first()["target_lang_raw"] == "pt-br"
    with pytest.raises(Exception, match="no range"):
        routing.route_segments(df.withColumn("end", F.col("start")), "zh", "en").collect()


def test_translations(spark):
    df = spark.createDataFrame([("1", "一二三四五六", "good", ["a", "bb", "ccc"]), ("2", "好", "ok", ["ok"]), ("3", "一二三四五六", "x", ["x"]), ("4", "一二三四五六", "good", ["a", "好", "c"]), ("5", "一二三四五六", "good", []), ("6", "一二三四五六", "aa", ["aa", "bb", "cc"])], "id string, original string, text string, raw array<string>")
    out = routing.check_translations(df, "en", "zh")
    got = {r["id"]: (r["error"], r["warning"]) for r in out.collect()}
    assert got["1"] == got["2"] == (None, None) and got["3"][0].startswith("candidate_count:1")
    assert got["4"][0].startswith("target_en") and got["5"][0] == "missing_candidates" and got["6"] == (None, "candidate_lengths_similar")
    with pytest.raises(ValueError, match="3 rows failed: 3"):
        routing.require_good(out)
    routing.require_good(out.where("error IS NULL"))


def test_jobs_and_chains(spark):
    seg = spark.createDataFrame([(1, "7/a", "t", "happy", "A", "cosyvoice3", 0.0, 2.0), (1, "8", "t", "sad", "B", "omnivoice", 0.0, 2.0)], "media long, id string, text string, emotion string, speaker string, engine string, start double, end double")
    refs = spark.createDataFrame([(1, "A", "a.wav", "hi")], "media long, speaker string, ref_audio string, ref_text string")
    made = routing.jobs(seg, refs)
    assert {r["id"]: (r["file"], r["ref_audio"]) for r in made.collect()} == {"7/a": ("segment_7_a_cosyvoice3.wav", "a.wav"), "8": ("segment_8_omnivoice.wav", None)}
    again = routing.next_jobs(made)
    assert [(r["id"], r["model"], r["fallback_count"]) for r in again.collect()] == [("7/a", "f5tts", 1)]
    assert routing.next_jobs(again).count() == 0


def test_replay_selects_the_first_that_passes(spark):
    rows = [(i, i % 4 + 1, "strong" if i < 8 else "safety_negative", i < 8, 0.2 if i < 8 else 0.0, 0.1 if i < 8 else 0.0, i == 99, i == 3) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, fold int, opportunity string, accepted boolean, baseline_cer double, corrected_cer double, latin_removed boolean, declared boolean")
    df = df.withColumn("cer_delta", F.col("corrected_cer") - F.col("baseline_cer")).withColumn("baseline", F.lit("b")).withColumn("corrected", F.lit("c"))
    got = {r["candidate"]: (r["pass"], r["selected"]) for r in routing.replay(df, {"loose": False, "strict": True}, 0.2).collect()}
    assert got == {"loose": (True, True), "strict": (True, False)}


def test_positions_must_agree(spark):
    a = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "media long, pos long, x string")
    b = a.select("media", "pos", F.upper("x").alias("y"))
    assert {(r["x"], r["y"]) for r in routing.by_position(a, b).collect()} == {("a", "A"), ("b", "B")}
    with pytest.raises(Exception, match="differ in positions"):
        routing.by_position(a, b.where("pos = 0")).collect()


def _clients():
    """Fake clients; local classes go to the workers by value."""

    class Reader:
        def read(self, media, seconds):
            if media == "bad":
                raise OSError("down")
            return f"{media}@{seconds}"

    class Engine:
        name, extension, signature = "fake", ".wav", "fake-1"

        def synthesize(self, text, language, path):
            if text == "boom":
                raise RuntimeError
            return len(text) / 10

    return Reader, Engine


def test_frames_with_cache(spark):
    Reader, _ = _clients()
    seg = spark.createDataFrame([("m", 0, 0.0, 10.0), ("bad", 0, 0.0, 10.0)], "media string, pos long, start double, end double").coalesce(1)
    wanted = clients.frames(seg)
    empty = spark.createDataFrame([], "media string, pos long, at double, text string, error string")
    first = clients.read_frames(wanted, empty, Reader, failures=2)
    got = {(r["media"], r["at"]): (r["text"], r["error"]) for r in first.collect()}
    assert got[("m", 2.0)] == ("m@2.0", None) and {got[("bad", t)][1] for t in (2.0, 5.0, 8.0)} == {"down", "skipped"}
    cache = spark.createDataFrame([("m", 0, 2.0, "old", None)], "media string, pos long, at double, text string, error string")
    assert {(r["text"]) for r in clients.read_frames(wanted.where("media = 'm'"), cache, Reader).collect()} == {"old", "m@5.0", "m@8.0"}


def test_measured_choice(spark):
    _, Engine = _clients()
    cand = spark.createDataFrame([(1, 0, 0, "short", "en", 1.0), (1, 0, 1, "ten chars!", "en", 1.0), (1, 1, 0, "boom", "en", 1.0)], "media long, pos long, idx int, text string, language string, target double")
    empty = spark.createDataFrame([], "fingerprint string, measured double")
    best = {r["pos"]: (r["idx"], r["status"]) for r in select.closest_duration(clients.measure(cand, empty, Engine, "fake-1")).collect()}
    assert best == {0: (1, "success"), 1: (0, "fallback")}


def _short(spark):
    kind = "media long, pos long, text string, start double, end double, label string, score double, speaker string"
    return spark.createDataFrame([(1, 0, "hi", 15.6, 16.4, "anger", 0.9, "a"), (1, 1, "hi", 15.6, 16.399, "anger", 0.9, "a")], kind)


def test_eight_tenths_of_a_second_are_not_short(spark):
    """16.4 - 15.6 is less than 0.8 in binary."""
    got = [(r["emotion"], r["engine"]) for r in routing.route_segments(_short(spark), "zh", "en").orderBy("pos").collect()]
    assert got == [("angry", "indextts2"), ("neutral", "f5tts")]


def test_jobs_of_segments_at_the_least_length(spark):
    """The planned engine of a segment of 0.8 s is that of its emotion, and so are its file and its next engine."""
    none = spark.createDataFrame([], "media long, speaker string, ref_audio string, ref_text string")
    made = routing.next_jobs(routing.jobs(routing.route_segments(_short(spark), "zh", "en"), none))
    got = [(r["planned_engine"], r["model"], r["file"]) for r in made.orderBy("id").collect()]
    assert got == [("indextts2", "f5tts", "segment_0_indextts2.wav"), ("f5tts", "cosyvoice3", "segment_1_f5tts.wav")]
