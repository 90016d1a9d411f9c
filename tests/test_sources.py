"""Readers and writers on small files."""

import json

import pytest

from marlstone.operators import incremental
from marlstone.sources import readers, writers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def test_results_as_list_and_as_map(spark, tmp_path):
    put(tmp_path, "a.json", json.dumps([{"segment_id": 1, "status": "success"}, {"segment_id": "x", "status": "failed"}]))
    put(tmp_path, "b.json", json.dumps({"2": {"status": "success"}}))
    got = readers.results(spark, str(tmp_path), "status:string").collect()
    assert sorted((r["segment_id"], r["status"]) for r in got) == [("1", "success"), ("2", "success"), ("x", "failed")]


def test_documents_lines_and_csv(spark, tmp_path):
    doc = put(tmp_path, "d.json", '{\n "a": 1,\n "other": 2\n}')
    assert readers.json_document(spark, doc, "a int, b string").first().asDict() == {"a": 1, "b": None}
    good, bad = put(tmp_path, "g.jsonl", '{"k":1}\n\n{"k":2}\n'), put(tmp_path, "b.jsonl", '{"k":1}\n{"k":\n')
    assert readers.json_lines(spark, good, "k int").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, bad, "k int").collect()
    csv = put(tmp_path, "m.csv", '﻿id,Text,text2\n1,"a\nb",\n2,,c\n,x,\n1,last,\n')
    rows = readers.csv_strings(spark, csv)
    assert rows.columns == ["id", "Text", "text2"]
    got = readers.aliased(rows, {"id": ["id"], "text": ["missing", "Text", "text2"], "ok": ["success"]}, "id", {"ok": "True"})
    assert {r["id"]: (r["text"], r["ok"]) for r in got.collect()} == {"1": ("last", "True"), "2": ("c", "True")}


def test_rttm_and_patterns(spark, tmp_path):
    path = put(tmp_path, "talk.rttm", "SPEAKER f 1 0.50 1.25 <NA> <NA> spk1 <NA>\nOTHER x\nSPEAKER f 1 0 1\n")
    assert [tuple(r) for r in readers.rttm(spark, path).collect()] == [("talk", 500, 1750, "spk1")]
    assert readers.pattern_lines(spark, put(tmp_path, "p.txt", "# c\n\nfoo.*\n")) == ["foo.*"]
    with pytest.raises(Exception, match="(?i)regex|pattern"):
        readers.pattern_lines(spark, put(tmp_path, "q.txt", "([\n"))


def test_recognition_forms(spark):
    stamp = {"text": "a", "start": 0.12345, "end": 1.0}
    forms = [{"text": "a", "language": "en", "time_stamps": [stamp]}, {"text": "a", "timestamps": [stamp]}, {"text": "a", "timestamps": {"items": [stamp]}}, {}]
    df = spark.createDataFrame([(i, json.dumps(f)) for i, f in enumerate(forms)], "i int, j string")
    got = [r[0] for r in df.orderBy("i").select(readers.recognition(df["j"])).collect()]
    assert [len(g["stamps"]) for g in got] == [1, 1, 1, 0] and got[0]["stamps"][0]["start"] == 0.123


def test_media_shards_and_frames(spark, tmp_path):
    for name in ("a.wav", "a.mp3", "b.ogg", "c.txt"):
        put(tmp_path, name, "x")
    got = {r["id"]: r["path"].rsplit(".", 1)[1] for r in readers.media_files(spark, str(tmp_path)).collect()}
    assert got == {"a": "mp3", "b": "ogg"}
    manifest = spark.createDataFrame([({"w1": "s1", "w2": "s2", "w3": "s2"},)], "weight_map map<string,string>")
    assert [r["name"] for r in readers.shards_present(manifest, spark.createDataFrame([("s1", 5), ("s2", 0)], "name string, size int")).collect()] == ["s2"]
    frames = spark.createDataFrame([("1", '[{"text":"a"}]'), ("2", '[{"error":"e"}]'), ("3", "[]")], "id string, frames_json string")
    assert [r["id"] for r in readers.complete_rows(frames).collect()] == ["1"]


def test_proposals(spark):
    kind = "pos int, rows array<struct<id:string,proposal:string>>, retries array<struct<id:string,proposal:string>>"
    df = spark.createDataFrame([(0, [("a", "1"), ("b", "2")], None), (1, [], [("a", "3")])], kind)
    assert {r["id"]: r["proposal"] for r in readers.proposals(df, strict=False).collect()} == {"a": "3", "b": "2"}
    with pytest.raises(Exception, match="repeated id"):
        readers.proposals(df, strict=True).collect()


def test_writers(spark, tmp_path):
    row = {"id": 1, "text": "t", "start": 0.0, "end": 1.0, "source_lang": "en", "target_lang": "zh", "emotion": "happy", "speaker": "A", "tts_engine": "f5tts"}
    kind = "id int, text string, start double, end double, source_lang string, target_lang string, emotion string, speaker string, tts_engine string"
    good, bad = spark.createDataFrame([row], kind), spark.createDataFrame([row | {"end": 0.0}], kind)
    writers.save_segments(good, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 1
    with pytest.raises(ValueError, match="end_not_after_start"):
        writers.save_segments(bad, str(tmp_path / "t"))
    writers.save_csv(good, str(tmp_path / "c"), ["text", "none"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["text", "none"]
    writers.save_stage(good, str(tmp_path), "stage")
    writers.save_stage(good, str(tmp_path), "stage")
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 1
    writers.append_json(good, str(tmp_path / "j"))
    with pytest.raises(Exception, match="NaN"):
        writers.append_json(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "j"))
    line = spark.createDataFrame([(7, 12, 1500), (7, 5, 5)], "media long, start_ms long, end_ms long")
    assert [r["value"] for r in writers.segment_list(line).collect()] == ["7-00000012-00001500 7 0.012 1.500"]


def test_mix_gate(spark):
    seg = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "segment_id string")
    clips = spark.createDataFrame([("1", "f", 1.0), ("2", "f", 0.0), ("3", "old", 1.0), ("9", "f", 1.0)], "segment_id string, fingerprint string, duration double")
    results = spark.createDataFrame([(i, "success", "f", "c", "c") for i in "123"], "segment_id string, status string, fingerprint string, checksum string, stored_checksum string")
    got = {(r["segment_id"], r["issue"]) for r in incremental.mix_issues(seg, clips, results).collect()}
    assert got == {("2", "empty_audio"), ("3", "fingerprint_mismatch"), ("4", "missing_or_unsuccessful"), ("9", "clip_unknown")}


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (2, None)], "a int, b string")
    prints = [r[0] for r in df.select(incremental.fingerprint("a", "b")).collect()]
    assert len(set(prints)) == 3
    table = incremental.table_fingerprint(df.withColumn("g", df["a"] * 0), ["a", "b"], ["g"]).first()["fingerprint"]
    assert table == incremental.table_fingerprint(df.orderBy("a", ascending=False).withColumn("g", df["a"] * 0), ["a", "b"], ["g"]).first()["fingerprint"]


def test_rounds(spark, tmp_path):
    from pyspark.sql import functions as F

    seen = []

    def work(df):
        seen.append(df.count())
        return df.withColumn("status", F.when(F.col("id") <= 2 * len(seen), "success").otherwise("failed"))

    def save(df):
        path = str(tmp_path / f"r{len(seen)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    done = incremental.run_rounds(spark.range(1, 6), "id", work, save)
    assert done.count() == 5 and seen == [5, 3, 1]
