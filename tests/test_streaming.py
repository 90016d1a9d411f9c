"""Streams driven to their end over files."""

from pyspark.sql import functions as F

from marlstone.streaming import ranges

SF = "/root/testdata/sf0.001"


def drain(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def events(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.parquet(str(tmp_path / "e"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e"))


def test_windows_and_sessions(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    key = lambda r: (r["window"]["start"], r["event_type"], r["n"])
    got = drain(spark, ranges.windowed_counts(stream), "w", "complete")
    want = batch.groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    got = drain(spark, ranges.sessions(stream), "s", "complete")
    want = batch.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    key = lambda r: (r["session_window"]["start"], r["user_id"], r["n"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_islands_close(spark, tmp_path):
    rows = [("a", 0, 100), ("a", 300, 500), ("a", 900, 1000), ("a", 950, 1200), ("b", 0, 50), ("a", 9_000_000, 9_000_100)]
    df = spark.createDataFrame(rows, "media string, start_ms long, end_ms long").withColumn("ts", F.timestamp_millis(F.col("start_ms") + 1_000_000))  # not at the epoch, where the first watermark stands
    df.coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "r"))
    got = {(r["media"], r["start_ms"], r["end_ms"], r["parts"]) for r in drain(spark, ranges.islands(stream), "i", "append").collect()}
    assert {("a", 0, 500, 2), ("a", 900, 1200, 2)} <= got
