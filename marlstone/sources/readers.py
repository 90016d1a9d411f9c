"""Readers of the file formats that timed-text projects come in. Paths go to Spark's readers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.policy import first_nonblank
from marlstone.operators.select import last_wins


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document a file (S01, S02); keys outside the schema are left out, keys it lacks are null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def results(spark: SparkSession, path: str, row: str, key: str = "segment_id") -> DataFrame:
    """Result rows from a list of rows or a map by id (S03, S04); ids become strings. row: a struct's fields without the key, as `n:long, text:string`."""
    text = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", f"array<struct<{key}:string,{row}>>")
    as_map = F.from_json("value", f"map<string,struct<{row}>>")
    names = [f.split(":")[0].strip() for f in _fields(row)]
    listed = text.where(F.trim("value").startswith("[")).select(F.explode(as_list).alias("r")).select(f"r.{key}", *(f"r.{n}" for n in names))
    mapped = text.where(~F.trim("value").startswith("[")).select(F.explode(as_map).alias(key, "r")).select(key, *(f"r.{n}" for n in names))
    return listed.unionByName(mapped)


def _fields(ddl: str) -> list[str]:
    """The fields of a struct's DDL at its top level."""
    out, depth, now = [], 0, ""
    for c in ddl:
        depth += c in "<(" or -(c in ">)")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def checkpoint_maps(text: Column) -> Column:
    """(candidates, selections) of a two-map checkpoint; broken JSON is empty maps."""
    kind = "struct<candidates:map<string,string>,selections:map<string,string>>"
    got = F.from_json(text, kind)
    empty = F.create_map().cast("map<string,string>")
    return F.struct(F.coalesce(got["candidates"], empty).alias("candidates"), F.coalesce(got["selections"], empty).alias("selections"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines (S06, S07); strict: a malformed line raises. Blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV whose values are all strings; a byte order mark in the header goes."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*(c.removeprefix("﻿").strip('"') for c in df.columns))


def aliased(rows: DataFrame, fields: dict[str, list[str]], key: str, defaults: dict[str, str] | None = None, order: str | None = None) -> DataFrame:
    """Columns by the first non-blank of their aliases (S08, S09, S10); rows without a key go, the last of a key wins.

    order: a column that says which row is later; without one any row of a key may win.
    """
    made = rows.select(*(first_nonblank(*(F.col(a) for a in names if a in rows.columns), default=(defaults or {}).get(to, "")).alias(to) if any(a in rows.columns for a in names) else F.lit((defaults or {}).get(to, "")).alias(to) for to, names in fields.items()), *([F.col(order).alias("_order")] if order else [F.monotonically_increasing_id().alias("_order")]))
    return last_wins(made.where(F.col(key) != ""), key, "_order").drop("_order")


def rttm(spark: SparkSession, path: str) -> DataFrame:
    """media (file name), start_ms, end_ms, speaker of SPEAKER lines with eight fields or more."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("media"), f.alias("f")).where((F.size("f") >= 8) & (F.col("f")[0] == "SPEAKER"))
    start, length = F.col("f")[3].cast("double"), F.col("f")[4].cast("double")
    return rows.select("media", F.round(start * 1000).cast("long").alias("start_ms"), F.round((start + length) * 1000).cast("long").alias("end_ms"), F.col("f")[7].alias("speaker"))


def pattern_lines(spark: SparkSession, path: str) -> list[str]:
    """Patterns of a small file, one a line; blank lines and # comments go, an invalid pattern raises."""
    rows = [r[0].lstrip("﻿").strip() for r in spark.read.text(path).limit(10_000).collect()]
    kept = [r for r in rows if r and not r.startswith("#")]
    for p in kept:
        spark.sql("SELECT regexp_like('', :p)", args={"p": p}).collect()
    return kept


def columns_table(text: DataFrame, names: list[str]) -> DataFrame:
    """A white-space table with a header line, as listings of programs are."""
    f = F.split(F.trim("value"), r"\s+")
    return text.where((F.trim("value") != "") & (F.split(F.trim("value"), r"\s+")[0] != names[0])).select(*(F.try_element_at(f, F.lit(i + 1)).alias(n) for i, n in enumerate(names)))


def recognition(text: Column) -> Column:
    """(text, language, stamps) of a recogniser's JSON whose stamps go by one of two names, as a list or in items."""
    stamp = "array<struct<text:string,start:double,end:double>>"
    got = F.from_json(text, f"text string, language string, time_stamps {stamp}, timestamps {stamp}")
    nested = F.from_json(text, f"time_stamps struct<items:{stamp}>, timestamps struct<items:{stamp}>")
    stamps = F.coalesce(got["time_stamps"], got["timestamps"], nested["time_stamps"]["items"], nested["timestamps"]["items"], F.array().cast(stamp))
    rounded = F.transform(stamps, lambda s: F.struct(s["text"].alias("text"), F.round(s["start"], 3).alias("start"), F.round(s["end"], 3).alias("end")))
    return F.struct(F.coalesce(got["text"], F.lit("")).alias("text"), F.coalesce(got["language"], F.lit("")).alias("language"), rounded.alias("stamps"))


def media_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("mp3", "wav", "flac", "m4a", "ogg")) -> DataFrame:
    """(id, path) with the first existing extension in order (S17); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rank = F.array_position(F.array(*map(F.lit, extensions)), ext)
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("id"), rank.alias("rank"), "path").where("rank > 0")
    return rows.groupBy("id").agg(F.min(F.struct("rank", "path")).alias("m")).select("id", "m.path")


def shards_present(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Shards that a weight map names and that are missing or empty (S18). manifest: weight_map map; files: name, size."""
    wanted = manifest.select(F.explode(F.map_values("weight_map")).alias("name")).distinct()
    return wanted.join(files.where("size > 0"), "name", "left_anti")


def complete_rows(rows: DataFrame, frames: str = "frames_json") -> DataFrame:
    """Earlier rows whose every frame succeeded; the others are to be done again."""
    got = F.from_json(frames, "array<struct<timestamp:double,text:string,error:string>>")
    return rows.where((F.size(got) > 0) & F.forall(got, lambda f: f["error"].isNull() | (f["error"] == "")))


def proposals(records: DataFrame, strict: bool) -> DataFrame:
    """(id, proposal) of nested responses (S24). records: pos, rows array<struct<id,proposal>>, retries of the same kind.

    The last of an id wins; strict: a repeated id raises.
    """
    each = records.select("pos", F.posexplode(F.concat("rows", F.coalesce("retries", F.array().cast(records.schema["rows"].dataType)))).alias("i", "r"))
    if strict:
        n = each.groupBy("r.id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("pos", "i", "r")).alias("m"))
        return n.select("id", F.when(F.col("n") == 1, F.col("m.r.proposal")).otherwise(F.raise_error(F.concat(F.lit("repeated id "), "id"))).alias("proposal"))
    return each.groupBy("r.id").agg(F.max(F.struct("pos", "i", "r")).alias("m")).select("id", F.col("m.r.proposal").alias("proposal"))
