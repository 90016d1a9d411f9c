"""Licence scans: sparse TF-IDF cosine of header lines to templates, then inheritance from licence files.

DataFrame operations only. Document frequencies of all words are counted over all files. A header is a line, a block of adjacent lines or a whole licence
file with an anchor word; an SPDX identifier names its licence. A header's cosine to each template is a sum over its words, joined to the (small, fixed) table of template weights. A file
without a licence of its own takes that of the nearest directory above it that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import materialise

# What the headers and short forms of well-known licences say.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 license."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
)
# Paragraphs of the customary file headers, which are wrapped over several lines.
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
HEADERS: tuple[tuple[str, str], ...] = (
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1")),
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
#: A line is a header if it has one of these (any case); a file is a licence file if its name matches the other.
ANCHOR = r"(?i)licen[sc]e|copyright|spdx|redistribut|permission is hereby|public domain"
LICENSE_FILE = r"(?i)^(?:licen[sc]e|copying|unlicense|notice)(?:[.-][a-z0-9.-]*)?$"
TOKEN = "[A-Za-z0-9]+"
THRESHOLD = 0.7
#: Lines of a block are all comments or all not; lines without a letter or digit stand between blocks.
COMMENT = r"^\s*(?:#|//|/\*|\*|--|;|%|<!--)"
SPDX = r"(?i)spdx-license-identifier:[ \t]*\(?([a-z0-9.+-]+(?:[ \t]+(?:and|or|with)[ \t]+[a-z0-9.+-]+)*)"


def words(text: str) -> list[str]:
    return [w.lower() for w in re.findall(TOKEN, text)]


@cache
def templates() -> tuple[tuple[str, str], ...]:
    """Name and text of short forms, headers and full licence texts."""
    full = sorted((Path(__file__).parent / "licenses").glob("*.txt"))
    return (*TEMPLATES, *HEADERS, *((p.stem, p.read_text(encoding="utf-8")) for p in full))


@dataclass
class Weights:
    """Inverse document frequencies and unit template vectors, from n files and the counts of template words."""

    n: int
    df: dict[str, int]
    names: list[str] = field(default_factory=list)
    vectors: list[dict[str, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        for name, text in templates():
            tf = Counter(words(text))
            v = {w: k * self.idf(w) for w, k in tf.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.names.append(name)
            self.vectors.append({w: x / norm for w, x in v.items()})

    def idf(self, word: str) -> float:
        return math.log((1 + self.n) / (1 + self.df.get(word, 0))) + 1


def vocabulary() -> list[str]:
    """The words of all templates."""
    return sorted({w for _, t in templates() for w in words(t)})


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), F.lower)


def weigh(counted: DataFrame, n: int) -> Weights:
    """Weights from the number of files and their (word, df), of which only the words of templates (a few thousand) come to the driver."""
    listed = counted.sparkSession.createDataFrame([(w,) for w in vocabulary()], "word string")
    return Weights(n, {r["word"]: r["df"] for r in counted.join(F.broadcast(listed), "word").collect()})


def frequencies(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, df): in how many files each word occurs."""
    return files.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def units(text: Column, whole: Column) -> Column:
    """What is compared of a text, as (form, line, said): 0 lines, 1 blocks of several lines, 2 the whole if `whole`; each with an anchor word."""
    lines = F.split(text, "\n", -1)
    kind = lambda x: F.when(~x.rlike(r"[\p{L}\p{N}]"), 0).when(x.rlike(COMMENT), 1).otherwise(2)
    # Each line with the one before it; the pair left over at the end is null and array_join leaves it out.
    joined = F.zip_with(lines, F.concat(F.array(F.lit("")), lines), lambda x, before: F.concat(F.when(kind(x) == kind(before), "\n").otherwise("\0"), x))
    blocks = F.split(F.array_join(joined, ""), "\0", -1)
    made = lambda form, said: F.transform(said, lambda x, i: F.struct(F.lit(form).alias("form"), i.alias("line"), x.alias("said")))
    some = F.concat(made(0, lines), F.filter(made(1, blocks), lambda u: u["said"].contains("\n")), F.filter(made(2, F.array(text)), lambda u: F.coalesce(whole, F.lit(False))))
    return F.filter(some, lambda u: u["said"].rlike(ANCHOR))


def identified(lines: DataFrame, key: str) -> DataFrame:
    """Lines with an SPDX identifier, which names the licence; "-only", "-or-later" and "+" are left out."""
    found = lines.where("form = 0").withColumn("name", F.regexp_extract("said", SPDX, 1)).where("name <> ''")
    name = F.regexp_replace("name", r"(?i)(?:-only|-or-later|\+)(?=\s|$)", "")
    known = F.create_map(*(F.lit(x) for n in dict.fromkeys(n for n, _ in templates()) for x in (n.lower(), n)))
    return found.select(key, F.struct(F.lit(1.0).alias("score"), F.lit(0).alias("form"), (-F.col("line")).alias("line"), F.lit(1).alias("place"), F.coalesce(F.try_element_at(known, F.lower(name)), name).alias("license")).alias("b"))


def headers(files: DataFrame, weights: Weights, counted: DataFrame, key: str, text_col: str = "text", threshold: float = THRESHOLD, name_col: str | None = None) -> DataFrame:
    """(key, license, score) of each file that has a header: its most similar template, or its SPDX identifier.

    counted: (word, df) over all files. Lines, blocks of lines and (by the file name in name_col) whole licence files are compared;
    ties go to lines, then blocks, then the earlier one, then template.
    """
    spark = files.sparkSession
    has = F.col(text_col).rlike(ANCHOR)
    whole = F.col(name_col).rlike(LICENSE_FILE) if name_col else F.lit(False)
    lines = materialise(files.where(has).select(key, F.inline(units(F.col(text_col), whole))), "units")
    spread = lines.repartition(key, "form", "line").select(key, "form", "line", F.explode(tokens(F.col("said"))).alias("word"))
    tf = spread.groupBy(key, "form", "line", "word").agg(F.count(F.lit(1)).alias("tf"))
    columns = [f"t{i}" for i in range(len(weights.names))]
    table = [(w, weights.idf(w), *(v.get(w, 0.0) for v in weights.vectors)) for w in vocabulary()]
    known = spark.createDataFrame(table, f"word string, idf double, {', '.join(f'{c} double' for c in columns)}")
    others = counted.join(F.broadcast(known.select("word")), "word", "left_anti")
    # A word of no template has the weight of its own document frequency; one of `others` only if it occurs in a unit.
    own = F.log(F.lit(1.0 + weights.n) / (F.lit(1) + F.coalesce("df", F.lit(0)))) + 1
    w = F.col("tf") * F.coalesce(F.col("idf"), own)
    # The table of template words is fixed and has a few thousand rows.
    sums = tf.join(F.broadcast(known), "word", "left").join(others, "word", "left").groupBy(key, "form", "line").agg(F.sqrt(F.sum(w * w)).alias("norm"), *(F.coalesce(F.sum(w * F.col(c)), F.lit(0.0)).alias(c) for c in columns))
    each = F.array(*(F.struct(F.round(F.col(c) / F.col("norm"), 9).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("license")) for i, (c, name) in enumerate(zip(columns, weights.names, strict=True))))
    best = sums.select(key, "form", "line", F.array_max(each).alias("b")).where(F.col("b.score") >= threshold)
    best = best.select(key, F.struct("b.score", (-F.col("form")).alias("form"), (-F.col("line")).alias("line"), "b.place", "b.license").alias("b")).unionByName(identified(lines, key))
    return best.groupBy(key).agg(F.max("b").alias("m")).select(key, F.col("m.license").alias("own_license"), F.col("m.score").alias("own_score"))


def scan(files: DataFrame, path_col: str = "path", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per file row: id, path, own_license, own_score, license, license_dir.

    license is the file's own or else that of the nearest directory above (its own directory first)
    with a licence file that has one; license_dir is that directory (null for an own licence). Several
    licence files in a directory: the most similar, then the smallest path. Null texts have no
    header; a null path inherits nothing. The root directory is "". Rows are matched by a hash of id,
    path and text, so repeated ids, paths and rows are all returned. Other columns are ignored.
    """
    counted = materialise(frequencies(files, text_col), "frequencies")
    weights = weigh(counted, files.count())
    path = F.regexp_replace(F.col(path_col).cast("string"), "^/+", "")
    rows = files.select(F.col(id_col).alias("id"), path.alias("path"), F.xxhash64(F.col(id_col), path, F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    rows = rows.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")).withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
    own = headers(rows.where("text IS NOT NULL"), weights, counted, "row", "text", threshold, "name")
    narrow = rows.drop("text").join(own, "row", "left")
    listed = narrow.where(F.col("name").rlike(LICENSE_FILE) & F.col("own_license").isNotNull())
    by_dir = listed.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("m")).select(F.col("dir").alias("license_dir"), F.col("m.own_license").alias("dir_license"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("license_dir")))
    dirs = narrow.where("own_license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    up = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.*").join(by_dir, "license_dir")
    nearest = up.groupBy("dir").agg(F.max(F.struct("depth", "license_dir", "dir_license")).alias("near"))
    found = narrow.join(nearest, "dir", "left")
    inherits = F.col("own_license").isNull()
    return found.select(
        F.col("id").alias(id_col),
        F.col("path").alias(path_col),
        "own_license",
        "own_score",
        F.coalesce("own_license", "near.dir_license").alias("license"),
        F.when(inherits, F.col("near.license_dir")).alias("license_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: a directory per source with two levels below; every 40th is a licence file higher up."""
    ident = F.col("doc_id")
    top = F.coalesce("source", F.lit("none"))
    d, e = F.concat(F.lit("d"), F.pmod(ident, F.lit(7))), F.concat(F.lit("e"), F.pmod(ident, F.lit(5)))
    name = F.concat(F.lit("f"), ident.cast("string"), F.lit(".txt"))
    path = F.when(ident % 80 == 0, F.concat_ws("/", top, F.lit("LICENSE"))).when(ident % 40 == 0, F.concat_ws("/", top, d, F.lit("LICENSE.txt"))).otherwise(F.concat_ws("/", top, d, e, name))
    return docs.select("doc_id", path.alias("path"), "text")


def op10_license_scan(docs: DataFrame) -> DataFrame:
    """All of `docs` as files; the score is rounded to 4 places."""
    return scan(document_paths(docs)).withColumn("own_score", F.round("own_score", 4))
