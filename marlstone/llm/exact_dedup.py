"""Exact deduplication by a tree merge of sorted digest runs. DataFrame operations only.

Every input partition is a leaf run: its rows sorted by digest with equal digests collapsed to the
best identifier and a count. In each round `FAN_IN` neighbouring runs meet (the binomial exchange
with several rounds in one: the run number loses its low bits) and a multiway merge collapses equal
digests again, until one run is left; there are as many rounds as the number of leaf runs takes.
`min` over a struct makes Spark plan a sort aggregate on both sides of each exchange, so a round is:
sorted run, exchange by (run, digest), merge. Spark's exchange doesn't keep the order of the runs
that meet, so a merge sorts them first. Copies collapse before every exchange, so a text that fills a
third of the table costs one row per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import fresh, materialise, once_each

#: Runs that are merged into one in a round; a power of two.
FAN_IN = 16


def identity(text: Column) -> list[Column]:
    """What makes two texts equal: SHA-256, verified by byte length and an independent 64-bit hash."""
    filled = F.coalesce(text, F.lit(""))
    return [
        F.unhex(F.sha2(filled, 256)).alias("digest"),
        F.octet_length(filled).alias("n_bytes"),
        F.xxhash64(filled).alias("check"),
    ]


def merge_runs(leaves: DataFrame, best: str, n_runs: int) -> DataFrame:
    """Merge `n_runs` runs of (run, digest, n_bytes, check, best, n) up to the root run.

    A digest only merges where byte length and second hash agree too, at every level, so a collision
    of digests keeps its texts apart.
    """
    runs, bits = leaves, FAN_IN.bit_length() - 1
    left = max(2, n_runs) - 1
    while left:
        left >>= bits
        runs = (
            runs.withColumn("run", F.shiftright("run", bits))
            .groupBy("run", "digest", "n_bytes", "check")
            .agg(F.min(best).alias(best), F.sum("n").alias("n"))
        )
    return runs.drop("run")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" identifier of equal texts stays. Null text counts as empty. A null
    identifier stays only where no other row has the text. Rows repeated with the same identifier and
    text are all in group_size, and exactly one of them is kept. Other columns of `docs` are ignored
    whatever their names. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    ident = F.col(id_col).cast("long")
    # The complement turns the order round and, unlike the negative, exists for every long.
    turn = (lambda c: c) if keep == "smallest" else F.bitwise_not
    rank = turn(ident)
    digests = materialise(
        docs.select(
            ident.alias("id"),
            *identity(F.col(text_col)),
            F.struct(ident.isNull().alias("no_id"), rank.alias("rank"), F.monotonically_increasing_id().alias("row")).alias("best"),
            F.spark_partition_id().alias("run"),
        ),
        "digests",
    )
    keys = ["digest", "n_bytes", "check"]
    leaves = digests.groupBy("run", *keys).agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n"))
    n_runs = 1 + (digests.agg(F.max("run")).first()[0] or 0)
    root = merge_runs(leaves, "best", n_runs).withColumnRenamed("best", "winner")
    return digests.join(root, keys).select(
        F.col("id").alias(id_col),
        turn(F.col("winner.rank")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("best.row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Null text counts as empty. Of rows repeated with the same identifier (or none) and text one stays;
    if they differ in other columns, whichever Spark comes to first. An empty table gives no rows.
    """
    ident, none, digest = fresh(docs, "row_key", "row_none", "row_digest")
    keys = [ident, none, digest]
    found = classify(docs, id_col, text_col, keep)
    row = found.select(F.coalesce(F.col(id_col), F.lit(0)).alias(ident), F.col(id_col).isNull().alias(none), F.col("text_sha256").alias(digest), "kept")
    row = materialise(row.groupBy(*keys).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "kept")
    own = F.col(id_col).cast("long")
    tagged = docs.withColumn(ident, F.coalesce(own, F.lit(0))).withColumn(none, own.isNull()).withColumn(digest, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    dropped = materialise(row.where("NOT kept").select(*keys), "dropped")
    repeated = materialise(row.where("kept AND n > 1").select(*keys), "repeated")
    return once_each(tagged, dropped, repeated, keys).select(*docs.columns)
