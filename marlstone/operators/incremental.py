"""Fingerprints, reuse of finished work, ledgers, coverage checks, and driver loops around model calls.

Paid or external calls are made by driver loops over bounded batches, never inside retried tasks.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(*columns: Column | str, version: str = "1") -> Column:
    """SHA-256 of the named columns as JSON, nulls included, in the order of their names.

    NaN and infinite numbers raise when they are met. A name may occur once.
    """
    named = {c if isinstance(c, str) else _name_of(c): F.col(c) if isinstance(c, str) else c for c in columns}
    if len(named) != len(columns):
        raise ValueError("a fingerprint's columns need names of their own")
    text = F.to_json(F.struct(F.lit(version).alias("version"), *(named[n].alias(n) for n in sorted(named))), {"ignoreNullFields": "false"})
    odd = text.rlike(r'[:\[,]"?(?:NaN|-?Infinity)"?[,\]}]')
    return F.sha2(F.when(odd, F.raise_error(F.lit("NaN or infinite number in a fingerprint")).cast("string")).otherwise(text), 256)


def _name_of(column: Column) -> str:
    """The name a column has in a struct."""
    text = column._jc.toString() if hasattr(column, "_jc") else str(column)
    return text.rsplit(" AS ", 1)[-1].strip("`")


def segment_fingerprint(source: str, target: str, model: str) -> Column:
    """Fingerprint of a segment with its neighbours' texts (H02); rows as from `neighbours`."""
    return fingerprint(F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(model).alias("model"), "media", "pos", "text", "start_ms", "end_ms", "speaker", "previous_text", "next_text", version="segment-1")


def table_fingerprint(rows: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """One digest per group of rows in order.

    Rows are digested first, so a group gathers 64 characters a row.
    """
    each = rows.select(*by, F.struct(*order, fingerprint(*[c for c in rows.columns if c not in by]).alias("row")).alias("r"))
    return each.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]), ","), 256).alias("fingerprint"))


def content_id(prefix: str, *columns: Column | str) -> Column:
    """A content-addressed identifier."""
    return F.concat(F.lit(f"{prefix}_"), fingerprint(*columns))


def reuse(rows: DataFrame, finished: DataFrame, keys: list[str], print_col: str = "fingerprint", status_col: str = "status") -> tuple[DataFrame, DataFrame]:
    """(rows with reusable results, pending rows): results count if key and fingerprint agree and status is success."""
    good = finished.where(F.col(status_col) == "success").drop(status_col).dropDuplicates([*keys, print_col])
    return rows.join(good, [*keys, print_col]), rows.join(good, [*keys, print_col], "left_anti")


def coverage(expected: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """Keys that are missing, unknown or returned more than once, with the problem."""
    a = expected.groupBy(key).agg(F.count(F.lit(1)).alias("wanted"))
    b = returned.groupBy(key).agg(F.count(F.lit(1)).alias("got"))
    both = a.join(b, key, "full_outer")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when((F.col("got") > 1) | (F.col("wanted") > 1), "duplicate")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select(key, "problem")


def mix_issues(segments: DataFrame, clips: DataFrame, results: DataFrame) -> DataFrame:
    """(segment_id, issue) that block mixing (F16).

    clips: segment_id, fingerprint, duration. results: segment_id, status, fingerprint, checksum,
    stored_checksum. The first issue of a segment counts; duplicates and unknown ids are issues too.
    """
    ids = coverage(segments.select("segment_id"), clips.select("segment_id"), "segment_id").select("segment_id", F.concat(F.lit("clip_"), "problem").alias("issue"))
    c = clips.dropDuplicates(["segment_id"]).select("segment_id", F.col("fingerprint").alias("clip_print"), "duration")
    r = results.dropDuplicates(["segment_id"])
    rows = segments.select("segment_id").distinct().join(c, "segment_id", "left").join(r, "segment_id", "left")
    issue = (
        F.when(F.coalesce(F.col("status") != "success", F.lit(True)) | F.col("clip_print").isNull(), "missing_or_unsuccessful")
        .when(F.coalesce(F.col("duration") <= 0, F.lit(True)), "empty_audio")
        .when(~F.col("clip_print").eqNullSafe(F.col("fingerprint")), "fingerprint_mismatch")
        .when(~F.col("checksum").eqNullSafe(F.col("stored_checksum")), "checksum_mismatch")
    )
    return ids.where("issue <> 'clip_missing'").unionByName(rows.select("segment_id", issue.alias("issue")).where("issue IS NOT NULL"))


def attempts(ledger: DataFrame) -> DataFrame:
    """(key, attempts) over the keys of start events (G10). ledger: event, call, keys array."""
    return ledger.where(F.col("event") == "start").select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("attempts"))


def share_usage(calls: DataFrame, batch: str, columns: list[str]) -> DataFrame:
    """Token counts of a batch divided over its items."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(batch))
    return calls.withColumns({c: F.col(c) / n for c in columns})


class StageGraph:
    """Which stages follow from which, so that a changed stage drops what depends on it."""

    def __init__(self, after: dict[str, list[str]]) -> None:
        self.after = after

    def stale(self, changed: str) -> list[str]:
        """All stages downstream of a changed one, nearest first."""
        out, queue = [], [changed]
        while queue:
            for name, needs in self.after.items():
                if queue[0] in needs and name not in out:
                    out.append(name)
                    queue.append(name)
            queue.pop(0)
        return out


def drop_stale(spark: SparkSession, root: str, graph: StageGraph, changed: str) -> list[str]:
    """Delete the tables of all stages downstream of a changed one; the names of those that were there."""
    gone = []
    for name in graph.stale(changed):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True):
            gone.append(name)
    return gone


def implementation_digest(*modules: object) -> str:
    """SHA-256 over the sources of modules, in the order of their names: what results are bound to."""
    named = sorted((m.__name__, inspect.getsource(m)) for m in modules)
    return hashlib.sha256(json.dumps(named).encode()).hexdigest()


#: HTTP statuses after which the same call may succeed.
TRANSIENT = (408, 409, 425, 429, 500, 502, 503, 504)


def retryable(error: Exception | str) -> bool:
    """Whether an error names a transient HTTP status, or is or tells of a lost connection.

    Digits only count where they are said to be a status.
    """
    if isinstance(error, (ConnectionError, TimeoutError)):
        return True
    said = re.findall(r"(?i)\b(?:http(?:/[\d.]+)?|status(?: code)?|code)[ :=]*(\d{3})\b", str(error))
    return any(int(n) in TRANSIENT for n in said) or re.search(r"(?i)\btimed out\b|\bconnection (?:reset|refused|aborted|closed|error)\b", str(error)) is not None


def error_chain(error: BaseException | None) -> str:
    """An error and what it came from, nearest first."""
    seen: dict[int, str] = {}
    while error is not None and id(error) not in seen:
        seen[id(error)] = f"{type(error).__name__}: {error}"
        error = error.__cause__ or error.__context__
    return " <- ".join(seen.values())


def with_retries(call: Callable[[], object], tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Call, waiting twice as long after each transient failure."""
    for k in range(tries):
        try:
            return call()
        except Exception as e:
            if k + 1 == tries or not retryable(e):
                raise
            sleep(wait * 2**k)
    raise ValueError("no tries")


@dataclass
class Budget:
    """Calls and attempts that may still be made; the ledger is written before a call."""

    calls: int = 6
    attempts: int = 2
    batch: int = 8

    def run(self, keys: list[str], cache: dict[str, object], ledger: list[dict], ask: Callable[[list[str]], dict[str, object]]) -> dict[str, object]:
        """Answers of the cache and of as many calls as the budget allows; what stays open has none.

        The ledger is a list of start, response and error events that outlives the run.
        """
        used = sum(e["event"] == "start" for e in ledger)
        tried = {k: sum(e["event"] == "start" and k in e["keys"] for e in ledger) for k in keys}
        while used < self.calls:
            open_keys = [k for k in keys if k not in cache and tried[k] < self.attempts][: self.batch]
            if not open_keys:
                break
            ledger.append({"event": "start", "call": used, "keys": open_keys})
            used += 1
            for k in open_keys:
                tried[k] += 1
            try:
                found = ask(open_keys)
            except Exception as e:
                ledger.append({"event": "error", "call": used - 1, "keys": open_keys, "reason": str(e)})
                continue
            cache.update({k: v for k, v in found.items() if k in open_keys})
            ledger.append({"event": "response", "call": used - 1, "keys": sorted(found)})
        return {k: cache[k] for k in keys if k in cache}


def run_rounds(pending: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """Repeat `work` over what is not a success yet; `save` writes each round's rows and reads them back."""
    done = None
    for _ in range(rounds):
        result = save(work(pending))
        good = result.where(F.col("status") == "success")
        done = good if done is None else done.unionByName(good)
        pending = pending.join(good.select(key), key, "left_anti")
        if not pending.take(1):
            break
    return done
