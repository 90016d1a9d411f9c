"""What the training-data operators share: table reading and durable intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table of a scale directory; only Spark's reader touches the path."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's `spark.checkpoint.dir`.

    Where it is unset on one machine (tests) a temporary folder is set once and used from then on; on a
    cluster that raises, as executors elsewhere could not read such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/marlstone/{tag}-{uuid.uuid4().hex}"


#: Where the shared folder is a local one, Hadoop starts `chmod` four times for a file with its .crc beside it and once
#: without; until such a child has begun, the whole JVM's memory seems to be its own as well. Other stores ignore this.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialise(df: DataFrame, tag: str, paths: list[str] | None = None) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back; its path is added to `paths`.

    Lineage ends at replicated files, so a lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.options(**_PLAIN_FILES).parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that `materialise` wrote and nothing reads any more, through Hadoop's file systems."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that `df` does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def once_each(docs: DataFrame, dropped: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `docs` whose keys are not in `dropped`, and of those whose keys are in `repeated` one each.

    Both are narrow tables that were written down, so the planner knows their size: a small one is
    broadcast and texts don't move, a larger one is joined by a shuffle. Null keys match nothing, so
    their rows stay.
    """
    kept = docs.join(dropped, keys, "left_anti")
    if not repeated.take(1):
        return kept
    once = docs.join(repeated, keys, "left_semi").dropDuplicates(keys).select(*kept.columns)
    return kept.join(repeated, keys, "left_anti").unionByName(once)


def bounded_batches(spark: SparkSession, max_bytes: int = 8_000_000) -> None:
    """Bound the Arrow batches that Python workers get by bytes, so that long texts don't gather by the thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))


def gathered(batches: Iterator[pa.RecordBatch], least_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `least_bytes` or more, but for the last."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def sample_ids(rows: DataFrame, k: int, key: str = "doc_id") -> list[int]:
    """At most `k` distinct keys of `rows`, those with the smallest hashes; the same whatever the partitions.

    A first filter on the hash leaves a few times `k` keys, so that tasks don't each send `k` on.
    """
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    parts = 1 << 30
    most = min(parts, math.ceil(parts * min(1.0, 4 * k / max(1, keys.count()))) + 1)
    near = keys.where(F.pmod(F.xxhash64(key), F.lit(parts)) < most)
    return [r[0] for r in near.orderBy(F.pmod(F.xxhash64(key), F.lit(parts)), key).limit(k).collect()]


def rows_of(rows: DataFrame, ids: list[int], key: str = "doc_id") -> DataFrame:
    """The rows whose key is one of a bounded list, by a broadcast of the list."""
    listed = rows.sparkSession.createDataFrame([(i,) for i in ids], f"{key} long")
    return rows.join(F.broadcast(listed), key, "left_semi")


#: What operators keep in a Python worker between tasks: module to a function that lets it go.
_KEPT: dict[str, Callable[[], None]] = {}


def keep_between_tasks(owner: str, forget: Callable[[], None]) -> None:
    """Say how to let go what the module `owner` keeps in a worker."""
    _KEPT[owner] = forget


def forget_others(owner: str) -> None:
    """Let go what other operators keep in this worker; workers are shared by all stages."""
    for name, forget in _KEPT.items():
        if name != owner:
            forget()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over Arrow batches: other operators' caches go when its task begins, freed memory when it ends."""
    owner = run.__module__

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped
