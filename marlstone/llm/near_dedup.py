"""MinHash near-deduplication with an LSH forest: sorted signature orders and longest-common-prefix neighbours.

1. Each document gives the set of its word shingles as 64-bit hashes, a digest of that set and a
   MinHash signature. Documents with equal sets are one class and only its representative goes on.
2. Each tree orders the representatives by a signature prefix of its own. The order is a range
   partitioning by (tree, prefix, id), so a region that holds a third of all rows spreads over
   partitions; the ends of neighbouring partitions meet in one more small pass. In each order a
   representative meets its neighbours, whose common prefix is as deep there as its region is dense but
   at least MIN_DEPTH values, and keeps those whose whole signatures agree most.
3. Links are confirmed on full shingle sets: in a few rounds the most alike pair of each
   representative that still joins two components, then all others that do.
4. The rest, exactly: in every region (equal prefix of MIN_DEPTH values) that holds several
   components, each row outside the region's largest component is a query against all rows of the
   region, first by signature and then on full sets. Queries and rows are dealt to a grid of small
   blocks, so a dense region is more blocks, never fewer comparisons.

So two documents are compared if they share a region in one of the trees, unless links already join
them. No pair of rows is ever expanded within a component.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import drop_tables, fresh, keep_between_tasks, materialise, once_each, tidy

WORD = re.compile("[^\x20\x09-\x0d]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Forest:
    """Parameters of the forest. `percent` is the threshold: 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80
    trees: int = 16
    depth: int = 6
    min_depth: int = 3
    #: Rows ahead in a sorted order that a row looks at, and how many of those it keeps.
    window: int = 16
    keep: int = 2
    #: Rounds in which each row's most alike open pair is confirmed, before all that are still open are.
    best_rounds: int = 3
    #: Rows of a block of queries, and of a block of the rows that they are compared with.
    block: int = 256
    #: Pairs stay candidates down to so many standard deviations of the estimate below the threshold.
    slack: float = 5.0

    @property
    def size(self) -> int:
        """Values of a signature; tree k orders by values k * depth to (k + 1) * depth."""
        return self.trees * self.depth

    @property
    def least_equal(self) -> int:
        """The least number of equal signature values of a candidate pair."""
        p = self.percent / 100
        return int(np.floor(self.size * p - self.slack * np.sqrt(self.size * p * (1 - p))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of n hash functions, by rule."""
    base = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _ODD)
    return base[:n] | np.uint64(1), base[n:]


class _Words(dict):
    """Word to 64-bit hash, bounded by starting again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_WORDS = _Words()
keep_between_tasks(__name__, _WORDS.clear)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the n-word shingles of a text.

    A-Z is lower-cased and words are runs without ASCII white space. A text of fewer words gives its
    whole sequence as one shingle; one without words gives none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    m = min(n, len(h))
    acc = np.full(len(h) - m + 1, m, np.uint64)
    for i in range(m):
        acc = _mixed(acc * _ODD + h[i : len(h) - m + 1 + i])
    return np.unique(acc)


def signature(sh: np.ndarray, k: int) -> np.ndarray:
    """k MinHash values (32 bits) of a non-empty set, in blocks so that long texts need little memory."""
    a, b = _seeds(k)
    out = np.full(k, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(sh), 2048):
        block = sh[i : i + 2048, None] * a + b
        np.minimum(out, block.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(">u4")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of distinct hashes reach the threshold."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x) or not len(y):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def sketch(docs: DataFrame, f: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, check (hash of the text), n_shingles, set_key (digest of the set; null if empty), sig (big-endian 32-bit values), brief (their low bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs, briefs = [], [], [], []
            for text in batch.column(2):
                sh = shingles(text.as_py(), f.words)
                n.append(len(sh))
                keys.append(hashlib.blake2b(sh.tobytes(), digest_size=16).digest() if len(sh) else None)
                sigs.append(signature(sh, f.size).tobytes() if len(sh) else None)
                briefs.append(sigs[-1][3::4] if len(sh) else None)
            made = [pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (keys, sigs, briefs))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "check", "n_shingles", "set_key", "sig", "brief"])

    return _named(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, check long, n_shingles long, set_key binary, sig binary, brief binary")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, check, text) of all rows."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("check"), F.col(text_col).alias("text"))


# --- candidates -----------------------------------------------------------------------------------

_SWEPT = "kind int, a long, b long, equal int, key binary, brief binary"
#: Bytes of a boundary's number before the key, where the ends of partitions meet.
_EDGE = 4
_SWEPT_PA = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("equal", pa.int32()), ("key", pa.binary()), ("brief", pa.binary())])


def _matrix(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _row_batch(kind: int, part: dict) -> pa.RecordBatch:
    n = len(part["id"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(part["id"]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array([x.tobytes() for x in part["key"]], pa.binary()), pa.array([x.tobytes() for x in part["brief"]], pa.binary())], schema=_SWEPT_PA)


def _neighbours(now: dict, upto: int, f: Forest, skip: int) -> pa.RecordBatch:
    """The pairs of the first `upto` rows of a sorted run with rows ahead; marks rows that share a region."""
    n, region = len(now["id"]), now["key"][:, : skip + 1 + 4 * f.min_depth]
    equal = np.full((f.window, upto), -1, np.int32)
    for d in range(1, min(f.window, n - 1) + 1):
        m = min(upto, n - d)
        at = np.flatnonzero((region[:m] == region[d : m + d]).all(axis=1))
        if not len(at):
            break  # rows of a region stand together
        now["shared"][at] = now["shared"][at + d] = True
        equal[d - 1, at] = (now["brief"][at] == now["brief"][at + d]).sum(axis=1)
    best = np.argsort(-equal, axis=0, kind="stable")[: f.keep]
    rows = np.broadcast_to(np.arange(upto), best.shape)
    got = np.take_along_axis(equal, best, 0)
    good = (got >= f.least_equal) & (now["id"][rows] != now["id"][np.minimum(rows + best + 1, n - 1)])
    a, b = now["id"][rows[good]], now["id"][(rows + best + 1)[good]]
    k = len(a)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(got[good].astype(np.int32)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], schema=_SWEPT_PA)


def _sweep(rows: DataFrame, f: Forest, ends: bool = True) -> DataFrame:
    """Over (key, brief, id), sorted by (key, id).

    Output rows: kind 0, a candidate pair (a, b, equal). With `ends`, for a range partitioning, also kind
    1, a row at an end of a partition, its key after the number of the boundary with the partition
    before or behind, and kind 2, a row that shares its region with another or stands at such an end.
    Kinds 1 and 2 have key, brief and a = id. Without, the keys are those of kind 1.
    """
    skip = 0 if ends else _EDGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: dict | None = None
        head_left = f.window
        own = TaskContext.get().partitionId()

        def end(boundary: int, part: dict) -> pa.RecordBatch:
            mark = np.broadcast_to(np.frombuffer(boundary.to_bytes(_EDGE, "big"), np.uint8), (len(part["id"]), _EDGE))
            return _row_batch(1, part | {"key": np.concatenate([mark, part["key"]], axis=1)})

        for batch in batches:
            if not batch.num_rows:
                continue
            now = {"key": _matrix(batch.column(0)), "brief": _matrix(batch.column(1)), "id": batch.column(2).to_numpy(), "shared": np.zeros(batch.num_rows, bool)}
            if ends and head_left:
                if head_left == f.window:
                    now["shared"][0] = True
                yield end(own, {k: v[:head_left] for k, v in now.items()})
                head_left = max(0, head_left - batch.num_rows)
            if tail:
                now = {k: np.concatenate([tail[k], now[k]]) for k in now}
            cut = max(0, len(now["id"]) - f.window)
            if cut:
                yield _neighbours(now, cut, f, skip)
                if ends:
                    yield _row_batch(2, {k: v[:cut][now["shared"][:cut]] for k, v in now.items()})
            tail = {k: v[cut:] for k, v in now.items()}
        if tail:
            yield _neighbours(tail, len(tail["id"]), f, skip)
            if ends:
                tail["shared"][-1] = True
                yield _row_batch(2, {k: v[tail["shared"]] for k, v in tail.items()})
                yield end(own + 1, tail)

    return rows.mapInArrow(tidy(run), _SWEPT)


def candidates(rows: DataFrame, f: Forest, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b, equal), and the rows (key, brief, id) that share a region, of rows (key, brief, id).

    A row that is alone in its region may be among the latter if it stands at an end of a partition.
    """
    swept = materialise(_sweep(rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id"), f), "swept", paths)
    # 2 * window rows of each partition, dealt by boundary.
    ends = swept.where("kind = 1").select("key", "brief", F.col("a").alias("id"))
    met = _sweep(ends.repartition(F.substring("key", 1, _EDGE)).sortWithinPartitions("key", "id"), f, ends=False)
    both = swept.where("kind = 0").unionByName(met.where("kind = 0"))
    pairs = both.groupBy("a", "b").agg(F.max("equal").alias("equal"))
    shared = swept.where("kind = 2").select("key", F.col("a").alias("id"), "brief")
    return materialise(pairs, "pairs", paths), materialise(shared, "shared", paths)


# --- regions of several components ----------------------------------------------------------------


def blocks(shared: DataFrame, comps: DataFrame, f: Forest, paths: list[str]) -> DataFrame:
    """Rows (g, id, comp, brief, query) of the regions that hold several components.

    A row outside its region's largest component is a query. A group g is one block of queries with
    one block of the region's rows (those are targets); the blocks of a region are a whole grid.
    """
    left = shared.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")).withColumn("region", F.substring("key", 1, 1 + 4 * f.min_depth))
    sizes = left.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("n"))
    stats = sizes.groupBy("region").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("major"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    stats = stats.select("region", "n", (F.col("n") - F.col("major.n")).alias("m"), F.col("major.comp").alias("major"))
    rows = materialise(left.join(stats, "region"), "regions", paths)
    nb, nq = (F.ceil(F.col(c) / f.block).cast("int") for c in ("n", "m"))
    own = F.xxhash64("id")
    targets = rows.select("region", "id", "comp", "brief", F.lit(False).alias("query"), F.pmod(own, nb).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), nq - 1)).alias("q"))
    asked = rows.where("comp <> major").select("region", "id", "comp", "brief", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), nb - 1)).alias("t"), F.pmod(own, nq).cast("int").alias("q"))
    return targets.unionByName(asked).select(F.concat("region", *(F.unhex(F.lpad(F.hex(c), 8, "0")) for c in ("t", "q"))).alias("g"), "id", "comp", "brief", "query")


def _by_group(dealt: DataFrame, run, schema: str) -> DataFrame:
    """Apply `run(group table) -> record batch or None` to the rows of each group g, which are dealt to one partition."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            if rest is not None:
                now = pa.concat_tables([rest, now]).combine_chunks()
            key = now.column("g").combine_chunks()
            starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)])) if len(key) else np.empty(0, int)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if (made := run(now.slice(a, b - a))) is not None:
                    yield made
            rest = now.slice(starts[-1]) if len(starts) else rest
        if rest is not None and rest.num_rows and (made := run(rest)) is not None:
            yield made

    return dealt.sortWithinPartitions("g").mapInArrow(tidy(groups), schema)


def promising(rows: DataFrame, f: Forest) -> DataFrame:
    """The rows (g, id, comp, query) of queries and targets whose signatures agree enough with one another's."""

    def run(t: pa.Table) -> pa.RecordBatch | None:
        query = t.column("query").to_numpy()
        if query.all() or not query.any():
            return None
        ids, comp = t.column("id").to_numpy(), t.column("comp").to_numpy()
        brief = _matrix(t.column("brief").combine_chunks())
        q, x = np.flatnonzero(query), np.flatnonzero(~query)
        good = np.zeros(len(ids), bool)
        for i in range(0, len(q), 32):
            part = q[i : i + 32]
            hit = ((brief[part][:, None, :] == brief[x][None, :, :]).sum(axis=2) >= f.least_equal) & (comp[part][:, None] != comp[x][None, :])
            good[part] = hit.any(axis=1)
            good[x] |= hit.any(axis=0)
        if not good.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(t.column("g").to_numpy(zero_copy_only=False)[good], pa.binary()), pa.array(ids[good]), pa.array(comp[good]), pa.array(query[good])], names=["g", "id", "comp", "query"])

    # By ranges of groups, which are drawn so that partitions have like numbers of rows.
    return _by_group(rows.repartitionByRange("g"), run, "g binary, id long, comp long, query boolean")


def confirm_blocks(rows: DataFrame, texts: DataFrame, f: Forest) -> DataFrame:
    """Links (a, b) between queries and targets of rows (g, id, comp, query); one for each query and component."""

    def run(t: pa.Table) -> pa.RecordBatch | None:
        query, ids, comp, check = (t.column(c).to_numpy(zero_copy_only=False) for c in ("query", "id", "comp", "check"))
        keys = list(zip(ids.tolist(), check.tolist(), strict=True))
        known: dict[tuple[int, int], np.ndarray] = {}
        for key, text in zip(keys, t.column("text"), strict=True):
            if key not in known:
                known[key] = shingles(text.as_py(), f.words)
        x = np.flatnonzero(~query)
        if not len(x):
            return None
        values = np.concatenate([known[keys[i]] for i in x])
        sizes = np.array([len(known[keys[i]]) for i in x])
        owner = np.repeat(np.arange(len(x)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        a, b = [], []
        for k in np.flatnonzero(query):
            own = known[keys[k]]
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            lo, hi = lo[hi > lo], hi[hi > lo]
            n = hi - lo
            places = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, int)
            both = np.bincount(owner[places], minlength=len(x))
            hit = np.flatnonzero((100 * both >= f.percent * (len(own) + sizes - both)) & (both > 0) & (comp[x] != comp[k]))
            _, first = np.unique(comp[x][hit], return_index=True)
            b += ids[x][hit[first]].tolist()
            a += [int(ids[k])] * len(first)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"]) if a else None

    return _by_group(rows.join(texts.hint("merge"), "id").repartition("g"), run, "a long, b long")


# --- links and components -------------------------------------------------------------------------


def confirm(pairs: DataFrame, texts: DataFrame, f: Forest) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. texts: (id, check, text)."""
    side = lambda i: texts.select(F.col("id").alias(i), F.col("check").alias(f"c{i}"), F.col("text").alias(f"t{i}")).hint("merge")
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ca", "cb", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple[int, int], np.ndarray] = {}  # rows come sorted by b, so its set is used again

            def of(key: tuple[int, int], text: pa.Scalar, known=known) -> np.ndarray:
                if key not in known:
                    if len(known) > 64:
                        known.clear()
                    known[key] = shingles(text.as_py(), f.words)
                return known[key]

            a, b, ca, cb = (batch.column(i).to_pylist() for i in range(4))
            keep = [linked(of((a[k], ca[k]), batch.column(4)[k]), of((b[k], cb[k]), batch.column(5)[k]), f.percent) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every end of an edge (a, b): comp is the smallest id that can be reached.

    Labels go to the smallest label among the neighbours and then to that label's own label, which
    halves paths. Labels only fall, so it ends; each round is a table in the shared folder.
    """
    spark = edges.sparkSession
    paths: list[str] = []
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", paths)
    old: list[str] = []
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "labels", old)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        low = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("comp").alias("before"), F.least("comp", "near").alias("comp"))
        # Labels that are their own label lead no further, so the label of a giant component meets nothing here.
        own = labels.where("id <> comp").select(F.col("id").alias("comp"), F.col("comp").alias("above"))
        best = F.least("comp", F.coalesce("above", "comp"))
        made: list[str] = []
        new = materialise(low.join(own, "comp", "left").select("id", best.alias("comp"), (best != F.col("before")).alias("moved")), "labels", made)
        drop_tables(spark, old)
        labels, old = new.select("id", "comp"), made
        if not new.where("moved").take(1):
            drop_tables(spark, paths)
            return labels


def joined(comps: DataFrame, edges: DataFrame, paths: list[str]) -> DataFrame:
    """The components (id, comp) with further edges (a, b): only components that edges meet are labelled again."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comps, "id", "left_anti")
    base = comps.unionByName(ends.select("id", F.col("id").alias("comp")))
    lifted = _lifted(edges, comps).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    moved = components(lifted).select(F.col("id").alias("comp"), F.col("comp").alias("root"))
    return materialise(base.join(moved, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "components", paths)


def _lifted(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose ends are in two components, with these as ca and cb."""
    a = comps.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
    b = comps.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    found = pairs.join(a, "a", "left").join(b, "b", "left").withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))
    return found.where("ca <> cb")


def classes(docs: DataFrame, f: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, check (hash of the text), n_shingles, class_id (smallest id with an equal set), component_id.

    Null and empty texts, and texts of white space, have an empty set and link with nothing: class
    and component are their own id. Rows without an id never represent a class; where a set has no
    other rows its class and component are null. Rows that share an id may have different texts:
    different sets of which it is the smallest id are one node, whose links are those of all of them.
    Other columns are ignored. An empty table gives no rows.
    """
    f = f or Forest()
    sketches = materialise(sketch(docs, f, id_col, text_col), "sketches")
    sets = sketches.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    reps = sets.groupBy("set_key").agg(F.min(F.struct("doc_id", "check", "sig", "brief")).alias("rep"))
    reps = materialise(reps.select("set_key", F.col("rep.doc_id").alias("id"), F.col("rep.check").alias("check"), F.col("rep.sig").alias("sig"), F.col("rep.brief").alias("brief")), "representatives")
    comps = _linked_components(_named(docs, id_col, text_col), reps, f)
    named = reps.select("set_key", F.col("id").alias("class_id")).join(comps.withColumnRenamed("id", "class_id"), "class_id", "left")
    out = sketches.select("doc_id", "check", "n_shingles", "set_key").join(named, "set_key", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    return out.select("doc_id", "check", "n_shingles", F.coalesce("class_id", alone).alias("class_id"), F.coalesce("comp", "class_id", alone).alias("component_id"))


def _linked_components(texts: DataFrame, reps: DataFrame, f: Forest) -> DataFrame:
    """(id, comp) of the representatives that have links. reps: (id, check, sig, brief); texts: (id, check, text) of all rows."""
    spark = texts.sparkSession
    paths: list[str] = []
    tree = F.sequence(F.lit(0), F.lit(f.trees - 1))
    keys = F.transform(tree, lambda t: F.concat(F.unhex(F.lpad(F.hex(t), 2, "0")), F.substring("sig", t * (4 * f.depth) + 1, F.lit(4 * f.depth))))
    pairs, shared = candidates(reps.select(F.explode(keys).alias("key"), "brief", "id"), f, paths)
    end = F.explode(F.array("a", "b")).alias("id")
    # The one shuffle of all texts: from here on only those of rows that share a region move.
    nodes = pairs.select(end).unionByName(shared.select("id")).distinct()
    wanted = reps.select("id", "check").join(nodes, "id", "left_semi")
    near = materialise(texts.join(wanted.hint("merge"), ["id", "check"], "left_semi").dropDuplicates(["id", "check"]), "texts", paths)
    comps = tested = None
    for turn in range(f.best_rounds + 1):
        left = pairs if tested is None else materialise(_lifted(pairs.join(tested, ["a", "b"], "left_anti"), comps).select("a", "b", "equal"), "crossing", paths)
        if turn < f.best_rounds:  # the most alike pair of each row; most of the others are then within a component
            best = left.select(end, F.struct("equal", F.xxhash64("a", "b").alias("any"), "a", "b").alias("p")).groupBy("id").agg(F.max("p").alias("p"))
            left = materialise(best.select("p.a", "p.b").distinct(), "best", paths)
        found = materialise(confirm(left, near, f), "links", paths)
        comps = components(found) if comps is None else joined(comps, found, paths)
        tested = left.select("a", "b") if tested is None else tested.unionByName(left.select("a", "b"))
    asked = materialise(promising(blocks(shared, comps, f, paths), f), "asked", paths)
    more = materialise(confirm_blocks(asked, near, f), "links", paths)
    out = materialise(joined(comps, more, paths) if more.take(1) else comps, "components")
    drop_tables(spark, paths)
    return out


def deduplicate(docs: DataFrame, f: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each component those of the smallest id.

    Rows without an id all stay, as no component can be named by them. Where rows share an id that
    stays, each of its texts stays once. Null and empty texts stay. An empty table gives no rows.
    """
    key, check = fresh(docs, "row_key", "row_check")
    found = classes(docs, f, id_col, text_col).where("doc_id IS NOT NULL")
    # A text always has the same component under one id.
    found = materialise(found.groupBy("doc_id", "check").agg(F.min("component_id").alias("comp"), F.count(F.lit(1)).alias("n")), "classes")
    narrow = lambda rows: rows.select(F.col("doc_id").alias(key), F.col("check").alias(check))
    tagged = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(check, F.xxhash64(text_col))
    return once_each(tagged, materialise(narrow(found.where("doc_id <> comp")), "dropped"), materialise(narrow(found.where("doc_id = comp AND n > 1")), "again"), [key, check]).select(*docs.columns)


def op4_minhash_near_dedup(docs: DataFrame) -> DataFrame:
    """The contract's columns, at 100 * intersection >= 85 * union."""
    found = classes(docs, Forest(percent=85))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
