"""Benchmark decontamination with an Aho-Corasick automaton over normalised item windows.

Texts are normalised to ASCII-lower-case words joined by single spaces. Each item gives its windows
of WINDOW consecutive words (a shorter item is one window); one automaton holds all of them and each
document is scanned once. Word places are kept, so that hits map back to code-point spans of the
original text.

The automaton is built once per Python worker from a block of items whose size is checked: items
beyond `max_block_bytes` go to further blocks, each with its own automaton and pass over the
documents, so no automaton grows with the benchmark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import keep_between_tasks, materialise, tidy

WINDOW = 10
MAX_BLOCK_BYTES = 1_000_000
#: Passes in a row before the accumulated hits are written down, as each holds an automaton.
CHAIN = 4

#: Bytes outside words become spaces, A-Z becomes a-z, everything else stays.
#: WORD finds the same words in the original text, where A-Z are not folded yet.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text in UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Windows:
    """The automaton of a block of items: [(item_id, text)]. Its letters are word numbers; 0 is any other word."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(words[i : i + window], set()).add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, ids in found.items():
            self.machine.add_word(key, (len(key), frozenset(ids)))
        self.empty = not found
        if found:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [first, end) word ranges that windows cover, and the items whose windows occur."""
        if self.empty or not words:
            return [], set()
        ranges, items = [], set()
        for last, (n, ids) in self.machine.iter(tuple(map(self.number.get, words, repeat(0)))):
            ranges.append((last + 1 - n, last + 1))
            items |= ids
        return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_BUILT: dict[str, Windows] = {}
keep_between_tasks(__name__, _BUILT.clear)


def _automaton(items: list[tuple[str | None, str | None]], window: int, key: str) -> Windows:
    """The block's automaton, built once per Python worker."""
    if key not in _BUILT:
        if len(_BUILT) >= CHAIN:
            _BUILT.clear()
        _BUILT[key] = Windows(items, window)
    return _BUILT[key]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, max_block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Item lists of at most `max_block_bytes` of text (one item at least), never all at once on the driver."""
    rows = benchmark.select(F.col(item_col).cast("string"), text_col)
    block: list[tuple[str | None, str | None]] = []
    size = 0
    for item, text in rows.toLocalIterator():
        n = len((text or "").encode())
        if block and size + n > max_block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


_PAIR = lambda a, b: pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())]))
_FIELDS = [("doc_id", "long", pa.int64()), ("n_words", "long", pa.int64()), ("ranges", "array<struct<first:int,end:int>>", _PAIR("first", "end")), ("spans", "array<struct<start:int,end:int>>", _PAIR("start", "end")), ("items", "array<string>", pa.list_(pa.string())), ("text", "string", pa.string())]


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, hit word ranges, hit code-point spans of the original, sorted items.

    Null and empty texts have no words and no hits. Items without words never occur, those
    without an id only leave no id; repeated items count once. An empty benchmark hits nothing, but every document is
    returned. Other columns are ignored.
    """
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def passed(out: DataFrame, shipped: Broadcast, key: str, first: bool, last: bool) -> DataFrame:
        fields = _FIELDS[:-1] if last else _FIELDS

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = _automaton(shipped.value, window, key)
            schema = pa.schema([(n, t) for n, _, t in fields])
            for batch in batches:
                cols = {"n_words": [], "ranges": [], "spans": [], "items": []}
                texts = batch.column(batch.schema.get_field_index("text"))
                before = repeat((None, None)) if first else zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)
                for text, (old_ranges, old_items) in zip(texts, before, strict=False):
                    text = text.as_py()
                    words = words_of(text)
                    ranges, found = windows.scan(words)
                    if old_ranges:
                        ranges = merged([*ranges, *((r["first"], r["end"]) for r in old_ranges)])
                        found = found.union(old_items)
                    at = [m.span() for m in WORD.finditer(text)] if ranges else []
                    cols["n_words"].append(len(words))
                    cols["ranges"].append([{"first": a, "end": b} for a, b in ranges])
                    cols["spans"].append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges])
                    cols["items"].append(sorted(x for x in found if x is not None))
                cols |= {"doc_id": batch.column(0), "text": texts}
                yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) if isinstance(cols[n], list) else cols[n].cast(t) for n, _, t in fields], schema=schema)

        return out.mapInArrow(tidy(scan), ", ".join(f"{n} {t}" for n, t, _ in fields))

    return _over_blocks(out, benchmark, item_col, item_text_col, window, max_block_bytes, passed)


def _over_blocks(out: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int, max_block_bytes: int, passed: Callable[[DataFrame, Broadcast, str, bool, bool], DataFrame]) -> DataFrame:
    """Apply a pass for each block of items: passed(rows, the block as a broadcast, its key, whether it is first, whether last).

    After CHAIN passes the rows are written down and those blocks let go, so that neither a worker nor the
    driver holds more of them.
    """
    context = out.sparkSession.sparkContext
    held: list[Broadcast] = []
    blocks = blocks_of(benchmark, item_col, text_col, max_block_bytes)
    items, first = next(blocks), True
    while items is not None:
        after = next(blocks, None)
        if len(held) == CHAIN:
            out = materialise(out, "hits")
            while held:
                held.pop().destroy()
        held.append(context.broadcast(items))
        out = passed(out, held[-1], hashlib.sha256(repr((window, items)).encode("utf-8", "surrogatepass")).hexdigest(), first, after is None)
        items, first = after, False
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", text_col: str = "text", window: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` in which no window occurs, with all their columns; null texts stay."""

    def passed(docs: DataFrame, shipped: Broadcast, key: str, first: bool, last: bool) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = _automaton(shipped.value, window, key)
            for batch in batches:
                text = batch.column(batch.schema.get_field_index(text_col))
                yield batch.filter(pa.array([not windows.scan(words_of(t.as_py()))[0] for t in text], pa.bool_()))

        return docs.mapInArrow(tidy(keep), docs.schema)

    return _over_blocks(docs, benchmark, item_col, item_text_col, window, max_block_bytes, passed)


def op7_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns, from the hit ranges and items of every block."""
    hits = find_hits(docs, benchmark)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["first"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
    )
