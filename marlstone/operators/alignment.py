"""Candidate corrections by aligning a recognised text with evidence lines, and decisions on them.

Enumeration needs difflib's blocks and token offsets and runs Arrow-batched, with what else a request's row settles: merging,
conflicts and capacity. Decisions are DataFrame operations.
"""

from __future__ import annotations

import heapq
import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from marlstone.functions import guards
from marlstone.functions.text import placed_regions, splice_all
from marlstone.functions.unicode import TOKEN, _match, match_text
from marlstone.operators.incremental import content_id

#: Content tokens of an anchor, of an anchor that bears a gap open at one side, and of such a gap at most.
LEAST_ANCHOR = 2
LEAST_SUPPORT = 3
EDGE_WINDOW = 4
#: Tokens and code points of either side of a candidate, candidates of a request and its bytes at most.
MAX_TOKENS = 12
MAX_CHARS = 80
MAX_CANDIDATES = 24
MAX_BYTES = 24_000
#: Candidates that are handed back together, and code points that are aligned at once.
MOST_ROWS = 20_000
MOST_CHARS = 500_000

#: Pairs of equal runs of two ranges up to which all common runs of the ranges are listed.
SMALL = 8_000
#: Bytes of a candidate's identifier: c_ and a SHA-256 in hex.
ID_BYTES = 66


class _Runs:
    """Common runs of two lists of numbers from 0.

    Runs of 1, 2, 4, ... elements get numbers once; a run of any length is two of those, so runs are compared by number.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.n, self.m = len(a), len(b)
        #: levels[p][i] is the number of the run of 2 ** p elements from i; those that leave their list have numbers of their own.
        self.levels = [np.concatenate([a, b])]

    def level(self, p: int) -> np.ndarray:
        n, levels = self.n, self.levels
        while len(levels) <= p:
            half, last = 1 << (len(levels) - 1), levels[-1]
            after = np.full(len(last), -1, np.int64)
            after[:-half or None] = last[half:] if half < len(last) else -1
            after[max(0, n - half) : n] = -2 - np.arange(min(n, half))  # over the end of a
            key = last * (2 * len(last) + 2) + after + len(last) + 1
            levels.append(np.unique(key, return_inverse=True)[1])
        return levels[p]

    def runs(self, lo: int, hi: int, size: int) -> np.ndarray:
        """A number for each run of `size` elements inside [lo, hi) of the first list and, behind it, the second."""
        p = size.bit_length() - 1
        ranks = self.level(p)
        if size == 1 << p:
            return ranks[lo : hi - size + 1]
        return ranks[lo : hi - size + 1] * (len(ranks) + 1) + ranks[lo + size - (1 << p) : hi - (1 << p) + 1]

    def both(self, alo: int, ahi: int, blo: int, bhi: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(alo, ahi, size), self.runs(self.n + blo, self.n + bhi, size)

    def listed(self, alo: int, ahi: int, blo: int, bhi: int, size: int, most: int) -> list[tuple[int, int, int]] | None:
        """All common runs of `size` elements or more that can't be extended, as heap entries (-length, i, j); None beyond `most` pairs."""
        mine, theirs = self.both(alo, ahi, blo, bhi, size)
        if size & (size - 1) == 0 and (ahi - alo, bhi - blo) == (self.n, self.m):  # numbers are dense
            if int(np.bincount(mine, minlength=len(self.levels[0]))[theirs].sum()) > most:
                return None
        order = np.argsort(theirs, kind="stable")
        ranked = theirs[order]
        first = np.searchsorted(ranked, mine)
        count = np.searchsorted(ranked, mine, "right") - first
        total = int(count.sum())
        if not 0 < total <= most:
            return None if total else []
        i = np.repeat(np.arange(len(mine)), count)
        j = order[np.repeat(first - np.cumsum(count) + count, count) + np.arange(total)]
        by = np.argsort(j - i, kind="stable")
        i, j = i[by], j[by]
        starts = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(j) != 1)])
        length = np.diff(np.r_[starts, total]) + size - 1
        return list(zip((-length).tolist(), (i[starts] + alo).tolist(), (j[starts] + blo).tolist(), strict=True))

    def longest(self, alo: int, ahi: int, blo: int, bhi: int, least: int) -> list[tuple[int, int, int]]:
        """The longest common run of two ranges by halving over lengths, of equal ones the first in a and then in b."""
        low, high = 0, min(ahi - alo, bhi - blo)
        while low < high:
            size = (low + high + 1) // 2
            if np.isin(*self.both(alo, ahi, blo, bhi, size)).any():
                low = size
            else:
                high = size - 1
        if low < least:
            return []
        mine, theirs = self.both(alo, ahi, blo, bhi, low)
        i = int(np.isin(mine, theirs).argmax())
        return [(alo + i, blo + int((theirs == mine[i]).argmax()), low)]

    def blocks(self, small: int, least: int) -> list[tuple[int, int, int]]:
        out, todo = [], [(0, self.n, 0, self.m)]
        while todo:
            part = alo, ahi, blo, bhi = todo.pop()
            most, size, heap = min(ahi - alo, bhi - blo), least, None
            while size <= most and (heap := self.listed(*part, size, small)) is None:
                size *= 2
            if heap is None and most < least:
                continue
            # Blocks of `size` or more depend on such runs only; shorter ones lie in the cells between them.
            found = _longest_first(heap, *part, size) if heap else []
            if heap is not None and size == least:
                out += found
                continue
            found = found or self.longest(*part, least)
            out += found
            if found:
                ends = [(alo, blo), *((i + n, j + n) for i, j, n in found)]
                todo += [(x, i, y, j) for (x, y), (i, j) in zip(ends, [*((i, j) for i, j, _ in found), (ahi, bhi)], strict=True)]
        return sorted(out)


def _longest_first(heap: list[tuple[int, int, int]], alo: int, ahi: int, blo: int, bhi: int, least: int) -> list[tuple[int, int, int]]:
    """The blocks that taking the longest run of every cell gives, in order; a run is cut to the cells that it meets."""
    heapq.heapify(heap)
    at: list[int] = []
    blocks: list[tuple[int, int, int]] = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n, k = -n, bisect_right(at, i)
        while True:
            p, q, size = blocks[k - 1] if k else (alo, blo, 0)
            right, low = (blocks[k][0], blocks[k][1]) if k < len(blocks) else (ahi, bhi)
            lower, upper = max(0, p + size - i, q + size - j), min(n, right - i, low - j)
            if lower == 0 and upper == n:
                at.insert(k, i)
                blocks.insert(k, (i, j, n))
                break
            if upper - lower >= least:
                heapq.heappush(heap, (lower - upper, i + lower, j + lower))
            if k == len(blocks) or right >= i + n:
                break
            k += 1
    return blocks


def matching_blocks(a: list[str], b: list[str], small: int = SMALL, least: int = 1) -> list[tuple[int, int, int]]:
    """The blocks (place in a, place in b, size) of `least` elements or more that difflib finds without junk, for long lists too.

    The longest common run, of equal ones the first in a and then in b, and the same on both sides of it.
    """
    code: dict[str, int] = {}
    numbers = [np.array([code.setdefault(x, len(code)) for x in part], np.int64) for part in (a, b)]
    return _Runs(*numbers).blocks(small, least)


#: Kinds of ASCII bytes: letter, digit, white space (as Python's patterns see it), and others, which are tokens of their own.
LETTER, DIGIT, SPACE, OTHER = 1, 2, 0, 3
_KINDS = np.array([LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SPACE if chr(c).isspace() else OTHER for c in range(128)], np.int8)
#: Bytes of a key that are its number; longer keys and those of other scripts get numbers from here on.
PACKED = 8
NAMED = 1 << 63
#: Numbers of which only the k low bytes are set.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(PACKED + 1)], np.uint64)
#: Lengths of common runs that are looked for one after the other, each between those found before.
LENGTHS = (32, 8, 4, 2)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of several ranges one after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - before, size)


def _mixed(numbers: np.ndarray, seed: int) -> np.ndarray:
    """Well spread numbers of 64 bits."""
    x = (numbers + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Texts:
    """The tokens of texts one after the other: where they stand in their text, the numbers of their keys, and which are content."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        names: dict[str, int] = {}
        plain = [k for k, t in enumerate(texts) if t.isascii()]
        parts = [self._ascii([texts[k] for k in plain], names)]
        for k, t in enumerate(texts):
            if not t.isascii():
                spans = np.array([m.span() for m in TOKEN.finditer(t)], np.int64).reshape(-1, 2)
                said = [t[s:e] for s, e in spans.tolist()]
                parts.append((spans[:, 0], spans[:, 1], np.array([self._number(x.casefold(), names) for x in said], np.uint64), np.array([x[0].isalnum() for x in said], bool), np.array([len(said)])))
        starts, ends, numbers, content, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(parts) > 1:
            place = np.array(plain + [k for k, t in enumerate(texts) if not t.isascii()])
            order = np.argsort(place)
            at = _ranges((np.cumsum(counts) - counts)[order], counts[order])
            starts, ends, numbers, content, counts = starts[at], ends[at], numbers[at], content[at], counts[order]
        self.starts, self.ends, self.numbers, self.content = starts, ends, numbers, content
        #: The first token of each text, and the content tokens before each token.
        self.first = np.r_[0, np.cumsum(counts)]
        self.before = np.r_[0, np.cumsum(content)]

    @staticmethod
    def _number(key: str, names: dict[str, int]) -> int:
        if key.isascii() and len(key) <= PACKED:
            return int.from_bytes(key.encode(), "little")
        return NAMED + names.setdefault(key, len(names))

    def _ascii(self, texts: list[str], names: dict[str, int]) -> tuple[np.ndarray, ...]:
        """As TOKEN splits: words with apostrophes between letters, runs of digits, and other characters one by one."""
        low = "\n".join([*texts, ""]).lower()
        raw = np.frombuffer(low.encode() + b"\n" * PACKED, np.uint8)
        kind = _KINDS[raw]
        if "'" in low:
            letter = kind == LETTER
            kind[1:-1][(raw[1:-1] == ord("'")) & letter[:-2] & letter[2:]] = LETTER
        edge = np.ones(len(raw), bool)
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == OTHER
        starts = np.flatnonzero(edge)
        kinds, ends = kind[starts], np.append(starts[1:], len(raw))
        there = kinds != SPACE
        starts, ends, kinds = starts[there], ends[there], kinds[there]
        size = ends - starts
        # The eight bytes from each token on, without those behind its end.
        cells = np.lib.stride_tricks.as_strided(raw, (len(raw) - PACKED + 1, PACKED), (1, 1))[starts]
        numbers = np.ascontiguousarray(cells).view("<u8").ravel().astype(np.uint64) & _LOW[np.minimum(size, PACKED)]
        large = np.flatnonzero(size > PACKED)
        numbers[large] = np.array([names.setdefault(low[s:e], len(names)) for s, e in zip(starts[large].tolist(), ends[large].tolist(), strict=True)], np.uint64) + np.uint64(NAMED)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        offsets = np.cumsum(lengths) - lengths
        first = np.searchsorted(starts, np.append(offsets, len(raw)))
        counts = np.diff(first)
        own = np.repeat(offsets, counts)
        return starts - own, ends - own, numbers, kinds != OTHER, counts

    def span(self, text: int, i: int, j: int) -> tuple[int, int]:
        """Where the tokens from i to before j stand in their text; an empty range stands before token i."""
        if j > i:
            return int(self.starts[i]), int(self.ends[j - 1])
        lo, hi = int(self.first[text]), int(self.first[text + 1])
        at = int(self.starts[i]) if i < hi else int(self.ends[hi - 1]) if hi > lo else 0
        return at, at

    def beside(self, text: int, edge: int, n: int, step: int) -> tuple[int, int] | None:
        """The range of tokens from an edge on (step 1) or back (-1) with n content tokens, punctuation next to them included."""
        way = range(edge, int(self.first[text + 1])) if step > 0 else range(edge - 1, int(self.first[text]) - 1, -1)
        size = found = 0
        for seen in accumulate(int(self.content[i]) for i in way):
            if seen > n:
                break
            size, found = size + 1, seen
        if found < n:
            return None
        return (edge, edge + size) if step > 0 else (edge - size, edge)

    def pairs_seen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How often each token and its next one stand in their text (0 for a text's last token), tokens with equal pairs side by side, and where each token's group of those begins."""
        counts = np.diff(self.first)
        own = np.repeat(np.arange(len(counts)), counts)
        at = np.flatnonzero(own[1:] == own[:-1])
        one, two, text = self.numbers[at], self.numbers[at + 1], own[at]
        for seed in range(1, 100):
            key = _mixed(_mixed(one, seed) + two, seed) + _mixed(text.astype(np.uint64), seed + 1)
            order = np.argsort(key, kind="stable")
            key = key[order]
            same = key[1:] == key[:-1]
            x, y = order[1:][same], order[:-1][same]
            if (one[x] == one[y]).all() and (two[x] == two[y]).all() and (text[x] == text[y]).all():
                break
        else:
            raise ArithmeticError("pairs of tokens can't be told apart")
        begins = np.flatnonzero(np.r_[True, ~same]) if len(at) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begins, len(at)))
        seen, group = np.zeros(len(own) + 1, np.int64), np.zeros(len(own) + 1, np.int64)
        seen[at[order]], group[at[order]] = np.repeat(sizes, sizes), np.repeat(begins, sizes)
        return seen, at[order], group


def _common(a: np.ndarray, b: np.ndarray, cells: np.ndarray, least: int) -> np.ndarray:
    """The blocks (place in a, place in b, size) of `least` tokens or more of all cells (rows of alo, ahi, blo, bhi, in order), as difflib takes them.

    Runs of the larger lengths are taken first. They part the cells, so that shorter runs meet few others. Equal runs are
    found by well spread sums and then held against the tokens. Cells in which runs repeat too often are left to `_Runs`.
    """
    done, hard = [], []
    sums = {1: (_mixed(a, 1), _mixed(b, 1))}
    size = 1
    while size < LENGTHS[0]:
        pair = []
        for x in sums[size]:
            y = x * np.uint64(0xD6E8FEB86659FD93) ^ (x >> np.uint64(31))
            y[:-size or None] += x[size:] if size < len(x) else 0
            pair.append(y)
        size *= 2
        sums[size] = tuple(pair)
    for size in [n for n in LENGTHS if n > least] + [least]:
        cells = cells[np.minimum(cells[:, 1] - cells[:, 0], cells[:, 3] - cells[:, 2]) >= least]
        fit = np.flatnonzero(np.minimum(cells[:, 1] - cells[:, 0], cells[:, 3] - cells[:, 2]) >= size)
        if not len(fit):
            continue
        sides = []
        for k, x in enumerate(sums[size]):
            n = cells[fit, 2 * k + 1] - cells[fit, 2 * k] - size + 1
            at, own = _ranges(cells[fit, 2 * k], n), np.repeat(fit, n)
            sides.append((x[at] + _mixed(own.astype(np.uint64), 2), at, own))
        bits = np.uint64(64 - max(16, min(24, len(sides[1][0]).bit_length() + 3)))
        for k in (0, 1):  # what has no partner goes
            seen = np.zeros(1 << int(64 - bits), bool)
            seen[(sides[1 - k][0] >> bits)] = True
            keep = seen[sides[k][0] >> bits]
            sides[k] = tuple(x[keep] for x in sides[k])
        (mine, i, own), (theirs, j, their_own) = sides
        order = np.argsort(theirs)
        ranked = theirs[order]
        first = np.searchsorted(ranked, mine)
        count = np.searchsorted(ranked, mine, "right") - first
        many = np.bincount(own, weights=count, minlength=len(cells))
        over = many > np.maximum(SMALL, 8 * (cells[:, 1] - cells[:, 0]))
        if over.any():
            hard.append(cells[over])
            count[over[own]] = 0
        total = int(count.sum())
        j = j[order[np.repeat(first - np.cumsum(count) + count, count) + np.arange(total)]]
        i = np.repeat(i, count)
        key = np.sort((j - i + len(a)) * (len(a) + 1) + i)
        starts = np.flatnonzero(np.diff(key, prepend=-2) != 1)
        length = np.diff(np.append(starts, total)) + size - 1
        i = key[starts] % (len(a) + 1)
        j = key[starts] // (len(a) + 1) - len(a) + i
        wrong = np.repeat(np.arange(len(i)), length)[a[_ranges(i, length)] != b[_ranges(j, length)]]
        inside = np.searchsorted(cells[:, 0], i, "right") - 1
        outside = (j < cells[inside, 2]) | (j + length > cells[inside, 3]) | (i + length > cells[inside, 1])
        if len(wrong) or outside.any():  # equal sums of unlike runs
            bad = np.zeros(len(cells), bool)
            bad[inside[wrong]] = bad[inside[outside]] = True
            hard.append(cells[bad & ~over])
            over |= bad
            keep = ~bad[inside]
            i, j, length = i[keep], j[keep], length[keep]
        order = np.lexsort((j, i))
        taken = _taken(i[order], j[order], length[order], size)
        done.append(taken)
        # What is left of the cells: before, between and behind their blocks.
        cells = cells[~over]
        inside = np.searchsorted(cells[:, 0], taken[:, 0], "right") - 1
        ahead, behind = (np.searchsorted(inside, np.arange(len(cells)), side) for side in ("left", "right"))
        ends = taken[:, :2] + taken[:, 2:]
        cells = np.stack([np.insert(ends[:, 0], ahead, cells[:, 0]), np.insert(taken[:, 0], behind, cells[:, 1]), np.insert(ends[:, 1], ahead, cells[:, 2]), np.insert(taken[:, 1], behind, cells[:, 3])], 1)
    for alo, ahi, blo, bhi in np.concatenate(hard).tolist() if hard else []:
        codes = np.unique(np.concatenate([a[alo:ahi], b[blo:bhi]]), return_inverse=True)[1].astype(np.int64)
        found = _Runs(codes[: ahi - alo], codes[ahi - alo :]).blocks(SMALL, least)
        done.append(np.array(found, np.int64).reshape(-1, 3) + [alo, blo, 0])
    out = np.concatenate(done) if done else np.zeros((0, 3), np.int64)
    return out[np.argsort(out[:, 0])]


def _taken(i: np.ndarray, j: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """The blocks that runs in order give: those that all others lie before or behind stand as they are, the rest are taken longest first."""
    if not len(i):
        return np.zeros((0, 3), np.int64)
    reach = np.maximum.accumulate(i + n), np.maximum.accumulate(j + n)
    parted = (reach[0][:-1] <= i[1:]) & (reach[1][:-1] <= np.minimum.accumulate(j[::-1])[::-1][1:])
    begins = np.flatnonzero(np.r_[True, parted])
    sizes = np.diff(np.append(begins, len(i)))
    runs = np.stack([i, j, n], 1)
    out = [runs[begins[sizes == 1]]]
    sizes, begins = sizes[sizes > 1], begins[sizes > 1]
    at = _ranges(begins, sizes)
    listed = list(zip((-n[at]).tolist(), i[at].tolist(), j[at].tolist(), strict=True))
    found, ahead = [], 0
    for size in sizes.tolist():
        heap = listed[ahead : ahead + size]
        ahead += size
        found += _longest_first(heap, heap[0][1], max(x[1] - x[0] for x in heap), min(x[2] for x in heap), max(x[2] - x[0] for x in heap), least)
    out.append(np.array(found, np.int64).reshape(-1, 3))
    out = np.concatenate(out)
    return out[np.argsort(out[:, 0])]


class _Side:
    """A text that is aligned."""

    def __init__(self, text: str) -> None:
        self.text = text


def gaps(heard: str, line: str) -> list[tuple]:
    """Spans of the heard text that the line words otherwise: (start, end, original, replacement, operation, alignment, support, reasons).

    Anchors are common runs of tokens with LEAST_ANCHOR content tokens or more that occur once in both texts.
    A gap lies between two anchors, or before the first or behind the last one if the line has at most
    EDGE_WINDOW content tokens there; then it takes as many of the heard text. support is the content tokens
    of the one anchor of such a gap. reasons say why a gap is no candidate: nothing of content on one side, the
    same content, or too long.
    """
    return _gaps(_Side(heard), _Side(line))


def _gaps(a: _Side, b: _Side) -> list[tuple]:
    return all_gaps([(a.text, b.text)])[0]


#: Operations and reasons of a gap by number.
_OPERATIONS = ("replace", "insert", "delete")
_REASONS = [[*([] if op == "replace" else [f"{op}_diagnostic"]), *["long_span"] * long, *["surface_only"] * surface] for op in _OPERATIONS for long in (0, 1) for surface in (0, 1)]


def all_gaps(pairs: list[tuple[str, str]]) -> list[list[tuple]]:
    """The gaps of many pairs of texts, as `gaps` has them, found at once."""
    out: list[list[tuple]] = [[] for _ in pairs]
    unlike = [k for k, (heard, line) in enumerate(pairs) if heard != line and heard and line]
    if not unlike:
        return out
    number: dict[str, int] = {}
    ours, lines = (np.array([number.setdefault(pairs[k][side], len(number)) for k in unlike]) for side in (0, 1))
    t = _Texts(list(number))
    # Texts stand once for each of their pairs: the tokens of either side, and where each pair's begin.
    places, begins = [], []
    for side in (ours, lines):
        n = t.first[side + 1] - t.first[side]
        places.append(_ranges(t.first[side], n))
        begins.append(np.r_[0, np.cumsum(n)])
    (mine, theirs), (alo, blo) = places, begins
    found = _common(t.numbers[mine], t.numbers[theirs], np.stack([alo[:-1], alo[1:], blo[:-1], blo[1:]], 1), LEAST_ANCHOR)
    pair = np.searchsorted(alo, found[:, 0], "right") - 1
    i, j, n = mine[found[:, 0]], theirs[found[:, 1]], found[:, 2]
    weight = t.before[i + n] - t.before[i]
    # A run with LEAST_ANCHOR content tokens has as many tokens, and shorter blocks bear on shorter ones only.
    keep = weight >= LEAST_ANCHOR
    seen, ranked, group = t.pairs_seen()
    raw = t.numbers.tobytes()
    for x in (i, j):
        at = np.flatnonzero(keep)
        keep[at] = _once(t.first, x[at], n[at], seen, ranked, group, raw)
    pair, i, j, n, weight = pair[keep], i[keep], j[keep], n[keep], weight[keep]
    if not len(pair):
        return out

    # Gaps between two anchors of a pair.
    two = np.flatnonzero(pair[1:] == pair[:-1])
    columns = [[x] for x in (pair[two], i[two] + n[two], i[two + 1], j[two] + n[two], j[two + 1], np.full(len(two), -1))]
    # And beside the first and the last one.
    edges = []
    heads = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    tails = np.append(heads[1:], len(pair)) - 1
    for anchor, step in ((heads, -1), (tails, 1)):
        line = lines[pair[anchor]]
        lo, hi = (t.first[line], j[anchor]) if step < 0 else (j[anchor] + n[anchor], t.first[line + 1])
        wanted = t.before[hi] - t.before[lo]
        for k in np.flatnonzero((hi > lo) & (wanted <= EDGE_WINDOW)).tolist():
            p, at = int(pair[anchor[k]]), int(anchor[k])
            if beside := t.beside(int(ours[p]), int(i[at] if step < 0 else i[at] + n[at]), int(wanted[k]), step):
                edges.append((p, *beside, int(lo[k]), int(hi[k]), int(weight[at])))
    for x, more in zip(columns, np.array(edges, np.int64).reshape(-1, 6).T, strict=True):
        x.append(more)
    pair, x, y, u, v, support = (np.concatenate(c) for c in columns)
    told, said = t.before[y] - t.before[x], t.before[v] - t.before[u]
    operation = np.where((said > 0) & (told == 0), 1, np.where((told > 0) & (said == 0), 2, 0))
    last = len(t.starts) - 1
    spans = []
    for lo, hi in ((x, y), (u, v)):
        at = t.starts[np.minimum(lo, last)]
        spans.append([at, np.where(hi > lo, t.ends[hi - 1], at)])
    for k in range(len(two), len(pair)):  # an empty range may stand behind all tokens
        p = int(pair[k])
        for (lo, hi), (start, end), text in ((x[k], y[k]), spans[0], ours[p]), ((u[k], v[k]), spans[1], lines[p]):
            start[k], end[k] = t.span(int(text), int(lo), int(hi))
    (start, end), (line_start, line_end) = spans
    long = (np.maximum(y - x, v - u) > MAX_TOKENS) | (np.maximum(end - start, line_end - line_start) > MAX_CHARS)
    surface = told == said
    content = t.numbers[t.content].tobytes()
    at, line_at = 8 * t.before[x], 8 * t.before[u]
    for k in np.flatnonzero(surface & (told > 0)).tolist():
        surface[k] = content[at[k] : at[k] + 8 * told[k]] == content[line_at[k] : line_at[k] + 8 * told[k]]
    reasons = operation * 4 + long * 2 + surface
    for p, s, e, ls, le, op, why, held in zip(*(c.tolist() for c in (pair, start, end, line_start, line_end, operation, reasons, support)), strict=True):
        heard, line = pairs[unlike[p]]
        original, replacement = heard[s:e], line[ls:le]
        if original != replacement:
            out[unlike[p]].append((s, e, original, replacement, _OPERATIONS[op], *(("two_sided", 0) if held < 0 else ("one_sided", held)), _REASONS[why]))
    return out


def _once(texts: np.ndarray, at: np.ndarray, n: np.ndarray, seen: np.ndarray, ranked: np.ndarray, group: np.ndarray, raw: bytes) -> np.ndarray:
    """Whether runs of two tokens or more occur once in their text: by their rarest pair of tokens."""
    if not len(at):
        return np.zeros(0, bool)
    rarest = np.minimum.reduceat(seen, np.stack([at, at + n - 1], 1).ravel())[::2]
    once = rarest == 1
    for k in np.flatnonzero(~once & (n > 2)).tolist():
        i, size = int(at[k]), int(n[k])
        lo, hi = texts[np.searchsorted(texts, i, "right") - 1 :][:2].tolist()
        off = int(seen[i : i + size - 1].argmin())
        run, first = raw[8 * i : 8 * (i + size)], int(group[i + off])
        once[k] = sum(raw[8 * (p - off) : 8 * (p - off + size)] == run for p in ranked[first : first + int(rarest[k])].tolist() if lo <= p - off <= hi - size) == 1
    return once


def stands_elsewhere(text: str, start: int, end: int, replacement: str) -> bool:
    """Whether a text has a replacement outside a span already, case aside; as `marlstone.functions.text.relocates`."""
    low, wanted = text.lower(), replacement.lower()
    return wanted != "" and (low.find(wanted, 0, start) >= 0 or low.find(wanted, end) >= 0)


def enumerate_candidates(heard: str, lines: list[dict]) -> list[dict]:
    """The candidates of one request in order, those that several lines give merged into one."""
    side = _Side(heard)
    return _merged(heard, lines, {line: _gaps(side, _Side(line)) for line in dict.fromkeys(x["text"] or "" for x in lines)})


def _merged(heard: str, lines: list[dict], by_text: dict[str, list[tuple]]) -> list[dict]:
    """The candidates of one request from the gaps of its lines' texts."""
    cited: dict[str, set] = {}
    for x in lines:
        cited.setdefault(x["text"] or "", set()).add(x["line_id"])
    found: dict[tuple, list] = {}
    for text, ids in cited.items():
        own = sorted(ids - {None})
        for gap in by_text[text]:
            if (met := found.setdefault((gap[0], gap[1], gap[3]), [gap, own]))[0] is not gap:
                met += [gap, own]
    out = []
    for (start, end, replacement), met in found.items():
        _, _, original, _, operation, alignment, anchor, reasons = met[0]
        cites = met[1]
        if len(met) > 2:
            same = met[::2]
            how = {g[5] for g in same}
            operation = min(g[4] for g in same)
            reasons = sorted({r for g in same for r in g[7]})
            cites = sorted({x for ids in met[1::2] for x in ids})
            anchor = min((g[6] for g in same if g[5] == "one_sided"), default=0)
            if len(how) > 1:
                alignment, reasons = "ambiguous", sorted([*reasons, "mixed_alignment_provenance"])
        if alignment == "one_sided" and not reasons:
            reasons = ["weak_one_sided_anchor"] * (anchor < LEAST_SUPPORT)
            if stands_elsewhere(heard, start, end, replacement):
                reasons = ["relocated_existing_text", *reasons]
        out.append({"start": start, "end": end, "original": original, "replacement": replacement, "operation": operation, "lines": cites, "reasons": reasons, "alignment": alignment, "support": len(cites)})
    return sorted(out, key=lambda c: (c["start"], c["end"]))


def mark_conflicts(found: list[dict]) -> None:
    """Group and size for candidates in order of their spans, by the rule of `marlstone.operators.intervals.conflict_groups`."""
    group, reach, before, sizes = 0, None, None, Counter()
    for c in found:
        span = c["start"], c["end"]
        if reach is None or (span[0] >= reach and not (span[0] == span[1] and span == before)):
            group += 1
        reach, before = max(span[1], reach or 0), span
        c["conflict_group"] = group
        sizes[group] += 1
    for c in found:
        c["conflict_size"] = sizes[c["conflict_group"]]


def _bytes(**fields: object) -> int:
    """Bytes of the fields as JSON, as Spark writes it: nulls are left out."""
    bare = lambda x: {k: v for k, v in x.items() if v is not None} if isinstance(x, dict) else x
    return len(json.dumps(bare({k: [bare(y) for y in x] if isinstance(x, list) else x for k, x in fields.items()}), ensure_ascii=False, separators=(",", ":")).encode())


def decide_status(ident: str | None, heard: str | None, lines: list[dict], found: list[dict]) -> None:
    """The status of one request's candidates, whose conflicts are marked."""
    for c in found:
        c["status"] = "conflicting" if c["conflict_size"] > 1 else "diagnostic_only" if c["reasons"] else "classifiable"
    left = [c for c in found if c["status"] == "classifiable"]
    if not left:
        return
    over = len(left) > MAX_CANDIDATES
    if not over:
        said = sum(_bytes(candidate_id="", **{k: c[k] for k in ("start", "end", "original", "replacement", "operation", "lines")}) + ID_BYTES for c in left)
        over = _bytes(id=ident, heard=heard, lines=lines) + said > MAX_BYTES
    for c in left:
        c["status"] = "over_capacity" if over else c["status"]


_FOUND = pa.schema(
    [("id", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
    + [(n, pa.string()) for n in ("replacement", "original", "operation")]
    + [("lines", pa.list_(pa.string())), ("reasons", pa.list_(pa.string())), ("alignment", pa.string()), ("support", pa.int64()), ("conflict_group", pa.int64()), ("conflict_size", pa.int64()), ("status", pa.string())]
)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Requests (id, heard, lines) that are aligned at once: about MOST_CHARS code points, or one request."""
    some, size = [], 0
    for batch in batches:
        for ident, heard, lines in zip(*(batch.column(k) for k in range(3)), strict=True):
            ident, heard, lines = ident.as_py(), heard.as_py(), lines.as_py() or []
            more = len(heard or "") + sum(len(x["text"] or "") for x in lines)
            if some and size + more > MOST_CHARS:
                yield some
                some, size = [], 0
            some.append((ident, heard, lines))
            size += more
    if some:
        yield some


def inventory(requests: DataFrame) -> DataFrame:
    """Merged candidates: id, candidate_id, start, end, original, replacement, operation, alignment, lines, support, reasons, conflict_group, status.

    requests: id, heard, lines array<struct<line_id,text>>, one row an id; all that is said of a request follows from its row, so nothing is shuffled.
    Equal candidates of several lines are one (G13). A candidate is diagnostic_only for a reason of its gaps, for
    gaps of both alignments, and at one side for an anchor of fewer than LEAST_SUPPORT content tokens or a
    replacement that the heard text has elsewhere already; conflicting if it overlaps another one (N18);
    over_capacity if its request has more than MAX_CANDIDATES candidates left or, with them, more than
    MAX_BYTES bytes; else classifiable.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {n: [] for n in _FOUND.names}
        for some in _together(batches):
            pairs = dict.fromkeys((heard or "", x["text"] or "") for _, heard, lines in some for x in lines)
            told = dict(zip(pairs, all_gaps(list(pairs)), strict=True))
            for ident, heard, lines in some:
                found = _merged(heard or "", lines, {x["text"] or "": told[heard or "", x["text"] or ""] for x in lines})
                mark_conflicts(found)
                decide_status(ident, heard, lines, found)
                for name, values in columns.items():
                    values += [ident] * len(found) if name == "id" else [c[name] for c in found]
                if len(columns["id"]) >= MOST_ROWS:
                    yield pa.RecordBatch.from_pydict(columns, _FOUND)
                    columns = {n: [] for n in _FOUND.names}
        yield pa.RecordBatch.from_pydict(columns, _FOUND)

    found = requests.select(F.col("id").cast("string").alias("id"), "heard", F.transform("lines", lambda x: F.struct(x["line_id"].alias("line_id"), x["text"].alias("text"))).alias("lines")).mapInArrow(run, from_arrow_schema(_FOUND))
    return found.withColumn("candidate_id", content_id("c", "id", "start", "end", "replacement"))


# --- cited lines, overlaps, local deletions, sanitised lines ---------------------------------------


def cited_lines(edits: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, edit, texts): the lines that each edit cites, in the order cited.

    edits: id, edit, cited array<string>; lines: id, line_id, text. texts is null where a cited line is missing or none is cited.
    """
    each = edits.select("id", "edit", F.posexplode_outer("cited").alias("place", "line_id"))
    found = each.join(lines.select("id", "line_id", "text"), ["id", "line_id"], "left")
    listed = found.groupBy("id", "edit").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("l"), F.count("text").alias("known"), F.count(F.lit(1)).alias("n"))
    return listed.select("id", "edit", F.when(F.col("known") == F.col("n"), F.transform("l", lambda x: x["text"])).alias("texts"))


def overlapping(spans: Column, points: bool = False) -> Column:
    """For each of an array of (start, end) whether another one overlaps it (J14); with `points` equal empty spans do too."""
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    same = lambda a, b: (a["start"] == a["end"]) & (b["start"] == b["end"]) & (a["start"] == b["start"])
    hit = (lambda a, b: meet(a, b) | same(a, b)) if points else meet
    placed = F.transform(spans, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["end"].alias("end")))
    return F.transform(placed, lambda a: F.exists(placed, lambda b: (a["i"] != b["i"]) & hit(a, b)))


def local_deletion(heard: str, original: str, replacement: str, lines: list[str], width: int) -> str:
    """Whether cited lines word a span and `width` letters on both sides as the replacement does, and nowhere as heard.

    Where the heard text ends within the width, the line must end there too.
    """
    if not original or heard.count(original) != 1:
        return "span_not_unique"
    before, after = (_match(x) for x in heard.split(original))
    left, right = before[-width:], after[:width]
    old, new = (left + _match(x) + right for x in (original, replacement))
    if not new or new == old or not left + right:
        return "insufficient_local_anchors"
    if not lines:
        return "missing_own_cited_line"
    known = {_match(x) for x in lines}
    if any(old in x for x in known):
        return "original_window_supported"
    window = re.compile(("\\A" if len(before) <= width else "") + f"(?={re.escape(new)}" + ("\\Z" if len(after) <= width else "") + ")")
    hits = sum(1 for x in known for _ in window.finditer(x))
    return ("local_alignment_not_found", "unique_local_replacement", "ambiguous_local_alignment")[min(hits, 2)]


@F.pandas_udf(T.StringType())
def local_deletions(heard: pd.Series, original: pd.Series, replacement: pd.Series, lines: pd.Series) -> pd.Series:
    """`local_deletion` at widths of 3 to 8: the first that settles it, else the last."""
    final = ("unique_local_replacement", "original_window_supported", "span_not_unique", "missing_own_cited_line")
    out = []
    for h, o, r, cited in zip(heard, original, replacement, lines, strict=True):
        reason = ""
        for width in range(3, 9):
            reason = local_deletion(h or "", o or "", r or "", [x or "" for x in (cited if cited is not None else [])], width)
            if reason in final:
                break
        out.append(reason)
    return pd.Series(out)


def sanitize(lines: DataFrame) -> DataFrame:
    """Regions of recognised lines with a status: what is no content, of the wrong script or seen before goes.

    lines: id, source_language, place, line_id, text. Out: id, line_id (with the region's number), text, bbox, status.
    """
    made = lines.select("id", "source_language", "place", "line_id", F.posexplode(placed_regions(F.col("text"))).alias("k", "r"))
    script = F.when(F.col("source_language") == "en", F.col("r.text").rlike("[A-Za-z]")).when(F.col("source_language") == "zh", F.col("r.text").rlike(r"[㐀-䶿一-鿿]"))
    known = F.when(script.isNull(), F.raise_error(F.concat(F.lit("unsupported source language "), "source_language")).cast("boolean")).otherwise(script)
    bad = F.when(~F.col("r.text").rlike(r"[A-Za-z0-9㐀-䶿一-鿿]"), "dropped_non_content").when(~known, "dropped_wrong_script")
    rows = made.withColumn("bad", bad)
    first = F.row_number().over(Window.partitionBy("id", "r.text", F.col("bad").isNull()).orderBy("place", "k"))
    status = F.coalesce("bad", F.when(first == 1, "kept").otherwise("dropped_exact_duplicate"))
    return rows.withColumn("status", status).select("id", F.format_string("%sS%02d", "line_id", F.col("k") + 1).alias("line_id"), F.col("r.text").alias("text"), F.col("r.bbox").alias("bbox"), "status")


def model_items(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """What a model may see of each request: its text and classifiable candidates, and nothing else."""
    shown = candidates.where("status = 'classifiable'").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "candidate_id", "original", "replacement"))).alias("candidates"))
    return requests.select("id", F.col("heard").alias("text")).join(shown, "id", "left")


def same_items(sent: DataFrame, returned: DataFrame) -> DataFrame:
    """Ids whose returned candidates are not those sent, in order."""
    both = sent.select("id", F.col("candidates").alias("a")).join(returned.select("id", F.col("candidates").alias("b")), "id", "full_outer")
    same = (F.size("a") == F.size("b")) & F.forall(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), lambda ok: ok)
    return both.where(~F.coalesce(same, F.col("a").isNull() & F.col("b").isNull())).select("id")


def decide(requests: DataFrame, candidates: DataFrame, judgments: DataFrame | None = None, least_confidence: float = 0.85) -> DataFrame:
    """id, corrected_text, accepted, edits, reasons of each request.

    judgments: candidate_id, correspondence, confidence; without them every classifiable candidate is
    judged the same with confidence 1. An edit must be grounded in the request's lines and keep Latin
    script. Accepted edits are spliced from the right.
    """
    ok = candidates.where("status = 'classifiable'")
    if judgments is not None:
        ok = ok.join(judgments.select("candidate_id", "correspondence", "confidence"), "candidate_id", "left")
    else:
        ok = ok.withColumn("correspondence", F.lit("same")).withColumn("confidence", F.lit(1.0))
    listed = ok.withColumn("new", match_text(F.col("replacement"))).groupBy("id").agg(F.collect_list(F.struct("start", "end", "original", "replacement", "new", "correspondence", "confidence")).alias("found"))
    # A request's texts meet its candidates once, as an array, and not once a candidate.
    rows = requests.join(listed, "id", "left").withColumn("evidence", match_text(F.when(F.col("found").isNotNull(), F.array_join(F.transform("lines", lambda x: x["text"]), ""))))
    reason = lambda c: (
        F.when(F.coalesce(c["correspondence"], F.lit("")) != "same", "not_same")
        .when(c["confidence"] < least_confidence, "low_confidence")
        .when((c["new"] != "") & ~F.col("evidence").contains(c["new"]), "replacement_not_in_evidence")
        .when(guards.removes_latin(F.array(c["original"]), F.array(c["replacement"])), "latin_script_removed")
        .otherwise("accepted")
    )
    judged = F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["replacement"].alias("replacement"), reason(c).alias("reason")))
    rows = rows.withColumn("judged", F.coalesce(judged, F.array().cast("array<struct<start:int,end:int,replacement:string,reason:string>>")))
    edits = F.transform(F.filter("judged", lambda c: c["reason"] == "accepted"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["replacement"].alias("replacement")))
    rows = rows.withColumn("edits", edits)
    return rows.select("id", splice_all(F.col("heard"), F.col("edits")).alias("corrected_text"), (F.size("edits") > 0).alias("accepted"), F.size("edits").alias("edits"), F.array_sort(F.array_distinct(F.transform("judged", lambda c: c["reason"]))).alias("reasons"))


def strict_judgments(reply: str, expected: list[str]) -> list[dict]:
    """Judgments of a reply that must name every expected candidate once and no other."""
    found = json.loads(reply)["judgments"]
    ids = [j["candidate_id"] for j in found]
    if sorted(ids) != sorted(expected):
        raise ValueError("judgments don't cover the candidates")
    if bad := [j for j in found if not 0 <= float(j["confidence"]) <= 1]:
        raise ValueError(f"confidence out of range: {bad[0]['candidate_id']}")
    return found
