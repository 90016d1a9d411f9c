"""Arrow-batched functions for what Spark has no built-in: normal forms, case folding, difflib, offsets, strict JSON."""

from __future__ import annotations

import difflib
import html
import json
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

CJK = re.compile("[㐀-䶿一-鿿豈-﫿]")
TOKEN = re.compile("[㐀-䶿一-鿿\U00020000-\U0002ebef\U00030000-\U000323af]|[A-Za-z]+(?:['’][A-Za-z]+)*|[0-9]+|[^\\s]")


def _match(text: str | None) -> str:
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    return "".join(c for c in folded if c.isalnum() or CJK.match(c))


def _metric(text: str | None) -> str:
    folded = unicodedata.normalize("NFC", text or "").casefold()
    return " ".join("".join(" " if unicodedata.category(c)[0] == "P" else c for c in folded).split())


def _bare(text: str | None) -> str:
    folded = unicodedata.normalize("NFC", text or "").casefold()
    return "".join(c for c in folded if unicodedata.category(c)[0] != "P" and not c.isspace())


def _words(text: str | None) -> list[str]:
    return re.findall(f"{CJK.pattern}|[^\\s㐀-䶿一-鿿豈-﫿]+", _metric(text))


def _places(a: list | str, before: int) -> dict:
    """For each element the places where it stands in `a`, as bits of bytes, after `before` clear bits."""
    found: dict = {}
    size = (before + len(a) + 7) // 8
    for i, x in enumerate(a, before):
        if x not in found:
            found[x] = bytearray(size)
        found[x][i >> 3] |= 1 << (i & 7)
    return found


def _within(a: list | str, b: list | str, most: int) -> int | None:
    """The edit distance if it is at most `most`, which is at least the difference of the lengths and at most len(a).

    Columns of the table by bits as in `distance`, but only the cells at most `most` off the diagonal.
    """
    width = 2 * most + 1
    every, top, n_bytes = (1 << width) - 1, 1 << (width - 1), (width + 14) // 8
    found, none = _places(a, most), b""
    up, down, score = every >> most << most, 0, most
    turn = len(a) - most  # from here on the last row is followed and not the lowest diagonal
    for j, y in enumerate(b):
        same = int.from_bytes(found.get(y, none)[j >> 3 : (j >> 3) + n_bytes], "little") >> (j & 7) & every
        level = (((same & up) + up) ^ up) | same | down
        more, less = down | (every & ~(level | up)), level & up & every
        if j < turn:
            score += not level & top
        else:
            top >>= 1
            score += bool(more & top) - bool(less & top)
        level = (level & every) >> 1
        up, down = less | (every & ~(level | more)), level & more
    return score if score <= most else None


#: The narrowest band that is tried.
LEAST_BAND = 1_024


def distance(a: list | str, b: list | str) -> int:
    """Edit distance of two sequences: a column of the table at a time, its steps up and down as bits of two numbers (Myers).

    For long sequences narrow bands around the diagonal are tried first, so alike ones take time in proportion to their
    length and distance; short ones gain nothing by it.
    """
    if not a or not b:
        return len(a) + len(b)
    most = max(LEAST_BAND, abs(len(a) - len(b)))
    while most * 4 < len(a):
        if (near := _within(a, b, most)) is not None:
            return near
        most *= 4
    found = {x: int.from_bytes(v, "little") for x, v in _places(a, 0).items()}
    every, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = every, 0
    for y in b:
        same = found.get(y, 0)
        vertical = same | down
        level = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(level | up)), up & level & every
        score += (more >= last) - (less >= last)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(vertical | more)) & every, more & vertical & every
    return score


@pandas_udf(T.IntegerType())
def edits(left: pd.Series, right: pd.Series) -> pd.Series:
    """`distance` of two columns of texts; null with a null."""
    return pd.Series([None if a is None or b is None else distance(a, b) for a, b in zip(left, right, strict=True)], dtype="Int32")


@pandas_udf(T.StringType())
def match_text(text: pd.Series) -> pd.Series:
    """NFKC, case folded, letters, digits and CJK only (X01); null is empty."""
    return text.map(_match, na_action=None)


@pandas_udf(T.StringType())
def bare_text(text: pd.Series) -> pd.Series:
    """NFC, case folded, without punctuation and white space."""
    return text.map(_bare)


@pandas_udf(T.StringType())
def metric_text(text: pd.Series) -> pd.Series:
    """NFC, case folded, punctuation as single spaces."""
    return text.map(_metric)


@pandas_udf(T.StructType([T.StructField("wer", T.DoubleType()), T.StructField("cer", T.DoubleType())]))
def error_rates(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Word and character error rates, over the reference's length or 1."""
    out = []
    for r, h in zip(reference, hypothesis, strict=True):
        rw, hw, rc, hc = _words(r), _words(h), _metric(r).replace(" ", ""), _metric(h).replace(" ", "")
        out.append((distance(rw, hw) / max(1, len(rw)), distance(rc, hc) / max(1, len(rc))))
    return pd.DataFrame(out, columns=["wer", "cer"])


def _similarity(a: str | None, b: str | None) -> float:
    x, y = _match(a), _match(b)
    if not x or not y:
        return 0.0
    grams = lambda t: {t[i : i + 2] for i in range(max(1, len(t) - 1))}
    g, h = grams(x), grams(y)
    shared = len(g & h)
    return 0.5 * difflib.SequenceMatcher(None, x, y).ratio() + 0.35 * shared / len(g | h) + 0.15 * min(shared / len(g), shared / len(h))


@pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Half sequence ratio, .35 bigram Jaccard, .15 bigram containment of match texts."""
    return pd.Series([_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def kind_of(raw: str) -> str:
    """cjk, word, number or punct."""
    return "number" if raw.isascii() and raw.isdigit() else "word" if raw[0].isascii() and raw[0].isalpha() else "punct" if not raw.isalnum() else "cjk"


def tokens_of(text: str | None) -> list[dict]:
    """Tokens with kinds and places: cjk, word, number, punct."""
    out = []
    for m in TOKEN.finditer(text or ""):
        raw = m[0]
        out.append({"raw": raw, "key": raw.casefold(), "kind": kind_of(raw), "start": m.start(), "end": m.end()})
    return out


@pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("raw", "key", "kind")] + [T.StructField(n, T.IntegerType()) for n in ("start", "end")])))
def tokenize(text: pd.Series) -> pd.Series:
    """`tokens_of` a column."""
    return text.map(tokens_of)


KINDS = ("word", "number", "cjk", "punct")


@pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in (*KINDS, "content")]))
def count_tokens(text: pd.Series) -> pd.DataFrame:
    """How many of `tokens_of` a text are of each kind, and how many are content; the tokens themselves are not kept."""
    rows = []
    for t in text:
        n = dict.fromkeys(KINDS, 0)
        for raw, k in Counter(TOKEN.findall(t or "")).items():
            n[kind_of(raw)] += k
        rows.append((*n.values(), sum(n.values()) - n["punct"]))
    return pd.DataFrame(rows, columns=[*KINDS, "content"])


def content_of(text: str | None) -> list[str]:
    """Keys of the tokens that aren't punctuation."""
    return [t["key"] for t in tokens_of(text) if t["kind"] != "punct"]


@pandas_udf(T.ArrayType(T.StringType()))
def content_keys(text: pd.Series) -> pd.Series:
    """`content_of` a column; its size is the content count."""
    return text.map(content_of)


@pandas_udf(T.StringType())
def surface_key(text: pd.Series) -> pd.Series:
    """Letters, digits and CJK in lower case, without normal forms."""
    return text.map(lambda x: "".join(c.lower() for c in x or "" if c.isalnum() or CJK.match(c)))


@pandas_udf(T.ArrayType(T.StringType()))
def deletions(original: pd.Series, replacement: pd.Series) -> pd.Series:
    """Parts of the original that the replacement lacks, by difflib without junk."""
    out = []
    for a, b in zip(original, replacement, strict=True):
        ops = difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).get_opcodes()
        out.append([a[i:j] for tag, i, j, _, _ in ops if tag in ("delete", "replace") and _match(a[i:j])])
    return pd.Series(out)


@pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def unique_window(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    """The smallest token window around a span whose text occurs once: fewest extra tokens, then shortest, then first."""
    rows = []
    for t, s, e in zip(text, start, end, strict=True):
        toks = tokens_of(t)
        inside = [i for i, k in enumerate(toks) if k["end"] > s and k["start"] < e]
        lo, hi = (inside[0], inside[-1]) if inside else (len([k for k in toks if k["end"] <= s]), len([k for k in toks if k["end"] <= s]) - 1)
        found = None
        for extra in range(len(toks) + 1):
            options = []
            for left in range(extra + 1):
                a, b = lo - left, hi + extra - left
                if a < 0 or b >= len(toks) or b < a:
                    continue
                x, y = min(s, toks[a]["start"]), max(e, toks[b]["end"])
                piece = t[x:y]
                if piece and t.find(piece) == t.rfind(piece):
                    options.append((y - x, x, y))
            if options:
                found = min(options)
                break
        rows.append((found[1], found[2]) if found else (None, None))
    return pd.DataFrame(rows, columns=["start", "end"]).astype("Int64")


@pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references decoded."""
    return text.map(lambda x: None if x is None else html.unescape(x))


def _strict(text: str | None) -> str | None:
    def pairs(items: list[tuple]) -> dict:
        if len({k for k, _ in items}) != len(items):
            raise ValueError("duplicate key")
        return dict(items)

    def constant(name: str) -> None:
        raise ValueError(name)

    try:
        return json.dumps(json.loads(text, object_pairs_hook=pairs, parse_constant=constant), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (TypeError, ValueError, RecursionError):
        return None


@pandas_udf(T.StringType())
def strict_json(text: pd.Series) -> pd.Series:
    """Canonical JSON of a text, or null if it is not JSON, repeats a key or has NaN or Infinity."""
    return text.map(_strict)


def lettered(text: str) -> np.ndarray:
    """For each character whether it counts as a letter, digit or apostrophe."""
    return np.fromiter((c == "'" or unicodedata.category(c)[0] in "LN" for c in text), bool, len(text))


def share_out(text: str, weights: list[float]) -> list[str]:
    """The text as one piece a weight: the k-th letter is owned by the weight in whose share of all letters it falls.

    What stands between letters goes with the letter before it; each piece but the first begins with a
    letter, and the first has one at least.
    """
    seen = np.cumsum(lettered(text)) if text else np.zeros(0, int)
    n, total = int(seen[-1]) if len(seen) else 0, sum(weights)
    pieces = [""] * max(1, len(weights))
    if len(pieces) == 1 or not n or total <= 0:
        pieces[0] = text.strip()
        return pieces
    shares = np.cumsum(np.asarray(weights[:-1], float)) / total
    firsts = np.minimum(np.maximum(np.rint(shares * n), 1), n - 1)
    owner = np.searchsorted(firsts, seen, side="left")
    edges = np.searchsorted(owner, np.arange(len(pieces) + 1))
    for k in np.unique(owner).tolist():
        pieces[k] = text[edges[k] : edges[k + 1]].strip()
    return pieces


@pandas_udf(T.ArrayType(T.StringType()))
def split_by_weights(text: pd.Series, weights: pd.Series) -> pd.Series:
    """The text cut in proportion to weights at letters and digits."""
    return pd.Series([share_out(t or "", [float(x) for x in w]) for t, w in zip(text, weights, strict=True)])
