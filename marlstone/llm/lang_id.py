"""Language identification of mixed-language text: script ranges, word scores, Viterbi spans.

A word's script narrows the languages it can belong to. Each of those gets a log posterior from a
character n-gram model of the word with its ends marked. A Viterbi pass over the words of a text, with
a penalty for each change of language, labels spans; the text's language is the one with most letters.

A run of letters is cut where its script changes, and after every PIECE letters, so that text without
spaces is many words to the Viterbi pass. A later piece of a run knows the letters before it, so every
n-gram of the run is scored once.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import gathered, rows_of, sample_ids, tidy

#: Labelled rows that a model is fitted on; their texts are learned from as a whole.
SAMPLE_ROWS = 3_000
ORDERS = (2, 3, 4)
#: Letters of a run that are one word at most.
PIECE = 24
SWITCH_PENALTY = 9.0
#: A script belongs to a language if at least so much of its training letters are of that script.
SCRIPT_SHARE = 0.01
#: A model's size at most, as it goes to every executor.
MODEL_BYTES = 200_000_000
#: Text that is labelled together, in bytes.
BATCH_BYTES = 16_000_000
#: Words whose scores a Python worker remembers.
MAX_WORDS = 400_000

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")

# First code points of ranges and their scripts; letters between ranges are of script "".
_RANGES = [
    (0x0041, "Latin"), (0x0250, "Latin"), (0x0300, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, ""), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, ""),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, ""), (0x1780, "Khmer"), (0x1800, ""), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, ""),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x2C60, "Latin"), (0x2C80, ""), (0x2DE0, "Cyrillic"), (0x2E00, ""), (0x3040, "Kana"), (0x3100, ""), (0x3130, "Hangul"), (0x3190, ""), (0x31F0, "Kana"), (0x3200, ""),
    (0x3400, "Han"), (0x4DC0, ""), (0x4E00, "Han"), (0xA000, ""), (0xA640, "Cyrillic"), (0xA6A0, ""), (0xA720, "Latin"), (0xA800, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, ""),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFF00, ""), (0xFF21, "Latin"), (0xFF5B, ""), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"), (0x323B0, ""),
]
_STARTS = [a for a, _ in _RANGES]


def script_of(letter: str) -> str:
    """The script of a letter, "" if it is in none of the ranges."""
    at = bisect_right(_STARTS, ord(letter)) - 1
    return _RANGES[at][1] if at >= 0 else ""


def held_out(doc_id: Column) -> Column:
    """Whether a document is left out of learning: CRC-32 of its id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


@dataclass
class Model:
    """Languages, the scripts of each, and for each n-gram its row of log probabilities by language (row 0: unseen)."""

    langs: list[str]
    scripts: dict[str, np.ndarray] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    logs: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))

    def scores(self, words: list[str]) -> np.ndarray:
        """Log posteriors of lower-case words, uniform prior. Languages that don't use a word's script get none
        of the mass; if no language does, all are alike."""
        n, row = len(self.langs), self.rows.get
        found = [[row(g, 0) for g in grams_of(w)] for w in words]
        sizes = np.array([len(f) for f in found])
        flat = np.fromiter((k for f in found for k in f), np.int64, int(sizes.sum()))
        total = np.add.reduceat(self.logs[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        none = np.zeros(n, bool)
        allowed = np.stack([self.scripts.get(script_of(body_of(w)[0]), none) for w in words])
        strange = ~allowed.any(axis=1)
        total[~allowed] = -np.inf
        total[strange] = 0
        total -= total.max(axis=1, keepdims=True)
        return np.maximum(total - np.log(np.exp(total).sum(axis=1, keepdims=True)), -20.0)


#: Between the letters before a piece and the piece. Runs hold letters and marks only.
_CUT = "\0"
#: Texts in which a run may have to be cut: letters outside the Latin ranges, or more than PIECE letters in a row.
_ODD = regex.compile(rf"[^\x00-\u024f\u1e00-\u1eff\u2000-\u206f]|\p{{L}}[\p{{L}}\p{{M}}]{{{PIECE}}}")


@lru_cache(100_000)
def pieces_of(word: str) -> tuple[str, ...]:
    """A run of letters as words: itself, or pieces with the letters before them. Marks keep the script of their letter."""
    if word.isascii() and len(word) <= PIECE:
        return (word,)
    parts: list[tuple[bool, str]] = []  # whether a run of one script begins, and letters
    before = None
    for c in word:
        script = before if parts and regex.match(r"\p{M}", c) else script_of(c)
        if script != before or len(parts[-1][1]) == PIECE:
            parts.append((script != before, c))
        else:
            parts[-1] = (parts[-1][0], parts[-1][1] + c)
        before = script
    out, context = [], ""
    for k, (first, body) in enumerate(parts):
        last = k + 1 == len(parts) or parts[k + 1][0]
        out.append(body if first and last else f"{'' if first else context}{_CUT}{body}{_CUT if last else ''}")
        context = body[-max(ORDERS) + 1 :]
    return tuple(out)


def body_of(piece: str) -> str:
    """The letters of a piece without those before it."""
    return piece.split(_CUT)[1] if _CUT in piece else piece


def words_of(text: str | None) -> list[str]:
    """The words and pieces of a text in order, in lower case."""
    if not text:
        return []
    found = WORD.findall(text.lower())
    return [p for w in found for p in pieces_of(w)] if _ODD.search(text) else found


def grams_of(piece: str) -> list[str]:
    """The n-grams of a word between its end marks; of a piece of a longer run those that end in it."""
    if _CUT not in piece:
        marked, skip = f"<{piece}>", 0
    else:
        context, body, *last = piece.split(_CUT)
        marked = f"{context or '<'}{body}{'>' if last else ''}"
        skip = len(context)
    return [marked[i : i + k] for k in ORDERS for i in range(max(0, skip + 1 - k), len(marked) - k + 1)]


def count_grams(rows: Iterable[tuple[str | None, str]]) -> Counter:
    """Of (text, lang) rows the number of (lang, n-gram), and of letters by script as (lang, "\\0" and script)."""
    words: dict[str, Counter] = {}
    for text, lang in rows:
        words.setdefault(lang, Counter()).update(words_of(text))
    out: Counter = Counter()
    for lang, seen in words.items():
        for word, k in seen.items():
            body = body_of(word)
            out[lang, _CUT + script_of(body[0])] += k * len(body)
            for g in grams_of(word):
                out[lang, g] += k
    return out


def learn(rows: list[tuple[str, str]]) -> Model:
    """A model of (text, lang) rows; languages are sorted."""
    return learn_counts(sorted({lang for _, lang in rows}), count_grams(rows))


def learn_counts(langs: list[str], found: dict[tuple[str, str], int]) -> Model:
    """A model from the numbers that `count_grams` gives."""
    model = Model(langs)
    place, n = {lang: i for i, lang in enumerate(langs)}, len(langs)
    counts: dict[str, np.ndarray] = {}
    letters: dict[str, np.ndarray] = {}
    for (lang, g), k in sorted(found.items()):
        own = letters if g.startswith(_CUT) else counts
        own.setdefault(g.removeprefix(_CUT), np.zeros(n))[place[lang]] += k
    total = sum(letters.values(), np.zeros(n))
    model.scripts = {s: v >= SCRIPT_SHARE * np.maximum(total, 1) for s, v in letters.items() if s}
    # N-grams of one order share a distribution; a longer one refines what the shorter ones say.
    size = np.array([sum(v for g, v in counts.items() if len(g) == k) + 0.5 * sum(len(g) == k for g in counts) for k in ORDERS]) if counts else np.ones((len(ORDERS), n))
    order = {k: j for j, k in enumerate(ORDERS)}
    model.rows = {g: i for i, g in enumerate(counts, 1)}
    model.logs = np.stack([np.zeros(n), *(np.log((v + 0.5) / size[order[len(g)]]) / len(ORDERS) for g, v in counts.items())])
    return model


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of at most `sample_rows` labelled documents that are not held out, taken by a hash of the id.

    Their whole texts are counted by the tasks; the driver gets the numbers of n-grams. Rows without id,
    text or language are not learned from; of rows that share an id the one with the smallest text is.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = rows_of(rows.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), sample_ids(rows, sample_rows))
    once = found.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("r.text", "r.lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for batch in batches:
            out.update(count_grams(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
        cols = [pa.array(c, pa.string()) for c in ([x for x, _ in out], [g for _, g in out])]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(list(out.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = once.mapInArrow(tidy(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, grams, n = (c.to_pylist() for c in counts.columns)
    return learn_counts(sorted(set(langs)), dict(zip(zip(langs, grams, strict=True), n, strict=True)))


class _Numbers(dict):
    """Words to numbers in order of first sight; `new` are those not scored yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


class Labeller:
    """Applies a model to batches of texts; remembers the scores of words."""

    def __init__(self, model: Model, penalty: float = SWITCH_PENALTY) -> None:
        self.model, self.penalty = model, penalty
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.table = np.zeros((1024, len(self.model.langs)), np.float32)
        self.letters = np.zeros(1024, np.int32)

    def _numbers(self, text: str | None) -> np.ndarray:
        """The words of a text as rows of the table; new words get rows that `_score_new` fills."""
        words = words_of(text)
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def _score_new(self) -> None:
        """Fill the rows of new words, some thousand at a time."""
        new = self.number.new
        first = len(self.number) - len(new)
        while len(self.number) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        for i in range(0, len(new), 8_192):
            part = new[i : i + 8_192]
            self.table[first + i : first + i + len(part)] = self.model.scores(part)
            self.letters[first + i : first + i + len(part)] = [len(body_of(w)) for w in part]
        new.clear()

    def viterbi(self, numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The language of each word. Texts are runs of `numbers`; all texts step together, longest first."""
        order = np.argsort(-sizes, kind="stable")
        begin, size = starts[order], sizes[order]
        n_langs = len(self.model.langs)
        came = np.zeros((len(numbers), n_langs), np.min_scalar_type(n_langs))
        label = np.zeros(len(numbers), np.int64)
        value = np.zeros((len(order), n_langs), np.float32)
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # texts with more than t words
        own = np.arange(n_langs, dtype=came.dtype)
        for t in range(longest):
            m = active[t]
            at = begin[:m] + t
            before = value[:m]
            top = before.argmax(axis=1)
            other = before[np.arange(m), top] - self.penalty
            stay = before >= other[:, None]
            came[at] = np.where(stay, own, top[:, None])
            value[:m] = self.table[numbers[at]] + np.where(stay, before, other[:, None])
        now = value.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            m = active[t]
            at = begin[:m] + t
            label[at] = now[:m]
            now[:m] = came[at, now[:m]]
        return label

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """For each text its language, a score (mean posterior of that language over the letters of its own
        spans, times their share of all letters) and the words' labels as runs of (first word, end, language)."""
        model = self.model
        own = [self._numbers(t) for t in texts] if model.langs else []
        sizes = np.array([len(x) for x in own])
        if not sizes.sum():
            return [("und", 0.0, [])] * len(texts)
        self._score_new()
        numbers = np.concatenate(own)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        label = self.viterbi(numbers, starts, sizes)
        letters = self.letters[numbers].astype(np.float64)
        n, owner = len(model.langs), np.repeat(np.arange(len(texts)), sizes)
        share = np.bincount(owner * n + label, letters, len(texts) * n).reshape(-1, n)
        sure = np.bincount(owner * n + label, letters * np.exp(self.table[numbers, label]), len(texts) * n).reshape(-1, n)
        best = share.argmax(axis=1)
        edge = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])]))
        runs: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(numbers)], strict=True):
            k = int(owner[a])
            runs[k].append((int(a - starts[k]), int(b - starts[k]), model.langs[label[a]]))
        if len(self.number) > MAX_WORDS:
            self._forget()
        return [(model.langs[best[i]], float(sure[i, best[i]] / share[i].sum()), runs[i]) if sizes[i] else ("und", 0.0, []) for i in range(len(texts))]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY, with_spans: bool = True) -> DataFrame:
    """One row per document row: doc_id, lang_pred, score and (with_spans) spans of code points with their language.

    Null texts and texts without letters are `und` with score 0, as is everything if no language was
    learned. A tie goes to the language that sorts first. Repeated rows each give a row, null ids stay
    null, an empty table gives no rows. Texts are read whole, in batches bounded by bytes. Other columns
    are ignored.
    """
    packed = pickle.dumps(model)
    if len(packed) > MODEL_BYTES:
        raise ValueError(f"the model has {len(packed)} bytes, more than {MODEL_BYTES}: fit it on fewer rows")
    shipped = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(pickle.loads(shipped.value), penalty)
        for batch in gathered(batches, BATCH_BYTES):  # Viterbi steps through all texts of a batch together
            texts = batch.column(1).to_pylist()
            found = labeller.label(texts)
            cols = [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if with_spans:
                spans = []
                for text, (_, _, runs) in zip(texts, found, strict=True):
                    at = _places(text) if runs else []
                    spans.append([{"start": at[a][0], "end": at[b - 1][1], "lang": lang} for a, b, lang in runs])
                cols.append(pa.array(spans, _SPANS))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans)


def _places(text: str) -> list[tuple[int, int]]:
    """Spans of the words in the text as it is; lower-casing may change lengths, so characters are lowered one by one."""
    lowered = text.lower()
    origin = None
    if len(lowered) != len(text):
        origin = [i for i, c in enumerate(text) for _ in c.lower()]
        lowered = "".join(c.lower() for c in text)
    odd = _ODD.search(text)
    out = []
    for m in WORD.finditer(lowered):
        at = m.start()
        for size in [len(body_of(p)) for p in pieces_of(m[0])] if odd else [len(m[0])]:
            out.append((origin[at], origin[at + size - 1] + 1) if origin else (at, at + size))
            at += size
    return out


def op5_language_id(docs: DataFrame) -> DataFrame:
    """The contract's columns over all of `docs`."""
    found = predict(docs, fit(docs), with_spans=False)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
