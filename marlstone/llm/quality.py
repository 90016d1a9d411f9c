"""Quality classifier: a byte-level convolutional network in numpy.

Bytes have learned vectors; learned filters over WIDTH bytes slide over the whole text. Filter outputs
are pooled over overlapping chunks (CHUNK bytes, half a chunk apart) by maximum and mean, a hidden
layer looks at each chunk, its outputs are pooled over all chunks by maximum and mean, and a logistic
unit makes one probability. Training and scoring look at all chunks of a text. For scoring, vectors
and filters are compiled to one table per place in the filter, so that a filter output is a sum of
WIDTH rows; half chunks are computed once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.lang_id import held_out
from marlstone.llm.shared import materialise, sample_ids, tidy

#: Labelled rows that the network is fitted on at most (half of each label at most). Their texts are learned from as a whole.
SAMPLE_ROWS = 2_000
HALF = 128
CHUNK = 2 * HALF
WIDTH = 6
VECTOR = 8
FILTERS = 16
HIDDEN = 16
#: Passes over the training texts; of few texts there are more, for so many steps in all.
EPOCHS = 6
LEAST_STEPS = 150
THRESHOLD = 0.7
#: Half chunks that go through the filters at once in training; bounds memory whatever the texts.
BLOCK_HALVES = 512


def padded(text: str | None) -> np.ndarray:
    """UTF-8 bytes (+1, so that 0 is padding) filled up to whole half chunks, two at least, and WIDTH - 1 more."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    halves = max(2, -(-len(data) // HALF))
    out = np.zeros(halves * HALF + WIDTH - 1, np.int16)
    out[: len(data)] = data
    out[: len(data)] += 1
    return out


class Network:
    """Weights, training and scoring."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        f = np.float32
        self.w = {
            "vector": r.normal(0, 0.5, (257, VECTOR)).astype(f),
            "filter": r.normal(0, 1 / np.sqrt(WIDTH * VECTOR), (WIDTH * VECTOR, FILTERS)).astype(f),
            "bias": np.zeros(FILTERS, f),
            "hidden": r.normal(0, 1 / np.sqrt(2 * FILTERS), (2 * FILTERS, HIDDEN)).astype(f),
            "hidden_bias": np.zeros(HIDDEN, f),
            "out": r.normal(0, 1 / np.sqrt(2 * HIDDEN), 2 * HIDDEN).astype(f),
            "out_bias": np.zeros(1, f),
        }
        self.w["vector"][0] = 0

    def _halves(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of (n, HALF + WIDTH - 1) byte codes: what the filters see and say, and per filter where its largest output is, that output and the sum."""
        w = self.w
        v = w["vector"][codes]
        x = np.concatenate([v[:, i : i + HALF] for i in range(WIDTH)], axis=2)
        z = x @ w["filter"] + w["bias"]
        a = np.maximum(z, 0)
        top = a.argmax(axis=1)
        return x, z, top, np.take_along_axis(a, top[:, None, :], 1)[:, 0], a.sum(axis=1)

    def hidden(self, most: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled filter outputs of chunks, of (n, 2, FILTERS) outputs of their halves, and the hidden layer."""
        pooled = np.concatenate([most.max(axis=1), total.sum(axis=1) * (4 / CHUNK)], axis=1)
        return pooled, np.tanh(pooled @ self.w["hidden"] + self.w["hidden_bias"])

    def step(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        """Gradients and loss of a batch of padded texts, over all their chunks; half chunks go through the filters block by block."""
        w = self.w
        sizes = np.array([(len(t) - WIDTH + 1) // HALF for t in texts])
        of = np.repeat(np.arange(len(texts)), sizes)
        at = np.concatenate([np.arange(0, n * HALF, HALF) for n in sizes])
        blocks = [slice(i, i + BLOCK_HALVES) for i in range(0, len(of), BLOCK_HALVES)]
        span = np.arange(HALF + WIDTH - 1)

        def forward(block: slice) -> tuple[np.ndarray, ...]:
            codes = np.stack([texts[k][s + span] for k, s in zip(of[block], at[block], strict=True)])
            return codes, *self._halves(codes)

        # What the filters see is kept for one block only; where there are more, it is computed again.
        kept = forward(blocks[0]) if len(blocks) == 1 else None
        most, total = (np.concatenate(x) for x in zip(*((kept or forward(b))[-2:] for b in blocks), strict=True))
        first = np.flatnonzero(of[:-1] == of[1:])  # a chunk is a half and the next of the same text
        pair = first[:, None] + np.arange(2)
        pooled, h = self.hidden(most[pair], total[pair])
        owner, n = of[first], len(texts)
        count = np.bincount(owner, minlength=n)[:, None].astype(np.float32)
        best = np.full((n, HIDDEN), -2, np.float32)
        np.maximum.at(best, owner, h)
        mean = np.zeros((n, HIDDEN), np.float32)
        np.add.at(mean, owner, h)
        mean /= count
        doc = np.concatenate([best, mean], axis=1)
        p = 1 / (1 + np.exp(-(doc @ w["out"] + w["out_bias"])))
        loss = float(-(weight * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).mean())
        d = (weight * (p - y) / n).astype(np.float32)
        d_doc = d[:, None] * w["out"]
        is_top = h == best[owner]
        ties = np.zeros((n, HIDDEN), np.float32)
        np.add.at(ties, owner, is_top)
        d_h = (d_doc[:, HIDDEN:] / count)[owner] + np.where(is_top, (d_doc[:, :HIDDEN] / ties)[owner], 0)
        d_s = d_h * (1 - h * h)
        g = {k: np.zeros_like(v) for k, v in w.items()} | {"out": doc.T @ d, "out_bias": d.sum(keepdims=True), "hidden": pooled.T @ d_s, "hidden_bias": d_s.sum(axis=0)}
        d_pool = d_s @ w["hidden"].T
        later = most[first + 1] > most[first]  # of equal outputs the earlier half's counts
        d_most, d_total = np.zeros_like(most), np.zeros_like(total)
        for side, own in ((0, ~later), (1, later)):
            d_most[first + side] += np.where(own, d_pool[:, :FILTERS], 0)
            d_total[first + side] += d_pool[:, FILTERS:] * (4 / CHUNK)
        for block in blocks:
            codes, x, z, top, *_ = kept or forward(block)
            self._backward(codes, x, z, top, d_most[block], d_total[block], g)
        g["vector"][0] = 0
        return g, loss

    def _backward(self, codes: np.ndarray, x: np.ndarray, z: np.ndarray, top: np.ndarray, d_most: np.ndarray, d_total: np.ndarray, g: dict) -> None:
        """Add the gradients of vectors and filters of a block of half chunks, given those of their largest and summed outputs."""
        d_a = np.repeat(d_total[:, None, :], HALF, axis=1)
        at = np.arange(len(codes))[:, None], top, np.arange(FILTERS)[None, :]
        d_a[at] += d_most
        d_z = np.where(z > 0, d_a, 0).reshape(-1, FILTERS)
        g["filter"] += x.reshape(-1, WIDTH * VECTOR).T @ d_z
        g["bias"] += d_z.sum(axis=0)
        d_x = (d_z @ self.w["filter"].T).reshape(len(codes), HALF, WIDTH, VECTOR)
        d_v = np.zeros((len(codes), HALF + WIDTH - 1, VECTOR), np.float32)
        for i in range(WIDTH):
            d_v[:, i : i + HALF] += d_x[:, :, i]
        flat_codes, flat = codes.ravel(), d_v.reshape(-1, VECTOR)
        g["vector"] += np.stack([np.bincount(flat_codes, flat[:, j], 257) for j in range(VECTOR)], axis=1).astype(np.float32)

    def train(self, rows: list[tuple[str, int]], epochs: int | None = None, batch: int = 24, rate: float = 0.01, seed: int = 11, good_weight: float = 1.5) -> list[float]:
        """Adam on (text, label) rows; both labels weigh alike but for `good_weight`, which spares clean texts."""
        epochs = epochs or max(EPOCHS, -(-LEAST_STEPS // max(1, -(-len(rows) // batch))))
        rng = np.random.default_rng(seed)
        texts, y = [padded(t) for t, _ in rows], np.array([q for _, q in rows], np.float32)
        share = max(1e-6, min(1 - 1e-6, float(y.mean())) if len(y) else 0.5)
        weight = np.where(y > 0, good_weight * 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses, t = [], 0
        total = epochs * max(1, -(-len(texts) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            seen = []
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                g, loss = self.step([texts[k] for k in part], y[part], weight[part])
                seen.append(loss)
                t += 1
                now = rate * (1 - t / (total + 1))
                for k in self.w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.w[k] = (self.w[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses

    def compiled(self) -> Scorer:
        """The network for scoring."""
        v, f = self.w["vector"], self.w["filter"].reshape(WIDTH, VECTOR, FILTERS)
        return Scorer(np.stack([v @ f[i] for i in range(WIDTH)]).astype(np.float32), self.w)


class Scorer:
    """Scores whole texts; tables[i][code] is what a byte at place i adds to the filters."""

    BLOCK = 64  # half chunks that are worked on at once; bounds memory whatever the text

    def __init__(self, tables: np.ndarray, w: dict[str, np.ndarray]) -> None:
        self.w = w
        # Places go in pairs, so that one row of a larger table serves two bytes.
        self.pairs = [(tables[i][:, None, :] + tables[i + 1][None, :, :]).reshape(257 * 257, -1) for i in range(0, WIDTH, 2)]

    def halves(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest and summed filter outputs of each half chunk of a padded text."""
        n = (len(codes) - WIDTH + 1) // HALF
        two = codes[:-1].astype(np.int32) * 257 + codes[1:]
        most, total = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.float32)
        for i in range(0, n, self.BLOCK):
            k = min(self.BLOCK, n - i)
            at = i * HALF
            z = self.pairs[0].take(two[at : at + k * HALF], axis=0)
            for j in range(1, len(self.pairs)):
                z += self.pairs[j].take(two[at + 2 * j : at + 2 * j + k * HALF], axis=0)
            z += self.w["bias"]
            np.maximum(z, 0, out=z)
            z = z.reshape(k, HALF, FILTERS)
            most[i : i + k] = z.max(axis=1)
            total[i : i + k] = z.sum(axis=1)
        return most, total

    def score(self, text: str | None) -> float:
        """The probability that a text is of good quality; null and empty texts have one too."""
        w = self.w
        most, total = self.halves(padded(text))
        pooled = np.concatenate([np.maximum(most[:-1], most[1:]), (total[:-1] + total[1:]) * (4 / CHUNK)], axis=1)
        h = np.tanh(pooled @ w["hidden"] + w["hidden_bias"])
        z = float(np.concatenate([h.max(axis=0), h.mean(axis=0)]) @ w["out"] + w["out_bias"][0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """A network fitted on labelled documents that are not held out: at most `sample_rows`, half of each
    label at most, taken by a hash of the id, and learned from as a whole. Rows without an id or a label
    of 0 or 1 teach nothing; a document with both labels counts as 0; of rows that share an id the
    smallest text counts. With one label only, or none, the network still scores, without having learned
    a difference.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    # One narrow pass finds the ids and labels; the texts of the chosen rows come last, to one task.
    near = materialise(docs.select("doc_id").join(known, "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality")), "labelled")
    spark = docs.sparkSession
    chosen = {i: q for q in (0, 1) for i in sample_ids(near.where(F.col("quality") == q), sample_rows // 2)}
    listed = spark.createDataFrame(list(chosen.items()), "doc_id long, quality int")
    rows = docs.select("doc_id", "text").join(F.broadcast(listed), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = sorted((i, t or "", q) for batch in batches for i, t, q in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if taken:
            net = Network()
            net.train([(t, q) for _, t, q in taken])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.w)], pa.binary())], names=["weights"])

    # One task learns from the sample, with one thread as Spark sets it there; only the weights come back.
    found = rows.repartition(1).mapInArrow(tidy(run), "weights binary").collect()
    net = Network()
    if found:
        net.w = pickle.loads(found[0]["weights"])
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, score. Null text counts as empty and has a score too; null ids stay
    null, repeated rows each give a row, an empty table gives none. Other columns are ignored."""
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net.w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shipped.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(x.as_py()) for x in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, score double")


def _scorer(packed: bytes) -> Scorer:
    net = Network()
    net.w = pickle.loads(packed)
    return net.compiled()


def keep_good(docs: DataFrame, net: Network, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores `threshold` or more, with all their columns; null text counts as empty."""
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net.w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shipped.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([scorer.score(x.as_py()) >= threshold for x in texts], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def op9_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns over all of `docs`."""
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
