"""Seams to external models and services: what they must offer, and how tables reach them.

Nothing here calls a network; a client is passed in. Clients are made once per task by a factory that can
be pickled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.policy import frame_times


class SpeechBackend(Protocol):
    """A speech engine (D01, D04). `signature` goes into fingerprints of its results."""

    name: str
    extension: str
    signature: str

    def synthesize(self, text: str, language: str, path: str) -> float:
        """Write audio and return its seconds."""


class TextReader(Protocol):
    """A frame reader (S19): the text at a time of a segment."""

    def read(self, media: str, seconds: float) -> str: ...


class Classifier(Protocol):
    """A labelling model: (label, score) per input."""

    def classify(self, items: list[dict]) -> list[tuple[str, float]]: ...


_FRAMES = "media string, pos long, at double, text string, error string"


def frames(segments: DataFrame) -> DataFrame:
    """(media, pos, at): the times at which a segment's frames are read. segments: media, pos, start, end (seconds)."""
    return segments.select(F.col("media").cast("string").alias("media"), "pos", F.explode(frame_times(F.col("start"), F.col("end"))).alias("at"))


def read_frames(wanted: DataFrame, cache: DataFrame, factory: Callable[[], TextReader], failures: int = 3) -> DataFrame:
    """(media, pos, at, text, error): cached frames, and others read by a client.

    After so many failures in a row a task stops asking; its further frames have the error "skipped".
    Write the result as the next cache: rows with an error are asked for again.
    """
    known = cache.where("error IS NULL OR error = ''").select("media", "pos", "at", "text", "error")
    open_rows = wanted.join(known, ["media", "pos", "at"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, row = factory(), 0
        for batch in batches:
            texts, errors = [], []
            for r in batch.itertuples(index=False):
                text, error = None, "skipped"
                if row < failures:
                    try:
                        text, error, row = client.read(r.media, r.at), None, 0
                    except Exception as e:  # the error is a value of the result
                        error, row = str(e), row + 1
                texts.append(text)
                errors.append(error)
            yield batch.assign(text=texts, error=errors)

    return known.join(wanted, ["media", "pos", "at"], "left_semi").unionByName(open_rows.mapInPandas(run, _FRAMES))


def measure(candidates: DataFrame, cache: DataFrame, factory: Callable[[], SpeechBackend], signature: str) -> DataFrame:
    """Candidates with measured seconds (null if the engine failed), asking only for what the cache lacks.

    candidates: media, pos, idx, text, language, target. cache: fingerprint, measured. One engine per task.
    """
    from marlstone.operators.incremental import fingerprint

    rows = candidates.withColumn("fingerprint", fingerprint(F.lit(signature).alias("engine"), "text", "language", F.round("target", 6).alias("target")))
    open_rows = rows.select("fingerprint", "text", "language").dropDuplicates(["fingerprint"]).join(cache, "fingerprint", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = factory()
        for batch in batches:
            seconds = []
            for r in batch.itertuples(index=False):
                try:
                    seconds.append(float(engine.synthesize(r.text, r.language, r.fingerprint + engine.extension)))
                except Exception:  # a failed candidate is left to the choice among the others
                    seconds.append(None)
            yield pd.DataFrame({"fingerprint": batch["fingerprint"], "measured": pd.array(seconds, dtype="Float64")})

    fresh = open_rows.mapInPandas(run, "fingerprint string, measured double")
    return rows.join(cache.select("fingerprint", "measured").unionByName(fresh), "fingerprint", "left")
