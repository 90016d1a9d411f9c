"""Speaker turns inside segments: assignment, snapping to sentence ends, splitting."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.config import Turns
from marlstone.functions.policy import normalize_speaker
from marlstone.functions.unicode import lettered, share_out
from marlstone.operators.durable import durable
from marlstone.operators.intervals import dominant_speaker, merge_fragments, nearest_span, priority_speaker
from marlstone.operators.sequence import merge_adjacent, renumber

SENTENCE_END = re.compile("[.!?。！？][\"'’”)\\]]*$")
# Short answers and fillers that may belong to another speaker.
INTERJECTIONS = r"(?i)^(?:uh+h*|huh+|yeah+|yes+|ok+a*y*|what\?*|oh+|ah+|um+m*|hmm+|wow+|hey+|no+|right[.,]?|嗯|啊|哦|哎|呀|呢|吧|吗|哼|哈|呃|欸|啥|咋|喔|喏|呗|嘛)$"


#: A sentence of a text: up to its marks and what closes after them.
SENTENCE = re.compile("[^.!?。！？]+(?:[.!?。！？]+[\"'’”)\\]]*|$)")


def snap(texts: list[str], starts: list[int], ends: list[int], speakers: list[str], cfg: Turns = Turns()) -> list[str]:
    """Move changes of speaker in mid-sentence to the sentence's end, if that is near and words follow.

    Runs of one speaker are taken in order; a run that begins in mid-sentence hands its first tokens, up to
    the end of that sentence, to the run before.
    """
    runs = [[who, sum(1 for _ in group)] for who, group in groupby(speakers)]
    if len(texts) < 3 or len(runs) < 2:
        return list(speakers)
    closed = [SENTENCE_END.search(t.strip()) is not None for t in texts]
    at = 0
    for before, run in pairwise([["", 0], *runs]):
        size = run[1]
        if at and not closed[at - 1]:
            given = next((k + 1 for k in range(min(size, cfg.snap_tokens)) if closed[at + k]), 0)
            if given and size - given >= cfg.snap_following and ends[at + given - 1] - starts[at] <= cfg.snap_ms:
                before[1] += given
                run[1] -= given
        at += size
    return [who for who, size in runs for _ in range(size)]


def coherent(texts: list[str], starts: list[int], ends: list[int], speakers: list[str], text: str, cfg: Turns = Turns()) -> list[str]:
    """Give a sentence's tokens to the speaker with most of its letters, if it is short and the share is clear.

    Sentences are those of the segment's text. Each ends after the token whose letters so far come nearest
    to the sentences' letters so far, with a token at least for each sentence.
    """
    if not texts:
        return []
    weigh = lambda t: max(1, int(lettered(t).sum()))
    own = np.array([weigh(t) for t in texts])
    said = [m.strip() for m in SENTENCE.findall(text) if m.strip()] or [text]
    reached, wanted = np.cumsum(own), np.cumsum([weigh(t) for t in said])
    edges, n = [0], len(texts)
    for k, goal in enumerate(wanted[:-1].tolist()):
        room = reached[edges[-1] : n - (len(said) - k - 1)]  # the tokens that may close this sentence
        if not len(room):
            break
        edges.append(edges[-1] + 1 + int(np.argmin(np.abs(room - goal))))
    names = list(dict.fromkeys(speakers))
    codes = np.array([names.index(s) for s in speakers])
    for a, b in pairwise([*edges, n]):
        votes = np.bincount(codes[a:b], own[a:b], len(names)) if b > a else np.zeros(len(names))
        # Of equal votes the speaker heard first in the sentence wins.
        best = max(dict.fromkeys(codes[a:b].tolist()), key=votes.__getitem__, default=0)
        total = votes.sum()
        if votes[best] < total and votes[best] >= cfg.sentence_share * total and max(ends[a:b]) - min(starts[a:b]) <= cfg.sentence_ms:
            codes[a:b] = best
    return [names[k] for k in codes]


_PART = "media long, pos long, part int, speaker string, text string, start_ms long, end_ms long, tokens int"


def split_segments(segments: DataFrame, words: DataFrame, cfg: Turns = Turns(), sentences: bool = False) -> DataFrame:
    """Split segments where their words change speaker.

    segments: media, pos, text, start_ms, end_ms. words: media, pos, word (place), said, start_ms, end_ms,
    speaker. Speakers are snapped to sentence ends; boundaries lie midway between groups; the text is cut in
    proportion to letters; empty parts go. Segments without words or changes are one part.
    """
    w = words.groupBy("media", "pos").agg(F.array_sort(F.collect_list(F.struct("word", "said", "start_ms", "end_ms", "speaker"))).alias("words"))
    rows = segments.select("media", "pos", "text", "start_ms", "end_ms").join(w, ["media", "pos"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                items = [] if r.words is None else list(r.words)
                texts, starts, ends = [x["said"] or "" for x in items], [int(x["start_ms"]) for x in items], [int(x["end_ms"]) for x in items]
                who = snap(texts, starts, ends, [x["speaker"] for x in items], cfg)
                if sentences:
                    who = coherent(texts, starts, ends, who, r.text or "", cfg)
                edges = [0, *(i for i in range(1, len(who)) if who[i] != who[i - 1]), len(who)] if who else []
                groups = list(pairwise(edges))
                if len(groups) <= 1:
                    out.append((r.media, r.pos, 0, who[0] if who else None, r.text, r.start_ms, r.end_ms, len(items)))
                    continue
                letters = [sum(max(1, int(lettered(texts[i]).sum())) for i in range(a, b)) for a, b in groups]
                cuts = [r.start_ms, *((max(ends[a:b]) + min(starts[c:d])) // 2 for (a, b), (c, d) in pairwise(groups)), r.end_ms]
                parts = [(who[a], t, cuts[k], cuts[k + 1], b - a) for k, ((a, b), t) in enumerate(zip(groups, share_out(r.text or "", letters), strict=True)) if t]
                out += [(r.media, r.pos, k, *p) for k, p in enumerate(parts)] or [(r.media, r.pos, 0, None, r.text, r.start_ms, r.end_ms, len(items))]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _PART.split(", ")])

    return rows.mapInPandas(run, _PART)


def fix_interjections(segments: DataFrame, spans: DataFrame, cfg: Turns = Turns()) -> DataFrame:
    """Short interjections go to the speaker of the span around or nearest to their middle."""
    near = nearest_span(segments, spans)
    short = (F.col("end_ms") - F.col("start_ms") < cfg.interjection_ms) & F.trim("text").rlike(INTERJECTIONS) & F.col("nearest").isNotNull()
    return near.withColumn("speaker", F.when(short, normalize_speaker(F.col("nearest"))).otherwise(F.col("speaker"))).drop("nearest", "half_ms")


def assign_speakers(segments: DataFrame, words: DataFrame, spans: DataFrame, cfg: Turns = Turns()) -> DataFrame:
    """The whole assignment: words by priority, split, dominant speakers, interjections, fragments, merging."""
    keyed = words.withColumnsRenamed({"pos": "segment", "word": "place"}).withColumn("pos", F.struct("segment", "place"))
    spoken = priority_speaker(keyed, spans).select("media", F.col("segment").alias("pos"), F.col("place").alias("word"), "said", "start_ms", "end_ms", F.col("chosen").alias("speaker"))
    parts = durable(split_segments(segments, spoken, cfg), "turns")  # what follows reads it several times
    placed = renumber(parts.withColumn("pos", F.col("pos") * 1000 + F.col("part")), "at").withColumn("pos", F.col("at").cast("long")).drop("at")
    main = dominant_speaker(placed, spans)
    main = main.withColumn("speaker", normalize_speaker(F.coalesce("speaker", "dominant"))).drop("dominant", "part", "tokens")
    fixed = durable(fix_interjections(main, spans, cfg), "turns")
    return merge_adjacent(merge_fragments(fixed, cfg).select("media", "pos", "text", "speaker", "start_ms", "end_ms"), cfg)
