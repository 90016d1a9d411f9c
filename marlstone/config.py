"""Parameters of the operators as frozen dataclasses; `from_env` reads overrides from the environment on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


class FromEnv:
    """Adds `from_env`: a field of the prefix and the upper-case field name overrides the default."""

    @classmethod
    def from_env(cls, prefix: str = "MARLSTONE_", env: dict[str, str] | None = None):
        env = dict(os.environ) if env is None else env
        base = cls()
        found = {}
        for f in fields(base):
            raw = env.get(prefix + f.name.upper(), "").strip()
            if raw:
                kind = type(getattr(base, f.name))
                found[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return replace(base, **found)


@dataclass(frozen=True)
class Complexity(FromEnv):
    """When a text counts as long or complex."""

    zh_long_chars: int = 28
    en_long_words: int = 20
    complex_clauses: int = 3


@dataclass(frozen=True)
class Emotion(FromEnv):
    """Reliability of emotion labels and smoothing over neighbours."""

    min_score: float = 0.5
    min_duration: float = 0.8
    context_gap: float = 1.5


@dataclass(frozen=True)
class Speech(FromEnv):
    """Speech ranges, in milliseconds."""

    keep_silence_ms: int = 180
    min_chunk_ms: int = 350
    merge_gap_ms: int = 350
    max_chunk_ms: int = 25_000
    search_ms: int = 5_000
    hard_limit_ms: int = 45_000


@dataclass(frozen=True)
class Turns(FromEnv):
    """Speaker turns, in milliseconds and shares."""

    island_ms: int = 500
    island_gap_ms: int = 150
    merge_gap_ms: int = 500
    short_ms: int = 1_500
    fragment_ms: int = 1_500
    fragment_share: float = 0.03
    fragment_count: int = 2
    snap_ms: int = 1_200
    snap_tokens: int = 3
    snap_following: int = 2
    interjection_ms: int = 1_200
    sentence_share: float = 0.60
    sentence_ms: int = 8_000


@dataclass(frozen=True)
class Guard(FromEnv):
    """Acceptance of a proposed correction."""

    min_confidence: float = 0.85
    max_edit_ratio: float = 0.45
    translated_ratio: float = 0.25
    proper_noun_ratio: float = 0.60
    proper_noun_confidence: float = 0.95
    expansion: float = 1.45
    expansion_from: int = 20


@dataclass(frozen=True)
class Quality(FromEnv):
    """Durations of generated speech, in seconds."""

    max_error: float = 0.6
    max_ratio_error: float = 0.25
    tempo_low: float = 0.6
    tempo_high: float = 2.0
    tempo_ignore: float = 0.2
    tempo_target: float = 0.1


@dataclass(frozen=True)
class Evidence(FromEnv):
    """Selection of evidence lines."""

    max_lines: int = 8
    lexical_quota: int = 4
    max_chars: int = 600
    least_lexical: float = 0.05
