"""Streaming forms (extensions; the surveyed system has no streams): windows and speech islands over events.

Both keep state only as far as the watermark: what is later than that is dropped, which is what a
watermark means.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum of `value` per window and event type; ts is a timestamp."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: bounds and number of events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


_OUT = "media string, start_ms long, end_ms long, parts int"
_STATE = "start_ms long, end_ms long, parts int"


def islands(ranges: DataFrame, gap_ms: int = 350, late: str = "1 minute") -> DataFrame:
    """Merged ranges per media (media string, ts timestamp, start_ms, end_ms), given out when closed.

    An island closes when a range begins more than gap_ms after its end, or when the watermark passes.
    Ranges of a media must arrive in order of start within a batch or be sorted here; one that begins
    before the open island stretches it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = []
        open_one = list(state.get) if state.exists else None
        if state.hasTimedOut:
            closed.append(tuple(open_one))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["start_ms", "end_ms"])
            for r in rows.itertuples(index=False):
                if open_one and r.start_ms - open_one[1] <= gap_ms:
                    open_one = [min(open_one[0], r.start_ms), max(open_one[1], r.end_ms), open_one[2] + 1]
                else:
                    if open_one:
                        closed.append(tuple(open_one))
                    open_one = [r.start_ms, r.end_ms, 1]
            state.update(tuple(int(x) for x in open_one))
            state.setTimeoutTimestamp(max(int(open_one[1]) + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *map(int, c)) for c in closed], columns=["media", "start_ms", "end_ms", "parts"])

    return ranges.withWatermark("ts", late).groupBy("media").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
