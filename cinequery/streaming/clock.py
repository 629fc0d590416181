"""The playback clock over a stream of events: one small state for each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "running boolean, media double, anchor double, last long"
OUTPUT = "session long, ord long, media_time double"


def clock(events: DataFrame, duration: float, late: str = "10 minutes") -> DataFrame:
    """Media time before each event of a streaming frame (session, ord, at, kind, value, ts); a session without events for ``late`` of event time is forgotten. An event whose ord isn't past the last one seen moves nothing; its row has no media time."""
    patience = events.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL '{late}')").first()[0]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        running, media, anchor, last = state.get if state.exists else (False, 0.0, 0.0, -1)
        rows = pd.concat(list(frames)).sort_values("ord")
        out = []
        for ordinal, at, kind, value in zip(rows["ord"], rows["at"], rows["kind"], rows["value"], strict=True):
            if ordinal <= last:
                out.append((int(key[0]), int(ordinal), None))
                continue
            now = min(duration, media + max(0.0, at - anchor)) if running else media
            if running and now >= duration:
                running = False
            media, anchor, last = float(now), float(at), int(ordinal)
            out.append((int(key[0]), int(ordinal), float(now)))
            if kind in ("start", "seek"):
                media = min(max(float(value), 0.0), duration)
                running = running or kind == "start"
            elif kind == "pause":
                running = False
        state.update((bool(running), float(media), float(anchor), last))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + patience)
        yield pd.DataFrame(out, columns=["session", "ord", "media_time"])

    timed = events.withWatermark("ts", late)
    return timed.groupBy("session").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
