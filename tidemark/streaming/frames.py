"""Streams of frame scores (ts, clip_id, label, p): sliding means, gap joins and hysteresis as frames arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.frames import FRAME


def sliding_mean(stream: DataFrame, window: str = "8 seconds", hop: str = "2 seconds", late: str = "30 seconds") -> DataFrame:
    """clip_id, label, start_ts, p: means over sliding windows of event time."""
    out = stream.withWatermark("ts", late).groupBy("clip_id", "label", F.window("ts", window, hop).alias("w")).agg(F.avg("p").alias("p"))
    return out.select("clip_id", "label", F.col("w.start").alias("start_ts"), "p")


def chunk_counts(stream: DataFrame, width: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """clip_id, start_ts, n in tumbling windows."""
    out = stream.withWatermark("ts", late).groupBy("clip_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("clip_id", F.col("w.start").alias("start_ts"), "n")


def gap_sessions(stream: DataFrame, inline: list[str], gap_inline: str = "300 milliseconds", gap_background: str = "1 seconds", late: str = "30 seconds") -> DataFrame:
    """clip_id, label, start_ts, end_ts, n: frames of one label joined while the next comes within the label's gap."""
    gap = F.when(F.col("label").isin(inline), gap_inline).otherwise(gap_background)
    out = stream.withWatermark("ts", late).groupBy("clip_id", "label", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("clip_id", "label", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


#: What a series keeps between batches: its joined event so far and the run that is open.
STATE = "ev_start long, ev_stop long, run_start long, run_stop long, rises boolean, done long"


class Hysteresis:
    """Joined runs of one series, frame by frame in order; a finished event comes out once no later run can join it."""

    def __init__(self, high: float, low: float, gap: float, least: float, state: tuple | None = None):
        self.high, self.low, self.gap, self.least = high, low, gap, least
        self.ev_start, self.ev_stop, self.run_start, self.run_stop, self.rises, self.done = state or (-1, -1, -1, -1, False, -1)

    def state(self) -> tuple:
        return self.ev_start, self.ev_stop, self.run_start, self.run_stop, self.rises, self.done

    def add(self, frame: int, p: float) -> list[tuple[int, int]]:
        out = []
        if frame <= self.done:
            return out  # too late
        self.done = frame
        if self.run_start >= 0 and (frame != self.run_stop or p <= self.low):
            out += self._close()
        if p > self.low:
            if self.run_start < 0:
                self.run_start, self.rises = frame, False
            self.run_stop, self.rises = frame + 1, self.rises or p > self.high
        elif self.ev_start >= 0 and (frame + 1 - self.ev_stop) * FRAME > self.gap:
            out += self._emit()
        return out

    def _close(self) -> list[tuple[int, int]]:
        start, stop, rises = self.run_start, self.run_stop, self.rises
        self.run_start = self.run_stop = -1
        if not rises:
            return []
        out = []
        if self.ev_start >= 0 and (start - self.ev_stop) * FRAME > self.gap:
            out = self._emit()
        if self.ev_start < 0:
            self.ev_start = start
        self.ev_stop = stop
        return out

    def _emit(self) -> list[tuple[int, int]]:
        event = (self.ev_start, self.ev_stop)
        self.ev_start = self.ev_stop = -1
        return [event] if (event[1] - event[0]) * FRAME >= self.least else []

    def finish(self) -> list[tuple[int, int]]:
        out = self._close() if self.run_start >= 0 else []
        return out + (self._emit() if self.ev_start >= 0 else [])


def hysteresis_stream(stream: DataFrame, high: float, low_ratio: float = 0.6, gap: float = 1.0, least: float = 0.15, late: str = "30 seconds") -> DataFrame:
    """clip_id, label, start, stop (frames) of events from a stream with ts, clip_id, label, frame, p.

    A series' open run and joined event are its state.  The last event comes out
    when the watermark has passed the series by the gap.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        h = Hysteresis(high, low_ratio * high, gap, least, state.getOption)
        found = []
        if state.hasTimedOut:
            found = h.finish()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("frame")
            for f, p in zip(rows["frame"], rows["p"]):
                found += h.add(int(f), float(p))
            state.update(h.state())
            state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + int(gap * 1000) + 1)
        if found:
            yield pd.DataFrame({"clip_id": key[0], "label": key[1], "start": [s for s, _ in found], "stop": [e for _, e in found]})

    rows = stream.select("ts", "clip_id", "label", "frame", "p").withWatermark("ts", late).groupBy("clip_id", "label")
    return rows.applyInPandasWithState(run, "clip_id long, label string, start long, stop long", STATE, "append", GroupStateTimeout.EventTimeTimeout)
