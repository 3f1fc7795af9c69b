"""From PCM to events and transcripts, and the functions that SQL can call."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dsp
from .functions.taxonomy import DROP, TAG_RULES, is_inline
from .operators import events, frames
from .operators.frames import FRAME


def detect(bank: DataFrame, key: str, model: bytes, labels: list[str], thresholds: DataFrame, low_ratio: float = 0.6, gap_inline: float = 0.3, gap_background: float = 1.0, least: float = 0.15, batch: int = 16) -> DataFrame:
    """clip_id, label, start_s, end_s, prob of every event in a bank (key, pcm).

    Windows of 8 s every 2 s are judged by the model and averaged, smoothed by a
    median of five frames and read with hysteresis.  thresholds: label, thr; a
    threshold above 1 switches a label off.
    """
    scores = dsp.infer(bank, key, model, labels, batch)
    known = thresholds.select("label", "thr").withColumn("inline", is_inline(F.col("label")))
    found = events.hysteresis(frames.median_smooth(scores), known, low_ratio, gap_inline, gap_background, least)
    return events.as_seconds(found)


def class_runs(p: np.ndarray, high: float, low_ratio: float = 0.6, gap: float = 1.0, least: float = 0.15) -> list[tuple[int, int]]:
    """(start, stop) frames of runs above low_ratio * high that rise above high, joined over gaps of at most gap seconds, of least seconds or more."""
    if high > 1:
        return []
    above = np.flatnonzero(np.asarray(p, float) > low_ratio * high)
    runs = [(int(r[0]), int(r[-1]) + 1) for r in np.split(above, np.flatnonzero(np.diff(above) > 1) + 1) if len(r) and max(p[i] for i in r) > high]
    joined: list[tuple[int, int]] = []
    for a, z in runs:
        if joined and (a - joined[-1][1]) * FRAME <= gap:
            joined[-1] = (joined[-1][0], z)
        else:
            joined.append((a, z))
    return [(a, z) for a, z in joined if (z - a) * FRAME >= least]


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """Make canon_label(tag), class_runs(p, high, low_ratio, gap, least) and frame_db(pcm) callable from SQL in this session."""
    rules = " ".join(f"when t rlike {_text(pattern)} then {'null' if label is None else _text(label)}" for pattern, label in TAG_RULES)
    plain = r"trim(regexp_replace(regexp_replace(lower(tag), '[<>\\[\\]_]', ' '), '\\s+', ' '))"
    spark.sql(f"create or replace temporary function canon_label(tag string) returns string return (select case {rules} else {_text(DROP)} end from (select {plain} as t))")

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def runs(p: pd.Series, high: pd.Series, low_ratio: pd.Series, gap: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "stop": z} for a, z in class_runs(x, *k)] for x, *k in zip(p, high, low_ratio, gap, least)])

    @F.pandas_udf("array<double>")
    def db(pcm: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else dsp.frame_db(np.frombuffer(x, "<i2") / 32767).tolist() for x in pcm])

    spark.udf.register("class_runs", runs)
    spark.udf.register("frame_db", db)
