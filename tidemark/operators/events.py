"""Operators on events: intervals (clip_id, label, start, stop or start_s, end_s)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import FRAME, SERIES


def hysteresis(frames: DataFrame, thresholds: DataFrame, low_ratio: float = 0.6, gap_inline: float = 0.3, gap_background: float = 1.0, least: float = 0.15) -> DataFrame:
    """clip_id, label, start, stop, prob: runs above low_ratio * thr that rise above thr, joined over short gaps.

    thresholds: label, thr, inline; a threshold above 1 switches a label off.
    Runs that never rise above thr neither count nor bridge.  Joined runs
    shorter than least seconds go.  prob is the mean of all frames in between,
    dips included.  One exchange on the series serves every step.
    """
    rows = frames.join(thresholds.where("thr <= 1"), "label")
    order = Window.partitionBy(*SERIES).orderBy("frame")
    low = rows.withColumn("_sum", F.sum("p").over(order)).where(F.col("p") > low_ratio * F.col("thr"))
    low = low.withColumn("_island", F.col("frame") - F.row_number().over(order))
    island = low.groupBy(*SERIES, "_island", "inline").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"), F.max(F.col("p") > F.col("thr")).alias("_rises"), F.max("_sum").alias("_to"), F.min_by(F.col("_sum") - F.col("p"), "frame").alias("_from"))
    island = island.where("_rises")
    by_start = Window.partitionBy(*SERIES).orderBy("start")
    gap = F.when(F.col("inline"), gap_inline).otherwise(gap_background)
    apart = F.coalesce((F.col("start") - F.lag("stop").over(by_start)) * F.lit(FRAME) > gap, F.lit(True))
    island = island.withColumn("_new", apart.cast("int")).withColumn("_event", F.sum("_new").over(by_start))
    out = island.groupBy(*SERIES, "_event").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("_from", "start").alias("_from"), F.max_by("_to", "stop").alias("_to"))
    out = out.where((F.col("stop") - F.col("start")) * F.lit(FRAME) >= least)
    return out.select(*SERIES, "start", "stop", ((F.col("_to") - F.col("_from")) / (F.col("stop") - F.col("start"))).alias("prob"))


def as_seconds(events: DataFrame) -> DataFrame:
    """clip_id, label, start_s, end_s, prob from frame events, rounded to hundredths."""
    return events.select(*SERIES, F.round(F.col("start") * F.lit(FRAME), 2).alias("start_s"), F.round(F.col("stop") * F.lit(FRAME), 2).alias("end_s"), F.round("prob", 2).alias("prob"))


def gap_join(events: DataFrame, gap: Column, keys: list[str] | None = None) -> DataFrame:
    """keys, start_s, end_s, n: events of one series joined while the next starts at most gap after the farthest end so far."""
    keys = keys or SERIES
    before = Window.partitionBy(*keys).orderBy("start_s", "end_s").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start_s", "end_s").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("start_s") - F.max("end_s").over(before) > gap, F.lit(True)).cast("int")
    rows = events.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(upto))
    return rows.groupBy(*keys, "_island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("n")).drop("_island")


def _overlap(a: str, b: str) -> Column:
    return (F.col(f"{a}.start_s") < F.col(f"{b}.end_s")) & (F.col(f"{a}.end_s") > F.col(f"{b}.start_s"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str] | None = None, how: str = "left_semi") -> DataFrame:
    """Rows of left that do (left_semi) or do not (left_anti) overlap a row of right with the same keys, ends excluded."""
    keys = keys or SERIES
    on = _overlap("l", "r")
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return left.alias("l").join(right.alias("r"), on, how)


def overlap_counts(truth: DataFrame, found: DataFrame) -> DataFrame:
    """label, gt, gt_found, pred, pred_ok: events of each side and those that the other overlaps."""
    side = lambda df, n: df.groupBy("label").agg(F.count(F.lit(1)).alias(n))
    parts = [side(truth, "gt"), side(overlapping(truth, found), "gt_found"), side(found, "pred"), side(overlapping(found, truth), "pred_ok")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "label", "full_outer")
    return out.na.fill(0)


def cropped(events: DataFrame, margin: float = 0.03, rate: int = 16_000) -> DataFrame:
    """events plus a and z: the samples of a crop with a margin on both sides."""
    return events.withColumn("a", F.floor(F.greatest(F.lit(0.0), F.col("start_s") - margin) * rate).cast("long")).withColumn("z", F.floor((F.col("end_s") + margin) * rate).cast("long"))


def crop_ok(duration: Column, inline: Column, shortest: float = 0.15, longest_inline: float = 3.0, longest: float = 8.0) -> Column:
    """A crop's length is within the limits of its kind."""
    return duration.between(F.lit(shortest), F.when(inline, longest_inline).otherwise(longest))


def speech_bed(clips: DataFrame, away: float = 0.3, least: float = 2.0, longest: float = 10.0) -> DataFrame:
    """clips (duration, start_s, end_s) plus bed_s, bed_e: the longer side away from the event, the earlier of equals."""
    before, after = F.greatest(F.lit(0.0), F.col("start_s") - away), F.greatest(F.lit(0.0), F.col("duration") - F.col("end_s") - away)
    first = before >= after
    out = clips.withColumn("bed_s", F.when(first, 0.0).otherwise(F.col("end_s") + away)).withColumn("_len", F.greatest(before, after))
    return out.where(F.col("_len") >= least).withColumn("bed_e", F.col("bed_s") + F.least(F.col("_len"), F.lit(longest))).drop("_len")
