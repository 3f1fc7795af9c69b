"""Operators on frames: (clip_id, label, frame, p) on a grid of 40 ms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME, RATE = 0.04, 16_000
SERIES = ["clip_id", "label"]


def frame_count(samples: Column) -> Column:
    """Frames of a recording of so many samples."""
    return (F.floor(samples / RATE / FRAME) + 1).cast("int")


def window_starts(samples: Column, window: int = 8 * RATE, hop: int = 2 * RATE) -> Column:
    """Starts of the overlapping windows that cover a recording, in samples."""
    last = F.greatest(F.lit(1), samples - window + hop)
    return F.sequence(F.lit(0), (F.ceil(last / hop) - 1).cast("int") * hop, F.lit(hop))


def overlap_average(windows: DataFrame, lengths: DataFrame) -> DataFrame:
    """clip_id, label, frame, p: the mean over the windows that reach a frame, 0 where none does.

    windows: clip_id, label, first (frame of the window's start), scores array.
    lengths: clip_id, n_frames.
    """
    rows = windows.select(*SERIES, "first", F.posexplode("scores").alias("i", "p")).select(*SERIES, (F.col("first") + F.col("i")).alias("frame"), "p")
    means = rows.groupBy(*SERIES, "frame").agg(F.avg("p").alias("p"))
    grid = windows.select(*SERIES).distinct().join(lengths, "clip_id").select(*SERIES, F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame"))
    return grid.join(means, [*SERIES, "frame"], "left").select(*SERIES, "frame", F.coalesce("p", F.lit(0.0)).alias("p"))


def median_smooth(frames: DataFrame, size: int = 5) -> DataFrame:
    """Running median of size frames, the ends mirrored (the edge frame repeats).

    A series is one array while it is smoothed: no shuffle but the one that
    gathers it, and mirroring is index arithmetic.
    """
    half = size // 2
    series = frames.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("frame", "p"))).alias("s"))
    n = F.size("s")

    def at(i: Column) -> Column:
        m = F.pmod(i, 2 * n)
        return F.col("s")[F.when(m < n, m).otherwise(2 * n - 1 - m)]["p"]

    middle = lambda x, i: F.struct(x["frame"].alias("frame"), F.array_sort(F.array(*[at(i + k) for k in range(-half, half + 1)]))[half].alias("p"))
    return series.select(*SERIES, F.explode(F.transform("s", middle)).alias("x")).select(*SERIES, "x.frame", "x.p")


def target_frames(events: DataFrame, n_frames: int, dilate: int = 1) -> DataFrame:
    """clip_id, label, frame: the frames that annotated events (start_s, end_s) cover, dilated, each once."""
    first = F.greatest(F.lit(0), F.floor(F.col("start_s") / FRAME).cast("int") - dilate)
    last = F.least(F.lit(n_frames), F.floor(F.col("end_s") / FRAME).cast("int") + 1 + dilate) - 1
    return events.where(first <= last).select(*SERIES, F.explode(F.sequence(first, last)).alias("frame")).distinct()


def dilate_hits(frames: DataFrame, reach: int = 8) -> DataFrame:
    """frames (with hit boolean) plus near_hit: a hit lies within reach frames."""
    around = Window.partitionBy(*SERIES).orderBy("frame").rowsBetween(-reach, reach)
    return frames.withColumn("near_hit", F.max("hit").over(around))


def runs(frames: DataFrame, active: Column) -> DataFrame:
    """clip_id, label, start, stop (exclusive) of the runs of consecutive active frames."""
    order = Window.partitionBy(*SERIES).orderBy("frame")
    rows = frames.where(active).withColumn("island", F.col("frame") - F.row_number().over(order))
    return rows.groupBy(*SERIES, "island").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop")).drop("island")


def longest_clean_run(frames: DataFrame, reach: int = 8, least: int = 50) -> DataFrame:
    """The longest run of each series away from hits, the first of equals; none shorter than least frames."""
    clean = runs(dilate_hits(frames, reach), ~F.col("near_hit")).where(F.col("stop") - F.col("start") >= least)
    rank = F.row_number().over(Window.partitionBy(*SERIES).orderBy((F.col("stop") - F.col("start")).desc(), "start"))
    return clean.withColumn("_r", rank).where("_r = 1").drop("_r")


def fixed_chunks(recordings: DataFrame, width: int) -> DataFrame:
    """recordings (with length) plus start and stop of each whole chunk; a partial tail is left out."""
    ok = recordings.where(F.col("length") >= width)
    return ok.withColumn("start", F.explode(F.sequence(F.lit(0), (F.col("length") - width).cast("int"), F.lit(width)))).withColumn("stop", F.col("start") + width)


def noise_floor(frames: DataFrame, value: str = "p", share: float = 0.1) -> DataFrame:
    """clip_id, label, floor: the share's quantile, linearly interpolated."""
    return frames.groupBy(*SERIES).agg(F.percentile(value, share).alias("floor"))


def active_span(frames: DataFrame, value: str = "p", rise: float = 8.0, drop: float = 40.0) -> DataFrame:
    """clip_id, label, first, last: the outermost frames louder than both floor + rise and peak - drop."""
    whole = Window.partitionBy(*SERIES)
    level = F.greatest(F.percentile(value, 0.1).over(whole) + rise, F.max(value).over(whole) - drop)
    return frames.withColumn("_level", level).where(F.col(value) > F.col("_level")).groupBy(*SERIES).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


def loudest_run(frames: DataFrame, value: str = "p", rise: float = 4.0, gap: int = 5) -> DataFrame:
    """clip_id, label, start, stop, energy: of the runs above floor + rise, joined over gaps of at most gap frames, the one of most energy."""
    whole, order = Window.partitionBy(*SERIES), Window.partitionBy(*SERIES).orderBy("frame")
    rows = frames.withColumn("_floor", F.percentile(value, 0.1).over(whole)).where(F.col(value) > F.col("_floor") + rise)
    fresh = F.coalesce(F.col("frame") - F.lag("frame").over(order) - 1 > gap, F.lit(True)).cast("int")
    rows = rows.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order))
    sums = rows.groupBy(*SERIES, "_run").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"), F.sum(F.col(value) - F.col("_floor")).alias("energy"))
    rank = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.round("energy", 9).desc(), "start"))
    return sums.withColumn("_r", rank).where("_r = 1").drop("_r", "_run")


def rolled(frames: DataFrame, shift: int, length: int) -> DataFrame:
    """frames moved shift places on a circle of length frames."""
    return frames.withColumn("frame", F.pmod(F.col("frame") + shift, F.lit(length)))


def concatenated(pieces: DataFrame, order: str) -> DataFrame:
    """pieces (clip_id, length, events with start_s and end_s by explode) plus offset: where each starts when laid end to end."""
    before = Window.partitionBy("clip_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def silence_inserted(events: DataFrame, at: float, gap: float, limit: float = 8.0, least: float = 0.05) -> DataFrame:
    """Events after a point move by gap, are cut at limit, and go if shorter than least."""
    move = F.when(F.col("start_s") >= at, F.lit(gap)).otherwise(0.0)
    out = events.withColumn("start_s", F.col("start_s") + move).withColumn("end_s", F.least(F.lit(limit), F.col("end_s") + move))
    return out.where(F.col("end_s") - F.col("start_s") >= least)
