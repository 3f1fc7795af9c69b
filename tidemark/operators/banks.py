"""Plans of what to cut from indexed clips for training, and reports over what was cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quotas

#: Seconds: shortest and longest single event, longest clip that is used whole.
SHORTEST, LONGEST, WHOLE = 0.15, 5.0, 20.0


def all_known(labels: Column, known: list[str]) -> Column:
    """True if there are labels and each is known; a null label is not."""
    return (F.size(labels) > 0) & F.forall(labels, lambda c: F.coalesce(c.isin(known), F.lit(False)))


def _taken(eligible: Column, keys: list[str], order: list[str], cap: Column) -> Column:
    """True for the first cap eligible rows of each key in order."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return eligible & (F.count_if(eligible).over(before) <= cap)


def single_event_plan(clips: DataFrame, known: list[str], order: list[str], event_cap: int, bed_cap: int, whole_cap: int) -> DataFrame:
    """clips (src, label, split, duration, start_s, end_s) with take_event, take_bed and take_whole, without those that are of no use.

    Quotas count what is planned, not what can later be decoded, in the given
    order: events by source, label and split, beds by split, whole clips by
    source and split; validation has an eighth of each (of events two at least).
    """
    mine = F.coalesce(F.col("label").isin(known), F.lit(False))
    train = F.col("split") == "train"
    lasts = (F.col("end_s") - F.col("start_s")).between(SHORTEST, LONGEST)
    out = clips.withColumn("take_event", _taken(mine & F.coalesce(lasts, F.lit(False)), ["src", "label", "split"], order, quotas.validation_cap(F.col("split"), event_cap)))
    out = out.withColumn("take_bed", _taken(F.lit(True), ["split"], order, F.when(train, bed_cap).otherwise(bed_cap // 8)))
    out = out.withColumn("take_whole", _taken(mine & F.coalesce(F.col("duration") <= WHOLE, F.lit(False)), ["src", "split"], order, F.when(train, whole_cap).otherwise(whole_cap // 8)))
    return out.where("take_event or take_bed or take_whole")


def capped_samples(length: Column, rate: int = 16_000, most: float = 5.0) -> Column:
    """A trimmed recording's samples, cut at most seconds."""
    return F.least(length, F.lit(int(most * rate)))


def noise_key(kind: Column, env: Column) -> Column:
    """What a background recording's quota counts by: its environment, or its kind where it has none."""
    return F.coalesce(F.concat(F.lit("env/"), env), F.concat(F.lit("kind/"), kind))


def macro_of_frequent(scores: DataFrame, columns: list[str], least: int = 10, count: str = "gt") -> DataFrame:
    """The means of columns over labels with least events or more, and how many labels those are."""
    return scores.where(F.col(count) >= least).agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n_labels"))


def threshold_report(thresholds: DataFrame, by: str = "ap") -> DataFrame:
    """A report's rows with their rank, best first (ties by label), and the mean of by over labels that are not weak."""
    order = Window.orderBy(F.col(by).desc_nulls_last(), "label")  # a row for each label
    every = Window.partitionBy(F.lit(1))
    return thresholds.withColumn("rank", F.row_number().over(order)).withColumn(f"mean_{by}", F.avg(F.when(~F.col("weak"), F.col(by))).over(every))
