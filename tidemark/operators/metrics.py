"""Ranking and threshold metrics over scored targets (label, p, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds that a search tries: 0.05, 0.075, ... 0.975.
GRID_START, GRID_STEP, GRID_SIZE = 0.05, 0.025, 38


def average_precision(scored: DataFrame, keys: list[str] | None = None, tie: str = "id") -> DataFrame:
    """keys, positives, ap: precision at each positive by falling p, averaged; ties stand in the order of tie."""
    keys = keys or ["label"]
    order = Window.partitionBy(*keys).orderBy(F.desc("p"), tie)
    rows = scored.withColumn("_k", F.row_number().over(order)).withColumn("_tp", F.sum("y").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys).agg(F.sum("y").alias("positives"), (F.sum(F.when(F.col("y") == 1, F.col("_tp") / F.col("_k")).otherwise(0.0)) / F.greatest(F.lit(1), F.sum("y"))).alias("ap"))


def macro_average_precision(ap: DataFrame, sets: list[str]) -> DataFrame:
    """sets, macro_ap: the mean over labels with a positive; null if none."""
    return ap.groupBy(*sets).agg(F.avg(F.when(F.col("positives") > 0, F.col("ap"))).alias("macro_ap"))


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p = tp / F.greatest(F.lit(1), tp + fp)
    r = tp / F.greatest(F.lit(1), tp + fn)
    f = lambda b2: (1 + b2) * p * r / F.greatest(F.lit(1e-9), b2 * p + r)
    return [p.alias("precision"), r.alias("recall"), f(1.0).alias("f1"), f(4.0).alias("f2")]


def at_threshold(scored: DataFrame, threshold: Column, keys: list[str] | None = None) -> DataFrame:
    """keys, precision, recall, f1, f2 with p strictly above the threshold counting as found."""
    keys = keys or ["label"]
    hit = F.col("p") > threshold
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return scored.groupBy(*keys).agg(one(hit & (F.col("y") == 1)).alias("tp"), one(hit & (F.col("y") == 0)).alias("fp"), one(~hit & (F.col("y") == 1)).alias("fn")).select(*keys, "tp", "fp", "fn", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def threshold_table(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, step, thr, precision, recall, f1, f2 for every threshold of the grid.

    Rows are first counted by how many thresholds they exceed, so what is
    shuffled is a histogram and not rows times thresholds.
    """
    keys = keys or ["label"]
    grid = [GRID_START + GRID_STEP * i for i in range(GRID_SIZE)]
    level = sum((F.when(F.col("p") > t, 1).otherwise(0) for t in grid), F.lit(0))
    counts = scored.groupBy(*keys, level.alias("level")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    series = counts.groupBy(*keys).agg(F.collect_list(F.struct("level", "pos", "neg")).alias("h"), F.sum("pos").alias("_pos"))
    rows = series.select(*keys, "h", "_pos", F.posexplode(F.array(*map(F.lit, grid))).alias("step", "thr"))
    above = lambda field: F.aggregate("h", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["level"] > F.col("step"), x[field]).otherwise(0))
    rows = rows.select(*keys, "step", "thr", above("pos").alias("tp"), above("neg").alias("fp"), "_pos").withColumn("fn", F.col("_pos") - F.col("tp"))
    return rows.select(*keys, "step", "thr", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def best_threshold(scored: DataFrame, measure: str = "f1", keys: list[str] | None = None) -> DataFrame:
    """keys, thr and the measure: the grid's best threshold, the lowest of equals (to 12 decimals)."""
    keys = keys or ["label"]
    best = F.max_by(F.struct("thr", measure), F.struct(F.round(measure, 12).alias("m"), (-F.col("step")).alias("s")))
    return threshold_table(scored, keys).groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.thr", f"_b.{measure}")


def two_folds(scored: DataFrame, order: str = "id") -> DataFrame:
    """scored plus fold: even and odd rows of each label."""
    return scored.withColumn("fold", (F.row_number().over(Window.partitionBy("label").orderBy(order)) - 1) % 2)


def cross_validated(scored: DataFrame, measure: str = "f1", order: str = "id") -> DataFrame:
    """label and cv_<measure>: the threshold found on one fold, measured on the other, averaged."""
    rows = two_folds(scored, order)
    best = best_threshold(rows, measure, ["label", "fold"]).select("label", (1 - F.col("fold")).alias("fold"), F.col("thr").alias("_thr"))
    scores = at_threshold(rows.join(best, ["label", "fold"]), F.col("_thr"), ["label", "fold"])
    return scores.groupBy("label").agg(F.avg(measure).alias(f"cv_{measure}"))


def weak_clamped(report: DataFrame) -> DataFrame:
    """report (positives, cv_f1, balanced, sensitive) plus weak, with clamped thresholds for weak labels."""
    weak = (F.col("positives") < 25) | (F.col("cv_f1") < 0.1)
    return report.withColumn("weak", weak).withColumn("balanced", F.when(weak, F.greatest("balanced", F.lit(0.9))).otherwise(F.col("balanced"))).withColumn("sensitive", F.when(weak, F.least(F.greatest("sensitive", F.lit(0.6)), F.lit(0.8))).otherwise(F.col("sensitive")))


def positive_weight(positive: Column, total: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(1.0), (total - positive) / F.greatest(positive, F.lit(1))))


def event_scores(counts: DataFrame) -> DataFrame:
    """counts (gt, gt_found, pred, pred_ok) plus recall, precision, f1 (0 where undefined)."""
    r, p = F.col("gt_found") / F.nullif("gt", F.lit(0)), F.col("pred_ok") / F.nullif("pred", F.lit(0))
    out = counts.withColumn("recall", r).withColumn("precision", p)
    return out.withColumn("f1", F.coalesce(F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))), F.lit(0.0)))
