"""Threshold profiles: a base, overrides of a file and of a run, the last that names a label wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_overrides(text: Column) -> Column:
    """map<string,double> from k=v,k=v."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda k, v: v.cast("double"))


def layered(labels: DataFrame, base: DataFrame, *overrides: DataFrame, default: float = 0.5) -> DataFrame:
    """label, thr: the last override that has the label, else the base, else the default."""
    out = labels.select("label").join(base.select("label", F.col("thr").alias("_t0")), "label", "left")
    for i, o in enumerate(overrides, 1):
        out = out.join(o.select("label", F.col("thr").alias(f"_t{i}")), "label", "left")
    return out.select("label", F.coalesce(*[f"_t{i}" for i in range(len(overrides), -1, -1)], F.lit(default)).alias("thr"))


def active(thresholds: DataFrame) -> DataFrame:
    """Without the labels that a threshold above 1 switches off."""
    return thresholds.where("thr <= 1")


def bounded(thr: Column, default: float = 0.9, most: float = 0.99) -> Column:
    return F.least(F.coalesce(thr, F.lit(default)), F.lit(most))


def visible(events: DataFrame, hidden: list[str], least: float) -> DataFrame:
    """Events that a run reports: not hidden, and probable enough after rounding."""
    return events.where(~F.col("label").isin(hidden) & (F.col("prob") >= least)) if hidden else events.where(F.col("prob") >= least)
