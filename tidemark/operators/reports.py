"""Counts, tables and statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import MIN_EVENTS, is_inline


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def class_table(rows: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """label, a zero-filled column for each source, inline, total."""
    table = rows.groupBy("label").pivot("src", sources).count().na.fill(0)
    names = [c for c in table.columns if c != "label"]
    return table.select("label", *names, is_inline(F.col("label")).alias("inline"), sum((F.col(f"`{c}`") for c in names), F.lit(0)).cast("long").alias("total"))


def class_list(rows: DataFrame, listed: list[str] | None = None, least: int = MIN_EVENTS) -> DataFrame:
    """label, idx: the listed labels with enough events, numbered by name."""
    from pyspark.sql import Window

    counts = counts_by(rows, "label").where(F.col("n") >= least)
    if listed is not None:
        counts = counts.where(F.col("label").isin(listed))
    return counts.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("idx"))


def unknown_labels(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.select("label").distinct().join(known.select("label"), "label", "left_anti")


def require_known(rows: DataFrame, known: DataFrame) -> None:
    """Raise ValueError that names labels which are not known."""
    extra = [r["label"] for r in unknown_labels(rows, known).orderBy("label").limit(20).collect()]
    if extra:
        raise ValueError(f"unknown labels: {', '.join(map(str, extra))}")


def scored_where_annotated(rows: DataFrame, annotated: DataFrame) -> DataFrame:
    """Rows whose source annotates their label."""
    return rows.join(annotated.select("src", "label").distinct(), ["src", "label"], "left_semi")


def store_statistics(items: DataFrame, rate: int = 16_000) -> DataFrame:
    """store, split, items, hours, gb of 16-bit audio, with subtotals (null split, null store)."""
    out = items.rollup("store", "split").agg(F.count(F.lit(1)).alias("items"), F.sum("len").alias("_len"))
    return out.select("store", "split", "items", (F.col("_len") / rate / 3600).alias("hours"), (F.col("_len") * 2 / 1e9).alias("gb"))


def outcomes(rows: DataFrame, value: str = "blob") -> DataFrame:
    """where_, rows, undecodable: how many values of each place are null."""
    return rows.groupBy("where_").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value).isNull()).alias("undecodable"))


def side_by_side(a: DataFrame, b: DataFrame, columns: list[str], names: tuple[str, str]) -> DataFrame:
    """label and both models' columns with the models' names appended; labels of either."""
    left, right = (df.select("label", *[F.col(c).alias(f"{c}_{n}") for c in columns]) for df, n in zip((a, b), names))
    return left.join(right, "label", "full_outer")


def clip_maxima(frames: DataFrame) -> DataFrame:
    """clip_id, label, p: each label's largest probability in a clip."""
    return frames.groupBy("clip_id", "label").agg(F.max("p").alias("p"))


def alignment_outcomes(rows: DataFrame, least: float = 0.35, longest: float = 30.0) -> DataFrame:
    """outcome, n of aligned clips (duration, score, n_words): too_long, no_words, failed, poor or located."""
    outcome = F.when(F.col("duration") > longest, "too_long").when(F.col("n_words") == 0, "no_words").when(F.col("score").isNull(), "failed").when(F.col("score") < least, "poor").otherwise("located")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
