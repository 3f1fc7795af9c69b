"""Sinks: JSON Lines, CSV reports, write-once indexes, threshold files, rendered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def records(events: DataFrame, durations: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """file, duration, events[] (and transcript): one record for each recording, also for those without events."""
    item = F.struct(F.col("start_s").alias("start"), "label", F.col("end_s").alias("end"), "prob")
    own = events.groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("e"))
    shaped = F.transform(F.coalesce("e", F.array().cast("array<struct<start:double,label:string,end:double,prob:double>>")), lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["end"].alias("end"), x["prob"].alias("prob")))
    out = durations.select("file", "duration").join(own, "file", "left").select("file", "duration", shaped.alias("events"))
    return out if transcripts is None else out.join(transcripts.select("file", "transcript"), "file", "left")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_once(rows: DataFrame, path: str) -> DataFrame:
    """rows as Parquet, written only if nothing is there yet, and read back."""
    rows.write.mode("ignore").parquet(path)
    return rows.sparkSession.read.parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """One CSV part with a header, for reports of a bounded number of rows."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_thresholds(rows: DataFrame, path: str) -> None:
    """{label: thr} as one JSON text."""
    rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "thr"))))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def console_line(label: Column, start: Column, end: Column, prob: Column) -> Column:
    """An event as one line of a report."""
    return F.format_string("%7.2f-%7.2fs  %s  p=%.2f", start, end, label, prob)


def console_report(rows: DataFrame) -> DataFrame:
    """file, report of records: a line for each event, or "(no events)"."""
    lines = F.transform("events", lambda e: console_line(e["label"], e["start"], e["end"], e["prob"]))
    return rows.select("file", F.when(F.size("events") == 0, "(no events)").otherwise(F.array_join(lines, "\n")).alias("report"))


def render(rows: DataFrame, template: str, mark: str = "__CLASSES_JSON__") -> str:
    """template with mark replaced by the rows as a JSON array; for tables of a bounded number of rows."""
    value = rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("v")).first()["v"]
    return template.replace(mark, value or "[]")
