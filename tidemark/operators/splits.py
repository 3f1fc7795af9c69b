"""Stable splits by hash and by the rules of each kind of source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_validation(key: Column, percent: int = 10) -> Column:
    """True for about percent of the keys: CRC-32 of the key's UTF-8 modulo 100 lies below it."""
    return F.crc32(key.cast("string").cast("binary")) % 100 < percent


def train_or_val(key: Column, percent: int = 10) -> Column:
    return F.when(is_validation(key, percent), "val").otherwise("train")


def row_key(file: Column, group: Column, row: Column) -> Column:
    """basename/row group/row."""
    return F.concat_ws("/", F.substring_index(file, "/", -1), group.cast("string"), row.cast("string"))


def district_split(district: Column, quality: Column, percent: int = 10) -> Column:
    """Held-out districts give val clips if their times are verified, else none; clips without times are skipped."""
    held = F.when(quality == "verified_timestamps", "val").otherwise("skip")
    return F.when(quality == "no_timestamps", "skip").when(is_validation(district, percent), held).otherwise("train")


def file_prefix_split(file: Column) -> Column:
    return F.when(F.substring_index(file, "/", -1).startswith("test"), "val").otherwise("train")


def folder_split(file: Column) -> Column:
    """val for the second path part dev or test."""
    return F.when(F.split(file, "/")[1].isin("dev", "test"), "val").otherwise("train")


def session_of(path: Column) -> Column:
    """A recording's session: its path without the trailing _<number>.wav."""
    return F.regexp_replace(path, r"_\d+\.wav$", "")


def kind_of(path: Column) -> Column:
    """The first piece of a file name before " _ " or "_<digit>"."""
    return F.trim(F.split(F.substring_index(path, "/", -1), r" _ |_\d")[0])


def time_split(position: Column, length: Column, share: float = 0.8) -> Column:
    """The first share of a recording trains, the rest validates."""
    return F.when(position < F.floor(length * F.lit(share)), "train").otherwise("val")
