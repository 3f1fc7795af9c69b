"""Sources: file listings, Parquet indexes, nested JSON metadata, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO = ("wav", "mp3", "flac", "ogg", "m4a", "opus", "webm", "mp4")


def audio_files(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """path, length (and content) of the audio files under a folder, by extension whatever its case; a missing path is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(AUDIO)})$")).select("path", "length", *(["content"] if content else []))


def environments(spark: SparkSession, path: str) -> DataFrame:
    """env: the folders that hold files, one level above them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("env")).distinct()


def parquet_index(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """columns plus file, rg, row, rg_mb: a row for each row of the files, without reading other columns.

    Spark shows each row's place in its file; the row groups' bounds come from
    the footers, which the driver reads as a query planner would.  They are a
    few numbers for each row group.
    """
    # a local file's URI has one slash or three, depending on who writes it
    rows = spark.read.parquet(path).select(*columns, F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file"), F.col("_metadata.row_index").alias("_at"))
    names = spark.read.parquet(path).inputFiles()
    groups = row_groups(spark, names).withColumn("_file", F.regexp_replace("_file", "^file:/+", "file:/"))
    return rows.join(groups, (rows["file"] == groups["_file"]) & (rows["_at"] >= groups["_first"]) & (rows["_at"] < groups["_first"] + groups["_n"])).select(*columns, "file", "rg", (F.col("_at") - F.col("_first")).cast("int").alias("row"), "rg_mb")


def row_groups(spark: SparkSession, names: list[str]) -> DataFrame:
    """_file, rg, _first, _n, rg_mb of every row group, from the footers of any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in names:
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        first = 0
        for g, block in enumerate(reader.getRowGroups()):
            out.append((name, g, first, block.getRowCount(), block.getTotalByteSize() / 1e6))
            first += block.getRowCount()
        reader.close()
    return spark.createDataFrame(out, "_file string, rg int, _first long, _n long, rg_mb double")


def nested_metadata(spark: SparkSession, path: str) -> DataFrame:
    """label, path, speaker from one JSON object {label: {file: {"speakerID": ...}}}."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,struct<speakerID:string>>>").alias("m"))
    files = text.select(F.explode("m").alias("label", "files"))
    return files.select("label", F.explode("files").alias("path", "s")).select("label", "path", F.col("s.speakerID").alias("speaker"))


def existing_only(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata whose path is among the files' base names."""
    return metadata.join(files.select(F.substring_index("path", "/", -1).alias("path")).distinct(), "path", "left_semi")


def zip_members(archives: DataFrame) -> DataFrame:
    """archive, member, content of the files in zip archives (path, content); folders and system files are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, blob in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for m in z.infolist():
                        if not (m.is_dir() or "MACOSX" in m.filename or "/._" in m.filename):
                            yield pd.DataFrame({"archive": [name], "member": [m.filename], "content": [z.read(m)]})

    return archives.select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def threshold_profile(spark: SparkSession, path: str) -> DataFrame:
    """label, thr from a JSON object of numbers; settings, whose names start with an underscore, are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("label", "thr"))
    return rows.where(~F.col("label").startswith("_"))


def profile_setting(spark: SparkSession, path: str, name: str, default: float) -> float:
    """A setting of a profile, such as _low_ratio."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>")[name].alias("v")).first()
    return default if row is None or row["v"] is None else row["v"]
