"""Canonical tables over the driver's Parquet files, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, label, frame, p."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"), F.posexplode("embedding").alias("frame", "x"))
    return rows.select("clip_id", "label", "frame", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.col("x").cast("double"))).alias("p"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, clip_id, label, start_s, end_s: a user's day-time recording, all days in one."""
    micros = F.hour("ts").cast("long") * 3_600_000_000 + F.minute("ts").cast("long") * 60_000_000 + F.round(F.expr("extract(second from ts)") * 1_000_000).cast("long")
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("clip_id"), F.col("event_type").alias("label"), (micros / F.lit(1e6)).alias("start_s"), "value")
    return rows.select("id", "clip_id", "label", "start_s", (F.col("start_s") + 20 * F.col("value")).alias("end_s"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, src, label, file, rg, row, duration, split."""
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(d.alias("clip_id"), F.col("source").alias("src"), F.col("lang").alias("label"), F.concat(F.lit("shard-"), F.floor(d / 500).cast("string"), F.lit(".parquet")).alias("file"), F.floor(d / 50).cast("int").alias("rg"), (d % 50).cast("int").alias("row"), (F.col("n_chars") / F.lit(100.0)).alias("duration"), F.when(d % 10 == 0, "val").otherwise("train").alias("split"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, text: a turn is a recording."""
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("clip_id"), "text")


#: So many words are sorted in one task, whatever the size of the table.
WORDS_A_TASK = 300_000


def turns_by_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns dealt by clip over as many tasks as their words need; whole texts move, and steps on a clip's words deal nothing anew."""
    rows = turns(spark, sf_dir)
    n = rows.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-n // WORDS_A_TASK)), "clip_id")


def words(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """clip_id, pos, word, start_s, end_s: the words of turns, one every 0.4 s; every ninth word has no times."""
    rows = (turns(spark, sf_dir) if of is None else of).select("clip_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    start = F.when(F.col("pos") % 9 != 8, F.col("pos") * F.lit(0.4))
    return rows.select("clip_id", "pos", "word", start.alias("start_s"), (start + 0.3).alias("end_s"))


def sounds(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """clip_id, label, start_s, end_s: sounds within the recordings of words."""
    rows = words(spark, sf_dir, of).where("pos % 5 = 2")
    label = F.element_at(F.array(*map(F.lit, ("cough", "horn", "laugh", "bird"))), (F.floor(F.col("pos") / 10) % 4 + 1).cast("int"))
    start = F.col("pos") * F.lit(0.4) + 0.1
    return rows.select("clip_id", label.alias("label"), start.alias("start_s"), (start + 0.9).alias("end_s"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, p, y."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = d.join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), ((F.col("n_chars") * 7919 + F.col("toxic") * 350) % 1000 / F.lit(1000.0)).alias("p"), F.col("toxic").cast("long").alias("y"))


#: The same tables as common table expressions.
SQL = {
    "fs": "select vec_id as clip_id, 'c' || cast(label as varchar) as label, cast(i - 1 as integer) as frame, least(1e0, greatest(0e0, 5e-1 + cast(embedding[i] as double))) as p from embeddings, range(1, 65) t(i)",
    "ev": "select event_id as id, user_id as clip_id, event_type as label, (epoch_us(ts) % 86400000000) / 1e6 as start_s, (epoch_us(ts) % 86400000000) / 1e6 + 20 * value as end_s from events",
    "clips": "select doc_id as clip_id, source as src, lang as label, 'shard-' || cast(doc_id // 500 as varchar) || '.parquet' as file, cast(doc_id // 50 as integer) as rg, cast(doc_id % 50 as integer) as row, n_chars / 1e2 as duration, case when doc_id % 10 = 0 then 'val' else 'train' end as split from documents",
    "words": "select clip_id, pos, word, case when pos % 9 <> 8 then pos * 4e-1 end as start_s, case when pos % 9 <> 8 then pos * 4e-1 + 3e-1 end as end_s from (select conv_id * 1000 + turn as clip_id, unnest(range(len(string_split(text, ' ')))) as pos, unnest(string_split(text, ' ')) as word from conversations)",
    "sounds": "select clip_id, (['cough', 'horn', 'laugh', 'bird'])[(pos // 10) % 4 + 1] as label, pos * 4e-1 + 1e-1 as start_s, pos * 4e-1 + 1e-1 + 9e-1 as end_s from words where pos % 5 = 2",
    "scored": "select doc_id as id, lang as label, (n_chars * 7919 + toxic * 350) % 1000 / 1e3 as p, toxic as y from documents join labels using (doc_id)",
}


def with_tables(*names: str) -> str:
    """A WITH clause, open for more expressions, of the named tables."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names)
