"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


_OWN: dict[str, str] = {}
#: A key is heavy if it holds more than one of so many rows, so there are fewer heavy keys than this.
HEAVY = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local master where none is configured (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _OWN[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back, which cuts the lineage for lost executors.

    Tables that df owns are deleted then, so df is not to be read again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tidemark_path = path
    discard(*vars(df).get("tidemark_owned", ()))
    return out


def owning(df: DataFrame, *written: DataFrame) -> DataFrame:
    """df, with tables that materialize wrote and that nothing but df reads."""
    df.tidemark_owned = written
    return df


def discard(*written: DataFrame) -> None:
    """Delete tables that materialize wrote, once everything that reads them has been written out itself."""
    for df in written:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.tidemark_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores more as it takes to clash with no column."""
    taken, out = {c.lower() for c in columns}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def heavy_keys(rows: DataFrame, key: str, total: int | None = None, one_in: int = HEAVY) -> DataFrame | None:
    """The keys that hold two rows or more and more than one of one_in of the total, None if there are none.

    There are fewer than one_in of them, whatever rows holds.
    """
    total = rows.count() if total is None else total
    found = rows.where(F.col(key).isNotNull()).groupBy(key).count().where((F.col("count") > 1) & (F.col("count") * one_in > total)).select(key)
    keys = found.collect()
    return rows.sparkSession.createDataFrame(keys, found.schema) if keys else None


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left joined (inner or left) to right, which has one row a key at most, without dealing out the rows of heavy keys by key.

    hot: left's heavy keys.  They are few by their definition, so their rows of
    right are broadcast.
    """
    if hot is None:
        return left.join(right, key, how)
    of_hot = right.join(F.broadcast(hot), key, "left_semi")
    return left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(of_hot), key, how).unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """A document's text; null counts as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element array binds it to a lambda variable."""
    return F.transform(F.array(value), body)[0]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
