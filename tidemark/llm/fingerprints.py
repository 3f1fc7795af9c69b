"""Order-independent fingerprints of documents: homomorphic hashing of their paragraphs.

Every paragraph is hashed to a wide vector and a document's state is the sum of
its paragraphs' vectors, modulo 2^16 in one part and 2^32 in the other.  The sum
does not depend on the order of paragraphs, and adding or subtracting one
paragraph's vector inserts or deletes it.  The vector has two parts:

- exact: EXACT pseudo-random numbers from SHAKE-128 of the paragraph, modulo
  2^16.  Two documents have equal parts if and only if (up to chance) they have
  the same paragraphs with the same multiplicities.
- likeness: the sum, over the paragraph's word shingles, of a hashed unit
  vector with a sign (one of LIKE coordinates), modulo 2^32.  Inner products of
  such sums estimate the shingle multisets' inner products, so their cosine
  measures how much two documents share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT, LIKE, SHINGLE = 128, 512, 3


def paragraphs(text: str) -> list[str]:
    """The lines of a text that hold a word, trimmed of ASCII white space."""
    return [p for p in (x.strip(" \t\n\x0b\x0c\r") for x in text.split("\n")) if p]


def _shingle_hashes(paragraph: str) -> np.ndarray:
    """A 64-bit hash of each run of SHINGLE words; of the whole paragraph if it has fewer."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, paragraph.split()), np.uint64)
    if len(h) < SHINGLE:
        return h[:1] * np.uint64(3) + h[-1:] + np.uint64(len(h))
    out = h[:len(h) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k:len(h) - SHINGLE + 1 + k]
    return out


def _counts(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
    at = ((mixed >> np.uint64(40)) % np.uint64(LIKE)).astype(np.int64)
    return np.bincount(at, sign, LIKE).astype(np.int64).astype(np.uint32)


#: What the parts are summed modulo, less one.
_MASK = np.repeat(np.array([0xFFFF, 0xFFFFFFFF], np.uint32), [EXACT, LIKE])


def state(text: str | None) -> np.ndarray:
    """The sum of all paragraphs' vectors, each part modulo its power; zeros for null, empty and blank texts."""
    out = np.zeros(EXACT + LIKE, np.uint32)
    parts = paragraphs(text) if text else []
    if parts:
        digests = b"".join([hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(2 * EXACT) for p in parts])
        out[:EXACT] = np.frombuffer(digests, "<u2").reshape(len(parts), EXACT).sum(0, dtype=np.uint64).astype(np.uint16)
        out[EXACT:] = _counts(np.concatenate([_shingle_hashes(p) for p in parts]))
    return out


def insert(s: np.ndarray, paragraph: str) -> np.ndarray:
    """The state with one more paragraph (or several lines)."""
    return (s + state(paragraph)) & _MASK


def delete(s: np.ndarray, paragraph: str) -> np.ndarray:
    return (s - state(paragraph)) & _MASK


def encode(s: np.ndarray) -> str:
    """A state as text: how many bytes a likeness coordinate takes (the least that hold all), then both parts in base 64."""
    like = s[EXACT:].astype(np.int32)
    size = next(k for k in (1, 2, 4) if k == 4 or -(1 << (8 * k - 1)) <= like.min() and like.max() < 1 << (8 * k - 1))
    return str(size) + base64.b64encode(s[:EXACT].astype("<u2").tobytes() + like.astype(f"<i{size}").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    data = base64.b64decode(fingerprint[1:])
    exact, like = np.frombuffer(data[:2 * EXACT], "<u2"), np.frombuffer(data[2 * EXACT:], f"<i{fingerprint[0]}")
    return np.concatenate([exact.astype(np.uint32), like.astype(np.int32).view(np.uint32)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: 1 for equal states, else the cosine of the likeness parts, read as signed numbers."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a[EXACT:].astype(np.int32).astype(np.float64), b[EXACT:].astype(np.int32).astype(np.float64)
    norm = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, (x @ y) / norm))) if norm else 0.0


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many, or all, of following."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


#: Stands for a null doc_id, as the smallest of all.
NULL_ID = -(1 << 63)


def _ranges(rows: DataFrame, parts: int) -> tuple[np.ndarray, dict[int, int]]:
    """(inner bounds of about parts ranges of key, {key that holds several ranges' worth of rows: how many}).

    Reads keys alone.
    """
    found = rows.select("key").stat.approxQuantile("key", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds, times = np.unique(np.array(found, np.float64), return_counts=True)
    return bounds, {int(k): int(n) for k, n in zip(bounds, times) if n > 1}


def _part_of(bounds: np.ndarray, heavy: dict[int, int]):
    """A function of key and tie to the number of a row's part; parts follow each other as documents do, the largest key first."""

    @F.pandas_udf("long")
    def find(key: pd.Series, tie: pd.Series) -> pd.Series:
        keys = key.to_numpy(np.int64)
        part = 2 * (len(bounds) - np.searchsorted(bounds, keys.astype(np.float64), "right")) << 32
        for k, n in heavy.items():  # the last key of its range, with parts of its own by tie
            own = keys == k
            part[own] += (1 << 32) + ((tie.to_numpy(np.int64)[own] / 2**64 + 0.5) * n).astype(np.int64)
        return pd.Series(part)

    return find


def _ranges_of(number: dict[int, int], follows: dict[tuple[int, int | None], int], heavy: dict[int, int]):
    """A function of key, tie and part to an array: the row's own range, then the range that it also follows, if any."""

    @F.pandas_udf("array<int>")
    def find(key: pd.Series, tie: pd.Series, part: pd.Series) -> pd.Series:
        after = [follows.get((k, t if k in heavy else None)) for k, t in zip(key.tolist(), tie.tolist())]
        return pd.Series([[number[p]] if a is None else [number[p], a] for p, a in zip(part.tolist(), after)])

    return find


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fingerprint (the encoded state) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(state(t)) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The next document is the one with the next smaller doc_id, after the
    smallest the largest; null ids count as the smallest, and rows of one id
    stand in the order of their texts' hashes.  The texts move once, to ranges
    of doc_id (an id of very many rows has ranges of text hashes); each range
    gets a copy of the row that follows its last.
    """
    spark = docs.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID)))
    bounds, heavy = _ranges(rows, 8 * tasks)
    tie = F.xxhash64("text")
    if heavy:
        rows = rows.withColumn("part", _part_of(bounds, heavy)("key", tie))
    else:  # the texts are not needed to place a row
        rows = rows.withColumn("part", _part_of(bounds, heavy)("key", F.lit(0).cast("long")))
    firsts = rows.groupBy("part").agg(F.max("key").alias("key"), F.min(tie if heavy else F.lit(0)).alias("tie")).orderBy("part").collect()  # some numbers for each range
    number = {r["part"]: i for i, r in enumerate(firsts)}
    follows = {(r["key"], r["tie"] if r["key"] in heavy else None): (i - 1) % len(firsts) for i, r in enumerate(firsts)}
    placed = rows.withColumn("tie", tie).select("doc_id", "text", "key", "tie", F.posexplode(_ranges_of(number, follows, heavy)("key", "tie", "part")).alias("extra", "part"))
    placed = placed.repartition(tasks, "part").sortWithinPartitions("part", "extra", F.col("key").desc(), "tie")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []

        def finish(following: str, following_state: np.ndarray):
            doc_id, own, s = last
            e = edited(own, following)
            es = s if e == own else state(e)
            out.append((doc_id, len(own), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), encode(s), encode(es), likeness(s, es), likeness(s, following_state)))

        for b in batches:
            for doc_id, t, part, extra in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "part", "extra"))):
                if extra and last is None:
                    continue
                s = state(t)
                if last is not None:
                    finish(t, s)
                last = None if extra else (doc_id, t, s)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return placed.select("doc_id", "text", "part", "extra").mapInArrow(run, schema)
