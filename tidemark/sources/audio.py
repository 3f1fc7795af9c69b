"""Audio decoded to mono 16-bit PCM, and banks of PCM clips."""

from __future__ import annotations

import io
import shutil
import subprocess
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 16_000


def resampled(x: np.ndarray, rate: int, to: int = RATE, lobes: int = 16) -> np.ndarray:
    """x at another rate, by a windowed sinc that keeps what is below half of the lower rate."""
    if rate == to or not len(x):
        return x.astype(np.float32)
    n, cut = max(1, round(len(x) * to / rate)), min(1.0, to / rate)
    reach = int(np.ceil(lobes / cut))
    padded = np.pad(x.astype(np.float64), reach + 1)
    out = np.empty(n)
    for a in range(0, n, 8192):
        at = np.arange(a, min(n, a + 8192)) * rate / to
        near = np.floor(at).astype(np.int64)[:, None] + np.arange(-reach, reach + 1)
        d = at[:, None] - near
        kernel = cut * np.sinc(cut * d) * np.where(np.abs(d) < reach, 0.5 + 0.5 * np.cos(np.pi * d / reach), 0)
        out[a:a + len(at)] = (kernel * padded[np.clip(near + reach + 1, 0, len(padded) - 1)]).sum(1)
    return out.astype(np.float32)


def decoded(blob: bytes | None, ffmpeg: str | None = None) -> np.ndarray | None:
    """Mono float samples at 16 kHz of a recording; None if it cannot be decoded, is empty or not finite.

    WAV needs nothing else; other formats need ffmpeg.
    """
    if not blob:
        return None
    try:
        with wave.open(io.BytesIO(blob)) as w:
            width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            raw = w.readframes(w.getnframes())
        kinds = {1: (np.uint8, 128.0), 2: (np.dtype("<i2"), 32768.0), 4: (np.dtype("<i4"), 2147483648.0)}
        if width not in kinds:
            return None
        kind, scale = kinds[width]
        x = np.frombuffer(raw, kind).astype(np.float64)
        x = ((x - 128 if width == 1 else x) / scale).reshape(-1, channels).mean(1)
    except (wave.Error, EOFError, ValueError):
        tool = ffmpeg or shutil.which("ffmpeg")
        if not tool:
            return None
        run = subprocess.run([tool, "-v", "error", "-i", "pipe:0", "-ac", "1", "-ar", str(RATE), "-f", "s16le", "pipe:1"], input=blob, capture_output=True, check=False)
        if run.returncode:
            return None
        x, rate = np.frombuffer(run.stdout, "<i2") / 32768.0, RATE
    x = resampled(x, rate)
    return x if len(x) and np.isfinite(x).all() else None


def to_pcm(x: np.ndarray) -> bytes:
    """16-bit samples; what exceeds 1 is cut."""
    return (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()


def from_pcm(pcm: bytes) -> np.ndarray:
    return np.frombuffer(pcm, "<i2").astype(np.float32) / 32767


def decode(files: DataFrame, key: str = "path", content: str = "content", ffmpeg: str | None = None) -> DataFrame:
    """key, pcm, len of recordings; pcm and len are null where decoding fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xs = [decoded(c, ffmpeg) for c in b[content]]
            yield pd.DataFrame({key: b[key], "pcm": [None if x is None else to_pcm(x) for x in xs], "len": pd.array([None if x is None else len(x) for x in xs], "Int64")})

    kind = dict(files.dtypes)[key]
    return files.select(key, content).mapInPandas(run, f"`{key}` {kind}, pcm binary, len long")


def failures(decoded_: DataFrame) -> DataFrame:
    """rows, undecodable."""
    return decoded_.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("pcm").isNull()).alias("undecodable"))


def crops(bank: DataFrame, plan: DataFrame, key: str = "clip_id") -> DataFrame:
    """plan (key, a, z in samples) with the PCM of each crop; slices are taken in the JVM."""
    rows = plan.join(bank.select(key, "pcm"), key)
    rows = rows.withColumn("len", F.greatest(F.lit(0), F.least("z", (F.octet_length("pcm") / 2).cast("long")) - F.col("a")))
    return rows.withColumn("pcm", F.substr("pcm", (F.col("a") * 2 + 1).cast("int"), (F.col("len") * 2).cast("int")))


def union_stores(*stores: DataFrame) -> DataFrame:
    """All stores' rows with store, their number; columns that a store lacks are null."""
    out = stores[0].withColumn("store", F.lit(0))
    for i, s in enumerate(stores[1:], 1):
        out = out.unionByName(s.withColumn("store", F.lit(i)), allowMissingColumns=True)
    return out
