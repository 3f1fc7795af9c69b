"""Secrets in text: fixed forms, and random strings that a tokenizer compresses badly.

A byte-pair vocabulary merges what is frequent, so words and identifiers have
many characters per token and keys, passwords and other random strings few.
Runs of key characters are measured in that way, with digits or without; known
digests and identifiers (plain hexadecimal of digest length, UUIDs, numbers) are
excluded first, and of runs made of word parts only the letters are measured, so
that separators and version numbers do not count against words.  Texts are scanned a batch at a time in Python: the vocabulary exists
only there.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import free_names

#: Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_=.-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
#: Lower-case parts of which every assignment has one.
HINTS = ("passw", "secret", "token", "apikey", "api_key")
#: What may be a random string, and the forms that are none.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
#: A part of a run made of word parts, and the letters of such a run that are long enough to tell.
PART = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]{1,8}|[a-z]+[0-9]{1,4}")
LETTERS = re.compile(r"[A-Za-z]{4,}")
#: Characters per token below which a candidate counts as random, and how much of the candidate is read: all of it.
RATIO = 2.0


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tiktoken encoding of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def identifier(s: str) -> bool:
    """True for known digests and identifiers: digests in hexadecimal, UUIDs and numbers."""
    if UUID.fullmatch(s) or re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) and len(s) in DIGEST_LENGTHS:
        return True
    return not re.search("[A-Za-z]", s)


def measured(s: str) -> list[str]:
    """What is measured of a candidate: its letters if it has no digit or its parts look like words, else all of it."""
    if not re.search("[0-9]", s) or all(map(PART.fullmatch, re.split(r"[+/_=-]+|(?<=[a-z])(?=[A-Z])", s))):
        return LETTERS.findall(s)
    return [s]


def random_string(s: str, vocabulary: str, ratio: float = RATIO) -> bool:
    """The token-efficiency test of one candidate."""
    if identifier(s):
        return False
    parts, encode = measured(s), encoding(vocabulary).encode_ordinary
    return sum(map(len, parts)) < ratio * sum(len(encode(p)) for p in parts)


def scan(text: str, vocabulary: str, ratio: float = RATIO) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text as (start, kind's rank, end), sorted.  A random string is added unless a base span overlaps it."""
    base = []
    low = text.lower()
    if any(h in low for h in HINTS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if max(map(len, text.split()), default=0) < 20:
        return base, base if len(base) < 2 else sorted(base)
    runs = list(CANDIDATE.finditer(text))
    for r in runs:
        base += [(r.start() + m.start(), 2, r.start() + m.end()) for m in HEX.finditer(r[0]) if m.end() - m.start() >= 24]
    base.sort()
    more, k, reach = [], 0, 0
    for r in runs:
        while k < len(base) and base[k][0] < r.end():  # reach: the furthest end of the base spans that start before the run ends
            reach = max(reach, base[k][2])
            k += 1
        if reach > r.start():
            continue
        if random_string(r[0], vocabulary, ratio):
            more.append((r.start(), 3, r.end()))
    return base, sorted(base + more) if more else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """text with every span, overlapping ones as one, replaced by mark."""
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


#: What find_secrets adds.
FOUND = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans")


def find_secrets(docs: DataFrame, text: str = "text", vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """docs without its text, with n_assign, n_access, n_hex, base_sha256, spans and n_spans.

    Null texts are empty and have no spans.  Positions are code points, ends
    exclusive.  Columns of docs with these names are replaced; others stay.
    """
    path = vocabulary or default_vocabulary()
    carried = [c for c in docs.columns if c.lower() not in FOUND and c != text]
    frame = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row") if carried else F.struct(F.lit(0).alias("none")).alias("row"))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                base, spans = scan(t, path, ratio) if t else ([], [])
                n = [0, 0, 0]
                for x in base:
                    n[x[1]] += 1
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest() if base else nothing, joined(spans), len(spans)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["row", *FOUND])

    schema = StructType([frame.schema["row"], *(StructField(c, StringType() if c in ("base_sha256", "spans") else LongType()) for c in FOUND)])
    found = frame.mapInArrow(run, schema)
    return found.select("row.*", *FOUND) if carried else found.select(*FOUND)


def redact_secrets(docs: DataFrame, text: str = "text", vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """docs with every secret in text replaced by a mark; n_chars, if docs has it, follows the new text where there is one.

    Null texts stay null.  Other columns, whatever their names, stay as they are.
    """
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("string")
    def marked(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, spans) if t and (spans := scan(t, path, ratio)[1]) else t for t in texts], dtype=object)

    [new] = free_names(docs.columns, "marked")
    out = docs.withColumn(new, marked(F.col(f"`{text}`").cast("string")))
    changed = {text: F.col(new)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
