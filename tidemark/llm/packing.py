"""Order-preserving packing of token streams into windows of a fixed size.

Documents, in the order of doc_id, are one stream of tokens.  A dynamic program
chooses the window cuts: f(j) is the least cost of cutting the stream up to j,
f(j) = min over i in [j - size, j) of f(i) + padding(j - i) + penalty(j).
Padding of a full-range window is size - (j - i), so the minimum of f(i) + i
over the window's range comes from a monotone queue; windows of a power-of-two
length, which are not padded, are extra transitions.  Cuts stand at document
ends (no penalty) and sentence ends (a small one); a longer run without either
and the tail of a block also offer cuts at a high penalty.  Blocks of the stream
bound the program's memory: each block is cut, and what follows its last-but-few
windows goes on to the next block.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, END_ID = 2048, 1
#: Cost of a cut, in tokens of padding: at a document's end, a sentence's end, anywhere else; and of each window.
DOCUMENT, SENTENCE, ANYWHERE, WINDOW_COST = 0.0, 4.0, 48.0, 24.0
#: Tokens of a block of the stream, and the spacing of emergency cuts.
BLOCK_TOKENS, STEP = 1 << 20, 64


@lru_cache(maxsize=2)
def encoder(name: str):
    """(encode, sentence): the ids of a text under a public vocabulary, and for each id whether a sentence can end after it.

    The rank file of the vocabulary gives the same ids as its JSON form and is
    several times faster.  Its pattern has a look-ahead that only matters within
    runs of white space; texts without such runs take the pattern without it.
    Texts that hold an added token of the JSON form are encoded by that.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = public_tokenizers.PATTERN
    exact = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    plain = tiktoken.Encoding(f"{name}-plain", pat_str=pattern.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    runs = re.compile(r"\s\s").search
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", [])]
    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return whole.encode(text, add_special_tokens=False).ids
        return exact(text) if runs(text) else plain(text)

    ends = np.zeros(max(max(ranks.values()) + 2, whole.get_vocab_size()), bool)
    for piece, i in ranks.items():
        ends[i] = piece.rstrip(b"\"')]").endswith((b".", b"!", b"?", b"\n"))
    return encode, ends


def candidates(ids: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray, size: int = SIZE, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) of the possible cuts of a stretch of the stream, its own end among them."""
    n = len(ids)
    penalty = np.full(n + 1, np.inf)
    penalty[np.flatnonzero(ends[ids]) + 1] = SENTENCE
    tail = n - np.array([1 << k for k in range(size.bit_length()) if 1 << k <= n], np.int64)
    penalty[tail] = np.minimum(penalty[tail], ANYWHERE)
    penalty[doc_ends] = DOCUMENT
    penalty[0] = penalty[n] = DOCUMENT
    at = np.flatnonzero(penalty < np.inf)
    gaps = np.flatnonzero(np.diff(at) > size // 4)
    for g in gaps:
        penalty[at[g] + step:at[g + 1]:step] = ANYWHERE
    if len(gaps):
        at = np.flatnonzero(penalty < np.inf)
    return at, penalty[at]


def cuts(at: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices into at of the cheapest cuts, the first and last position included."""
    pos, pen, n = at.tolist(), penalty.tolist(), len(at)
    powers = [1 << k for k in range(size.bit_length())]
    hits: dict[int, list[int]] = {}
    for p in powers:
        k = np.searchsorted(at, at - p)
        ok = np.flatnonzero((at >= p) & (at[np.minimum(k, n - 1)] == at - p))
        for j, i in zip(ok.tolist(), k[ok].tolist()):
            hits.setdefault(j, []).append(i)
    cost, back, queue = [0.0] * n, [0] * n, deque([(0.0, 0)])
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0][1]] < p - size:
            queue.popleft()
        key, i = queue[0]
        best = key + size - p
        for h in hits.get(j, ()):
            if cost[h] < best:
                best, i = cost[h], h
        cost[j], back[j] = best + pen[j] + WINDOW_COST, i
        key = cost[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], n - 1
    while j:
        out.append(j)
        j = back[j]
    return [0, *reversed(out)]


class Packer:
    """Takes documents one by one and gives the finished pieces of the stream."""

    def __init__(self, name: str, base: int, size: int = SIZE, block: int = BLOCK_TOKENS):
        self.encode, self.ends = encoder(name)
        self.size, self.block, self.sequence = size, block, base
        self.docs: list[tuple] = []  # (doc_id, ids, first position not yet packed)
        self.held = 0

    def add(self, doc_id, text: str | None) -> list[tuple]:
        ids = np.array([*(self.encode(text) if text else ()), END_ID], np.uint32)
        self.docs.append((doc_id, ids, 0))
        self.held += len(ids)
        return self.cut(False) if self.held >= self.block else []

    def cut(self, last: bool) -> list[tuple]:
        """Cut what is held; if not the last, the windows near the end stay and are cut again with what follows."""
        if not self.docs:
            return []
        stream = np.concatenate([ids[a:] for _, ids, a in self.docs])
        doc_ends = np.cumsum([len(ids) - a for _, ids, a in self.docs])
        at, penalty = candidates(stream, self.ends, doc_ends, self.size)
        marks = at[cuts(at, penalty, self.size)].tolist()
        if not last:
            marks = marks[:bisect_left(marks, len(stream) - 16 * self.size)] or [0]
        rows, w, d, offset = [], 0, 0, 0
        starts = [0, *doc_ends[:-1].tolist()]
        for w in range(len(marks) - 1):
            at_token, offset = marks[w], 0
            while at_token < marks[w + 1]:
                while doc_ends[d] <= at_token:
                    d += 1
                doc_id, ids, a = self.docs[d]
                s = a + at_token - starts[d]
                n = int(min(marks[w + 1], doc_ends[d]) - at_token)
                rows.append((doc_id, s, n, zlib.crc32(ids[s:s + n].astype("<u4").tobytes()), len(ids), self.sequence, offset))
                offset += n
                at_token += n
            self.sequence += 1
        done = marks[-1] if marks else 0
        self.docs = [(i, ids, max(a, a + done - s)) for (i, ids, a), s, e in zip(self.docs, starts, doc_ends.tolist()) if e > done]
        self.held = len(stream) - done
        return rows


def pack(docs: DataFrame, text: str = "text", name: str = "byte_bpe_50k", size: int = SIZE, block: int = BLOCK_TOKENS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are ordered by doc_id (null first; equal ids by their texts'
    hashes) over range partitions, each with its own sequences: sequence_id is
    the partition's number times 2^40 and a count.  Null and empty texts are the
    end id alone.  Other columns of docs are not read.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(name, TaskContext.get().partitionId() << 40, size, block)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if rows := packer.add(i, t):
                    yield out(rows)
        if rows := packer.cut(True):
            yield out(rows)

    return ordered.mapInArrow(run, schema)
