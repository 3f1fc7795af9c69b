"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and word beginnings.  A bounded sample of labelled documents
(EXAMPLES), drawn by label so that a rare one is not lost, becomes the index
with all its terms; document frequencies come from all documents.  TF-IDF
weights are multiplied by a term's association with the label (the phi
coefficient in the sample, plus FLOOR), so telling terms lead and no term is
left out.  The index is an inverted one whose examples are ordered by likeness
and cut into blocks, each with its largest weight of every term: a query's sum
over these maxima bounds its cosines in a block, so the blocks of the largest
bounds are summed first and those that cannot reach the k-th largest cosine
found are left out; the nearest are exact.  Neighbours vote with their cosines as weights;
a logistic curve, fitted on sampled documents outside the index and weighted by
the labels' shares among all training labels, turns votes and the weight of the
text's terms into probabilities.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: At most so many labelled documents; what every term's association is raised by.
EXAMPLES, FLOOR = 4_000, 0.01
#: Parts that document frequencies are summed in.
PARTS = 64
#: Terms in more than one of so many examples are summed by matrix products, texts judged at once.
COMMON, TOGETHER = 32, 256
#: Neighbours that vote, examples in a block, blocks of the largest bounds that are summed first, length of word beginnings.
NEAREST, BLOCK, FIRST, STEM = 15, 64, 2, 4
#: Weight of the sample's share of toxic documents in a vote.
PRIOR_WEIGHT = 0.2
LETTERS = re.compile(r"[^\W\d_]+")


#: Turns what is no ASCII letter into spaces.
_SPACED = bytes(i if chr(i).isalpha() and i < 128 else 32 for i in range(256))


def _words(text: str) -> list[str]:
    """The text's lower-cased runs of letters."""
    text = text.lower()
    return text.encode().translate(_SPACED).decode().split() if text.isascii() else LETTERS.findall(text)


class _Numbered(dict):
    """Numbers keys in the order in which they are first asked for; new lists those not yet dealt with."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        i = self[key] = len(self)
        return i


def _terms_of_word(w: str) -> tuple[str, ...]:
    return (w, "^" + w[:STEM]) if len(w) >= STEM else (w,)


def terms_of(text: str) -> Counter:
    """Counts of lower-cased words and of the beginnings (marked ``^``) of those that are long enough."""
    out = Counter()
    for w, n in Counter(_words(text)).items():
        for t in _terms_of_word(w):
            out[t] += n
    return out


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], ..., starts[i] + lengths[i] - 1 for every i, end to end."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def _alike(matrix: np.ndarray, block: int) -> np.ndarray:
    """An order of the rows in which each block holds similar ones: halves by the leading direction, cut at a block's edge, and so on."""
    rng = np.random.default_rng(7)

    def split(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= block:
            return [rows]
        x = matrix[rows] - matrix[rows].mean(0)
        v = rng.standard_normal(x.shape[1])
        for _ in range(8):
            v = x.T @ (x @ v)
            v /= np.sqrt(v @ v) or 1.0
        rows = rows[np.argsort(x @ v, kind="stable")]
        half = max(1, len(rows) // block // 2) * block
        return split(rows[:half]) + split(rows[half:])

    return np.concatenate(split(np.arange(len(matrix)))) if len(matrix) else np.zeros(0, np.int64)


class Index:
    """Examples as unit vectors in a block-max inverted index; terms in more than a COMMON-th of them are rows of a matrix."""

    def __init__(self, at: np.ndarray, terms: np.ndarray, weights: np.ndarray, marks: list, n_terms: int, block: int = BLOCK):
        """Example i has terms[at[i]:at[i + 1]] and their weights, of length 1; marks: what identifies each, (doc_id, label)."""
        self.given = (np.asarray(at, np.int64), np.asarray(terms).astype(np.int32), np.asarray(weights).astype(np.float32), list(marks), n_terms, block)
        self.order = _alike(self._common()[0].T, block)
        self._build()

    def _common(self) -> tuple[np.ndarray, np.ndarray]:
        """(the common terms' matrix, terms by examples, and each term's row in it or -1)."""
        at, terms, weights, marks, n_terms, _ = self.given
        common = np.flatnonzero(np.bincount(terms, minlength=n_terms) * COMMON > len(marks))
        row = np.full(n_terms, -1)
        row[common] = np.arange(len(common))
        own = row[terms]
        matrix = np.zeros((len(common), len(marks)))
        matrix[own[own >= 0], np.repeat(np.arange(len(marks)), np.diff(at))[own >= 0]] = weights[own >= 0]
        return matrix, row

    def _build(self):
        at, terms, weights, self.marks, n_terms, self.block = self.given
        n, self.n_blocks = len(self.marks), -(-len(self.marks) // self.block)
        matrix, self.row = self._common()
        padded = np.zeros((len(matrix), self.n_blocks * self.block))
        padded[:, :n] = matrix[:, self.order]
        self.rows = np.ascontiguousarray(padded.reshape(len(matrix), self.n_blocks, self.block).transpose(1, 0, 2), np.float32)  # block, term, example
        self.row_max = self.rows.max(2, initial=0.0).T  # term, block
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        ids = place[np.repeat(np.arange(n), np.diff(at))]
        rare = self.row[terms] < 0
        order = np.lexsort((ids[rare], terms[rare]))
        terms, self.ids, self.weights = terms[rare][order].astype(np.int64), ids[rare][order], weights[rare][order].astype(float)
        # an entry a term and block: its block, its largest weight and its postings
        group = terms * max(1, self.n_blocks) + self.ids // self.block
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        self.entry_block, self.entry_start = self.ids[first] // self.block, first
        self.entry_length = np.diff(np.append(first, len(group)))
        self.entry_max = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.entries = np.concatenate([[0], np.cumsum(np.bincount(terms[first], minlength=n_terms))])

    def __getstate__(self):
        return self.given, self.order

    def __setstate__(self, state):
        self.given, self.order = state
        self._build()

    def nearest(self, at: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """For each query the k examples of largest positive cosine, (cosine, position), largest first; ties go to the smaller position.

        Query i has terms[at[i]:at[i + 1]] and their weights.
        """
        n, blocks, width = len(at) - 1, self.n_blocks, self.n_blocks * self.block
        if not blocks:
            return [[] for _ in range(n)]
        query, row = np.repeat(np.arange(n), np.diff(at)), self.row[terms]
        common = np.zeros((n, len(self.row_max)), np.float32)
        common[query[row >= 0], row[row >= 0]] = weights[row >= 0]
        query, terms, weights = query[row < 0], terms[row < 0], weights[row < 0]
        lengths = self.entries[terms + 1] - self.entries[terms]
        entry, query, weights = _runs(self.entries[terms], lengths), np.repeat(query, lengths), np.repeat(weights, lengths)
        block = self.entry_block[entry]
        bound = common @ self.row_max + np.bincount(query * blocks + block, weights * self.entry_max[entry], n * blocks).reshape(n, blocks)
        sums = np.zeros((n, width))

        def add(wanted: np.ndarray):
            for b in np.flatnonzero(wanted.any(0)).tolist():
                some = np.flatnonzero(wanted[:, b])
                sums[some, b * self.block:(b + 1) * self.block] += common[some] @ self.rows[b]
            own = wanted[query, block]
            times = self.entry_length[entry[own]]
            posting = _runs(self.entry_start[entry[own]], times)
            flat = np.repeat(query[own] * width, times) + self.ids[posting]
            sums.reshape(-1)[:] += np.bincount(flat, np.repeat(weights[own], times) * self.weights[posting], n * width)

        leading, first = np.zeros((n, blocks), bool), np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
        np.put_along_axis(leading, first, True, 1)
        add(leading)
        found = sums.reshape(n, blocks, self.block)[np.arange(n)[:, None], first].reshape(n, -1)
        least = np.partition(found, -k, axis=1)[:, -k] if k <= found.shape[1] else np.zeros(n)  # the k-th largest is no less
        add((bound > 0) & (bound * (1 + 1e-5) >= least[:, None]) & ~leading)
        out = []
        for i in range(n):
            found = np.flatnonzero((sums[i] >= least[i]) & (sums[i] > 0))
            position = self.order[found]
            best = np.lexsort((position, -sums[i, found]))[:k]
            out.append(list(zip(sums[i, found[best]].tolist(), position[best].tolist())))
        return out


class Voter:
    """Scores term vectors by their nearest examples."""

    def __init__(self, index: Index | None, weights: np.ndarray, prior: float, none: float, curve: tuple[float, float, float]):
        self.index, self.weights, self.prior, self.none, self.curve = index, weights, prior, none, curve

    def vectors(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights of unit vectors, the vectors' lengths before)."""
        w = (1 + np.log(counts)) * self.weights[ids]
        query = np.repeat(np.arange(len(at) - 1), np.diff(at))
        norms = np.sqrt(np.bincount(query, w * w, len(at) - 1))
        return w / norms[query], norms

    def votes(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> list[tuple[tuple[float, float] | None, list[tuple[float, int]]]]:
        """Of each text: ((the neighbours' vote, log of the query's weight) or None without neighbours, the neighbours)."""
        weights, norms = self.vectors(at, ids, counts)
        out = []
        for norm, near in zip(norms.tolist(), self.index.nearest(at, ids, weights, NEAREST)):
            weight = sum(s for s, _ in near)
            vote = (sum(s * self.index.marks[i][1] for s, i in near) + PRIOR_WEIGHT * self.prior) / (weight + PRIOR_WEIGHT)
            out.append(((vote, math.log1p(norm)) if near else None, near))
        return out

    def scored(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> list[tuple[float, str]]:
        out = []
        for v, near in self.votes(at, ids, counts):
            z = self.curve[0] * v[0] + self.curve[1] * v[1] + self.curve[2] if v else 0.0
            evidence = ",".join(f"{self.index.marks[i][0]}:{self.index.marks[i][1]}:{s:.3f}" for s, i in near[:3])
            out.append((1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) if v else self.none, evidence))
        return out


#: The curve where there is nothing to fit, and what a fit is drawn to.
CURVE = (8.0, 0.5, -6.0)


def fit_curve(votes: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> tuple[float, float, float]:
    """The logistic curve's weights of vote, log weight and 1, by Newton steps on the lightly penalised likelihood; rising with the vote.  shares: how much each row counts."""
    x = np.column_stack([votes.reshape(-1, 2), np.ones(len(votes))])
    start = np.array(CURVE)
    w = start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (shares * (p - labels)) + 0.05 * (w - start)
        w = w - np.linalg.solve((x * (shares * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), gradient)
    return tuple(map(float, w)) if np.isfinite(w).all() and w[0] > 0 else CURVE


def sample(docs: DataFrame, labels: DataFrame, text: str, examples: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, toxic and text of at most examples labelled training documents, {0 or 1: how many labels a sampled one stands for}).

    Half of them are toxic and half clean, or all of the rarer label and the rest of the other; of each the smallest by hash.
    Of rows that repeat a doc_id one stays.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {0: 0, 1: 0, **{r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}}
    taken = {y: min(n, max(examples - examples // 2 if y else examples // 2, examples - sizes[1 - y])) for y, n in sizes.items()}
    smallest = [rows.where(F.col("toxic") == y).withColumn("_h", F.xxhash64("doc_id", F.lit("toxicity"))).orderBy("_h", "doc_id").limit(n).drop("_h") for y, n in taken.items()]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    drawn = texts.join(F.broadcast(smallest[0].unionByName(smallest[1])), "doc_id")  # at most examples rows of two numbers
    once = drawn.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return once, {y: sizes[y] / n if n else 1.0 for y, n in taken.items()}


def sample_terms(sampled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(all terms of the sample's documents, their association with the label: the phi coefficient, and FLOOR)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by[y].update(terms_of(t).keys())
        terms = list(by[0].keys() | by[1].keys())
        for a in range(0, len(terms), 10_000):
            part = terms[a:a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[w] for w in part], pa.int64()) for c in by)], ["term", "clean", "toxic"])

    sizes = sampled.agg(F.count_if(F.col("toxic") <= 0).alias("c"), F.count_if(F.col("toxic") > 0).alias("t")).first()
    c, t = float(sizes["c"]), float(sizes["t"])
    counts = sampled.select("text", "toxic").mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("x"), F.sum("toxic").alias("y")).toArrow().sort_by("term")
    x, y = counts["x"].to_numpy().astype(float), counts["y"].to_numpy().astype(float)
    phi = np.abs(y * (c - x) - x * (t - y)) / np.sqrt(np.maximum((x + y) * (c + t - x - y), 1.0) * c * t) if c and t else np.zeros(len(x))
    return counts["term"].to_pylist(), phi + FLOOR


def score(docs: DataFrame, labels: DataFrame, text: str = "text", examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every row.

    evidence lists the three nearest examples as doc_id:label:cosine.  A text
    with no term of the sample (an empty one, say) has no neighbour and gets the
    share of toxic ones among such texts.  Without labelled training documents
    every score is 0.1.
    """
    spark = docs.sparkSession
    drawn, stands_for = sample(docs, labels, text, examples)
    sampled = materialize(drawn, "toxicity-sample")
    terms, association = sample_terms(sampled)
    numbers = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})  # bounded by examples
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col(text).cast("string").alias("text"))
    n_docs = rows.count()
    frequencies = np.zeros(len(terms))
    for r in _document_frequencies(rows, numbers, len(terms)).collect():
        n = np.frombuffer(r["n"], "<i8")
        frequencies[r["part"] * _width(len(terms)):][:len(n)] = n
    weights = association * (np.log((n_docs + 1) / (frequencies + 1)) + 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(numbers.value)
        for b in batches:
            at, ids, counts = finder.find(b.column(2).to_pylist())
            cut = [(ids[i:j].astype("<i4").tobytes(), counts[i:j].astype("<i4").tobytes()) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([x[k] for x in cut], pa.binary()) for k in range(2))], ["doc_id", "toxic", "ids", "counts"])

    learnt = sampled.select("doc_id", "toxic", "text").mapInArrow(find, "doc_id long, toxic int, ids binary, counts binary").orderBy("doc_id").collect()
    model = spark.sparkContext.broadcast(fit(learnt, weights, stands_for))  # bounded by examples

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, finder = model.value, Finder(numbers.value)
        for b in batches:
            out = []
            for a in range(0, b.num_rows, TOGETHER):
                out += own.scored(*finder.find(b.column(2).slice(a, TOGETHER).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s for s, _ in out], pa.float64()), pa.array([int(s >= 0.5) for s, _ in out], pa.int32()), pa.array([e for _, e in out], pa.string())], ["doc_id", "held_out", "score", "predicted", "evidence"])

    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int, evidence string")


class Finder:
    """Finds the numbered terms of texts; what it knows of words is kept for the texts that follow."""

    def __init__(self, number: dict[str, int]):
        self.number = number
        self._forget()

    def _forget(self):
        self.known = _Numbered()  # word: its row in starts and lengths
        self.starts, self.lengths, self.terms = (np.zeros(0, np.int64) for _ in range(3))

    def _learn(self):
        found = [[i for t in _terms_of_word(w) if (i := self.number.get(t)) is not None] for w in self.known.new]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, len(self.terms) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.terms = np.concatenate([self.terms, np.fromiter(chain.from_iterable(found), np.int64, lengths.sum())])
        self.known.new = []

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, ids, counts): text i has the terms ids[at[i]:at[i + 1]], rising, and their counts."""
        bags = [Counter(_words(t)) if t and self.number else {} for t in texts]
        if len(self.known) > 300_000:
            self._forget()
        sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        rows = np.fromiter(map(self.known.__getitem__, chain.from_iterable(bags)), np.int64, sizes.sum())
        if self.known.new:
            self._learn()
        times = np.fromiter(chain.from_iterable(b.values() for b in bags), np.int64, sizes.sum())
        n, width = self.lengths[rows], max(1, len(self.number))
        flat = np.repeat(np.repeat(np.arange(len(bags)), sizes), n) * width + self.terms[_runs(self.starts[rows], n)]
        order = np.argsort(flat, kind="stable")
        flat, times = flat[order], np.repeat(times, n)[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        counts = np.add.reduceat(times, first) if len(first) else np.zeros(0, np.int64)
        return np.searchsorted(flat[first], np.arange(len(bags) + 1) * width), flat[first] % width, counts


def _width(n_terms: int) -> int:
    return max(1, -(-n_terms // PARTS))


def _document_frequencies(rows: DataFrame, numbers, n_terms: int) -> DataFrame:
    """(part, n): in how many documents each term stands, as PARTS arrays of numbers; counted within each task first, so a task sends PARTS rows at most."""
    width = _width(n_terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, finder = np.zeros(n_terms, "<i8"), Finder(numbers.value)
        for b in batches:
            for a in range(0, b.num_rows, TOGETHER):
                n += np.bincount(finder.find(b.column(0).slice(a, TOGETHER).to_pylist())[1], minlength=n_terms)
        parts = [k for k in range(PARTS) if n[k * width:(k + 1) * width].any()]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([n[k * width:(k + 1) * width].tobytes() for k in parts], pa.binary())], ["part", "n"])

    def add(group: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x, "<i8") for x in group["n"].to_pylist())
        return pa.table({"part": group["part"].slice(0, 1).cast(pa.int32()), "n": pa.array([n.astype("<i8").tobytes()], pa.binary())})

    return rows.select("text").mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary")


def fit(rows: list, weights: np.ndarray, stands_for: dict[int, float]) -> Voter:
    """A voter from sampled rows (doc_id, toxic, ids, counts): every fifth of a label with terms calibrates, the others are the index."""
    rows = [(r[0], int(r[1] > 0), np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], "<i4")) for r in rows]

    def share(some: list) -> float:
        return (sum(stands_for[1] for r in some if r[1]) + 0.1) / (sum(stands_for[r[1]] for r in some) + 1)

    none = share([r for r in rows if not len(r[2])])
    kept, tried = [], []
    for y in (0, 1):
        having = [r for r in rows if len(r[2]) and r[1] == y]
        kept += [r for k, r in enumerate(having) if k % 5]
        tried += having[::5]
    if len(kept) < 50:
        kept, tried = kept + tried, []

    def together(some: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [np.concatenate([r[k] for r in some]).astype(np.int64) if some else np.zeros(0, np.int64) for k in (2, 3)]
        return np.concatenate([[0], np.cumsum([len(r[2]) for r in some])]).astype(np.int64), *parts

    blank = Voter(None, weights, share(rows), none, CURVE)
    at, ids, counts = together(kept)
    blank.index = Index(at, ids, blank.vectors(at, ids, counts)[0], [r[:2] for r in kept], len(weights))
    votes = []
    for a in range(0, len(tried), TOGETHER):
        some = tried[a:a + TOGETHER]
        votes += [(v, r[1], stands_for[r[1]]) for r, (v, _) in zip(some, blank.votes(*together(some))) if v is not None]
    if not votes:
        return blank
    shares = np.array([n for _, _, n in votes])
    return Voter(blank.index, weights, blank.prior, none, fit_curve(np.array([v for v, _, _ in votes]), np.array([y for _, y, _ in votes], float), shares * len(shares) / shares.sum()))
