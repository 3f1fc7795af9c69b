"""Language identification by unigram pieces, summed over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary.  The
probability of a word is the sum, over every way of cutting it into pieces, of
the product of their probabilities; a forward pass over the word's characters
computes it.  A text's log-likelihood is the sum over its words, and the
posterior over languages (with equal priors) is its score.  Piece probabilities
are learned by expectation maximisation over word counts, on a bounded sample
of labelled documents (EXAMPLES per language, whole texts).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About how many documents of each language train it, rounds of learning, and pseudo-counts.
EXAMPLES, ROUNDS, SMOOTHING = 300, 2, 0.1
#: Longest runs of letters that are summed many at once; longer ones are summed whole, one by one.
WORD = 48
#: Probability of a character outside the vocabulary, in every language.
UNKNOWN = 1e-7
#: Base of the polynomial hash of pieces.
BASE = 0x9E3779B97F4A7C15
LETTERS = re.compile(r"[^\W\d_]+")


def pieces_of(vocabulary: str) -> list[str]:
    """The lower-cased letter pieces of a sentencepiece vocabulary, word starts marked by a leading underscore."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    out = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        marked = p.startswith("▁")
        body = p[1:] if marked else p
        if LETTERS.fullmatch(body):
            out["_" * marked + body.lower()] = None
    return list(out)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Scorer:
    """Forward sums of words under all languages at once."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray):
        """probabilities: pieces by languages."""
        hashes = np.array([self.hash(p) for p in pieces], np.uint64)
        self.longest = max(map(len, pieces), default=1)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order + 1
        self.p = np.vstack([np.zeros(probabilities.shape[1]), probabilities])  # 0: no piece
        self.p = np.vstack([self.p, np.full(probabilities.shape[1], UNKNOWN)])  # last: an unknown character
        self.unknown = len(self.p) - 1
        self.known: dict[str, int] = {}  # rows of self.rows
        self.rows = np.empty((0, probabilities.shape[1]))

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * BASE + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def lattice(self, words: list[str]) -> np.ndarray:
        """For words of one marked length n: ids[w, end, k] of the piece of k + 1 characters that ends there.

        Pieces are found by a 64-bit polynomial hash of every substring.
        """
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n).astype(np.uint64)
        ids = np.zeros((len(words), n, min(self.longest, n)), np.int64)
        h = np.zeros((len(words), n), np.uint64)
        for k in range(ids.shape[2] if len(self.hashes) else 0):
            h = h[:, :n - k] * np.uint64(BASE) + codes[:, k:]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ids[:, k:, k] = np.where(self.hashes[at] == h, self.ids[at], 0)
        single = ids[:, :, 0]
        single[single == 0] = self.unknown
        return ids

    def forward(self, ids: np.ndarray) -> np.ndarray:
        """alpha[w, position, language], each position divided by 10 ** -2 a character to stay in range."""
        n, depth = ids.shape[1:]
        alpha = np.zeros((len(ids), n + 1, self.p.shape[1]))
        alpha[:, 0] = 1
        for end in range(n):
            for k in range(min(depth, end + 1)):
                used = ids[:, end, k]
                if used.any():
                    alpha[:, end + 1] += alpha[:, end - k] * self.p[used] * 100.0 ** (k + 1)
        return alpha

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log-probabilities, words by languages, of marked words."""
        out = np.empty((len(words), self.p.shape[1]))
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, at in by.items():
            if n > WORD:
                for i in at:
                    out[i] = self.log_long(words[i])
                continue
            for a in range(0, len(at), 4096):
                part = at[a:a + 4096]
                out[part] = np.log(self.forward(self.lattice([words[i] for i in part]))[:, -1]) - n * np.log(100.0)
        return out

    def log_long(self, word: str, stretch: int = 4096) -> np.ndarray:
        """Log-probabilities by languages of one marked word of any length, which is not cut.

        The last sums are kept, scaled at every character; pieces are looked up
        a stretch at a time, with as many characters before it as a piece can have.
        """
        depth, n_langs = self.longest, self.p.shape[1]
        last, scale = np.zeros((depth, n_langs)), np.zeros(n_langs)  # last[k]: of the prefix that ends k + 1 characters before the next end
        last[0] = 1
        for a in range(0, len(word), stretch):
            before = max(0, a - depth + 1)
            ids = self.lattice([word[before:a + stretch]])[0]
            for end in range(a - before, len(ids)):
                used = ids[end]  # pieces that would start before the word's first character find a sum of 0
                total = np.einsum("kl,kl->l", last[:len(used)], self.p[used])
                scale += np.log(total)
                last[1:] = last[:-1] / total
                last[0] = 1
        return scale

    def log_texts(self, counts: list[Counter]) -> np.ndarray:
        """Log-likelihoods, texts by languages; what is known of words is kept for the texts that follow."""
        known = self.known
        new = list({w for c in counts for w in c} - known.keys())
        if len(known) + len(new) > 400_000:
            known.clear()
            self.rows = self.rows[:0]
            new = list({w for c in counts for w in c})
        parts = [self.rows]
        for a in range(0, len(new), 50_000):
            parts.append(self.log_words(new[a:a + 50_000]))
        known.update(zip(new, range(len(known), len(known) + len(new))))
        self.rows = np.concatenate(parts) if new else self.rows
        out = np.zeros((len(counts), self.p.shape[1]))
        for i, c in enumerate(counts):
            if c:
                rows = np.fromiter(map(known.__getitem__, c), np.int64, len(c))
                out[i] = np.fromiter(c.values(), np.float64, len(c)) @ self.rows[rows]
        return out


def words_of_text(text: str) -> Counter:
    """Counts of the text's lower-cased letter runs, each marked at its start.

    Runs of other numerals (superscripts, Roman numerals) hold no letter and do not count.
    """
    out = Counter()
    for w, n in Counter(LETTERS.findall(text.lower())).items():
        if not w.isalpha() and not any(map(str.isalpha, w)):
            continue
        out["_" + w] += n
    return out


def _cut(words: dict[str, int]) -> dict[str, int]:
    out = {w: n for w, n in words.items() if len(w) <= WORD}
    for w, n in words.items():
        for a in range(0, len(w) if len(w) > WORD else 0, WORD):
            part = w[a:a + WORD]
            out[part] = out.get(part, 0) + n
    return out


def learn(pieces: list[str], counts: dict[str, dict[str, int]], rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Piece probabilities, pieces by languages (in counts' order), by expectation maximisation over all segmentations.

    Words of more than WORD characters teach as several, cut there.
    """
    counts = {lang: _cut(words) for lang, words in counts.items()}
    scorer = Scorer(pieces, np.full((len(pieces), 1), 1.0 / len(pieces)))
    start = np.array([10.0 ** -len(p.lstrip("_")) for p in pieces])
    columns = []
    for words in counts.values():
        p = start / start.sum()
        lattices = []
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for n in sorted(by):
            for a in range(0, len(by[n]), 4096):
                part = by[n][a:a + 4096]
                lattices.append((scorer.lattice(part), np.array([words[w] for w in part], float)))
        for _ in range(rounds):
            scorer.p = np.concatenate([[0.0], p, [UNKNOWN]])[:, None]
            expected = np.zeros(len(scorer.p))
            for ids, weight in lattices:
                n, depth = ids.shape[1:]
                alpha = scorer.forward(ids)[:, :, 0]
                beta = np.zeros_like(alpha)
                beta[:, n] = 1
                for end in range(n - 1, -1, -1):
                    for k in range(min(depth, end + 1)):
                        beta[:, end - k] += beta[:, end + 1] * scorer.p[ids[:, end, k], 0] * 100.0 ** (k + 1)
                total = alpha[:, n]
                for end in range(n):
                    for k in range(min(depth, end + 1)):
                        used = ids[:, end, k]
                        mass = weight * alpha[:, end - k] * scorer.p[used, 0] * 100.0 ** (k + 1) * beta[:, end + 1] / total
                        np.add.at(expected, used, mass)
            p = (expected[1:-1] + smoothing) / (expected[1:-1] + smoothing).sum()
        columns.append(p)
    return np.array(columns).T if columns else np.zeros((len(pieces), 0))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def training_counts(docs: DataFrame, text: str = "text", examples: int = EXAMPLES) -> dict[str, dict[str, int]]:
    """Word counts by language over about examples labelled training documents of each language, chosen by hash.

    Reads lang and doc_id of all documents and the chosen documents' whole texts;
    brings the word counts of these texts to the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("_h", F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)))
    counted = rows.groupBy("lang").count()
    sizes = counted.collect()
    if not sizes:
        return {}
    limits = counted.select("lang", (F.least(F.lit(1.0), F.lit(examples) / F.col("count")) * (1 << 30)).cast("long").alias("_limit"))
    chosen = rows.join(F.broadcast(limits), "lang").where(F.col("_h") < F.col("_limit")).select("lang", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))  # a row a language

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            by: dict[str, Counter] = {}
            for lang, t in zip(b["lang"], b["text"]):
                by.setdefault(lang, Counter()).update(words_of_text(t))
            flat = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            yield pd.DataFrame(flat, columns=["lang", "word", "n"])

    words = chosen.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = {r["lang"]: {} for r in sorted(sizes, key=lambda r: r["lang"])}
    found = words.toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    for lang, word, n in zip(*(found[c].to_pylist() for c in ("lang", "word", "n"))):
        out[lang][word] = n
    return out


def identify(docs: DataFrame, text: str = "text", vocabulary: str | None = None, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    Texts that are null or have no letter are ``und`` with score 0, as is
    everything if no labelled training document exists.  Ties go to the language
    that sorts first.  lang is read for training alone.
    """
    counts = training_counts(docs, text, examples)
    pieces = pieces_of(vocabulary or default_vocabulary()) if counts else []
    probabilities = learn(pieces, counts).astype(np.float32) if counts else np.zeros((0, 0), np.float32)
    langs = list(counts)
    model = docs.sparkSession.sparkContext.broadcast((pieces, probabilities))  # pieces by languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value[0], model.value[1].astype(np.float64)) if langs else None
        for b in batches:
            texts = b.column(2).to_pylist()
            preds, scores = [], []
            for a in range(0, len(texts), 1024):
                words = [words_of_text(t) if t else Counter() for t in texts[a:a + 1024]]
                logs = scorer.log_texts(words) if scorer else None
                for i, c in enumerate(words):
                    if not c or logs is None:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    e = np.exp(logs[i] - logs[i].max())
                    k = int(e.argmax())
                    preds.append(langs[k])
                    scores.append(float(e[k] / e.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
