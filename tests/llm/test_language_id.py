"""Language identification against enumerated segmentations and held-out documents."""

import math
import zlib

import numpy as np

from tests.llm.cases import TEXTS, documents, empty
from tidemark.llm import language_id as li
from tidemark.llm.common import read


def segmentations(word, p):
    if not word:
        return 1.0
    return sum(p.get(word[:k], li.UNKNOWN if k == 1 else 0.0) * segmentations(word[k:], p) for k in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    pieces = ["_", "_a", "a", "b", "ab", "_ab", "ba", "aba", "é"]
    rng = np.random.default_rng(0)
    probabilities = rng.dirichlet(np.ones(len(pieces)), 2).T
    scorer = li.Scorer(pieces, probabilities)
    words = ["_a", "_abab", "_é", "_zab", "_abaabba"]
    got = scorer.log_words(words)
    for w, row in zip(words, got):
        for k in range(2):
            assert np.isclose(np.exp(row[k]), segmentations(w, dict(zip(pieces, probabilities[:, k]))), rtol=1e-9)


def test_long_words_are_summed_whole():
    rng = np.random.default_rng(1)
    pieces = ["_", "_a", "a", "b", "ab", "_ab", "ba", "aba", "abbaabbaabba"]
    probabilities = rng.dirichlet(np.ones(len(pieces)), 3).T
    scorer = li.Scorer(pieces, probabilities)
    for n in (3, 20, 46, 47, 48, 60, 100):
        word = "_" + "".join(rng.choice(list("abz"), n, p=[0.5, 0.4, 0.1]))
        alpha = np.zeros((n + 2, 3))
        alpha[0] = 1
        for end in range(1, n + 2):
            for k in range(1, min(12, end) + 1):
                piece = word[end - k:end]
                alpha[end] += alpha[end - k] * (probabilities[pieces.index(piece)] if piece in pieces else li.UNKNOWN if k == 1 else 0.0)
        for stretch in (1, 7, 4096):
            assert np.allclose(scorer.log_long(word, stretch), np.log(alpha[-1]), rtol=1e-9)
        assert np.allclose(scorer.log_words([word])[0], np.log(alpha[-1]), rtol=1e-9)
    assert np.isfinite(scorer.log_long("_" + "ab" * 20_000)).all()


def test_the_longest_pieces_of_the_vocabulary_count():
    pieces = li.pieces_of(li.default_vocabulary())
    longest = max(pieces, key=len)
    assert len(longest) > 12 and li.Scorer(pieces, np.full((len(pieces), 1), 1 / len(pieces))).lattice([longest])[0, -1, len(longest) - 1] == pieces.index(longest) + 1


def test_query_against_plain_python(spark, sf):
    """From text to score: words, posterior and prediction of every document, one word at a time over dicts."""
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    rows = docs.collect()
    counts = li.training_counts(docs)
    plain = {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            for w in "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split():
                plain.setdefault(r.lang, {}).setdefault("_" + w, 0)
                plain[r.lang]["_" + w] += 1
    assert counts == plain  # fewer documents than the sample's bound: all are learned
    pieces = li.pieces_of(li.default_vocabulary())
    p = li.learn(pieces, counts).astype(np.float32).astype(float)
    model = [dict(zip(pieces, p[:, k])) for k in range(len(counts))]
    cache = {}

    def log_word(w, k):
        if (w, k) not in cache:
            alpha = [1.0] + [0.0] * len(w)
            for end in range(1, len(w) + 1):
                for n in range(1, min(20, end) + 1):
                    alpha[end] += alpha[end - n] * model[k].get(w[end - n:end], li.UNKNOWN if n == 1 else 0.0)
            cache[w, k] = math.log(alpha[-1])
        return cache[w, k]

    got = {r.doc_id: r for r in li.identify(docs).collect()}
    for r in rows[::4]:
        words = ["_" + w for w in "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()]
        logs = np.array([sum(log_word(w, k) for w in words) for k in range(len(counts))])
        e = np.exp(logs - logs.max())
        assert got[r.doc_id].lang_pred == (list(counts)[int(e.argmax())] if words else "und") and abs(got[r.doc_id].score - (e.max() / e.sum() if words else 0)) < 1e-4


def test_learning_raises_the_likelihood():
    pieces = li.pieces_of(li.default_vocabulary())
    words = {"_haus": 5, "_baum": 3, "_hausbaum": 2}
    weights = np.array(list(words.values()), float)
    fits = [weights @ li.Scorer(pieces, li.learn(pieces, {"de": words}, rounds, 1e-6)).log_words(list(words))[:, 0] for rounds in (1, 2, 4)]
    assert fits == sorted(fits)


def test_held_out_accuracy(spark, sf):
    docs = read(spark, sf.replace("0.001", "0.01"), "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = li.identify(docs).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_only_letters_make_words():
    assert li.words_of_text("² Ⅷ 12 _ ! ½") == {} and li.words_of_text("x² É") == {"_x²": 1, "_é": 1}


def test_cases(spark):
    got = {r.doc_id: r for r in li.identify(documents(spark)).collect()}
    assert len(got) == len(TEXTS) + 2
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in range(4)) and got[4].lang_pred in ("en", "de", "fr")
    assert li.identify(empty(spark)).count() == 0
    unlabelled = documents(spark).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in li.identify(unlabelled).collect()} == {"und"}


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(k * 40 + i, "some words", f"l{k:02}") for k in range(70) for i in range(40)], "doc_id long, text string, lang string")
    assert sorted(li.training_counts(docs)) == [f"l{k:02}" for k in range(70)]


def test_no_language_loses_its_words_to_another(spark):
    letters = "abcdefghij"
    many = " ".join("".join(letters[int(d)] for d in f"{i:06}") for i in range(90_000))
    a, z = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    docs = spark.createDataFrame([(a, many, "aa"), (z, "five rare words stand here", "zz")], "doc_id long, text string, lang string")
    got = li.training_counts(docs)
    assert len(got["aa"]) == 90_000 and len(got["zz"]) == 5
