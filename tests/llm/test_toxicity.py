"""Toxicity against brute-force neighbours and held-out labels."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import TEXTS, documents, empty
from tidemark.llm import toxicity as tx
from tidemark.llm.common import read


def flat(vectors):
    return np.cumsum([0, *map(len, vectors)]), np.array([t for v in vectors for t in sorted(v)], np.int64), np.array([v[t] for v in vectors for t in sorted(v)])


@pytest.mark.parametrize("common", [2, 16, 10**6])
def test_blocks_give_the_exact_nearest(common, monkeypatch):
    monkeypatch.setattr(tx, "COMMON", common)
    rng = np.random.default_rng(4)
    vectors = []
    for k in range(400):
        v = {int(t): float(rng.random() + 0.1) for t in rng.choice(30, rng.integers(1, 6), replace=False) + 30 * (k % 3)}
        n = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / n for t, x in v.items()})
    index = tx.Index(*flat(vectors), list(range(400)), 91, block=8)
    for query, got in zip(vectors[:80], index.nearest(*flat(vectors[:80]), 7)):
        want = sorted((sum(w * v.get(t, 0) for t, w in query.items()) for v in vectors), reverse=True)[:7]
        assert np.allclose([s for s, _ in got], [w for w in want if w > 0])
        assert all(np.isclose(s, sum(w * vectors[i].get(t, 0) for t, w in query.items())) for s, i in got)
    assert index.nearest(*flat([{}, {90: 1.0}]), 7) == [[], []] and tx.Index(*flat([]), [], 5).nearest(*flat([{1: 1.0}]), 3) == [[]]


def test_found_is_terms_of():
    number = {"stupid": 0, "^stup": 1, "^lowe": 2, "é": 3}
    texts = ["Stupid stupidly STUPID", None, "loweient lowei stup", "é_é stupid9stupid", ""]
    at, ids, counts = tx.Finder(number).find(texts)
    for i, t in enumerate(texts):
        full = tx.terms_of(t or "")
        assert dict(zip(ids[at[i]:at[i + 1]].tolist(), counts[at[i]:at[i + 1]].tolist())) == {k: full[w] for w, k in number.items() if full[w]}


def plain_words(text):
    out, w = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            w += c
        elif w:
            out.append(w)
            w = ""
    return out


def test_scores_from_text_against_plain_python(spark, sf):
    """The query's method from text to score, each step written out over dicts and all pairs."""
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts}
    bags = {}
    for d, t in texts.items():
        bags[d] = Counter(x for w in plain_words(t) for x in ([w, "^" + w[:4]] if len(w) >= 4 else [w]))
    n1 = sum(toxic.values())
    n0 = len(toxic) - n1
    weight = {}
    for term in {x for d in toxic for x in bags[d]}:
        x, y = (sum(term in bags[d] for d in toxic if toxic[d] == k) for k in (0, 1))
        phi = abs(y * (n0 - x) - x * (n1 - y)) / math.sqrt(max((x + y) * (n0 + n1 - x - y), 1) * n0 * n1)
        weight[term] = (phi + 0.01) * (math.log((len(texts) + 1) / (sum(term in b for b in bags.values()) + 1)) + 1)

    def vector(d):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in bags[d].items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}, norm

    having = {k: [d for d in sorted(toxic) if toxic[d] == k and vector(d)[0]] for k in (0, 1)}
    kept = [d for k in (0, 1) for i, d in enumerate(having[k]) if i % 5]
    tried = [d for k in (0, 1) for d in having[k][::5]]
    if len(kept) < 50:
        kept, tried = kept + tried, []
    examples = [(d, vector(d)[0]) for d in kept]
    prior = (n1 + 0.1) / (len(toxic) + 1)

    def vote(d):
        v, norm = vector(d)
        near = sorted(((sum(x * e.get(t, 0) for t, x in v.items()), -i) for i, (_, e) in enumerate(examples)), reverse=True)[:15]
        near = [(s, -i) for s, i in near if s > 0]
        total = sum(s for s, _ in near)
        return (sum(s * toxic[kept[i]] for s, i in near) + 0.2 * prior) / (total + 0.2), math.log1p(norm), near

    fitted = [vote(d)[:2] for d in tried]
    curve = tx.fit_curve(np.array(fitted), np.array([toxic[d] for d in tried], float), np.ones(len(tried))) if tried else tx.CURVE
    got = {r.doc_id: r for r in tx.score(docs, labels).collect()}
    for d in sorted(texts)[::3]:
        if not vector(d)[0]:
            continue
        v, norm, near = vote(d)
        assert abs(got[d].score - 1 / (1 + math.exp(-(curve[0] * v + curve[1] * norm + curve[2])))) < 1e-4
        assert [float(e.split(":")[2]) for e in got[d].evidence.split(",")] == pytest.approx([s for s, _ in near[:3]], abs=2e-3)


def test_held_out_labels(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = tx.score(docs, labels).collect()
    assert len(got) == len({r.doc_id for r in got}) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p for p, y in held if y]) > 0.85 and np.mean([p for p, y in held if not y]) < 0.02


def test_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(tx.score(documents(spark), labels).collect()) == len(TEXTS) + 5
    assert {r.score for r in tx.score(documents(spark), labels.limit(0)).collect()} == {0.1}
    assert tx.score(empty(spark), labels).count() == 0


def test_rare_toxic_words_and_plain_texts_are_judged(spark):
    clean = [f"calm number{i % 50} evening{i % 7} walk along the river{i % 11}" for i in range(3000)]
    toxic = [f"moron{i} scoundrel{i % 3} calm evening{i % 7} walk" for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(clean + toxic)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 3000)) for i in range(3006)], "doc_id long, quality int, toxic int")
    drawn, stands_for = tx.sample(docs, labels, "text", 100)
    own = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(3000, 3006))
    assert sorted(r.toxic for r in drawn.collect()) == [0] * (100 - own) + [1] * own and stands_for[1] == 1 < stands_for[0]
    got = tx.score(docs, labels).collect()
    assert all(r.evidence for r in got) and len({r.score for r in got}) > 1
    assert min(r.score for r in got if r.doc_id >= 3000 and not r.held_out) > max(r.score for r in got if r.doc_id < 3000)
