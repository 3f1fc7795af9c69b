"""Near duplicates against all pairs of full shingle sets."""

import random
import re

import numpy as np
import pytest

from tests.llm.cases import documents, empty
from tidemark.llm import odd_sketch as od
from tidemark.llm.common import read


def shingles(t, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= percent * (len(a) + len(b) - n):
                    x, y = top(i), top(j)
                    up[max(x, y, key=lambda k: rows[k][0])] = min(x, y, key=lambda k: rows[k][0])
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return sorted((d, len(sets[i]), least[top(i)], d == least[top(i)]) for i, (d, _) in enumerate(rows))


def test_sketch_estimates_high_similarities():
    rng = np.random.default_rng(1)
    for share in (0.75, 0.85, 0.95, 1.0):
        errors = []
        for _ in range(60):
            n = int(rng.integers(20, 2000))
            pool = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2))
            k = round(n * (1 - share) / (1 + share))
            a, b = np.sort(pool[:n]), np.sort(pool[k:n + k])
            if len(a) != n or len(b) != n:
                continue
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            a, b = np.sort(od._mix(a)), np.sort(od._mix(b))
            x, y = (np.frombuffer(od.sketch(od.samples(s)), np.uint64) for s in (a, b))
            errors.append(od.similarity(int(np.bitwise_count(x ^ y).sum())) - true)
        assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < od.MARGIN


def test_exact_links():
    rng = np.random.default_rng(2)
    for m in (2, 5, 9, 40):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(m)]
        got = od.exact_links(sets, 50)
        for i in range(m):
            for j in range(m):
                n = len(np.intersect1d(sets[i], sets[j]))
                assert got[i, j] == (i != j and 100 * n >= 50 * (len(sets[i]) + len(sets[j]) - n))


def test_forest_spans():
    rng = np.random.default_rng(3)
    linked = rng.random((40, 40)) < 0.04
    linked |= linked.T
    up = list(range(40))
    for i, j in od.forest(linked):
        up[i] = j
    reach = np.linalg.matrix_power((linked | np.eye(40, dtype=bool)).astype(np.int64), 1) > 0
    for _ in range(6):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert all((up[i] == up[j]) == reach[i, j] for i in range(40) for j in range(40))


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_against_all_pairs(spark, sf, size, percent, monkeypatch):
    monkeypatch.setattr(od, "BUCKET_BLOCK", 7)
    monkeypatch.setattr(od, "FAMILY_BLOCK", 5)
    docs = read(spark, sf, "documents").select("doc_id", "text")
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(80):  # a large family whose similarities lie on both sides of the threshold
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(5000 + i, "the same three" if i % 2 else "The  SAME three") for i in range(30)] + [(6000, "a b c d e f g h i"), (6001, "a b c d e f g h"), (6002, ""), (6003, None)]
    docs = docs.where("doc_id < 150").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, od.near_duplicates(docs, size=size, threshold_percent=percent).collect()))
    assert got == brute(plain, size, percent)
    assert sum(not r[3] for r in got) > 40


def test_cases(spark):
    got = od.near_duplicates(documents(spark), size=3, threshold_percent=85).collect()
    assert len(got) == documents(spark).count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[7][0].component_id == 6 and by[10**12][0].component_id == 6 and by[None][0].component_id == 6 and not by[None][0].kept
    assert all(by[i][0].kept and by[i][0].n_shingles == 0 for i in range(4)) and len(by[8]) == 3
    assert od.near_duplicates(empty(spark)).count() == 0


def test_dropping_keeps_other_texts_of_one_id_and_columns_of_any_name(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one, 5, 1), (1, two, 6, 2), (1, two, 6, 2), (2, one + " tail", 7, 3), (3, "", 8, 4), (3, "", 8, 4), (4, "", 9, 5), (None, one, 1, 6), (None, one, 1, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rank int, rank int")
    out = od.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], rows[1], rows[4], rows[6], rows[7], rows[8]], key=str)


def test_rows_made_for_a_group_of_near_copies_are_linear(spark):
    """Every step's rows for one group of m near copies, and for one twice as large."""
    rng = random.Random(8)

    def made(m):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows = []
        for i in range(m):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        nodes = od.nodes_of(od.features(docs, "text", 5, od.bands_for(0.8))).cache()
        members = od.members_of(nodes)
        pairs = od.pivot_pairs(members, 0.8)
        links = od.components(od.pivot_links(od.texts_of(docs, members, "text"), pairs, 5, 80))
        left = members.where("m > 2").join(links, "node", "left").selectExpr("key", "node", "n_shingles", "sketch", "coalesce(root, node) root")
        return pairs.count(), od.dealt(left, "key", od.BUCKET_BLOCK).count(), od.families(left, 0.8).count()

    for small, large in zip(made(700), made(1400)):
        assert large <= 4 * small + 1400
