"""Fingerprints against a plain reading of the contract."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.cases import TEXTS, documents, empty
from tidemark.llm import fingerprints as fp
from tidemark.llm.common import read


def test_state_is_a_sum_of_paragraphs():
    parts = ["one two three four", "five six", "five six", "seven"]
    s = fp.state("\n".join(parts))
    random.Random(1).shuffle(parts)
    assert np.array_equal(s, fp.state("\n".join(parts)))
    assert not np.array_equal(s, fp.state("one two three four\nfive six\nseven"))
    grown = fp.insert(s, "new words here now")
    assert np.array_equal(grown, fp.state("\n".join([*parts, "new words here now"]))) and np.array_equal(fp.delete(grown, "new words here now"), s)
    assert np.array_equal(fp.decode(fp.encode(s)), s)
    assert not fp.state(None).any() and not fp.state(" \n\t").any()


def test_likeness_follows_the_shared_share():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    for share in (0.0, 0.3, 0.5, 0.9, 1.0):
        a = [rng.choice(words) for _ in range(600)]
        n = int(600 * share)
        b = a[:n] + [rng.choice(words) for _ in range(600 - n)]
        assert abs(fp.likeness(fp.state(" ".join(a)), fp.state(" ".join(b))) - share) < 0.15


M64 = (1 << 64) - 1


def plain_state(text):
    """Both parts as plain numbers: sums over paragraphs, the likeness part before any modulus."""
    exact, like = [0] * fp.EXACT, [0] * fp.LIKE
    for p in text.split("\n"):
        p = p.strip(" \t\n\x0b\x0c\r")
        if not p:
            continue
        digest = hashlib.shake_128(p.encode()).digest(2 * fp.EXACT)
        exact = [(x + digest[2 * i] + 256 * digest[2 * i + 1]) % 65536 for i, x in enumerate(exact)]
        h = [xxhash.xxh3_64_intdigest(w) for w in p.split()]
        if len(h) < 3:
            hashes = [(h[0] * 3 + h[-1] + len(h)) & M64] if h else []
        else:
            hashes = []
            for a, b, c in zip(h, h[1:], h[2:]):
                x = ((a ^ (a >> 29)) * 0xBF58476D1CE4E5B9 + b) & M64
                hashes.append(((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 + c) & M64)
        for x in hashes:
            m = ((x ^ (x >> 32)) * 0x9E3779B97F4A7C15) & M64
            like[(m >> 40) % fp.LIKE] += 1 if m >> 63 else -1
    return exact, like


def plain_print(state):
    exact, like = state
    size = 1 if -128 <= min(like) and max(like) < 128 else 2 if -32768 <= min(like) and max(like) < 32768 else 4
    return str(size) + base64.b64encode(b"".join(x.to_bytes(2, "little") for x in exact) + b"".join(x.to_bytes(size, "little", signed=True) for x in like)).decode()


def plain_likeness(a, b):
    if a == b:
        return 1.0
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    norm = math.sqrt(dot(a[1], a[1]) * dot(b[1], b[1]))
    return max(0.0, dot(a[1], b[1]) / norm) if norm else 0.0


def expected(rows):
    out, n = [], len(rows)
    for k, (i, t) in enumerate(rows):
        follows = rows[(k + 1) % n][1]
        e = t[:len(t) - len(t) // 2] + follows[:len(t) // 2]
        s, se, sf = plain_state(t), plain_state(e), plain_state(follows)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_print(s), plain_print(se), pytest.approx(plain_likeness(s, se), abs=1e-9), pytest.approx(plain_likeness(s, sf), abs=1e-9)))
    return sorted(out, key=lambda r: r[:5])


def test_many_repeats_do_not_wrap():
    for n, m in ((40_000, 30_000), (100_000, 7)):
        assert fp.likeness(fp.state("a " * n), fp.state("a " * m)) == pytest.approx(1.0)
    assert np.array_equal(fp.decode(fp.encode(fp.state("a " * 100_000))), fp.state("a " * 100_000))


def test_rows_of_one_id_are_spread(spark):
    rows = [(None, f"text {i}") for i in range(400)] + [(5, f"other {i}") for i in range(300)] + [(i, f"own {i}") for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bounds, heavy = fp._ranges(docs.withColumn("key", F.coalesce("doc_id", F.lit(fp.NULL_ID))), 32)
    assert set(heavy) == {fp.NULL_ID, 5}
    ties = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-(fp.NULL_ID if r[0] is None else r[0]), ties[r[1]]))
    got = sorted(map(tuple, fp.compare_with_next(docs.repartition(3)).collect()), key=lambda r: r[3])
    want = sorted(expected_any(order), key=lambda r: r[3])
    assert got == want


def expected_any(rows):
    return [(i, *r[1:]) for (i, t), r in zip(rows, [expected_one(rows, k) for k in range(len(rows))])]


def expected_one(rows, k):
    t, follows = rows[k][1], rows[(k + 1) % len(rows)][1]
    return expected([(0, t), (1, follows)])[0]


def test_compare_with_next(spark, sf):
    docs = read(spark, sf, "documents")
    rows = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()][::-1]
    got = sorted(map(tuple, fp.compare_with_next(docs.repartition(3)).collect()))
    assert got == expected(rows)
    assert np.mean([r[5] for r in got]) > 0.3 + np.mean([r[6] for r in got])


def test_cases(spark):
    docs = spark.createDataFrame([(i * 7, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, key string")
    got = sorted(map(tuple, fp.compare_with_next(docs).collect()))
    assert got == expected([(i * 7, t or "") for i, t in enumerate(TEXTS)][::-1])
    assert fp.compare_with_next(documents(spark)).count() == documents(spark).count()
    assert fp.compare_with_next(empty(spark)).count() == 0
    one = fp.compare_with_next(docs.where("doc_id = 35")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    prints = {r.doc_id: r.fingerprint for r in fp.fingerprint(documents(spark)).collect()}
    assert prints[6] == prints[10**12] and prints[0] == prints[1]
