"""Detection from PCM to events with a small model, alignment, and the functions that SQL can call."""

import itertools
import random

import numpy as np
import pytest

import tidemark
from tidemark.functions import dsp
from tidemark.operators import banks
from tidemark.operators import quotas as qu
from tidemark.sources import audio


def field(number, value):
    """A protobuf field: a number, text or bytes."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def small_model(weights):
    """An ONNX model: the mean of four spectrum frames times weights (mels by labels) is a frame's logits."""
    def tensor(name, a):
        return b"".join(field(1, d) for d in a.shape) + field(2, 1) + field(8, name) + field(9, a.astype("<f4").tobytes())

    def ints(name, *v):
        return field(1, name) + b"".join(field(8, i) for i in v) + field(20, 7)

    def node(op, inputs, output, *attributes):
        return b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, op) + b"".join(field(5, a) for a in attributes)

    def value(name, *dims):
        shape = b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
        return field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))

    graph = field(1, node("AveragePool", ["mel"], "pooled", ints("kernel_shape", 4), ints("strides", 4)))
    graph += field(1, node("Transpose", ["pooled"], "turned", ints("perm", 0, 2, 1))) + field(1, node("MatMul", ["turned", "w"], "logits"))
    graph += field(2, "g") + field(5, tensor("w", weights)) + field(11, value("mel", "n", 64, "t")) + field(12, value("logits", "n", "f", weights.shape[1]))
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


def test_detection_from_samples(spark):
    rng = np.random.default_rng(3)
    weights = rng.normal(0, 0.2, (64, 3))
    lengths = [int(11.3 * 16_000), 4000, 0, 30 * 16_000]
    clips = [(rng.standard_normal(n) * np.repeat(rng.random(n // 2000 + 1) > 0.5, 2000)[:n] * 0.1).astype(np.float32) for n in lengths]
    labels = ["cough", "horn", "laugh"]
    bank = spark.createDataFrame([(i, audio.to_pcm(x)) for i, x in enumerate(clips)], "id int, pcm binary")
    thresholds = spark.createDataFrame([("cough", 0.5), ("horn", 0.6), ("laugh", 1.01)], "label string, thr double")
    scores = dsp.infer(bank, "id", small_model(weights), labels, batch=2).collect()
    assert all(0 <= r.p <= 1 for r in scores)
    got = {}
    for r in tidemark.detect(bank, "id", small_model(weights), labels, thresholds, batch=2).collect():
        got.setdefault((r.clip_id, r.label), []).append((r.start_s, r.end_s, r.prob))
        assert 0 <= r.start_s < r.end_s <= lengths[r.clip_id] / 16_000 + 0.04
    for i, x in enumerate(clips):
        x = audio.from_pcm(audio.to_pcm(x))
        n = int(len(x) / 16_000 / 0.04) + 1
        total, times = np.zeros((n, 3)), np.zeros(n)
        for t0 in range(0, max(1, len(x) - 96_000), 32_000):
            window = np.zeros(128_000)
            window[:len(x[t0:t0 + 128_000])] = x[t0:t0 + 128_000]
            mel = dsp.log_mel(window)
            for f in range(mel.shape[1] // 4):
                if t0 // 640 + f < n:
                    total[t0 // 640 + f] += 1 / (1 + np.exp(-mel[:, 4 * f:4 * f + 4].mean(1) @ weights))
                    times[t0 // 640 + f] += 1
        p = total / np.maximum(times, 1)[:, None]
        mine = np.array(sorted((r.frame, labels.index(r.label), r.p) for r in scores if r.clip_id == i))[:, 2].reshape(n, 3)
        assert np.allclose(mine, p, atol=1e-4)
        mirrored = np.pad(mine, ((2, 2), (0, 0)), mode="symmetric")
        smooth = np.median(np.stack([mirrored[k:k + n] for k in range(5)]), 0)
        for k, (label, high) in enumerate([("cough", 0.5), ("horn", 0.6), ("laugh", 1.01)]):
            runs = tidemark.class_runs(smooth[:, k], high, 0.6, 0.3 if label in tidemark.INLINE else 1.0)
            want = [(round(a * 0.04, 2), round(z * 0.04, 2)) for a, z in runs]
            assert [round(v, 2) for e in sorted(got.get((i, label), [])) for v in e[:2]] == [v for e in want for v in e]
    assert sum(map(len, got.values())) > 3


def best_by_enumeration(log_probs, words):
    """The best score over every assignment of frames to tokens and blanks."""
    tokens = [t for w in words for t in w]
    best = -np.inf
    for cut in itertools.combinations_with_replacement(range(len(log_probs) + 1), 2 * len(tokens)):
        spans = list(zip(cut[::2], cut[1::2]))
        if any(a >= z for a, z in spans) or any(s == t and z == a for (s, t), (_, z), (a, _) in zip(zip(tokens, tokens[1:]), spans, spans[1:])):
            continue
        path = np.zeros(len(log_probs), int)
        for t, (a, z) in zip(tokens, spans):
            path[a:z] = t
        best = max(best, log_probs[np.arange(len(path)), path].sum())
    return best


def test_alignment_is_the_best_of_all_paths():
    rng = np.random.default_rng(4)
    for words in ([[1]], [[1, 2]], [[1], [1]], [[2, 2], [1]]):
        for _ in range(12):
            frames = int(rng.integers(4, 8))
            lp = np.log(rng.dirichlet(np.ones(3) * 0.5, frames) + 1e-12)
            spans = dsp.word_spans(lp, words)
            assert all(a < z for a, z, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
            if all(len(w) == 1 for w in words):
                path = np.zeros(frames, int)
                for w, (a, z, p) in zip(words, spans):
                    path[a:z] = w[0]
                    assert p == pytest.approx(np.exp(lp[a:z, w[0]]).mean())
                assert lp[np.arange(frames), path].sum() == pytest.approx(best_by_enumeration(lp, words))
    with pytest.raises(ValueError):
        dsp.word_spans(np.zeros((2, 3)), [[1, 1]])


def test_sounds_in_pauses_and_trims():
    db = np.full(200, -60.0)
    db[60:70] = -20
    assert dsp.sound_in_pause("cough", 1.0, 2.0, db, -60.0) == (1.16, 1.44)
    assert dsp.sound_in_pause("cough", 1.0, 1.2, db, -60.0) is None and dsp.sound_in_pause("cough", 2.0, 2.5, db, -60.0) == (2.06, 2.44)
    db[50:150] = -20
    s, e = dsp.sound_in_pause("sniff", 0.5, 3.5, db, -60.0)
    assert e - s <= 1.0 + 1e-9
    x = np.zeros(32_000, np.float32)
    x[8000:16_000] = 0.5
    assert len(dsp.trimmed(x)) == 8000 + 2 * 800 and dsp.trimmed(x[:100]) is None


def test_resampling_keeps_low_tones_and_drops_high_ones():
    t = np.arange(48_000) / 48_000
    low, high = audio.resampled(np.sin(2 * np.pi * 1000 * t), 48_000), audio.resampled(np.sin(2 * np.pi * 11_000 * t), 48_000)
    assert len(low) == 16_000 and np.abs(low[500:-500] - np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000)[500:-500]).max() < 0.01
    assert np.abs(high[500:-500]).max() < 0.02


def test_sql_functions(spark):
    tidemark.register(spark)
    row = spark.sql("select canon_label('<vehicle horn>') a, canon_label('people talking') b, canon_label('xyz') c, class_runs(array(0.1D, 0.9D, 0.9D, 0.9D, 0.9D, 0.9D, 0.1D), 0.8D, 0.5D, 1.0D, 0.15D) d").first()
    assert (row.a, row.b) == ("horn", None) and row.c.startswith("__") and [tuple(x) for x in row.d] == [(1, 6)]


def test_row_groups_in_pick_order_and_draws(spark):
    rng = random.Random(5)
    clips = spark.createDataFrame([(i // 20, i, [rng.choice("abc"), rng.choice("cdx")], rng.choice(["train", "val"])) for i in range(400)], "rg int, id int, labels array<string>, split string")
    picks = qu.select_rowgroups(clips, ["rg"], "labels", 1000, 4, 2, list("abcd"))
    rows = sorted(picks.collect(), key=lambda r: r.pick_ord)
    assert [r.pick_ord for r in rows] == list(range(6)) and len({r.rg for r in rows}) == 6
    order = [r.pick_ord for r in qu.in_pick_order(clips, picks, ["rg"]).collect()]
    assert order == sorted(order) and len(order) == 120
    items = spark.createDataFrame([("a", 1)] * 1 + [("b", i) for i in range(50)] + [("c", 7), ("c", 8)], "label string, id int")
    draws = qu.drawn(items, "label", "id", 900, 1).collect()
    assert len(draws) == 900 and sorted(r.draw for r in draws) == list(range(900))
    for c in "abc":
        assert 230 < sum(r.label == c for r in draws) < 370
    assert sorted(map(tuple, draws)) == sorted(map(tuple, qu.drawn(items.repartition(3), "label", "id", 900, 1).collect()))


def test_noise_keys(spark):
    rows = spark.createDataFrame([("kitchen", None), ("x", "home")], "kind string, env string")
    assert [r[0] for r in rows.select(banks.noise_key(rows["kind"], rows["env"])).collect()] == ["kind/kitchen", "env/home"]
