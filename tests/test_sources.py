"""Sources, sinks, signal kernels and streams."""

import io
import json
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import loop_runs
from tidemark.functions import dsp
from tidemark.sources import audio, files, sinks
from tidemark.streaming import frames as st


def wav(x, rate=16_000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.repeat((np.clip(x, -1, 1) * 32767).astype("<i2"), channels).tobytes())
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("audio")
    t = np.arange(8000) / 16_000
    (top / "home").mkdir()
    (top / "home/a.WAV").write_bytes(wav(0.5 * np.sin(2 * np.pi * 440 * t)))
    (top / "home/b.wav").write_bytes(wav(0.5 * np.sin(2 * np.pi * 440 * np.arange(4000) / 8000), 8000, 2))
    (top / "bad.wav").write_bytes(b"nothing")
    (top / "notes.txt").write_text("x")
    with zipfile.ZipFile(top / "z.zip", "w") as z:
        z.writestr("d/c.wav", wav(t * 0)), z.writestr("__MACOSX/c.wav", b""), z.writestr("d/._c.wav", b"")
    return str(top)


def test_listing_and_decoding(spark, folder):
    found = files.audio_files(spark, folder)
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.WAV", "b.wav", "bad.wav"]
    rows = {r.path.rsplit("/", 1)[1]: r for r in audio.decode(found).collect()}
    assert rows["bad.wav"].pcm is None and rows["a.WAV"].len == 8000 and rows["b.wav"].len == 8000
    assert np.abs(audio.from_pcm(rows["a.WAV"].pcm) - audio.from_pcm(rows["b.wav"].pcm)).max() < 0.1
    assert tuple(audio.failures(audio.decode(found)).first()) == (3, 1)
    assert {r.env for r in files.environments(spark, folder).collect()} >= {"home"}
    zips = spark.read.format("binaryFile").load(folder + "/z.zip")
    assert [r.member for r in files.zip_members(zips).collect()] == ["d/c.wav"]
    with pytest.raises(Exception):
        files.audio_files(spark, folder + "/none").count()


def test_crops(spark):
    pcm = np.arange(100, dtype="<i2")
    bank = spark.createDataFrame([(1, pcm.tobytes())], "clip_id int, pcm binary")
    got = audio.crops(bank, spark.createDataFrame([(1, 10, 20), (1, 95, 300)], "clip_id int, a long, z long")).orderBy("a").collect()
    assert [np.frombuffer(r.pcm, "<i2").tolist() for r in got] == [list(range(10, 20)), list(range(95, 100))] and [r.len for r in got] == [10, 5]
    both = audio.union_stores(bank, bank.withColumn("kind", F.lit("x")))
    assert both.columns == ["clip_id", "pcm", "store", "kind"] and both.count() == 2


def test_parquet_index(spark, tmp_path):
    spark.range(1000).withColumn("label", F.concat(F.lit("l"), F.col("id") % 3)).coalesce(1).write.option("parquet.block.row.count.limit", 300).parquet(str(tmp_path / "t"))
    rows = files.parquet_index(spark, str(tmp_path / "t"), ["id", "label"])
    got = rows.orderBy("id").collect()
    assert len(got) == 1000 and len({(r.file, r.rg, r.row) for r in got}) == 1000
    for a, b in zip(got, got[1:]):
        assert (b.rg, b.row) in ((a.rg, a.row + 1), (a.rg + 1, 0))
    once = sinks.write_once(rows, str(tmp_path / "i"))
    assert sinks.write_once(rows.limit(1), str(tmp_path / "i")).count() == once.count() == 1000


def test_json_and_reports(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"coughing": {"a.wav": {"speakerID": "s1"}}, "yawning": {"b.wav": {"speakerID": "s2"}}}))
    meta = files.nested_metadata(spark, str(tmp_path / "m.json"))
    assert sorted(map(tuple, meta.collect())) == [("coughing", "a.wav", "s1"), ("yawning", "b.wav", "s2")]
    assert files.existing_only(meta, spark.createDataFrame([("/x/b.wav",)], "path string")).count() == 1
    thr = spark.createDataFrame([("b", 0.5), ("a", 0.25), ("_low_ratio", 0.5)], "label string, thr double")
    sinks.write_thresholds(thr, str(tmp_path / "thr"))
    assert sorted(map(tuple, files.threshold_profile(spark, str(tmp_path / "thr")).collect())) == [("a", 0.25), ("b", 0.5)]
    assert files.profile_setting(spark, str(tmp_path / "thr"), "_low_ratio", 0.6) == 0.5
    events = spark.createDataFrame([("f", "horn", 2.0, 3.0, 0.9), ("f", "cough", 0.5, 0.75, 0.8)], "file string, label string, start_s double, end_s double, prob double")
    rec = sinks.records(events, spark.createDataFrame([("f", 4.0), ("g", 1.0)], "file string, duration double"))
    sinks.write_json_lines(rec, str(tmp_path / "out"))
    back = {r.file: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert [e.label for e in back["f"].events] == ["cough", "horn"] and back["g"].events == []
    lines = {r.file: r.report for r in sinks.console_report(rec).collect()}
    assert lines["g"] == "(no events)" and lines["f"].splitlines()[0] == "   0.50-   0.75s  cough  p=0.80"
    assert json.loads(sinks.render(thr.where("label = 'a'"), "__CLASSES_JSON__")) == [{"label": "a", "thr": 0.25}]
    sinks.write_report(thr, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_kernels():
    rng = np.random.default_rng(0)
    t = np.arange(16_000) / 16_000
    tone = (0.5 * np.sin(2 * np.pi * 1000 * t)).astype(np.float32)
    mel = dsp.log_mel(0.002 * tone)
    assert mel.shape == (64, 101) and mel.min() >= -1 and mel.max() <= 3
    centre = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 50 / 700), 2595 * np.log10(1 + 8000 / 700), 66)[1:-1] / 2595) - 1)
    assert abs(centre[mel.mean(1).argmax()] - 1000) < 100
    assert np.allclose(dsp.frame_db(tone), 10 * np.log10(0.125), atol=0.2)
    assert len(dsp.speed(tone, 2.0)) == 8000
    for beta in (0, 1, 2):
        s = np.abs(np.fft.rfft(dsp.coloured_noise(1 << 15, beta, rng))) ** 2
        slope = np.polyfit(np.log(np.arange(10, 8000)), np.log(s[10:8000]), 1)[0]
        assert abs(slope + beta) < 0.15
    assert abs(dsp.rms(dsp.reverb(tone, rng)) - dsp.rms(tone)) < 1e-3
    assert np.abs(np.fft.rfft(dsp.phone(tone)))[4500:].max() < 200 and dsp.rms(dsp.hum(16_000, rng)) == pytest.approx(1, abs=1e-3)
    noisy = dsp.at_snr(tone, dsp.coloured_noise(16_000, 0, rng), 10.0)
    assert 20 * np.log10(dsp.rms(tone) / dsp.rms(noisy - tone)) == pytest.approx(10, abs=0.1)
    assert np.array_equal(dsp.augmented(tone, (1, 2))[0], dsp.augmented(tone, (1, 2))[0])
    for k in range(60):
        y, moved = dsp.augmented(tone, (1, k), [("horn", 0.2, 0.4)], [tone], [tone])
        assert len(y) == len(tone) and np.abs(y).max() <= 1 and all(e - s >= 0.05 and e <= 1 for _, s, e in moved)
    x, events = dsp.mixture([tone], {"horn": [tone[:4000]]}, (3, 4))
    assert len(x) == 128_000 and all(0 <= s < e <= 8 for _, s, e in events)
    assert dsp.spec_augmented(mel, rng).shape == mel.shape and dsp.babble([tone], 100, rng).shape == (100,)


def test_composed_windows():
    x = np.full(16_000 * 3, 0.1, np.float32)
    out, events = dsp.composed([(x, [("horn", 0.5, 1.0)])] * 4, (1, 1))
    assert len(out) == 128_000 and [e[1:] for e in events] == [(0.5, 1.0), (3.5, 4.0), (6.5, 7.0)]
    assert out[0] == 0 and abs(out[48_000]) < 1e-6 and 0.04 < out[24_000] < 0.21


def test_word_spans():
    frames = np.full((12, 4), -5.0)
    for f, token in enumerate([0, 1, 1, 0, 2, 0, 0, 3, 3, 3, 0, 0]):
        frames[f, token] = -0.01
    spans = dsp.word_spans(frames, [[1, 2], [3]])
    assert [(a, z) for a, z, _ in spans] == [(1, 5), (7, 10)] and all(p > 0.98 for *_, p in spans)
    with pytest.raises(ValueError):
        dsp.word_spans(frames[:2], [[1, 2], [3]])


def test_kernel_over_a_bank(spark):
    bank = spark.createDataFrame([(1, np.zeros(640, "<i2").tobytes()), (2, None)], "clip_id long, pcm binary")
    got = {r.clip_id: r.db for r in dsp.on_pcm(bank, "clip_id", dsp.frame_db, "db").collect()}
    assert got[1] == pytest.approx([-100.0, -100.0]) and got[2] is None


def _stream(spark, rows, folder, parts=3):
    schema = "ts timestamp, clip_id long, label string, frame long, p double"
    frame = spark.createDataFrame(rows, "ms long, clip_id long, label string, frame long, p double").select(F.timestamp_millis("ms").alias("ts"), "clip_id", "label", "frame", "p")
    for k in range(parts):
        a, z = k * len(rows) // parts, (k + 1) * len(rows) // parts
        frame.where(F.col("frame").between(rows[a][3], rows[z - 1][3])).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    rng = np.random.default_rng(7)
    p = np.clip(np.cumsum(rng.normal(0, 0.2, 300)) % 1.2, 0, 1).round(3)
    rows = [(i * 40, 1, "x", i, float(v)) for i, v in enumerate(p)]
    rows += [(10_000_000 + i * 40, 1, "x", 100_000 + i, 0.0) for i in range(40)]
    stream = _stream(spark, rows, str(tmp_path / "s"))
    got = _run(st.hysteresis_stream(stream, 0.7, gap=0.3, late="0 seconds"), "hysteresis")
    assert sorted((r.start, r.stop) for r in got) == loop_runs(p.tolist(), 0.7, gap=0.3)
    sessions = _run(st.gap_sessions(stream.where("p > 0.7"), [], late="0 seconds"), "sessions")
    assert sum(r.n for r in sessions) <= int((p > 0.7).sum())
    means = _run(st.sliding_mean(stream, late="0 seconds"), "means")
    first = [r.p for r in means if r.start_ts.timestamp() == 0]
    assert first and first[0] == pytest.approx(p[:200].mean())
    assert _run(st.chunk_counts(stream, late="0 seconds"), "chunks")


def test_loop_state_equals_the_loop():
    rng = np.random.default_rng(8)
    for _ in range(100):
        p = np.clip(np.cumsum(rng.normal(0, 0.3, 90)) % 1.2, 0, 1).round(3).tolist()
        h, got = st.Hysteresis(0.7, 0.42, 0.3, 0.15), []
        for i, v in enumerate(p):
            h = st.Hysteresis(0.7, 0.42, 0.3, 0.15, h.state())
            got += h.add(i, v)
        assert got + h.finish() == loop_runs(p, 0.7, gap=0.3)
