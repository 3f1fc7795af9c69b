"""Transcript steps: tasks grow with the words, rows are dealt once, and a long recording is no join."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import transcript as tr
from tidemark.plans import registry
from tidemark.plans import tables as t


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dedup_consecutive", "rich_transcript", "asof_slot", "monotone_starts", "merge_same_label"])
def test_tasks_grow_with_the_words(spark, sf, monkeypatch, name):
    few = registry.QUERIES[name](spark, sf)
    monkeypatch.setattr(t, "WORDS_A_TASK", 200, raising=False)
    many = registry.QUERIES[name](spark, sf)
    words = t.words(spark, sf).count()
    assert words > 2_000 and many.rdd.getNumPartitions() == -(-words // 200)
    text = plan(many)
    assert len(re.findall(r"(?<!Reused)Exchange .*REPARTITION_BY_NUM", text)) == len(re.findall(r"(?<!Reused)Exchange ", text)) > 0
    assert not re.search(r"(?<!Reused)Exchange [^\n]*\n[^\n]*Generate", text)  # whole turns move, not words
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_closing_tags_equal_the_loop_without_a_join(spark):
    rng = random.Random(6)
    words = [(0, k, "a", s := round(rng.uniform(-1, 90), 2), round(s + rng.uniform(0, 1), 2)) for k in range(60)] + [(1, 0, "a", None, None), (1, 1, "b", 2.0, None)]
    events = [(rng.choice([0, 1, 2]), "horn", s := round(rng.uniform(0, 95), 2), round(s + rng.uniform(0, 2), 2)) for _ in range(200)]
    w = spark.createDataFrame(words, "clip_id long, pos int, word string, start_s double, end_s double")
    e = spark.createDataFrame(events, "clip_id long, label string, start_s double, end_s double")
    spans = [(c, s or 0.0, z if z is not None else s or 0.0) for c, _, _, s, z in words]
    want = sorted((c, z) for c, _, s, z in events if any(k == c and a < z and b > s for k, a, b in spans) and z + tr.TAIL < max(b for k, _, b in spans if k == c))
    got = tr.tags(w, e)
    assert "Join" not in plan(got)
    assert got.where("prio = 0").count() == len(events)
    assert sorted((r.clip_id, r.t) for r in got.where(F.col("text") == "</horn>").collect()) == want and want
