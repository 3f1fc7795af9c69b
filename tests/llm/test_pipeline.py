"""The pipeline's stages against plain Python, each on the stage before it."""

from collections import Counter

import corpus_pipeline
from tests.llm.cases import documents
from tests.llm.test_native_texts import stats, water_fill, words
from tests.llm.test_odd_sketch import brute
from tests.llm.test_python_texts import check_pieces
from tidemark.llm import secrets
from tidemark.llm.common import materialize, read


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf), name)
        seen[name] = (before.collect(), docs.collect())
        assert name == "packing" or docs.columns == columns
    before, after = seen["quality_rules"]
    good = {r.doc_id for r in before if not stats(r.text)[-1]}
    assert {r.doc_id for r in after} <= good and len(after) > 0.9 * len(good)
    before, after = seen["near_dedup"]
    assert {r.doc_id for r in after} == {d for d, _, _, kept in brute([(r.doc_id, r.text) for r in before], 5, 80) if kept} and len(after) == len({r.doc_id for r in after})
    before, after = seen["secret_scan"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    assert not any(secrets.scan(r.text, secrets.default_vocabulary())[1] for r in after) and all(r.n_chars == len(r.text) for r in after)
    before, after = seen["mixing"]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += len(words(r.text))
    for r in after:
        taken[r.source] += len(words(r.text))
    order = sorted(sizes)
    longest = max(len(words(r.text)) for r in before)
    for s, want in zip(order, water_fill([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])):
        assert abs(taken[s] - want) <= 2 * longest
    before, after = seen["packing"]
    check_pieces(after, [(r.doc_id, r.text) for r in before])


def test_stages_survive_odd_rows(spark, sf):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), name)
        assert (out.count() > 0 or name == "quality_rules") and materialize(stage(spark, docs.limit(0), sf), name).count() == 0
