"""Quality rules, personal data and mixing against plain Python."""

import hashlib
import heapq
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents, empty
from tidemark.llm import mixing, pii, quality_rules
from tidemark.llm.common import materialize, read, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def stats(t):
    t, w = t or "", words(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    win = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(win)
    cover = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(8)}
    out = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
    return (*out, out[0] < 20 or 100 * out[4] > 30 * out[0])


def _tables(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text", "lang", "source").unionByName(documents(spark).select("doc_id", "text", "lang", "source"))


def test_text_stats(spark, sf):
    rows = quality_rules.text_stats(_tables(spark, sf), ["doc_id", "text"]).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == stats(r.text), r


def test_binomial_tail(spark):
    cases = [(0, 10, 0.02), (3, 400, 0.02), (7, 400, 0.02), (9, 400, 0.02), (5, 100, 0.1)]
    for x, n, p in cases:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(x).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1)) if x < n * p else 1.0
        assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_bound_false_rejections(spark):
    # 2000 good documents: 0.5 % are rejected from step 3 on, 5.5 % from step 10; the bad ones from step 5 or 10
    def found(bad):
        rows = [("en", True, 3 if i < 10 else 10 if i < 110 else 19, 19) for i in range(2000)] + [("de", True, 19, 19)] * 30 + [("en", False, bad, 19), ("de", False, 0, 0)] * 50
        out = quality_rules.certified_cutoffs(spark.createDataFrame(rows, "stratum string, good boolean, symbols int, dup_lines int"))
        return {(r.stratum, r.rule): r.cutoff for r in out.collect()}

    assert found(5) == {("en", "symbols"): quality_rules.GRID[5]}
    assert found(10) == {}


def test_judge_keeps_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(documents(spark), labels)
    assert out.count() == documents(spark).count()
    assert quality_rules.judge(empty(spark), labels).count() == 0
    assert all(r.kept == (r.reason is None) and not (r.base_failed and r.kept) for r in out.collect())


def test_keep_good_keeps_whole_rows_and_leaves_no_copy(spark, sf):
    docs = _tables(spark, sf).where("doc_id is not null").withColumn("row", F.lit("r")).withColumn("n_words", F.col("doc_id")).withColumn("c.0", F.lit(1))
    labels = read(spark, sf, "labels")
    lazy = quality_rules.keep_good(docs, labels)
    [copy] = lazy.tidemark_owned
    assert len(copy.inputFiles()) > 0
    out = materialize(lazy, "kept").collect()
    assert spark.read.format("binaryFile").option("recursiveFileLookup", True).load(shared_dir(spark)).where(F.col("path").contains(copy.tidemark_path.rsplit("/", 1)[1])).isEmpty()
    kept = Counter(r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect())
    assert Counter(r.doc_id for r in out) == kept and out[0].asDict().keys() == set(docs.columns)
    of = Counter(tuple(r) for r in docs.collect())
    assert all(of[tuple(r)] for r in out)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out)]


def test_pii_base(spark, sf):
    docs = _tables(spark, sf)
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    found = pii.digest_columns(pii.find_pii(docs)).collect()
    want = Counter()
    for (i, t), n in texts.items():
        spans = base_spans(t)
        want[i, *(sum(x.startswith(k) for x in spans) for k in PATTERNS), hashlib.sha256(",".join(spans).encode()).hexdigest()] += n
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found) == want
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in found) > 10


CONTEXT_WORDS = {
    "iban": "iban account bank konto compte cuenta", "ssn": "ssn,social security,tax id", "local_phone": "phone tel telephone mobile cell call fax telefon téléphone teléfono",
}
ADDED = {
    "iban": (0.7, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), "ssn": (0.3, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local_phone": (0.2, r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])"),
}


def all_spans(t):
    """Base spans and added ones by slices of the text, all pairs compared."""
    base = [(int(x.split(":")[1]), list(PATTERNS).index(x.split(":")[0]), int(x.split(":")[2]), x.split(":")[0]) for x in base_spans(t)]
    out = list(base)
    for k, (kind, (prior, p)) in enumerate(ADDED.items()):
        found = list(re.finditer(p, t, re.ASCII))
        for m, after in zip(found, [*found[1:], None]):
            plain = re.sub("[^0-9A-Za-z]", "", m[0])
            if kind == "iban":
                ok = 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
            elif kind == "ssn":
                ok = not (plain[:3] in ("000", "666") or plain[0] == "9" or plain[3:5] == "00" or plain[5:] == "0000")
            else:
                ok = 9 <= len(plain) <= 12
            near = (t[max(0, m.start() - 40):m.start()] + "\n" + t[m.end():min(m.end() + 40, after.start() if after else len(t))]).lower()
            has = lambda words: any(re.search(rf"\b{w}\b", near, re.ASCII) for w in words)
            words_ = CONTEXT_WORDS[kind].split("," if "," in CONTEXT_WORDS[kind] else None)
            score = prior + (0.4 if has(words_) else -0.3 if has("order invoice tracking reference serial part version isbn example".split()) else 0)
            if ok and score >= 0.5 - 1e-9 and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
                out.append((m.start(), 4 + k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def test_pii_added(spark, sf):
    rows = [(1, "pay to DE89 3704 0044 0532 0130 00 now"), (2, "pay to DE89 3704 0044 0532 0130 01 now"), (3, "SSN: 219-09-9999"), (4, "part 219-09-9999"), (5, "phone: 030 1234 5678"), (6, "page 030 1234 5678"), (7, "order DE89370400440532013000"), (8, "219-09-9999 is my tax id")]
    got = {r.doc_id: r for r in pii.digest_columns(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1].spans.startswith("iban:7:34") and got[2].spans == "" and got[3].spans == "ssn:5:16" and got[4].spans == "" and got[5].spans == "local_phone:7:20" and got[6].spans == ""
    assert got[7].spans == "" and got[8].spans == "ssn:0:11" and got[3].scores == "0.70"
    assert pii.find_pii(empty(spark)).count() == 0
    rng = random.Random(3)
    parts = ["219-09-9999", "phone", "030 1234 5678", "4111 1111 1111 1111", "a@b.co", "10.0.0.1", "tel", "bank DE89370400440532013000", "part", "SSN", "+49 30 1234567", "(030) 123 4567", "und", "x" * 30, "030-123-4567-89", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(150)] + [rng.choice(["tel ", ""]).join(rng.choice(parts) for _ in range(900))]
    texts += [r.text or "" for r in read(spark, sf, "documents").collect()]
    found = pii.digest_columns(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert sum("ssn" in r.spans or "local_phone" in r.spans for r in found) > 50
    for r in found:
        assert r.spans == all_spans(texts[r.doc_id]), texts[r.doc_id][:300]


def test_pii_of_long_texts_is_linear(spark):
    texts = ["4111 " * 200_000, "phone 030 1234 5678 " * 50_000, "a@b.co 219-09-9999 ssn " * 40_000]
    started = time.time()
    found = pii.digest_columns(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert {r.doc_id: r.n_spans for r in found} == {0: 0, 1: 50_000, 2: 80_000} and time.time() - started < 90


def test_pii_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a@b.co", 5, 6, 7)], "doc_id long, text string, body int, more int, _text int")
    assert pii.find_pii(docs).select("body", "more", "_text").first() == (5, 6, 7)


def water_fill(sizes, weights):
    total, fixed = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        level = (total - sum(3 * sizes[i] for i in fixed)) / sum(weights[i] for i in free) if free else 0
        over = {i for i in free if weights[i] * level > 3 * sizes[i] + 1e-9}
        if not over:
            return [3 * s if i in fixed else weights[i] * level for i, s in enumerate(sizes)]
        fixed |= over


@pytest.mark.parametrize("which", ["cases", "sf"])
def test_mixing(spark, sf, which):
    docs = documents(spark) if which == "cases" else read(spark, sf, "documents")
    rows = docs.select("doc_id", "source", "text").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = dict(zip(order, water_fill([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    out = mixing.mix(docs, ["doc_id", "source"]).collect()
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK, (s, taken[s], want[s])
    again = mixing.mix(docs.repartition(3), ["doc_id", "source"]).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.mix(empty(spark)).count() == 0


def by_heap(shares, capacities, seats):
    """Highest quotients, a seat at a time; ties go to the first party."""
    heap = [(-s, i, 0) for i, s in enumerate(shares) if s > 0 and capacities[i] > 0]
    heapq.heapify(heap)
    won = [0] * len(shares)
    while heap and seats:
        _, i, k = heapq.heappop(heap)
        won[i] += 1
        seats -= 1
        if k + 1 < capacities[i]:
            heapq.heappush(heap, (-shares[i] / (2 * k + 3), i, k + 1))
    return won


def test_quotas_are_those_of_a_heap(spark):
    rng = random.Random(6)
    cases = [([600.0] + [0.4] * 1000, [10**6] * 1001, 1000), ([600.0] + [0.6] * 1000, [10**6] * 1001, 1200), ([5.0, 3.0, 0.0], [2, 2, 9], 9), ([1.0] * 7, [3] * 7, 5), ([2.0], [4], 0)]
    for _ in range(25):
        n = rng.randrange(1, 12)
        cases.append(([rng.choice([0.0, 1.0, 2.0, rng.random() * 50]) for _ in range(n)], [rng.randrange(0, 9) for _ in range(n)], rng.randrange(0, 40)))
    rows = [(g, i, s, c, seats) for g, (shares, capacities, seats) in enumerate(cases) for i, (s, c) in enumerate(zip(shares, capacities))]
    parties = spark.createDataFrame(rows, "g int, _order int, share double, capacity long, seats long")
    got = {(r.g, r._order): r.quota for r in mixing.sainte_lague(parties, ["g"], "share", "capacity", "seats").collect()}
    assert len(got) == len(rows)
    for g, case in enumerate(cases):
        assert [got[g, i] for i in range(len(case[0]))] == by_heap(*case), case


def test_resample_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c " * 9, "s", 7, 8, 9), (1, "d e f " * 9, "s", 7, 8, 9), (None, "g h " * 9, None, 7, 8, 9), (None, "i j " * 9, None, 7, 8, 9)], "doc_id long, text string, source string, _n int, doc int, doc2 int")
    out = mixing.resample(docs)
    assert out.columns == docs.columns and {r.text for r in out.collect()} <= {r.text for r in docs.collect()} and out.count() > 0
