"""Text statistics and quality rules whose cutoffs bound the share of good documents they reject.

A rule rejects a document when its statistic reaches a cutoff.  For every
stratum and rule the cutoffs of a fixed grid are tested from the most lenient
on against labelled holdout documents: a cutoff is certified if the exact
binomial tail P(Bin(n, alpha / rules) <= x) is at most delta / (strata * rules),
with n good labelled documents in the stratum of which the cutoff rejects x.
Testing in that fixed order and stopping at the first failure needs no further
correction over cutoffs; Bonferroni covers strata and rules.  So with
probability 1 - delta no rule rejects more than alpha / rules of any stratum's
good documents, and all rules together no more than alpha of them.  Of a
stratum's certified cutoffs a rule takes the one that separates bad from good
labelled documents best, and none if none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, let, materialize, owning, text_of, words_of

#: Highest share of a stratum's good documents that the rules together may reject, and the chance that this is broken anywhere.
ALPHA, DELTA = 0.03, 0.05
#: Cutoffs in hundredths, from the most lenient to the strictest.
GRID = (90, 80, 70, 60, 50, 40, 35, 30, 25, 20, 15, 12, 10, 8, 6, 5, 4, 3, 2)
#: Statistic of a document in hundredths, by rule.
RULES = {
    "symbols": lambda: 100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
    "dup_lines": lambda: 100 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
}
WINDOW = 8


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that a text has twice or more; windows are compared by 64-bit hash."""
    i64 = lambda x: F.lit(x).cast("long")

    def covered(at_windows):
        def keep(x, k):
            same = lambda j: at_windows[j]["h"] == x["h"]
            return F.when(k > 0, same(k - 1)).otherwise(False) | F.when(k < F.size(at_windows) - 1, same(k + 1)).otherwise(False)

        starts = F.array_sort(F.transform(F.filter(at_windows, keep), lambda x: x["i"]))

        def add(acc, p):
            return F.struct((acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).cast("long").alias("n"), (p + WINDOW).cast("long").alias("end"))

        return F.aggregate(starts, F.struct(i64(0).alias("n"), i64(0).alias("end")), add, lambda acc: acc["n"])

    def of_windows(win):
        return F.when(F.size(F.array_distinct(win)) == F.size(win), i64(0)).otherwise(
            let(F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))

    def of_hashes(hs):
        win = F.transform(F.sequence(F.lit(0), F.size(hs) - WINDOW), lambda i: F.xxhash64(*[hs[i + k] for k in range(WINDOW)]))
        return let(win, of_windows)

    return F.when(F.size(words) < WINDOW + 1, i64(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def text_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed.

    n_lines counts lines with a word.  Null and empty texts have zeros and fail the base rule.
    """
    [body] = free_names(keep, "body")
    out = docs.select(*keep, text_of(docs, text).alias(body))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def stats(words):
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"))

    of_words, of_lines = free_names([*keep, body], "of_words", "of_lines")
    out = out.select(
        *keep, let(words_of(F.col(body)), stats).alias(of_words),
        (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias(of_lines))
    out = out.select(*keep, f"{of_words}.n_words", f"{of_words}.word_chars", "n_symbols", f"{of_lines}.n_lines", f"{of_lines}.n_dup_lines", f"{of_words}.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _level(statistic: Column) -> Column:
    """How many of GRID's cutoffs, from the most lenient on, do not reject: those above the statistic."""
    return sum((F.when(statistic < c, 1).otherwise(0) for c in GRID), F.lit(0))


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= x), exactly, by its terms' recurrence in logarithms; 1 where x >= n * p, which certifies nothing."""
    def step(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("term"), F.exp(first).alias("sum"))
    return F.when(x >= n * p, F.lit(1.0)).when(x < 1, F.exp(first)).otherwise(F.aggregate(F.sequence(F.lit(1), x.cast("int")), start, step, lambda acc: acc["sum"]))


def certified_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the certified cutoff of the largest gain, of equals the most lenient, where that is positive.

    labelled: stratum, good, and the rules' levels (columns named by rule).  The
    gain is the share of bad documents rejected less that of good ones.
    """
    counts = materialize(labelled.groupBy("stratum", *RULES).agg(F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("bad")), "quality-counts")  # a row for each stratum and pair of levels
    each = counts.select("stratum", "n", "bad", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("level")) for r in RULES])).alias("x")).select("stratum", "n", "bad", "x.rule", "x.level")
    each = each.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.collect_list(F.struct("level", "n", "bad")).alias("levels"))
    strata = max(1, counts.select("stratum").distinct().count())
    tests = each.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(c).alias("cutoff")) for k, c in enumerate(GRID)])).alias("g"))

    def rejected(kind):
        return F.aggregate("levels", F.lit(0).cast("long"), lambda acc, v: acc + F.when(v["level"] <= F.col("g.step"), v[kind]).otherwise(0))

    tests = tests.select("stratum", "rule", "g.step", "g.cutoff", (binomial_tail(rejected("n"), F.col("n"), alpha / len(RULES)) <= delta / len(RULES) / strata).alias("ok"), (rejected("bad") * F.col("n") - rejected("n") * F.col("bad")).alias("gain"))
    runs = tests.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("ok"), F.col("step"))).alias("failed"))
    tests = tests.join(runs, ["stratum", "rule"]).where(F.col("ok") & (F.col("failed").isNull() | (F.col("step") < F.col("failed"))) & (F.col("gain") > 0))
    return tests.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff"))


def _stratum() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("(none)"))


def _marks(labels: DataFrame) -> DataFrame:
    """doc_id and good; repeated labels count once and are good only if all are."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))


def _cutoff_table(labelled: DataFrame, alpha: float, delta: float) -> DataFrame:
    """stratum and a column cut_<rule> for each rule, from labelled documents' statistics, stratum and good; a row per stratum with a cutoff."""
    levels = labelled.where(~F.col("base_failed")).select("stratum", "good", *[_level(RULES[r]()).alias(r) for r in RULES])
    cutoffs = certified_cutoffs(levels, alpha, delta)
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    return materialize(wide, "cutoffs")


def _reasoned(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    reason = F.when(F.col("base_failed"), "base")
    for r in RULES:
        reason = reason.when(RULES[r]() >= F.col(f"cut_{r}"), r)
    return stats.join(cutoffs, "stratum", "left").withColumn("reason", reason)


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and reason (base, a rule's name, or null) of every row.

    Strata are languages; a null language is one of its own.  labels: doc_id and
    quality (1: good); repeated labels count once and are good only if all are.
    A stratum with too few good labelled documents gets no cutoff and rejects
    only what the base rule rejects.  Other columns of docs are not read.
    """
    stats = materialize(text_stats(docs.select("doc_id", "text", _stratum().alias("stratum")), ["doc_id", "stratum"]), "quality")
    out = _reasoned(stats, _cutoff_table(stats.join(_marks(labels), "doc_id"), alpha, delta))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", F.col("reason").isNull().alias("kept"), "reason")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs, all columns of any name, that judge keeps.

    All texts are read once: rows are written with their statistics, the cutoffs
    come from those of the labelled documents, joined without texts, and the
    written rows are filtered where they are.  The copy is the result's own and
    goes when materialize has written the result.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    rows = docs.select(row.alias("row"), "doc_id", "text", _stratum().alias("stratum"))
    stats = materialize(text_stats(rows, ["row", "doc_id", "stratum"]), "quality")
    cutoffs = _cutoff_table(stats.drop("row").join(_marks(labels), "doc_id"), alpha, delta)
    kept = _reasoned(stats, cutoffs).where("reason is null").select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
    return owning(kept, stats)
