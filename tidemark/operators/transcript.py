"""Events merged into word-timed transcripts.

words: clip_id, pos, word, start_s, end_s (times may be null).
events: clip_id, label, start_s, end_s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taxonomy import INLINE, is_inline
from .events import gap_join

# Words that stand for a sound which a recogniser wrote out.
FILLER_WORDS = ["uh", "um", "umm", "hmm", "ah", "er", "mhm"]
LAUGH_WORDS = ["ha", "haha", "hehe", "heh", "[laughs]", "lol"]
#: A closing tag needs so much speech after it.
TAIL = 0.3


def is_filler(word: Column) -> Column:
    return F.trim(F.lower(word), F.lit(" .,!?")).isin(FILLER_WORDS + LAUGH_WORDS)


def suppress_spoken(words: DataFrame, events: DataFrame) -> DataFrame:
    """events without those that overlap words all of which are fillers; words without times overlap nothing."""
    w = words.where("start_s is not null and end_s is not null").select(F.col("clip_id").alias("_c"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), is_filler(F.col("word")).alias("_f"))
    keyed = events.withColumn("_id", F.struct("clip_id", "label", "start_s", "end_s"))
    hits = keyed.select("_id", "clip_id", "start_s", "end_s").distinct().join(w, (F.col("clip_id") == F.col("_c")) & (F.col("_s") < F.col("end_s")) & (F.col("_e") > F.col("start_s")))
    gone = hits.groupBy("_id").agg(F.bool_and("_f").alias("_all")).where("_all").select("_id")
    return keyed.join(gone, "_id", "left_anti").drop("_id")


def merge_same_label(events: DataFrame, inline_gap: float = 0.5, background_gap: float = 1.5) -> DataFrame:
    """clip_id, label, start_s, end_s, n: pieces of one label that are close together as one."""
    return gap_join(events, F.when(is_inline(F.col("label")), inline_gap).otherwise(background_gap))


def monotone_starts(words: DataFrame) -> DataFrame:
    """words plus at_s: starts made non-decreasing from 0; a null start takes the one before."""
    upto = Window.partitionBy("clip_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return words.withColumn("at_s", F.greatest(F.lit(0.0), F.coalesce(F.max("start_s").over(upto), F.lit(0.0))))


def tags(words: DataFrame, events: DataFrame, times: bool = False) -> DataFrame:
    """clip_id, t, prio, text: an opening tag for every merged event and a closing one for background sounds around words.

    Words and the events' ends are one series ordered by time: an event
    overlaps a word if, of the words that start before its end, the farthest
    end lies after its start.
    """
    spans = words.select("clip_id", F.coalesce("start_s", F.lit(0.0)).alias("_at"), F.lit(1).alias("_w"), F.coalesce("end_s", "start_s", F.lit(0.0)).alias("_e"))
    ends = events.select("clip_id", F.col("end_s").alias("_at"), F.lit(0).alias("_w"), "label", "start_s", "end_s")
    by_time = Window.partitionBy("clip_id").orderBy("_at", "_w")
    far, last = (F.max("_e").over(by_time.rowsBetween(Window.unboundedPreceding, end)) for end in (0, Window.unboundedFollowing))
    rows = spans.unionByName(ends, allowMissingColumns=True).select("*", far.alias("_far"), last.alias("_last")).where("_w = 0")
    core = F.concat("label", F.format_string(" %.2f-%.2f", "start_s", "end_s")) if times else F.col("label")
    inline = is_inline(F.col("label"))
    opening = F.struct(F.col("start_s").alias("t"), F.lit(0).alias("prio"), F.when(inline, F.concat(F.lit("["), core, F.lit("]"))).otherwise(F.concat(F.lit("<"), core, F.lit(">"))).alias("text"))
    closing = F.struct(F.col("end_s").alias("t"), F.lit(2).alias("prio"), F.concat(F.lit("</"), "label", F.lit(">")).alias("text"))
    closes = ~inline & F.col("clip_id").isNotNull() & (F.col("end_s") + TAIL < F.col("_last")) & (F.col("_far") > F.col("start_s"))
    return rows.select("clip_id", F.inline(F.when(closes, F.array(opening, closing)).otherwise(F.array(opening))))


def _series(words: DataFrame, marks: DataFrame) -> DataFrame:
    """clip_id, t, prio, text, is_word, slot: words and marks in one series, each with the number of words before it."""
    w = monotone_starts(words).select("clip_id", F.col("at_s").alias("t"), F.lit(1).alias("prio"), F.col("word").alias("text"), F.lit(1).alias("is_word"), "pos")
    both = w.unionByName(marks.select("clip_id", "t", "prio", "text", F.lit(0).alias("is_word")), allowMissingColumns=True)
    upto = Window.partitionBy("clip_id").orderBy("t", "prio", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return both.select("clip_id", "t", "prio", "text", "is_word", (F.sum("is_word").over(upto) - F.col("is_word")).alias("slot"))


def slotted(words: DataFrame, marks: DataFrame) -> DataFrame:
    """marks plus slot: before which word each stands - as many words as start before it, or up to it for closing tags.

    An as-of join as one sort: words and marks in one series ordered by time,
    words counted as they pass.
    """
    return _series(words, marks).where("is_word = 0").select("clip_id", "t", "prio", "text", "slot")


def tokens(words: DataFrame, marks: DataFrame) -> DataFrame:
    """clip_id, seq, token: words in their order with the tags slotted between, a repeated tag once."""
    own = words.where(F.length(F.trim("word")) > 0).withColumn("word", F.trim("word"))
    rows = _series(own, marks).select("clip_id", "slot", "is_word", F.round("t", 3).alias("t"), "prio", F.col("text").alias("token"))
    order = Window.partitionBy("clip_id").orderBy("slot", "is_word", "t", "prio", "token")
    rows = rows.select("clip_id", "token", F.lag("token").over(order).alias("_before"), F.row_number().over(order).alias("seq"))
    repeated = (F.col("token") == F.col("_before")) & F.substring("token", 1, 1).isin("[", "<")
    return rows.where(F.col("_before").isNull() | ~repeated).select("clip_id", "seq", "token")


def rich_transcript(words: DataFrame, events: DataFrame, times: bool = False, inline_gap: float = 0.5, background_gap: float = 1.5) -> DataFrame:
    """clip_id, transcript: words with [tags] for speakers' sounds and <tags> ... </tags> around words for background."""
    own = words.where(F.length(F.trim("word")) > 0)
    rows = tokens(own, tags(own, merge_same_label(events, inline_gap, background_gap), times))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"]), " ")
    return rows.groupBy("clip_id").agg(line.alias("transcript"))


def words_from_recogniser(raw: DataFrame) -> DataFrame:
    """Recogniser words: without a start they go, without an end they last 0.3 s."""
    return raw.where("start_s is not null").withColumn("end_s", F.coalesce("end_s", F.col("start_s") + 0.3))


def placed_between(words: DataFrame, marks: DataFrame, durations: DataFrame) -> DataFrame:
    """marks (clip_id, label, k) plus g0, g1: from the end of word k - 1 (0 before the first) to the start of word k (the clip's end after the last)."""
    spans = words.select("clip_id", F.col("pos").alias("k"), "start_s", "end_s")
    before = spans.select("clip_id", (F.col("k") + 1).alias("k"), F.col("end_s").alias("g0"))
    after = spans.select("clip_id", "k", F.col("start_s").alias("g1"))
    out = marks.join(before, ["clip_id", "k"], "left").join(after, ["clip_id", "k"], "left").join(durations, "clip_id")
    return out.select("clip_id", "label", "k", F.coalesce("g0", F.lit(0.0)).alias("g0"), F.coalesce("g1", "duration").alias("g1"))


INLINE_LABELS = sorted(INLINE)
