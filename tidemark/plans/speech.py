"""Queries over words, labels and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators import transcript as tr
from . import tables as t
from .frames import _GAP
from .registry import query


def _literal(value) -> str:
    return "null" if value is None else "'" + str(value).replace("'", "''") + "'"


def case_of(rules: list, text: str, otherwise) -> str:
    """Ordered rules as a CASE expression."""
    return "case " + " ".join(f"when regexp_matches({text}, {_literal(p)}) then {_literal(v)}" for p, v in rules) + f" else {_literal(otherwise)} end"


_PLAIN = "trim(regexp_replace(regexp_replace(lower(tag), '[<>\\[\\]_]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TAGS = "tags as (select distinct p_name || ' <' || p_type || '_' || n_name || '>' as tag from part join nation on p_partkey % 25 = n_nationkey union select distinct '<' || p_name || ' cricket>' from part)"


def _tags(spark, sf_dir):
    p = t.read(spark, sf_dir, "part")
    n = t.read(spark, sf_dir, "nation")
    a = p.join(n, F.col("p_partkey") % 25 == F.col("n_nationkey")).select(F.concat("p_name", F.lit(" <"), "p_type", F.lit("_"), "n_name", F.lit(">")).alias("tag"))
    return a.union(p.select(F.concat(F.lit("<"), "p_name", F.lit(" cricket>")).alias("tag"))).distinct()


@query(f"with {_TAGS} select tag, {case_of(tx.TAG_RULES, _PLAIN, tx.DROP)} as label from tags")
def label_canonicalize(spark, sf_dir):
    return _tags(spark, sf_dir).select("tag", tx.canon_tag(F.col("tag")).alias("label"))


@query(f"with {_TAGS} select tag, {case_of(tx.ONTOLOGY_RULES, 'lower(tag)', None)} as label from tags")
def ontology_canonicalize(spark, sf_dir):
    return _tags(spark, sf_dir).select("tag", tx.canon_ontology(F.col("tag")).alias("label"))


_MAP = {"signup": "sigh", "error": None, "click": "click", "view": "horn"}


@query("select case event_type when 'signup' then 'sigh' when 'click' then 'click' when 'view' then 'horn' else null end as label, event_type in ('error') as known_ignored, count(*) as n from events group by all")
def label_map_counts(spark, sf_dir):
    e = t.read(spark, sf_dir, "events")
    return e.groupBy(tx.mapped(F.col("event_type"), _MAP).alias("label"), F.col("event_type").isin("error").alias("known_ignored")).agg(F.count(F.lit(1)).alias("n"))


@query("""with s as (select p_partkey, len(regexp_extract_all(lower(p_name), '[a-z'']*[a-z][a-z'']*')) as a, len(regexp_extract_all(lower(p_brand), '[a-z'']*[a-z][a-z'']*')) as b from part)
select p_partkey, 'laugh' as label, cast(a as integer) as k from s union all select p_partkey, 'breath', cast(a + b as integer) from s""")
def emoji_tokenize(spark, sf_dir):
    p = t.read(spark, sf_dir, "part").withColumn("text", F.concat("p_name", F.lit(" 🤣 "), "p_brand", F.lit("🌬")))
    return p.select("p_partkey", F.explode(tx.emoji_tokens(F.col("text"))).alias("x")).select("p_partkey", "x.label", "x.k")


_FILLER = "trim(lower(word), ' .,!?') in (" + ", ".join(map(_literal, tr.FILLER_WORDS + tr.LAUGH_WORDS + ["la", "die", "the", "de"])) + ")"


@query(t.with_tables("words", "sounds") + ", w as (select clip_id, start_s, end_s, trim(lower(word), ' .,!?') in (" + ", ".join(map(_literal, tr.FILLER_WORDS + tr.LAUGH_WORDS)) + """) as filler from (select clip_id, start_s, end_s, case when word in ('la', 'die', 'the', 'de') then 'um' else word end as word from words))
select clip_id, label, round(start_s, 6) as start_s, round(end_s, 6) as end_s from sounds s where not coalesce((select bool_and(filler) from w where w.clip_id = s.clip_id and w.start_s < s.start_s + 5e-1 and w.end_s > s.start_s), false)""")
def suppress_all_filler(spark, sf_dir):
    w = t.words(spark, sf_dir).withColumn("word", F.when(F.col("word").isin("la", "die", "the", "de"), "um").otherwise(F.col("word")))
    s = t.sounds(spark, sf_dir).withColumn("full", F.col("end_s")).withColumn("end_s", F.col("start_s") + 0.5)
    kept = tr.suppress_spoken(w, s)
    return kept.select("clip_id", "label", F.round("start_s", 6).alias("start_s"), F.round("full", 6).alias("end_s"))


@query(t.with_tables("words", "sounds") + _GAP.format(gap="(case when label in ('cough', 'laugh') then 5e-1 else 15e-1 end)", rows="sounds"))
def merge_same_label(spark, sf_dir):
    return tr.merge_same_label(t.sounds(spark, sf_dir, t.turns_by_clip(spark, sf_dir))).withColumn("start_s", F.round("start_s", 6)).withColumn("end_s", F.round("end_s", 6))


_SHIFTED = "w as (select clip_id, pos, word, start_s - case when pos % 4 = 3 then 1e0 else 0e0 end as start_s, end_s from words)"


def _shifted(spark, sf_dir, turns=None):
    return t.words(spark, sf_dir, turns).withColumn("start_s", F.col("start_s") - F.when(F.col("pos") % 4 == 3, 1.0).otherwise(0.0))


@query(t.with_tables("words") + f", {_SHIFTED} select clip_id, pos, round(greatest(0e0, coalesce(max(start_s) over (partition by clip_id order by pos), 0e0)), 6) as at_s from w")
def monotone_starts(spark, sf_dir):
    return tr.monotone_starts(_shifted(spark, sf_dir, t.turns_by_clip(spark, sf_dir))).select("clip_id", "pos", F.round("at_s", 6).alias("at_s"))


_STARTS = f"{_SHIFTED}, st as (select clip_id, greatest(0e0, coalesce(max(start_s) over (partition by clip_id order by pos), 0e0)) as at_s from w where trim(word) <> '')"


@query(t.with_tables("words", "sounds") + f""", {_STARTS}, m as (select clip_id, start_s as t, 0 as prio, label from sounds union all select clip_id, end_s, 2, label from sounds)
select clip_id, round(t, 6) as t, prio, label as text, (select count(*) from st where st.clip_id = m.clip_id and (st.at_s < m.t or (m.prio = 2 and st.at_s = m.t))) as slot from m""")
def asof_slot(spark, sf_dir):
    turns = t.turns_by_clip(spark, sf_dir)
    s = t.sounds(spark, sf_dir, turns)
    marks = s.select("clip_id", F.col("start_s").alias("t"), F.lit(0).alias("prio"), F.col("label").alias("text")).union(s.select("clip_id", "end_s", F.lit(2), "label"))
    w = _shifted(spark, sf_dir, turns).where("trim(word) <> ''")
    return tr.slotted(w, marks).select("clip_id", F.round("t", 6).alias("t"), "prio", "text", "slot")


_TOKENS = f""", {_STARTS.replace("from w where", "from w where")},
own as (select clip_id, row_number() over (partition by clip_id order by pos) - 1 as slot, trim(word) as token, start_s, end_s from w where trim(word) <> ''),
f as (select *, case when start_s - max(end_s) over (partition by clip_id, label order by start_s, end_s rows between unbounded preceding and 1 preceding) <= (case when label in ('cough', 'laugh') then 5e-1 else 15e-1 end) then 0 else 1 end as fresh from sounds),
g as (select clip_id, label, min(start_s) as s, max(end_s) as e from (select *, sum(fresh) over (partition by clip_id, label order by start_s, end_s rows between unbounded preceding and current row) as island from f) group by clip_id, label, island),
lw as (select clip_id, max(coalesce(end_s, start_s, 0e0)) as last_end from own group by clip_id),
m as (select clip_id, s as t, 0 as prio, case when label in ('cough', 'laugh') then '[' || label || ']' else '<' || label || '>' end as token from g
  union all select g.clip_id, e, 2, '</' || label || '>' from g join lw using (clip_id) where label not in ('cough', 'laugh') and e + 3e-1 < last_end
    and exists (select 1 from own where own.clip_id = g.clip_id and coalesce(start_s, 0e0) < g.e and coalesce(end_s, start_s, 0e0) > g.s)),
seq as (select clip_id, (select count(*) from st where st.clip_id = m.clip_id and (st.at_s < m.t or (m.prio = 2 and st.at_s = m.t))) as slot, 0 as is_word, round(t, 3) as t, prio, token from m
  union all select clip_id, slot, 1, 0e0, 1, token from own),
num as (select clip_id, token, lag(token) over o as before, row_number() over o as seq from seq window o as (partition by clip_id order by slot, is_word, t, prio, token)),
fin as (select * from num where before is null or not (token = before and left(token, 1) in ('[', '<')))"""


@query(t.with_tables("words", "sounds") + _TOKENS + " select clip_id, count(*) as n, count(*) filter (where left(token, 1) in ('[', '<')) as n_tags from fin group by clip_id")
def dedup_consecutive(spark, sf_dir):
    turns = t.turns_by_clip(spark, sf_dir)
    own = _shifted(spark, sf_dir, turns).where("trim(word) <> ''")
    rows = tr.tokens(own, tr.tags(own, tr.merge_same_label(t.sounds(spark, sf_dir, turns))))
    return rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.substring("token", 1, 1).isin("[", "<")).alias("n_tags"))


@query(t.with_tables("words", "sounds") + _TOKENS + " select clip_id, string_agg(token, ' ' order by seq) as transcript from fin group by clip_id")
def rich_transcript(spark, sf_dir):
    turns = t.turns_by_clip(spark, sf_dir)
    return tr.rich_transcript(_shifted(spark, sf_dir, turns), t.sounds(spark, sf_dir, turns))


@query(t.with_tables("words") + " select clip_id, pos, round(start_s, 6) as start_s, round(case when pos % 5 = 0 then start_s + 3e-1 else end_s end, 6) as end_s from words where start_s is not null")
def recogniser_words(spark, sf_dir):
    raw = t.words(spark, sf_dir).withColumn("end_s", F.when(F.col("pos") % 5 != 0, F.col("end_s")))
    return tr.words_from_recogniser(raw).select("clip_id", "pos", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(t.with_tables("words") + """, sp as (select clip_id, pos, pos * 4e-1 as s, pos * 4e-1 + 3e-1 as e from words), d as (select clip_id, max(e) + 1e0 as duration from sp group by clip_id),
m as (select clip_id, 'cough' as label, pos as k from words where pos % 6 = 0 union all select clip_id, 'sigh', count(*) from words group by clip_id)
select m.clip_id, m.label, m.k, round(coalesce(a.e, 0e0), 6) as g0, round(coalesce(b.s, d.duration), 6) as g1 from m join d using (clip_id) left join sp a on a.clip_id = m.clip_id and a.pos = m.k - 1 left join sp b on b.clip_id = m.clip_id and b.pos = m.k""")
def event_placement(spark, sf_dir):
    w = t.words(spark, sf_dir).withColumn("start_s", F.col("pos") * F.lit(0.4)).withColumn("end_s", F.col("pos") * F.lit(0.4) + 0.3)
    durations = w.groupBy("clip_id").agg((F.max("end_s") + 1.0).alias("duration"))
    marks = w.where("pos % 6 = 0").select("clip_id", F.lit("cough").alias("label"), F.col("pos").cast("long").alias("k")).unionByName(w.groupBy("clip_id").agg(F.count(F.lit(1)).alias("k")).select("clip_id", F.lit("sigh").alias("label"), "k"))
    return tr.placed_between(w, marks, durations).withColumn("g0", F.round("g0", 6)).withColumn("g1", F.round("g1", 6))
