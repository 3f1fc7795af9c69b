"""Queries over quotas, coverage and top-k selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quotas as qu
from . import tables as t
from .registry import query


@query(t.with_tables("clips") + " select clip_id, src, split from clips where duration between 5 and 60 qualify row_number() over (partition by src, split order by rg, row) <= case when split = 'train' then 20 else 2 end")
def quota_first_n(spark, sf_dir):
    out = qu.first_n(t.clips(spark, sf_dir), ["src", "split"], ["rg", "row"], qu.validation_cap(F.col("split"), 20), F.col("duration").between(5, 60))
    return out.select("clip_id", "src", "split")


@query(t.with_tables("ev") + " select id, clip_id, label from (select *, count(*) over (partition by label order by clip_id range between unbounded preceding and 1 preceding) as n from ev) where n < 100")
def quota_per_clip(spark, sf_dir):
    return qu.per_clip(t.events(spark, sf_dir), ["label"], "clip_id", F.lit(100)).select("id", "clip_id", "label")


@query(t.with_tables("clips") + """, e as (select *, duration < 10 as is_empty, row_number() over (partition by src, duration < 10 order by clip_id) as e from clips),
r as (select *, row_number() over (partition by src order by clip_id) as r from e where not is_empty or e <= 3) select clip_id, src, is_empty from r where r <= 30""")
def quota_coupled(spark, sf_dir):
    out = qu.coupled(t.clips(spark, sf_dir), ["src"], "clip_id", F.col("duration") < 10, 30)
    return out.select("clip_id", "src", (F.col("duration") < 10).alias("is_empty"))


@query(t.with_tables("clips") + " select rg, count(*) filter (where label = 'de') as de, count(*) filter (where label = 'en') as en, count(*) filter (where label = 'es') as es, count(*) filter (where label = 'fr') as fr from clips group by rg")
def rowgroup_class_matrix(spark, sf_dir):
    return qu.group_matrix(t.clips(spark, sf_dir), ["rg"], "label", ["de", "en", "es", "fr"])


#: Picks one by one: pairs (rg, label) must come before; need and counts are lists by label.
_COVER = """, labels as (select list(distinct label order by label) as ls from pairs), per as (select rg, label, count(*) as n from pairs group by all),
m as (select g.rg, list(coalesce(n, 0)::double order by l) as v from (select distinct rg from pairs) g cross join (select unnest(ls) as l from labels) left join per on per.rg = g.rg and label = l group by g.rg),
w as (select list(1 / greatest(1, least({cap}, n)) order by label) as w from (select label, count(*) as n from pairs group by label)),
r as (select 0 as ord, list_transform(w, lambda x: {cap}e0) as need, []::integer[] as picked, null::integer as rg, null::double as gain from w
  union all select ord + 1, list_transform(range(1, len(v) + 1), lambda i: greatest(need[i] - v[i], 0)), list_append(picked, x.rg), x.rg, x.gain from
  (select *, row_number() over (order by round(gain, 9) desc, rg) as k from (select r.ord, r.need, r.picked, m.rg, m.v, list_sum(list_transform(range(1, len(v) + 1), lambda i: least(v[i], need[i]) * w.w[i])) as gain from r, m, w where r.ord < {budget} and not list_contains(r.picked, m.rg))) x where k = 1 and gain > 0)"""


@query(t.with_tables("clips").replace("with ", "with recursive ", 1) + ", pairs as (select rg, label from clips where split = 'train')" + _COVER.format(cap=60, budget=12) + " select rg, cast(ord - 1 as integer) as pick_ord, round(gain, 9) as gain from r where ord > 0")
def greedy_cover(spark, sf_dir):
    return qu.greedy_cover(t.clips(spark, sf_dir).where("split = 'train'"), "rg", "label", 60, 12).withColumn("gain", F.round("gain", 9))


_LABELS = "case when duration >= 20 then 'long' else 'short' end"


@query(t.with_tables("clips").replace("with ", "with recursive ", 1) + f", pairs as (select rg, unnest([label, {_LABELS}]) as label from clips)" + _COVER.format(cap=40, budget=8) + """,
val as (select rg, row_number() over (order by count(*) desc, rg) as k from clips where split = 'val' and rg not in (select rg from r where ord > 0) group by rg)
select rg, cast(ord - 1 as integer) as pick_ord from r where ord > 0 union all select rg, cast((select count(*) from r where ord > 0) + k - 1 as integer) from val where k <= 3""")
def rowgroups_selected(spark, sf_dir):
    clips = t.clips(spark, sf_dir).withColumn("labels", F.array("label", F.expr(_LABELS)))
    return qu.select_rowgroups(clips, ["rg"], "labels", 40, 8, 3)


@query(t.with_tables("clips") + " select rg, count(*) as n_val from clips where split = 'val' and rg not in (select rg from clips group by rg having max(duration) > 100) group by rg order by n_val desc, rg limit 5")
def topn_val_groups(spark, sf_dir):
    c = t.clips(spark, sf_dir)
    return qu.top_groups(c, ["rg"], c.groupBy("rg").agg(F.max("duration").alias("d")).where("d > 100"), 5)


@query(t.with_tables("clips") + " select clip_id, src from clips where duration between 5 and 12 qualify row_number() over (partition by src order by clip_id) <= 2")
def example_selection(spark, sf_dir):
    return qu.head_of(t.clips(spark, sf_dir).where("duration between 5 and 12"), ["src"], ["clip_id"], 2).select("clip_id", "src")


@query(t.with_tables("clips") + " select a.clip_id, a.file, a.rg, a.row, b.duration from clips a join clips b on a.file = b.file and a.rg = b.rg and a.row = b.row where a.duration between 5 and 20")
def decode_planned_rows(spark, sf_dir):
    c = t.clips(spark, sf_dir)
    plan = c.where("duration between 5 and 20").select("clip_id", "file", "rg", "row")
    return plan.join(c.select("file", "rg", "row", "duration"), ["file", "rg", "row"]).select("clip_id", "file", "rg", "row", "duration")
