"""Queries over scored targets, thresholds and corpus counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as me
from ..operators import reports as rp
from ..operators import splits as sp
from ..operators import thresholds as th
from . import tables as t
from .registry import query

_R = lambda *names: [F.round(n, 9).alias(n) for n in names]

_AP = ", k as (select label, y, row_number() over o as k, sum(y) over (o rows unbounded preceding) as tp from scored window o as (partition by label order by p desc, id)), ap as (select label, cast(sum(y) as bigint) as positives, sum(case when y = 1 then tp / k else 0 end) / greatest(1, sum(y)) as ap from k group by label)"


@query(t.with_tables("scored") + _AP + " select label, positives, round(ap, 9) as ap from ap")
def average_precision(spark, sf_dir):
    return me.average_precision(t.scored(spark, sf_dir)).select("label", "positives", *_R("ap"))


@query(t.with_tables("scored") + _AP + " select label in ('en', 'de') as big, round(avg(case when positives > 0 then ap end), 9) as macro_ap from ap group by all")
def macro_ap(spark, sf_dir):
    ap = me.average_precision(t.scored(spark, sf_dir)).withColumn("big", F.col("label").isin("en", "de"))
    return me.macro_average_precision(ap, ["big"]).select("big", *_R("macro_ap"))


_PRF = "tp / greatest(1, tp + fp) as p, tp / greatest(1, tp + fn) as r"
_F = "round(p, 9) as precision, round(r, 9) as recall, round(2 * p * r / greatest(1e-9, p + r), 9) as f1, round(5 * p * r / greatest(1e-9, 4 * p + r), 9) as f2"
_C = "count(*) filter (where p > {t} and y = 1) as tp, count(*) filter (where p > {t} and y = 0) as fp, count(*) filter (where not p > {t} and y = 1) as fn"


@query(t.with_tables("scored") + f", c as (select label, {_C.format(t='55e-2')} from scored group by label), s as (select *, {_PRF} from c) select label, tp, fp, fn, {_F} from s")
def prf_at_threshold(spark, sf_dir):
    out = me.at_threshold(t.scored(spark, sf_dir), F.lit(0.55))
    return out.select("label", "tp", "fp", "fn", *_R("precision", "recall", "f1", "f2"))


_GRID = "grid as (select i as step, 5e-2 + 25e-3 * i as thr from range(38) g(i))"
_TUNED = f", {_GRID}, c as (select {{k}}, step, thr, {_C.format(t='thr')} from scored, grid group by all), s as (select *, {_PRF} from c), b as (select {{k}}, thr, 2 * p * r / greatest(1e-9, p + r) as f1 from s qualify row_number() over (partition by {{k}} order by round(f1, 12) desc, step) = 1)"


@query(t.with_tables("scored") + _TUNED.format(k="label") + " select label, round(thr, 9) as thr, round(f1, 9) as f1 from b")
def threshold_tune(spark, sf_dir):
    return me.best_threshold(t.scored(spark, sf_dir)).select("label", *_R("thr", "f1"))


_CV = """, folded as (select *, (row_number() over (partition by label order by id) - 1) % 2 as fold from scored),
c as (select label, fold, step, thr, {c} from folded, grid group by all), s as (select *, {prf} from c),
b as (select label, 1 - fold as fold, thr as best from s qualify row_number() over (partition by label, fold order by round(2 * p * r / greatest(1e-9, p + r), 12) desc, step) = 1),
d as (select f.label, f.fold, {d} from folded f join b on f.label = b.label and f.fold = b.fold group by all), e as (select *, {prf} from d)""".format(c=_C.format(t="thr"), prf=_PRF, d=_C.format(t="best"))


@query(t.with_tables("scored") + f", {_GRID}" + _CV + " select label, round(avg(2 * p * r / greatest(1e-9, p + r)), 9) as cv_f1 from e group by label")
def cv_two_fold(spark, sf_dir):
    return me.cross_validated(t.scored(spark, sf_dir)).select("label", *_R("cv_f1"))


@query(t.with_tables("scored") + f", {_GRID}" + _CV + """, cv as (select label, avg(2 * p * r / greatest(1e-9, p + r)) as cv_f1 from e group by label),
n as (select label, cast(sum(y) as bigint) as positives from scored group by label)
select label, positives, positives < 25 or cv_f1 < 1e-1 as weak, case when positives < 25 or cv_f1 < 1e-1 then greatest(5e-1, 9e-1) else 5e-1 end as balanced, case when positives < 25 or cv_f1 < 1e-1 then least(greatest(4e-1, 6e-1), 8e-1) else 4e-1 end as sensitive from n join cv using (label)""")
def weak_clamp(spark, sf_dir):
    s = t.scored(spark, sf_dir)
    report = s.groupBy("label").agg(F.sum("y").alias("positives")).join(me.cross_validated(s), "label").withColumn("balanced", F.lit(0.5)).withColumn("sensitive", F.lit(0.4))
    return me.weak_clamped(report).drop("cv_f1")


@query(t.with_tables("scored") + " select label, round(least(100e0, greatest(1e0, (count(*) - sum(y)) / greatest(sum(y), 1))), 9) as pos_weight from scored group by label")
def pos_weight(spark, sf_dir):
    return t.scored(spark, sf_dir).groupBy("label").agg(F.round(me.positive_weight(F.sum("y"), F.count(F.lit(1))), 9).alias("pos_weight"))


@query(t.with_tables("scored") + f", {_GRID}, c as (select label, step, {_C.format(t='thr')} from scored, grid group by all), s as (select *, {_PRF} from c) select label, step, {_F} from s")
def threshold_curve(spark, sf_dir):
    return me.threshold_table(t.scored(spark, sf_dir)).select("label", "step", *_R("precision", "recall", "f1", "f2"))


@query(t.with_tables("clips") + " select label, cast(count(*) filter (where src = 'src0') as bigint) as src0, cast(count(*) filter (where src = 'src1') as bigint) as src1, cast(count(*) filter (where src = 'src2') as bigint) as src2, false as inline, count(*) filter (where src in ('src0', 'src1', 'src2')) as total from clips where src in ('src0', 'src1', 'src2') group by label")
def class_source_pivot(spark, sf_dir):
    return rp.class_table(t.clips(spark, sf_dir).where(F.col("src").isin("src0", "src1", "src2")), ["src0", "src1", "src2"])


@query(t.with_tables("clips") + " select label, src || '/' || split as part, count(*) as n from clips group by all")
def counts_by_source_split(spark, sf_dir):
    return rp.counts_by(t.clips(spark, sf_dir).withColumn("part", F.concat_ws("/", "src", "split")), "label", "part")


@query(t.with_tables("clips") + " select src as label, row_number() over (order by src) - 1 as idx from (select src, count(*) as n from clips group by src) where n >= 40")
def min_events_classes(spark, sf_dir):
    return rp.class_list(t.clips(spark, sf_dir).select(F.col("src").alias("label")), least=40)


_CRC = "list_reduce(list_concat([4294967295], list_transform(range(1, length({s}) + 1), lambda i: cast(ascii(substr({s}, i, 1)) as bigint))), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))"


@query("with k as (select doc_id, 'shard-' || cast(doc_id // 500 as varchar) || '.parquet/' || cast(doc_id // 50 as varchar) || '/' || cast(doc_id % 50 as varchar) as s from documents) select doc_id, case when xor(" + _CRC.format(s="s") + ", 4294967295) % 100 < 10 then 'val' else 'train' end as split from k")
def hash_split(spark, sf_dir):
    c = t.clips(spark, sf_dir)
    return c.select(F.col("clip_id").alias("doc_id"), sp.train_or_val(sp.row_key(F.col("file"), F.col("rg"), F.col("row"))).alias("split"))


@query("select page_id, regexp_replace(path, '_\\d+\\.wav$', '') as session, trim(string_split_regex(regexp_extract(path, '[^/]*$'), ' _ |_\\d')[1]) as kind, case when string_split(path, '/')[2] in ('dev', 'test') then 'val' else 'train' end as folder from (select page_id, 'x/' || case page_id % 3 when 0 then 'dev' when 1 then 'test' else 'main' end || '/Kind' || cast(page_id % 4 as varchar) || case when page_id % 2 = 0 then ' _ a' else '' end || '_' || cast(page_id as varchar) || '.wav' as path from pages)")
def path_splits(spark, sf_dir):
    i = F.col("page_id")
    path = F.concat(F.lit("x/"), F.when(i % 3 == 0, "dev").when(i % 3 == 1, "test").otherwise("main"), F.lit("/Kind"), (i % 4).cast("string"), F.when(i % 2 == 0, " _ a").otherwise(""), F.lit("_"), i.cast("string"), F.lit(".wav"))
    rows = t.read(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", sp.session_of(F.col("path")).alias("session"), sp.kind_of(F.col("path")).alias("kind"), sp.folder_split(F.col("path")).alias("folder"))


@query("select doc_id, pos, case when pos < floor(n_chars * 8e-1) then 'train' else 'val' end as split from (select doc_id, n_chars, unnest(range(0, n_chars, 500)) as pos from documents)")
def time_split_80_20(spark, sf_dir):
    rows = t.read(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") - 1, F.lit(500).cast("long"))).alias("pos"))
    return rows.select("doc_id", "pos", sp.time_split(F.col("pos"), F.col("n_chars")).alias("split"))


@query("select label, case when label = 'click' then 7e-1 when label in ('view', 'error') then 6e-1 when label = 'purchase' then 5e-1 else 4e-1 end as thr from (select distinct event_type as label from events)")
def threshold_overlay(spark, sf_dir):
    labels = t.read(spark, sf_dir, "events").select(F.col("event_type").alias("label")).distinct()
    table = lambda text: spark.range(1).select(F.explode(th.parse_overrides(F.lit(text))).alias("label", "thr"))
    return th.layered(labels, table("signup=0.4,click=0.4,view=0.3"), table("view=0.6,error=0.6,click=0.65"), table("click=0.7"))


@query("select event_id as id, event_type as label, floor(value / 5) / 1e2 as prob from events where event_type not in ('error') and floor(value / 5) / 1e2 >= 5e-2")
def visible_events(spark, sf_dir):
    e = t.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("label"), (F.floor(F.col("value") / 5) / F.lit(100.0)).alias("prob"))
    return th.visible(e, ["error"], 0.05)


@query(t.with_tables("scored") + ", a as (select label, round(avg(p), 9) as m from scored group by label), b as (select label, round(avg(1 - p), 9) as m from scored where label <> 'es' group by label) select coalesce(a.label, b.label) as label, a.m as m_old, b.m as m_new from a full join b on a.label = b.label")
def model_compare_outer(spark, sf_dir):
    s = t.scored(spark, sf_dir)
    mean = lambda df, p: df.groupBy("label").agg(F.round(F.avg(p), 9).alias("m"))
    return rp.side_by_side(mean(s, F.col("p")), mean(s.where("label <> 'es'"), 1 - F.col("p")), ["m"], ("old", "new"))


@query(t.with_tables("clips") + " select distinct src as label from clips where not exists (select 1 from clips b where b.split = 'val' and b.src = clips.src and b.label = 'en')")
def set_ops_labels(spark, sf_dir):
    c = t.clips(spark, sf_dir).withColumn("lang", F.col("label")).withColumn("label", F.col("src"))
    return rp.unknown_labels(c, c.where("split = 'val' and lang = 'en'"))


@query(t.with_tables("clips") + " select src as store, split, count(*) as items, round(sum(duration) * 16000 / 16000 / 3600, 6) as hours, round(sum(duration) * 16000 * 2 / 1e9, 6) as gb from clips group by rollup (src, split)")
def corpus_rollup(spark, sf_dir):
    c = t.clips(spark, sf_dir).select(F.col("src").alias("store"), "split", (F.col("duration") * 16000).alias("len"))
    return rp.store_statistics(c).withColumn("hours", F.round("hours", 6)).withColumn("gb", F.round("gb", 6))


@query(t.with_tables("clips") + ", a as (select distinct src, label from clips where duration > 60) select clip_id, src, label from clips where exists (select 1 from a where a.src = clips.src and a.label = clips.label)")
def annotated_sources(spark, sf_dir):
    c = t.clips(spark, sf_dir)
    return rp.scored_where_annotated(c.select("clip_id", "src", "label"), c.where("duration > 60"))


@query("select event_id, cast(props::json->>'k' as integer) as k, '{\"k\":' || (props::json->>'k') || '}' as again from events")
def json_props_roundtrip(spark, sf_dir):
    e = t.read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("s"))
    return e.select("event_id", "s.k", F.to_json("s").alias("again"))


@query(t.with_tables("fs") + " select clip_id, label, max(p) as p from fs group by all")
def clip_maxima(spark, sf_dir):
    return rp.clip_maxima(t.frame_scores(spark, sf_dir))


@query("select case when n_chars / 1e2 > 30 then 'too_long' when doc_id % 11 = 0 then 'no_words' when doc_id % 7 = 0 then 'failed' when doc_id % 100 / 1e2 < 35e-2 then 'poor' else 'located' end as outcome, count(*) as n from documents group by all")
def alignment_outcomes(spark, sf_dir):
    i = F.col("doc_id")
    d = t.read(spark, sf_dir, "documents").select((F.col("n_chars") / F.lit(100.0)).alias("duration"), F.when(i % 7 != 0, i % 100 / F.lit(100.0)).alias("score"), F.when(i % 11 == 0, 0).otherwise(5).alias("n_words"))
    return rp.alignment_outcomes(d)


@query("with k as (select distinct 'd' || cast(doc_id // 20 as varchar) as district, doc_id % 3 as q from documents) select district, q, case when q = 0 then 'skip' when xor(" + _CRC.format(s="district") + ", 4294967295) % 100 < 10 then case when q = 1 then 'val' else 'skip' end else 'train' end as split from k")
def district_split(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 20).cast("string")).alias("district"), (F.col("doc_id") % 3).alias("q")).distinct()
    quality = F.when(F.col("q") == 0, "no_timestamps").when(F.col("q") == 1, "verified_timestamps").otherwise("unverified")
    return d.select("district", "q", sp.district_split(F.col("district"), quality).alias("split"))


@query("select event_id, user_id from events where not exists (select 1 from customer where c_custkey = user_id and c_nationkey < 20) and not exists (select 1 from orders where o_custkey = user_id and o_totalprice > 300000)")
def picked_groups_removed(spark, sf_dir):
    e = t.read(spark, sf_dir, "events").select("event_id", "user_id")
    a = t.read(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("user_id"))
    b = t.read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("user_id"))
    return e.join(a, "user_id", "left_anti").join(b, "user_id", "left_anti")
