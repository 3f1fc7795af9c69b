"""Queries over frames and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import frames as fr
from . import tables as t
from .registry import query

_MEDIAN = """, n as (select clip_id, label, count(*) as n from fs group by all),
refl as (select fs.clip_id, fs.label, fs.frame, n.n, ((fs.frame + k) % (2 * n.n) + 2 * n.n) % (2 * n.n) as m from fs join n using (clip_id, label), range(-2, 3) r(k)),
smooth as (select refl.clip_id, refl.label, refl.frame, quantile_cont(fs.p, 5e-1) as p from refl join fs on fs.clip_id = refl.clip_id and fs.label = refl.label and fs.frame = case when m < n then m else 2 * n - 1 - m end group by all)"""
_RUNS = """, low as (select clip_id, label, frame, p, frame - row_number() over (partition by clip_id, label order by frame) as island from smooth where p > 6e-1 * 7e-1),
island as (select clip_id, label, min(frame) as s, max(frame) + 1 as e from low group by clip_id, label, island having max(p) > 7e-1),
flagged as (select *, case when (s - lag(e) over (partition by clip_id, label order by s)) * 4e-2 <= (case when label in ('c0', 'c1', 'c2') then 3e-1 else 1e0 end) then 0 else 1 end as fresh from island),
joined as (select clip_id, label, min(s) as s, max(e) as e from (select *, sum(fresh) over (partition by clip_id, label order by s) as g from flagged) group by clip_id, label, g having (max(e) - min(s)) * 4e-2 >= 15e-2)"""


@query(t.with_tables("fs") + _MEDIAN + " select clip_id, label, frame, p from smooth")
def frame_median_smooth(spark, sf_dir):
    return fr.median_smooth(t.frame_scores(spark, sf_dir))


@query(t.with_tables("fs") + _MEDIAN + _RUNS + " select j.clip_id, j.label, round(j.s * 4e-2, 2) as start_s, round(j.e * 4e-2, 2) as end_s, round(avg(p), 2) as prob from joined j join smooth m on m.clip_id = j.clip_id and m.label = j.label and m.frame >= j.s and m.frame < j.e group by j.clip_id, j.label, j.s, j.e")
def hysteresis_events(spark, sf_dir):
    smooth = fr.median_smooth(t.frame_scores(spark, sf_dir))
    thresholds = smooth.sparkSession.range(10).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("label"), F.lit(0.7).alias("thr"), (F.col("id") < 3).alias("inline"))
    return ev.as_seconds(ev.hysteresis(smooth, thresholds))


@query(t.with_tables("fs") + """, w as (select clip_id // 8 as rec, (clip_id % 8) * 16 + frame as frame, p from fs),
grid as (select rec, unnest(range(0, 180)) as frame from (select distinct rec from w))
select rec as clip_id, 'all' as label, cast(g.frame as integer) as frame, round(coalesce(m.p, 0), 9) as p from grid g left join (select rec, frame, avg(p) as p from w group by all) m using (rec, frame)""")
def window_overlap_avg(spark, sf_dir):
    e = t.read(spark, sf_dir, "embeddings")
    windows = e.select(F.floor(F.col("vec_id") / 8).alias("clip_id"), F.lit("all").alias("label"), ((F.col("vec_id") % 8) * 16).cast("int").alias("first"), F.transform("embedding", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + x.cast("double")))).alias("scores"))
    lengths = windows.select("clip_id").distinct().withColumn("n_frames", F.lit(180))
    return fr.overlap_average(windows, lengths).withColumn("p", F.round("p", 9))


@query(t.with_tables("ev") + """ select distinct clip_id, label, cast(unnest(range(greatest(0, cast(floor(s / 4e-2) as integer) - 1), least(250, cast(floor(e / 4e-2) as integer) + 2))) as integer) as frame
from (select clip_id, label, start_s / 1e4 as s, end_s / 1e4 as e from ev)""")
def frame_targets(spark, sf_dir):
    e = t.events(spark, sf_dir).withColumn("start_s", F.col("start_s") / 1e4).withColumn("end_s", F.col("end_s") / 1e4)
    return fr.target_frames(e, 250)


@query(t.with_tables("fs") + ", d as (select clip_id, label, frame, max(case when p > 78e-2 then 1 else 0 end) over (partition by clip_id, label order by frame rows between 4 preceding and 4 following) = 1 as near_hit from fs) select clip_id, label, count(*) as frames, count(*) filter (where near_hit) as near from d group by all")
def dilate_hits(spark, sf_dir):
    d = fr.dilate_hits(t.frame_scores(spark, sf_dir).withColumn("hit", F.col("p") > 0.78), 4)
    return d.groupBy("clip_id", "label").agg(F.count(F.lit(1)).alias("frames"), F.count_if("near_hit").alias("near"))


@query(t.with_tables("fs") + """, d as (select clip_id, label, frame, max(case when p > 75e-2 then 1 else 0 end) over (partition by clip_id, label order by frame rows between 2 preceding and 2 following) as hit from fs),
r as (select clip_id, label, min(frame) as start, max(frame) + 1 as stop from (select *, frame - row_number() over (partition by clip_id, label order by frame) as g from d where hit = 0) group by clip_id, label, g having count(*) >= 5)
select clip_id, label, start, stop from r qualify row_number() over (partition by clip_id, label order by stop - start desc, start) = 1""")
def longest_clean_run(spark, sf_dir):
    return fr.longest_clean_run(t.frame_scores(spark, sf_dir).withColumn("hit", F.col("p") > 0.75), 2, 5)


@query(t.with_tables("fs") + " select clip_id, label, round(quantile_cont(p, 1e-1), 9) as floor from fs group by all")
def noise_floor_p10(spark, sf_dir):
    return fr.noise_floor(t.frame_scores(spark, sf_dir)).withColumn("floor", F.round("floor", 9))


@query(t.with_tables("fs") + ", f as (select *, quantile_cont(p, 1e-1) over w as q, max(p) over w as m from fs window w as (partition by clip_id, label)) select clip_id, label, min(frame) as first, max(frame) as last from f where p > greatest(q + 2e-1, m - 15e-2) group by all")
def active_frame_span(spark, sf_dir):
    return fr.active_span(t.frame_scores(spark, sf_dir), rise=0.2, drop=0.15)


@query(t.with_tables("fs") + """, f as (select *, quantile_cont(p, 1e-1) over (partition by clip_id, label) as q from fs), a as (select * from f where p > q + 25e-2),
g as (select *, case when frame - lag(frame) over (partition by clip_id, label order by frame) - 1 <= 2 then 0 else 1 end as fresh from a),
r as (select clip_id, label, min(frame) as start, max(frame) + 1 as stop, sum(p - q) as energy from (select *, sum(fresh) over (partition by clip_id, label order by frame) as run from g) group by clip_id, label, run)
select clip_id, label, start, stop, round(energy, 6) as energy from r qualify row_number() over (partition by clip_id, label order by round(energy, 9) desc, start) = 1""")
def loudest_run(spark, sf_dir):
    return fr.loudest_run(t.frame_scores(spark, sf_dir), rise=0.25, gap=2).withColumn("energy", F.round("energy", 6))


@query(t.with_tables("fs") + " select clip_id, label, (frame + 40) % 64 as frame, p from fs")
def circular_shift(spark, sf_dir):
    return fr.rolled(t.frame_scores(spark, sf_dir), 40, 64)


@query("select doc_id as clip_id, cast(unnest(range(0, n_chars - 800 + 1, 800)) as integer) as start, cast(unnest(range(0, n_chars - 800 + 1, 800)) + 800 as integer) as stop from documents where n_chars >= 800")
def fixed_chunks(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id"), F.col("n_chars").cast("int").alias("length"))
    return fr.fixed_chunks(d, 800).drop("length")


@query(t.with_tables("clips") + " select file, clip_id, cast(duration * 100 as bigint) as length, cast(coalesce(sum(cast(duration * 100 as bigint)) over (partition by file order by clip_id rows between unbounded preceding and 1 preceding), 0) as bigint) as offset_at from clips")
def concatenated_offsets(spark, sf_dir):
    c = t.clips(spark, sf_dir).select(F.col("file").alias("clip_id"), F.col("clip_id").alias("part"), F.round(F.col("duration") * 100).cast("long").alias("length"))
    return fr.concatenated(c, "part").select(F.col("clip_id").alias("file"), F.col("part").alias("clip_id"), "length", F.col("offset").alias("offset_at"))


@query(t.with_tables("ev") + ", m as (select id, clip_id, label, start_s + case when start_s >= 40000 then 3600 else 0 end as start_s, least(86400e0, end_s + case when start_s >= 40000 then 3600 else 0 end) as end_s from ev) select id, clip_id, label, round(start_s, 6) as start_s, round(end_s, 6) as end_s from m where end_s - start_s >= 60")
def silence_inserted(spark, sf_dir):
    e = fr.silence_inserted(t.events(spark, sf_dir), 40000.0, 3600.0, 86400.0, 60.0)
    return e.select("id", "clip_id", "label", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


_GAP = """, f as (select *, case when start_s - max(end_s) over (partition by clip_id, label order by start_s, end_s rows between unbounded preceding and 1 preceding) <= {gap} then 0 else 1 end as fresh from {rows}),
g as (select *, sum(fresh) over (partition by clip_id, label order by start_s, end_s rows between unbounded preceding and current row) as island from f)
select clip_id, label, round(min(start_s), 6) as start_s, round(max(end_s), 6) as end_s, count(*) as n from g group by clip_id, label, island"""


@query(t.with_tables("ev") + _GAP.format(gap="600", rows="ev"))
def gap_join_events(spark, sf_dir):
    return ev.gap_join(t.events(spark, sf_dir), F.lit(600)).withColumn("start_s", F.round("start_s", 6)).withColumn("end_s", F.round("end_s", 6))


@query(t.with_tables("ev") + " select id, clip_id, label from ev a where end_s - start_s >= 5000 and exists (select 1 from ev b where b.end_s - b.start_s < 5000 and b.clip_id = a.clip_id and b.label = a.label and a.start_s < b.end_s and a.end_s > b.start_s)")
def interval_overlap_semi(spark, sf_dir):
    e = t.events(spark, sf_dir)
    return ev.overlapping(e.where("end_s - start_s >= 5000"), e.where("end_s - start_s < 5000")).select("id", "clip_id", "label")


_COUNTS = """, a as (select * from ev where end_s - start_s >= 5000), b as (select * from ev where end_s - start_s < 5000),
gt as (select label, count(*) as gt, count(*) filter (where exists (select 1 from b where b.clip_id = a.clip_id and b.label = a.label and a.start_s < b.end_s and a.end_s > b.start_s)) as gt_found from a group by label),
pr as (select label, count(*) as pred, count(*) filter (where exists (select 1 from a where b.clip_id = a.clip_id and b.label = a.label and a.start_s < b.end_s and a.end_s > b.start_s)) as pred_ok from b group by label)"""


@query(t.with_tables("ev") + _COUNTS + " select coalesce(gt.label, pr.label) as label, coalesce(gt, 0) as gt, coalesce(gt_found, 0) as gt_found, coalesce(pred, 0) as pred, coalesce(pred_ok, 0) as pred_ok, round(gt_found / nullif(gt, 0), 9) as recall, round(pred_ok / nullif(pred, 0), 9) as precision, round(coalesce(2 * (gt_found / gt) * (pred_ok / pred) / nullif(gt_found / gt + pred_ok / pred, 0), 0), 9) as f1 from gt full join pr on gt.label = pr.label")
def overlap_eval(spark, sf_dir):
    from ..operators import metrics

    e = t.events(spark, sf_dir)
    out = metrics.event_scores(ev.overlap_counts(e.where("end_s - start_s >= 5000"), e.where("end_s - start_s < 5000")))
    return out.select("label", "gt", "gt_found", "pred", "pred_ok", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "f1")])


@query(t.with_tables("ev") + " select id, cast(floor(greatest(0e0, start_s - 3e-2) * 16000) as bigint) as a, cast(floor((end_s + 3e-2) * 16000) as bigint) as z from ev where end_s - start_s between 15e-2 and case when label in ('view', 'click') then 300e0 else 800e0 end")
def crop_slices(spark, sf_dir):
    e = t.events(spark, sf_dir)
    ok = ev.crop_ok(F.col("end_s") - F.col("start_s"), F.col("label").isin("view", "click"), longest_inline=300.0, longest=800.0)
    return ev.cropped(e.where(ok)).select("id", "a", "z")


@query(t.with_tables("ev") + """, s as (select id, greatest(0e0, start_s - 3e-1) as b, greatest(0e0, 86400e0 - end_s - 3e-1) as c, end_s from ev)
select id, round(case when b >= c then 0 else end_s + 3e-1 end, 6) as bed_s, round(case when b >= c then 0 else end_s + 3e-1 end + least(greatest(b, c), 10e0), 6) as bed_e from s where greatest(b, c) >= 2""")
def speech_beds(spark, sf_dir):
    e = ev.speech_bed(t.events(spark, sf_dir).withColumn("duration", F.lit(86400.0)))
    return e.select("id", F.round("bed_s", 6).alias("bed_s"), F.round("bed_e", 6).alias("bed_e"))


@query("""with f as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hours then 0 else 1 end as fresh from events),
g as (select *, sum(fresh) over (partition by user_id order by ts, fresh desc rows unbounded preceding) as s from f) select user_id, min(ts) as start_ts, count(*) as n from g group by user_id, s""")
def session_gap_batch(spark, sf_dir):
    e = t.read(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start_ts"), "n")


@query("""with e as (select event_type, value, epoch_us(ts) as us from events), w as (select event_type, value, (us // 7200000000 - k) * 7200000000 as start_us from e, range(4) r(k))
select event_type, start_us, count(*) as n, round(sum(value), 2) as total from w group by all""")
def sliding_window_avg(spark, sf_dir):
    e = t.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = e.groupBy("event_type", F.window("ts", "8 hours", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', w.start) * 1000000")
    return out.select("event_type", start.alias("start_us"), "n", "total")
