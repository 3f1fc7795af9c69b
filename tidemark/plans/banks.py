"""Queries over bank plans, sampling and signal frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import dsp
from ..operators import banks, quotas, splits, thresholds
from ..operators import reports as rp
from ..sources import audio
from ..streaming import frames as streams
from . import tables as t
from .registry import query

_KNOWN = ["de", "en", "fr"]
_TAKEN = "count(*) filter (where {e}) over (partition by {k} order by clip_id rows between unbounded preceding and current row) <= {cap}"


@query(t.with_tables("clips") + f""", c as (select *, label in ('de', 'en', 'fr') as mine, split = 'train' as tr from clips),
p as (select clip_id, src, label, split, mine and duration / 4 between 15e-2 and 5 and {_TAKEN.format(e='mine and duration / 4 between 15e-2 and 5', k='src, label, split', cap='case when tr then 24 else 3 end')} as take_event,
  {_TAKEN.format(e='true', k='split', cap='case when tr then 160 else 20 end')} as take_bed, mine and duration <= 20 and {_TAKEN.format(e='mine and duration <= 20', k='src, split', cap='case when tr then 40 else 5 end')} as take_whole from c)
select * from p where take_event or take_bed or take_whole""")
def bank_plan(spark, sf_dir):
    c = t.clips(spark, sf_dir).withColumn("start_s", F.lit(0.0)).withColumn("end_s", F.col("duration") / 4)
    return banks.single_event_plan(c, _KNOWN, ["clip_id"], 24, 160, 40).select("clip_id", "src", "label", "split", "take_event", "take_bed", "take_whole")


@query(t.with_tables("words", "sounds") + ", g as (select clip_id, list(distinct label) as ls from sounds group by clip_id) select clip_id, len(list_filter(ls, lambda x: x not in ('cough', 'laugh', 'bird'))) = 0 as usable from g")
def clips_all_known(spark, sf_dir):
    g = t.sounds(spark, sf_dir).groupBy("clip_id").agg(F.collect_set("label").alias("labels"))
    return g.select("clip_id", banks.all_known(F.col("labels"), ["cough", "laugh", "bird"]).alias("usable"))


@query("select source as kind, coalesce('env/' || nullif(lang, 'es'), 'kind/' || source) as key, count(*) as n, sum(least(n_chars * 100, 80000))::bigint as samples from documents group by all")
def noise_quota_keys(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").withColumn("env", F.expr("nullif(lang, 'es')"))
    return d.groupBy(F.col("source").alias("kind"), banks.noise_key(F.col("source"), F.col("env")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(banks.capped_samples(F.col("n_chars") * 100)).cast("long").alias("samples"))


@query("select avg(m) as m, count(*) as n_labels from (select lang, avg(n_chars)::double / 1e3 as m, count(*) as gt from documents group by lang) where gt >= 200")
def macro_of_frequent(spark, sf_dir):
    scores = t.read(spark, sf_dir, "documents").groupBy("lang").agg((F.avg("n_chars") / 1e3).alias("m"), F.count(F.lit(1)).alias("gt"))
    return banks.macro_of_frequent(scores, ["m"], 200)


@query("with r as (select p_brand as label, round(avg(p_retailprice), 6) as ap, count(*) < 80 as weak from part group by 1) select label, ap, weak, row_number() over (order by ap desc, label) as rank, round(avg(ap) filter (where not weak) over (), 4) as mean_ap from r")
def threshold_report(spark, sf_dir):
    r = t.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg(F.round(F.avg("p_retailprice"), 6).alias("ap"), (F.count(F.lit(1)) < 80).alias("weak"))
    return banks.threshold_report(r).withColumn("mean_ap", F.round("mean_ap", 4))


@query("select label, case when thr is null then 9e-1 else least(thr, 99e-2) end as thr from (select lang as label, nullif(round(avg(n_chars) / 4e3, 3), 0) as thr from documents group by lang)")
def bounded_thresholds(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("label")).agg(F.round(F.avg("n_chars") / 4e3, 3).alias("thr"))
    return d.select("label", thresholds.bounded(F.col("thr")).alias("thr"))


@query(t.with_tables("clips") + " select clip_id, src, unnest(range(3))::integer as copy from clips")
def augmentation_copies(spark, sf_dir):
    return quotas.copies(t.clips(spark, sf_dir).select("clip_id", "src"), 2)


def _pcm(spark, sf_dir):
    """clip_id and pcm: every vector as sixty-four 16-bit samples."""

    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return pd.Series([audio.to_pcm(np.asarray(v, np.float64)) for v in x])

    return t.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), packed("embedding").alias("pcm"))


_SAMPLES = "s as (select vec_id as clip_id, i, (trunc(greatest(-1e0, least(1e0, embedding[i]::double)) * 32767) / 32767)::float::double as x from embeddings, range(1, 65) r(i))"


@query(f"with {_SAMPLES} select clip_id, ((i - 1) // 16)::integer as frame, round(10 * log10(avg(x * x) + 1e-10), 3) as db from s group by all")
def frame_energy(spark, sf_dir):
    db = dsp.on_pcm(_pcm(spark, sf_dir), "clip_id", lambda x: dsp.frame_db(x, 16), "db")
    return db.select("clip_id", F.posexplode("db").alias("frame", "db")).withColumn("db", F.round("db", 3))


@query(f"with {_SAMPLES} select clip_id, round(sqrt(avg(x * x)) + 1e-6, 6) as level from s group by all")
def clip_level(spark, sf_dir):
    return dsp.on_pcm(_pcm(spark, sf_dir), "clip_id", lambda x: np.array([dsp.rms(x)]), "v").select("clip_id", F.round(F.col("v")[0], 6).alias("level"))


@query("select user_id as clip_id, (epoch_us(ts) // 3600000000) * 3600 as start_s, count(*) as n from events group by all")
def tumbling_counts(spark, sf_dir):
    rows = t.read(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', start_ts)")
    return streams.chunk_counts(rows, "1 hour").select("clip_id", start.alias("start_s"), "n")


@query("select source as where_, count(*) as rows, count(*) filter (where nullif(lang, 'es') is null) as undecodable from documents group by all")
def undecodable_by_place(spark, sf_dir):
    d = t.read(spark, sf_dir, "documents").select(F.col("source").alias("where_"), F.expr("nullif(lang, 'es')").alias("blob"))
    return rp.outcomes(d)


@query("select page_id, case when starts_with(regexp_extract(url, '[^/]*$'), 'test') then 'val' else 'train' end as split from pages")
def prefix_splits(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", splits.file_prefix_split(F.col("url")).alias("split"))
