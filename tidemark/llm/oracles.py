"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import mixing
from .quality_rules import ALPHA, DELTA, GRID, RULES

_URL = r"""
with rules(verdict, host, path) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut),
fits as (select p.page_id, p.host, p.path, r.host || r.path as rule, r.verdict from parts p left join rules r
  on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits
qualify row_number() over (partition by page_id order by length(rule) desc nulls last) = 1
"""

_RULES = {"symbols": "1e2 * n_symbols / greatest(word_chars, 1)", "dup_lines": "1e2 * n_dup_lines / greatest(n_lines, 1)"}
_QUALITY = (
    r"""
with d as (select doc_id, coalesce(lang, '(none)') as stratum, coalesce(text, '') as t from documents),
w as (select doc_id, stratum, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
win as (select doc_id, unnest(range(1, len(ws) - 6)) as i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) as s from w where len(ws) > 8),
many as (select doc_id, i from win qualify count(*) over (partition by doc_id, s) > 1),
rep as (select doc_id, count(distinct i + k) as n from many, range(8) r(k) group by doc_id),
st as (select w.doc_id, stratum, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words from w left join rep on rep.doc_id = w.doc_id),
s as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, """
    + ", ".join(f"{_RULES[r]} as f_{r}" for r in RULES)
    + """ from st),
marks as (select doc_id, min(quality) = 1 as good from labels where quality is not null group by doc_id),
lab as (select * from s join marks using (doc_id) where not base_failed),
grid as (select i - 1 as step, ["""
    + ", ".join(map(str, GRID))
    + "][i] as cutoff from range(1, "
    + str(len(GRID) + 1)
    + """) g(i)),
tests as ("""
    + " union all ".join(f"select stratum, '{r}' as rule, step, cutoff, count(*) filter (where good) as n, count(*) filter (where good and f_{r} >= cutoff) as x, count(*) filter (where not good) as nb, count(*) filter (where not good and f_{r} >= cutoff) as xb from lab, grid group by all" for r in RULES)
    + f"""),
tails as (select *, case when x >= n * {ALPHA / len(RULES)}::double then 1e0 else list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA / len(RULES)}::double) + (n - i) * ln(1 - {ALPHA / len(RULES)}::double)))) end
  <= {DELTA}::double / {len(RULES)} / (select count(distinct stratum) from lab) as ok from tests),
cuts as (select stratum, rule, cutoff from (select *, min(case when not ok then step end) over (partition by stratum, rule) as failed from tails) where ok and (failed is null or step < failed) and xb * n > x * nb
  qualify row_number() over (partition by stratum, rule order by xb * n - x * nb desc, cutoff desc) = 1),
v as (select s.*, case when base_failed then 'base' """
    + " ".join(f"when f_{r} >= (select cutoff from cuts where cuts.stratum = s.stratum and rule = '{r}') then '{r}'" for r in RULES)
    + """ end as reason from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason is null as kept, reason from v
"""
)

_MIXING = rf"""
with d as (select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as size, md5('{mixing.SEED}:' || doc_id) as h from documents),
src as (select source, sum(size)::bigint as source_size, count(*) as n_rows, (row_number() over (order by source nulls last) - 1) % 3 + 1e0 as weight from d group by source),
lev as (select *, {mixing.REPEATS}e0 * source_size as cap, (sum(source_size) over () - coalesce(sum({mixing.REPEATS}e0 * source_size) over (o rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (o rows between current row and unbounded following) as y from src window o as (order by {mixing.REPEATS}e0 * source_size / weight, source nulls last)),
tgt as (select source, source_size, coalesce(least(cap, weight * (select y from lev where y <= cap / weight order by cap / weight, source nulls last limit 1)), cap)::double as target,
  greatest(ceil((source_size + 1) / {mixing.SHARD_WORDS}), ceil(n_rows / {mixing.SHARD_ROWS}))::bigint as n_shards from lev),
rws as (select doc_id, d.source, size, h, source_size, target, ('0x' || substr(h, 1, 7))::bigint % n_shards as shard from d join tgt on d.source is not distinct from tgt.source),
sh as (select source, source_size, target, shard, sum(size)::bigint as words, ceil(sum(size) / {mixing.BLOCK})::bigint as nb from rws group by all),
bs as (select source, sum(nb)::bigint as blocks, case when source_size > 0 then target / source_size * sum(nb) else 0e0 end as share from sh group by source, source_size, target),
seats as (select round(sum(round(share * 4096)) / 4096)::bigint as n from bs),
q1 as (select source, row_number() over (order by share / (2 * k + 1) desc, source nulls last, k) as r from (select *, unnest(range({mixing.REPEATS} * blocks)) as k from bs where share > 0)),
sq as (select source, count(*) as quota from q1 where r <= (select n from seats) group by source),
q2 as (select s.source, shard, coalesce(sq.quota, 0) as seats, row_number() over (partition by s.source order by nb / (2 * k + 1) desc, shard, k) as r
  from (select *, unnest(range({mixing.REPEATS} * nb)) as k from sh) s left join sq on s.source is not distinct from sq.source),
quo as (select source, shard, count(*) as quota from q2 where r <= seats group by all),
str as (select rws.*, words, greatest(nb, 1) as b, coalesce(quota, 0) as quota, sum(size) over (partition by rws.source, rws.shard order by h, size rows between unbounded preceding and current row) as e,
  ('0x' || substr(md5('{mixing.SEED + 1}:' || (rws.source is null)::int || ':' || coalesce(rws.source, '') || ':' || rws.shard), 1, 7))::bigint % greatest(nb, 1) as f
  from rws join sh on rws.source is not distinct from sh.source and rws.shard = sh.shard left join quo on rws.source is not distinct from quo.source and rws.shard = quo.shard),
cut as (select *, e - size as s, quota % b as rest, floor(f * words / b) as a1, floor(least(f + quota % b, b) * words / b) as z1, floor(greatest(f + quota % b - b, 0) * words / b) as z2 from str)
select doc_id, size::bigint as size, source_size, target, (floor(quota / b) * size + greatest(0, least(e, z1) - greatest(s, a1)) + greatest(0, least(e, z2) - s))::bigint as taken from cut
"""

SQL = {"op5_url_filter": _URL, "op7_quality_rules": _QUALITY, "op10_mixing": _MIXING}
