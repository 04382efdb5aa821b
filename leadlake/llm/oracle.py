"""DuckDB twins of those registered queries that SQL can express."""

from __future__ import annotations

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
with d as (select doc_id, {_TERMS} as w from documents),
 b as (select item_id, w, least(13, len(w)) as n from (select item_id, {_TERMS} as w from benchmark) where len(w) > 0),
 windows as (select distinct item_id, n, w[i : i + n - 1] as x from (select *, unnest(range(1, len(w) - n + 2)) as i from b)),
 starts as (select doc_id, n, i, w[i : i + n - 1] as x
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from windows))),
 hits as (select doc_id, s.n, i, item_id from starts s join windows v on v.n = s.n and v.x = s.x),
 covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
 listed as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, item_id::varchar as item from hits) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
 sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join listed using (doc_id)"""


_FINE = "len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: floor(256 * x::double)::bigint)"

HARD_NEGATIVES = f"""
with u as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_WHOLE} as v
  from embeddings where label is not null and embedding is not null and {_FINE}),
 scored as (select a.id as anchor, a.label as al, c.id, c.label as cl, sum(x.a * x.c)::bigint as score
  from u a join u c on a.id % 100 = 0 and a.id <> c.id, unnest(list_zip(a.v, c.v)) as z(x0), lateral (select x0[1] as a, x0[2] as c) x
  group by all),
 positives as (select anchor, id as positive, score as p from scored where al = cl
  qualify row_number() over (partition by anchor order by score desc, id) <= 5),
 ranked as (select anchor, positive, p, id, score, row_number() over (partition by anchor, positive order by score desc, id) as rank
  from positives join scored using (anchor) where al <> cl and 80 * p <= 100 * score and 100 * score <= 100 * p)
select anchor as anchor_id, positive as positive_id, rank::int as rank, id as negative_id, p as positive_score, score as negative_score
from ranked where rank <= 5"""

_SQUARED = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"


def _assigned(n: int) -> str:
    return f"""a{n} as (select id, v, (arg_min(c, struct_pack(d, c))) as c, min(d) as d
  from (select x.id, x.v, c.c, {_SQUARED} as d from u x, c{n} c) group by id, v)"""


def _moved(n: int) -> str:
    mean = "(s - ((s % m) + m) % m) // m"  # floor, below zero too
    return f"""c{n + 1} as (select o.c, coalesce(m.v, o.v) as v from c{n} o left join
  (select c, list({mean} order by k) as v from (select c, k, sum(x)::bigint as s, count(*) as m
   from (select c, unnest(v) as x, generate_subscripts(v, 1) as k from a{n}) group by c, k) group by c) m using (c))"""


_ROUNDS = ",\n ".join(f"{_assigned(n)},\n {_moved(n)}" for n in range(5))

CENTROIDS = f"""
with u as materialized (select vec_id as id, {_WHOLE} as v from embeddings where len(embedding) = 64 and {_FINE}),
 c0 as (select row_number() over (order by sha256('2:' || id)) - 1 as c, v from u order by sha256('2:' || id) limit 40),
 {_ROUNDS},
 {_assigned(5)}
select a.id as vec_id, a.c::int as cluster, a.d as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia,
 (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c5.v, ',')) as centroid_sha256
from a5 a join c5 on a.c = c5.c"""


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": DECONTAMINATION, "op12_hard_negatives": HARD_NEGATIVES, "op13_centroid_clustering": CENTROIDS}
