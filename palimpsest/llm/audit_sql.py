"""SQL that the filter audit and the centroid clusters must agree with."""

from __future__ import annotations


def filters_sql() -> str:
    """Masks of failed filters per document, all orders by recursion, counts over masks."""
    return """
with recursive d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (
  select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws, min(doc_id) over (partition by t) as smallest from d),
good as (select distinct doc_id from labels where quality = 1), bad as (select distinct doc_id from labels where toxic = 1),
m as (
  select part, g.doc_id is not null as good, b.doc_id is not null as toxic,
    (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int
    + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(w.doc_id > smallest, false)::int as mask
  from w left join good g on g.doc_id = w.doc_id left join bad b on b.doc_id = w.doc_id),
c as (select part, mask, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic from m group by part, mask),
orders as (
  select '' as filter_order, 0 as used
  union all
  select filter_order || chr((65 + i)::int), (used + (1 << i::int))::int from orders, range(5) r(i) where used & (1 << i::int) = 0),
steps as (
  select o.filter_order, s.step::int as step, ascii(substr(o.filter_order, s.step::int, 1)) - 65 as f,
    coalesce(list_sum(list_transform(range(1, s.step), lambda i: 1 << (ascii(substr(o.filter_order, i::int, 1)) - 65))), 0)::int as before
  from orders o, range(1, 6) s(step) where length(o.filter_order) = 5),
one as (
  select part, filter_order, step, f,
    sum(n) filter (mask & before = 0 and mask & (1 << f) = 0) as kept,
    sum(n) filter (mask & before = 0 and mask & (1 << f) <> 0) as removed,
    sum(n) filter (mask & before <> 0 and mask & (1 << f) <> 0) as redundant,
    sum(n) filter (mask = 1 << f) as unique_fails,
    sum(n_good) filter (mask & before = 0 and mask & (1 << f) <> 0) as good_lost,
    sum(n_toxic) filter (mask & before = 0 and mask & (1 << f) <> 0) as toxic_lost
  from c, steps group by part, filter_order, step, f)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  sum(coalesce(removed, 0)) over (partition by part, f)::bigint as shapley
from one"""


def clusters_sql(rounds: int = 3, k: int = 16) -> str:
    """All distances of every round, in whole numbers."""
    ctes = [f"""v as (
  select row_number() over () as rid, vec_id, list_transform(embedding::double[], lambda x: floor(64 * x)::bigint) as q from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select row_number() over (order by h nulls last, q) - 1 as cluster, q from (select *, sha256('1:' || vec_id) as h from v) order by h nulls last, q limit {k})"""]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} as (
  select rid, vec_id, q, d, cluster from (
    select v.rid, v.vec_id, v.q, c{i}.cluster, list_sum(list_transform(list_zip(v.q, c{i}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, c{i})
  qualify row_number() over (partition by rid order by d, cluster) = 1)""")
        if i < rounds:
            ctes.append(f"""m{i} as (
  select cluster, j, sum(x) as s, count(*) as n from (select cluster, unnest(q) as x, generate_subscripts(q, 1) as j from a{i}) group by cluster, j),
n{i} as (select cluster, list((case when s % n < 0 then (s - s % n) // n - 1 else (s - s % n) // n end)::bigint order by j) as q from m{i} group by cluster),
c{i + 1} as (select c{i}.cluster, coalesce(n{i}.q, c{i}.q) as q from c{i} left join n{i} using (cluster))""")
    return f"""with {", ".join(ctes)}
select vec_id, cluster::int as cluster, d as distance, sum(d) over (partition by cluster)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
  sha256(array_to_string(c{rounds}.q, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (cluster)"""
