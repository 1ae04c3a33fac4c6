"""SQL that the Jaccard join and the licence, mixing and URL queries must agree with."""

from __future__ import annotations

from palimpsest.llm import licenses, mixing, url_filter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def licence_sql() -> str:
    return f"""
with d as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
tok as (select rid, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos from d),
notices(label, template, phrase) as (values {_values([(k, t, p) for k, (t, p) in licenses.TEMPLATES.items()])}),
tw as (select label, unnest(string_split(template, ' ')) as word, generate_subscripts(string_split(template, ' '), 1) - 1 as pos,
         len(string_split(template, ' ')) as n,
         len(string_split(substr(template, 1, position(' ' || phrase || ' ' in ' ' || template || ' ')), ' ')) - 1 as key_from,
         len(string_split(phrase, ' ')) as key_n
       from notices),
df as (select word, count(distinct rid) as files from tok where word in (select word from tw) group by word),
ranked as (
  select label, word, files, row_number() over (partition by label order by files, word) as place from (select distinct label, word, files from tw join df using (word))),
in_key as (
  select label, word, files, row_number() over (partition by label order by files, word) as place
  from (select distinct label, word, files from tw join df using (word) where pos >= key_from and pos < key_from + key_n)),
rare as (
  select label, word, files from ranked where place <= {licenses.INDEXED} union select label, word, files from in_key where place <= {licenses.AGREEING}),
postings as (select tw.label, tw.word, tw.pos from tw join rare using (label, word)),
looked as (
  select rid, word from (
    select *, row_number() over (partition by rid order by files, word) as place
    from (select distinct rid, word, files from tok join (select distinct word, files from rare) using (word)))
  where place <= {licenses.LOOKED_UP}),
hits as (select tok.rid, postings.label, tok.pos - postings.pos as place from tok join looked using (rid, word) join postings using (word)),
candidates as (select rid, label, place from hits group by all having count(*) >= {licenses.AGREEING}),
found as (
  select c.rid, c.label, c.place, count(tok.word) as same, any_value(tw.n) as n
  from candidates c join tw using (label) left join tok on tok.rid = c.rid and tok.pos = c.place + tw.pos and tok.word = tw.word
  group by all having count(tok.word) filter (tw.pos >= tw.key_from and tw.pos < tw.key_from + tw.key_n) = any_value(tw.key_n)),
phrases(phrase, label) as (values {_values(list(licenses.BASE.items()))}),
pw as (select label, unnest(string_split(phrase, ' ')) as word, generate_subscripts(string_split(phrase, ' '), 1) - 1 as i, len(string_split(phrase, ' ')) as n
       from phrases),
places as (select rid, label, tok.pos - i as spot from tok join pw using (word) group by rid, label, tok.pos - i, n having count(*) = n),
base as (select rid, count(*) as n_base, min(spot) as first_word, max(spot) as last_word, string_agg(distinct label, ',' order by label) as base_labels
         from places group by rid),
every as (select rid, string_agg(distinct label, ',' order by label) as labels
          from (select rid, label from places union select rid, label from found) group by rid),
best as (select rid, max(same / n::double) as share from found group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, case when n_base > 0 then 1.0 else coalesce(share, 0) end::double as score
from d left join base using (rid) left join every using (rid) left join best using (rid)"""


def mixing_sql() -> str:
    weight = "case (row_number() over (order by source nulls last) - 1) % {n} {cases} end".format(
        n=len(mixing.WEIGHTS), cases=" ".join(f"when {i} then {w}" for i, w in enumerate(mixing.WEIGHTS)))
    return f"""
with w as (select doc_id, avg(quality) + 0.25 as weight from labels where doc_id is not null and quality is not null group by doc_id),
d as (
  select d.doc_id, d.source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint + 1) / {2**52}::double)
      / coalesce(w.weight, {mixing.UNLABELLED}::double) as key
  from documents d left join w using (doc_id)),
s as (select source, sum(size)::bigint as source_size from d group by source),
n as (select *, ({weight})::double as weight, source_size * {mixing.MOST_EPOCHS} as most from s),
o as (
  select *, ((sum(source_size) over ())::double
      - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
      / sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as level,
    row_number() over (order by most / weight, source nulls last) as place
  from n),
f as (select min(place) as place from o where level * weight <= most),
t as (select source, source_size, case when o.place < f.place or f.place is null then most::double
        else least((select level from o where place = f.place) * weight, most::double) end as target from o, f),
e as (select *, case when source_size > 0 then least(floor(target / source_size), {mixing.MOST_EPOCHS}) else 0 end::bigint as epochs from t),
r as (
  select d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
    (sum(d.size) over (partition by d.source order by d.key))::double as upto, (sum(d.size) over (partition by d.source, d.key))::double as block
  from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, ((epochs + case when rest > 0 and rest - (upto - block) > block / 2 then 1 else 0 end) * size)::bigint as taken
from r"""


def url_sql(rules: list[tuple[str, str, str]]) -> str:
    rate, chance = "a / (a + b)", "above * (1 - above)"

    def level(name: str, source: str) -> str:
        return f"""
{name}_in as ({source}),
{name}_weight as (
  select 1 / least({url_filter.MOST_RHO}, greatest({url_filter.LEAST_RHO}, coalesce(
    sum((bad - n * above) ** 2 - n * {chance}) / nullif(sum(n * (n - 1) * {chance}), 0), {url_filter.MOST_RHO}))) - 1 as weight from {name}_in),
{name} as (select *, weight * above + bad as a, weight * (1 - above) + n - bad as b from {name}_in, {name}_weight)"""

    return f"""
with outcome as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels where doc_id is not null group by doc_id),
cut as (select row_number() over () as rid, page_id, url, case when url is not null and instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest
        from pages),
p as (
  select rid, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
q as (select p.*, bad from p left join outcome on outcome.doc_id = try_cast(regexp_extract(path, '/([0-9]+)([.]html)?/?$', 1) as bigint)),
hosts as (
  select host, count(bad)::double as n, coalesce(sum(bad), 0)::double as bad, regexp_extract(host, '([^.]*[.])?[^.]*$', 0) as domain,
    regexp_extract(host, '[^.]*$', 0) as suffix from q group by host),
whole as (select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) as mean from hosts),
{level("s", "select suffix, sum(n) as n, sum(bad) as bad, any_value(mean) as above from hosts, whole group by suffix")},
{level("m", f"select x.suffix, x.domain, x.n, x.bad, {rate} as above from (select suffix, domain, sum(n) as n, sum(bad) as bad from hosts group by all) x "
            "join s using (suffix)").replace("join s using", "join (select suffix, a, b from s) z using")},
{level("h", f"select x.host, x.n, x.bad, {rate} as above from hosts x join (select domain, a, b from m) z using (domain)")},
judged as (select host, a / (a + b) - {url_filter.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from h),
rules(rule_host, rule_path, given) as (values {_values(rules)}),
fits as (
  select rid, arg_max(struct_pack(rule := rule_host || rule_path, given := given), (length(rule_host || rule_path), rule_host || rule_path)) as best
  from p join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by rid)
select page_id, host, path, best.rule as rule, coalesce(best.given, case when bound > {url_filter.MAX_BAD} then 'block' else 'allow' end) as verdict
from p left join fits using (rid) left join judged using (host)"""


def jaccard_sql() -> str:
    return f"""
with recursive d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
s as (
  select distinct rid, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle from d),
n as (select rid, count(*) as n from s group by rid),
c as (select a.rid as a, b.rid as b, count(*) as common from s a join s b on a.shingle = b.shingle and a.rid <> b.rid group by all),
l as (select a, b from c join n x on x.rid = a join n y on y.rid = b where 100 * common >= 75 * (x.n + y.n - common)),
r(rid, reached) as (select rid, rid from d union select r.rid, l.b from r join l on l.a = r.reached)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(o.doc_id) as component_id
from r join d using (rid) join d o on o.rid = r.reached left join n on n.rid = d.rid group by d.rid, d.doc_id"""
