"""Shared pieces of the DuckDB side: fixture CTEs and text expressions, written independently of the Spark code."""

from __future__ import annotations

LINES = """
la as (select doc_id as pair_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos,
              unnest(string_split(text, chr(10))) as line from documents),
lh as (select *, (pair_id * 7 + pos * 3) % 17 as h from la),
lb0 as (select pair_id, pos, 0 as sub, case when h = 5 then 'edited ' || line else line end as line from lh where h <> 3
        union all select pair_id, pos, 1, 'inserted ' || pos from lh where h = 11),
lb as (select pair_id, row_number() over (partition by pair_id order by pos, sub) - 1 as pos, line from lb0),
lines as (select pair_id, 'A' as side, pos, line from la union all select pair_id, 'B', pos, line from lb)
"""

OUTLINE_A = """
oraw as (
 select r_regionkey as pair_id, -1 as nat, '' as seg, 0 as rank, 0 as key, 'heading' as type, 1 as level,
        (r_regionkey + 1) || ' ' || r_name as text from region
 union all select n_regionkey, n_nationkey, '', 1, 0, 'heading', 2,
        case when n_nationkey % 7 = 6 then '' when n_nationkey % 11 = 10 then 'Revision history ' || n_nationkey
             else (n_regionkey + 1) || '.' || n_nationkey || ' ' || n_name end from nation
 union all select distinct n_regionkey, n_nationkey, c_mktsegment, 0, -1, 'heading', 3, 'Segment ' || c_mktsegment
        from customer join nation on c_nationkey = n_nationkey
 union all select n_regionkey, n_nationkey, c_mktsegment, 1, c_custkey, 'paragraph', null,
        c_name || ' ,balance ' || cast(floor(c_acctbal) as bigint) || ' ;active'
        from customer join nation on c_nationkey = n_nationkey
 union all select n_regionkey, n_nationkey, '', 2, s_suppkey, 'paragraph', null,
        s_name || ' owes ' || cast(floor(s_acctbal) as bigint) from supplier join nation on s_nationkey = n_nationkey),
oa as (select cast(pair_id as bigint) as pair_id,
              cast(row_number() over (partition by pair_id order by nat, seg, rank, key) - 1 as int) as ord,
              type, level, text from oraw)
"""

OUTLINE = OUTLINE_A + """,
oh as (select *, (pair_id * 7 + ord * 3) % 17 as h from oa),
ob0 as (select pair_id, ord, 0 as sub, type,
               case when type = 'heading' and h = 8 then level + 1 else level end as level,
               case when h = 5 and text <> '' then 'edited ' || text
                    when h = 13 and text <> '' then 'wholly different words ' || ord else text end as text
        from oh where h <> 3
        union all select pair_id, ord, 1, 'paragraph', null, 'inserted ' || ord from oh where h = 11),
ob as (select pair_id, cast(row_number() over (partition by pair_id order by ord, sub) - 1 as int) as ord, type, level,
              text from ob0),
onodes as (select *, 'n' || lpad(cast(ord as varchar), 9, '0') as uid from (
        select pair_id, 'A' as side, ord, type, level, text from oa
        union all select pair_id, 'B', ord, type, level, text from ob))
"""

CELLS = """
li as (select l_orderkey as ok, l_partkey, l_suppkey, cast(floor(l_quantity) as bigint) as qty,
              cast(floor(l_extendedprice) as bigint) as price, l_returnflag || l_linestatus as flag, l_returnflag,
              cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity,
                   l_extendedprice, l_shipdate) as int) as r from lineitem),
lib as (select ok, l_partkey, l_suppkey, case when (ok + r) % 9 = 4 then qty + 1 else qty end as qty, price, flag,
               qty > 40 as wide, cast(row_number() over (partition by ok order by r) as int) as r
        from li where (ok + r) % 9 <> 2),
hd as (select o_orderkey as ok from orders),
cells as (
 select ok as pair_id, side, 't' || ok as table_uid, anchor_row, anchor_col, 1 as row_span, col_span, text from (
  select ok, 'A' as side, 0 as anchor_row, c as anchor_col, 1 as col_span,
         ['part', 'supplier', 'quantity', 'price', 'flag'][c + 1] as text from hd, range(5) t(c)
  union all select ok, 'B', 0, c, 1, case when c = 3 and ok % 5 = 0 then 'amount' else
         ['part', 'supplier', 'quantity', 'price', 'flag'][c + 1] end from hd, range(5) t(c)
         where not (c = 4 and ok % 7 = 0)
  union all select ok, 'A', r, c, case when c = 4 and qty > 40 then 2 else 1 end,
         ['part ' || l_partkey, 'supplier ' || l_suppkey, cast(qty as varchar), cast(price as varchar), flag][c + 1]
         from li, range(5) t(c)
  union all select ok, 'B', r, c, case when c = 4 and wide then 2 else 1 end,
         ['part ' || l_partkey, 'supplier ' || l_suppkey, cast(qty as varchar), cast(price as varchar), flag][c + 1]
         from lib, range(5) t(c) where not (c = 4 and ok % 7 = 0)))
"""

IMAGES = """
im as (select vec_id, side,
        sha256(label || ':' || (vec_id % 200 + case when side = 'B' and vec_id % 5 = 0 then 1000 else 0 end)) as sha256,
        [list_sum([case when (embedding[w * 16 + d + 1] > 0) <>
             (side = 'B' and w = 0 and d < case vec_id % 3 when 0 then 1 when 1 then 5 else 0 end)
             then (1 << d) else 0 end for d in range(16)]) for w in range(4)] as words,
        (vec_id % 40) * 9525 * 3 + case when side = 'B' then 100 else 0 end as width_emu,
        (vec_id % 30) * 9525 + 4762 as height_emu
       from embeddings, (values ('A'), ('B')) s(side))
"""

JOBLOG = """
jl as (select event_id % 5000 as job_id, 'u' || user_id as username, ts, event_id,
        case when event_type = 'signup' then 'queued' when event_type = 'view' then 'processing'
             when event_type in ('click', 'purchase') then 'done' else 'error' end as status,
        value > 50 as files_deleted from events)
"""

# invisible characters, space variants and soft breaks as code points
_DROP = [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD, 0x0C, 0x1C, 0x1D, 0x1E]
_SPACE = [0xA0, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x202F, 0x3000]
_BREAK = [0x0B, 0x2028, 0x2029]


def _cls(points) -> str:
    return "[" + "".join("\\x{%x}" % p for p in points) + "]"


WS = ("[\\s\\x{b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}"
      "\\x{3000}]+")


def base(e: str, br: str = "' '") -> str:
    e = f"regexp_replace({e}, '{_cls(_BREAK)}', {br}, 'g')"
    e = f"regexp_replace({e}, '{_cls(_DROP)}', '', 'g')"
    e = f"regexp_replace({e}, '{_cls(_SPACE)}', ' ', 'g')"
    e = f"regexp_replace({e}, '\\r\\n|\\r|\\n', {br}, 'g')"
    return f"replace({e}, chr(9), ' ')"


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}', ' ', 'g'))"


def norm_text(e: str) -> str:
    return squeeze(base(e))


def norm_sig(e: str) -> str:
    e = squeeze(base(e))
    e = f"regexp_replace({e}, '\\s*([,;])\\s*([^\\s])', '\\1 \\2', 'g')"
    e = f"regexp_replace({e}, '\\s+([,;])$', '\\1')"
    e = f"regexp_replace({e}, '\\(\\s+', '(', 'g')"
    e = f"regexp_replace({e}, '\\s+\\)', ')', 'g')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def norm_diff(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace({norm_sig(e)}, '\\s*([,;])\\s*', ' \\1 ', 'g'), '\\s+', ' ', 'g'))"


def norm_align(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace({norm_sig(e)}, '[,;]\\s*', ' ', 'g'), '\\s+', ' ', 'g'))"


def norm_match(e: str) -> str:
    return f"lower({squeeze(e)})"


def short_md5(e: str, n: int = 16) -> str:
    return f"case when {e} = '' then 'empty' else substr(md5({e}), 1, {n}) end"


def with_(*parts: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",\n".join(p.strip() for p in parts) + "\n"

_SKIPS = ["muc luc", "mục lục", "table of contents", "目次", "ly lich sua doi", "lý lịch sửa đổi", "revision history",
          "change history", "document history", "改訂履歴"]
_MARKS = ["tiep trang sau", "tiếp trang sau", "continued on next page", "continue on next page", "次ページに続く"]


def has_any(e: str, words) -> str:
    return "(" + " or ".join(f"contains({e}, '{w}')" for w in words) + ")"


def skip_section(e: str) -> str:
    return has_any(norm_match(e), _SKIPS)


def skip_mark(e: str) -> str:
    return has_any(norm_match(e), _MARKS)


# rows outside skipped sections: a skipped heading rules until the next heading of its level or above
KEPT = f"""
rawh as (select pair_id, side, ord, level, text from onodes where type = 'heading'),
skp as (select h.pair_id, h.side, h.ord, (select min(x.ord) from rawh x where x.pair_id = h.pair_id and x.side = h.side
           and x.ord > h.ord and x.level <= h.level) as until from rawh h where {skip_section('h.text')}),
kept as (select n.* from onodes n where not exists (select 1 from skp s where s.pair_id = n.pair_id and s.side = n.side
           and n.ord >= s.ord and n.ord < coalesce(s.until, 2147483647)))
"""
PATHS = """
hs as (select pair_id, side, ord, level, text from kept where type = 'heading' and trim(text) <> ''),
hspan as (select h.*, coalesce((select min(x.ord) from hs x where x.pair_id = h.pair_id and x.side = h.side
           and x.ord > h.ord and x.level <= h.level), 2147483647) as until from hs h),
pth as (select n.pair_id, n.side, n.ord, string_agg(h.text, ' > ' order by h.ord) as heading_ctx,
           max_by(h.level, h.ord) as heading_level
        from kept n join hspan h on h.pair_id = n.pair_id and h.side = n.side and n.ord >= h.ord and n.ord < h.until
        group by n.pair_id, n.side, n.ord),
ctx as (select n.*, p.heading_ctx, coalesce(p.heading_level, 0) as heading_level
        from kept n left join pth p using (pair_id, side, ord))
"""


def align_sql(items: str, keys: list[str], p: str) -> str:
    """CTEs ending in ``{p}ops``: opcodes of the relation ``items (keys, side, idx, key)`` by recursive splitting.

    Needs WITH RECURSIVE.  Written over explicit matches and their diagonal runs, unlike the Spark side.
    """
    k = ", ".join(keys)

    def on(x, y):
        return " and ".join(f"{x}.{c} = {y}.{c}" for c in keys)

    return f"""
{p}n as (select {k}, cast(count(*) filter (where side = 'A') as bigint) as na,
         cast(count(*) filter (where side = 'B') as bigint) as nb from {items} group by {k}),
{p}m as (select {", ".join("a." + c for c in keys)}, cast(a.idx as bigint) as i, cast(b.idx as bigint) as j
         from {items} a join {items} b on {on("a", "b")} and a.key = b.key where a.side = 'A' and b.side = 'B'),
{p}d as (select *, i - row_number() over (partition by {k}, i - j order by i) as g from {p}m),
{p}r as (select {k}, min(i) as i0, min(j) as j0, count(*) as len from {p}d group by {k}, i - j, g),
{p}t as (
 select {k}, '' as path, cast(0 as bigint) as alo, na as ahi, cast(0 as bigint) as blo, nb as bhi, i0 as i, j0 as j, len as n
 from (select r.*, na, nb, row_number() over (partition by {", ".join("r." + c for c in keys)} order by len desc, i0, j0)
       as rn from {p}r r join {p}n n on {on("r", "n")}) where rn = 1
 union all
 select {k}, path, alo, ahi, blo, bhi, i, j, n from (
  select *, row_number() over (partition by {k}, path order by n desc, i, j) as rn from (
   select {", ".join("c." + x for x in keys)}, c.path, c.alo, c.ahi, c.blo, c.bhi, c.i0 + c.s as i, c.j0 + c.s as j,
          least(c.len - c.s, c.ahi - c.i0 - c.s, c.bhi - c.j0 - c.s) as n
   from (select c0.*, r0.i0, r0.j0, r0.len, greatest(0, c0.alo - r0.i0, c0.blo - r0.j0) as s from (
          select {", ".join("t." + c for c in keys)}, t.path || x.d as path,
            case when d = 'l' then alo else i + n end as alo, case when d = 'l' then i else ahi end as ahi,
            case when d = 'l' then blo else j + n end as blo, case when d = 'l' then j else bhi end as bhi
          from {p}t t, (values ('l'), ('r')) x(d)) c0 join {p}r r0 on {on("c0", "r0")}) c
  ) where n > 0) where rn = 1),
{p}b as (select {k}, i, j, n from {p}t union all select {k}, na, nb, 0 from {p}n),
{p}g as (select *, lag(i + n, 1, 0) over w as pi, lag(j + n, 1, 0) over w as pj from {p}b
         window w as (partition by {k} order by i, j, n desc)),
{p}e as (select *, sum(case when pi = i and pj = j then 0 else 1 end) over (partition by {k} order by i, j, n desc) as isl
         from {p}g),
{p}ops as (
 select {k}, case when pi < i and pj < j then 'replace' when pi < i then 'delete' else 'insert' end as tag,
        cast(pi as int) as i1, cast(i as int) as i2, cast(pj as int) as j1, cast(j as int) as j2
 from {p}g where pi < i or pj < j
 union all select {k}, 'equal', cast(min(i) as int), cast(max(i + n) as int), cast(min(j) as int), cast(max(j + n) as int)
 from {p}e where n > 0 group by {k}, isl)
"""


LINE_BLOCKS = f"""
lnorm as (select pair_id, side, pos, line, {norm_sig("line")} as norm from lines),
lblk as (select pair_id, side, row_number() over (partition by pair_id, side order by pos) - 1 as idx, pos as ord, line, norm,
         'paragraph|P:' || substr(md5('txt:' || norm), 1, 16) as key from lnorm where norm <> '')
"""


def ratio_sql(pairs: str, keys: list[str], p: str) -> str:
    """CTEs ending in ``{p}ratio``: gestalt ratio ``r`` over the characters of the texts ``x`` and ``y`` of ``pairs (keys, x, y)``."""
    k = ", ".join(keys)

    def chars(side: str, text: str) -> str:
        return f"select {k}, '{side}' as side, generate_subscripts(string_split({text}, ''), 1) - 1 as idx, unnest(string_split({text}, '')) as key from {pairs} where x <> y and {text} <> ''"

    return f"{p}ch as ({chars('A', 'x')} union all {chars('B', 'y')}),\n" + align_sql(f"{p}ch", keys, p).strip() + f""",
{p}eq as (select {k}, sum(i2 - i1) as m from {p}ops where tag = 'equal' group by {k}),
{p}ratio as (select {", ".join("o." + c for c in keys)}, case when x = y then 1.0::double else 2.0::double * coalesce(m, 0) / (length(x) + length(y)) end as r
  from {pairs} o left join {p}eq e on {" and ".join(f"o.{c} = e.{c}" for c in keys)})
"""


def greedy_sql(edges: str, keys: list[str], order: str, p: str) -> str:
    """CTEs ending in ``{p}picks``: edges ``(keys, ki, kj)`` in ``order``, each taken if both its ends are still free."""
    k = ", ".join(keys)
    on = " and ".join(f"g.{c} = e.{c}" for c in keys)
    return f"""
{p}rk as (select {k}, ki::int as ki, kj::int as kj, row_number() over (partition by {k} order by {order}) as rn from {edges}),
{p}gr as (
 select distinct {k}, 0::bigint as rn, []::int[] as ua, []::int[] as ub from {p}rk
 union all
 select {", ".join("g." + c for c in keys)}, e.rn, case when list_contains(ua, ki) or list_contains(ub, kj) then ua else list_append(ua, ki) end,
   case when list_contains(ua, ki) or list_contains(ub, kj) then ub else list_append(ub, kj) end
 from {p}gr g join {p}rk e on {on} and e.rn = g.rn + 1),
{p}picks as (select {k}, unnest(ua) as ki, unnest(ub) as kj from (
  select *, row_number() over (partition by {k} order by rn desc) as last from {p}gr) where last = 1)
"""
