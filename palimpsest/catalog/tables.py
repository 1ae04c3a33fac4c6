"""Tables: texts, signatures, split tables, and table differences."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.catalog import sqlparts as S
from palimpsest.operators import align
from palimpsest.operators import tablediff as td
from palimpsest.operators import tables as tb
from palimpsest.operators.scan import PLAIN, number_rows
from palimpsest.plans import fixtures as fx
from palimpsest.session import cut_lineage, kept_by

BY = ["pair_id", "side"]
PAIR = ["pair_id"]
NORM = f"nc as (select *, {S.norm_text('text')} as t from cells)"


@query("a3_flattened_tables", S.with_(S.CELLS, NORM, """
r as (select pair_id, side, anchor_row, string_agg(t, ' ' order by anchor_col) filter (where t <> '') as rt from nc group by all)""")
       + "select pair_id, side, md5(string_agg(rt, chr(10) order by anchor_row)) as flat from r group by all")
def flattened(spark, sf):
    return tb.flatten_text(fx.order_cells(spark, sf), BY).select(*BY, F.md5("flat").alias("flat"))


@query("a4_table_summary", S.with_(S.CELLS, NORM, """
r as (select pair_id, side, anchor_row, string_agg(t, ' | ' order by anchor_col) filter (where t <> '') as rt, sum(col_span) as w
      from nc group by all)""") + """
select r.pair_id, r.side, md5(string_agg(rt, chr(10) order by anchor_row)) as text, cast(max(anchor_row) + 1 as int) as rows,
 cast(max(w) as int) as cols, any_value(s.ts) as text_set from r join (select pair_id, side,
 md5(array_to_string(list_sort(list(distinct t)), '|')) as ts from nc where t <> '' group by all) s using (pair_id, side)
group by r.pair_id, r.side""")
def summaries(spark, sf):
    return tb.table_summary(fx.order_cells(spark, sf), BY).select(
        *BY, F.md5("text").alias("text"), "rows", "cols", F.md5(F.array_join("text_set", "|")).alias("text_set"))


NESTED = S.CELLS + f"""
, nst as (select *, case when pair_id % 3 > 0 then (pair_id - 1) end as up, 'r' || pair_id || '_' || anchor_row || '_' ||
  anchor_col as uid from cells where side = 'A'),
"""


def nested_cells(spark, sf):
    """Order tables put into each other: every table but each third lies in the first header cell of the one before."""
    c = fx.order_cells(spark, sf, lambda ok: F.floor(ok / 3)).filter("side = 'A'")
    p = F.col("pair_id")

    def uid(pair, r, col):
        return F.concat(F.lit("r"), pair.cast("string"), F.lit("_"), r.cast("string"), F.lit("_"), col.cast("string"))

    return c.select("doc", "pair_id", "table_uid", "anchor_row", "anchor_col", "row_span", "col_span", "text",
                    uid(p, F.col("anchor_row"), F.col("anchor_col")).alias("uid"),
                    F.when(p % 3 > 0, uid(p - 1, F.lit(0), F.lit(0))).alias("parent_cell_uid"))


@query("a2_deep_cell_text", S.with_(S.CELLS, NORM) + """, a as (select pair_id, anchor_row, anchor_col, t from nc where side = 'A'),
 d2 as (select pair_id, string_agg(t, ' ' order by anchor_row, anchor_col) as all_text from a where pair_id % 3 = 2 group by all),
 d1 as (select a.pair_id, string_agg(case when anchor_row = 0 and anchor_col = 0 and d2.all_text is not null
          then t || ' ' || d2.all_text else t end, ' ' order by anchor_row, anchor_col) as all_text
        from a left join d2 on d2.pair_id = a.pair_id + 1 where a.pair_id % 3 = 1 group by all)
select a.pair_id, md5(t || coalesce(' ' || x.all_text, '')) as deep from a
 left join (select * from d2 union all select * from d1) x on x.pair_id = a.pair_id + 1 and a.pair_id % 3 < 2
 where anchor_row = 0 and anchor_col = 0""")
def deep_text(spark, sf):
    c = tb.deep_texts(nested_cells(spark, sf), ["doc", "table_uid"], fx.order_tasks(spark, sf))
    return c.filter("anchor_row = 0 and anchor_col = 0").select("pair_id", F.md5("deep").alias("deep"))


SPANS = S.with_(S.CELLS) + """, sp as (select pair_id, side, anchor_row, anchor_col, case when (pair_id + anchor_row * 2
  + anchor_col) % 5 = 0 then 3 else 1 end as row_span, col_span from cells)"""


def spanning(spark, sf):
    n = (F.col("pair_id") + F.col("anchor_row") * 2 + F.col("anchor_col")) % 5
    return fx.order_cells(spark, sf).withColumn("row_span", F.when(n == 0, 3).otherwise(1))


@query("a6_logical_rows", SPANS + """, x as (select *, unnest(range(anchor_row, anchor_row + row_span)) as r from sp)
select pair_id, side, cast(r as int) as "row", count(*) filter (where r = anchor_row) as n_anchor,
 count(*) filter (where r > anchor_row) as n_spanning from x group by all""")
def logical_rows(spark, sf):
    return tb.row_counts(spanning(spark, sf), BY)


@query("j4_covering_cells", SPANS + """, pr as (select distinct pair_id, side, anchor_row + 1 as "row", anchor_col as col from sp
   where anchor_col in (1, 4))
select p.pair_id, p.side, p."row", count(s.pair_id) as n, coalesce(sum(s.anchor_row * 100 + s.anchor_col), 0)::bigint as which
 from pr p left join sp s on s.pair_id = p.pair_id and s.side = p.side and s.anchor_row <= p."row"
 and p."row" < s.anchor_row + s.row_span and s.anchor_col <= p.col and p.col < s.anchor_col + s.col_span group by all""")
def covering(spark, sf):
    c = spanning(spark, sf).drop("table_uid", "text")
    probes = c.filter("anchor_col in (1, 4)").select(*BY, (F.col("anchor_row") + 1).alias("row"), F.col("anchor_col").alias("col")
                                                     ).distinct()
    hit = tb.covering_cells(probes, c, BY)
    return hit.groupBy(*BY, "row").agg(F.count("anchor_row").alias("n"), F.coalesce(F.sum(
        F.col("anchor_row") * 100 + F.col("anchor_col")), F.lit(0)).cast("bigint").alias("which"))


@query("g8_table_signature", S.with_(S.CELLS) + f""", cs as (select pair_id, side, anchor_row, anchor_col,
  'C:' || substr(md5({S.norm_sig('text')}), 1, 16) as c from cells), rs as (select pair_id, side, anchor_row,
  'R:' || substr(md5(string_agg(c, '|' order by anchor_col)), 1, 16) as r from cs group by all)
select pair_id, side, 'T:' || substr(md5(string_agg(r, '|' order by anchor_row)), 1, 16) as sig from rs group by all""")
def table_signature(spark, sf):
    return tb.table_signatures(fx.order_cells(spark, sf), BY)


ROWKEYS = S.CELLS + """, """ + NORM + """,
rk as (select pair_id, side, anchor_row, array_to_string(list_sort(list(anchor_col || ':T:img0:txt' ||
   case when t = '' then '' else substr(md5(substr(t, 1, 80)), 1, 10) end)), '|') as row_key from nc group by all),
rh as (select pair_id, side, anchor_row, md5(coalesce(nullif(string_agg(t, ' | ' order by anchor_col) filter (where t <> ''), ''),
   '__empty_row_' || anchor_row || '__')) as row_hash from nc group by pair_id, side, anchor_row)"""


@query("g11_row_keys", S.with_(ROWKEYS) + """select pair_id, side, md5(string_agg(row_key, ',' order by anchor_row)) as row_keys
 from rk group by all""")
def row_keys(spark, sf):
    r = tb.row_keys(fx.order_cells(spark, sf), BY)
    return r.groupBy(*BY).agg(F.md5(tb.joined("row_key", ["anchor_row"], ",")).alias("row_keys"))


@query("g12_row_hashes", S.with_(ROWKEYS) + """select pair_id, side, md5(string_agg(row_hash, ',' order by anchor_row)) as hashes
 from rh group by all""")
def row_hashes(spark, sf):
    r = tb.row_hashes(fx.order_cells(spark, sf), BY)
    return r.groupBy(*BY).agg(F.md5(tb.joined("row_hash", ["anchor_row"], ",")).alias("hashes"))


@query("g13_readable_signatures", SPANS + """, x as (select *, unnest(range(anchor_row, anchor_row + row_span)) as r from sp),
 o as (select pair_id, side, r, string_agg('EMPTY:' || anchor_row || ':' || anchor_col || ':' || row_span || 'x' || col_span, '|'
   order by anchor_col) filter (where r = anchor_row) as a, string_agg('SPAN:r' || anchor_row || 'c' || anchor_col || ':' ||
   row_span || 'x' || col_span, '|' order by anchor_row, anchor_col) filter (where r > anchor_row) as s from x group by all)
select pair_id, side, md5(string_agg(coalesce(a, s), ',' order by r)) as sigs from o group by all""")
def readable(spark, sf):
    r = tb.readable_rows(spanning(spark, sf), BY)
    return r.groupBy(*BY).agg(F.md5(tb.joined("row_sig", ["row"], ",")).alias("sigs"))


# ---- grids ----------------------------------------------------------------------------------------------------

@query("w7_merged_cell_grid", S.with_(S.CELLS) + """, lf as (select *, coalesce(l_returnflag = lag(l_returnflag) over
   (partition by ok order by r), false) as cont from li),
 isl as (select *, sum(cast(not cont as int)) over (partition by ok order by r) as g from lf),
 c0 as (select ok, g, min(r) as anchor_row, 0 as anchor_col, count(*) as row_span, 2 as col_span from isl group by ok, g)
select ok, cast(anchor_row as int) as anchor_row, anchor_col, cast(row_span as int) as row_span, col_span from c0
union all select ok, r, 2, 1, case when qty > 40 then 2 else 1 end from li
union all select ok, r, case when qty > 40 then 4 else 3 end, 1, 1 from li""")
def merged_grid(spark, sf):
    """The flag of an item continues the cell above while it stays the same; a wide second cell moves the third."""
    from palimpsest.operators.scan import previous
    li = fx._numbered_items(spark, sf)
    li = previous(li, ["ok"], "r", "_p", F.struct("l_returnflag"))
    cont = F.coalesce(F.col("_p.l_returnflag") == F.col("l_returnflag"), F.lit(False))

    def cell(no, span, merge, text):
        return F.struct(F.lit(no).alias("cell_no"), span.cast("int").alias("col_span"), merge.cast("string").alias("vmerge"),
                        text.alias("text"))

    xml = li.select("ok", F.col("r").alias("row"), F.explode(F.array(
        cell(0, F.lit(2), F.when(cont, "continue").otherwise("restart"), F.col("l_returnflag")),
        cell(1, F.when(F.col("qty") > 40, 2).otherwise(1), F.lit(None), F.col("qty").cast("string")),
        cell(2, F.lit(1), F.lit(None), F.col("l_linestatus")))).alias("c")).select("ok", "row", "c.*")
    return tb.resolve_grid(xml, ["ok"]).drop("text")


# ---- split tables ---------------------------------------------------------------------------------------------

SPLIT = S.CELLS + """,
ca as (select * from cells where side = 'A'),
pieces as (
 select pair_id, 0 as piece, anchor_row, anchor_col, row_span, col_span, text from ca where anchor_row <= 2
 union all select pair_id, 1, 0, anchor_col, 1, col_span, text from ca where anchor_row = 0
   and exists (select 1 from ca x where x.pair_id = ca.pair_id and x.anchor_row > 2)
 union all select pair_id, 1, anchor_row - 2, anchor_col, row_span, col_span, text from ca where anchor_row > 2),
mk as (select * from pieces union all select pair_id, 0, max(anchor_row) + 1, 0, 1, 5, '(continued on next page)' from pieces
   where piece = 0 and pair_id % 3 = 0 group by pair_id)
"""


def split_tables(spark, sf):
    """Order tables cut after their second item: the second piece repeats the header, some first pieces end in a mark."""
    c = fx.order_cells(spark, sf).filter("side = 'A'").drop("side", "table_uid").dropna(subset=["pair_id"])
    table, r = W.partitionBy("pair_id"), F.col("anchor_row")
    c = c.withColumn("_last", F.max("anchor_row").over(table)).withColumn("_nth", F.row_number().over(table.orderBy("anchor_row", "anchor_col")))

    def piece(no, row, *rest):
        col, rows, cols, text = rest or [F.col(x) for x in ("anchor_col", "row_span", "col_span", "text")]
        return F.struct(F.lit(no).alias("piece"), row.cast("int").alias("anchor_row"), col.cast("int").alias("anchor_col"),
                        rows.cast("int").alias("row_span"), cols.cast("int").alias("col_span"), text.alias("text"))

    one = F.lit(1)
    mark = piece(0, F.least("_last", F.lit(2)) + 1, F.lit(0), one, F.lit(5), F.lit("(continued on next page)"))
    pieces = F.when(r > 2, F.array(piece(1, r - 2))).when((r == 0) & (F.col("_last") > 2), F.array(piece(0, r), piece(1, r))).when(
        r <= 2, F.array(piece(0, r)))
    # one mark per table
    marked = F.when((F.col("_nth") == 1) & (F.col("pair_id") % 3 == 0), F.concat(F.coalesce(pieces, F.array()), F.array(mark))).otherwise(pieces)
    out = c.select("pair_id", F.explode(marked).alias("p")).select("pair_id", "p.*")
    return out.withColumn("table_uid", F.concat(F.lit("t"), F.col("piece").cast("string")))


def split_groups(spark, sf, cells):
    blocks = cells.select("pair_id", "table_uid", F.col("piece").alias("idx"), F.lit("table").alias("type")).distinct()
    return tb.merge_groups(blocks, tb.header_keys(cells, ["pair_id", "table_uid"]), PAIR)


@query("m1_header_keys", S.with_(SPLIT) + f"""select pair_id, 't' || piece as table_uid,
 string_agg({S.norm_text('text')}, '|' order by anchor_col) as header_key from mk where anchor_row = 0 group by all""")
def header_keys(spark, sf):
    return tb.header_keys(split_tables(spark, sf), ["pair_id", "table_uid"])


@query("m2_consecutive_tables", S.with_(S.CELLS) + """, ow as (select o_custkey as cust, o_orderkey as ok, row_number() over
  (partition by o_custkey order by o_orderkey) - 1 as idx, o_orderkey % 7 = 0 as narrow, o_orderkey % 5 = 0 as amount,
  case when o_orderkey % 11 = 0 then 'paragraph' else 'table' end as type from orders),
 hk as (select *, case when type = 'table' then 'part|supplier|quantity|' || case when amount then 'amount' else 'price' end ||
   case when narrow then '' else '|flag' end end as key from ow),
 f as (select *, case when type = 'table' and lag(type) over w = 'table' and lag(key) over w = key then 0 else 1 end as new
   from hk window w as (partition by cust order by idx)),
 g as (select *, sum(new) over (partition by cust order by idx) as run from f)
select cust as pair_id, cast(run as bigint) as run, cast(count(*) as bigint) as n from g group by all""")
def consecutive(spark, sf):
    """Documents of a customer: every order a table; equal headers that follow each other are one table."""
    ow = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("ok"))
    ow = number_rows(ow, PAIR, "ok", "idx")
    kind = F.when(F.col("ok") % 11 == 0, "paragraph").otherwise("table")
    blocks = ow.select("pair_id", "idx", kind.alias("type"), F.col("ok").alias("table_uid"))
    heads = tb.header_keys(fx.order_cells(spark, sf).filter("side = 'B'").withColumnRenamed("pair_id", "ok"), ["ok"])
    heads = heads.join(ow.select("pair_id", "ok"), "ok").select("pair_id", F.col("ok").alias("table_uid"), "header_key")
    heads = heads.filter(F.col("table_uid") % 11 != 0)
    g = tb.merge_groups(blocks, heads, PAIR)
    return g.groupBy("pair_id", "run").agg(F.count(F.lit(1)).alias("n"))


@query("m3_continuation_rows", S.with_(SPLIT) + """select pair_id, 't' || piece as table_uid, count(*) as n,
 cast(max(anchor_row) as int) as last_row from mk where text <> '(continued on next page)' group by all""")
def continuation_rows(spark, sf):
    c = tb.drop_continuation_rows(split_tables(spark, sf), ["pair_id", "table_uid"])
    return c.groupBy("pair_id", "table_uid").agg(F.count(F.lit(1)).alias("n"), F.max("anchor_row").alias("last_row"))


@query("m4_repeated_headers", S.with_(SPLIT) + """select pair_id, 1 as repeated from mk where piece = 1 group by pair_id""")
def repeated(spark, sf):
    c = split_tables(spark, sf)
    return tb.repeated_headers(c.filter("piece = 0"), c.filter("piece = 1"), PAIR)


@query("m5_merged_tables", S.with_(SPLIT) + """select pair_id, count(*) as n, cast(max(anchor_row) as int) as last_row,
 md5(string_agg(anchor_row || ':' || anchor_col || ':' || text, '|' order by anchor_row, anchor_col)) as grid from ca group by pair_id""")
def merged(spark, sf):
    """Cut and merged again: rows, columns and texts are those of the uncut tables."""
    c = split_tables(spark, sf)
    m = tb.merge_runs(c, split_groups(spark, sf, c), PAIR, fx.order_layout(spark, sf))
    # a table that ends in a mark but has no second piece keeps it
    m = m.filter("text <> '(continued on next page)'")
    place = F.concat_ws(":", F.col("anchor_row").cast("string"), F.col("anchor_col").cast("string"), "text")
    return m.withColumn("_g", place).groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("anchor_row").alias("last_row"),
        F.md5(tb.joined("_g", ["anchor_row", "anchor_col"], "|")).alias("grid"))


@query("m6_rejoined_labels", S.with_(S.CELLS) + """, lb as (select pair_id, side, anchor_row, anchor_col, case when anchor_row = 0 then text
   else 'group ' || ((anchor_row - 1) // (2 + anchor_col % 2)) end as text from cells),
 f as (select *, case when anchor_col <= 1 and lag(text) over w = text then 0 else 1 end as new from lb
   window w as (partition by pair_id, side, anchor_col order by anchor_row)),
 g as (select *, sum(new) over (partition by pair_id, side, anchor_col order by anchor_row) as isl from f)
select pair_id, side, anchor_col, cast(min(anchor_row) as int) as anchor_row, cast(count(*) as int) as row_span, min(text) as text
from g group by pair_id, side, anchor_col, isl""")
def rejoined(spark, sf):
    label = F.when(F.col("anchor_row") == 0, F.col("text")).otherwise(F.concat(F.lit("group "), F.floor(
        (F.col("anchor_row") - 1) / (2 + F.col("anchor_col") % 2)).cast("string")))
    c = fx.order_cells(spark, sf).select(
        *BY, "anchor_row", "anchor_col", "row_span", F.lit(1).alias("col_span"), label.alias("text"))
    return tb.rejoin_labels(c, BY, fx.order_chunk(spark, sf)).drop("col_span")


@query("a10_page_union", """
with p as (select l_orderkey as k, case when l_linenumber % 3 = 0 then null else l_linenumber end as s, case when l_linenumber % 2
  = 0 then l_linenumber + 1 end as e, l_partkey % 9 + 1 as p from lineitem)
select k, cast(min(coalesce(s, p)) as bigint) as page_start, cast(max(greatest(coalesce(s, p), coalesce(e, coalesce(s, p)))) as bigint)
 as page_end from p group by k""")
def page_union(spark, sf):
    n = F.col("l_linenumber")
    b = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 9 + 1).alias("page"), F.when(n % 3 != 0, n).cast("bigint")
        .alias("page_start"), F.when(n % 2 == 0, n + 1).cast("bigint").alias("page_end"))
    return tb.page_union(b, ["k"])


# ---- differences ----------------------------------------------------------------------------------------------

@query("b1_header_rows", S.with_(S.CELLS, NORM) + """, r as (select pair_id, side, anchor_row, bool_and(t = '') or
   bool_or(regexp_matches(t, '\\d{2,}') and not regexp_matches(t, '^\\d{1,3}$')) as stop from nc group by all),
 n as (select *, row_number() over (partition by pair_id, side order by anchor_row) as nth from r),
 e as (select pair_id, side, min(nth) filter (where stop) as ends from n where nth <= 3 group by all)
select n.pair_id, n.side, n.anchor_row from n join e using (pair_id, side)
where nth <= 3 and (nth < coalesce(ends, 4) or nth = 1)""")
def header_rows(spark, sf):
    return td.header_rows(fx.order_cells(spark, sf), BY)


def _maps(spark, sf):
    c = fx.order_cells(spark, sf)
    return c, cut_lineage(td.header_map(c, PAIR))


# Titles are those of row zero here: every later row holds a price, which ends the header.
HEADS = S.with_(S.CELLS, f"""
ttl as (select pair_id, side, anchor_col as col, {S.norm_text("text")} as title from cells where anchor_row = 0),
hp as (select pair_id, list(row(col, title) order by col) filter (where side = 'A') as ta, list(row(col, title) order by col) filter (where side = 'B') as tb from ttl group by 1),
hu as (select row_number() over (order by ta, tb) as head, ta, tb from (select distinct ta, tb from hp)),
hx as (select head, x[1] as ki, x[2] as x, y[1] as kj, y[2] as y from (
   select head, x, unnest(tb) as y from (select head, unnest(ta) as x, tb from hu)))""", S.ratio_sql("hx", ["head", "ki", "kj"], "q"), """
he as (select h.head, h.ki, h.kj, r from hx h join qratio using (head, ki, kj) where r >= case when least(length(x), length(y)) < 4 then 0.85 else 0.6 end)""",
    S.greedy_sql("he", ["head"], "-r, ki, kj", "h"), """
hm as (select head, ki as a_col, kj as b_col from hpicks
  union all select head, x[1], null from (select head, unnest(ta) as x from hu) t where not exists (select 1 from hpicks p where p.head = t.head and p.ki = t.x[1])
  union all select head, null, y[1] from (select head, unnest(tb) as y from hu) t where not exists (select 1 from hpicks p where p.head = t.head and p.kj = t.y[1]))
""", recursive=True)


@query("b2_j8_header_map", HEADS + "select hp.pair_id, a_col::int as a_col, b_col::int as b_col from hp join hu using (ta, tb) join hm using (head)")
def header_map(spark, sf):
    return _maps(spark, sf)[1]


@query("e3_added_deleted_columns", S.with_(S.CELLS) + """select ok as pair_id, case when ok % 5 = 0 then 1 else 0 end +
 case when ok % 7 = 0 then 1 else 0 end as deleted, case when ok % 5 = 0 then 1 else 0 end as added from hd""")
def one_sided_columns(spark, sf):
    m = _maps(spark, sf)[1]
    return m.groupBy("pair_id").agg(F.count_if(F.col("b_col").isNull()).cast("int").alias("deleted"),
                                    F.count_if(F.col("a_col").isNull()).cast("int").alias("added"))


@query("b3_structure_change", S.with_(S.CELLS) + "select ok as pair_id, false as structure_changed from hd")
def structure(spark, sf):
    c, m = _maps(spark, sf)
    return td.structure_change(c, m, PAIR).select("pair_id", "structure_changed")


@query("b4_row_alignment", S.with_(ROWKEYS, """
ri as (select pair_id, side, row_number() over (partition by pair_id, side order by anchor_row) - 1 as idx, row_key as key from rk)""",
       S.align_sql("ri", PAIR, "q"), recursive=True) + "select pair_id, tag, i1, i2, j1, j2 from qops")
def row_alignment(spark, sf):
    rows = td.anchor_rows(fx.order_cells(spark, sf), PAIR)
    return align.opcodes(cut_lineage(rows.select("pair_id", "side", "idx", F.col("row_key").alias("key"))), PAIR)


STATES = S.with_(ROWKEYS, """
ri as (select pair_id, side, row_number() over (partition by pair_id, side order by anchor_row) - 1 as idx, row_hash as key from rh)""",
       S.align_sql("ri", PAIR, "q"), """
st as (select pair_id, 'A' as side, tag, unnest(range(i1, i2)) as idx from qops where i2 > i1
       union all select pair_id, 'B', tag, unnest(range(j1, j2)) from qops where j2 > j1),
sc as (select pair_id, count(*) filter (where side = 'A') as na, count(*) filter (where side = 'B') as nb,
        count(*) filter (where side = 'A' and tag = 'equal') as ua, count(*) filter (where side = 'B' and tag = 'equal') as ub
       from st group by pair_id)""", recursive=True)


def _states(spark, sf):
    # sizes are counted on the keys of orders and items, so cells are made once
    bounded = fx.order_chunk(spark, sf, align.FEW) is PLAIN
    rows = td.anchor_rows(fx.order_cells(spark, sf), PAIR, fx.order_chunk(spark, sf)).select(*BY, "anchor_row", "idx", "row_hash")
    return td.row_states(rows, PAIR, together=True, bounded=bounded)


@query("b11_row_states", STATES + """select pair_id, side, cast(idx as int) as anchor_row, case when tag = 'equal' then 'unchanged'
 when side = 'A' then 'deleted' else 'added' end as state from st""")
def states(spark, sf):
    return _states(spark, sf)


@query("a11_b12_unchanged_share", STATES + """select pair_id, round(least(ua, ub) / greatest(na, nb)::double, 9) as share,
 least(ua, ub) / greatest(na, nb)::double >= 0.8 as layout_only from sc""")
def share(spark, sf):
    return td.unchanged_share(_states(spark, sf), PAIR).withColumn("share", F.round("share", 9))


@query("b5_paired_rows")
def paired_rows(spark, sf):
    tasks = fx.order_layout(spark, sf)
    rows = td.anchor_rows(fx.order_cells(spark, sf), PAIR, fx.order_chunk(spark, sf)).drop("row_hash")
    p = td.row_pairs(kept_by(rows, tasks, *PAIR), PAIR, tasks=tasks)
    return p.select("pair_id", "kind", "a_row", "b_row")


BY_ROW = S.with_(S.CELLS, NORM) + """, j as (select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.anchor_row, b.anchor_row)
   as r, coalesce(a.anchor_col, b.anchor_col) as col, a.t as xa, b.t as xb, a.col_span as asp, b.col_span as bsp
 from (select * from nc where side = 'A') a full join (select * from nc where side = 'B') b
   on a.pair_id = b.pair_id and a.anchor_row = b.anchor_row and a.anchor_col = b.anchor_col),
 rws as (select pair_id, anchor_row from nc group by all having count(distinct side) = 2),
 ch as (select j.pair_id, r, col, case when xa is null then 'table_cell_added' when xb is null then 'table_cell_deleted'
   when xa <> xb then 'table_cell_modified' when asp <> bsp then 'table_cell_span_changed' end as type, coalesce(xa, '') as lt,
   coalesce(xb, '') as rt from j join rws on rws.pair_id = j.pair_id and rws.anchor_row = j.r)
"""


def _same_number(spark, sf):
    """Rows with one number on both sides taken as pairs."""
    c = fx.order_cells(spark, sf)
    rows = c.groupBy("pair_id", "anchor_row").agg(F.countDistinct("side").alias("n")).filter("n = 2")
    pairs = rows.select("pair_id", F.lit("pair").alias("kind"), F.col("anchor_row").alias("a_row"), F.col("anchor_row").alias("b_row"),
                        F.struct(F.col("anchor_row").alias("at"), F.lit(1).alias("late"), F.lit(0).alias("sub")).alias("place"))
    return c, pairs


@query("j5_b6_cell_changes", BY_ROW + """select pair_id, r as b_row, col, type, lt as left_text, rt as right_text from ch
 where type is not null""")
def cell_changes(spark, sf):
    c, pairs = _same_number(spark, sf)
    ch = td.cell_changes(td.cell_pairs(pairs, c, PAIR))
    return ch.select("pair_id", "b_row", "col", "type", "left_text", "right_text")


@query("j6_mapped_columns", BY_ROW + """, mp as (select pair_id, r, c, type from (
   select a.pair_id, a.anchor_row as r, b.anchor_col as c, case when a.t <> b.t then 'table_cell_modified' when a.col_span <> b.col_span
     then 'table_cell_span_changed' end as type from nc a join nc b on a.pair_id = b.pair_id and a.anchor_row = b.anchor_row
     and a.side = 'A' and b.side = 'B' and b.anchor_col = case a.anchor_col when 0 then 1 when 1 then 0 when 2 then 2 end
   union all select pair_id, anchor_row, anchor_col, 'table_cell_deleted' from nc join rws using (pair_id, anchor_row)
     where side = 'A' and anchor_col = 3
   union all select pair_id, anchor_row, anchor_col, 'table_cell_added' from nc join rws using (pair_id, anchor_row)
     where side = 'B' and anchor_col = 3))
select pair_id, r as b_row, c as col, type from mp where type is not null""")
def mapped_columns(spark, sf):
    """Columns led through a map that swaps the first two, keeps the third and pairs the fourth with nothing."""
    c, pairs = _same_number(spark, sf)
    cols = F.explode(F.array(*[F.struct(F.lit(a).cast("int").alias("a_col"), F.lit(b).cast("int").alias("b_col"))
                               for a, b in [(0, 1), (1, 0), (2, 2), (3, None), (None, 3)]]))
    mapping = c.select("pair_id").distinct().select("pair_id", cols.alias("m")).select("pair_id", "m.*")
    return td.cell_changes(td.cell_pairs(pairs, c, PAIR, mapping)).select("pair_id", "b_row", "col", "type")


@query("f12_table_noise", BY_ROW + """, rw as (select pair_id, r, bool_and(type = 'table_cell_span_changed' and lt = rt) as spans,
   string_agg(lt, ' | ' order by col) as l, string_agg(rt, ' | ' order by col) as rr, count(*) as n from ch where type is not null group by all)
select pair_id, r as anchor_row, cast(n as int) as n_cells from rw where not spans and l <> rr""")
def noise(spark, sf):
    c, pairs = _same_number(spark, sf)
    rows = c.groupBy(*BY, "anchor_row").agg(F.lit("").alias("norm"))
    changed = td.cell_changes(td.cell_pairs(pairs, c, PAIR))
    return td.row_changes(pairs, changed, rows, PAIR).select("pair_id", "anchor_row", "n_cells")


@query("b10_row_records", S.with_(S.CELLS, NORM) + """select pair_id, side, anchor_row,
 coalesce(string_agg(t, ' | ' order by anchor_col) filter (where t <> ''), '') as row_text from nc group by all""")
def row_records(spark, sf):
    rows = td.anchor_rows(fx.order_cells(spark, sf), PAIR)
    return rows.select("pair_id", "side", "anchor_row", F.col("norm").alias("row_text"))


@query("b13_render_modes")
def render_modes(spark, sf):
    return td.diff_tables(fx.order_cells(spark, sf), PAIR, fx.order_layout(spark, sf))[1]


@query("b13_one_sided_tables", """
select o_orderkey as pair_id, case when o_orderkey % 3 = 0 then 'table_deleted' when o_orderkey % 3 = 1 then 'table_added' end
 as render_mode from orders""")
def one_sided(spark, sf):
    k = F.col("o_orderkey") % 3
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pair_id"),
                                                td.one_sided_mode(k != 1, k != 0).alias("render_mode"))


@query("b15_table_changes")
def table_changes(spark, sf):
    ch, _ = td.diff_tables(fx.order_cells(spark, sf), PAIR, fx.order_layout(spark, sf))
    return ch.select("pair_id", "type", "anchor_row", "n_cells", "left_text", "right_text")


@query("o3_cell_order", S.with_(S.CELLS) + """select pair_id, side, md5(string_agg(anchor_row || ':' || anchor_col, ',' order by anchor_row,
 anchor_col)) as cell_order from cells group by all""")
def cell_order(spark, sf):
    c = fx.order_cells(spark, sf).withColumn("_at", F.concat_ws(":", F.col("anchor_row").cast("string"), F.col("anchor_col").cast("string")))
    return tb.per_table(c, BY, "_at", "cell_order")


@query("b14_serialized_tables", S.with_(S.CELLS) + """, j as (select *, '{"anchor_row":' || anchor_row || ',"anchor_col":' || anchor_col ||
  ',"row_span":' || row_span || ',"col_span":' || col_span || ',"text":"' || text || '"}' as j from cells),
 w as (select pair_id, side, anchor_row, sum(col_span) as w from cells group by all),
 z as (select pair_id, side, max(anchor_row) + 1 as rows, max(w) as cols from w group by all)
select j.pair_id, j.side, md5('{"rows":' || z.rows || ',"cols":' || z.cols || ',"header":[' || string_agg(j, ',' order by anchor_row, anchor_col)
 filter (where anchor_row = 0) || '],"cells":[' || string_agg(j, ',' order by anchor_row, anchor_col) || ']}') as json
from j join z using (pair_id, side) group by j.pair_id, j.side, z.rows, z.cols""")
def serialized(spark, sf):
    return td.serialized(fx.order_cells(spark, sf), BY).select(*BY, F.md5("json").alias("json"))


CELL_PARAS = S.with_(S.LINES, f"""
cp as (select pair_id, side, pos as idx, {S.norm_text('line')} as key from lines)""", S.align_sql("cp", PAIR, "q"), """
pc as (select pair_id, case when tag = 'equal' then 'paragraph_unchanged' when k < i2 - i1 and k < j2 - j1 then 'paragraph_modified'
   when k < i2 - i1 then 'paragraph_deleted' else 'paragraph_inserted' end as type, case when k < i2 - i1 then i1 + k end as a,
   case when k < j2 - j1 then j1 + k end as b from (select *, unnest(range(greatest(i2 - i1, j2 - j1))) as k from qops))""", recursive=True)


def _cell_paragraphs(spark, sf):
    """A document as one cell whose paragraphs are its lines."""
    lines = cut_lineage(fx.line_versions(spark, sf).select("pair_id", "side", F.col("pos").alias("idx"), F.col("line").alias("text")))
    return td.paragraph_changes(lines, PAIR)


@query("b8_cell_paragraphs", CELL_PARAS + "select pair_id, type, cast(a as int) as a, cast(b as int) as b from pc")
def cell_paragraphs(spark, sf):
    return _cell_paragraphs(spark, sf)


@query("b9_interleaved_changes", CELL_PARAS + """, al as (select pair_id, type, a * 2 as a_pos, b * 2 as b_pos, 0 as source from pc
   union all select pair_id, case when a % 2 = 0 then 'image_modified' else 'image_equal' end, a * 2 + 1, b * 2 + 1, 1 from pc
   where a % 5 = 0 and b is not null)
select pair_id, cast(row_number() over (partition by pair_id order by coalesce(a_pos, b_pos), source, a_pos nulls first, b_pos nulls first) - 1 as int) as n,
 type from al where type not like '%unchanged' and type not like '%equal'""")
def interleaved(spark, sf):
    p = _cell_paragraphs(spark, sf)
    both = p.select("pair_id", "type", (F.col("a") * 2).alias("a_pos"), (F.col("b") * 2).alias("b_pos"), F.lit(0).alias("source"))
    pics = p.filter("a % 5 = 0 and b is not null").select(
        "pair_id", F.when(F.col("a") % 2 == 0, "image_modified").otherwise("image_equal").alias("type"), (F.col("a") * 2 + 1).alias("a_pos"),
        (F.col("b") * 2 + 1).alias("b_pos"), F.lit(1).alias("source"))
    return td.interleave(both.unionByName(pics), PAIR).select("pair_id", "n", "type")


@query("b7_nested_cell_cases", S.with_(S.CELLS, NORM, """
fr as (select pair_id, side, anchor_row, string_agg(t, ' ' order by anchor_col) filter (where t <> '') as rt from nc group by all),
fl as (select pair_id, side, string_agg(rt, chr(10) order by anchor_row) as f from fr group by all)""") + """
select a.pair_id, case when a.pair_id % 4 = 0 then case when a.f <> b.f then 'nested_table_modified' end
 when a.pair_id % 4 = 1 then 'nested_table_to_text' when a.pair_id % 4 = 2 then 'text_to_nested_table'
 when a.pair_id % 8 = 3 then 'text_modified' end as type
from fl a join fl b on a.pair_id = b.pair_id and a.side = 'A' and b.side = 'B'""")
def nested_cases(spark, sf):
    """Order tables as nested tables of a cell, against each other or against plain text."""
    flat = tb.flatten_text(fx.order_cells(spark, sf), BY)
    f = flat.groupBy("pair_id").agg(F.max(F.when(F.col("side") == "A", F.col("flat"))).alias("fa"),
                                    F.max(F.when(F.col("side") == "B", F.col("flat"))).alias("fb"))
    k = F.col("pair_id") % 4
    other = F.when(F.col("pair_id") % 8 == 3, "other").otherwise("words")
    return f.select("pair_id", td.nested_case(k.isin(0, 1), k.isin(0, 2), F.col("fa"), F.col("fb"), F.lit("words"), other).alias("type"))
