"""Alignment, pairing in replace slices, and table scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.catalog import sqlparts as S
from palimpsest.functions import fingerprint as fp
from palimpsest.functions.kernels import gestalt_ratio
from palimpsest.functions.text import norm_for_signature, tokenize
from palimpsest.operators import align
from palimpsest.operators import matching as m
from palimpsest.operators import structure as st
from palimpsest.operators import tables as tb
from palimpsest.plans import compare as cp
from palimpsest.plans import fixtures as fx
from palimpsest.operators.scan import chunk_for
from palimpsest.session import cut_lineage, spread

PAIR = ["pair_id"]


def line_items(spark, sf):
    lines = fx.line_versions(spark, sf)
    n = F.lit(None)
    sig = fp.paragraph_signature(F.col("norm"), n.cast(fp.NUMBERING), n.cast(fp.IMAGES), True)
    kept = lines.withColumn("norm", norm_for_signature(F.col("line"))).filter("norm <> ''")
    kept = kept.select("pair_id", "side", F.col("pos").alias("ord"), F.lit("").alias("uid"), "line", "norm",
                       F.concat(F.lit("paragraph|"), sig).alias("key"))
    chunk = chunk_for(lines, ["pair_id", "side"])
    # three readers follow: group sizes, gathered groups and the large path
    return cut_lineage(st.number_blocks(kept, ["pair_id", "side"], chunk).select("pair_id", "side", "idx", "ord", "key"))


@query("j1_fingerprint_matches", S.with_(S.LINES, S.LINE_BLOCKS) + """
select a.pair_id, count(*) as matches, count(distinct a.key) as shared_keys from lblk a join lblk b
 on a.pair_id = b.pair_id and a.key = b.key where a.side = 'A' and b.side = 'B' group by a.pair_id""")
def matches(spark, sf):
    """Counted from per-key counts: the pairs themselves are never listed."""
    it = line_items(spark, sf)
    per_key = it.groupBy("pair_id", "key").agg(F.count_if(F.col("side") == "A").alias("na"),
                                               F.count_if(F.col("side") == "B").alias("nb")).filter("na > 0 and nb > 0")
    return per_key.groupBy("pair_id").agg(F.sum(F.col("na") * F.col("nb")).alias("matches"),
                                          F.count(F.lit(1)).alias("shared_keys"))


@query("l1_line_opcodes", S.with_(S.LINES, S.LINE_BLOCKS, S.align_sql("lblk", PAIR, "q"), recursive=True)
       + "select pair_id, tag, i1, i2, j1, j2 from qops")
def line_opcodes(spark, sf):
    return align.opcodes(line_items(spark, sf), PAIR)


@query("l1_word_opcodes", S.with_(S.LINES, """
wd as (select pair_id * 1000000 + pos as pair_id, side, unnest(string_split(line, ' ')) as key,
        generate_subscripts(string_split(line, ' '), 1) - 1 as idx from (
          select * from lines where side = 'A' union all
          select pair_id, 'B', pos, regexp_replace(line, '([aeiou]) ([a-m])', '\\1 x \\2', 'g') from lines where side = 'A'))""", S.align_sql("wd", PAIR, "q"), recursive=True) + """
select pair_id, tag, i1, i2, j1, j2 from qops""")
def word_opcodes(spark, sf):
    """Lines against a copy with words put in: many small groups."""
    a = fx.line_versions(spark, sf).filter("side = 'A'")
    gid = F.col("pair_id") * 1000000 + F.col("pos")
    put_in = F.regexp_replace("line", "([aeiou]) ([a-m])", "$1 x $2")
    both = a.select(gid.alias("pair_id"), F.explode(F.array(
        F.struct(F.lit("A").alias("side"), F.split("line", " ").alias("w")),
        F.struct(F.lit("B").alias("side"), F.split(put_in, " ").alias("w")))).alias("v"))
    items = both.select("pair_id", "v.side", F.posexplode("v.w").alias("idx", "key"))
    return align.opcodes(items, PAIR)


@query("l2_ratio_of_edited_lines")
def edited_ratios(spark, sf):
    """Gestalt ratio of each line to its edited form, only where the forms differ."""
    a = fx.line_versions(spark, sf).filter("side = 'A'")
    edited = F.concat(F.lit("edited "), F.regexp_replace("line", "e ", "es "))
    a = a.select("pair_id", "pos", "line", edited.alias("other"))
    a = spread(a, "pair_id", "pos")
    return a.select("pair_id", "pos", F.round(gestalt_ratio("line", "other"), 9).alias("ratio"))


@query("l2_ratio_of_outline_texts", S.with_(S.OUTLINE_A, """
tp as (select pair_id, ord, text as x, 'edited ' || regexp_replace(text, 'e ', 'es ', 'g') as y from oa)""", S.ratio_sql("tp", ["pair_id", "ord"], "q"),
                                             recursive=True) + "select pair_id, ord, round(r, 9) as ratio from qratio")
def outline_ratios(spark, sf):
    """Gestalt ratio of every text of the outline to its edited form."""
    a = fx.outline_nodes(spark, sf)
    edited = F.concat(F.lit("edited "), F.regexp_replace("text", "e ", "es "))
    return a.select("pair_id", "ord", F.round(gestalt_ratio("text", edited), 9).alias("ratio"))


@query("l4_thresholds", S.with_(S.LINES) + f"""
select pair_id, side, pos, k as kind, case k when 'heading' then 0.72 when 'shape' then 0.8 when 'table' then 0.82
 when 'image' then 0.75 else case when n > 300 then 0.55 when n > 120 then 0.6 else 0.65 end end::double as t
from (select pair_id, side, pos, length({S.norm_sig('line')}) as n,
 ['paragraph','heading','shape','table','image'][pos % 5 + 1] as k from lines)""")
def thresholds(spark, sf):
    kinds = F.array(*map(F.lit, ["paragraph", "heading", "shape", "table", "image"]))
    k = F.element_at(kinds, (F.col("pos") % 5 + 1).cast("int"))
    ln = fx.line_versions(spark, sf).select("pair_id", "side", "pos", k.alias("kind"),
                                            F.length(norm_for_signature(F.col("line"))).alias("n"))
    return ln.select("pair_id", "side", "pos", "kind", m.threshold(F.col("kind"), F.col("n")).cast("double").alias("t"))


def _outline_refined(spark, sf):
    return cp.compare_text(fx.outline_versions(spark, sf))


OUTLINE_BLOCKS = f"""
obk as (select *, {S.norm_sig('text')} as norm from ctx where not (type in ('heading', 'paragraph') and {S.skip_mark('text')})
        and (type = 'heading' or {S.norm_sig('text')} <> '')),
och as (select *, lower(norm) as low, regexp_extract(lower(norm), '^(\\d+(\\.\\d+)*)\\s+(.*)', 1) as ch from obk),
oblk as (select pair_id, side, row_number() over (partition by pair_id, side order by ord, uid) - 1 as idx, ord, uid, type,
   level, text, heading_ctx, case when type = 'heading' then 'H' || level || '|d' ||
   case when ch = '' then 0 else length(ch) - length(replace(ch, '.', '')) + 1 end || '|' || substr(md5(case when ch = ''
   then low else regexp_extract(low, '^(\\d+(\\.\\d+)*)\\s+(.*)', 3) end), 1, 12)
   else 'paragraph|P:' || substr(md5('txt:' || norm), 1, 16) end as key from och)
"""


# Replace slices resolved: candidates of one type, ratio over characters, greedy by similarity and distance, then single opcodes.
REFINED = S.with_(S.OUTLINE, S.KEPT, S.PATHS, OUTLINE_BLOCKS, S.align_sql("oblk", PAIR, "q"), f"""
onorm as (select *, {S.norm_sig("text")} as norm from oblk),
ocand as (select o.pair_id, o.i1 as si, o.j1 as sj, x.idx - o.i1 as ki, y.idx - o.j1 as kj, x.norm as x, y.norm as y,
    x.heading_ctx is not distinct from y.heading_ctx as same, x.type as kind
  from qops o join onorm x on x.pair_id = o.pair_id and x.side = 'A' and x.idx >= o.i1 and x.idx < o.i2
  join onorm y on y.pair_id = o.pair_id and y.side = 'B' and y.idx >= o.j1 and y.idx < o.j2 and y.type = x.type where o.tag = 'replace')""",
    S.ratio_sql("ocand", ["pair_id", "si", "sj", "ki", "kj"], "c"), """
oedge as (select * from (select o.*, least(1.0, r + case when same then 0.08 else 0 end) as sim,
    least(case when kind = 'heading' then 0.72 when length(x) > 300 then 0.55 when length(x) > 120 then 0.6 else 0.65 end,
          case when kind = 'heading' then 0.72 when length(y) > 300 then 0.55 when length(y) > 120 then 0.6 else 0.65 end)::double as cut
  from ocand o join cratio using (pair_id, si, sj, ki, kj)) where sim >= cut)""",
    S.greedy_sql("oedge", ["pair_id", "si", "sj"], "-sim, abs(ki - kj), ki, kj", "o"), """
slices as (select pair_id, i1, i2, j1, j2, i2 - i1 = 1 and j2 - j1 = 1 as single from qops where tag = 'replace'),
sa as (select s.*, k as ki, p.kj from (select *, unnest(range(i2 - i1)) as k from slices) s
  left join opicks p on p.pair_id = s.pair_id and p.si = s.i1 and p.sj = s.j1 and p.ki = s.k),
sb as (select s.*, k as kj, p.ki from (select *, unnest(range(j2 - j1)) as k from slices) s
  left join opicks p on p.pair_id = s.pair_id and p.si = s.i1 and p.sj = s.j1 and p.kj = s.k),
sw as (select *, last_value(ki ignore nulls) over (partition by pair_id, i1, j1 order by kj rows between unbounded preceding and current row) as back,
    first_value(ki ignore nulls) over (partition by pair_id, i1, j1 order by kj rows between current row and unbounded following) as ahead from sb),
rops as (
  select pair_id, tag, i1, i2, j1, j2 from qops where tag <> 'replace'
  union all select pair_id, case when kj is null then 'delete' else 'replace' end, i1 + ki, i1 + ki + 1,
    coalesce(j1 + kj, case when single then j1 else j2 end), coalesce(j1 + kj + 1, case when single then j1 else j2 end) from sa
  union all select pair_id, 'insert', coalesce(i1 + ahead, i1 + back + 1, i2), coalesce(i1 + ahead, i1 + back + 1, i2), j1 + kj, j1 + kj + 1 from sw where ki is null)
""", recursive=True)


@query("l3_l5_l6_l7_refined_opcodes", REFINED + "select pair_id, tag, i1::int as i1, i2::int as i2, j1::int as j1, j2::int as j2 from rops")
def refined(spark, sf):
    return _outline_refined(spark, sf).opcodes


@query("l1_outline_opcodes", S.with_(S.OUTLINE, S.KEPT, S.PATHS, OUTLINE_BLOCKS, S.align_sql("oblk", PAIR, "q"),
                                     recursive=True) + "select pair_id, tag, i1, i2, j1, j2 from qops")
def outline_opcodes(spark, sf):
    return align.opcodes(st.build_text_blocks(fx.outline_versions(spark, sf), ["pair_id", "side"]), PAIR)


@query("o1_opcode_order", S.with_(S.LINES, S.LINE_BLOCKS, S.align_sql("lblk", PAIR, "q"), recursive=True) + """
select pair_id, tag, i1, j1, cast(row_number() over (partition by pair_id order by i1, j1, case tag when 'delete' then 0
 when 'insert' then 1 when 'replace' then 2 else 3 end) as int) as n from qops""")
def opcode_order(spark, sf):
    from palimpsest.operators.scan import Run, scan
    ops = align.opcodes(line_items(spark, sf), PAIR).withColumn("_r", m.tag_rank(F.col("tag")))
    return scan(ops, PAIR, "i1", {"n": Run("count", F.lit(1))}, tie=["j1", "_r"]).select(
        "pair_id", "tag", "i1", "j1", F.col("n").cast("int").alias("n"))


@query("o2_sequence_index", S.with_(S.LINES, S.LINE_BLOCKS, S.align_sql("lblk", PAIR, "q"), recursive=True) + """
select pair_id, tag, cast(i1 + k as bigint) * 100000 as seq, 0 as at from (select *, unnest(range(i2 - i1)) as k from qops where tag = 'delete')
union all select pair_id, tag, cast(i1 as bigint) * 100000 - 50000 + k, j1 + k from (select *, unnest(range(j2 - j1)) as k from qops where tag = 'insert')
union all select pair_id, tag, cast(i1 as bigint) * 100000, j1 from qops where tag = 'replace' and i2 - i1 = 1 and j2 - j1 = 1
union all select pair_id, 'delete', cast(i1 + k as bigint) * 100000, 0 from (
  select *, unnest(range(i2 - i1)) as k from qops where tag = 'replace' and not (i2 - i1 = 1 and j2 - j1 = 1))
union all select pair_id, 'insert', cast(i2 as bigint) * 100000 - 50000 + k, j1 + k from (
  select *, unnest(range(j2 - j1)) as k from qops where tag = 'replace' and not (i2 - i1 = 1 and j2 - j1 = 1))""")
def sequence_index(spark, sf):
    from palimpsest.operators.report import touched
    ops = align.opcodes(line_items(spark, sf), PAIR)
    t = touched(ops, PAIR)
    return t.select("pair_id", F.col("kind").alias("tag"), "seq", F.coalesce("b", F.lit(0)).cast("int").alias("at"))


IDENT = S.CELLS + f""",
tx as (select *, {S.norm_match('text')} as t from cells),
rw as (select pair_id, side, anchor_row, string_agg(t, ' ' order by anchor_col) filter (where text <> '') as rt,
        sum(col_span) as w from tx group by all),
idn as (select pair_id, side, list(rt order by anchor_row) as row_texts, max(anchor_row) + 1 as rows, cast(max(w) as int) as cols,
        list_distinct(flatten(list(regexp_extract_all(rt, '[\\p{{L}}\\p{{N}}_]+')))) as tokens from rw group by all)
"""
SETS = f"""
ps as (select a.pair_id, a.row_texts as ar, b.row_texts as br, a.tokens as atok, b.tokens as btok, a.rows as arows,
        b.rows as brows, a.cols as acols, b.cols as bcols from idn a join idn b on a.pair_id = b.pair_id and a.side = 'A'
        and b.side = 'B'),
sc as (select *, case when len(list_distinct(ar)) = 0 then 0 else len(list_intersect(list_distinct(ar), list_distinct(br)))
        / greatest(len(list_distinct(ar)), len(list_distinct(br)))::double end as row_overlap,
        case when len(atok) = 0 or len(btok) = 0 then 0 else len(list_intersect(atok, btok))
        / len(list_distinct(list_concat(atok, btok)))::double end as token_overlap from ps)
"""


def both_identities(spark, sf):
    ident = tb.identities(fx.order_cells(spark, sf), ["pair_id", "side"])
    st_ = F.struct(F.lit(None).cast("string").alias("heading_ctx"), "cols", "rows", "row_texts", "tokens",
                   (F.col("pair_id") % 11 + F.when(F.col("side") == "A", 0).otherwise(2)).alias("idx"))
    ident = ident.select("pair_id", "side", st_.alias("ident"))
    return ident.groupBy("pair_id").agg(F.max(F.when(F.col("side") == "A", F.col("ident"))).alias("a"),
                                        F.max(F.when(F.col("side") == "B", F.col("ident"))).alias("b"))


@query("e1_row_text_overlap", S.with_(IDENT, SETS) + "select pair_id, round(row_overlap, 9) as v from sc")
def row_text_overlap(spark, sf):
    return both_identities(spark, sf).select("pair_id", F.round(m.row_overlap(F.col("a.row_texts"), F.col("b.row_texts")), 9)
                                             .alias("v"))


@query("e2_token_overlap", S.with_(IDENT, SETS) + "select pair_id, round(token_overlap, 9) as v from sc")
def tokens(spark, sf):
    return both_identities(spark, sf).select("pair_id", F.round(m.token_overlap(F.col("a.tokens"), F.col("b.tokens")), 9)
                                             .alias("v"))


_SCORE = """round(least(1, 0.45 * row_overlap + 0.2 * token_overlap + 0.15 * greatest(0, 1 - abs(acols - bcols) * 0.25)
 + 0.1 * greatest(0, 1 - abs(arows - brows) / greatest(arows, brows)::double) + 0.1 * greatest(0, 1 - 2 / 40.0::double)), 9)"""


@query("l8_table_similarity", S.with_(IDENT, SETS) + f"select pair_id, {_SCORE} as score from sc")
def table_similarity(spark, sf):
    return both_identities(spark, sf).select("pair_id", F.round(
        m.table_similarity(F.col("a"), F.col("b"), F.lit(40)), 9).alias("score"))


@query("a5_table_identity", S.with_(IDENT) + """select pair_id, side, md5(array_to_string(row_texts, '|')) as row_texts,
 md5(array_to_string(list_sort(tokens), ' ')) as tokens, cast(rows as int) as rows, cols from idn""")
def table_identity(spark, sf):
    return tb.identities(fx.order_cells(spark, sf), ["pair_id", "side"]).select(
        "pair_id", "side", F.md5(F.array_join("row_texts", "|")).alias("row_texts"),
        F.md5(F.array_join(F.array_sort("tokens"), " ")).alias("tokens"), "rows", "cols")


# Orders of one customer form a document of tables; side B shifts the order by one, so nothing pairs by place.
CUSTOMER_TABLES = IDENT + """,
ow as (select o_orderkey as ok, o_custkey as cust, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int)
        as n from orders),
tot as (select cust, 2 * count(*) as total from ow group by cust)
"""


def customer_tables(spark, sf):
    """Identities and blocks of documents whose tables are the orders of a customer."""
    from palimpsest.operators.scan import number_rows
    ow = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("ok"))
    ow = number_rows(ow, ["pair_id"], "ok", "n").withColumn("n", F.col("n").cast("int"))
    ident = tb.identities(fx.order_cells(spark, sf), ["pair_id", "side"]).withColumnRenamed("pair_id", "ok")
    ident = ident.join(ow, "ok").select("pair_id", "side", F.col("n").alias("idx"), F.struct(
        F.lit(None).cast("string").alias("heading_ctx"), "cols", "rows", "row_texts", "tokens", F.col("n").alias("idx"))
        .alias("ident"))
    totals = ow.groupBy("pair_id").agg((2 * F.count(F.lit(1))).alias("total_blocks"))
    return ow, ident, totals


@query("l9_table_pair_resolution", S.with_(CUSTOMER_TABLES) + """, pr as (select a.cust, a.n as i, b.n as j, a.ok as ak, b.ok as bk
  from ow a join ow b on a.cust = b.cust and b.n = a.n + 1),
 pp as (select p.cust, i, j, x.row_texts as ar, y.row_texts as br, x.tokens as atok, y.tokens as btok, x.rows as arows, y.rows as brows,
   x.cols as acols, y.cols as bcols, total from pr p join idn x on x.pair_id = ak and x.side = 'A'
   join idn y on y.pair_id = bk and y.side = 'B' join tot using (cust)),
 ss as (select *, least(1, 0.45 * len(list_intersect(list_distinct(ar), list_distinct(br)))
   / greatest(len(list_distinct(ar)), len(list_distinct(br)))::double + 0.2 * len(list_intersect(atok, btok))
   / len(list_distinct(list_concat(atok, btok)))::double + 0.15 * greatest(0, 1 - abs(acols - bcols) * 0.25)
   + 0.1 * greatest(0, 1 - abs(arows - brows) / greatest(arows, brows)::double) + 0.1 * greatest(0, 1 - 1 / total::double))
   as s from pp)
select cust as pair_id, round(s, 9) as score, 'replace' as tag, i as i1, i + 1 as i2, j as j1, j + 1 as j2 from ss where s >= 0.45
union all select cust, round(s, 9), 'delete', i, i + 1, j, j from ss where s < 0.45
union all select cust, round(s, 9), 'insert', i + 1, i + 1, j, j + 1 from ss where s < 0.45""")
def pair_resolution(spark, sf):
    ow, ident, totals = customer_tables(spark, sf)
    pairs = ow.select("pair_id", F.col("n").alias("i1"), (F.col("n") + 1).alias("j1"))
    out = m.score_table_pairs(pairs, ident, totals, PAIR)
    return out.select("pair_id", F.round("score", 9).alias("score"), "tag", "i1", "i2", "j1", "j2")


@query("l10_rescued_tables")
def rescued(spark, sf):
    """Every order table deleted and inserted again: each finds its best free partner."""
    ow, ident, totals = customer_tables(spark, sf)
    blocks = ow.select("pair_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side"), F.col("n").alias("idx"),
                       F.lit("table").alias("type"))
    n = F.col("n")
    ops = ow.select("pair_id", F.explode(F.array(
        F.struct(F.lit("delete").alias("tag"), n.alias("i1"), (n + 1).alias("i2"), n.alias("j1"), n.alias("j2")),
        F.struct(F.lit("insert").alias("tag"), n.alias("i1"), n.alias("i2"), n.alias("j1"), (n + 1).alias("j2")))).alias("o"))
    ops = ops.select("pair_id", "o.*", F.lit(0).alias("phase"))
    return m.rescue_tables(ops, blocks, ident, totals, PAIR).drop("phase")


@query("o4_best_candidate", S.with_(S.LINES) + """
select pair_id, side, min_by(pos, (-length(line), pos)) as best_pos from lines group by pair_id, side""")
def best_candidate(spark, sf):
    """First maximum wins: one aggregate, no window."""
    return fx.line_versions(spark, sf).groupBy("pair_id", "side").agg(
        F.max_by("pos", F.struct(F.length("line"), -F.col("pos"))).alias("best_pos"))


@query("j7_slice_candidates")
def slice_candidates(spark, sf):
    """Pairs above the threshold inside the replace slices of the edited documents."""
    lines = fx.line_versions(spark, sf)
    blocks = cut_lineage(st.build_text_blocks(cp.line_nodes(lines), ["pair_id", "side"]))
    items = m.slice_items(align.opcodes(blocks, PAIR), blocks, PAIR)
    return m.slice_edges(items, PAIR).select("pair_id", "i1", "j1", "ki", "kj", F.round("sim", 9).alias("sim"))
