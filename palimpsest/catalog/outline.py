"""Outline paths, skipped parts, page numbers and list labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.catalog import sqlparts as S
from palimpsest.operators import structure as st
from palimpsest.operators.scan import following, previous
from palimpsest.plans import fixtures as fx

KEYS = ["pair_id", "side"]


@query("f1_skip_sections", S.with_(S.OUTLINE, S.KEPT) + "select pair_id, side, ord, uid, type, level, text from kept")
def skip_sections(spark, sf):
    return st.drop_skipped_sections(fx.outline_versions(spark, sf), KEYS)


@query("w1_heading_paths", S.with_(S.OUTLINE, S.KEPT, S.PATHS)
       + "select pair_id, side, ord, type, heading_ctx, cast(heading_level as int) as heading_level from ctx")
def heading_paths(spark, sf):
    kept = st.drop_skipped_sections(fx.outline_versions(spark, sf), KEYS)
    return st.heading_paths(kept, KEYS).select("pair_id", "side", "ord", "type", "heading_ctx", "heading_level")


MARKED = S.with_(S.LINES, """
mk as (select pair_id, side, pos as ord, case when (pair_id + pos) % 5 = 0 then 'paragraph'
        when (pair_id + pos) % 5 = 1 then 'heading' else 'image' end as type,
        case when (pair_id + pos * 3) % 13 = 4 then '(Continued  on next' || chr(10) || 'page) ' || line else line end as text,
        (pair_id + pos) % 29 = 3 as in_toc from lines)""")


def marked(spark, sf):
    n = (F.col("pair_id") + F.col("pos")) % 5
    kind = F.when(n == 0, "paragraph").when(n == 1, "heading").otherwise("image")
    text = F.when((F.col("pair_id") + F.col("pos") * 3) % 13 == 4,
                  F.concat(F.lit("(Continued  on next\npage) "), "line")).otherwise(F.col("line"))
    return fx.line_versions(spark, sf).select(
        "pair_id", "side", F.col("pos").alias("ord"), kind.alias("type"), text.alias("text"),
        ((F.col("pair_id") + F.col("pos")) % 29 == 3).alias("in_toc"))


@query("f2_skip_blocks", MARKED + f"""select pair_id, side, ord, type from mk
where not in_toc and not (type in ('heading', 'paragraph') and {S.skip_mark('text')})""")
def skip_blocks(spark, sf):
    return st.drop_skipped_blocks(marked(spark, sf)).select("pair_id", "side", "ord", "type")


CONT_CELLS = S.CELLS + """,
cc as (select pair_id, side, table_uid, case when pair_id % 4 = 1 and side = 'B' then 'continue on next page'
        when pair_id % 4 = 2 then '' when pair_id % 4 = 3 and anchor_row > 0 then 'Tiếp trang sau' else text end as text
       from cells)"""


@query("f2_continuation_only_tables", S.with_(CONT_CELLS) + f"""
select pair_id, side, table_uid from cc where {S.norm_match('text')} <> '' group by all
having bool_and({S.skip_mark('text')})""")
def continuation_tables(spark, sf):
    p = F.col("pair_id") % 4
    text = (F.when((p == 1) & (F.col("side") == "B"), "continue on next page").when(p == 2, "")
            .when((p == 3) & (F.col("anchor_row") > 0), "Tiếp trang sau").otherwise(F.col("text")))
    cells = fx.order_cells(spark, sf).withColumn("text", text)
    return st.continuation_only_tables(cells, ["pair_id", "side", "table_uid"])


@query("f5_blank_lines", S.with_(S.LINES) + f"select pair_id, side, pos from lines where {S.norm_sig('line')} <> ''")
def blank_lines(spark, sf):
    from palimpsest.functions.text import norm_for_signature
    return fx.line_versions(spark, sf).filter(norm_for_signature(F.col("line")) != "").select("pair_id", "side", "pos")


CONTENTS = S.with_(S.LINES, """
tl as (select pair_id, side, pos as ord, 'u' || lpad(cast(pos as varchar), 9, '0') as uid,
        case when (pair_id + pos) % 31 = 9 then 'heading' else 'paragraph' end as type,
        case when (pair_id * 5 + pos // 3) % 5 < 2 then line || ' ..... ' || pos else line end as text from lines),
lk as (select *, type = 'paragraph' and regexp_matches(trim(""" + S.norm_match("text") + """),
        '^.+[.\\s\\x{b7}\\x{2022}]{3,}\\d+\\s*$') as toc from tl),
rn as (select *, sum(case when toc then 0 else 1 end) over (partition by pair_id, side order by ord) as run from lk),
sz as (select *, count(*) filter (where toc) over (partition by pair_id, side, run) as n from rn)""")


@query("f6_contents_runs", CONTENTS + "select pair_id, side, ord, text from sz where not (toc and n >= 4)")
def contents_runs(spark, sf):
    text = F.when((F.col("pair_id") * 5 + F.floor(F.col("pos") / 3)) % 5 < 2,
                  F.concat("line", F.lit(" ..... "), F.col("pos").cast("string"))).otherwise(F.col("line"))
    blocks = fx.line_versions(spark, sf).select(
        "pair_id", "side", F.col("pos").alias("ord"), F.concat(F.lit("u"), F.lpad(F.col("pos").cast("string"), 9, "0"))
        .alias("uid"), F.when((F.col("pair_id") + F.col("pos")) % 31 == 9, "heading").otherwise("paragraph")
        .alias("type"), text.alias("text"))
    return st.drop_contents_runs(blocks, KEYS).select("pair_id", "side", "ord", "text")


@query("f7_contents_style", """
with s as (select conv_id, turn, case turn % 4 when 0 then 'TOC ' || conv_id when 1 then 'toc' || turn when 2 then role
  else 'Contents TOC 1' end as style from conversations)
select conv_id, turn, regexp_matches(style, '^(?i:toc)\\s*\\d+') as in_style from s""")
def contents_style(spark, sf):
    t = F.col("turn") % 4
    style = (F.when(t == 0, F.concat(F.lit("TOC "), F.col("conv_id").cast("string")))
             .when(t == 1, F.concat(F.lit("toc"), F.col("turn").cast("string"))).when(t == 2, F.col("role"))
             .otherwise("Contents TOC 1"))
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", style.rlike(st.CONTENTS_STYLE)
                                                       .alias("in_style"))


@query("f9_previews", """
select conv_id, turn, k as kind, trim(substr(case k when 'paragraph' then text when 'heading' then text
  when 'image' then case when turn % 2 = 0 then '[IMAGE]' else '[IMAGE: ' || role || ']' end
  when 'shape' then case when turn % 3 = 0 then '[SHAPE]' else '[SHAPE: ' || text || ']' end
  when 'table' then '[TABLE ' || turn || '×' || (conv_id % 7) || ']' else '' end, 1, 200)) as preview
from conversations, (values ('paragraph'), ('heading'), ('image'), ('shape'), ('table'), ('other')) v(k)""")
def previews(spark, sf):
    kinds = F.explode(F.array(*map(F.lit, ["paragraph", "heading", "image", "shape", "table", "other"])))
    c = fx.table(spark, sf, "conversations").withColumn("kind", kinds)
    return c.select("conv_id", "turn", "kind", st.preview(
        F.col("kind"), F.col("text"), F.when(F.col("turn") % 2 == 1, F.col("role")),
        F.when(F.col("turn") % 3 != 0, F.col("text")), F.col("turn"), F.col("conv_id") % 7).alias("preview"))


@query("f10_page_fields", """
with p as (select event_id, nullif(event_id % 4, 0) as page, case when event_id % 3 = 0 then event_id % 7 end as s,
           case when event_id % 5 < 2 then event_id % 6 end as e from events),
 q as (select event_id, coalesce(page, 1) as page, coalesce(nullif(s, 0), page, 1) as ps, nullif(e, 0) as e from p)
select event_id, page, ps as page_start, greatest(coalesce(e, ps), ps) as page_end from q""")
def page_fields(spark, sf):
    e = F.col("event_id")
    cols = st.page_fields(e % 4, F.when(e % 3 == 0, e % 7), F.when(e % 5 < 2, e % 6))
    return fx.table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in cols.items()])


@query("w2_shape_headings", S.with_(S.OUTLINE, S.KEPT, S.PATHS, """
sh as (select *, case when type = 'paragraph' and ord % 4 = 1 then 'shape' else type end as kind,
        case when ord % 4 = 1 and type = 'paragraph' then 'stale' else heading_ctx end as old_ctx from ctx),
hd as (select pair_id, side, ord, heading_ctx as hc, lead(ord, 1, 2147483647) over (partition by pair_id, side order by ord)
        as nxt from sh where type = 'heading')""") + """
select s.pair_id, s.side, s.ord, s.kind as type, case when s.kind = 'shape' then coalesce(h.hc, s.old_ctx) else s.old_ctx end
 as heading_ctx from sh s left join hd h on h.pair_id = s.pair_id and h.side = s.side and s.ord >= h.ord and s.ord < h.nxt""")
def shape_headings(spark, sf):
    kept = st.heading_paths(st.drop_skipped_sections(fx.outline_versions(spark, sf), KEYS), KEYS)
    shape = (F.col("type") == "paragraph") & (F.col("ord") % 4 == 1)
    kept = kept.withColumn("heading_ctx", F.when(shape, "stale").otherwise(F.col("heading_ctx"))).withColumn(
        "type", F.when(shape, "shape").otherwise(F.col("type")))
    return st.fix_shape_headings(kept, KEYS).select("pair_id", "side", "ord", "type", "heading_ctx")


@query("w3_page_numbers", S.with_(S.LINES) + """, pg as (select pair_id, pos, pos % 23 = 0 and pos > 0 as bb,
  cast(pos % 31 = 30 as int) as bi from lines where side = 'A')
select pair_id, pos, cast(1 + sum(cast(bb as int)) over w + sum(bi) over w - bi as int) as page from pg
window w as (partition by pair_id order by pos)""")
def page_numbers(spark, sf):
    a = fx.line_versions(spark, sf).filter("side = 'A'").select(
        "pair_id", "pos", ((F.col("pos") % 23 == 0) & (F.col("pos") > 0)).alias("break_before"),
        (F.col("pos") % 31 == 30).cast("int").alias("breaks_inside"))
    return st.page_numbers(a, ["pair_id"]).select("pair_id", "pos", "page")


LIST_DEFS = [
    (0, 0, "decimal", "%1.", 1), (0, 1, "decimal", "%1.%2", 1), (0, 2, "decimal", "%1.%2.%3", 1),
    (1, 0, "upperRoman", "%1)", 1), (1, 1, "lowerLetter", "%2)", 3), (1, 2, "decimalZero", "(%1-%3)", 1),
    (2, 0, "bullet", "o", 1), (2, 1, "none", "", 1), (2, 2, "decimal", "%3", 5),
    (3, 0, "upperLetter", "%1", 2), (3, 2, "lowerRoman", "%1.%2.%3", 1),
]

ITEMS = """
defs(num_id, level, num_fmt, lvl_text, start) as (values """ + ", ".join(map(repr, LIST_DEFS)) + """),
its as (select conv_id % 25 as doc_id, conv_id * 100 + turn as pos, conv_id % 4 as num_id, (turn + conv_id) % 3 as level
        from conversations),
dit as (select i.* from its i where exists (select 1 from defs d where d.num_id = i.num_id and d.level = i.level)),
cnt as (select i.doc_id, i.pos, i.num_id, i.level, k.k,
         (select count(*) from dit x where x.doc_id = i.doc_id and x.num_id = i.num_id and x.level = k.k and x.pos <= i.pos
           and x.pos > coalesce((select max(y.pos) from dit y where y.doc_id = i.doc_id and y.num_id = i.num_id
                                  and y.level < k.k and y.pos <= i.pos), -1)) as n
        from dit i, range(3) k(k)),
val as (select c.*, d.num_fmt, coalesce(d.start, 1) - 1 + greatest(n, 1) as v,
          case when n = 0 or d.start is null then coalesce(d.start, 1) else d.start - 1 + n end as shown
        from cnt c left join defs d on d.num_id = c.num_id and d.level = c.k),
rend as (select *, case num_fmt
   when 'decimalZero' then case when shown < 10 then '0' || shown else cast(shown as varchar) end
   when 'lowerLetter' then case when shown <= 26 then chr(cast(96 + shown as int)) else
        chr(cast(96 + (shown - 1) // 26 as int)) || chr(cast(97 + (shown - 1) % 26 as int)) end
   when 'upperLetter' then case when shown <= 26 then chr(cast(64 + shown as int)) else
        chr(cast(64 + (shown - 1) // 26 as int)) || chr(cast(65 + (shown - 1) % 26 as int)) end
   when 'upperRoman' then ['','C','CC','CCC'][shown // 100 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][(shown // 10) % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][shown % 10 + 1]
   when 'lowerRoman' then lower(['','C','CC','CCC'][shown // 100 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][(shown // 10) % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][shown % 10 + 1])
   else cast(shown as varchar) end as s from val),
wide as (select doc_id, pos, num_id, level, max(s) filter (where k = 0) as s0, max(s) filter (where k = 1) as s1,
         max(s) filter (where k = 2) as s2, cast(max(v) filter (where k = level) as int) as counter from rend group by all)
"""


def list_items(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    items = fx.table(spark, sf, "conversations").select(
        (c % 25).alias("doc_id"), (c * 100 + t).alias("pos"), (c % 4).cast("int").alias("num_id"),
        ((t + c) % 3).cast("int").alias("level"))
    defs = spark.createDataFrame(LIST_DEFS, "num_id int, level int, num_fmt string, lvl_text string, start int")
    return items, defs


@query("w4_w5_list_labels", S.with_(ITEMS) + """
select i.doc_id, i.pos, w.counter, case when w.pos is null then '' when d.num_fmt in ('bullet', 'none')
  then coalesce(nullif(d.lvl_text, ''), '•')
  else replace(replace(replace(d.lvl_text, '%3', case when i.level >= 2 then s2 else '%3' end), '%2',
       case when i.level >= 1 then s1 else '%2' end), '%1', s0) end as label
from its i left join wide w on w.doc_id = i.doc_id and w.pos = i.pos
left join defs d on d.num_id = i.num_id and d.level = i.level""")
def list_labels(spark, sf):
    items, defs = list_items(spark, sf)
    out = st.list_labels(items, defs, ["doc_id"])
    counted = F.when(F.col("label") != "", F.col("counter"))
    return out.select("doc_id", "pos", counted.alias("counter"), "label")


@query("j10_numbering_definitions", """
with num(num_id, abstract_id) as (values (0, 'a'), (1, 'b'), (2, 'a'), (3, 'c')),
 lv(abstract_id, level, num_fmt, lvl_text, start) as (values ('a', 0, 'decimal', '%1.', 1), ('a', 1, 'bullet', 'o', 1),
   ('b', 0, 'upperRoman', '%1)', 4))
select conv_id, turn, coalesce(num_fmt, '') as num_fmt, coalesce(lvl_text, '') as lvl_text, start from conversations c
left join num on num.num_id = conv_id % 5 left join lv on lv.abstract_id = num.abstract_id and lv.level = turn % 2""")
def numbering_definitions(spark, sf):
    num = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "num_id int, abstract_id string")
    lv = spark.createDataFrame([("a", 0, "decimal", "%1.", 1), ("a", 1, "bullet", "o", 1), ("b", 0, "upperRoman", "%1)", 4)],
                               "abstract_id string, level int, num_fmt string, lvl_text string, start int")
    items = fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", (F.col("conv_id") % 5).alias("num_id"), (F.col("turn") % 2).alias("level"))
    out = items.join(num, "num_id", "left").join(lv, ["abstract_id", "level"], "left")
    return out.select("conv_id", "turn", F.coalesce("num_fmt", F.lit("")).alias("num_fmt"),
                      F.coalesce("lvl_text", F.lit("")).alias("lvl_text"), "start")


FIELDS = """
ev as (select user_id % 40 as doc_id, event_id as seq, event_id // 3 as pos, case event_type when 'view' then 'begin'
        when 'signup' then 'end' when 'click' then 'toc' end as kind from events)
"""


@query("w6_contents_fields", """with e as (select user_id % 40 as doc_id, event_id // 3 as pos, event_id as seq,
  case event_type when 'view' then 'begin' when 'signup' then 'end' when 'click' then 'toc' end as raw from events),
 k as (select *, case when raw = 'toc' and coalesce(lag(raw) over (partition by doc_id order by seq), '') <> 'begin' then null else raw end as kind from e),
 s as (select *, sum(case kind when 'begin' then 1 when 'end' then -1 else 0 end) over w as total, count(*) filter (kind = 'toc') over w as spans
   from k window w as (partition by doc_id order by pos, seq)),
 d as (select *, total - min(least(total, 0)) over (partition by doc_id order by pos, seq) as depth from s),
 t as (select *, last_value(case when kind = 'toc' then depth end ignore nulls) over (partition by doc_id order by pos, seq) as opened,
   min(depth) over (partition by doc_id, spans order by pos, seq) as lowest from d)
select doc_id, pos, arg_max(coalesce(lowest >= opened, false), seq) as in_toc from t group by doc_id, pos""")
def contents_fields(spark, sf):
    kind = F.when(F.col("event_type") == "view", "begin").when(F.col("event_type") == "signup", "end").when(
        F.col("event_type") == "click", "toc")
    ev = fx.table(spark, sf, "events").select(
        (F.col("user_id") % 40).alias("doc_id"), F.floor(F.col("event_id") / 3).alias("pos"),
        F.col("event_id").alias("seq"), kind.alias("kind"))
    # an instruction opens a span only right after a begin
    ev = previous(ev, ["doc_id"], "seq", "_p", F.struct("kind"))
    ev = ev.withColumn("kind", F.when((F.col("kind") == "toc") & ~(F.coalesce(F.col("_p.kind"), F.lit("")) == "begin"),
                                      None).otherwise(F.col("kind"))).drop("_p")
    return st.contents_field_rows(ev, ["doc_id"])


@query("w8_neighbours", S.with_(S.OUTLINE) + """select pair_id, side, ord, lag(uid) over w as previous_uid,
 lag(type) over w as previous_type, lead(uid) over w as next_uid, lead(type) over w as next_type from onodes
 window w as (partition by pair_id, side order by ord)""")
def neighbours(spark, sf):
    n = fx.outline_versions(spark, sf)
    item = F.struct("uid", "type")
    n = following(previous(n, KEYS, "ord", "p", item), KEYS, "ord", "n", item)
    return n.select("pair_id", "side", "ord", F.col("p.uid").alias("previous_uid"), F.col("p.type").alias("previous_type"),
                    F.col("n.uid").alias("next_uid"), F.col("n.type").alias("next_type"))


@query("w11_block_index", S.with_(S.OUTLINE) + """select pair_id, side, uid, cast(row_number() over (partition by pair_id,
 side order by ord // 3, uid) - 1 as int) as idx from onodes""")
def block_index(spark, sf):
    n = fx.outline_versions(spark, sf).withColumn("ord", F.floor(F.col("ord") / 3))
    return st.number_blocks(n, KEYS).select("pair_id", "side", "uid", "idx")


@query("f4_promoted_images", S.with_(S.LINES) + """, pr as (select pair_id, side, pos * 10 as ord, 'n' || pos as uid,
  case when pos % 4 = 2 then ' ' else line end as text, pos % 3 as n from lines)
select pair_id, side, ord, uid, 'paragraph' as type from pr where not (trim(text) = '' and n > 0)
union all select pair_id, side, ord + k + 1, uid || '.i' || k, 'image' from pr, range(2) r(k) where trim(text) = '' and k < n""")
def promoted_images(spark, sf):
    pos = F.col("pos")
    image = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: F.struct(
        F.concat(F.lit("n"), pos.cast("string"), F.lit(".i"), k.cast("string")).alias("uid"),
        (pos * 10 + k + 1).alias("ord")))
    n = fx.line_versions(spark, sf).select(
        "pair_id", "side", (pos * 10).alias("ord"), F.concat(F.lit("n"), pos.cast("string")).alias("uid"),
        F.lit("paragraph").alias("type"), F.when(pos % 4 == 2, " ").otherwise(F.col("line")).alias("text"),
        F.slice(image, F.lit(1), pos % 3).alias("images"))
    return st.promote_images(n).select("pair_id", "side", "ord", "uid", "type")
