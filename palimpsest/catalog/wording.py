"""Word-level differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.catalog import sqlparts as S
from palimpsest.operators import wording as w
from palimpsest.plans import fixtures as fx
from palimpsest.session import spread

SPAN_TEXT = "array_join(transform(spans, s -> concat_ws('~', s.type, s.side, s.old_text, s.new_text, s.space_before)), '¦')"


def edited_lines(spark, sf):
    """Each line of side A against an edited form: words put in, dropped, and punctuation moved."""
    a = fx.line_versions(spark, sf).filter("side = 'A'").select("pair_id", "pos", "line")
    e = F.regexp_replace("line", "([aeiou]) ([a-m])", "$1 x $2")
    e = F.when(F.col("pos") % 3 == 0, F.regexp_replace(e, ", ", " ;")).otherwise(e)
    a = spread(a, "pair_id", "pos")  # word alignment costs far more than its bytes
    return a.select("pair_id", "pos", "line", F.when(F.col("pos") % 7 == 6, F.col("line")).otherwise(e).alias("other"))


@query("p1_word_spans")
def word_spans(spark, sf):
    d = w.word_spans(edited_lines(spark, sf), "line", "other", "line", "other")
    return d.select("pair_id", "pos", F.size("spans").alias("n_spans"), F.md5(F.expr(SPAN_TEXT)).alias("spans"))


@query("p1_word_span_counts", S.with_(S.LINES, f"""
e0 as (select pair_id, pos, line, regexp_replace(line, '([aeiou]) ([a-m])', '\\1 x \\2', 'g') as o from lines where side = 'A'),
e1 as (select pair_id * 1000000 + pos as pair_id, line, case when pos % 7 = 6 then line when pos % 3 = 0
        then regexp_replace(o, ', ', ' ;', 'g') else o end as other from e0),
tk as (select pair_id, 'A' as side, unnest(string_split({S.norm_diff('line')}, ' ')) as key,
         generate_subscripts(string_split({S.norm_diff('line')}, ' '), 1) - 1 as idx from e1
       where {S.norm_diff('line')} <> {S.norm_diff('other')}
       union all select pair_id, 'B', unnest(string_split({S.norm_diff('other')}, ' ')),
         generate_subscripts(string_split({S.norm_diff('other')}, ' '), 1) - 1 from e1
       where {S.norm_diff('line')} <> {S.norm_diff('other')})""", S.align_sql("tk", ["pair_id"], "q"), recursive=True) + f"""
select e1.pair_id, coalesce(count(o.tag) filter (where o.tag = 'insert'), 0) as n_insert,
 count(o.tag) filter (where o.tag = 'replace') as n_replace,
 case when {S.norm_diff('line')} = '' and {S.norm_diff('other')} = '' then 0
      when {S.norm_diff('line')} = {S.norm_diff('other')} then 1 else count(o.tag) end as n_spans
from e1 left join qops o on o.pair_id = e1.pair_id group by e1.pair_id, line, other""")
def word_span_counts(spark, sf):
    d = w.word_spans(edited_lines(spark, sf), "line", "other", "line", "other")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["type"] == kind)).cast("long")

    return d.select((F.col("pair_id") * 1000000 + F.col("pos")).alias("pair_id"), n("insert").alias("n_insert"),
                    n("replace").alias("n_replace"), F.size("spans").cast("long").alias("n_spans"))


@query("p2_line_spans")
def line_spans(spark, sf):
    """Whole documents as multi-line paragraphs: original against edited version."""
    v = fx.line_versions(spark, sf)
    text = v.groupBy("pair_id", "side").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))),
                                                                     lambda x: x["line"]), "\n").alias("t"))
    both = text.groupBy("pair_id").agg(F.max(F.when(F.col("side") == "A", F.col("t"))).alias("a"),
                                       F.max(F.when(F.col("side") == "B", F.col("t"))).alias("b"))
    d = w.text_diff(both, ["pair_id"], "a", "b", "a", "b")
    return d.select("pair_id", F.size("spans").alias("n_spans"), F.md5(F.expr(SPAN_TEXT)).alias("spans"))


@query("p3_numbering_change", """
with n as (select conv_id, turn, case when turn % 3 = 0 then null else turn % 4 end as a, case when turn % 5 = 0 then null
  else conv_id % 4 end as b from conversations)
select conv_id, turn, a is distinct from b as changed from n""")
def numbering_change(spark, sf):
    def num(missing, v):
        return F.when(~missing, F.struct((F.lit(0)).alias("level"), F.lit("decimal").alias("num_fmt"),
                                         F.lit("%1.").alias("lvl_text"), v.cast("string").alias("label")))

    t, c = F.col("turn"), F.col("conv_id")
    d = fx.table(spark, sf, "conversations").select("conv_id", "turn", num(t % 3 == 0, t % 4).alias("a"),
                                                    num(t % 5 == 0, c % 4).alias("b"))
    return d.select("conv_id", "turn", w.numbering_changed(F.col("a"), F.col("b")).alias("changed"))
