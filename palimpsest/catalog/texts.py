"""Text normal forms, tokens and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.catalog import sqlparts as S
from palimpsest.functions import numbers, text
from palimpsest.functions.kernels import compose
from palimpsest.plans.fixtures import table

NOISY = """
ln as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos,
              unnest(string_split(text, chr(10))) as line from documents),
ny as (select doc_id, pos, replace(replace(line, ', ', chr(160) || ',' || chr(8203)), '. ',
              chr(8232) || '( a )' || chr(9) || '. ' || chr(11)) ||
              case when pos % 4 = 0 then ' ;' when pos % 4 = 1 then chr(13) || chr(10) || chr(12288) || 'z ,y' else '' end
              as line from ln)
"""


def noisy_lines(spark, sf):
    """Every line of every document, with separators replaced by awkward whitespace."""
    ln = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    s = F.replace(F.col("line"), F.lit(", "), F.lit("\u00a0,\u200b"))
    s = F.replace(s, F.lit(". "), F.lit("\u2028( a )\t. \x0b"))
    tail = F.when(F.col("pos") % 4 == 0, " ;").when(F.col("pos") % 4 == 1, "\r\n\u3000z ,y").otherwise("")
    return ln.select("doc_id", "pos", F.concat(s, tail).alias("line"))


def _simple(name, fn, sql_expr):
    @query(name, S.with_(NOISY) + f"select doc_id, pos, {sql_expr} as v from ny")
    def run(spark, sf):
        return noisy_lines(spark, sf).select("doc_id", "pos", fn(F.col("line")).alias("v"))

    return run


_simple("t1_norm_base", text.norm_base, S.base("line"))
_simple("t2_norm_text", text.norm_text, S.norm_text("line"))
_simple("t3_norm_for_signature", text.norm_for_signature, S.norm_sig("line"))
_simple("t4_norm_for_diff", text.norm_for_diff, S.norm_diff("line"))
_simple("t5_norm_for_align", text.norm_for_align, S.norm_align("line"))
_RAW = S.base("line", "chr(10)").replace("chr(9), ' '", "chr(9), chr(9)")
_simple("t6_raw_text", text.raw_text, f"regexp_replace(regexp_replace({_RAW}, '^{S.WS}', ''), '{S.WS}$', '')")
_simple("t7_norm_for_match", text.norm_for_match, S.norm_match("line"))
_simple("t8_tokenize", lambda c: F.array_join(F.array_sort(text.tokenize(c)), "|"),
        "coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(line), '[\\p{L}\\p{N}_]+'))), '|'), '')")
_simple("t9_detokenize", lambda c: text.detokenize(F.split(text.norm_for_diff(c), " ")),
        f"trim(regexp_replace(regexp_replace({S.norm_diff('line')}, ' ([,;])', '\\1', 'g'), '([,;]) ', '\\1  ', 'g'))")


@query("t1_unicode_composition", """
select doc_id, md5(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)))) as v
from documents""")
def composed(spark, sf):
    s = F.replace(F.replace(F.col("text"), F.lit("\u00e9"), F.lit("e\u0301")), F.lit("\u00fc"), F.lit("u\u0308"))
    docs = table(spark, sf, "documents").select("doc_id", s.alias("decomposed"))
    return docs.select("doc_id", F.md5(compose(F.col("decomposed"))).alias("v"))


@query("t10_space_before", S.with_(NOISY) + f"""
, tk as (select doc_id, pos, unnest(string_split({S.norm_diff('line')}, ' ')) as tok,
                generate_subscripts(string_split({S.norm_diff('line')}, ' '), 1) as k from ny),
 f as (select *, lag(tok) over (partition by doc_id, pos order by k) as prev from tk)
select doc_id, pos, cast(count(*) filter (where prev is not null and tok not in (',',';','.','!','?',':',')')
       and prev <> '(') as bigint) as spaced from f group by all""")
def space_before(spark, sf):
    tokens = F.split(text.norm_for_diff(F.col("line")), " ")
    df = noisy_lines(spark, sf).select("doc_id", "pos", tokens.alias("t"))
    # neighbours inside one row's array: no shuffle
    flags = F.transform("t", lambda tok, i: text.needs_space_before(F.get("t", i - 1), tok))
    return df.select("doc_id", "pos", F.size(F.filter(flags, lambda x: x)).cast("long").alias("spaced"))


@query("t11_split_heading", f"""
with h as (select n_nationkey as k, '  ' || n_regionkey || '.' || n_nationkey || chr(160) || n_name || ' ,annex' as t
           from nation union all select c_custkey + 1000, c_name || ' ' || c_mktsegment from customer),
n as (select k, lower({S.norm_sig('t')}) as t from h)
select cast(k as bigint) as k, regexp_extract(t, '^(\\d+(\\.\\d+)*)\\s+(.*)', 1) as chapter,
  case when regexp_matches(t, '^(\\d+(\\.\\d+)*)\\s+') then regexp_extract(t, '^(\\d+(\\.\\d+)*)\\s+(.*)', 3) else t end
  as body from n""")
def split_heading(spark, sf):
    n = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("k"),
        F.concat(F.lit("  "), F.col("n_regionkey").cast("string"), F.lit("."), F.col("n_nationkey").cast("string"),
                 F.lit(" "), "n_name", F.lit(" ,annex")).alias("t"))
    c = table(spark, sf, "customer").select((F.col("c_custkey") + 1000).alias("k"),
                                            F.concat_ws(" ", "c_name", "c_mktsegment").alias("t"))
    t = text.norm_for_signature(F.col("t"))
    return n.unionByName(c).select("k", text.chapter_number(t).alias("chapter"), text.heading_body(t).alias("body"))


@query("t11_heading_path_bodies", """
with p as (select n_nationkey as k, (n_regionkey + 1) || ' ' || r_name || ' > ' || n_regionkey || '.' || n_nationkey ||
           ' ' || n_name as ctx from nation join region on r_regionkey = n_regionkey)
select k, array_to_string([regexp_replace(lower(x), '^\\d+(\\.\\d+)*\\s+', '') for x in string_split(ctx, ' > ')], ' > ')
  as v from p""")
def path_bodies(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    ctx = F.concat((F.col("n_regionkey") + 1).cast("string"), F.lit(" "), "r_name", F.lit(" > "),
                   F.col("n_regionkey").cast("string"), F.lit("."), F.col("n_nationkey").cast("string"), F.lit(" "),
                   "n_name")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("k"), text.path_bodies(ctx).alias("v"))


_FONTS = ["Wingdings", "Symbol", "Arial"]
_CODES = ["F0A3", "f0fe", "F052", "F0FC", "F0A1", "F06C", "F0B7", "F041", "0042", "zz"]


@query("t12_symbol_text", """
with e as (select event_id, ['Wingdings','Symbol','Arial'][event_id % 3 + 1] as font,
  ['F0A3','f0fe','F052','F0FC','F0A1','F06C','F0B7','F041','0042','zz'][(event_id // 3) % 10 + 1] as c from events)
select event_id, case when font = 'Wingdings' and upper(c) in ('F0A3') then '☐'
  when font = 'Wingdings' and upper(c) in ('F0FE','F052') then '☑' when font = 'Wingdings' and c = 'F0FC' then '✓'
  when font = 'Wingdings' and c = 'F0A1' then '○' when font = 'Wingdings' and c = 'F06C' then '●'
  when font = 'Symbol' and c = 'F0B7' then '•' when c = 'zz' then ''
  when lower(c) >= 'f000' then chr(cast(('0x' || c) as int) - 61440) else chr(cast(('0x' || c) as int)) end as v from e""")
def symbols(spark, sf):
    ids = F.col("event_id")
    font = F.element_at(F.array(*map(F.lit, _FONTS)), (ids % 3 + 1).cast("int"))
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.floor(ids / 3) % 10 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", text.symbol_text(font, code).alias("v"))


@query("t13_counter_rendering", """
with recursive n as (select p_partkey as k from part),
d as (select k, (k // 1000) as th, (k // 100) % 10 as hu, (k // 10) % 10 as te, k % 10 as o from n),
al as (select k, k as rest, '' as s from n union all
       select k, (rest - 1) // 26, chr(cast(65 + (rest - 1) % 26 as int)) || s from al where rest > 0)
select k, cast(k as varchar) as plain, case when k < 10 then '0' || k else cast(k as varchar) end as zero,
 (select max(s) from al where al.k = d.k and rest = 0) as upper_letter,
 repeat('M', cast(th as int)) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][hu+1]
 || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][te+1]
 || ['','I','II','III','IV','V','VI','VII','VIII','IX'][o+1] as upper_roman from d""")
def counters(spark, sf):
    k = F.col("p_partkey")

    def r(fmt):
        return numbers.render_counter(k, F.lit(fmt))

    return table(spark, sf, "part").select(
        k.alias("k"), r("decimal").alias("plain"), r("decimalZero").alias("zero"),
        r("upperLetter").alias("upper_letter"), r("upperRoman").alias("upper_roman"))


@query("t15_display_text", """
select conv_id, turn, trim(case when turn % 3 = 0 then '' else '  ' || text end ||
  case when turn % 3 = 0 then role else '' end) as v from conversations""")
def display(spark, sf):
    shown = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("  "), "text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.display(F.col("role"), shown).alias("v"))


@query("emu_and_point_lengths", """
select p_partkey, nullif(cast(round_even((p_size * 4762 + p_partkey % 3) * 96 / 914400.0, 0) as bigint), 0) as px,
  cast(floor(p_size * 1.5 * 12700) as bigint) as emu from part""")
def lengths(spark, sf):
    emu = F.col("p_size") * 4762 + F.col("p_partkey") % 3
    return table(spark, sf, "part").select("p_partkey", numbers.emu_to_px(emu).alias("px"),
                                           numbers.points_to_emu(F.col("p_size") * 1.5).alias("emu"))
