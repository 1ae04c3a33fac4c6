"""Fingerprints of headings, paragraphs, images, shapes, cells and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.catalog import sqlparts as S
from palimpsest.functions import fingerprint as fp
from palimpsest.operators import tables as tb
from palimpsest.plans import fixtures as fx

KEYS = ["pair_id", "side"]

# lines with list numbering and images hung on by position
RICH = S.with_(S.LINES, """
rich as (select pair_id, side, pos, line, pos % 4 as level,
  case when pos % 3 = 0 then 'N:' || (pos % 2) || ':decimal:%' || (pos % 2 + 1) || '.' else '' end as nk,
  case pos % 5 when 0 then ['img:' || substr(sha256(cast(pos as varchar)), 1, 16)]
   when 1 then ['img:nosha:' || substr(md5('pic ' || pos), 1, 8), 'img:nosha:' || substr(md5('95x' || pos), 1, 8)]
   else [] end as ik from lines)""")


def rich(spark, sf):
    pos = F.col("pos")
    txt = pos.cast("string")
    num = F.when(pos % 3 == 0, F.struct((pos % 2).cast("int").alias("level"), F.lit("decimal").alias("num_fmt"),
                                        F.concat(F.lit("%"), (pos % 2 + 1).cast("string"), F.lit(".")).alias("lvl_text"),
                                        F.lit("x").alias("label")))

    def img(sha, name, w, h):
        return F.struct(sha.cast("string").alias("sha256"), name.cast("string").alias("name"),
                        w.cast("bigint").alias("width_emu"), h.cast("bigint").alias("height_emu"),
                        F.concat(F.lit("u"), txt).alias("uid"))

    none = F.lit(None)
    images = (F.when(pos % 5 == 0, F.array(img(F.sha2(txt.cast("binary"), 256), none, none, none)))
              .when(pos % 5 == 1, F.array(img(none, F.concat(F.lit(" pic  "), txt), none, none), img(none, none, F.lit(95), pos)))
              .otherwise(F.array().cast(fp.IMAGES)))
    return fx.line_versions(spark, sf).select("pair_id", "side", "pos", "line", (pos % 4).alias("level"),
                                              num.alias("num"), images.alias("images"))


_COMBINED = (f"array_to_string(list_concat(case when {S.norm_sig('line')} <> '' then ['txt:' || {S.norm_sig('line')}] "
             "else [] end, case when nk <> '' then [nk] else [] end, ik), '|')")


@query("g1_heading_signature", RICH + f""", c as (select *, {_COMBINED} as c from rich)
select pair_id, side, pos, 'H' || level || ':' || {S.short_md5('c')} as sig from c""")
def heading_signature(spark, sf):
    return rich(spark, sf).select("pair_id", "side", "pos", fp.heading_signature(
        F.col("level"), F.col("line"), F.col("num"), F.col("images")).alias("sig"))


@query("g2_paragraph_signature", RICH + f""", c as (select *, {_COMBINED} as c from rich)
select pair_id, side, pos, 'P:' || {S.short_md5('c')} as sig from c""")
def paragraph_signature(spark, sf):
    return rich(spark, sf).select("pair_id", "side", "pos", fp.paragraph_signature(
        F.col("line"), F.col("num"), F.col("images")).alias("sig"))


@query("g3_inline_image_keys", RICH + "select pair_id, side, pos, array_to_string(ik, '|') as keys from rich")
def inline_image_keys(spark, sf):
    return rich(spark, sf).select("pair_id", "side", "pos",
                                  F.array_join(F.transform("images", fp.image_key), "|").alias("keys"))


@query("t14_numbering_key", RICH + "select pair_id, side, pos, nk as key from rich")
def numbering_key(spark, sf):
    return rich(spark, sf).select("pair_id", "side", "pos", fp.numbering_key(F.col("num")).alias("key"))


@query("g4_image_signature", S.with_(S.IMAGES) + """
select vec_id, side, 'I:' || case vec_id % 4 when 3 then 'nodata:' || substr(md5('v' || vec_id), 1, 8)
  when 2 then substr(md5('pic ' || vec_id), 1, 12) else substr(sha256, 1, 16) end || ':' || width_emu || 'x' || height_emu
  as sig from im""")
def image_signature(spark, sf):
    v = F.col("vec_id")
    img = F.struct(F.when(v % 4 < 2, F.col("sha256")).alias("sha256"),
                   F.when(v % 4 < 3, F.concat(F.lit("pic "), v.cast("string"))).alias("name"),
                   F.col("width_emu"), F.col("height_emu"), F.concat(F.lit("v"), v.cast("string")).alias("uid"))
    return fx.image_versions(spark, sf).select("vec_id", "side", img.alias("img")).select(
        "vec_id", "side", fp.image_signature(F.col("img")).alias("sig"))


@query("g6_shape_signature", S.with_(S.LINES) + """, s as (select pair_id, side, pos, case when pos % 6 = 5 then '' else
  array_to_string(list_slice(string_split(line, ' '), 1, 3), ' | ') end as body,
  case when pos % 2 = 0 then '' else 'ctx ' || pair_id end as ctx from lines)
select pair_id, side, pos, case when body = '' then 'S:box:empty:' || substr(md5('p:' || pos || ':' || ctx), 1, 8)
  else 'S:box:' || substr(md5(case when ctx = '' then body else ctx || '||' || body end), 1, 16) end as sig from s""")
def shape_signature(spark, sf):
    parts = F.when(F.col("pos") % 6 == 5, F.array().cast("array<string>")).otherwise(
        F.slice(F.split("line", " "), 1, 3))
    ctx = F.when(F.col("pos") % 2 == 1, F.concat(F.lit("ctx "), F.col("pair_id").cast("string")))
    return fx.line_versions(spark, sf).select("pair_id", "side", "pos", fp.shape_signature(
        F.lit("box"), parts, F.col("pos").cast("string"), F.lit("p"), ctx).alias("sig"))


@query("g7_cell_signature", S.with_(S.CELLS) + f"""
, k as (select *, case when pair_id % 5 = 4 then '' else text end as t from cells), sg as (
select pair_id, side, anchor_row, anchor_col,
 case when t = '' then 'C:empty:' || row_span || 'x' || col_span
  when anchor_col = 0 then 'C:' || substr(md5('P:' || substr(md5('txt:' || t || '|img:' || substr(sha256(t), 1, 16)), 1, 16)
       || '|img:' || substr(sha256(t), 1, 16)), 1, 16)
  when anchor_col = 1 then 'C:' || substr(md5('SHP:' || substr(md5('txt:' || t), 1, 16) || '|P:empty:e1'), 1, 16)
  when anchor_col = 2 then 'C:' || substr(md5('T:abc|img:nosha:' || substr(md5('z9'), 1, 8)), 1, 16)
  else 'C:' || substr(md5(t), 1, 16) end as sig from k)
select pair_id, side, md5(string_agg(sig, ',' order by anchor_row, anchor_col)) as cell_sigs from sg group by all""")
def cell_signature(spark, sf):
    t = F.when(F.col("pair_id") % 5 == 4, "").otherwise(F.col("text"))
    none = F.lit(None).cast("string")

    def item(kind, uid=none, text=none, sha=none, images=None, sig=none):
        return F.struct(F.lit(kind).alias("type"), uid.alias("uid"), text.alias("text"), text.alias("text_display"),
                        sha.alias("sha256"), (images if images is not None else F.lit(None)).cast(fp.IMAGES)
                        .alias("images"), sig.alias("table_sig"))

    sha = F.sha2(F.col("t").cast("binary"), 256)
    img = F.array(F.struct(sha.alias("sha256"), none.alias("name"), F.lit(0).cast("bigint").alias("width_emu"),
                           F.lit(0).cast("bigint").alias("height_emu"), F.lit("q").alias("uid")))
    content = (F.when(F.col("t") == "", F.array().cast(fp.CONTENT))
               .when(F.col("anchor_col") == 0, F.array(item("paragraph", text=F.col("t"), images=img), item("image", sha=sha)))
               .when(F.col("anchor_col") == 1, F.array(item("shape", text=F.col("t")), item("paragraph", uid=F.lit("e1"))))
               .when(F.col("anchor_col") == 2, F.array(item("table", sig=F.lit("T:abc")), item("image", uid=F.lit("z9"))))
               .otherwise(F.array().cast(fp.CONTENT)))
    c = fx.order_cells(spark, sf).withColumn("t", t).withColumn("content", content)
    sig = fp.cell_signature(F.col("content"), F.col("t"), F.col("row_span"), F.col("col_span"))
    return tb.per_table(c.withColumn("sig", sig), ["pair_id", "side"], "sig", "cell_sigs")


@query("g9_signature_by_type", S.with_(S.LINES) + f""", s as (select pair_id, side, pos, {S.norm_sig('line')} as t,
  pos % 4 as k from lines)
select pair_id, side, pos, case k when 0 then 'H2:' || case when t = '' then 'empty' else substr(md5('txt:' || t), 1, 16) end
  when 1 then 'P:' || case when t = '' then 'empty' else substr(md5('txt:' || t), 1, 16) end
  when 2 then 'T:2x3:' || {S.short_md5('t')} else 'U:note:' || {S.short_md5('t', 12)} end as sig from s""")
def signature_by_type(spark, sf):
    n_num, n_img = F.lit(None).cast(fp.NUMBERING), F.lit(None).cast(fp.IMAGES)
    k, t = F.col("pos") % 4, F.col("line")
    sig = (F.when(k == 0, fp.heading_signature(F.lit(2), t, n_num, n_img))
           .when(k == 1, fp.paragraph_signature(t, n_num, n_img))
           .when(k == 2, fp.table_fallback_signature(F.lit(2), F.lit(3), t)).otherwise(fp.other_signature(F.lit("note"), t)))
    return fx.line_versions(spark, sf).select("pair_id", "side", "pos", sig.alias("sig"))


@query("g10_alignment_keys", S.with_(S.OUTLINE) + f""", t as (select *, lower({S.norm_sig('text')}) as t from onodes),
 h as (select *, regexp_extract(t, '^(\\d+(\\.\\d+)*)\\s+(.*)', 1) as ch from t)
select pair_id, side, ord, case when type = 'heading' then 'H' || level || '|d' ||
  case when ch = '' then 0 else length(ch) - length(replace(ch, '.', '')) + 1 end || '|' ||
  substr(md5(case when ch = '' then t else regexp_extract(t, '^(\\d+(\\.\\d+)*)\\s+(.*)', 3) end), 1, 12)
  else 'paragraph|P:' || substr(md5('txt:' || {S.norm_sig('text')}), 1, 16) end as key from h""")
def alignment_keys(spark, sf):
    n_num, n_img, none = F.lit(None).cast(fp.NUMBERING), F.lit(None).cast(fp.IMAGES), F.lit(None).cast("string")
    sig = fp.paragraph_signature(F.col("text"), n_num, n_img)
    return fx.outline_versions(spark, sf).select("pair_id", "side", "ord", fp.alignment_key(
        F.col("type"), sig, F.col("level"), F.col("text"), F.lit(None).cast("array<string>"), F.col("uid"), none,
        none).alias("key"))


@query("g10_shape_alignment_keys", S.with_(S.LINES) + """, s as (select pair_id, side, pos, case when pos % 6 = 5 then []
  else list_slice(string_split(line, ' '), 1, 3) end as parts, pair_id || '.1 Ctx > Body' as ctx from lines)
select pair_id, side, pos, case when len(parts) = 0 then 'shape|empty|' || substr(md5('p:' || pos || ':ctx > body'), 1, 8)
  || '|ctx > body' else 'shape|' || substr(md5(array_to_string(parts, ' ')), 1, 16) || '|n' || len(parts) || '|ctx > body'
  end as key from s""")
def shape_alignment_keys(spark, sf):
    parts = F.when(F.col("pos") % 6 == 5, F.array().cast("array<string>")).otherwise(F.slice(F.split("line", " "), 1, 3))
    ctx = F.concat(F.col("pair_id").cast("string"), F.lit(".1 Ctx > Body"))
    return fx.line_versions(spark, sf).select("pair_id", "side", "pos", fp.alignment_key(
        F.lit("shape"), F.lit(None), F.lit(None).cast("int"), F.lit(None).cast("string"), parts,
        F.col("pos").cast("string"), F.lit("p"), ctx).alias("key"))


@query("g14_shape_child_keys", S.with_(S.LINES) + f""", s as (select pair_id, side, pos, pos % 3 as k, {S.norm_text('line')}
  as t from lines)
select pair_id, side, pos, case when k = 0 then 'I:sha:' || substr(sha256('i' || pos), 1, 16)
  when k = 1 then 'I:uid:' || substr(md5('u' || pos), 1, 12) when t = '' then 'P:empty:' || substr(md5('u' || pos), 1, 8)
  else 'P:' || substr(md5(t), 1, 16) end as key from s""")
def shape_child_keys(spark, sf):
    from palimpsest.functions.text import norm_text
    k, p = F.col("pos") % 3, F.col("pos").cast("string")
    return fx.line_versions(spark, sf).select("pair_id", "side", "pos", fp.shape_child_key(
        F.when(k < 2, "image").otherwise("paragraph"), F.when(k == 0, F.sha2(F.concat(F.lit("i"), p).cast("binary"), 256)),
        F.concat(F.lit("u"), p), norm_text(F.col("line"))).alias("key"))
