"""Images and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.catalog import query
from palimpsest.catalog import sqlparts as S
from palimpsest.functions import fingerprint as fp
from palimpsest.operators import media as md
from palimpsest.operators.scan import number_rows
from palimpsest.plans import fixtures as fx
from palimpsest.session import cut_lineage, spread
from palimpsest.sources.text import html_blocks

TWO = S.with_(S.IMAGES) + """, tw as (select vec_id, max(sha256) filter (where side = 'A') as sa, max(sha256) filter (where side = 'B') as sb,
 any_value(words) filter (where side = 'A') as wa, any_value(words) filter (where side = 'B') as wb from im group by vec_id),
 hd as (select *, list_sum([bit_count(xor(wa[k]::bigint, wb[k]::bigint)) for k in range(1, 5)]) as dist from tw)
"""


def two_sides(spark, sf):
    im = fx.image_versions(spark, sf).select("vec_id", "side", F.struct("sha256", "words", "width_emu", "height_emu").alias("i"))
    return im.groupBy("vec_id").agg(F.max(F.when(F.col("side") == "A", F.col("i"))).alias("a"),
                                    F.max(F.when(F.col("side") == "B", F.col("i"))).alias("b"))


def _equal():
    # every 7th pair has no hash
    h = F.when(F.col("vec_id") % 7 != 0, F.col("a.words"))
    return md.images_equal(F.col("a.sha256"), F.col("b.sha256"), h, F.col("b.words"))


@query("i1_image_equality", TWO + """select vec_id, cast(dist as int) as distance, sa = sb or (vec_id % 7 <> 0 and dist <= 3) as equal from hd""")
def equality(spark, sf):
    return two_sides(spark, sf).select("vec_id", md.hamming(F.col("a.words"), F.col("b.words")).alias("distance"),
                                       _equal().alias("equal"))


@query("i2_image_changes", TWO + """, c as (select hd.vec_id, case when hd.vec_id % 11 = 0 then 'image_deleted' when hd.vec_id % 11 = 1
  then 'image_added' when sa = sb or (hd.vec_id % 7 <> 0 and dist <= 3) then 'image_equal' else 'image_modified' end as type, sa, sb
  from hd)
select vec_id, type, case when vec_id % 11 <> 1 then nullif(cast(round_even((vec_id % 40) * 9525 * 3 * 96 / 914400.0, 0) as bigint), 0) end as left_px,
 case when vec_id % 11 <> 0 then nullif(cast(round_even((vec_id % 30 * 9525 + 4762) * 96 / 914400.0, 0) as bigint), 0) end as right_px,
 case when type <> 'image_equal' and vec_id % 11 <> 0 then 'images/' || sb end as right_url from c""")
def changes(spark, sf):
    t = two_sides(spark, sf)
    a, b = F.when(F.col("vec_id") % 11 != 1, F.col("a")), F.when(F.col("vec_id") % 11 != 0, F.col("b"))
    t = t.withColumn("equal", _equal()).withColumn("a", a).withColumn("b", b)
    c = md.image_change(F.col("a"), F.col("b"), F.col("equal"))
    return t.select("vec_id", *[v.alias(k) for k, v in c.items()]).select(
        "vec_id", "type", F.col("left.width_px").alias("left_px"), F.col("right.height_px").alias("right_px"),
        F.col("right.image_url").alias("right_url"))


IMAGE_LISTS = S.with_(S.IMAGES, """
il as (select vec_id % 40 as pair_id, side, row_number() over (partition by vec_id % 40, side order by vec_id) - 1 as idx,
        case when vec_id % 6 = 0 then 'u' || vec_id || side else sha256 end as key from im
       where not (side = 'B' and vec_id % 13 = 4))""", S.align_sql("il", ["pair_id"], "q"), """
pp as (select *, unnest(range(greatest(i2 - i1, j2 - j1))) as k from qops)""", recursive=True)


@query("i3_image_list_changes", IMAGE_LISTS + """select pair_id, case when tag = 'equal' then 'image_equal' when k < i2 - i1 and k < j2 - j1
 then 'image_modified' when k < i2 - i1 then 'image_deleted' else 'image_added' end as type, count(*) as n from pp group by all""")
def list_changes(spark, sf):
    im = fx.image_versions(spark, sf).filter(~((F.col("side") == "B") & (F.col("vec_id") % 13 == 4)))
    im = im.select((F.col("vec_id") % 40).alias("pair_id"), "side", "vec_id", F.when(F.col("vec_id") % 6 != 0, F.col("sha256"))
                   .alias("sha256"), F.concat(F.lit("u"), F.col("vec_id").cast("string"), "side").alias("uid"))
    im = cut_lineage(number_rows(im, ["pair_id", "side"], "vec_id", "idx"))
    return md.list_changes(im, ["pair_id"]).groupBy("pair_id", "type").agg(F.count(F.lit(1)).alias("n"))


# ---- shapes: a page is a text box, its paragraphs and one image are its children --------------------------------

HTML = f"""
hm as (select page_id, regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g') as h from pages),
ht as (select page_id, regexp_replace(regexp_replace(h, '(?i)<(h[1-6]|p|li)(\\s[^>]*)?>', chr(1) || '\\1' || chr(2), 'g'),
  '(?i)</?(h[1-6]|p|li|ul|ol|div|nav|article|section|footer|header|body|html|head|title)(\\s[^>]*)?>', chr(1) || '-' || chr(2), 'g') as h from hm),
hp as (select page_id, [x for x in string_split(h, chr(1)) if regexp_matches(x, '^(?i:h[1-6]|p|li)' || chr(2))] as ps from ht),
hx as (select page_id, generate_subscripts(ps, 1) - 1 as pos, unnest(ps) as p from hp),
hb as (select page_id, pos, lower(split_part(p, chr(2), 1)) as tag,
        {S.norm_text("regexp_replace(split_part(p, chr(2), 2), '<[^>]*>', '', 'g')")} as text from hx)
"""
SHAPES = HTML + """,
pg as (select page_id, row_number() over (partition by page_id order by pos) as ord, text from hb where tag = 'p'),
mx as (select page_id, coalesce(max(ord), 0) as n from pg right join (select page_id from pages) using (page_id) group by page_id),
sh as (
 select page_id as pair_id, 'A' as side, ord, 'paragraph' as type, text, null as sha256 from pg
 union all select page_id, 'A', n + 1, 'image', null, sha256('p' || page_id) from mx
 union all select page_id, 'B', ord, 'paragraph', case when page_id % 4 = 3 and ord % 3 = 0 then text || ' more' else text end, null
   from pg where not (page_id % 4 = 0 and ord = 2) and page_id % 4 <> 2
 union all select page_id, 'B', n + 1, 'image', null, sha256(case when page_id % 4 = 1 then 'q' else 'p' end || page_id) from mx
   where page_id % 4 <> 2)
"""


def shape_nodes(spark, sf):
    pages = spread(fx.table(spark, sf, "pages").select(F.col("page_id").alias("pair_id"), "html"), "pair_id")
    b = html_blocks(pages, ["pair_id"], "html", tags=["p"])
    b = number_rows(b, ["pair_id"], "pos", "n").select("pair_id", (F.col("n") + 1).cast("int").alias("ord"), "text")
    count = b.groupBy("pair_id").agg(F.max("ord").alias("n"))
    img = pages.select("pair_id").join(count, "pair_id", "left").select("pair_id", (F.coalesce("n", F.lit(0)) + 1).alias("ord"))
    k = F.col("pair_id") % 4
    none = F.lit(None).cast("string")

    def rows(df, side, kind, text, sha):
        return df.select("pair_id", F.lit(side).alias("side"), "ord", F.lit(kind).alias("type"), text.alias("text"),
                         sha.alias("sha256"), F.concat(F.lit("c"), F.col("ord").cast("string")).alias("uid"))

    def digest(letter):
        return F.sha2(F.concat(letter, F.col("pair_id").cast("string")).cast("binary"), 256)

    more = F.when((k == 3) & (F.col("ord") % 3 == 0), F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    return (rows(b, "A", "paragraph", F.col("text"), none).unionByName(rows(img, "A", "image", none, digest(F.lit("p"))))
            .unionByName(rows(b.filter(~((k == 0) & (F.col("ord") == 2)) & (k != 2)), "B", "paragraph", more, none))
            .unionByName(rows(img.filter(k != 2), "B", "image", none, digest(F.when(k == 1, "q").otherwise("p")))))


@query("s3_html_blocks", S.with_(HTML) + """select page_id, cast(pos as int) as pos, case when tag in ('p', 'li') then 'paragraph' else 'heading' end as type,
 case when tag not in ('p', 'li') then cast(substr(tag, 2, 1) as int) end as level, text from hb""")
def html(spark, sf):
    pages = spread(fx.table(spark, sf, "pages").select("page_id", "html"), "page_id")
    return html_blocks(pages, ["page_id"], "html")


@query("g5_shape_parts", S.with_(SHAPES) + """select pair_id, side, md5(string_agg(case when type = 'image' then 'img:' || substr(sha256, 1, 16)
 else text end, '|' order by ord)) as parts from sh where type = 'image' or text <> '' group by all""")
def shape_parts(spark, sf):
    p = md.shape_parts(shape_nodes(spark, sf), ["pair_id", "side"])
    return p.select("pair_id", "side", F.md5(F.array_join("parts", "|")).alias("parts"))


@query("g6_shape_signatures", S.with_(SHAPES) + """select pair_id, side, 'S:box:' || substr(md5(string_agg(case when type = 'image' then 'img:' ||
 substr(sha256, 1, 16) else text end, ' | ' order by ord)), 1, 16) as sig from sh where type = 'image' or text <> '' group by all""")
def shape_signatures(spark, sf):
    p = md.shape_parts(shape_nodes(spark, sf), ["pair_id", "side"])
    return p.select("pair_id", "side", fp.shape_signature(F.lit("box"), F.col("parts"), F.lit("u"), F.lit("p"), F.lit(None)
                                                          .cast("string")).alias("sig"))


@query("h1_diffable_children", S.with_(SHAPES) + """select pair_id, side, cast(row_number() over (partition by pair_id, side order by ord) - 1 as int)
 as idx, type from sh where type = 'image' or text <> ''""")
def diffable(spark, sf):
    return md.diffable(shape_nodes(spark, sf), ["pair_id", "side"]).select("pair_id", "side", "idx", "type")


H2 = S.with_(SHAPES, """
dk as (select pair_id, side, row_number() over (partition by pair_id, side order by ord) - 1 as idx, type, text, sha256,
        case when type = 'image' then 'I:sha:' || substr(sha256, 1, 16) else 'P:' || substr(md5(text), 1, 16) end as key
       from sh where type = 'image' or text <> '')""", S.align_sql("dk", ["pair_id"], "q"), """
sp as (select *, unnest(range(greatest(i2 - i1, j2 - j1))) as k from qops),
sj as (select s.pair_id, tag, x.type as xt, y.type as yt from sp s
  left join dk x on x.pair_id = s.pair_id and x.side = 'A' and x.idx = s.i1 + k and k < i2 - i1
  left join dk y on y.pair_id = s.pair_id and y.side = 'B' and y.idx = s.j1 + k and k < j2 - j1),
sr as (select pair_id, tag, case when tag = 'equal' then [xt || '_equal'] when yt is null then [xt || '_deleted']
   when xt is null then [case when yt = 'image' then 'image_added' else 'paragraph_inserted' end]
   when xt = yt then [xt || '_modified'] else [xt || '_deleted', case when yt = 'image' then 'image_added' else 'paragraph_inserted' end] end as t from sj)""",
            recursive=True)


@query("h2_shape_changes", H2 + """select pair_id, u as type, count(*) as n from (select pair_id, unnest(t) as u from sr)
 where pair_id in (select pair_id from sr where tag <> 'equal') group by all""")
def shape_changes(spark, sf):
    items = cut_lineage(md.diffable(shape_nodes(spark, sf), ["pair_id", "side"]))
    return md.shape_changes(items, ["pair_id"]).groupBy("pair_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("h3_shape_reports", S.with_(SHAPES) + """, r as (select pair_id, side, coalesce(string_agg(case when type = 'image' then '[Image]' else
  nullif(trim(text), '') end, chr(10) order by ord), '') as l, count(*) filter (where type = 'image') as n from sh group by all),
 f as (select p.page_id as pair_id, a.l as la, b.l as lb, a.n as na, b.n as nb from pages p left join r a on a.pair_id = p.page_id and a.side = 'A'
  left join r b on b.pair_id = p.page_id and b.side = 'B')
select pair_id, md5(la) as left_preview, coalesce(la <> '' or na > 0, false) and not coalesce(lb <> '' or nb > 0, false) as shape_cleared from f""")
def shape_reports(spark, sf):
    r = md.shape_report(shape_nodes(spark, sf), ["pair_id", "side"])
    a = r.filter("side = 'A'").select("pair_id", "preview", F.col("has_content").alias("ha"))
    b = r.filter("side = 'B'").select("pair_id", F.col("has_content").alias("hb"))
    return a.join(b, "pair_id", "left").select("pair_id", F.md5("preview").alias("left_preview"),
                                               md.cleared(F.col("ha"), F.col("hb")).alias("shape_cleared"))
