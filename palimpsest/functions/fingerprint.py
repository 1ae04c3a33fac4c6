"""Fingerprints of blocks, images, shapes, cells and tables as column expressions.

``images`` is an array of structs with ``sha256, name, width_emu, height_emu, uid``; ``numbering`` a struct with
``level, num_fmt, lvl_text``; ``content`` an array of typed cell items with ``type, uid, text, sha256, images,
table_sig``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import chapter_number, heading_body, norm_for_signature, path_bodies

SEPARATOR = "|"


EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"


def short_hash(s: Column, n: int = 16) -> Column:
    """First ``n`` digits of the md5, or the word ``empty``.  ``s`` appears once, so it is computed once."""
    digest = F.md5(F.coalesce(s, F.lit("")))
    return F.substring(F.replace(digest, F.lit(EMPTY_MD5), F.lit("empty")), 1, n)


def _text_part(normalized: Column) -> Column:
    """``txt:`` before a text that is not empty, with the text named only once."""
    return F.regexp_replace(normalized, "(?s)^(.+)$", "txt:$1")


def _joined(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda p: p != ""), SEPARATOR)


def _filled(s: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(s, F.lit(""))), F.lit(""))


def numbering_key(numbering: Column) -> Column:
    """Level, format and pattern of a list item; the id of its list says nothing across documents."""
    key = F.concat(
        F.lit("N:"), F.coalesce(numbering["level"], F.lit(0)).cast("string"), F.lit(":"),
        norm_for_signature(numbering["num_fmt"]), F.lit(":"), norm_for_signature(numbering["lvl_text"]))
    return F.when(numbering.isNotNull(), key).otherwise("")


def image_key(img: Column) -> Column:
    size = F.when((F.coalesce(img["width_emu"], F.lit(0)) != 0) | (F.coalesce(img["height_emu"], F.lit(0)) != 0),
                  dimensions(img["width_emu"], img["height_emu"]))
    fallback = F.coalesce(F.nullif(norm_for_signature(img["name"]), F.lit("")), size, img["uid"], F.lit(""))
    return F.coalesce(F.concat(F.lit("img:"), F.substring(_filled(img["sha256"]), 1, 16)),
                      F.concat(F.lit("img:nosha:"), short_hash(fallback, 8)))


def dimensions(width: Column, height: Column) -> Column:
    return F.concat(F.coalesce(width, F.lit(0)).cast("string"), F.lit("x"),
                    F.coalesce(height, F.lit(0)).cast("string"))


def _text_parts(text: Column, numbering: Column, images: Column, normalized: bool) -> Column:
    first = F.array(_text_part(text if normalized else norm_for_signature(text)), numbering_key(numbering))
    keys = F.coalesce(F.transform(images, image_key), F.array().cast("array<string>"))
    return _joined(F.concat(first, keys))


IMAGE = "struct<sha256:string,name:string,width_emu:bigint,height_emu:bigint,uid:string>"
IMAGES = f"array<{IMAGE}>"
NUMBERING = "struct<level:int,num_fmt:string,lvl_text:string,label:string>"


def heading_signature(level: Column, text: Column, numbering: Column, images: Column, normalized: bool = False) -> Column:
    return F.concat(F.lit("H"), F.coalesce(level, F.lit(0)).cast("string"), F.lit(":"),
                    short_hash(_text_parts(text, numbering, images, normalized)))


def paragraph_signature(text: Column, numbering: Column, images: Column, normalized: bool = False) -> Column:
    """``normalized`` says that ``text`` is already in signature form."""
    return F.concat(F.lit("P:"), short_hash(_text_parts(text, numbering, images, normalized)))


def image_signature(img: Column) -> Column:
    size = dimensions(img["width_emu"], img["height_emu"])
    name = F.nullif(norm_for_signature(img["name"]), F.lit(""))
    who = F.coalesce(F.substring(_filled(img["sha256"]), 1, 16), F.substring(F.md5(name), 1, 12),
                     F.concat(F.lit("nodata:"), short_hash(img["uid"], 8)))
    return F.concat(F.lit("I:"), who, F.lit(":"), size)


def empty_shape_id(uid: Column, parent_uid: Column, ctx: Column) -> Column:
    raw = F.concat(F.coalesce(parent_uid, F.lit("")), F.lit(":"), F.coalesce(uid, F.lit("")), F.lit(":"),
                   F.coalesce(ctx, F.lit("")))
    return F.substring(F.md5(raw), 1, 8)


def shape_signature(shape_type: Column, parts: Column, uid: Column, parent_uid: Column, ctx: Column) -> Column:
    ctx = F.coalesce(ctx, F.lit(""))
    body = F.array_join(parts, " | ")
    kind = F.concat(F.lit("S:"), F.coalesce(shape_type, F.lit("")), F.lit(":"))
    full = F.when(ctx != "", F.concat(ctx, F.lit("||"), body)).otherwise(body)
    return F.when(body == "", F.concat(kind, F.lit("empty:"), empty_shape_id(uid, parent_uid, ctx))).otherwise(
        F.concat(kind, short_hash(full)))


def table_fallback_signature(rows: Column, cols: Column, text: Column) -> Column:
    return F.concat(F.lit("T:"), dimensions(rows, cols), F.lit(":"), short_hash(norm_for_signature(text)))


def other_signature(kind: Column, text: Column) -> Column:
    return F.concat(F.lit("U:"), kind, F.lit(":"), short_hash(norm_for_signature(text), 12))


def _cell_image_key(img: Column) -> Column:
    """In cells an image without bytes is known by its uid only."""
    return F.coalesce(F.concat(F.lit("img:"), F.substring(_filled(img["sha256"]), 1, 16)),
                      F.concat(F.lit("img:nosha:"), short_hash(_filled(img["uid"]), 8)))


def cell_item_key(item: Column) -> Column:
    known = F.filter(item["images"], lambda i: _filled(i["sha256"]).isNotNull() | _filled(i["uid"]).isNotNull())
    keys = F.coalesce(F.transform(known, _cell_image_key), F.array().cast("array<string>"))
    parts = _joined(F.concat(F.array(_text_part(norm_for_signature(item["text"]))), keys))
    prefix = F.when(item["type"] == "shape", "SHP:").otherwise("P:")
    body = F.concat(prefix, F.replace(F.substring(F.md5(parts), 1, 16), F.lit(EMPTY_MD5[:16]),
                                      F.concat(F.lit("empty:"), F.coalesce(item["uid"], F.lit("")))))
    image = F.coalesce(F.concat(F.lit("img:"), F.substring(_filled(item["sha256"]), 1, 16)),
                       F.concat(F.lit("img:nosha:"), F.substring(F.md5(_filled(item["uid"])), 1, 8)),
                       F.lit("img:unknown"))
    return (F.when(item["type"].isin("paragraph", "shape"), body).when(item["type"] == "image", image)
            .when(item["type"] == "table", F.coalesce(item["table_sig"], F.lit("TBL:NONE")))
            .otherwise(F.concat(F.upper(item["type"]), F.lit(":UNKNOWN"))))


def cell_signature(content: Column, text: Column, row_span: Column, col_span: Column) -> Column:
    keys = F.array_join(F.transform(content, cell_item_key), SEPARATOR)
    return (F.when(F.size(F.coalesce(content, F.array().cast(CONTENT))) > 0, F.concat(F.lit("C:"), short_hash(keys)))
            .when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("C:"), short_hash(norm_for_signature(text))))
            .otherwise(F.concat(F.lit("C:empty:"), dimensions(row_span, col_span))))


CONTENT = (f"array<struct<type:string,uid:string,text:string,text_display:string,sha256:string,"
           f"images:{IMAGES},table_sig:string>>")


def alignment_key(kind: Column, signature: Column, level: Column, text: Column, parts: Column, uid: Column,
                  parent_uid: Column, ctx: Column, normalized: bool = False) -> Column:
    """What two blocks must share to be aligned as equal; headings ignore their chapter number."""
    bodies = path_bodies(ctx)
    shape_head = F.when(
        F.size(F.coalesce(parts, F.array().cast("array<string>"))) == 0,
        F.concat(F.lit("shape|empty|"), empty_shape_id(uid, parent_uid, bodies), F.lit("|"), bodies),
    ).otherwise(F.concat(F.lit("shape|"), F.substring(F.md5(F.array_join(parts, " ")), 1, 16), F.lit("|n"),
                         F.size(parts).cast("string"), F.lit("|"), bodies))
    t = text if normalized else norm_for_signature(text)
    chapter = chapter_number(t)
    depth = F.regexp_count(chapter, F.lit("\\d+"))
    lvl = F.when(F.coalesce(level, F.lit(0)) == 0, 1).otherwise(level)
    heading = F.concat(F.lit("H"), lvl.cast("string"), F.lit("|d"), depth.cast("string"), F.lit("|"),
                       F.substring(F.md5(heading_body(t)), 1, 12))
    return (F.when(kind == "shape", shape_head).when(kind == "heading", heading)
            .otherwise(F.concat(kind, F.lit("|"), F.coalesce(signature, F.lit("")))))


def shape_child_key(kind: Column, sha256: Column, uid: Column, normalized: Column) -> Column:
    who = _filled(uid)
    image = F.coalesce(F.concat(F.lit("I:sha:"), F.substring(_filled(sha256), 1, 16)),
                       F.concat(F.lit("I:uid:"), F.coalesce(F.substring(F.md5(who), 1, 12), F.lit("anon"))))
    para = F.when(normalized != "", F.concat(F.lit("P:"), F.substring(F.md5(normalized), 1, 16))).otherwise(
        F.concat(F.lit("P:empty:"), F.coalesce(F.substring(F.md5(who), 1, 8), F.lit("anon"))))
    return F.when(kind == "image", image).otherwise(para)
