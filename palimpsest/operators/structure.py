"""Document structure from ordered rows: outline paths, skipped sections, page numbers, list labels.

Input rows are ``nodes`` of many documents: group ``keys`` (for example pair and side), ``ord`` (pre-order
position), ``type``, ``level``, ``text``.  All running state goes through ``scan``, so one very long document is
spread over many tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import fingerprint as fp
from palimpsest.functions.numbers import render_counter
from palimpsest.functions.text import has_text, norm_for_match, norm_for_signature
from palimpsest.operators.scan import AUTO, PLAIN, Run, chunk_for, number_rows, scan

# Headings that start a section left out of the comparison.
SKIPPED_SECTIONS = [
    "muc luc", "mục lục", "table of contents", "目次",
    "ly lich sua doi", "lý lịch sửa đổi", "revision history",
    "change history", "document history", "改訂履歴",
]
# Texts that only say that something goes on overleaf.
CONTINUATION_MARKS = [
    "tiep trang sau", "tiếp trang sau",
    "(tiep trang sau)", "(tiếp trang sau)",
    "continued on next page", "continue on next page",
    "次ページに続く",
]
# A contents line ends in dots or spaces and a page number; four in a row make a contents list.
CONTENTS_LINE = "^.+[.\\s\\x{b7}\\x{2022}]{3,}\\d+\\s*$"
CONTENTS_STYLE = "(?i)^toc\\s*\\d+"
MIN_CONTENTS_LINES = 4
# Fixed value: levels that a list definition has.
LIST_LEVELS = 9


def contains_any(s: Column, patterns: list[str]) -> Column:
    """Whether ``s`` contains one of the patterns; ``s`` is computed once, not for each of them."""
    return F.exists(F.array(s), lambda t: reduce(or_, [t.contains(p) for p in patterns]))


def is_skipped_section(text: Column) -> Column:
    return contains_any(norm_for_match(text), SKIPPED_SECTIONS)


def is_continuation(text: Column) -> Column:
    return contains_any(norm_for_match(text), CONTINUATION_MARKS)


def _level(level: Column) -> Column:
    return F.when(F.coalesce(level, F.lit(0)) <= 0, 1).otherwise(level)


def heading_levels(nodes: DataFrame) -> list[int]:
    """The heading levels that occur, ascending: a handful of numbers, however deep the outline goes."""
    found = nodes.filter(F.col("type") == "heading").select(_level(F.col("level")).cast("int").alias("level")).distinct()
    return sorted(r["level"] for r in found.collect())


def _stack_runs(prefix: str, levels: list[int], is_entry: Column, level: Column, at: Column, value: Column) -> dict[str, Run]:
    """Last entry of each level; an entry is live iff it comes after the last entry of every shallower level."""
    return {f"{prefix}{k}": Run("last", F.when(is_entry & (level == k), F.struct(at.alias("at"), value.alias("v"))))
            for k in levels}


def _live(prefix: str, levels: list[int], kind: str) -> Column:
    """Array of live entries ``struct(level, v)`` from shallow to deep; ``kind`` is the type of ``v``."""
    entries, latest = [], F.lit(-1).cast("long")
    for k in levels:
        e = F.col(f"{prefix}{k}")
        entries.append(F.when(e["at"] > latest, F.struct(F.lit(k).alias("level"), e["v"].alias("v"))))
        latest = F.greatest(latest, e["at"].cast("long"))
    return F.array_compact(F.array(*entries)) if entries else F.array().cast(f"array<struct<level:int,v:{kind}>>")


def drop_skipped_sections(nodes: DataFrame, keys: list[str], chunk: int | None = AUTO) -> DataFrame:
    """Leave out a skipped heading and everything up to the next heading of its level or above.

    A row is inside such a section iff some heading on its raw heading stack (itself included) is skipped.
    """
    heading, levels = F.col("type") == "heading", heading_levels(nodes)
    runs = _stack_runs("_s", levels, heading, _level(F.col("level")), F.col("ord").cast("long"), is_skipped_section(F.col("text")))
    out = scan(nodes, keys, "ord", runs, chunk=chunk)
    inside = F.exists(_live("_s", levels, "boolean"), lambda e: e["v"])
    return out.filter(~inside).drop(*runs)


def drop_skipped_blocks(nodes: DataFrame) -> DataFrame:
    """Leave out contents entries and headings or paragraphs that only announce a continuation."""
    in_toc = F.coalesce(F.col("in_toc"), F.lit(False)) if "in_toc" in nodes.columns else F.lit(False)
    mark = F.col("type").isin("heading", "paragraph") & is_continuation(F.col("text"))
    return nodes.filter(~(in_toc | mark))


def continuation_only_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Tables whose non-blank cells all announce a continuation (tables without any text are not among them)."""
    filled = norm_for_match(F.col("text")) != ""
    return cells.filter(filled).groupBy(*keys).agg(F.min(is_continuation(F.col("text"))).alias("_all")).filter(
        "_all").drop("_all")


def heading_paths(nodes: DataFrame, keys: list[str], chunk: int | None = AUTO) -> DataFrame:
    """Add ``heading_ctx`` and ``heading_level``; blank headings do not touch the path."""
    title = F.trim(F.coalesce("text", F.lit("")))
    entry = (F.col("type") == "heading") & (title != "")
    level, levels = _level(F.col("level")), heading_levels(nodes)
    runs = _stack_runs("_h", levels, entry, level, F.col("ord").cast("long"), title)
    runs["_lv"] = Run("last", F.when(entry, level))
    out = scan(nodes, keys, "ord", runs, chunk=chunk)
    path = F.array_join(F.transform(_live("_h", levels, "string"), lambda e: e["v"]), " > ")
    return out.withColumn("heading_ctx", F.nullif(path, F.lit(""))).withColumn(
        "heading_level", F.coalesce("_lv", F.lit(0)).cast("int")).drop(*runs)


def drop_contents_runs(blocks: DataFrame, keys: list[str], min_lines: int = MIN_CONTENTS_LINES,
                       chunk: int | None = AUTO) -> DataFrame:
    """Leave out runs of at least ``min_lines`` adjacent paragraphs that look like contents lines."""
    looks = (F.col("type") == "paragraph") & F.trim(norm_for_match(F.col("text"))).rlike(CONTENTS_LINE)
    if chunk == AUTO:
        chunk = chunk_for(blocks, keys)
    rows = blocks.withColumn("_toc", looks)
    # rows that are not contents lines number the runs between them
    rows = scan(rows, keys, "ord", {"_run": Run("sum", F.when(F.col("_toc"), 0).otherwise(1))}, tie=["uid"], chunk=chunk)
    if chunk is PLAIN:
        # documents lie together already: no second pass over the texts, and no join
        many = F.count(F.when(F.col("_toc"), 1)).over(W.partitionBy(*keys, "_run")) >= min_lines
        known = reduce(and_, [F.col(k).isNotNull() for k in keys])
        return rows.withColumn("_long", F.coalesce(F.col("_toc"), F.lit(False)) & many & known).filter("not _long").select(*blocks.columns)
    long_runs = rows.filter("_toc").groupBy(*keys, "_run").agg(F.count("*").alias("_n")).filter(
        F.col("_n") >= min_lines).select(*keys, "_run", F.lit(True).alias("_toc"))
    return rows.join(long_runs, [*keys, "_run", "_toc"], "left_anti").drop("_toc", "_run").select(*blocks.columns)


def fix_shape_headings(blocks: DataFrame, keys: list[str], chunk: int | None = AUTO) -> DataFrame:
    """A shape takes the path of the last heading before it, if there is one."""
    heading = F.when(F.col("type") == "heading", F.struct(F.col("heading_ctx").alias("ctx")))
    out = scan(blocks, keys, "ord", {"_hd": Run("last", heading)}, tie=["uid"], chunk=chunk)
    shape = (F.col("type") == "shape") & F.col("_hd.ctx").isNotNull()
    return out.withColumn("heading_ctx", F.when(shape, F.col("_hd.ctx")).otherwise(F.col("heading_ctx"))).drop("_hd")


def number_blocks(blocks: DataFrame, keys: list[str], chunk: int | None = AUTO) -> DataFrame:
    """Dense zero-based ``idx`` in order of ``(ord, uid)``."""
    return number_rows(blocks, keys, "ord", "idx", tie=["uid"], chunk=chunk).withColumn("idx", F.col("idx").cast("int"))


def promote_images(nodes: DataFrame) -> DataFrame:
    """A paragraph without text but with images becomes one image block per image, at the image's own place.

    ``images`` is an array of structs that carry ``uid`` and ``ord`` next to the image fields.
    """
    images = F.coalesce(F.col("images"), F.array().cast(nodes.schema["images"].dataType))
    only = (F.col("type") == "paragraph") & (norm_for_signature(F.col("text")) == "") & (F.size(images) > 0)
    own = F.array(F.struct(F.lit(None).cast(nodes.schema["images"].dataType.elementType).alias("img")))
    each = F.transform(images, lambda i: F.struct(i.alias("img")))
    out = nodes.withColumn("_x", F.explode(F.when(only, each).otherwise(own)))
    img = F.col("_x.img")
    return out.withColumn("type", F.when(img.isNotNull(), "image").otherwise(F.col("type"))).withColumn(
        "uid", F.coalesce(img["uid"], F.col("uid"))).withColumn(
        "ord", F.coalesce(img["ord"].cast(nodes.schema["ord"].dataType), F.col("ord"))).withColumn(
        "images", F.when(img.isNotNull(), F.array(img)).otherwise(F.col("images"))).drop("_x")


def page_numbers(paras: DataFrame, keys: list[str], chunk: int | None = AUTO) -> DataFrame:
    """Add ``page``: a break before counts for the paragraph itself, breaks inside only for what follows."""
    out = scan(paras, keys, "pos", {
        "_before": Run("sum", F.col("break_before").cast("long")),
        "_inside": Run("sum", F.col("breaks_inside").cast("long"), exclusive=True)}, chunk=chunk)
    return out.withColumn("page", (1 + F.col("_before") + F.col("_inside")).cast("int")).drop("_before", "_inside")


def list_counters(items: DataFrame, keys: list[str], chunk: int | None = AUTO) -> DataFrame:
    """Add ``counter`` and ``counters`` (one per level) to list items ordered by ``pos``.

    The counter of an item is its start value plus the earlier items of its level since the last item of a
    shallower level in the same list.
    """
    if chunk == AUTO:
        chunk = chunk_for(items, [*keys, "num_id"])
    levels = range(LIST_LEVELS)
    pos = F.col("pos").cast("long")
    resets = {f"_g{k}": Run("max", F.when(F.col("level") < k, pos)) for k in levels}
    out = scan(items, [*keys, "num_id"], "pos", resets, chunk=chunk)
    # nth item of its level inside its reset group; the group starts at the last shallower item
    nths = {f"_n{k}": Run("count", F.when(F.col("level") == k, F.lit(1))) for k in levels}
    out = scan(out, [*keys, "num_id"], "pos", nths, chunk=chunk)
    starts = {f"_b{k}": Run("last", F.when(F.col("level") < k, F.struct(F.col(f"_n{k}").alias("n")))) for k in levels}
    out = scan(out, [*keys, "num_id"], "pos", starts, chunk=chunk)
    def count(k):
        return F.col(f"_n{k}") - F.coalesce(F.col(f"_b{k}.n"), F.lit(0))

    counts = F.array(*[count(k).cast("int") for k in levels])
    return out.withColumn("counts", counts).drop(*resets, *nths, *starts)


def list_labels(items: DataFrame, defs: DataFrame, keys: list[str], chunk: int | None = AUTO) -> DataFrame:
    """Add ``counter`` and ``label``.  ``defs`` has ``num_id, level, num_fmt, lvl_text, start``.

    The pattern of a level names counters as %1 ... %9; a level that has not been counted shows its start.
    """
    per_list = defs.groupBy("num_id").agg(F.map_from_entries(F.collect_list(
        F.struct("level", F.struct("num_fmt", "lvl_text", "start")))).alias("_defs"))
    own = F.try_element_at("_defs", F.col("level"))
    # an item of a level without definition neither counts nor resets
    out = items.join(per_list, "num_id", "left").withColumn("_shown", F.col("level")).withColumn(
        "level", F.when(own.isNotNull(), F.col("level")))
    out = list_counters(out, keys, chunk).withColumn("level", F.col("_shown")).drop("_shown")

    def shown(k):
        d = F.try_element_at("_defs", F.lit(k))
        n = F.get("counts", F.lit(k))
        # deeper levels have been reset; levels without a definition start at one and count in decimals
        value = F.when((n > 0) & d.isNotNull(), d["start"] - 1 + n).otherwise(F.coalesce(d["start"], F.lit(1)))
        return render_counter(value, F.coalesce(d["num_fmt"], F.lit("decimal")))

    label = F.coalesce(own["lvl_text"], F.lit(""))
    for k in range(LIST_LEVELS - 1, -1, -1):
        # the placeholder of a deeper level is left as it is; naming the label once keeps the expression small
        target = F.when(F.col("level") >= k, F.lit(f"%{k + 1}")).otherwise(F.lit("\u0000"))
        label = F.replace(label, target, shown(k))
    bullet = own["num_fmt"].isin("bullet", "none")
    pattern = F.coalesce(F.nullif(own["lvl_text"], F.lit("")), F.lit("•"))
    label = F.when(own.isNull(), "").when(bullet, pattern).otherwise(label)
    counter = F.coalesce(own["start"], F.lit(1)) - 1 + F.get("counts", F.col("level"))
    return out.withColumn("counter", counter.cast("int")).withColumn("label", label).drop("_defs", "counts")


def contents_field_rows(events: DataFrame, keys: list[str], chunk: int | None = AUTO) -> DataFrame:
    """Whether each paragraph lies in a contents field, by the state after its own field events.

    ``events`` has ``pos, seq, kind`` with kind ``begin``, ``toc`` (a contents instruction right after a begin) or
    ``end``; paragraphs without events carry one row with a null kind.  A contents instruction at depth d opens a span, which
    the first event that brings the depth below d closes; a later instruction takes the place of an earlier one.
    """
    delta = F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "end", -1).otherwise(0).cast("long")
    if chunk == AUTO:
        chunk = chunk_for(events, keys)
    rows = number_rows(events, keys, "pos", "_e", tie=["seq"], chunk=chunk)
    rows = scan(rows, keys, "_e", {"_sum": Run("sum", delta)}, chunk=chunk)
    # a depth that never falls below zero: subtract the lowest point reached so far
    rows = scan(rows, keys, "_e", {"_low": Run("min", F.least(F.col("_sum"), F.lit(0).cast("long")))}, chunk=chunk)
    rows = rows.withColumn("_depth", F.col("_sum") - F.col("_low"))
    # the last instruction counts: its depth, and the lowest depth since
    toc = F.col("kind") == "toc"
    rows = scan(rows, keys, "_e", {"_spans": Run("sum", F.when(toc, 1).otherwise(0)), "_at": Run("last", F.when(toc, F.col("_depth")))}, chunk=chunk)
    rows = scan(rows, [*keys, "_spans"], "_e", {"_least": Run("min", F.col("_depth"))}, chunk=chunk)
    live = F.coalesce(F.col("_least") >= F.col("_at"), F.lit(False))
    return rows.withColumn("_live", live).groupBy(*keys, "pos").agg(F.max_by("_live", "_e").alias("in_toc"))


def preview(kind: Column, text: Column, alt: Column, first_paragraph: Column, rows: Column, cols: Column) -> Column:
    def boxed(name, inner):
        return F.when(F.coalesce(inner, F.lit("")) != "", F.concat(F.lit(f"[{name}: "), inner, F.lit("]"))).otherwise(
            f"[{name}]")

    size = F.concat(F.lit("[TABLE "), F.coalesce(rows, F.lit(0)).cast("string"), F.lit("×"),
                    F.coalesce(cols, F.lit(0)).cast("string"), F.lit("]"))
    full = (F.when(kind.isin("heading", "paragraph"), F.coalesce(text, F.lit(""))).when(kind == "image", boxed("IMAGE", alt))
            .when(kind == "shape", boxed("SHAPE", first_paragraph)).when(kind == "table", size).otherwise(""))
    return F.trim(F.substring(full, 1, 200))


def page_fields(page: Column, page_start: Column, page_end: Column) -> dict[str, Column]:
    """Page defaults to one, the start to the page, the end to the start and never before it."""
    def set_(c):
        return F.nullif(c, F.lit(0))

    p = F.coalesce(set_(page), F.lit(1))
    start = F.coalesce(set_(page_start), p)
    return {"page": p, "page_start": start, "page_end": F.greatest(F.coalesce(set_(page_end), start), start)}


def build_text_blocks(nodes: DataFrame, keys: list[str], chunk: int | None = AUTO) -> DataFrame:
    """Headings and paragraphs as comparable blocks, in the fixed order of the steps."""
    if chunk == AUTO:
        chunk = chunk_for(nodes, keys)
    n = drop_skipped_blocks(drop_skipped_sections(nodes, keys, chunk))
    n = n.filter((F.col("type") == "heading") | has_text(F.col("text")))
    n = n.withColumn("norm", norm_for_signature(F.col("text")))
    n = heading_paths(n, keys, chunk)
    none_num, none_img = F.lit(None).cast(fp.NUMBERING), F.lit(None).cast(fp.IMAGES)
    num = F.col("numbering") if "numbering" in nodes.columns else none_num
    img = F.col("images") if "images" in nodes.columns else none_img
    sig = F.when(F.col("type") == "heading", fp.heading_signature(F.col("level"), F.col("norm"), num, img, True)).otherwise(
        fp.paragraph_signature(F.col("norm"), num, img, True))
    n = n.withColumn("signature", sig)
    n = number_blocks(drop_contents_runs(n, keys, chunk=chunk), keys, chunk)
    nothing = F.lit(None).cast("string")
    return n.withColumn("key", fp.alignment_key(
        F.col("type"), F.col("signature"), F.col("level"), F.col("norm"), F.lit(None).cast("array<string>"),
        F.col("uid"), nothing, F.col("heading_ctx"), True))
