"""Tables kept as master cells: grids, texts, signatures, identities, and joining tables cut by page breaks.

``cells`` has group ``keys`` that name one table (for example pair, side, table_uid) and ``anchor_row, anchor_col, row_span,
col_span, text``; optional ``uid``, ``content``, ``parent_cell_uid``.  Cells are first folded per row, which is
map-side combined and bounded by the width of a table; only row values meet per table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import fingerprint as fp
from palimpsest.functions.text import WORD, norm_for_match, norm_text
from palimpsest.operators.scan import AUTO, PLAIN, PLAIN_LIMIT, Run, attach, attach_all, chunk_for, previous, scan
from palimpsest.operators.structure import is_continuation
from palimpsest.session import cut_lineage, kept_by, spread

ROW_SEP = " | "


def joined(value: str, order: list[str], sep: str, keep: Column | None = None) -> Column:
    """Aggregate: values in order, joined; ``keep`` picks the rows that take part."""
    item = F.struct(*[F.col(c) for c in order], F.col(value).alias("_v"))
    if keep is not None:
        item = F.when(keep, item)
    return F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["_v"]), sep)


def per_table(cells: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """One digest per table over a per-cell value, for checks."""
    return cells.groupBy(*keys).agg(F.md5(joined(value, ["anchor_row", "anchor_col"], ",")).alias(out))


# ---- grid -----------------------------------------------------------------------------------------------------

def resolve_grid(xml_cells: DataFrame, keys: list[str], chunk: int | None = AUTO) -> DataFrame:
    """Master cells of a table given as rows of cells with ``col_span`` and ``vmerge`` (restart, continue, null).

    The column of a cell is the running sum of the spans before it in its row.  Continuing cells vanish; the row
    span of a master is one plus the directly following rows whose cell at its column continues.
    """
    c = scan(xml_cells, [*keys, "row"], "cell_no", {"anchor_col": Run("sum", F.col("col_span").cast("long"), exclusive=True)},
             chunk=chunk)
    goes_on = F.coalesce(F.col("vmerge") == "continue", F.lit(False))
    # islands per column: every cell that does not continue starts one; a missing row in between ends it
    c = previous(c, [*keys, "anchor_col"], "row", "_p", F.struct("row"), chunk=chunk)
    cut = ~goes_on | F.coalesce(F.col("_p.row") + 1 != F.col("row"), F.lit(True))
    c = scan(c.withColumn("_cut", cut), [*keys, "anchor_col"], "row", {"_isl": Run("sum", F.col("_cut").cast("long"))},
             chunk=chunk)
    head = F.min_by(F.struct("row", "cell_no", "col_span", "vmerge", "text"), "row")
    out = c.groupBy(*keys, "anchor_col", "_isl").agg(head.alias("h"), F.count(F.lit(1)).cast("int").alias("row_span"))
    # an island that begins with a continuing cell has no master
    return out.filter(~F.coalesce(F.col("h.vmerge") == "continue", F.lit(False))).select(
        *keys, F.col("h.row").alias("anchor_row"), F.col("anchor_col").cast("int"), "row_span",
        F.col("h.col_span").alias("col_span"), F.col("h.text").alias("text"))


def covering_cells(probes: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """The master cell that covers each probed ``(row, col)``: cells are spread over their rows, and looked for by column where a row and its probes meet.

    Cells stay in the tasks in which their tables lie.
    """
    rest = [c for c in cells.columns if c not in (*keys, "row", "col")]
    rows = cells.withColumn("row", F.explode(F.sequence("anchor_row", F.col("anchor_row") + F.col("row_span") - 1))).groupBy(*keys, "row").agg(
        F.collect_list(F.struct(*rest)).alias("_cells"))
    over = F.filter("_cells", lambda c: F.array_contains(F.sequence(c["anchor_col"], c["anchor_col"] + c["col_span"] - 1), F.col("col")))
    return attach(probes, rows, [*keys, "row"]).select(*probes.columns, F.explode_outer(over).alias("_cell")).select(*probes.columns, "_cell.*")


def logical_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with its visible cells: anchors, and cells that span into it from above."""
    row = F.explode(F.sequence("anchor_row", F.col("anchor_row") + F.col("row_span") - 1))
    spread = cells.withColumn("row", row).withColumn("is_anchor", F.col("anchor_row") == F.col("row"))
    return spread


def row_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    r = logical_rows(cells, keys).groupBy(*keys, "row").agg(
        F.count_if("is_anchor").alias("n_anchor"), F.count_if(~F.col("is_anchor")).alias("n_spanning"))
    return r


# ---- texts ----------------------------------------------------------------------------------------------------

def rows_of(cells: DataFrame, keys: list[str], value: Column, sep: str, out: str, drop_blank: bool = True) -> DataFrame:
    """Per anchor row: cell values joined in column order."""
    c = cells.withColumn("_t", value)
    keep = F.col("_t") != "" if drop_blank else None
    return c.groupBy(*keys, "anchor_row").agg(joined("_t", ["anchor_col"], sep, keep).alias(out))


def flatten_text(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cell texts joined by spaces per row, rows by line breaks; blank rows leave nothing."""
    r = rows_of(cells, keys, norm_text(F.col("text")), " ", "_row")
    return r.groupBy(*keys).agg(joined("_row", ["anchor_row"], "\n", F.col("_row") != "").alias("flat"))


def deep_texts(cells: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Add ``deep``: own text followed by the deep texts of the nested table's cells, from the innermost level up.

    ``uid`` names a cell and ``parent_cell_uid`` the cell a nested table lies in (null for tables of the body).  ``tasks``, if given, is the number
    of tasks into which the cells are dealt by document already; they stay there.
    """
    doc = [k for k in keys if k != "table_uid"]
    own = norm_text(F.col("text"))
    if "parent_cell_uid" not in cells.columns:
        return cells.withColumn("deep", own)
    # depth: only cells that hold a table are followed to their parents, until none is left (nesting is shallow)
    holders = cut_lineage(cells.filter("parent_cell_uid is not null").groupBy(*doc, F.col("parent_cell_uid").alias("uid")).agg(F.count(F.lit(1)).alias("_n")))
    if holders.isEmpty():
        return cells.withColumn("deep", own)
    # cells of a document lie together from here on, unless one has too many, and so does all that is attached to them: one exchange of each
    together = bool(doc) and holders.groupBy(*doc).agg(F.sum("_n").alias("_n")).filter(F.col("_n") > PLAIN_LIMIT).isEmpty()

    def near(d):
        return d if not together else spread(d, *doc) if tasks is None else d.repartition(tasks, *doc)

    holders = holders.drop("_n")
    c = near(cells) if tasks is None else cells
    nested = c.filter("parent_cell_uid is not null")
    up = attach(nested.select(*doc, "uid", "parent_cell_uid"), near(holders.withColumn("_holds", F.lit(True))), [*doc, "uid"]).filter("_holds")
    up = cut_lineage(up.select(*doc, F.col("uid").alias("_up"), F.col("parent_cell_uid").alias("_upper")).distinct())
    climb, depths = holders.select("*", F.col("uid").alias("_up"), F.lit(1).alias("_depth")), None
    while not climb.isEmpty():
        depths = climb if depths is None else depths.unionByName(climb)
        climb = cut_lineage(climb.join(up, [*doc, "_up"]).select(*doc, "uid", F.col("_upper").alias("_up"), (F.col("_depth") + 1).alias("_depth")))
    depths = cut_lineage(depths.groupBy(*doc, F.col("uid").alias("parent_cell_uid")).agg(F.max("_depth").alias("_depth")))
    placed = attach(nested.select(*doc, "uid", "parent_cell_uid", "table_uid", "anchor_row", "anchor_col", own.alias("deep")),
                    near(depths), [*doc, "parent_cell_uid"])

    def filled(d, inner):
        return attach(d, inner, [*doc, "uid"]).withColumn("deep", F.concat_ws(" ", F.nullif("deep", F.lit("")), "_in")).drop("_in")

    below = every = None
    for level in range(depths.agg(F.max("_depth")).first()[0], 0, -1):
        here = placed.filter(F.col("_depth") == level)
        here = here if below is None else filled(here, below)
        below = here.filter("deep <> ''").groupBy(*doc, F.col("parent_cell_uid").alias("uid")).agg(
            joined("deep", ["table_uid", "anchor_row", "anchor_col"], " ").alias("_in"))
        every = below if every is None else every.unionByName(below)
    return filled(c.withColumn("deep", own), every)


def table_sizes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` and ``cols``: last covered row and widest row (sum of spans)."""
    per_row = cells.groupBy(*keys, "anchor_row").agg(F.sum("col_span").alias("_w"),
                                                     F.max(F.col("anchor_row") + F.col("row_span")).alias("_h"))
    return per_row.groupBy(*keys).agg(F.max("_h").cast("int").alias("rows"), F.max("_w").cast("int").alias("cols"))


def table_summary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Text of the whole table, its sorted distinct cell texts, and its size."""
    t = norm_text(F.col("text"))
    r = cells.withColumn("_t", t).groupBy(*keys, "anchor_row").agg(
        joined("_t", ["anchor_col"], ROW_SEP, F.col("_t") != "").alias("_row"),
        F.collect_set(F.nullif("_t", F.lit(""))).alias("_set"), F.sum("col_span").alias("_w"),
        F.max(F.col("anchor_row") + F.col("row_span")).alias("_h"))
    return r.groupBy(*keys).agg(
        joined("_row", ["anchor_row"], "\n", F.col("_row") != "").alias("text"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_set")))).alias("text_set"),
        F.max("_h").cast("int").alias("rows"), F.max("_w").cast("int").alias("cols"))


def identities(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Soft features of a table: ``row_texts, tokens, rows, cols, image_hashes``."""
    content = F.col("content") if "content" in cells.columns else F.lit(None).cast(fp.CONTENT)
    images = F.transform(F.filter(F.coalesce(content, F.array().cast(fp.CONTENT)), lambda x: (x["type"] == "image")
                                  & x["sha256"].isNotNull()), lambda x: F.substring(x["sha256"], 1, 16))
    c = cells.withColumn("_t", norm_for_match(F.col("text"))).withColumn("_i", images)
    r = c.groupBy(*keys, "anchor_row").agg(
        joined("_t", ["anchor_col"], " ", F.coalesce(F.col("text"), F.lit("")) != "").alias("_row"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("anchor_col", "_i"))), lambda x: x["_i"])).alias("_i"),
        F.sum("col_span").alias("_w"), F.max(F.col("anchor_row") + F.col("row_span")).alias("_h"))
    tokens = F.regexp_extract_all("_row", F.lit(WORD), F.lit(0))
    item = F.sort_array(F.collect_list(F.struct("anchor_row", "_row", "_i")))
    return r.withColumn("_k", F.array_distinct(tokens)).groupBy(*keys).agg(
        item.alias("_r"), F.array_distinct(F.flatten(F.collect_list("_k"))).alias("tokens"),
        F.max("_h").cast("int").alias("rows"), F.max("_w").cast("int").alias("cols")).select(
        *keys, F.transform("_r", lambda x: x["_row"]).alias("row_texts"), "tokens", "rows", "cols",
        F.flatten(F.transform("_r", lambda x: x["_i"])).alias("image_hashes"))


# ---- signatures -----------------------------------------------------------------------------------------------

def cell_signatures(cells: DataFrame) -> DataFrame:
    content = F.col("content") if "content" in cells.columns else F.lit(None).cast(fp.CONTENT)
    return cells.withColumn("cell_sig", fp.cell_signature(content, F.col("text"), F.col("row_span"), F.col("col_span")))


def table_signatures(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Hash of the row hashes of the cell signatures."""
    rows = cell_signatures(cells).groupBy(*keys, "anchor_row").agg(
        F.concat(F.lit("R:"), fp.short_hash(joined("cell_sig", ["anchor_col"], "|"))).alias("_rs"))
    return rows.groupBy(*keys).agg(F.concat(F.lit("T:"), fp.short_hash(joined("_rs", ["anchor_row"], "|"))).alias("sig"))


def row_keys(cells: DataFrame, keys: list[str], prefix: int | None = None) -> DataFrame:
    """Soft key of an anchor row: column, kind, image count and a hash of the text of every cell.

    Uses ``deep`` if present, else the cell's own text.  With ``prefix``, rows that are alike so far into their cells are one.
    """
    return cells.withColumn("_p", row_key_part(cells, prefix)).groupBy(*keys, "anchor_row").agg(row_key_of("_p").alias("row_key"))


def row_key_part(cells: DataFrame, prefix: int | None = None) -> Column:
    """What a cell gives to the soft key of its row."""
    deep = F.col("deep") if "deep" in cells.columns else norm_text(F.col("text"))
    kind, n_img = F.lit("T"), F.lit("0")
    if "content" in cells.columns:
        kind = F.when(F.exists("content", lambda x: x["type"] == "table"), "N").otherwise("T")
        n_img = F.coalesce(F.size(F.filter("content", lambda x: x["type"] == "image")), F.lit(0)).cast("string")
    digest = F.replace(F.md5(deep if prefix is None else F.substring(deep, 1, prefix)), F.lit(fp.EMPTY_MD5), F.lit(""))
    return F.concat(F.col("anchor_col").cast("string"), F.lit(":"), kind, F.lit(":img"), n_img, F.lit(":txt"),
                    F.substring(digest, 1, 10))


def row_key_of(part: str, keep: Column | None = None) -> Column:
    """Aggregate: the soft key of a row from the parts of its cells."""
    item = F.col(part) if keep is None else F.when(keep, F.col(part))
    return F.array_join(F.sort_array(F.collect_list(item)), "|")


def row_hashes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Full hash of the deep texts of an anchor row; blank rows are told apart by their number."""
    deep = F.col("deep") if "deep" in cells.columns else norm_text(F.col("text"))
    return rows_of(cells, keys, deep, ROW_SEP, "_row").select(*keys, "anchor_row", row_hash_of("_row").alias("row_hash"))


def row_hash_of(text: str) -> Column:
    blank = F.concat(F.lit("__empty_row_"), F.col("anchor_row").cast("string"), F.lit("__"))
    return F.md5(F.coalesce(F.nullif(text, F.lit("")), blank))


def _readable_images(item: Column) -> Column:
    return F.transform(F.coalesce(item["images"], F.array().cast(fp.IMAGES)), lambda i: F.concat(
        F.lit("IMG:"), F.coalesce(F.substring(F.nullif(i["sha256"], F.lit("")), 1, 16), i["uid"], F.lit(""))))


def readable_item(item: Column, paragraph: int | None = None, shape_text: int | None = None) -> Column:
    """Readable key of a cell item: the text of a paragraph or shape (or so many characters of it), and image digests."""
    t = F.coalesce(item["text"], F.lit(""))
    of_paragraph = t if paragraph is None else F.substring(t, 1, paragraph)
    of_shape = t if shape_text is None else F.substring(t, 1, shape_text)
    para = F.concat(F.array(F.regexp_replace(of_paragraph, "(?s)^(.+)$", "TXT:$1")), _readable_images(item))
    para = F.array_join(F.filter(para, lambda x: x != ""), "|")
    shape = F.array_join(F.concat(F.array(F.concat(F.lit("SHP:"), F.coalesce(F.nullif(of_shape, F.lit("")),
                                                                           item["uid"]))), _readable_images(item)), "|")
    image = F.concat(F.lit("IMG:"), F.coalesce(F.substring(F.nullif(item["sha256"], F.lit("")), 1, 16), item["uid"]))
    return (F.when(item["type"] == "paragraph",
                   F.coalesce(F.nullif(para, F.lit("")), F.concat(F.lit("P_EMPTY:"), item["uid"])))
            .when(item["type"] == "shape", shape).when(item["type"] == "image", image)
            .otherwise(F.concat(F.lit("TBL:"), F.coalesce(item["table_sig"], F.lit("")))))


def readable_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Readable signature of every logical row: its anchors, or for rows of spanning cells only their spans."""
    content = F.col("content") if "content" in cells.columns else F.lit(None).cast(fp.CONTENT)
    filled = F.array_join(F.transform(content, lambda x: readable_item(x)), "|")
    blank = F.concat(F.lit("EMPTY:"), F.col("anchor_row").cast("string"), F.lit(":"), F.col("anchor_col").cast("string"),
                     F.lit(":"), fp.dimensions(F.col("row_span"), F.col("col_span")))
    own = F.coalesce(F.nullif(filled, F.lit("")), blank)
    anchor = F.concat(F.lit("SPAN:r"), F.col("anchor_row").cast("string"), F.lit("c"), F.col("anchor_col").cast("string"),
                      F.lit(":"), fp.dimensions(F.col("row_span"), F.col("col_span")))
    r = logical_rows(cells.withColumn("_own", own).withColumn("_span", anchor), keys)
    agg = r.groupBy(*keys, "row").agg(
        joined("_own", ["anchor_col"], "|", F.col("is_anchor")).alias("_a"),
        joined("_span", ["anchor_row", "anchor_col"], "|", ~F.col("is_anchor")).alias("_s"))
    return agg.select(*keys, "row", F.coalesce(F.nullif("_a", F.lit("")), F.col("_s")).alias("row_sig"))


# ---- tables cut by page breaks --------------------------------------------------------------------------------

def header_keys(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of row zero joined by bars; null if all of them are blank.  Tables without a row zero have no row here."""
    first = cells.filter("anchor_row = 0").withColumn("_t", norm_text(F.col("text")))
    h = first.groupBy(*keys).agg(joined("_t", ["anchor_col"], "|").alias("header_key"))
    return h.withColumn("header_key", F.when(F.translate("header_key", "|", "") != "", F.col("header_key")))


def merge_groups(blocks: DataFrame, headers: DataFrame, keys: list[str], chunk: int | None = AUTO) -> DataFrame:
    """Number runs of consecutive tables with one header: ``run`` and the place ``step`` inside it.

    ``blocks`` has ``keys, idx, type, table_uid``.
    """
    b = attach_all(blocks, headers, [*keys, "table_uid"])
    if chunk == AUTO:
        chunk = chunk_for(blocks, keys)
    b = previous(b, keys, "idx", "_p", F.struct("type", "header_key"), chunk=chunk)
    joins = F.coalesce((F.col("type") == "table") & (F.col("_p.type") == "table")
                       & (F.col("_p.header_key") == F.col("header_key")), F.lit(False))
    b = scan(b, keys, "idx", {"run": Run("sum", F.when(joins, 0).otherwise(1))}, chunk=chunk)
    first = F.min("idx").over(W.partitionBy(*keys, "run"))
    return b.dropna(subset=keys).withColumn("step", (F.col("idx") - first).cast("int")).drop("_p")


def drop_continuation_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Drop all cells that touch the last row if the texts there only announce a continuation."""
    table = W.partitionBy(*keys)
    end = F.col("anchor_row") + F.col("row_span") - 1
    c = cells.dropna(subset=keys).withColumn("_last", F.max(end).over(table))
    touches = end >= F.col("_last")
    there = touches & (norm_for_match(F.col("text")) != "")
    c = c.withColumn("_mark", F.min(F.when(there, is_continuation(F.col("text")))).over(table))
    return c.filter(~(touches & F.coalesce("_mark", F.lit(False)))).select(*cells.columns)


def repeated_headers(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Leading rows of ``extra`` that repeat those of ``base``; rows blank in both are passed over uncounted."""
    def numbered(c, name):
        r = c.withColumn("_t", norm_text(F.col("text"))).groupBy(*keys, "anchor_row").agg(
            joined("_t", ["anchor_col"], "|").alias(name))
        return scan(r, keys, "anchor_row", {"n": Run("count", F.lit(1))}, chunk=PLAIN).select(*keys, "n", name)

    both = attach(numbered(base, "x"), numbered(extra, "y"), [*keys, "n"]).dropna(subset=[*keys, "x", "y"])
    blank = (F.translate("x", "|", "") == "") & (F.translate("y", "|", "") == "")
    hit = ~blank & (F.col("x") == F.col("y"))
    stop = both.withColumn("_hit", hit).withColumn("_stop", F.when(~blank & ~hit, F.col("n")))
    stop = stop.groupBy(*keys).agg(F.min("_stop").alias("_end"), F.collect_list(F.when(F.col("_hit"), F.col("n"))).alias("_hits"))
    counted = F.size(F.filter("_hits", lambda n: F.col("_end").isNull() | (n < F.col("_end"))))
    return stop.select(*keys, counted.alias("repeated")).filter("repeated > 0")


def merge_runs(cells: DataFrame, groups: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Append the tables of every run to its first one.

    ``cells`` of all tables carry ``table_uid``; ``groups`` comes from ``merge_groups``.  A table that is appended loses the header rows that repeat those of
    the first one, cells beyond its grid, and, if another follows, its continuation row; last columns are stretched.  What is left of it has a height, so the
    place of each table is the sum of the heights before it: a constant number of passes, however long a run is.  Where more than the first table decides on
    the next (it is repeated whole and goes on, or a table leaves nothing), the run is built step by step.
    ``tasks``: in how many tasks cells and groups are dealt by ``keys``, if they are; no step moves them again then.
    """
    by, one = [*keys, "run"], [*keys, "run", "step"]
    run, table = W.partitionBy(*by), W.partitionBy(*one)
    tables = groups.filter("type = 'table'").select(*keys, "run", "step", "table_uid")
    tables = tables.withColumn("base_uid", F.first(F.when(F.col("step") == 0, F.col("table_uid")), ignorenulls=True).over(run))
    c = attach_all(cells, tables.dropna(subset=[*by, "base_uid"]), [*keys, "table_uid"]).filter("base_uid is not null")
    names = [*one, *[x for x in cells.columns if x not in keys]]
    # what tells on a cell, over its row, its table and its run: windows one inside the other, without another exchange
    c = c.withColumn("table_uid", F.col("base_uid")).withColumn("_width", F.sum("col_span").over(W.partitionBy(*one, "anchor_row")))
    c = c.withColumn("_nth", F.dense_rank().over(table.orderBy("anchor_row"))).withColumn(
        "_maxcol", F.max(F.when(F.col("anchor_row") > 0, F.col("anchor_col"))).over(table))
    c = c.withColumn("_end", F.max("step").over(run)).withColumn("_cols", F.max(F.when(F.col("step") == 0, F.col("_width"))).over(run).cast("int"))
    c = kept_by(c.select(*names, "_nth", "_maxcol", "_end", "_cols"), tasks, *keys)
    plain = c.select(*names)
    nxt, first = c.filter("step > 0"), c.filter("step = 0")
    base = drop_continuation_rows(first.filter("_end > 0"), by).select(*names)
    skip = kept_by(_repeated_of_first(base, nxt.select(*names), by), tasks, *keys)
    e = attach(nxt.dropna(subset=["anchor_row"]), skip.select(*one, "repeated"), one).dropna(subset=["repeated", "_cols"])
    left = F.col("_cols") - F.col("anchor_col")
    span = F.when(F.col("anchor_col") == F.col("_maxcol"), left).otherwise(F.col("col_span"))
    e = e.filter((F.col("_nth") > F.col("repeated")) & (left > 0)).withColumn("col_span", F.greatest(F.lit(1), F.least(span, left)).cast("int")).withColumn(
        "anchor_row", (F.col("anchor_row") - F.col("repeated")).cast("int")).select(*names, "_end")
    leaves = e.select(*one).distinct().withColumn("_leaves", F.lit(True))
    nothing = attach(nxt.select(*one, "_end").distinct(), leaves, one).filter("step < _end and _leaves is null")
    serial = cut_lineage(skip.filter("goes_on and step > 1").select(*by).unionByName(nothing.select(*by)).distinct())
    kept = base.unionByName(drop_continuation_rows(e.filter("step < _end"), one).unionByName(e.filter("step = _end")).select(*names))
    heights = kept.groupBy(*one).agg(F.max(F.col("anchor_row") + F.col("row_span")).alias("_height"))
    before = F.coalesce(F.sum("_height").over(W.partitionBy(*by).orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = attach(kept, heights.select(*one, before.alias("_rows")), one).dropna(subset=["_rows"]).withColumn(
        "anchor_row", (F.col("anchor_row") + F.col("_rows")).cast("int")).select(*names)
    alone = first.filter("_end = 0").select(*names)
    if serial.isEmpty():
        return out.unionByName(alone).drop("step")
    apart = _step_by_step(cut_lineage(plain.join(serial, by, "left_semi")), by)
    return out.join(serial, by, "left_anti").unionByName(alone).drop("step").unionByName(apart.select(*[x for x in names if x != "step"]))


def _repeated_of_first(base: DataFrame, extra: DataFrame, by: list[str]) -> DataFrame:
    """``by, step, repeated``: leading rows of each later table that repeat those of the first; ``goes_on`` if it has more rows and all of the first's agree."""
    one = [*by, "step"]

    def numbered(c, keys, name):
        r = c.withColumn("_t", norm_text(F.col("text"))).groupBy(*keys, "anchor_row").agg(joined("_t", ["anchor_col"], "|").alias(name))
        return scan(r, keys, "anchor_row", {"n": Run("count", F.lit(1))}, chunk=PLAIN).select(*keys, "n", name)

    x, y = numbered(base, by, "x"), numbered(extra, one, "y")
    both = attach(y, x, [*by, "n"])
    blank = (F.translate("x", "|", "") == "") & (F.translate("y", "|", "") == "")
    hit = ~blank & (F.col("x") == F.col("y"))
    both = both.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_stop", F.when(F.col("x").isNotNull() & ~blank & ~hit, F.col("n")))
    ends = both.dropna(subset=one).groupBy(*one).agg(F.min("_stop").alias("_end"), F.count_if(F.col("x").isNull()).alias("_more"),
                                                     F.collect_list(F.when(F.col("_hit"), F.col("n"))).alias("_hits"))
    counted = F.size(F.filter("_hits", lambda n: F.col("_end").isNull() | (n < F.col("_end"))))
    return ends.select(*one, counted.alias("repeated"), (F.col("_end").isNull() & (F.col("_more") > 0)).alias("goes_on"))


def _step_by_step(c: DataFrame, by: list[str]) -> DataFrame:
    """Runs whose tables depend on what has been built before them: one step per table of the longest run, all runs together."""
    longest = c.agg(F.max("step")).first()[0] or 0
    grid = table_sizes(c.filter("step = 0"), by).select(*by, F.col("cols").alias("_cols"))
    merged = c.filter("step = 0").drop("step")
    finished = []
    for step in range(1, longest + 1):
        nxt = c.filter(F.col("step") == step).drop("step")
        going = cut_lineage(nxt.select(*by).distinct())
        base = drop_continuation_rows(merged.join(going, by, "left_semi"), by)
        rows = base.groupBy(*by).agg(F.max(F.col("anchor_row") + F.col("row_span")).alias("_rows"))
        skip = repeated_headers(base, nxt, by)
        first_rows = scan(nxt.groupBy(*by, "anchor_row").agg(F.lit(1).alias("_one")), by, "anchor_row",
                          {"_nth": Run("count", F.lit(1))}, chunk=PLAIN).drop("_one")
        widest = nxt.filter("anchor_row > 0").groupBy(*by).agg(F.max("anchor_col").alias("_maxcol"))
        e = nxt.join(first_rows, [*by, "anchor_row"]).join(skip, by, "left").join(rows, by, "left").join(
            grid, by).join(widest, by, "left").withColumn("repeated", F.coalesce("repeated", F.lit(0)))
        left = F.col("_cols") - F.col("anchor_col")
        span = F.when(F.col("anchor_col") == F.col("_maxcol"), left).otherwise(F.col("col_span"))
        e = e.filter((F.col("_nth") > F.col("repeated")) & (left > 0)).withColumn(
            "col_span", F.greatest(F.lit(1), F.least(span, left)).cast("int")).withColumn(
            "anchor_row", (F.col("anchor_row") + F.coalesce("_rows", F.lit(0)) - F.col("repeated")).cast("int"))
        # runs that end here leave the loop; only the longer ones are carried on
        finished.append(merged.join(going, by, "left_anti"))
        merged = cut_lineage(base.select(*merged.columns).unionByName(e.select(*merged.columns)))
    for part in finished:
        merged = merged.unionByName(part)
    return merged


def rejoin_labels(cells: DataFrame, keys: list[str], chunk: int | None = AUTO) -> DataFrame:
    """In the first two columns, equal labels in directly following rows become one cell with the summed row span."""
    t = F.when(F.col("anchor_col") <= 1, norm_text(F.col("text")))
    if chunk == AUTO:
        chunk = chunk_for(cells, [*keys, "anchor_col"])
    c = previous(cells.withColumn("_t", t), [*keys, "anchor_col"], "anchor_row", "_p",
                 F.struct("_t", "col_span", (F.col("anchor_row") + F.col("row_span")).alias("end")), chunk=chunk)
    same = F.coalesce((F.col("anchor_col") <= 1) & (F.col("_t") != "") & (F.col("_p._t") == F.col("_t"))
                      & (F.col("_p.col_span") == F.col("col_span")) & (F.col("_p.end") == F.col("anchor_row")), F.lit(False))
    c = scan(c, [*keys, "anchor_col"], "anchor_row", {"_isl": Run("sum", F.when(same, 0).otherwise(1))}, chunk=chunk)
    rest = [x for x in cells.columns if x not in (*keys, "anchor_col", "anchor_row", "row_span")]
    return c.groupBy(*keys, "anchor_col", "_isl").agg(
        F.min("anchor_row").alias("anchor_row"), F.sum("row_span").cast("int").alias("row_span"),
        F.min_by(F.struct(*rest), "anchor_row").alias("_first")).select("*", "_first.*").select(*cells.columns)


def page_union(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Page range of merged tables: from the first start to the last end."""
    start = F.coalesce(F.nullif("page_start", F.lit(0)), F.nullif("page", F.lit(0)))
    end = F.coalesce(F.nullif("page_end", F.lit(0)), start)
    return blocks.groupBy(*keys).agg(F.min(F.coalesce(start, end)).alias("page_start"),
                                     F.max(F.greatest(start, end)).alias("page_end"))
