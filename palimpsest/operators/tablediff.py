"""Differences of table pairs: header mapping, row alignment, row and cell changes, and how to show them.

All table pairs of all documents go through every step together.  ``cells`` carries ``keys`` (one table pair) and
``side``; rows are numbered per table, so a step costs one aggregation or one equi join on the pair and a row or column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.kernels import gestalt_ratio
from palimpsest.functions.text import norm_text
from palimpsest.operators import align, matching
from palimpsest.operators import tables as tb
from palimpsest.operators.scan import AUTO, Run, attach, chunk_for, number_rows, scan
from palimpsest.session import cut_lineage, kept_by

# Limits of header detection, header pairing, row pairing and layout tests.
MAX_HEADER_ROWS = 3
HEADER_RATIO = 0.6
SHORT_HEADER_RATIO = 0.85
SHORT_HEADER = 4
MIN_MAPPED = 0.4
ROW_RATIO = 0.55
LAYOUT_SHARE = 0.8


def normalized(cells: DataFrame) -> Column:
    """The normalized text of a cell: column ``norm`` where it has been computed already."""
    return F.col("norm") if "norm" in cells.columns else norm_text(F.col("text"))


def header_rows(cells: DataFrame, keys: list[str], most: int = MAX_HEADER_ROWS) -> DataFrame:
    """Up to ``most`` leading rows before the first blank row or the first row with real numbers; at least one."""
    t = normalized(cells)
    number = t.rlike("\\d{2,}") & ~t.rlike("^\\d{1,3}$")
    r = cells.withColumn("_b", t == "").withColumn("_n", number).groupBy(*keys, "anchor_row").agg(
        (F.min("_b") | F.max("_n")).alias("_stop"))
    # a rank with a small bound is cut down before the exchange
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("anchor_row"))
    r = r.dropna(subset=keys).withColumn("_nth", nth).filter(F.col("_nth") <= most)
    # at most ``most`` rows of a table are left for the second window, which needs no other exchange
    r = r.withColumn("_end", F.min(F.when(F.col("_stop"), F.col("_nth"))).over(W.partitionBy(*keys)))
    return r.filter((F.col("_nth") < F.coalesce("_end", F.lit(MAX_HEADER_ROWS + 1))) | (F.col("_nth") == 1)).select(*keys, "anchor_row")


def header_cells(cells: DataFrame, keys: list[str], most: int = MAX_HEADER_ROWS) -> DataFrame:
    """The cells of the header rows: only those of the first ``most`` rows of a table reach its window."""
    t = normalized(cells)
    number = t.rlike("\\d{2,}") & ~t.rlike("^\\d{1,3}$")
    table, row = W.partitionBy(*keys), W.partitionBy(*keys, "anchor_row")
    c = cells.dropna(subset=keys).withColumn("_nth", F.dense_rank().over(table.orderBy("anchor_row"))).filter(F.col("_nth") <= most)
    c = c.withColumn("_stop", F.min(t == "").over(row) | F.max(number).over(row))
    c = c.withColumn("_end", F.min(F.when(F.col("_stop"), F.col("_nth"))).over(table))
    first = (F.col("_nth") < F.coalesce("_end", F.lit(MAX_HEADER_ROWS + 1))) | (F.col("_nth") == 1)
    return c.filter(first).dropna(subset=["anchor_row"]).select(*cells.columns)


def header_texts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Title of every column: distinct header texts from top to bottom; a spanning cell titles all its columns."""
    t = normalized(cells)
    h = header_cells(cells, keys).withColumn("_t", t).filter("_t <> ''")
    h = h.withColumn("col", F.explode(F.sequence("anchor_col", F.col("anchor_col") + F.col("col_span") - 1)))
    first = h.groupBy(*keys, "col", "_t").agg(F.min(F.struct("anchor_row", "anchor_col")).alias("_at"))
    return first.groupBy(*keys, "col").agg(tb.joined("_t", ["_at"], " / ").alias("title"))


def header_map(cells: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """``(keys, a_col, b_col)``: mapped columns, and columns of one side only with a null on the other.

    Headers come back for table after table, so columns are matched once per distinct pair of headers and the result is
    joined back; the planner broadcasts the distinct ones only if they are small, and splits hot ones otherwise.
    """
    titles = header_texts(cells, [*keys, "side"])

    def side(name):
        return F.sort_array(F.collect_list(F.when(F.col("side") == name, F.struct("col", "title"))))

    pairs = titles.groupBy(*keys).agg(side("A").alias("at"), side("B").alias("bt")).filter((F.size("at") > 0) & (F.size("bt") > 0))
    pairs = kept_by(pairs.withColumn("heads", F.md5(F.to_json(F.struct("at", "bt")))), tasks, *keys)
    heads = cut_lineage(pairs.groupBy("heads").agg(F.first("at").alias("at"), F.first("bt").alias("bt")))
    cand = heads.select("heads", F.explode("at").alias("x"), "bt").select("heads", "x", F.explode("bt").alias("y"))
    la, lb = F.length("x.title"), F.length("y.title")
    cut = F.when(F.least(la, lb) < SHORT_HEADER, SHORT_HEADER_RATIO).otherwise(HEADER_RATIO)
    cand = cand.withColumn("cut", cut).filter(2.0 * F.least(la, lb) / (la + lb) >= F.col("cut"))
    differ = F.col("x.title") != F.col("y.title")
    ratio = F.coalesce(gestalt_ratio(F.when(differ, F.col("x.title")), F.when(differ, F.col("y.title"))), F.lit(1.0))
    edges = cand.withColumn("_r", -ratio).filter(-F.col("_r") >= F.col("cut"))
    picks = matching.greedy_picks(edges.select("heads", F.col("x.col").cast("int").alias("ki"), F.col("y.col").cast("int").alias("kj"), "_r"),
                                  ["heads"], ["_r"])
    picks = picks.groupBy("heads").agg(F.collect_list(F.struct(F.col("ki").alias("a_col"), F.col("kj").alias("b_col"))).alias("m"))
    known = heads.join(picks, "heads", "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<a_col:int,b_col:int>>")))

    def alone(titles_, mapped, as_a):
        rest = F.array_except(F.transform(titles_, lambda t: t["col"].cast("int")), F.transform("m", lambda p: p[mapped]))
        none = F.lit(None).cast("int")
        return F.transform(rest, lambda c: F.struct((c if as_a else none).alias("a_col"), (none if as_a else c).alias("b_col")))

    known = known.select("heads", F.concat("m", alone("at", "a_col", True), alone("bt", "b_col", False)).alias("m"))
    return pairs.select(*keys, "heads").join(known, "heads").select(*keys, F.explode("m").alias("p")).select(*keys, "p.a_col", "p.b_col")


def structure_change(cells: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """``structure_changed``: too few header columns map; without headers, widths differ by more than one."""
    m = mapping.groupBy(*keys).agg(
        F.count_if(F.col("a_col").isNotNull() & F.col("b_col").isNotNull()).alias("n"),
        F.count("a_col").alias("na"), F.count("b_col").alias("nb"))
    size = tb.table_sizes(cells, [*keys, "side"]).groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "A", F.col("cols"))).alias("ca"),
        F.max(F.when(F.col("side") == "B", F.col("cols"))).alias("cb"))
    share = F.col("n") / F.greatest("na", "nb", F.lit(1))
    flag = F.when(F.col("n").isNotNull(), share < MIN_MAPPED).otherwise(F.abs(F.col("ca") - F.col("cb")) > 1)
    return size.dropna().join(m, keys, "left").select(*keys, flag.alias("structure_changed"), F.coalesce(
        F.col("n") > 0, F.lit(False)).alias("has_map"))


def anchor_rows(cells: DataFrame, keys: list[str], chunk: int | None = AUTO) -> DataFrame:
    """Numbered anchor rows with soft key, full hash and the text of all visible cells.

    All three are taken in one grouping of the visible cells: no cell goes through a join.
    """
    by = [*keys, "side"]
    if "deep" not in cells.columns:
        cells = cells.withColumn("deep", normalized(cells))
    if chunk == AUTO:
        # a table has no more rows than cells; short keys are counted, not the texts
        chunk = chunk_for(cells, by)
    # a cell without a span is part of its own row's key and hash, but not visible
    at = F.coalesce(F.sequence("anchor_row", F.col("anchor_row") + F.col("row_span") - 1), F.array("anchor_row"))
    v = cells.withColumn("_row", F.explode(at)).withColumn("_own", F.col("anchor_row") == F.col("_row")).withColumn("_part", tb.row_key_part(cells))
    shown, text = F.col("row_span").isNotNull(), F.col("deep") != ""
    r = v.dropna(subset=[*by, "_row"]).groupBy(*by, F.col("_row").alias("anchor_row")).agg(
        tb.row_key_of("_part", F.col("_own")).alias("row_key"),
        tb.joined("deep", ["anchor_col"], tb.ROW_SEP, F.col("_own") & text).alias("_hashed"),
        tb.joined("deep", ["anchor_col"], tb.ROW_SEP, shown & text).alias("norm"),
        F.count_if("_own").alias("_n_own"), F.count_if(shown).alias("_n_shown")).filter("_n_own > 0 and _n_shown > 0")
    r = r.select(*by, "anchor_row", "row_key", tb.row_hash_of("_hashed").alias("row_hash"), "norm")
    r = number_rows(r, by, "anchor_row", "idx", chunk=chunk)
    return r.withColumn("idx", F.col("idx").cast("int"))


def row_states(rows: DataFrame, keys: list[str], together: bool = False, bounded: bool = False) -> DataFrame:
    """``unchanged``, ``deleted`` or ``added`` per anchor row, by full hash.

    ``together``: rows of a table pair lie in one task already; ``bounded``: no table is known to have more than ``align.FEW`` rows.
    """
    s = align.tagged(rows.select(*keys, "side", "idx", F.col("row_hash").alias("key"), "anchor_row"), keys, ["anchor_row"], together, bounded)
    state = F.when(F.col("tag") == "equal", "unchanged").when(F.col("side") == "A", "deleted").otherwise("added")
    return s.select(*keys, "side", "anchor_row", state.alias("state"))


def unchanged_share(states: DataFrame, keys: list[str]) -> DataFrame:
    """Unchanged rows over the larger row number, and whether that makes the change one of layout only."""
    def n(side, cond=None):
        c = F.col("side") == side
        return F.count_if(c if cond is None else c & cond)

    same = F.col("state") == "unchanged"
    c = states.groupBy(*keys).agg(n("A").alias("na"), n("B").alias("nb"), n("A", same).alias("ua"), n("B", same).alias("ub"))
    share = F.least("ua", "ub") / F.greatest("na", "nb")
    return c.select(*keys, share.alias("share"), (share >= LAYOUT_SHARE).alias("layout_only"))


def row_pairs(rows: DataFrame, keys: list[str], tile: int = matching.TILE, tasks: int | None = None) -> DataFrame:
    """Rows of both sides brought together: ``(keys, kind, a_row, b_row, place)``.

    Rows with one soft key are paired by the aligner and compared later all the same, because a cell that spans
    into them may differ.  In replace slices each left row, in order, takes the best free right row.  An added row
    is shown before the first pair whose right row comes later.  ``tasks``: in how many tasks rows are dealt by table pair, if they are.
    """
    def near(d):
        return d if tasks is None else d.repartition(tasks, *keys)

    ops = kept_by(align.opcodes(rows.select(*keys, "side", "idx", F.col("row_key").alias("key")), keys, together=tasks is not None), tasks, *keys)
    eq = ops.filter("tag = 'equal'").select(*keys, "i1", "j1", F.explode(F.sequence(F.lit(0), F.col("i2") - F.col("i1") - 1))
                                            .alias("k"))
    eq = eq.select(*keys, F.lit("pair").alias("kind"), (F.col("i1") + F.col("k")).alias("a"), (F.col("j1") + F.col("k")).alias("b"),
                   (F.col("i1") + F.col("k")).alias("at"), F.lit(1).alias("late"), F.col("k").alias("sub"))
    gone = ops.filter("tag = 'delete'").select(*keys, F.explode(F.sequence("i1", F.col("i2") - 1)).alias("a"))
    gone = gone.select(*keys, F.lit("deleted").alias("kind"), "a", F.lit(None).cast("int").alias("b"), F.col("a").alias("at"),
                       F.lit(1).alias("late"), F.lit(0).alias("sub"))
    new = ops.filter("tag = 'insert'").select(*keys, "i1", F.explode(F.sequence("j1", F.col("j2") - 1)).alias("b"))
    new = new.select(*keys, F.lit("added").alias("kind"), F.lit(None).cast("int").alias("a"), "b", F.col("i1").alias("at"),
                     F.lit(0).alias("late"), F.col("b").alias("sub"))
    items = rows.select(*keys, "side", "idx", "norm", F.lit("row").alias("type"), F.lit(None).cast("string").alias("heading_ctx"))
    items = kept_by(matching.slice_items(ops, items, keys, together=tasks is not None), tasks, *keys)
    group = [*keys, "i1", "j1"]
    edges = matching.slice_edges(items, keys, tile, cut=F.lit(ROW_RATIO)).withColumn("_s", -F.col("sim")).drop("sim")
    picks = cut_lineage(matching.greedy_picks(edges.withColumn("_k", F.col("ki")), group, ["_k", "_s"], served=["_k"]))
    a = items.filter("side = 'A'").withColumnRenamed("k", "ki").join(picks, [*group, "ki"], "left")
    a = a.select(*keys, F.when(F.col("kj").isNull(), "deleted").otherwise("pair").alias("kind"), F.col("idx").alias("a"),
                 (F.col("j1") + F.col("kj")).alias("b"), F.col("idx").alias("at"), F.lit(1).alias("late"), F.lit(0).alias("sub"))
    b = items.filter("side = 'B'").withColumnRenamed("k", "kj").join(picks, [*group, "kj"], "left")
    b = scan(b, group, "kj", {"_next": Run("min", F.col("ki"), exclusive=True)}, reverse=True, chunk=chunk_for(b, group))
    b = b.filter("ki is null").select(
        *keys, F.lit("added").alias("kind"), F.lit(None).cast("int").alias("a"), F.col("idx").alias("b"),
        F.coalesce(F.col("i1") + F.col("_next"), F.col("i2")).alias("at"), F.lit(0).alias("late"), F.col("idx").alias("sub"))
    every = eq.unionByName(gone).unionByName(new).unionByName(near(a)).unionByName(near(b))
    names = rows.select(*keys, "side", "idx", "anchor_row", "norm")
    left = names.filter("side = 'A'").select(*keys, F.col("idx").alias("a"), F.col("anchor_row").alias("a_row"))
    right = names.filter("side = 'B'").select(*keys, F.col("idx").alias("b"), F.col("anchor_row").alias("b_row"))
    return attach(attach(every, left, [*keys, "a"]), right, [*keys, "b"]).select(
        *keys, "kind", "a_row", "b_row", F.struct("at", "late", "sub").alias("place"))


def visible_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    return tb.logical_rows(cells.withColumn("norm", normalized(cells)), [*keys, "side"])


def cell_pairs(pairs: DataFrame, cells: DataFrame, keys: list[str], mapping: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Cells of paired rows side by side, by column or through ``mapping`` where the pair has one (``a_col, b_col``).

    Spanning cells are visible in every row they reach.  Columns outside a mapping are not compared.  ``extra`` names columns that cells carry along.
    """
    by = [*keys, "a_row", "b_row"]
    # rows are folded before they meet; what is brought together is one row of cells, matched by column where it arrives
    cell = F.struct(F.col("anchor_col").alias("col"), F.struct("norm", "row_span", "col_span", "anchor_row", *extra).alias("c"))
    rows = visible_cells(cells, keys).groupBy(*keys, "side", "row").agg(F.collect_list(cell).alias("cs"))
    left = rows.filter("side = 'A'").select(*keys, F.col("row").alias("a_row"), F.col("cs").alias("xs"))
    right = rows.filter("side = 'B'").select(*keys, F.col("row").alias("b_row"), F.col("cs").alias("ys"))
    p = pairs.filter("kind = 'pair'").select(*by).dropna(subset=by)
    if mapping is not None:
        one, other = F.col("a_col"), F.col("b_col")
        slots = [F.collect_list(F.when(k.isNotNull(), F.struct(k.alias("col"), slot.alias("slot"))))
                 for k, slot in ((one, F.coalesce(other, F.lit(-1) - one)), (other, other))]
        p = p.join(mapping.groupBy(*keys).agg(slots[0].alias("ma"), slots[1].alias("mb"), F.lit(True).alias("_m")), keys, "left")
    p = attach(attach(p, left, [*keys, "a_row"]), right, [*keys, "b_row"])

    def placed(cs, way):
        """Cells of a row with the slot in which they are compared."""
        def at(slot, c):
            return F.struct(slot.cast("int").alias("slot"), c["col"].alias("col"), c["c"].alias("c"))

        here = F.transform(cs, lambda c: at(c["col"], c))
        if mapping is not None:
            led = F.flatten(F.transform(cs, lambda c: F.transform(F.filter(way, lambda m: m["col"] == c["col"]), lambda m: at(m["slot"], c))))
            here = F.filter(F.when(F.col("_m"), led).otherwise(here), lambda c: c["slot"].isNotNull())
        return F.coalesce(here, F.array())

    way = F.col("ma"), F.col("mb")
    p = p.withColumn("xs", placed(F.col("xs"), way[0])).withColumn("ys", placed(F.col("ys"), way[1]))
    of_cell = p.schema["xs"].dataType.elementType["c"].dataType
    none = F.lit(None).cast(of_cell)

    def alone(cs, others):
        return F.filter(cs, lambda c: ~F.coalesce(F.exists(others, lambda o: o["slot"] == c["slot"]), F.lit(False)))

    def row(col, x, y):
        return F.struct(col.alias("col"), x.alias("x"), y.alias("y"))

    both = F.flatten(F.transform("xs", lambda x: F.transform(F.filter("ys", lambda y: y["slot"] == x["slot"]), lambda y: row(y["col"], x["c"], y["c"]))))
    met = F.concat(both, F.transform(alone(F.col("xs"), F.col("ys")), lambda x: row(x["col"], x["c"], none)),
                   F.transform(alone(F.col("ys"), F.col("xs")), lambda y: row(y["col"], none, y["c"])))
    return p.select(*by, F.explode(met).alias("p")).select(*by, "p.*")


def cell_changes(cp: DataFrame) -> DataFrame:
    """``type`` of every differing cell pair; a change of span only counts if the content is the same."""
    x, y = F.col("x"), F.col("y")
    span = (x["row_span"] != y["row_span"]) | (x["col_span"] != y["col_span"])
    kind = (F.when(x.isNull(), "table_cell_added").when(y.isNull(), "table_cell_deleted")
            .when(x["norm"] != y["norm"], "table_cell_modified").when(span, "table_cell_span_changed"))
    return cp.withColumn("type", kind).filter("type is not null").withColumn(
        "left_text", F.coalesce(x["norm"], F.lit(""))).withColumn("right_text", F.coalesce(y["norm"], F.lit("")))


def row_changes(pairs: DataFrame, changed: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row records after the noise filters: modified, added and deleted rows, each named once.

    A modified row goes if all its cell changes are spans over equal texts, or if the joined texts of its changed
    cells are equal.
    """
    by = [*keys, "a_row", "b_row"]
    span_only = (F.col("type") == "table_cell_span_changed") & (F.col("left_text") == F.col("right_text"))
    per_row = changed.withColumn("_span", span_only).groupBy(*by).agg(
        F.min("_span").alias("_all"), F.count(F.lit(1)).cast("int").alias("n_cells"),
        tb.joined("left_text", ["col"], tb.ROW_SEP).alias("lt"), tb.joined("right_text", ["col"], tb.ROW_SEP).alias("rt"))
    mod = per_row.filter(~F.col("_all") & (norm_text(F.col("lt")) != norm_text(F.col("rt"))))
    text = rows.select(*keys, "side", "anchor_row", "norm")
    left = text.filter("side = 'A'").select(*keys, F.col("anchor_row").alias("a_row"), F.col("norm").alias("left_text"))
    right = text.filter("side = 'B'").select(*keys, F.col("anchor_row").alias("b_row"), F.col("norm").alias("right_text"))
    place = pairs.select(*by, "place")
    mod = attach(mod.dropna(subset=by), place, by).filter("place is not null").select(*by, F.lit("table_row_modified").alias("type"), "n_cells", "place")
    one = pairs.filter("kind <> 'pair'").select(
        *by, F.concat(F.lit("table_row_"), "kind").alias("type"), F.lit(0).alias("n_cells"), "place")
    every = attach(attach(mod.unionByName(one), left, [*keys, "a_row"]), right, [*keys, "b_row"])
    every = every.withColumn("left_text", F.coalesce("left_text", F.lit(""))).withColumn(
        "right_text", F.coalesce("right_text", F.lit(""))).withColumn("anchor_row", F.coalesce("b_row", "a_row"))
    return first_of_each(every, [*keys, "type", "anchor_row"], "place")


def first_of_each(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Keep the first row of every ``by`` in ``order``: a map-side combined aggregate instead of a window."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*by, "_r.*")


def render_modes(changes: DataFrame, structure: DataFrame, shares: DataFrame, keys: list[str]) -> DataFrame:
    """How each table pair is shown; pairs without any change have no row."""
    c = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "table_row_added").alias("added"),
                                   F.count_if(F.col("type") == "table_row_deleted").alias("deleted"))
    j = structure.join(c, keys, "left").join(shares, keys, "left")
    has = F.coalesce(F.col("n"), F.lit(0)) > 0
    mode = (F.when(has & F.col("structure_changed"), "full_table").when(has, "row_modified")
            .when(F.col("structure_changed") & F.col("layout_only"), "table_layout_changed")
            .when(F.col("structure_changed"), "full_table"))
    return j.withColumn("render_mode", mode).filter("render_mode is not null").select(
        *keys, "render_mode", "structure_changed", (~has & ~F.coalesce("layout_only", F.lit(False))).alias("content_unverifiable"),
        F.coalesce("n", F.lit(0)).cast("int").alias("n_changes"), F.coalesce("added", F.lit(0)).cast("int").alias("added_rows"),
        F.coalesce("deleted", F.lit(0)).cast("int").alias("deleted_rows"))


def one_sided_mode(has_a: Column, has_b: Column) -> Column:
    return F.when(has_a & ~has_b, "table_deleted").when(has_b & ~has_a, "table_added")


@dataclass
class Steps:
    """What the comparison of table pairs finds before it looks into cells."""

    structure: DataFrame
    rows: DataFrame
    pairs: DataFrame
    cells: DataFrame


def table_steps(cells: DataFrame, keys: list[str], extra: tuple[str, ...] = (), tasks: int | None = None) -> Steps:
    """Structure, numbered rows, row pairs and cell pairs of all table pairs; ``cells`` has ``norm``, and ``deep`` where that is another text.

    ``tasks``: in how many tasks cells are dealt by table pair, if they are; what is kept on the way is dealt as they are.
    """
    mapping = kept_by(header_map(cells, keys, tasks), tasks, *keys)
    structure = kept_by(structure_change(cells, mapping, keys), tasks, *keys)
    rows = kept_by(anchor_rows(cells, keys), tasks, *keys)
    pairs = kept_by(row_pairs(rows, keys, tasks=tasks), tasks, *keys)
    # the header map steers columns only where the structure changed
    steer = mapping.join(structure.filter("structure_changed and has_map").select(*keys), keys, "left_semi")
    return Steps(structure, rows, pairs, cell_pairs(pairs, cells, keys, steer, extra))


def shown_modes(changes: DataFrame, steps: Steps, keys: list[str], together: bool = False) -> DataFrame:
    """Render modes; row states are wanted only where nothing but the structure changed."""
    quiet = steps.structure.filter("structure_changed").join(changes.select(*keys).distinct(), keys, "left_anti").select(*keys)
    shares = unchanged_share(row_states(steps.rows.join(quiet, keys, "left_semi"), keys, together), keys)
    return render_modes(changes, steps.structure, shares, keys)


def with_texts(cells: DataFrame) -> DataFrame:
    """Texts are normalized once; every later step reads the result."""
    return cells.withColumn("norm", norm_text(F.col("text"))).withColumn("deep", F.col("deep") if "deep" in cells.columns else F.col("norm"))


def diff_tables(cells: DataFrame, keys: list[str], tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Row changes and render modes of all table pairs that have both sides, by the texts of their cells.

    With ``tasks`` cells are kept in so many files dealt by table pair, and no step moves them again; no pair may have too many for one task then.
    """
    if tasks is None or "deep" in cells.columns:
        cells = with_texts(cells)
    else:
        # nothing but what is compared
        cells = cells.select(*keys, "side", "anchor_row", "anchor_col", "row_span", "col_span", norm_text(F.col("text")).alias("norm"))
    steps = table_steps(kept_by(cells, tasks, *keys), keys, tasks=tasks)
    ch = kept_by(row_changes(steps.pairs, cell_changes(steps.cells), steps.rows, keys), tasks, *keys)
    return ch, shown_modes(ch, steps, keys, tasks is not None)


# ---- inside cells -----------------------------------------------------------------------------------------------

def paragraph_changes(paras: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraph lists of paired cells: ``(keys, type, a, b)``.

    ``paras`` has ``keys, side, idx, text``.  Paragraphs align on their normalized texts; those of a replace slice pair by
    position, and what is left over is deleted or inserted.
    """
    items = paras.select(*keys, "side", "idx", norm_text(F.col("text")).alias("key"))
    p = align.positional_pairs(align.opcodes(items, keys), keys)
    kind = (F.when(F.col("kind") == "equal", "paragraph_unchanged").when(F.col("kind") == "pair", "paragraph_modified")
            .when(F.col("kind") == "delete", "paragraph_deleted").otherwise("paragraph_inserted"))
    return p.select(*keys, kind.alias("type"), "a", "b")


def interleave(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of a cell in content order with equal ones left out: ``(keys, n, type)``.

    ``changes`` has ``type, source`` (0 paragraph, 1 image) and the content positions ``a_pos`` and ``b_pos``; inserted items
    stand at their right position, all others at their left one.
    """
    equal = F.col("type").endswith("_unchanged") | F.col("type").endswith("_equal")
    c = changes.filter(~equal).withColumn("_at", F.coalesce("a_pos", "b_pos").cast("long"))
    c = number_rows(c, keys, "_at", "n", tie=["source", "a_pos", "b_pos"])
    rest = [x for x in changes.columns if x not in (*keys, "type", "source", "a_pos", "b_pos")]
    return c.select(*keys, F.col("n").cast("int").alias("n"), "type", "a_pos", "b_pos", *rest)


def nested_case(a_nested: Column, b_nested: Column, a_flat: Column, b_flat: Column, a_text: Column, b_text: Column) -> Column:
    """What kind of change a cell with nested tables shows; null if its content is the same.

    A nested table against text is compared flattened; two nested tables are a table pair of their own, one level down.
    """
    return (F.when(a_nested & b_nested, F.when(a_flat != b_flat, "nested_table_modified"))
            .when(a_nested, F.when(a_flat != b_text, "nested_table_to_text"))
            .when(b_nested, F.when(a_text != b_flat, "text_to_nested_table"))
            .when(a_text != b_text, "text_modified"))


def serialized(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON per table: size, header cells and all cells by row and column."""
    one = F.to_json(F.struct("anchor_row", "anchor_col", "row_span", "col_span", "text"))
    rows = cells.withColumn("_j", one).dropna(subset=keys).groupBy(*keys, "anchor_row").agg(
        tb.joined("_j", ["anchor_col"], ",").alias("_row"), F.sum("col_span").alias("_w"), F.max(F.col("anchor_row") + F.col("row_span")).alias("_h"))
    j = rows.groupBy(*keys).agg(tb.joined("_row", ["anchor_row"], ",").alias("_cells"), tb.joined("_row", ["anchor_row"], ",", F.col("anchor_row") == 0)
                                .alias("_head"), F.max("_h").cast("int").alias("rows"), F.max("_w").cast("int").alias("cols"))
    return j.select(*keys, F.concat(F.lit('{"rows":'), F.col("rows").cast("string"), F.lit(',"cols":'), F.col("cols").cast("string"),
                                    F.lit(',"header":['), "_head", F.lit('],"cells":['), "_cells", F.lit("]}")).alias("json"))
