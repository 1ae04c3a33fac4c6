"""Pairing inside replace slices, table pairing, and the order in which changes are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.kernels import tile_edges
from palimpsest.operators.scan import DEFAULT_CHUNK, PLAIN, PLAIN_LIMIT, Run, attach_all, scan
from palimpsest.session import cut_lineage, in_tasks, spread

# Similarity needed to pair two blocks.
THRESHOLDS = {"heading": 0.72, "shape": 0.80, "table": 0.82, "other": 0.75}
# Paragraphs need less the longer they are (longer than, threshold).
PARAGRAPH_THRESHOLDS = [(300, 0.55), (120, 0.60), (-1, 0.65)]
SAME_HEADING_BONUS = {"shape": 0.2, "text": 0.08}
TABLE_THRESHOLD = 0.45
# Weights of the table score.
TABLE_WEIGHTS = {"rows": 0.45, "tokens": 0.20, "cols": 0.15, "row_count": 0.10, "position": 0.10, "heading": 0.10}
SEQ_STEP = 100_000
TILE = 256
TABLE_TILE = 64
#: Deleted and inserted tables of a pair that meet in one task at most.
MOST_TOGETHER = 2_000
MAX_EDGES_IN_ROW = 2_000
SERVED = 128


def threshold(kind: Column, length: Column) -> Column:
    para = F.when(length > PARAGRAPH_THRESHOLDS[0][0], PARAGRAPH_THRESHOLDS[0][1]).when(
        length > PARAGRAPH_THRESHOLDS[1][0], PARAGRAPH_THRESHOLDS[1][1]).otherwise(PARAGRAPH_THRESHOLDS[2][1])
    out = F.when(kind == "paragraph", para)
    for name in ("heading", "shape", "table"):
        out = out.when(kind == name, THRESHOLDS[name])
    return out.otherwise(THRESHOLDS["other"])


# ---- overlap scores -------------------------------------------------------------------------------------------

def row_overlap(a_rows: Column, b_rows: Column) -> Column:
    """Shared distinct non-blank row texts over the larger number of them; zero if the left side has none."""
    a = F.array_distinct(F.filter(a_rows, lambda t: F.trim(t) != ""))
    b = F.array_distinct(F.filter(b_rows, lambda t: F.trim(t) != ""))
    most = F.greatest(F.size(a), F.size(b))
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def token_overlap(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def table_similarity(a: Column, b: Column, total_blocks: Column) -> Column:
    """Score of two table identities (structs with heading_ctx, cols, rows, row_texts, tokens, idx)."""
    cols = (F.when((a["cols"] == 0) & (b["cols"] == 0), 1.0).when((a["cols"] == 0) | (b["cols"] == 0), 0.0)
            .otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(a["cols"] - b["cols"]) * 0.25)))
    most = F.greatest(a["rows"], b["rows"])
    counts = F.when(most == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(a["rows"] - b["rows"]) / most))
    place = F.when(total_blocks <= 1, 1.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.abs(a["idx"] - b["idx"]) / total_blocks))
    titled = (F.coalesce(a["heading_ctx"], F.lit("")) != "") & (a["heading_ctx"] == b["heading_ctx"])
    bonus = F.when(titled, TABLE_WEIGHTS["heading"]).otherwise(0.0)
    w = TABLE_WEIGHTS
    score = (w["rows"] * row_overlap(a["row_texts"], b["row_texts"]) + w["tokens"] * token_overlap(a["tokens"], b["tokens"])
             + w["cols"] * cols + w["row_count"] * counts + w["position"] * place)
    return F.least(F.lit(1.0), score + bonus)


# ---- greedy one-to-one picks ----------------------------------------------------------------------------------

def greedy_picks(edges: DataFrame, keys: list[str], rank: list[str], max_edges: int = MAX_EDGES_IN_ROW,
                 served: list[str] | None = None) -> DataFrame:
    """Walk the edges ``(keys, ki, kj, rank...)`` in order of ``rank`` and take each whose two ends are still free.

    Groups with few edges are folded inside one row.  Larger ones go through rounds in which every edge that
    ranks first at both of its ends is taken; since the order is total, that ends in the same picks.  If ``rank`` begins
    with columns of the left end (``served``), left ends are served one after the other, and large groups take them in blocks instead.
    """
    rank = [*rank, "ki", "kj"]
    uniq = list(dict.fromkeys(rank))
    edges = cut_lineage(edges.select(*keys, *dict.fromkeys(["ki", "kj", *uniq])))
    crowded = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_edges).drop("_n")
    crowded_exists = not crowded.isEmpty()
    few = edges.join(crowded, keys, "left_anti") if crowded_exists else edges
    item = F.struct(*[F.col(c) for c in uniq])
    start = F.struct(F.array().cast("array<int>").alias("a"), F.array().cast("array<int>").alias("b"),
                     F.array().cast("array<struct<ki:int,kj:int>>").alias("out"))

    def step(acc, e):
        taken = F.array_contains(acc["a"], e["ki"]) | F.array_contains(acc["b"], e["kj"])
        return F.when(taken, acc).otherwise(F.struct(
            F.array_append(acc["a"], e["ki"]).alias("a"), F.array_append(acc["b"], e["kj"]).alias("b"),
            F.array_append(acc["out"], F.struct(e["ki"].alias("ki"), e["kj"].alias("kj"))).alias("out")))

    folded = few.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("es")).select(
        *keys, F.explode(F.aggregate("es", start, step, lambda acc: acc["out"])).alias("p")).select(*keys, "p.ki", "p.kj")
    if not crowded_exists:
        return folded
    rest = cut_lineage(edges.join(crowded, keys, "left_semi"))
    if served:
        return folded.unionByName(_served_picks(rest, keys, uniq, served, start, step))
    picks = folded
    while not rest.isEmpty():
        first_a = rest.groupBy(*keys, "ki").agg(F.min(item).alias("fa"))
        first_b = rest.groupBy(*keys, "kj").agg(F.min(item).alias("fb"))
        mutual = rest.withColumn("me", item).join(first_a, [*keys, "ki"]).join(first_b, [*keys, "kj"]).filter(
            (F.col("me") == F.col("fa")) & (F.col("me") == F.col("fb")))
        taken = cut_lineage(mutual.select(*keys, "ki", "kj"))
        picks = picks.unionByName(taken)
        rest = cut_lineage(rest.join(taken.select(*keys, "ki"), [*keys, "ki"], "left_anti")
                           .join(taken.select(*keys, "kj"), [*keys, "kj"], "left_anti"))
    return picks


def _served_picks(edges: DataFrame, keys: list[str], rank: list[str], served: list[str], start: Column, step) -> DataFrame:
    """Left ends in blocks of ``SERVED``, in their order, each taking its best right end that is still free.

    The others of its block can take at most ``SERVED - 1`` right ends before one, so its ``SERVED`` best free ones are enough.
    """
    lefts = edges.select(*keys, "ki", *[c for c in served if c != "ki"]).distinct()
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*served, "ki"))
    lefts = lefts.select(*keys, "ki", F.floor((nth - 1) / SERVED).cast("int").alias("_block"))
    edges = cut_lineage(edges.join(lefts, [*keys, "ki"]))
    item = F.struct(*[F.col(c) for c in rank])
    blocks = (edges.agg(F.max("_block")).first()[0] or 0) + 1
    taken = None
    for b in range(blocks):
        free = edges.filter(F.col("_block") == b)
        if taken is not None:
            free = free.join(taken.select(*keys, "kj"), [*keys, "kj"], "left_anti")
        best = F.row_number().over(W.partitionBy(*keys, "ki").orderBy(item))
        free = free.withColumn("_best", best).filter(F.col("_best") <= SERVED)
        mine = free.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("es")).select(
            *keys, F.explode(F.aggregate("es", start, step, lambda acc: acc["out"])).alias("p")).select(*keys, "p.ki", "p.kj")
        taken = cut_lineage(mine if taken is None else taken.unionByName(mine))
    return taken


# ---- replace slices -------------------------------------------------------------------------------------------

def slice_items(ops: DataFrame, blocks: DataFrame, keys: list[str], together: bool = False) -> DataFrame:
    """One row per block of every replace slice, with its index ``k`` inside the slice.

    ``together``: opcodes and blocks of a group lie in one task already, and stay there.
    """
    rep = ops.filter(F.col("tag") == "replace").select(*keys, "i1", "i2", "j1", "j2")
    sides = F.array(F.struct(F.lit("A").alias("side"), F.sequence("i1", F.col("i2") - 1).alias("at")),
                    F.struct(F.lit("B").alias("side"), F.sequence("j1", F.col("j2") - 1).alias("at")))
    spots = rep.select("*", F.explode(sides).alias("s")).select(
        *keys, "i1", "i2", "j1", "j2", "s.side", F.posexplode("s.at").alias("k", "idx"))
    # equal keys never share a slice: the aligner would have matched them
    here = [*keys, "side", "idx"]
    if together:
        return attach_all(spots, blocks.withColumn("_there", F.lit(True)), here).filter("_there").drop("_there")
    return spots.join(blocks, here)


def slice_edges(items: DataFrame, keys: list[str], tile: int = TILE, cut: Column | None = None) -> DataFrame:
    """Pairs of one kind whose similarity reaches the threshold.

    A slice is cut into tiles of at most ``tile`` by ``tile`` blocks, so a huge slice spreads over many tasks and
    only pairs above the threshold leave a tile.
    """
    group = [*keys, "i1", "j1"]
    length = F.length("norm")
    bonus = F.when(F.col("type") == "shape", SAME_HEADING_BONUS["shape"]).otherwise(SAME_HEADING_BONUS["text"])
    rows = F.col("row_sigs") if "row_sigs" in items.columns else F.lit(None).cast("array<string>")
    sig = F.col("signature") if "signature" in items.columns else F.lit(None).cast("string")
    item = F.struct("k", F.col("type").alias("kind"), F.col("norm").alias("text"), rows.alias("rows"), F.when(F.col("type") == "table", sig).alias("sig"),
                    F.col("heading_ctx").alias("ctx"), bonus.alias("bonus"), (threshold(F.col("type"), length) if cut is None else cut).alias("cut"))
    other = F.when(F.col("side") == "A", F.col("j2") - F.col("j1")).otherwise(F.col("i2") - F.col("i1"))
    mine = F.floor(F.col("k") / tile).cast("int")
    work = items.select(*group, "type", "side", item.alias("item"), mine.alias("mine"), F.explode(
        F.sequence(F.lit(0), F.floor((other - 1) / tile).cast("int"))).alias("theirs"))
    left = F.when(F.col("side") == "A", F.col("mine")).otherwise(F.col("theirs"))
    right = F.when(F.col("side") == "A", F.col("theirs")).otherwise(F.col("mine"))
    work = spread(work.withColumn("ta", left).withColumn("tb", right), *group, "type", "ta", "tb")
    tiles = work.groupBy(*group, "type", "ta", "tb").agg(
        F.collect_list(F.when(F.col("side") == "A", F.col("item"))).alias("a"),
        F.collect_list(F.when(F.col("side") == "B", F.col("item"))).alias("b"))
    tiles = tiles.filter((F.size("a") > 0) & (F.size("b") > 0))
    return tiles.select(*group, F.explode(tile_edges("a", "b")).alias("e")).select(*group, "e.ki", "e.kj", "e.sim")


def match_slices(items: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """One-to-one pairs ``(keys, i1, j1, ki, kj)``: best similarity first, then nearest, then first."""
    edges = slice_edges(items, keys, tile).withColumn("_s", -F.col("sim")).withColumn(
        "_d", F.abs(F.col("ki") - F.col("kj")))
    return greedy_picks(edges.drop("sim"), [*keys, "i1", "j1"], ["_s", "_d"])


def slice_opcodes(items: DataFrame, pairs: DataFrame, keys: list[str], chunk: int | None = PLAIN) -> DataFrame:
    """Opcodes of the blocks of all slices.

    Unmatched left blocks are deletes placed after the slice on the right (before it, if the slice is one to one);
    an unmatched right block is anchored at the left partner of the next pair, else behind the partner of the
    last pair, else behind the slice.
    """
    group = [*keys, "i1", "j1"]
    single = (F.col("i2") - F.col("i1") == 1) & (F.col("j2") - F.col("j1") == 1)
    a = items.filter("side = 'A'").withColumnRenamed("k", "ki").join(pairs, [*group, "ki"], "left")
    ai, bj = F.col("i1") + F.col("ki"), F.col("j1") + F.col("kj")
    gone = F.when(single, F.col("j1")).otherwise(F.col("j2"))
    from_a = a.select(
        *keys, F.when(F.col("kj").isNull(), "delete").otherwise("replace").alias("tag"), ai.alias("i1"),
        (ai + 1).alias("i2"), F.coalesce(bj, gone).alias("j1"), F.coalesce(bj + 1, gone).alias("j2"))
    b = items.filter("side = 'B'").withColumnRenamed("k", "kj").join(pairs, [*group, "kj"], "left")
    b = scan(b, group, "kj", {"_back": Run("last", F.col("ki"))}, chunk=chunk)
    b = scan(b, group, "kj", {"_next": Run("last", F.col("ki"))}, reverse=True, chunk=chunk)
    anchor = F.coalesce(F.col("i1") + F.col("_next"), F.col("i1") + F.col("_back") + 1, F.col("i2"))
    at = F.col("j1") + F.col("kj")
    from_b = b.filter(F.col("ki").isNull()).select(
        *keys, F.lit("insert").alias("tag"), anchor.alias("i1"), anchor.alias("i2"), at.alias("j1"), (at + 1).alias("j2"))
    return from_a.unionByName(from_b)


def refine(ops: DataFrame, blocks: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """Replace slices resolved into replace, delete and insert of single blocks, without tables paired one to one.

    Adds ``phase``: 0, or 2 for a one-to-one slice of two tables that is still to be scored.
    """
    items = slice_items(ops, blocks, keys)
    single = (F.col("i2") - F.col("i1") == 1) & (F.col("j2") - F.col("j1") == 1)
    both = items.filter(single & (F.col("type") == "table")).groupBy(*keys, "i1", "i2", "j1", "j2").agg(
        F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n")
    items = cut_lineage(items.join(both.select(*keys, "i1", "j1"), [*keys, "i1", "j1"], "left_anti"))
    longest = ops.filter((F.col("tag") == "replace") & (F.col("j2") - F.col("j1") > PLAIN_LIMIT))
    chunk = PLAIN if longest.isEmpty() else DEFAULT_CHUNK
    resolved = slice_opcodes(items, match_slices(items, keys, tile), keys, chunk)
    cols = [*keys, "tag", "i1", "i2", "j1", "j2"]
    out = ops.filter(F.col("tag") != "replace").select(*cols).unionByName(resolved.select(*cols))
    return out.withColumn("phase", F.lit(0)).unionByName(
        both.select(*keys, F.lit("replace").alias("tag"), "i1", "i2", "j1", "j2", F.lit(2).alias("phase")))


# ---- tables ---------------------------------------------------------------------------------------------------

def score_table_pairs(pairs: DataFrame, identities: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Replace where the score reaches the threshold, else a delete and an insert behind it.

    ``pairs`` has ``i1`` and ``j1``; ``identities`` the identity struct ``ident`` per ``side`` and ``idx``.
    """
    a = identities.filter("side = 'A'").select(*keys, F.col("idx").alias("i1"), F.col("ident").alias("ia"))
    b = identities.filter("side = 'B'").select(*keys, F.col("idx").alias("j1"), F.col("ident").alias("ib"))
    s = pairs.select(*keys, "i1", "j1").join(a, [*keys, "i1"]).join(b, [*keys, "j1"]).join(totals, keys)
    s = s.withColumn("score", table_similarity(F.col("ia"), F.col("ib"), F.col("total_blocks")))
    op = "struct<tag:string,i1:int,i2:int,j1:int,j2:int,phase:int>"

    def row(tag, i1, i2, j1, j2):
        return F.struct(F.lit(tag), i1, i2, j1, j2, F.lit(1)).cast(op)

    i, j = F.col("i1"), F.col("j1")
    ops = F.when(F.col("score") >= TABLE_THRESHOLD, F.array(row("replace", i, i + 1, j, j + 1))).otherwise(
        F.array(row("delete", i, i + 1, j, j), row("insert", i + 1, i + 1, j, j + 1)))
    return s.select(*keys, "score", F.explode(ops).alias("o")).select(*keys, "score", "o.*")


def rescue_tables(ops: DataFrame, blocks: DataFrame, identities: DataFrame, totals: DataFrame, keys: list[str],
                  tile: int = TABLE_TILE) -> DataFrame:
    """Deleted tables, in order, each take the best inserted table that is still free.

    Only the first block of a delete or insert run is looked at; its other blocks stay deleted or inserted.
    """
    here = [*keys, "side", "idx"]
    is_table = blocks.filter(F.col("type") == "table").select(*here)

    def candidates(tag, side, at):
        c = ops.filter(F.col("tag") == tag).withColumn("idx", F.col(at)).withColumn("side", F.lit(side))
        # runs that come from scored pairs are listed after the others
        late = F.when(F.col("phase") == 1, 1).otherwise(0)
        return c.join(is_table, here, "left_semi").select(*keys, "side", late.alias("late"), "idx")

    cand = candidates("delete", "A", "i1").unionByName(candidates("insert", "B", "j1"))
    per_pair = cand.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, most = per_pair.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    cand = cand.join(totals, keys)
    ident = identities.select(*here, "ident")

    def n_of(side):
        return F.count_if(F.col("side") == side)

    if most <= MOST_TOGETHER:
        # identities are large: those of a pair go to one task, once, where they are attached, counted and dealt to tiles
        tasks = [in_tasks(d, total, *keys) for d in (cand, ident)]
        cand = attach_all(*tasks, here).filter(F.col("ident").isNotNull())
        pair = W.partitionBy(*keys)
        cand = cand.withColumn("n_a", n_of("A").over(pair)).withColumn("n_b", n_of("B").over(pair)).filter("n_a > 0 and n_b > 0")
    else:
        cand = cand.join(ident, here)
        sizes = cand.groupBy(*keys).agg(n_of("A").alias("n_a"), n_of("B").alias("n_b"))
        cand = cand.join(sizes.filter("n_a > 0 and n_b > 0"), keys)

    def tiles_of(n):
        return F.ceil(n / tile).cast("int")

    own = F.when(F.col("side") == "A", F.col("n_a")).otherwise(F.col("n_b"))
    other = F.when(F.col("side") == "A", F.col("n_b")).otherwise(F.col("n_a"))
    item = F.struct("late", "idx", "ident")
    work = cand.select(*keys, "total_blocks", "side", item.alias("item"), F.pmod(F.hash("idx"), tiles_of(own)).alias("mine"), F.explode(
        F.sequence(F.lit(0), tiles_of(other) - 1)).alias("theirs"))
    ta = F.when(F.col("side") == "A", F.col("mine")).otherwise(F.col("theirs"))
    tb = F.when(F.col("side") == "A", F.col("theirs")).otherwise(F.col("mine"))
    tiles = work.withColumn("ta", ta).withColumn("tb", tb).groupBy(*keys, "total_blocks", "ta", "tb").agg(
        F.collect_list(F.when(F.col("side") == "A", F.col("item"))).alias("a"),
        F.collect_list(F.when(F.col("side") == "B", F.col("item"))).alias("b"))
    scored = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.struct(
        x["late"].alias("la"), x["idx"].alias("ki"), y["late"].alias("lb"), y["idx"].alias("kj"),
        (-table_similarity(x["ident"], y["ident"], F.col("total_blocks"))).alias("s")))))
    edges = tiles.select(*keys, F.explode(F.filter(scored, lambda e: e["s"] <= -TABLE_THRESHOLD)).alias("e")).select(
        *keys, "e.*")
    # serial choice: deletes in order, each its best insert, ties to the first
    picks = greedy_picks(edges.select(*keys, "ki", "kj", "la", F.col("ki").alias("_k"), "s", "lb"), keys,
                         ["la", "_k", "s", "lb"], served=["la", "_k"])
    picks = cut_lineage(picks)
    shift_a = picks.select(*keys, F.lit("delete").alias("tag"), F.col("ki").alias("i1"), F.lit(True).alias("_hit"))
    shift_b = picks.select(*keys, F.lit("insert").alias("tag"), F.col("kj").alias("j1"), F.lit(True).alias("_hit"))
    dels = ops.filter("tag = 'delete'").join(shift_a, [*keys, "tag", "i1"], "left").withColumn(
        "i1", F.when(F.col("_hit"), F.col("i1") + 1).otherwise(F.col("i1"))).filter("i1 < i2").drop("_hit")
    ins = ops.filter("tag = 'insert'").join(shift_b, [*keys, "tag", "j1"], "left").withColumn(
        "j1", F.when(F.col("_hit"), F.col("j1") + 1).otherwise(F.col("j1"))).filter("j1 < j2").drop("_hit")
    rest = ops.filter(~F.col("tag").isin("delete", "insert"))
    found = picks.select(*keys, F.lit("replace").alias("tag"), F.col("ki").alias("i1"), (F.col("ki") + 1).alias("i2"),
                         F.col("kj").alias("j1"), (F.col("kj") + 1).alias("j2"), F.lit(1).alias("phase"))
    return rest.unionByName(dels.select(*rest.columns)).unionByName(ins.select(*rest.columns)).unionByName(
        found.select(*rest.columns))


# ---- order ----------------------------------------------------------------------------------------------------

# Rank of a tag among opcodes at one place.
TAG_RANK = {"delete": 0, "insert": 1, "replace": 2, "equal": 3}


def tag_rank(tag: Column) -> Column:
    out = F.lit(9)
    for name, n in TAG_RANK.items():
        out = F.when(tag == name, n).otherwise(out)
    return out


def seq_index(tag: Column, i1: Column, offset: Column) -> Column:
    """Place of a change: at its left block, inserts half a step before the block they are anchored to."""
    i = i1.cast("long")
    return F.when(tag == "insert", i * SEQ_STEP - SEQ_STEP // 2 + offset).otherwise(i * SEQ_STEP + offset * SEQ_STEP)
