"""Longest-run-first sequence alignment of many groups at once.

Two exact ways, chosen per group by its size:

* *bounded* groups (``max_items`` elements and ``max_matches`` equal pairs at most) are gathered, one shuffle, and solved by
  an Arrow kernel in place;
* *larger* groups never meet in one task.  Substring identities of length 1, 2, 4, ... are built by joins;
  every round finds the longest common run of each open interval by extending it bit by bit with aggregations
  whose cost is linear in the positions (equal pairs are never enumerated), accepts the first longest run together with
  every equally long run that no other candidate crosses or overlaps, and splits the intervals.  Intervals that
  have become bounded leave to the kernel, so rounds do not grow with the number of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.kernels import list_opcodes
from palimpsest.operators.scan import DEFAULT_CHUNK, Run, previous, scan
from palimpsest.session import cut_lineage, spread

MAX_ITEMS = 20_000
MAX_MATCHES = 2_000_000
#: Groups with so many elements on either side are bounded, whatever they are.
FEW = 1_400


def _sizes(items: DataFrame, keys: list[str]) -> DataFrame:
    """Elements per side and number of equal pairs per group, from per-key counts (map-side combined)."""
    a = F.sum(F.when(F.col("side") == "A", 1).otherwise(0))
    b = F.sum(F.when(F.col("side") == "B", 1).otherwise(0))
    per_key = items.groupBy(*keys, "key").agg(a.alias("na"), b.alias("nb"))
    return per_key.groupBy(*keys).agg(
        F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum(F.col("na") * F.col("nb")).alias("matches"))


def _too_big(max_items: int, max_matches: int) -> Column:
    return (F.col("na") + F.col("nb") > max_items) | (F.col("matches") > max_matches)


def _big_groups(items: DataFrame, keys: list[str], max_items: int, max_matches: int) -> DataFrame | None:
    """Groups that are too big to gather, with ``na`` and ``nb``; None if there are none.

    There are no more equal pairs than pairs, so elements are counted by side first, and by key only where that could be too many.
    """
    def n(side):
        return F.count_if(F.col("side") == side)

    most = items.groupBy(*keys).agg(n("A").alias("na"), n("B").alias("nb")).withColumn("matches", F.col("na") * F.col("nb"))
    may = most.filter(_too_big(max_items, max_matches)).select(*keys)
    if may.isEmpty():
        return None
    big = _sizes(items.join(cut_lineage(may), keys, "left_semi"), keys).filter(_too_big(max_items, max_matches))
    big = cut_lineage(big.select(*keys, "na", "nb"))
    return None if big.isEmpty() else big


def _gather(items: DataFrame, keys: list[str], together: bool = False) -> DataFrame:
    """Ordered key arrays ``a`` and ``b`` of bounded groups with their first positions ``a0`` and ``b0``."""
    def ordered(side):
        mine = F.collect_list(F.when(F.col("side") == side, F.struct("idx", "key")))
        return F.transform(F.sort_array(mine), lambda x: x["key"])

    def first(side):
        return F.min(F.when(F.col("side") == side, F.col("idx")))

    return (items if together else spread(items, *keys)).groupBy(*keys).agg(ordered("A").alias("a"), ordered("B").alias("b"),
                                    F.coalesce(first("A"), F.lit(0)).alias("a0"),
                                    F.coalesce(first("B"), F.lit(0)).alias("b0"))


def _opcodes_of(a: Column, b: Column) -> Column:
    """Opcodes of two lists; identical ones need no kernel."""
    same = F.array(F.struct(F.lit("equal").alias("tag"), F.lit(0).alias("i1"), F.size(a).alias("i2"),
                            F.lit(0).alias("j1"), F.size(b).alias("j2")))
    equal = a == b
    # the kernel sees nulls for identical groups and returns at once
    return F.coalesce(list_opcodes(F.when(~equal, a), F.when(~equal, b)), same)


def _solve(gathered: DataFrame, keys: list[str]) -> DataFrame:
    """Opcodes of gathered groups."""
    return gathered.withColumn("ops", _opcodes_of(F.col("a"), F.col("b"))).select(*keys, "a0", "b0", F.explode("ops").alias("o")).select(
        *keys, "o.tag", (F.col("o.i1") + F.col("a0")).cast("int").alias("i1"),
        (F.col("o.i2") + F.col("a0")).cast("int").alias("i2"), (F.col("o.j1") + F.col("b0")).cast("int").alias("j1"),
        (F.col("o.j2") + F.col("b0")).cast("int").alias("j2"))


def opcodes(items: DataFrame, keys: list[str], max_items: int = MAX_ITEMS,
            max_matches: int = MAX_MATCHES, together: bool = False) -> DataFrame:
    """``(keys, tag, i1, i2, j1, j2)`` that turn side A into side B.

    ``items`` has ``keys``, ``side`` ('A'/'B'), dense zero-based ``idx`` and ``key`` (null keys never match).  With ``together`` the elements
    of a group lie in one task already, and bounded groups need no exchange.
    """
    items = items.select(*keys, "side", F.col("idx").cast("int").alias("idx"), "key")
    big = _big_groups(items, keys, max_items, max_matches)
    if big is None:
        return _solve(_gather(items, keys, together), keys)
    small = _solve(_gather(items.join(big.select(*keys), keys, "left_anti"), keys), keys)
    large = cut_lineage(items.join(big.select(*keys), keys, "left_semi"))
    blocks = _large_blocks(large, big, keys, max_items, max_matches)
    return small.unionByName(blocks_to_opcodes(blocks, big, keys))


def tagged(items: DataFrame, keys: list[str], carried: list[str], together: bool = False, bounded: bool = False,
           max_items: int = MAX_ITEMS, max_matches: int = MAX_MATCHES) -> DataFrame:
    """``(keys, side, carried, tag)``: every element with the tag of the opcode it lies in.

    Elements of bounded groups are gathered with what they carry, so none is joined with its opcode.  With ``together`` the elements of
    a group lie in one task already, and bounded groups need no exchange; with ``bounded`` all are known to be.
    """
    items = items.dropna(subset=keys).select(*keys, "side", F.col("idx").cast("int").alias("idx"), "key", *carried)
    big = None if bounded else _big_groups(items, keys, max_items, max_matches)
    small = items if big is None else items.join(big.select(*keys), keys, "left_anti")

    def ordered(side):
        return F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("idx", "key", *carried))))

    g = (small if together else spread(small, *keys)).groupBy(*keys).agg(ordered("A").alias("_a"), ordered("B").alias("_b"))
    g = g.withColumn("a", F.transform("_a", lambda x: x["key"])).withColumn("b", F.transform("_b", lambda x: x["key"]))
    g = g.withColumn("ops", _opcodes_of(F.col("a"), F.col("b")))

    def of(side, op):
        mine, first, last = ("_a", "i1", "i2") if side == "A" else ("_b", "j1", "j2")
        return F.transform(F.slice(mine, op[first] + 1, op[last] - op[first]), lambda x: F.struct(
            F.lit(side).alias("side"), *[x[c].alias(c) for c in carried], op["tag"].alias("tag")))

    each = F.flatten(F.transform("ops", lambda o: F.concat(of("A", o), of("B", o))))
    out = g.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*")
    if big is None:
        return out
    large = items.join(big.select(*keys), keys, "left_semi")
    span = F.explode(F.array(F.struct(F.lit("A").alias("side"), F.col("i1").alias("x"), F.col("i2").alias("y")),
                             F.struct(F.lit("B").alias("side"), F.col("j1").alias("x"), F.col("j2").alias("y"))))
    tags = opcodes(large, keys, max_items, max_matches).select(*keys, "tag", span.alias("s")).filter("s.y > s.x").select(
        *keys, "tag", "s.side", F.explode(F.sequence("s.x", F.col("s.y") - 1)).alias("idx"))
    return out.unionByName(large.join(tags, [*keys, "side", "idx"]).select(*out.columns))


def _common(rows: DataFrame, by: list[str]) -> DataFrame:
    """Classes present on both sides with their extent."""
    def side(name, fn, col="idx"):
        return fn(F.when(F.col("side") == name, F.col(col)))

    return rows.groupBy(*by).agg(
        side("A", F.min).alias("imin"), side("A", F.max).alias("imax"), side("A", F.count).alias("ca"),
        side("B", F.min).alias("jmin"), side("B", F.max).alias("jmax"), side("B", F.count).alias("cb"),
    ).filter((F.col("ca") > 0) & (F.col("cb") > 0))


def _doubling(items: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Identities of common substrings of length 2^k at every position, for all k that have any."""
    level = items.filter(F.col("key").isNotNull()).select(*keys, "side", "idx", F.md5("key").alias("r"))
    ranks, k = None, 0
    while True:
        shared = _common(level, [*keys, "r"]).select(*keys, "r")
        level = cut_lineage(level.join(shared, [*keys, "r"], "left_semi"))
        if level.isEmpty():
            break
        row = level.select(*keys, "side", "idx", F.lit(k).alias("k"), "r")
        ranks = row if ranks is None else ranks.unionByName(row)
        step = 1 << k
        ahead = level.select(*keys, "side", (F.col("idx") - step).alias("idx"), F.col("r").alias("r2"))
        level = level.join(ahead, [*keys, "side", "idx"]).select(
            *keys, "side", "idx", F.md5(F.concat("r", "r2")).alias("r"))
        k += 1
    return ranks, k


def _large_blocks(items, sizes, keys, max_items, max_matches) -> DataFrame:
    """Matching blocks ``(keys, i, j, n)`` of groups that are too big to gather."""
    spark = items.sparkSession
    ranks, levels = _doubling(items, keys)
    key_fields = [items.schema[k] for k in keys]
    empty = spark.createDataFrame([], "i int, j int, n int")
    for f in reversed(key_fields):
        empty = empty.withColumn(f.name, F.lit(None).cast(f.dataType))
    done = empty.select(*keys, "i", "j", "n")
    solved: list[DataFrame] = []
    if ranks is None:
        return done
    open_items = items
    while True:
        placed = cut_lineage(_place(open_items, done, sizes, keys))
        by = [*keys, "iv"]
        stats = _sizes(placed, by).filter((F.col("na") > 0) & (F.col("nb") > 0) & (F.col("matches") > 0))
        stats = cut_lineage(stats)
        bounded = stats.filter(~_too_big(max_items, max_matches)).select(*by)
        ops = _solve(_gather(placed.join(bounded, by, "left_semi"), by), by).filter(F.col("tag") == "equal")
        solved.append(cut_lineage(ops.select(*keys, F.col("i1").alias("i"), F.col("j1").alias("j"),
                                             (F.col("i2") - F.col("i1")).alias("n"))))
        big = stats.filter(_too_big(max_items, max_matches)).select(*by)
        if big.isEmpty():
            break
        open_items = placed.join(big, by, "left_semi")
        found = _longest_runs(open_items, ranks, levels, keys)
        done = cut_lineage(done.unionByName(found))
        open_items = cut_lineage(open_items.select(*keys, "side", "idx", "key"))
    for s in solved:
        done = done.unionByName(s)
    return done


def _place(items: DataFrame, done: DataFrame, sizes: DataFrame, keys: list[str],
           chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Give every open position its interval: the gap behind the last accepted block, up to the next one."""
    marks = done.select(*keys, F.lit("A").alias("side"), F.col("i").alias("idx"), "n",
                        F.col("i").alias("name")).unionByName(
        done.select(*keys, F.lit("B").alias("side"), F.col("j").alias("idx"), "n", F.col("i").alias("name")))
    nothing = F.lit(None)
    rows = items.select(*keys, "side", "idx", "key", nothing.cast("int").alias("n"), nothing.cast("int").alias("name"))
    both = rows.unionByName(marks.select(*keys, "side", "idx", nothing.cast("string").alias("key"), "n", "name"))
    mark = F.when(F.col("name").isNotNull(), F.struct("name", (F.col("idx") + F.col("n")).alias("end"), "idx"))
    both = scan(both, [*keys, "side"], "idx", {"_back": Run("last", mark)}, tie=["name"], chunk=chunk)
    both = scan(both, [*keys, "side"], "idx", {"_next": Run("last", mark, exclusive=True)}, tie=["name"], reverse=True, chunk=chunk)
    # a mark sits on the position it starts at: nulls sort first, so the reverse scan meets it after that position
    end = F.when(F.col("side") == "A", F.col("na")).otherwise(F.col("nb"))
    out = both.filter(F.col("name").isNull()).join(sizes, keys).select(
        *keys, "side", "idx", "key", F.coalesce("_back.name", F.lit(-1)).alias("iv"),
        F.coalesce("_back.end", F.lit(0)).alias("_from"), F.coalesce("_next.idx", end).cast("int").alias("hi"))
    covered = done.select(*keys, F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side"), "i", "j", "n").select(
        *keys, "side", F.when(F.col("side") == "A", F.col("i")).otherwise(F.col("j")).alias("idx"))
    out = out.filter(F.col("idx") >= F.col("_from"))
    return out.join(covered, [*keys, "side", "idx"], "left_anti").drop("_from")


def _longest_runs(placed: DataFrame, ranks: DataFrame, levels: int, keys: list[str],
                  chunk: int = DEFAULT_CHUNK) -> DataFrame:
    by = [*keys, "iv"]
    here = [*keys, "side", "idx"]
    spots = placed.select(*here, "iv", "hi")
    ranked = ranks.join(spots, here).filter(F.col("idx") + F.expr("shiftleft(1, k)") <= F.col("hi"))
    top = _common(ranked, [*by, "k", "r"]).groupBy(*by).agg(F.max("k").alias("top"))
    cand = cut_lineage(ranked.join(top, by).filter(F.col("k") == F.col("top")).select(
        *here, "iv", "hi", "top", "r", F.expr("shiftleft(1, k)").alias("n")))
    for k in range(levels - 2, -1, -1):
        tail = ranks.filter(F.col("k") == k).select(*keys, "side", F.col("idx").alias("_at"), F.col("r").alias("r2"))
        longer = cand.filter(F.col("top") > k).withColumn("_at", F.col("idx") + F.col("n")).filter(
            F.col("_at") + (1 << k) <= F.col("hi")).join(tail, [*keys, "side", "_at"]).withColumn(
            "r", F.md5(F.concat("r", "r2"))).drop("_at", "r2")
        keep = _common(longer, [*by, "r"]).select(*by, "r")
        longer = longer.join(keep, [*by, "r"], "left_semi").withColumn("n", F.col("n") + (1 << k))
        longer = cut_lineage(longer.select(*cand.columns))
        cand = cut_lineage(longer.unionByName(cand.join(longer.select(*by).distinct(), by, "left_anti")))
    # n is constant within an interval
    boxes = _common(cand.filter(F.col("r").isNotNull()), [*by, "r", "n"])
    n = F.col("n")
    boxes = scan(boxes, by, "imin", {
        "pi": Run("max", F.col("imax") + n, exclusive=True), "pj": Run("max", F.col("jmax") + n, exclusive=True),
        "seen": Run("count", F.lit(1), exclusive=True)}, chunk=chunk)
    boxes = scan(boxes, by, "imin", {"ni": Run("min", F.col("imin"), exclusive=True),
                                     "nj": Run("min", F.col("jmin"), exclusive=True)}, reverse=True, chunk=chunk)
    lonely = ((F.col("ca") == 1) & (F.col("cb") == 1)
              & F.coalesce(F.col("pi") <= F.col("imin"), F.lit(True))
              & F.coalesce(F.col("pj") <= F.col("jmin"), F.lit(True))
              & F.coalesce(F.col("ni") >= F.col("imin") + n, F.lit(True))
              & F.coalesce(F.col("nj") >= F.col("jmin") + n, F.lit(True)))
    return boxes.filter((F.col("seen") == 0) | lonely).select(
        *keys, F.col("imin").cast("int").alias("i"), F.col("jmin").cast("int").alias("j"), n.cast("int").alias("n"))


def blocks_to_opcodes(blocks: DataFrame, sizes: DataFrame, keys: list[str],
                      chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Opcodes from matching blocks; ``sizes`` gives ``na`` and ``nb`` per group."""
    end = sizes.select(*keys, F.col("na").cast("int").alias("i"), F.col("nb").cast("int").alias("j"),
                       F.lit(0).alias("n"), F.lit(True).alias("last"))
    b = blocks.select(*keys, "i", "j", "n", F.lit(False).alias("last")).unionByName(end)
    order = ["last", "j"]
    b = previous(b, keys, "i", "p", F.struct((F.col("i") + F.col("n")).alias("i"), (F.col("j") + F.col("n")).alias("j")),
                 tie=order, chunk=chunk)
    pi, pj = F.coalesce("p.i", F.lit(0)), F.coalesce("p.j", F.lit(0))
    b = b.withColumn("pi", pi).withColumn("pj", pj)
    fresh = (F.col("pi") != F.col("i")) | (F.col("pj") != F.col("j")) | F.col("p").isNull()
    b = scan(b, keys, "i", {"island": Run("sum", fresh.cast("long"))}, tie=order, chunk=chunk)
    gap_tag = F.when((F.col("pi") < F.col("i")) & (F.col("pj") < F.col("j")), "replace").when(
        F.col("pi") < F.col("i"), "delete").otherwise("insert")
    gaps = b.filter((F.col("pi") < F.col("i")) | (F.col("pj") < F.col("j"))).select(
        *keys, gap_tag.alias("tag"), F.col("pi").alias("i1"), F.col("i").alias("i2"), F.col("pj").alias("j1"),
        F.col("j").alias("j2"))
    runs = b.filter(F.col("n") > 0).groupBy(*keys, "island").agg(
        F.min("i").alias("i1"), F.max(F.col("i") + F.col("n")).alias("i2"), F.min("j").alias("j1"),
        F.max(F.col("j") + F.col("n")).alias("j2"))
    return gaps.unionByName(runs.select(*keys, F.lit("equal").alias("tag"), "i1", "i2", "j1", "j2"))




def positional_pairs(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Opcodes spelled out per element: ``(keys, kind, a, b, i1, j1, k)``.

    Equal elements and the elements of replace slices pair by position (kinds ``equal`` and ``pair``); what is left over
    on either side is a ``delete`` or an ``insert``.
    """
    na, nb = F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1")
    rows = ops.select(*keys, "tag", "i1", "i2", "j1", "j2", F.explode(F.sequence(F.lit(0), F.greatest(na, nb) - 1)).alias("k"))
    a = F.when(F.col("k") < na, F.col("i1") + F.col("k"))
    b = F.when(F.col("k") < nb, F.col("j1") + F.col("k"))
    kind = (F.when(F.col("tag") == "equal", "equal").when(a.isNotNull() & b.isNotNull(), "pair")
            .when(a.isNotNull(), "delete").otherwise("insert"))
    return rows.select(*keys, kind.alias("kind"), a.alias("a"), b.alias("b"), "i1", "j1", "k")
