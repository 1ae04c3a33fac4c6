"""Changes, sections and totals from refined opcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import norm_text
from palimpsest.operators import matching as m
from palimpsest.operators import media
from palimpsest.operators.scan import PLAIN, Run, following, previous, scan

NO_HEADING = "(No heading)"
# What a change type is shown as.
DISPLAY_TYPES = {
    "paragraph_modified": "paragraph",
    "paragraph_inserted": "paragraph",
    "paragraph_deleted": "paragraph",
    "heading_modified": "heading",
    "heading_inserted": "heading",
    "heading_deleted": "heading",
    "table_modified": "table",
    "table_inserted": "table",
    "table_deleted": "table",
    "image_modified": "image",
    "image_inserted": "image",
    "image_deleted": "image",
    "image_added": "image",
    "shape_modified": "shape",
    "shape_inserted": "shape",
    "shape_deleted": "shape",
}


def touched(ops: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block or block pair of every opcode that is not equal, with its place ``seq``.

    Replaces of one block by one stay pairs; longer ones become deletes followed by inserts.
    """
    pair = (F.col("tag") == "replace") & (F.col("i2") - F.col("i1") == 1) & (F.col("j2") - F.col("j1") == 1)
    touch = "array<struct<kind:string,a:int,b:int,seq:bigint,k:int>>"

    def side(kind, first, last, seq):
        none = F.lit(None).cast("int")
        spots = F.when(last > first, F.sequence(first, last - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda at, k: F.struct(
            F.lit(kind), at if kind == "delete" else none, none if kind == "delete" else at, seq(at, k), k)).cast(touch)

    deletes = side("delete", F.col("i1"), F.col("i2"), lambda at, k: at.cast("long") * m.SEQ_STEP)
    anchor = F.when(F.col("tag") == "insert", F.col("i1")).otherwise(F.col("i2"))
    inserts = side("insert", F.col("j1"), F.col("j2"), lambda at, k: m.seq_index(F.lit("insert"), anchor, k))
    both = F.array(F.struct(F.lit("replace"), F.col("i1"), F.col("j1"), F.col("i1").cast("long") * m.SEQ_STEP,
                            F.lit(0))).cast(touch)
    rows = ops.filter(F.col("tag") != "equal").select(*keys, "i1", "j1", F.explode(
        F.when(pair, both).when(F.col("tag") == "delete", deletes).when(F.col("tag") == "insert", inserts)
        .otherwise(F.concat(deletes, inserts))).alias("t"))
    return rows.select(*keys, "i1", "j1", "t.*")


def with_context(blocks: DataFrame, keys: list[str], chunk: int | None) -> DataFrame:
    item = F.struct("uid", "type", "ord", "heading_ctx")
    by = [*keys, "side"]
    return following(previous(blocks, by, "idx", "prev", item, chunk=chunk), by, "idx", "next", item, chunk=chunk)


def heading_meta(left: Column, right: Column, left_ctx: Column, right_ctx: Column) -> dict[str, Column]:
    """``left`` and ``right`` tell whether the side exists; both paths present and different is a changed heading."""
    lh = F.when(left, F.nullif(left_ctx, F.lit("")))
    rh = F.when(right, F.nullif(right_ctx, F.lit("")))
    changed = F.coalesce(lh != rh, F.lit(False))
    return {"heading": F.coalesce(lh, rh), "left_heading": lh, "right_heading": rh, "heading_changed": changed}


def change_kind(left: Column, right: Column) -> Column:
    return F.when(left & ~right, "delete").when(~left & right, "insert").otherwise("replace")


def changes(ops: DataFrame, blocks: DataFrame, keys: list[str], extra: list[str] | None = None,
            chunk: int | None = PLAIN) -> DataFrame:
    """Changes of all pairs, numbered; ``extra`` names block columns to carry for both sides.

    Pairs of one type are kept if they really differ (text, level or numbering, paragraphs also in their images); pairs of
    two types become a delete and an insert.  A shape with nothing in it (``has_content`` is false) is neither deleted nor inserted.
    """
    extra = extra or []
    b = with_context(blocks, keys, chunk)
    cols = ["uid", "type", "ord", "text", "level", "heading_ctx", "numbering", "images", "image_words", "has_content", "signature", "prev",
            "next", *extra]
    have = [c for c in cols if c in b.columns]
    left = b.filter("side = 'A'").select(*keys, F.col("idx").alias("a"), F.struct(*have).alias("left"))
    right = b.filter("side = 'B'").select(*keys, F.col("idx").alias("b"), F.struct(*have).alias("right"))
    t = touched(ops, keys).join(left, [*keys, "a"], "left").join(right, [*keys, "b"], "left")
    mixed = (F.col("kind") == "replace") & (F.col("left.type") != F.col("right.type"))
    none_l, none_r = F.lit(None).cast(t.schema["left"].dataType), F.lit(None).cast(t.schema["right"].dataType)
    one = F.array(F.struct(F.col("seq"), F.col("left"), F.col("right")))
    two = F.array(F.struct(F.col("seq"), F.col("left"), none_r.alias("right")),
                  F.struct((F.col("seq") - m.SEQ_STEP // 2).alias("seq"), none_l.alias("left"), F.col("right")))
    t = t.withColumn("_v", F.explode(F.when(mixed, two).otherwise(one))).withColumn("seq", F.col("_v.seq")).withColumn(
        "left", F.col("_v.left")).withColumn("right", F.col("_v.right")).drop("_v")
    has_l, has_r = F.col("left").isNotNull(), F.col("right").isNotNull()
    kind = F.coalesce(F.col("left.type"), F.col("right.type"))
    same = norm_text(F.col("left.text")) == norm_text(F.col("right.text"))
    if "numbering" in have:
        same = same & F.col("left.numbering").eqNullSafe(F.col("right.numbering"))
    same_images = F.lit(True)
    if "images" in have:
        same_images = media.image_lists_equal(F.col("left.images"), F.col("right.images"), *[
            F.col(f"{x}.image_words") if "image_words" in have else F.lit(None).cast("array<array<bigint>>") for x in ("left", "right")])
    level_l, level_r = F.coalesce("left.level", F.lit(1)), F.coalesce("right.level", F.lit(1))
    same = F.when(kind == "heading", same & (level_l == level_r)).when(kind == "paragraph", same & same_images).otherwise(F.lit(False))
    t = t.filter(~(has_l & has_r & F.coalesce(same, F.lit(False))))
    if "has_content" in have:
        filled = F.coalesce("left.has_content", "right.has_content", F.lit(True))
        t = t.filter(~((kind == "shape") & ~(has_l & has_r) & ~filled))
    change = change_kind(has_l, has_r)
    verb = F.when(change == "delete", "_deleted").when(change == "insert", "_inserted").otherwise("_modified")
    meta = heading_meta(has_l, has_r, F.col("left.heading_ctx"), F.col("right.heading_ctx"))
    t = t.select(
        *keys, "seq", "i1", "j1", "k", F.concat(kind, verb).alias("type"), kind.alias("display_type"),
        change.alias("change_kind"), *[c.alias(n) for n, c in meta.items()],
        F.least("left.ord", "right.ord").alias("ord"), "left", "right", F.when(has_l, F.col("a")).alias("a"), F.when(has_r, F.col("b")).alias("b"),
        F.when((kind == "heading") & has_l & has_r, level_l != level_r).alias("level_changed"))
    return number_changes(t, keys, chunk)


def number_changes(t: DataFrame, keys: list[str], chunk: int | None = PLAIN) -> DataFrame:
    """Add ``id``: 1..n in order of place, then of the opcode that brought the change."""
    t = t.withColumn("_at", F.col("seq") + m.SEQ_STEP)
    wide = chunk if chunk is PLAIN else chunk * m.SEQ_STEP
    t = scan(t, keys, "_at", {"id": Run("count", F.lit(1))}, tie=["i1", "j1", "k"], chunk=wide)
    return t.withColumn("id", F.col("id").cast("int")).drop("_at")


def section_key() -> Column:
    def named(c):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(NO_HEADING))

    return F.when(F.col("heading_changed"), F.concat(named("left_heading"), F.lit("__TO__"), named("right_heading"))) \
        .otherwise(named("heading"))


def with_sections(ch: DataFrame, keys: list[str], chunk: int | None = PLAIN) -> DataFrame:
    """Add ``section_key`` and ``section_no``: a run of changes with one key is one section."""
    ch = ch.withColumn("section_key", section_key())
    ch = previous(ch, keys, "id", "_p", F.struct("section_key"), chunk=chunk)
    new = F.when(F.col("_p.section_key") == F.col("section_key"), 0).otherwise(1).cast("long")
    return scan(ch, keys, "id", {"section_no": Run("sum", new)}, chunk=chunk).withColumn(
        "section_no", F.col("section_no").cast("int")).drop("_p")


def sections(ch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per section with its range of change ids."""
    return ch.groupBy(*keys, "section_no", "section_key").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).cast("int").alias("n_changes"),
        F.first("heading_changed").alias("heading_changed"))


def summary(ch: DataFrame, keys: list[str]) -> DataFrame:
    """``total_sections`` and ``total_changes`` per pair."""
    return ch.groupBy(*keys).agg(F.max("section_no").cast("long").alias("total_sections"),
                                 F.count(F.lit(1)).alias("total_changes"))


def normalize(ch: DataFrame) -> DataFrame:
    """Display type by table lookup, order defaulting to the smaller side, section heading filled in."""
    known = F.create_map(*[F.lit(x) for kv in DISPLAY_TYPES.items() for x in kv])
    return ch.withColumn("display_type", F.coalesce(F.try_element_at(known, F.col("type")), F.col("type"))).withColumn(
        "ord", F.coalesce("ord", F.least("left.ord", "right.ord"), F.lit(0))).withColumn(
        "heading", F.coalesce("heading", F.lit(NO_HEADING)))


def report_json(ch: DataFrame, keys: list[str], per_part: int = 10_000) -> DataFrame:
    """JSON reports; a pair with very many changes is written as several numbered parts of bounded size."""
    one = F.to_json(F.struct("id", "type", "change_kind", "heading", "left_heading", "right_heading", "heading_changed",
                             "section_no", F.col("left.uid").alias("left_uid"), F.col("right.uid").alias("right_uid")))
    part = F.floor((F.col("id") - 1) / per_part).cast("int")
    return ch.withColumn("part", part).groupBy(*keys, "part").agg(
        F.sort_array(F.collect_list(F.struct("id", one.alias("j")))).alias("c")).select(
        *keys, "part", F.concat(F.lit('{"changes":['), F.array_join(F.transform("c", lambda x: x["j"]), ","), F.lit("]}"))
        .alias("report"))
