"""Images and shapes: equality, change records, lists of images, and what changed inside a shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import fingerprint as fp
from palimpsest.functions.numbers import emu_to_px
from palimpsest.functions.text import display, norm_text
from palimpsest.operators import align
from palimpsest.operators.tables import joined

# Fixed value: bits in which two 256-bit perceptual hashes may differ.
HASH_DISTANCE = 3


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes given as arrays of words; null if one is missing."""
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda acc, x: acc + x)


def images_equal(sha_a: Column, sha_b: Column, hash_a: Column, hash_b: Column, limit: int = HASH_DISTANCE) -> Column:
    """Same bytes, or nearly the same picture; without hashes different bytes are different images."""
    return F.coalesce(sha_a == sha_b, F.lit(False)) | F.coalesce(hamming(hash_a, hash_b) <= limit, F.lit(False))


def image_lists_equal(a: Column, b: Column, words_a: Column, words_b: Column) -> Column:
    """As many images on both sides, each equal to the one at its place; ``words_a`` and ``words_b`` are their hashes, or null."""
    n = F.coalesce(F.size(a), F.lit(0))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    each = F.forall(places, lambda i: images_equal(F.get(a, i)["sha256"], F.get(b, i)["sha256"], F.get(words_a, i), F.get(words_b, i)))
    return (n == F.coalesce(F.size(b), F.lit(0))) & each


def image_payload(img: Column, with_url: Column) -> Column:
    """Image fields for a report; the address only where the image has changed."""
    return F.when(img.isNotNull(), F.struct(
        img["sha256"].alias("sha256"), emu_to_px(img["width_emu"]).alias("width_px"),
        emu_to_px(img["height_emu"]).alias("height_px"),
        F.when(with_url, F.concat(F.lit("images/"), img["sha256"])).alias("image_url")))


def image_change(a: Column, b: Column, equal: Column) -> dict[str, Column]:
    kind = F.when(b.isNull(), "image_deleted").when(a.isNull(), "image_added").when(equal, "image_equal").otherwise(
        "image_modified")
    changed = kind != "image_equal"
    return {"type": kind, "left": image_payload(a, changed), "right": image_payload(b, changed)}


def list_changes(images: DataFrame, keys: list[str]) -> DataFrame:
    """Image lists of both sides, aligned by digest or uid: ``(keys, place, type, a_uid, b_uid)``.

    ``images`` has ``keys, side, idx, sha256, uid``.  Images of replace slices pair by position.
    """
    key = F.coalesce(F.nullif("sha256", F.lit("")), F.col("uid"))
    items = images.select(*keys, "side", "idx", key.alias("key"), "uid")
    p = align.positional_pairs(align.opcodes(items, keys), keys)
    left = items.filter("side = 'A'").select(*keys, F.col("idx").alias("a"), F.col("uid").alias("a_uid"))
    right = items.filter("side = 'B'").select(*keys, F.col("idx").alias("b"), F.col("uid").alias("b_uid"))
    kind = (F.when(F.col("kind") == "equal", "image_equal").when(F.col("kind") == "pair", "image_modified")
            .when(F.col("kind") == "delete", "image_deleted").otherwise("image_added"))
    return p.join(left, [*keys, "a"], "left").join(right, [*keys, "b"], "left").select(
        *keys, kind.alias("type"), "i1", "j1", "k", "a_uid", "b_uid")


# ---- shapes ---------------------------------------------------------------------------------------------------

def shape_parts(children: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered content of every shape: normalized texts, and digests of images; images without bytes say nothing."""
    t = norm_text(F.col("text"))
    img = F.concat(F.lit("img:"), F.substring(F.nullif("sha256", F.lit("")), 1, 16))
    part = F.when(F.col("type") == "image", img).otherwise(F.nullif(t, F.lit("")))
    c = children.withColumn("_p", part)
    item = F.when(F.col("_p").isNotNull(), F.struct("ord", F.col("_p").alias("p")))
    return c.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["p"]).alias("parts"))


def diffable(children: DataFrame, keys: list[str]) -> DataFrame:
    """Children that can be compared: paragraphs with text or images, and images of the shape itself, numbered."""
    from palimpsest.operators.structure import number_blocks
    c = children.withColumn("norm", norm_text(F.col("text")))
    images = F.coalesce(F.size("image_keys"), F.lit(0)) > 0 if "image_keys" in c.columns else F.lit(False)
    c = c.filter((F.col("type") == "image") | ((F.col("type") == "paragraph") & ((F.col("norm") != "") | images)))
    c = c.withColumn("key", fp.shape_child_key(F.col("type"), F.col("sha256"), F.col("uid"), F.col("norm")))
    return number_blocks(c, keys)


def shape_changes(items: DataFrame, keys: list[str], hashes: DataFrame | None = None) -> DataFrame:
    """Changes inside paired shapes, from ``diffable`` children of both sides; images are the same if ``hashes`` (sha256, words) say so.

    Aligned paragraphs are still compared on their own images.  Children of a replace slice pair by position; an
    image against a paragraph is a delete and an insert.  Shapes without any change have no rows.
    """
    p = align.positional_pairs(align.opcodes(items, keys), keys)
    cols = ["type", "uid", "norm", "sha256"] + (["image_keys"] if "image_keys" in items.columns else [])
    if hashes is not None:
        items = items.join(hashes.select("sha256", "words").dropDuplicates(["sha256"]), "sha256", "left")
        cols = [*cols, "words"]
    left = items.filter("side = 'A'").select(*keys, F.col("idx").alias("a"), F.struct(*cols).alias("x"))
    right = items.filter("side = 'B'").select(*keys, F.col("idx").alias("b"), F.struct(*cols).alias("y"))
    j = p.join(left, [*keys, "a"], "left").join(right, [*keys, "b"], "left")
    x, y = F.col("x"), F.col("y")
    alike = F.coalesce(hamming(x["words"], y["words"]) <= HASH_DISTANCE, F.lit(False)) if hashes is not None else F.lit(False)
    own_images = ~x["image_keys"].eqNullSafe(y["image_keys"]) if "image_keys" in items.columns else F.lit(False)

    def named(side, verb_image, verb_para):
        return F.when(side["type"] == "image", f"image_{verb_image}").otherwise(f"paragraph_{verb_para}")

    same = F.when(x["type"] == "image", x["sha256"].eqNullSafe(y["sha256"]) | alike).otherwise(
        (x["norm"] == y["norm"]) & ~own_images)
    paired = F.when(same, F.concat(x["type"], F.lit("_equal"))).otherwise(F.concat(x["type"], F.lit("_modified")))
    kinds = (F.when(F.col("kind") == "delete", F.array(named(x, "deleted", "deleted")))
             .when(F.col("kind") == "insert", F.array(named(y, "added", "inserted")))
             .when(x["type"] == y["type"], F.array(paired))
             .otherwise(F.array(named(x, "deleted", "deleted"), named(y, "added", "inserted"))))
    rows = j.select(*keys, "i1", "j1", "k", F.posexplode(kinds).alias("n", "type"), x["uid"].alias("a_uid"), y["uid"].alias("b_uid"))
    changed = rows.filter(~F.col("type").endswith("_equal")).select(*keys).distinct()
    return rows.join(changed, keys, "left_semi")


def shape_report(children: DataFrame, keys: list[str]) -> DataFrame:
    """Text lines, preview, counts and whether a shape has content, per side.

    An image is a line of its own; a shape without lines is previewed by its numbers of images and tables.
    """
    line = F.when(F.col("type") == "image", "[Image]").otherwise(display(F.col("text"), F.col("text")))
    c = children.withColumn("_l", line)
    agg = c.groupBy(*keys).agg(
        joined("_l", ["ord"], "\n", F.coalesce("_l", F.lit("")) != "").alias("lines"),
        F.count_if(F.col("type") == "image").cast("int").alias("n_images"),
        F.count_if(F.col("type") == "table").cast("int").alias("n_tables"))
    parts = F.concat_ws(" , ", F.when(F.col("n_images") > 0, F.concat(F.lit("Image × "), F.col("n_images").cast("string"))),
                        F.when(F.col("n_tables") > 0, F.concat(F.lit("Table × "), F.col("n_tables").cast("string"))))
    empty = F.when(parts != "", F.concat(F.lit("["), parts, F.lit("]"))).otherwise("[Empty shape]")
    return agg.withColumn("preview", F.coalesce(F.nullif("lines", F.lit("")), empty)).withColumn(
        "has_content", (F.col("lines") != "") | (F.col("n_images") > 0))


def cleared(left_has: Column, right_has: Column) -> Column:
    return F.coalesce(left_has, F.lit(False)) & ~F.coalesce(right_has, F.lit(False))
