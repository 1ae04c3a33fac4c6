"""Node trees as adjacency rows: closures, subtree texts, validation, inherited pages, assembled cell contents.

Uids are hierarchical (``n5.r0c1`` lies below ``n5``), so the ancestors of a node are the prefixes of its uid: closures
come from exploding prefixes inside the row, with no iteration and no self join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.tables import joined

# Which node types may lie in which; types not named here may hold anything.
VALID_CHILDREN = {
    "document": ["heading", "paragraph", "image", "table", "shape"],
    "table": ["row"],
    "row": ["cell"],
    "cell": ["paragraph", "image", "table", "shape"],
    "shape": ["image", "paragraph", "table"],
    "paragraph": ["image"],
    "heading": ["image"],
    "image": [],
}


def prefixes(uid: Column, own: bool = True) -> Column:
    """Uids of the ancestors from the top down, with the node itself if ``own``."""
    steps = F.split(uid, "\\.")
    n = F.size(steps)
    last = n if own else n - 1
    spots = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda k: F.array_join(F.slice(steps, F.lit(1), k), "."))


def closure(nodes: DataFrame, keys: list[str], own: bool = True) -> DataFrame:
    """Every node once per ancestor: adds ``root_uid`` and ``root_depth``."""
    return nodes.select("*", F.posexplode(prefixes(F.col("uid"), own)).alias("root_depth", "root_uid"))


def deepest_table_above(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``table_depth``: depth of the innermost table a node lies in, or -1."""
    tables = nodes.filter("type = 'table'").select(*keys, F.col("uid").alias("root_uid"))
    inside = closure(nodes.select(*keys, "uid"), keys, own=False).join(tables, [*keys, "root_uid"]).groupBy(
        *keys, "uid").agg(F.max("root_depth").alias("table_depth"))
    return nodes.join(inside, [*keys, "uid"], "left").withColumn("table_depth", F.coalesce("table_depth", F.lit(-1)))


def closure_outside_tables(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Closure that shows a nested table but not what lies in it."""
    c = closure(deepest_table_above(nodes, keys), keys)
    return c.filter(F.col("table_depth") <= F.col("root_depth"))


def subtree_text(nodes: DataFrame, keys: list[str], skip_nested_tables: bool = False) -> DataFrame:
    """Own text and texts of all descendants in order, joined by spaces."""
    c = closure_outside_tables(nodes, keys) if skip_nested_tables else closure(nodes, keys)
    if skip_nested_tables:
        c = c.filter((F.col("type") != "table") | (F.col("uid") == F.col("root_uid")))
    return c.groupBy(*keys, "root_uid").agg(
        joined("text", ["ord"], " ", F.coalesce("text", F.lit("")) != "").alias("text"))


def type_counts(nodes: DataFrame, keys: list[str], types: list[str]) -> DataFrame:
    """Descendants of each type below every node: partial sums, then one exchange."""
    return closure(nodes, keys, own=False).groupBy(*keys, "root_uid").agg(
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types])


def invalid_children(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes whose type may not lie in their parent's type, or that have no type."""
    spark: SparkSession = nodes.sparkSession
    allowed = spark.createDataFrame([(p, c) for p, cs in VALID_CHILDREN.items() for c in cs], "parent_type string, type string")
    parents = nodes.select(*keys, F.col("uid").alias("parent_uid"), F.col("type").alias("parent_type"))
    pairs = nodes.join(parents, [*keys, "parent_uid"], "left")
    blank = pairs.filter(F.coalesce("type", F.lit("")) == "")
    known = pairs.filter((F.coalesce("type", F.lit("")) != "") & F.col("parent_type").isin(list(VALID_CHILDREN)))
    wrong = known.join(allowed, ["parent_type", "type"], "left_anti")
    cols = [*keys, "uid", "type", "parent_type"]
    return blank.select(*cols).unionByName(wrong.select(*cols))


def with_children(nodes: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Nodes of one kind that have at least one child."""
    kids = nodes.select(*keys, F.col("parent_uid").alias("uid"))
    return nodes.filter(F.col("type") == kind).join(kids, [*keys, "uid"], "left_semi")


def inherit_pages(nodes: DataFrame, page_map: DataFrame, keys: list[str]) -> DataFrame:
    """Pages from a supplied map by uid, else the node's own ``page``; images and everything inside a table take the
    nearest page above them: among the prefixes of the uid, the deepest that has one.

    The map is joined as it is; the planner broadcasts it only if it is small.
    """
    known = nodes.select(*keys, "uid", "page").join(page_map, [*keys, "uid"], "left").select(
        *keys, F.col("uid").alias("root_uid"), F.coalesce("page_start", "page").alias("s"),
        F.coalesce("page_end", "page_start", "page").alias("e")).filter("s is not null")
    near = closure(nodes.select(*keys, "uid"), keys).join(known, [*keys, "root_uid"]).groupBy(*keys, "uid").agg(
        F.max_by(F.struct("s", "e", F.col("root_uid").alias("from")), "root_depth").alias("_r"))
    out = deepest_table_above(nodes, keys).join(near, [*keys, "uid"], "left")
    takes = (F.col("type") == "image") | (F.col("table_depth") >= 0) | (F.col("_r.from") == F.col("uid"))
    r = F.when(takes, F.col("_r"))
    return out.select(*nodes.columns, r["s"].alias("page_start"), F.greatest(r["e"], r["s"]).alias("page_end"))


def attach_images(paragraphs: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """Images of each paragraph as an ordered array; an image without a page takes the paragraph's."""
    p = paragraphs.select(*keys, F.col("uid").alias("parent_uid"), F.col("page").alias("_page"))
    i = images.join(p, [*keys, "parent_uid"])
    item = F.struct("ord", "uid", "sha256", F.coalesce("page", "_page").alias("page"))
    per = i.groupBy(*keys, "parent_uid").agg(F.sort_array(F.collect_list(item)).alias("images")).withColumnRenamed(
        "parent_uid", "uid")
    return paragraphs.join(per, [*keys, "uid"], "left")


def cell_content(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered content of every cell with its text.

    ``parts`` has ``pos, type, uid, text, images`` (arrays of digests).  Headings count as paragraphs; a paragraph
    without text becomes one image item per image; blank paragraphs without images vanish.
    """
    kind = F.when(F.col("type") == "heading", "paragraph").otherwise(F.col("type"))
    images = F.coalesce("images", F.array().cast("array<string>"))
    text = F.trim(F.coalesce("text", F.lit("")))
    para = kind == "paragraph"
    item = "array<struct<pos:int,n:int,type:string,uid:string,text:string,images:array<string>>>"
    none = F.lit(None)
    alone = F.transform(images, lambda s, i: F.struct(F.col("pos"), i, F.lit("image"), F.concat(F.col("uid"), F.lit(".i"), i.cast(
        "string")), none.cast("string"), F.array(s))).cast(item)
    whole = F.array(F.struct(F.col("pos"), F.lit(0), kind, F.col("uid"), text, images)).cast(item)
    items = parts.select(*keys, F.explode(F.when(para & (text == ""), alone).otherwise(whole)).alias("i"))
    agg = items.groupBy(*keys).agg(F.sort_array(F.collect_list("i")).alias("content"))
    texts = F.filter(F.transform("content", lambda x: F.when(x["type"] == "paragraph", x["text"]).otherwise("")), lambda t: t != "")
    return agg.withColumn("text", F.array_join(texts, " ")).withColumn("text_display", F.array_join(texts, "\n"))


def content_of_type(content: Column, kind: str) -> Column:
    """Items of one type, in order."""
    return F.filter(content, lambda x: x["type"] == kind)


def content_flags(content: Column) -> dict[str, Column]:
    def has(kind):
        return F.exists(content, lambda x: x["type"] == kind)

    return {"has_nested_table": has("table"), "has_images": has("image"), "has_shapes": has("shape"),
            "is_empty": F.size(content) == 0}
