"""Version pairs and other inputs derived from the given tables by arithmetic and string work only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.scan import PLAIN, PLAIN_LIMIT, Run, chunk_for, number_rows, scan
from palimpsest.session import spread, tasks_for

SEED_MUL, SEED_POS, SEED_MOD = 7, 3, 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edit_class(pair, pos):
    return (pair * SEED_MUL + pos * SEED_POS) % SEED_MOD


def line_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pair_id, side, pos, line)``: each document against an edited copy.

    Both sides are built inside the row by array functions, so numbering the lines needs no shuffle.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.split("text", "\n").alias("a"))
    # one exchange of whole documents; windows, groupings and gathers by pair (and side) below need no other
    docs = spread(docs, "pair_id")

    def edited(line, i):
        h = edit_class(F.col("pair_id"), i)
        return F.when(h == 3, F.array().cast("array<string>")).when(
            h == 5, F.array(F.concat(F.lit("edited "), line))
        ).when(h == 11, F.array(line, F.concat(F.lit("inserted "), i.cast("string")))).otherwise(F.array(line))

    both = docs.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(F.lit("A").alias("side"), F.col("a").alias("ls")),
                F.struct(F.lit("B").alias("side"), F.flatten(F.transform("a", edited)).alias("ls")),
            )
        ).alias("v"),
    )
    return both.select("pair_id", "v.side", F.posexplode("v.ls").alias("pos", "line"))


def outline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side A of the outline documents: ``(pair_id, ord, type, level, text)``, one document per region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")

    def row(pair, nat, seg, rank, key, kind, level, text):
        return [pair.alias("pair_id"), F.coalesce(nat, F.lit(-1)).cast("long").alias("nat"), seg.alias("seg"),
                F.lit(rank).alias("rank"), key.cast("long").alias("key"), F.lit(kind).alias("type"),
                F.lit(level).cast("int").alias("level"), text.alias("text")]

    none = F.lit(None).cast("int")
    empty = F.lit("")
    h1 = region.select(*row(F.col("r_regionkey"), none, empty, 0, F.lit(0), "heading", 1,
                            F.concat((F.col("r_regionkey") + 1).cast("string"), F.lit(" "), "r_name")))
    h2 = nation.select(*row(F.col("n_regionkey"), F.col("n_nationkey"), empty, 1, F.lit(0), "heading", 2,
                            F.when(F.col("n_nationkey") % 7 == 6, F.lit("")).when(
                                F.col("n_nationkey") % 11 == 10,
                                F.concat(F.lit("Revision history "), F.col("n_nationkey").cast("string"))).otherwise(
                                F.concat((F.col("n_regionkey") + 1).cast("string"), F.lit("."),
                                         F.col("n_nationkey").cast("string"), F.lit(" "), "n_name"))))
    seg = cust.select("c_nationkey", "c_mktsegment").distinct()
    small = nation
    h3 = seg.join(small, F.col("c_nationkey") == F.col("n_nationkey")).select(
        *row(F.col("n_regionkey"), F.col("n_nationkey"), F.col("c_mktsegment"), 0, F.lit(-1), "heading", 3,
             F.concat(F.lit("Segment "), "c_mktsegment")))
    pc = cust.join(small, F.col("c_nationkey") == F.col("n_nationkey")).select(
        *row(F.col("n_regionkey"), F.col("n_nationkey"), F.col("c_mktsegment"), 1, F.col("c_custkey"), "paragraph",
             None, F.concat("c_name", F.lit(" ,balance "), F.floor("c_acctbal").cast("bigint").cast("string"),
                            F.lit(" ;active"))))
    ps = supp.join(small, F.col("s_nationkey") == F.col("n_nationkey")).select(
        *row(F.col("n_regionkey"), F.col("n_nationkey"), empty, 2, F.col("s_suppkey"), "paragraph", None,
             F.concat("s_name", F.lit(" owes "), F.floor("s_acctbal").cast("bigint").cast("string"))))
    nodes = h1.unionByName(h2).unionByName(h3).unionByName(pc).unionByName(ps)
    nodes = nodes.withColumn("_pos", (F.col("nat") + 1) * 1_000_000 + F.greatest(F.col("key"), F.lit(0)))
    nodes = number_rows(nodes.drop("_pos").withColumn("_nat", F.col("nat") + 1), ["pair_id"], "_nat", "ord",
                        tie=["seg", "rank", "key"])
    return nodes.select(F.col("pair_id").cast("long"), F.col("ord").cast("int"), "type", "level", "text")


def outline_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pair_id, side, ord, uid, type, level, text)`` for the outline and its edited copy."""
    a = outline_nodes(spark, sf_dir)
    h = edit_class(F.col("pair_id"), F.col("ord"))
    kept = F.struct(
        F.lit(0).alias("sub"), "type",
        F.when((F.col("type") == "heading") & (h == 8), F.col("level") + 1).otherwise(F.col("level")).alias("level"),
        F.when((h == 5) & (F.col("text") != ""), F.concat(F.lit("edited "), "text"))
        .when((h == 13) & (F.col("text") != ""), F.concat(F.lit("wholly different words "), F.col("ord").cast("string")))
        .otherwise(F.col("text")).alias("text"))
    added = F.struct(F.lit(1).alias("sub"), F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"),
                     F.concat(F.lit("inserted "), F.col("ord").cast("string")).alias("text"))
    b = a.select("pair_id", "ord", F.explode(
        F.when(h == 3, F.array().cast("array<struct<sub:int,type:string,level:int,text:string>>"))
        .when(h == 11, F.array(kept, added)).otherwise(F.array(kept))).alias("v"))
    b = number_rows(b.select("pair_id", "ord", "v.*"), ["pair_id"], "ord", "new_ord", tie=["sub"])
    cols = ["type", "level", "text"]
    both = a.select("pair_id", F.lit("A").alias("side"), "ord", *cols).unionByName(
        b.select("pair_id", F.lit("B").alias("side"), F.col("new_ord").cast("int").alias("ord"), *cols))
    return both.select("pair_id", "side", "ord", F.concat(F.lit("n"), F.lpad(F.col("ord").cast("string"), 9, "0"))
                       .alias("uid"), *cols)


def _numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_shipdate", "l_returnflag", "l_linestatus")
    li = number_rows(li, ["ok"], "l_linenumber", "rn",
                     tie=["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"])
    return li.select("ok", (F.col("rn") + 1).cast("int").alias("r"), "l_partkey", "l_suppkey",
                     F.floor("l_quantity").cast("bigint").alias("qty"),
                     F.floor("l_extendedprice").cast("bigint").alias("price"), "l_returnflag", "l_linestatus")


HEADER = ["part", "supplier", "quantity", "price", "flag"]


def order_tasks(spark: SparkSession, sf_dir: str) -> int:
    """In how many tasks the cells of ``order_cells`` lie."""
    return tasks_for(spark, table(spark, sf_dir, "orders").count() + table(spark, sf_dir, "lineitem").count())


def order_cells(spark: SparkSession, sf_dir: str, doc: Callable[[Column], Column] | None = None) -> DataFrame:
    """Table cells of both sides: every order is a table, row 0 its header, later rows its items.

    Orders and items go through one exchange by order, before they become cells; what works by table below needs no other.
    With ``doc``, which names the document of an order, they go by document, and what works by document needs no other.
    """
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ties = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    li = items.select(F.col("l_orderkey").alias("ok"), F.lit(False).alias("head"), "l_linenumber", *ties, "l_returnflag", "l_linestatus")
    heads = orders.select(F.col("o_orderkey").alias("ok"), F.lit(True).alias("head"))
    chunk = chunk_for(li, ["ok"])
    both = heads.unionByName(li, allowMissingColumns=True)
    of = [] if doc is None else ["doc"]
    both = both if doc is None else both.withColumn("doc", doc(F.col("ok")))
    both = both.repartition(order_tasks(spark, sf_dir), *(of or ["ok"]))
    # headers have no number and count for none
    both = scan(both, [*of, "ok"], "l_linenumber", {"r": Run("count", F.when(~F.col("head"), 1))}, tie=ties, chunk=chunk)
    both = both.select(*of, "ok", "head", F.col("r").cast("int").alias("r"), "l_partkey", "l_suppkey", F.floor("l_quantity").cast("bigint").alias("qty"),
                       F.floor("l_extendedprice").cast("bigint").alias("price"), "l_returnflag", "l_linestatus")
    ok, r = F.col("ok"), F.col("r")
    wide = F.when(F.col("qty") > 40, 2).otherwise(1)

    def cell(row, col, span, text):
        return F.struct(row.cast("int").alias("anchor_row"), F.lit(col).cast("int").alias("anchor_col"),
                        F.lit(1).alias("row_span"), F.lit(span).cast("int").alias("col_span") if isinstance(span, int)
                        else span.cast("int").alias("col_span"), text.alias("text"))

    def line(row, qty):
        return [cell(row, 0, 1, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))),
                cell(row, 1, 1, F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"))),
                cell(row, 2, 1, qty.cast("string")), cell(row, 3, 1, F.col("price").cast("string")),
                cell(row, 4, wide, F.concat("l_returnflag", "l_linestatus"))]

    def sides(a, b):
        return F.array(F.struct(F.lit("A").alias("side"), a.alias("cs")), F.struct(F.lit("B").alias("side"), b.alias("cs")))

    dropped = F.floor((ok + r - 3) / 9) - F.floor((ok - 2) / 9)
    b_row = r - dropped
    b_cells = line(b_row, F.when((ok + r) % 9 == 4, F.col("qty") + 1).otherwise(F.col("qty")))
    body = sides(F.array(*line(r, F.col("qty"))), F.when((ok + r) % 9 == 2, F.array().cast(
        "array<struct<anchor_row:int,anchor_col:int,row_span:int,col_span:int,text:string>>"))
        .when(ok % 7 == 0, F.array(*b_cells[:4])).otherwise(F.array(*b_cells)))
    zero = F.lit(0)
    a_head = [cell(zero, i, 1, F.lit(t)) for i, t in enumerate(HEADER)]
    b_head = list(a_head)
    b_head[3] = cell(zero, 3, 1, F.when(ok % 5 == 0, F.lit("amount")).otherwise(F.lit("price")))
    head = sides(F.array(*a_head), F.when(ok % 7 == 0, F.array(*b_head[:4])).otherwise(F.array(*b_head)))
    cells = both.select(*of, "ok", F.explode(F.when(F.col("head"), head).otherwise(body)).alias("v")).select(*of, "ok", "v.side", F.explode("v.cs").alias("c"))
    return cells.select(
        *of, F.col("ok").alias("pair_id"), "side", F.concat(F.lit("t"), F.col("ok").cast("string")).alias("table_uid"),
        "c.anchor_row", "c.anchor_col", "c.row_span", "c.col_span", "c.text")


def order_chunk(spark: SparkSession, sf_dir: str, limit: int | None = None) -> int | None:
    """``chunk_for`` of the columns or rows of order tables, from the keys of orders and items: a column has a cell of each, and a table no more rows."""
    keys = [table(spark, sf_dir, t).select(F.col(k).alias("ok")) for t, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))]
    return chunk_for(keys[0].unionByName(keys[1]), ["ok"], limit)


def order_layout(spark: SparkSession, sf_dir: str) -> int | None:
    """``order_tasks`` if every order's cells fit one task, else None."""
    return order_tasks(spark, sf_dir) if order_chunk(spark, sf_dir, PLAIN_LIMIT // 10) is PLAIN else None


def image_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, side, sha256, words ARRAY<BIGINT>(4), width_emu, height_emu)``: sign patterns as 256-bit hashes.

    Word ``w`` packs the signs of 64 dimensions starting at ``16 w`` (cyclic); side B flips a few signs.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    flips = F.when(F.col("vec_id") % 3 == 0, 1).when(F.col("vec_id") % 3 == 1, 5).otherwise(0)

    def word(w, flipped):
        total = None
        for d in range(16):
            k = w * 16 + d
            bit = F.when(F.element_at("embedding", k + 1) > 0, 1).otherwise(0)
            if flipped and w == 0:
                bit = F.when(F.lit(d) < flips, 1 - bit).otherwise(bit)
            term = bit.cast("bigint") * F.lit(1 << d).cast("bigint")
            total = term if total is None else total + term
        return total

    def side(name, flipped):
        sha = F.sha2(F.concat(F.col("label").cast("string"), F.lit(":"),
                              (F.col("vec_id") % 200 + (F.when(F.col("vec_id") % 5 == 0, 1000).otherwise(0)
                                                        if flipped else F.lit(0))).cast("string")), 256)
        return F.struct(F.lit(name).alias("side"), sha.alias("sha256"),
                        F.array(*[word(w, flipped) for w in range(4)]).alias("words"),
                        ((F.col("vec_id") % 40) * 9525 * 3 + (100 if flipped else 0)).cast("bigint").alias("width_emu"),
                        ((F.col("vec_id") % 30) * 9525 + 4762).cast("bigint").alias("height_emu"))

    return e.select("vec_id", F.explode(F.array(side("A", False), side("B", True))).alias("v")).select("vec_id", "v.*")


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update log of comparison jobs from the event stream."""
    ev = table(spark, sf_dir, "events")
    return job_log_of(ev)


def job_log_of(ev: DataFrame) -> DataFrame:
    status = (F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "processing")
              .when(F.col("event_type").isin("click", "purchase"), "done").otherwise("error"))
    return ev.select((F.col("event_id") % 5000).alias("job_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
                     .alias("username"), F.col("ts").cast("timestamp").alias("ts"), "event_id", status.alias("status"),
                     (F.col("value") > 50).alias("files_deleted"))


def customer_documents(spark: SparkSession, sf_dir: str):
    """Whole documents of both sides: a customer's orders, each with a heading, a paragraph, a table, an image and, for every
    fourth, a text box.  Returns nodes, cells, shape children and perceptual hashes.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("ok"),
                                                   "o_orderpriority", "o_orderstatus")
    o = number_rows(orders, ["pair_id"], "ok", "n")
    ok, n = F.col("ok"), F.col("n")
    h = (ok * SEED_MUL) % SEED_MOD
    b = F.col("side") == "B"
    image = "struct<uid:string,ord:int,sha256:string,name:string,width_emu:bigint,height_emu:bigint>"

    def uid(letter):
        return F.concat(F.lit(letter), F.lpad(ok.cast("string"), 12, "0"))

    def node(slot, kind, letter, level, text, img=None):
        at = (n * 8 + slot).cast("int")
        pics = F.lit(None).cast(f"array<{image}>") if img is None else F.array(
            F.struct(uid("i"), at, img, F.lit("pic"), F.lit(9525).cast("bigint"), F.lit(9525).cast("bigint")).cast(image))
        return F.struct(at.alias("ord"), F.lit(kind).alias("type"), uid(letter).alias("uid"), F.lit(level).cast("int").alias("level"),
                        text.cast("string").alias("text"), pics.alias("images"))

    sha = F.sha2((ok % 200 + F.when(b & (ok % 5 == 0), 1000).otherwise(0)).cast("string").cast("binary"), 256)
    words = F.concat_ws(" ", F.lit("Order"), ok.cast("string"), F.lit("has priority"), "o_orderpriority", F.lit(", state"), "o_orderstatus")
    para = F.when(b & (h == 5), F.concat(F.lit("edited "), words)).when(b & (h == 8), F.lit("nothing in common")).otherwise(words)
    none = F.lit(None).cast("string")
    both = o.withColumn("side", F.explode(F.array(F.lit("A"), F.lit("B"))))
    slots = F.array(
        node(0, "heading", "h", 1, F.when(b & (ok % 6 == 0), F.concat(F.lit("9."), ok.cast("string"), F.lit(" Order"))).otherwise(
            F.concat(F.lit("1."), ok.cast("string"), F.lit(" Order")))),
        F.when(~(b & (h == 3)), node(1, "paragraph", "p", None, para)),
        F.when(~(b & (h == 11)), node(2, "table", "t", None, none)),
        node(3, "paragraph", "q", None, F.lit(""), sha),
        F.when(ok % 4 == 0, node(4, "shape", "s", None, none)))
    nodes = both.select("pair_id", "side", F.explode(F.array_compact(slots)).alias("v")).select("pair_id", "side", "v.*")
    cells = order_cells(spark, sf_dir).withColumnRenamed("pair_id", "ok").drop("table_uid").join(
        orders.select("pair_id", "ok"), "ok").select("pair_id", "side", uid("t").alias("table_uid"), "anchor_row", "anchor_col",
                                                     "row_span", "col_span", "text")
    child = F.array(*[F.struct(F.lit(k).alias("ord"), F.concat(uid("s"), F.lit(f".p{k}")).alias("uid"), F.lit("paragraph").alias("type"),
                               t.alias("text"), none.alias("sha256"))
                      for k, t in enumerate([F.lit("Box"), F.when(b & (ok % 8 == 0), "other words").otherwise("same words")])])
    children = both.filter(ok % 4 == 0).select("pair_id", "side", uid("s").alias("shape_uid"), F.explode(child).alias("c")).select(
        "pair_id", "side", "shape_uid", "c.*")
    return nodes, cells, children
