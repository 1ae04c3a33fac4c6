"""Work by table pair stays where its rows are, and what is kept between steps is a table that lies as they do."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.catalog import QUERIES, load_all
from palimpsest.operators import align
from palimpsest.operators import tables as tb
from palimpsest.operators import tablediff as td
from palimpsest.session import cut_lineage, kept_by
from test_exchanges import exchanges, sf  # noqa: F401

load_all()


def test_what_is_kept_is_a_parquet_table(spark):
    df = spark.createDataFrame([(1, [(1, "x")], None), (None, None, {"a": 1})], "k long, s array<struct<a:int,b:string>>, m map<string,int>")
    kept = cut_lineage(df)
    assert "Scan parquet" in kept._jdf.queryExecution().executedPlan().toString() and kept.schema == df.schema
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    # what Parquet doesn't take is kept all the same
    assert cut_lineage(spark.range(2).select("id", F.lit(None).alias("none"))).count() == 2


def test_kept_rows_lie_by_their_keys(spark):
    a = kept_by(spark.range(50).select((F.col("id") % 7).alias("k"), F.col("id").cast("int").alias("n")), 5, "k")
    b = kept_by(spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).alias("k"), F.lit(0).alias("n")), 5, "k")
    both = a.unionByName(b).withColumn("most", F.max("n").over(W.partitionBy("k", "n")))
    assert exchanges(both) == 0 and both.count() == 59 and both.filter("k is null").count() == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cut_")]


@pytest.mark.parametrize("name, most", [("b11_row_states", 1), ("a11_b12_unchanged_share", 2), ("j4_covering_cells", 2), ("a2_deep_cell_text", 7),
                                        ("m5_merged_tables", 0), ("b5_paired_rows", 3), ("b13_render_modes", 0), ("b15_table_changes", 0)])
def test_exchanges_of_table_pairs(spark, sf, name, most):  # noqa: F811
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(QUERIES[name](spark, sf)) <= most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("most", [(align.MAX_ITEMS, align.MAX_MATCHES), (4, 3)])
def test_tags_of_elements_are_those_of_their_opcodes(spark, most):
    """Also in groups too big to gather, and with elements of one side only."""
    texts = {1: ("abcabd", "xabcd"), 2: ("", "ab"), 3: ("ab", ""), 4: ("abc", "abc"), 5: ("aaaa", "aa")}
    rows = [(k, s, i, c, i * 10) for k, (a, b) in texts.items() for s, t in (("A", a), ("B", b)) for i, c in enumerate(t)]
    items = spark.createDataFrame([*rows, (None, "A", 0, "a", 0)], "g int, side string, idx int, key string, at int")
    got = {tuple(r) for r in align.tagged(items, ["g"], ["at"], max_items=most[0], max_matches=most[1]).select("g", "side", "at", "tag").collect()}
    want = set()
    for o in align.opcodes(items.filter("g is not null"), ["g"]).collect():
        want |= {(o.g, "A", i * 10, o.tag) for i in range(o.i1, o.i2)} | {(o.g, "B", j * 10, o.tag) for j in range(o.j1, o.j2)}
    assert got == want and len(got) == len(rows)


def test_covering_cells_are_those_of_a_join(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2, 2, "a"), (1, 0, 0, 1, 1, "b"), (1, 1, 2, 1, 1, "c"), (None, 0, 0, 1, 1, "d"), (2, 0, 0, None, 1, "e"),
                                   (1, 3, 3, 1, None, "f")], "k int, anchor_row int, anchor_col int, row_span int, col_span int, v string")
    probes = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 1, 2), (1, 9, 0), (None, 0, 0), (2, 0, 0), (1, 3, 3), (1, None, 0)], "k int, row int, col int")
    got = sorted(map(str, [(r.k, r.row, r.col, r.v) for r in tb.covering_cells(probes, cells, ["k"]).collect()]))
    want = [(1, 0, 0, "a"), (1, 0, 0, "b"), (1, 1, 1, "a"), (1, 1, 2, "c"), (1, 9, 0, None), (None, 0, 0, None), (2, 0, 0, None), (1, 3, 3, None), (1, None, 0, None)]
    assert got == sorted(map(str, want))


def test_groups_are_counted_by_side_before_keys(spark, monkeypatch):
    """Equal pairs are counted only where there may be too many."""
    items = spark.createDataFrame([(1, s, i, str(i % 3)) for s in "AB" for i in range(12)] + [(2, "A", 0, "x")], "g int, side string, idx int, key string")
    counted = []
    monkeypatch.setattr(align, "_sizes", lambda d, keys, f=align._sizes: counted.append(1) or f(d, keys))
    assert align.opcodes(items, ["g"]).count() == 2 and not counted
    assert align.opcodes(items, ["g"], max_matches=10).count() == 2 and counted


def test_rows_pair_alike_wherever_they_lie(spark, sf):  # noqa: F811
    from palimpsest.plans import fixtures as fx
    rows = cut_lineage(td.anchor_rows(fx.order_cells(spark, sf), ["pair_id"]))
    near = td.row_pairs(kept_by(rows, 3, "pair_id"), ["pair_id"], tasks=3)
    assert sorted(map(str, near.collect())) == sorted(map(str, td.row_pairs(rows, ["pair_id"]).select(near.columns).collect()))
