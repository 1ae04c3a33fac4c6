"""Work by table stays where its rows are: cells of a table go through one exchange, and none of them is kept on disk between steps."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.catalog import QUERIES, load_all
from palimpsest.operators import tables as tb
from palimpsest.operators import tablediff as td
from palimpsest.operators.scan import attach, attach_all

load_all()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("orders"))
    day = dt.datetime(1995, 1, 1)
    spark.createDataFrame([(k, k % 5) for k in range(1, 40)], "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(k, k * 7 % 50, k % 9, n, float(n * k % 50), float(100 + k), "A", "F", day) for k in range(1, 40) for n in range(1, 2 + k % 6)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    return d


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning")


@pytest.mark.parametrize("name, most", [("a3_flattened_tables", 1), ("a4_table_summary", 1), ("a5_table_identity", 1), ("b1_header_rows", 1),
                                        ("b10_row_records", 1), ("b14_serialized_tables", 1), ("g13_readable_signatures", 1),
                                        ("m3_continuation_rows", 1), ("m6_rejoined_labels", 1), ("j5_b6_cell_changes", 3), ("f12_table_noise", 6)])
def test_exchanges_of_cells(spark, sf, name, most):
    assert exchanges(QUERIES[name](spark, sf)) <= most


def test_nothing_is_kept_between_steps(spark, sf):
    folder = spark.sparkContext.getCheckpointDir()

    def files():
        return 0 if folder is None else sum(len(f) for _, _, f in os.walk(folder.removeprefix("file:")))

    before = files()
    for name in ("j5_b6_cell_changes", "f12_table_noise", "b10_row_records"):
        QUERIES[name](spark, sf).collect()
        folder = folder or spark.sparkContext.getCheckpointDir()
    assert files() == before


def test_attach_is_a_left_join(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (1, None, "z"), (2, 1, "w")], "k int, n int, v string")
    b = spark.createDataFrame([(1, 1, "one"), (1, None, "never"), (3, 1, "other")], "k int, n int, t string")
    got = {tuple(r) for r in attach(a, b, ["k", "n"]).collect()}
    assert got == {(1, 1, "x", "one"), (1, 1, "y", "one"), (1, None, "z", None), (2, 1, "w", None)}
    c = b.unionByName(spark.createDataFrame([(1, 1, "two")], b.schema))
    got = sorted(tuple(r) for r in attach_all(a, c, ["k", "n"]).filter("n is not null").collect() if r["t"])
    assert got == [(1, 1, v, t) for v in "xy" for t in ("one", "two")] and attach_all(a, c, ["k", "n"]).count() == 6


def test_rows_of_spanning_and_missing_cells(spark):
    """A spanning cell is seen in every row it reaches but is part of its own row's key only."""
    cells = spark.createDataFrame([(1, "A", 0, 0, 2, 1, "a"), (1, "A", 0, 1, 1, 1, "b"), (1, "A", 1, 1, 1, 1, "c"), (1, "A", 5, 0, None, 1, "gone")],
                                  "pair_id int, side string, anchor_row int, anchor_col int, row_span int, col_span int, text string")
    rows = {r["anchor_row"]: r for r in td.anchor_rows(cells, ["pair_id"]).collect()}
    assert {k: (r["norm"], r["idx"]) for k, r in rows.items()} == {0: ("a | b", 0), 1: ("a | c", 1)}
    by = ["pair_id", "side"]
    keys = {r["anchor_row"]: r["row_key"] for r in tb.row_keys(cells, by).collect()}
    hashes = {r["anchor_row"]: r["row_hash"] for r in tb.row_hashes(cells, by).collect()}
    assert all(r["row_key"] == keys[k] and r["row_hash"] == hashes[k] for k, r in rows.items())


def test_cells_in_one_column_meet_each_with_each(spark):
    schema = "pair_id int, side string, anchor_row int, anchor_col int, row_span int, col_span int, text string"
    cells = spark.createDataFrame([(1, "A", 0, 0, 1, 1, "a"), (1, "A", 0, 0, 1, 1, "b"), (1, "A", 0, 1, 1, 1, "l"),
                                   (1, "B", 3, 0, 1, 1, "c"), (1, "B", 3, 0, 1, 1, "d"), (1, "B", 3, 2, 1, 1, "r")], schema)
    pairs = spark.createDataFrame([(1, "pair", 0, 3)], "pair_id int, kind string, a_row int, b_row int")
    got = td.cell_pairs(pairs, cells, ["pair_id"]).select("col", "x.norm", F.col("y.norm").alias("other")).collect()
    assert {tuple(r) for r in got} == {(0, x, y) for x in "ab" for y in "cd"} | {(1, "l", None), (2, None, "r")}
    led = spark.createDataFrame([(1, 1, 2), (1, 0, None)], "pair_id int, a_col int, b_col int")
    got = td.cell_pairs(pairs, cells, ["pair_id"], led).select("col", "x.norm", F.col("y.norm").alias("other")).collect()
    assert {tuple(r) for r in got} == {(2, "l", "r"), (0, "a", None), (0, "b", None)}
