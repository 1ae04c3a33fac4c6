"""Cells are many: what is done for each of them is done once, and only where it decides something."""

from pyspark.sql import functions as F

from palimpsest.catalog import QUERIES, load_all
from palimpsest.functions import text as tx
from test_exchanges import sf  # noqa: F401

load_all()


def test_plain_texts_are_left_alone_and_others_are_not(spark):
    texts = ["", " ", "a", "a b", " a", "a ", "a  b", "a\tb", "a\nb", "a\r\nb\n", "Part 12 ;x", "a b", "café x", "a​b", "　a", "A\x0bB",
             "a\x1cb", "a\x1f b", "x" * 50_000, "x " * 50_000 + "x", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    full = tx.collapse(tx.norm_base(F.col("t")))
    assert d.filter(~tx.norm_text(F.col("t")).eqNullSafe(full)).count() == 0
    match = F.lower(tx.collapse(F.coalesce("t", F.lit(""))))
    assert d.filter(~tx.norm_for_match(F.col("t")).eqNullSafe(match)).count() == 0
    for form in (tx.norm_text, tx.norm_for_match):
        assert "rlike" in str(form(F.col("t"))).lower()


def test_tables_are_split_without_a_list_of_every_case(spark, sf):  # noqa: F811
    df = QUERIES["m3_continuation_rows"](spark, sf)
    assert "isnotnull(lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    # orders have 1 + k % 6 items under a header; what lies behind the second goes to the second piece, with the header again
    rows = {k: 1 + k % 6 for k in range(1, 40)}
    want = {(k, "t0"): (5 * (min(n, 2) + 1), min(n, 2)) for k, n in rows.items()} | {(k, "t1"): (5 * (n - 1), n - 2) for k, n in rows.items() if n > 2}
    assert {(r["pair_id"], r["table_uid"]): (r["n"], r["last_row"]) for r in df.collect()} == want
