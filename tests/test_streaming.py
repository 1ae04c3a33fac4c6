"""Pairs that arrive in pieces: same results as all at once, whatever the files."""

import pytest
from pyspark.sql import functions as F

from palimpsest.plans.compare import compare_text
from palimpsest.streaming import pairs as sp


def nodes_of(spark, n=12):
    rows = []
    for p in range(n):
        a = [f"line {i} of text {p}" for i in range(p * 3)]
        b = [t.replace("line", "row") if i % 4 == 1 else t for i, t in enumerate(a) if i % 5 != 2] + (["one more"] if p % 2 else [])
        a = [] if p == 5 else a
        rows += [(p, s, i, f"n{i:06d}", "paragraph", None, t) for s, d in (("A", a), ("B", b)) for i, t in enumerate(d)]
    return spark.createDataFrame(rows, sp.LINES)


@pytest.mark.parametrize("per_batch", [1, 3, 1000])
def test_stream_equals_batch(spark, tmp_path, per_batch):
    nodes = nodes_of(spark)
    pieces = sp.announced(nodes).withColumn("piece", (F.col("pair_id") + F.when(F.col("side") == "B", 1).otherwise(0) + F.col("ord") % 2 * 2) % 4).cache()
    for i in range(4):
        pieces.filter(F.col("piece") == i).drop("piece").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sp.compare_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ckpt", files_per_batch=per_batch).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, compare_text(nodes).summary.select(got.columns).collect()))
    assert not (tmp_path / "out-incomplete").exists()


def test_pairs_that_never_close_are_given_up(spark, tmp_path):
    rows = sp.announced(nodes_of(spark, 8)).cache()
    lost = (F.col("pair_id") == 6) & (F.col("side") == "B")
    where = str(tmp_path)

    def run():
        sp.compare_stream(spark, f"{where}/in", f"{where}/out", f"{where}/ckpt", wait_ms=0, compare=lambda n: n).awaitTermination()

    rows.filter(~lost & (F.col("pair_id") != 7)).coalesce(1).write.mode("append").parquet(f"{where}/in")
    run()
    rows.filter(F.col("pair_id") == 7).coalesce(1).write.mode("append").parquet(f"{where}/in")
    run()
    given_up = spark.read.parquet(f"{where}/out-incomplete")
    assert {(r.pair_id, r.side) for r in given_up.collect()} == {(6, "A")} and given_up.count() == 18
    done = spark.read.parquet(f"{where}/out")
    assert {r.pair_id for r in done.collect()} == {1, 2, 3, 4, 5, 7}
    assert done.drop("batch_id").exceptAll(rows.select(*sp.COLUMNS)).count() == 0
