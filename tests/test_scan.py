"""Running state: chunked scans against plain windows."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import scan as sc
from palimpsest.operators.scan import PLAIN, Run, scan


def test_chunked_equals_plain(spark):
    rng = random.Random(1)
    rows = [(g, p * rng.randint(1, 2) + p, rng.choice([None, 1, 2, 5]), p) for g in range(3) for p in range(40)]
    df = spark.createDataFrame(rows, "g int, p int, v int, u int")
    for reverse in (False, True):
        runs = {"s": Run("sum", F.col("v")), "x": Run("max", F.col("v")), "m": Run("min", F.col("v"), exclusive=True),
                "c": Run("count", F.col("v"), exclusive=True), "l": Run("last", F.col("v")), "le": Run("last", F.col("v"), exclusive=True)}
        cols = ["g", "p", "u", *runs]
        plain = scan(df, ["g"], "p", runs, tie=["u"], reverse=reverse, chunk=PLAIN).select(cols).collect()
        chunked = scan(df, ["g"], "p", runs, tie=["u"], reverse=reverse, chunk=7).select(cols).collect()
        assert sorted(plain, key=str) == sorted(chunked, key=str)


def test_auto_picks_by_group_size(spark):
    df = spark.range(100).select(F.lit(1).alias("g"), F.col("id").alias("p"))
    assert sc.chunk_for(df, ["g"], limit=100) is PLAIN
    assert sc.chunk_for(df, ["g"], limit=99) == sc.DEFAULT_CHUNK
