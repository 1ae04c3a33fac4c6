"""Connected components of links, by contracting stars: each round hangs neighbours on the smallest node they know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import drop_tables, written


def components(links: DataFrame, folder: str) -> DataFrame:
    """Node and the smallest node it is connected with (component), for all nodes of ``links`` (a, b; any order, repeats and loops allowed).

    Every round is written to ``folder``. The number of rounds grows with the logarithm of the longest chain. A node that very many links meet is only
    ever an aggregate (its smallest neighbour) and one side of a join that the adaptive planner may split.
    """
    spark = links.sparkSession
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), folder, "edges-0")
    state, turn = None, 0
    while True:
        got = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == state or not got[0]:
            break
        state, turn = got, turn + 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        # Larger neighbours of a node go to the smallest node near it.
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Smaller neighbours and the node itself do, too.
        lower = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(lower, F.col("u") == F.col("w"))
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.union(lower.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), folder, f"edges-{turn}")
        drop_tables(spark, folder, f"edges-{turn - 1}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
