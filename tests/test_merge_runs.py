"""Cut tables joined by heights equal those joined step by step."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import tables as tb

CELL = "pair_id bigint, table_uid string, anchor_row int, anchor_col int, row_span int, col_span int, text string"
GROUP = "pair_id bigint, type string, table_uid string, run bigint, step int"


def test_heights_equal_steps(spark):
    rng = random.Random(4)
    cells, groups = [], []
    for pair in range(60):
        header = [["h", "k", ""], ["u", "", "v"]][:rng.randrange(1, 3)]
        for step in range(rng.randrange(1, 6)):
            uid = f"t{pair}.{step}"
            body = [[rng.choice(["a", "b", "", "c"]) for _ in range(rng.randrange(2, 5))] for _ in range(rng.randrange(0, 4))]
            if rng.random() < 0.4:
                body.append(["Continued on next page"])
            rows = (header if rng.random() < 0.8 or step == 0 else header[:1] if rng.random() < 0.5 else []) + body
            rows = rows or [["x"]]
            for r, row in enumerate(rows):
                cells += [(pair, uid, r, c, rng.choice([1, 1, 1, 2]) if r > 1 else 1, rng.choice([1, 1, 2]), t) for c, t in enumerate(row)]
            groups.append((pair, "table", uid, 1, step))
    c, g = spark.createDataFrame(cells, CELL), spark.createDataFrame(groups, GROUP)
    got = tb.merge_runs(c, g, ["pair_id"])
    by = ["pair_id", "run"]
    head = g.filter("step = 0").select("pair_id", F.col("table_uid").alias("base"))
    placed = c.join(g.select("pair_id", "run", "step", "table_uid"), ["pair_id", "table_uid"]).join(head, "pair_id").withColumn("table_uid", F.col("base")).drop("base")
    want = tb._step_by_step(placed, by)
    cols = ["pair_id", "table_uid", "anchor_row", "anchor_col", "row_span", "col_span", "text"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_a_run_of_ten_thousand_pieces(spark):
    n = 10_000
    ids = spark.range(n).select(F.lit(1).cast("long").alias("pair_id"), F.concat(F.lit("t"), "id").alias("table_uid"), F.col("id").cast("int").alias("step"))
    row = F.explode(F.array(F.struct(F.lit(0).alias("r"), F.lit("head").alias("t")), F.struct(F.lit(1).alias("r"), F.concat(F.lit("text of "), "table_uid").alias("t")))).alias("x")
    cells = ids.select("pair_id", "table_uid", row).selectExpr("pair_id", "table_uid", "x.r as anchor_row", "0 as anchor_col", "1 as row_span", "1 as col_span", "x.t as text")
    groups = ids.selectExpr("pair_id", "'table' as type", "table_uid", "1L as run", "step")
    got = tb.merge_runs(cells, groups, ["pair_id"])
    r = got.agg(F.count("*").alias("n"), F.max("anchor_row").alias("last"), F.count_if(F.col("text") == "head").alias("heads")).first()
    assert (r.n, r.last, r.heads) == (n + 1, n, 1)
