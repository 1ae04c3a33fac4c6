"""What filters remove together: an audit of all orders of application (method: failing-id relations).

Every filter has one table of the ids that fail it. What a filter removes after a set of others is its table less theirs (left anti join); what it would
have removed, had an earlier filter not done so, is what the others took of its table (left semi join). Survivors, removals and losses of a prefix depend
on the set of filters before, not on their order, so each table is followed through all sets at once: rows carry the set applied so far, every filter in
turn doubles it (without, with), and one anti join per filter takes out what the sets with it have removed. All joins are on the row id, which is unique:
no key is hot, and the tables are shuffled once. Counts are grouped by part, filter, label and set (80 sets and filters for five); the rows of all orders
are made from these.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.shared import drop_tables, new_folder, written

#: Copies of one text that are joined by broadcast: texts of at least this share of all rows, so there are at most as many.
HOT_SHARE = 1024


def text_filters() -> dict[str, Column]:
    """Failure conditions of four filters on a column ``text`` that is not null and its words ``words``; the copy filter E needs the table."""
    n, upper = F.size("words"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    capitals = F.length("text") - F.length(F.translate("text", upper, ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct("words")) < 50 * n, "C": 100 * capitals > 3 * F.length("text"),
            "D": F.col("text").rlike("[#$%&*|]")}


def later_copies(rows: DataFrame, folder: str) -> DataFrame:
    """rid of the rows (rid, doc_id, digest) whose text a smaller doc_id has, too. Null ids are neither smaller nor larger than others.

    Groups are aggregated first. Those that hold a large share of all rows are few (``HOT_SHARE``) and sent to all tasks; others meet their rows in a shuffle.
    """
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    groups = written(groups.select("digest", "first", "n"), folder, "copied")
    least = rows.count() / HOT_SHARE
    hot, rest = groups.where(F.col("n") > least).drop("n"), groups.where(F.col("n") <= least).drop("n")
    narrow = rows.select("rid", "doc_id", "digest")
    in_hot = narrow.join(F.broadcast(hot), "digest")
    in_rest = narrow.join(F.broadcast(hot), "digest", "left_anti").join(rest, "digest")
    return in_hot.unionByName(in_rest).where("doc_id > first").select("rid")


def removals(failing: DataFrame, tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Counts by part, label, filter and set of filters before it: ``removed`` by it and ``redundant`` (failing it, removed before).

    ``failing`` has filter, rid, part and label; ``tables`` has the failing ids of each filter. A set is the sum of 2 to the number of each filter in it.
    What is left after each filter is written to ``folder``, so every step is one small plan.
    """
    names = list(tables)
    keys = ["part", "label", "filter", "before"]
    bits = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, 1 << i)])
    zero = F.lit(0).cast("long")
    rows, counts = failing.withColumn("before", F.lit(0)), []
    for i, name in enumerate(names):
        sets = F.when(F.col("filter") == name, F.array("before")).otherwise(F.array("before", F.col("before") + (1 << i)))
        grown = rows.select("part", "label", "filter", "rid", F.explode(sets).alias("before"))
        own = tables[name].select(F.col("rid").alias("own"))
        meets = (F.col("rid") == F.col("own")) & (F.col("before").bitwiseAND(1 << i) != 0)
        # What this filter takes is taken for all sets that add later filters.
        later = [sum(c) for k in range(len(names) - i) for c in itertools.combinations([1 << j for j in range(i + 1, len(names))], k)]
        took = grown.join(own, meets, "left_semi").groupBy(*keys).count().withColumn("more", F.explode(F.array(*map(F.lit, later))))
        took = took.where(F.col("more").bitwiseAND(bits[F.col("filter")]) == 0)
        took = took.select("part", "label", "filter", (F.col("before") + F.col("more")).alias("before"), zero.alias("removed"), F.col("count").alias("redundant"))
        counts.append(written(took, folder, f"taken_{name}"))
        rows = written(grown.join(own, meets, "left_anti"), folder, f"after_{name}")
        if i:
            drop_tables(rows.sparkSession, folder, f"after_{names[i - 1]}")
    out = rows.groupBy(*keys).count().select(*keys, F.col("count").alias("removed"), zero.alias("redundant"))
    for took in counts:
        out = out.unionByName(took)
    return out.groupBy(*keys).agg(F.sum("removed").alias("removed"), F.sum("redundant").alias("redundant"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (language; null: empty string), order of the filters A to E and step, with what the step removes, wastes and loses.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. ``docs`` has doc_id, text and lang; ``labels``
    has doc_id, quality and toxic. A null text is empty. Repeated rows are documents of their own; equal ids with equal texts are no copies of each other, and
    null ids neither have nor are copies. A document is good (toxic) if any of its labels says so; labels of null ids count for nothing. An empty table gives
    no parts and no rows. Other columns are not read.
    """
    folder = new_folder(docs.sparkSession, "filter-audit")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    plain = plain.withColumn("words", F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    checks = text_filters()
    judged = plain.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(n) for n, c in checks.items()])
    rows = written(judged, folder, "rows")
    tables = {n: written(rows.where(n).select("rid", "part", "doc_id"), folder, f"fails_{n}") for n in checks}
    tables["E"] = written(rows.join(later_copies(rows, folder), "rid", "left_semi").select("rid", "part", "doc_id"), folder, "fails_E")
    names = list(tables)
    failing = None
    for n, t in tables.items():
        own = t.select(F.lit(n).alias("filter"), "rid", "part", "doc_id")
        failing = own if failing is None else failing.unionByName(own)
    kinds = failing.select("filter", "rid", "part", F.lit("all").alias("label"))
    for kind, flag in (("good", F.col("quality") == 1), ("toxic", F.col("toxic") == 1)):
        ids = labels.where(flag & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
        kinds = kinds.unionByName(failing.join(ids, "doc_id", "left_semi").select("filter", "rid", "part", F.lit(kind).alias("label")))
    by_label = [F.sum(F.when(F.col("label") == kind, F.col(c))).alias(f"{kind}_{c}") for kind in ("all", "good", "toxic") for c in ("removed", "redundant")]
    counts = removals(written(kinds, folder, "failing"), tables, folder).groupBy("part", "filter", "before").agg(*by_label)
    return _orders(rows.groupBy("part").agg(F.count("*").alias("n_docs")), written(counts, folder, "counts"), names)


def _orders(parts: DataFrame, counts: DataFrame, names: list[str]) -> DataFrame:
    """All orders and steps of each part from the counts of sets."""
    steps, bit = [], {n: 1 << i for i, n in enumerate(names)}
    for order in itertools.permutations(names):
        for step, name in enumerate(order, 1):
            steps.append({"filter_order": "".join(order), "step": step, "filter": name, "before": sum(bit[x] for x in order[:step - 1])})
    every = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, filter: string, before: int>>")
    rows = parts.select("part", "n_docs", F.inline(every))
    full = sum(bit.values())
    number = [(n, s, s.bit_count()) for n in names for s in range(full + 1) if not s & bit[n]]
    ways = {k: math.factorial(k) * math.factorial(len(names) - 1 - k) for k in range(len(names))}
    weight = parts.sparkSession.createDataFrame([(n, s, ways[k], s == full - bit[n]) for n, s, k in number], "filter string, before int, ways long, alone boolean")
    by_filter = counts.join(F.broadcast(weight), ["filter", "before"]).groupBy("part", "filter").agg(
        F.sum(F.coalesce("all_removed", F.lit(0)) * F.col("ways")).alias("shapley"), F.sum(F.when(F.col("alone"), F.col("all_removed"))).alias("unique_fails"))
    joined = rows.join(counts, ["part", "filter", "before"], "left").join(by_filter, ["part", "filter"], "left")
    got = {n: F.coalesce(F.col(c), F.lit(0)).cast("long") for n, c in (
        ("removed", "all_removed"), ("redundant", "all_redundant"), ("unique_fails", "unique_fails"), ("good_lost", "good_removed"),
        ("toxic_lost", "toxic_removed"), ("shapley", "shapley"))}
    so_far = F.sum(got["removed"]).over(W.partitionBy("part", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    return joined.select("part", "filter_order", "step", (F.col("n_docs") - so_far).alias("kept"), *[c.alias(n) for n, c in got.items()])
