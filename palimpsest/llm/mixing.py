"""Mixing sources to target weights (method: Efraimidis-Spirakis sampling).

Every document draws an exponential key, -ln(u) / w, with its quality weight w; u comes from a digest of doc_id and text, so reruns agree. Within a
source, documents stand in ascending order of their keys, and the words before each of them are summed. A source's target first takes whole epochs
(every document once), then documents in this order until the rest of the target is reached; of the two ends next to it the nearer one is taken.

The place where a source's rest ends is found in two levels: documents fall into ranges of keys, ranges are summed, and only the range that holds the
end is ordered. So a source that holds a third of all rows is spread over many tasks, and what applies to documents is one small row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.shared import new_folder, sent_if_few, written

#: Weights of sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's size.
MOST_EPOCHS = 3
#: Documents of a source that share a range of keys, about.
RANGE_ROWS = 50_000
#: Quality weight of a document without a label; labels give 1/4 (poor) to 5/4 (good).
UNLABELLED = 0.75


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number above 0 and at most 1 from the digest of an id and a text. Repeated rows share it, and are taken or left together."""
    both = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return (F.conv(F.substring(F.md5(both), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Target of each source: ``sizes`` has source and source_size, the result adds target.

    The total of all sizes is shared by weight; no target exceeds ``most`` times its source's size, and what exceeds is shared again by weight among the
    others. In the end all others lie at one level times their weight, so the sources at their limit are those with the smallest limit per weight, and
    one sum over the sources in that order finds the level. ``sizes`` has one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * most
    rows = sizes.withColumn("_weight", weight.cast("double")).withColumn("_limit", limit)
    everything = W.partitionBy(F.lit(1))
    by_need = W.orderBy((F.col("_limit") / F.col("_weight")).asc(), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(W.unboundedPreceding, -1)
    onwards = by_need.rowsBetween(0, W.unboundedFollowing)
    rows = (rows.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
            .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / F.sum("_weight").over(onwards))
            .withColumn("_free", F.col("_level") * F.col("_weight") <= F.col("_limit")))
    # The level holds from the first source on that stays below its limit.
    first = F.coalesce(F.max(F.when(F.col("_free"), F.lit(1))).over(by_need.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    level = F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(by_need.rowsBetween(W.unboundedPreceding, 0))
    capped = F.when(first == 0, F.col("_limit").cast("double")).otherwise(F.least(level * F.col("_weight"), F.col("_limit").cast("double")))
    return rows.withColumn("target", capped).select("source", "source_size", "target")


def quality_weights(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """One weight per labelled doc_id: 1/4 plus its mean quality; null ids and labels are left out."""
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull())
    return rows.groupBy(F.col(doc_id).alias("doc_id")).agg((F.avg(quality) + 0.25).alias("weight"))


def mix(docs: DataFrame, weights: DataFrame | None = None, shares: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """How often the mix takes each document: the columns of ``docs``, then size, source_size, target, copies, taken (copies times size).

    ``docs`` has doc_id, source and text, and other columns, which are kept unless the result's names replace them; ``weights`` has doc_id and weight
    (above 0), others get ``UNLABELLED``. Every row is a document, repeated ids included. Documents without words have size 0 and are copied as their
    source's epochs and order say. A null source is a source of its own. An empty table gives an empty mix.
    """
    spark = docs.sparkSession
    # The columns of docs under names of our own: none of them can clash with what is added.
    own = {f"own{i}": c for i, c in enumerate(docs.columns) if c not in ("size", "source_size", "target", "copies", "taken")}
    drawn = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in own.items()], "doc_id", "source", "text")
    drawn = drawn.withColumns({"size": word_count("text"), "_u": uniform()}).drop("text")
    if weights is None:
        drawn = drawn.withColumn("_w", F.lit(UNLABELLED))
    else:
        weights = written(weights.select(F.col("doc_id").alias("_labelled"), F.col("weight").alias("_w")), new_folder(spark, "mixing"), "weights")
        drawn = drawn.join(sent_if_few(weights), F.col("doc_id") == F.col("_labelled"), "left")
    drawn = drawn.withColumn("_key", -F.log("_u") / F.coalesce("_w", F.lit(UNLABELLED))).drop("_u", "_w", "_labelled")
    # Nearly even ranges: most keys are about exponential with this rate. Which range a key is in never decides anything else.
    drawn = drawn.withColumn("_even", 1 - F.exp(-F.col("_key") * UNLABELLED))

    narrow = written(drawn.select("source", "size", "_key", "_even"), new_folder(spark, "mixing"), "keys")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    plan = targets(sizes.select("source", "source_size"), shares, most).join(sizes.select(F.col("source").alias("_s"), "_n"), F.col("source").eqNullSafe(F.col("_s")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    plan = plan.withColumn("_epochs", epochs.cast("long"))
    plan = plan.select(F.col("source").alias("_s"), "source_size", "target", "_epochs", (F.col("target") - F.col("_epochs") * F.col("source_size")).alias("_rest"),
                       F.ceil(F.col("_n") / RANGE_ROWS).alias("_ranges"))
    same = F.col("source").eqNullSafe(F.col("_s"))

    ranged = narrow.join(plan.select("_s", "_rest", "_ranges"), same).withColumn("_range", F.floor(F.col("_even") * F.col("_ranges")))
    words = ranged.groupBy("_s", "_range", "_rest").agg(F.sum("size").alias("_words"))
    upto = F.sum("_words").over(W.partitionBy("_s").orderBy("_range"))
    crossing = words.withColumn("_base", upto - F.col("_words")).where((F.col("_base") < F.col("_rest")) & (F.col("_rest") <= F.col("_base") + F.col("_words")))
    crossing = crossing.select(F.col("_s").alias("_cs"), F.col("_range").alias("_cross"), "_base")
    inside = ranged.join(crossing, F.col("_s").eqNullSafe(F.col("_cs")) & (F.col("_range") == F.col("_cross")))
    # Equal keys end together.
    blocks = inside.groupBy("_cs", "_cross", "_base", "_rest", "_key").agg(F.sum("size").alias("size"))
    start = F.col("_base") + F.sum("size").over(W.partitionBy("_cs").orderBy("_key")) - F.col("size")
    # Taken if the end of this document is nearer to the rest of the target than its start.
    cut = (blocks.withColumn("_taken", F.col("_rest") - start > F.col("size") / 2)
           .groupBy("_cs", "_cross").agg(F.max(F.when(F.col("_taken"), F.col("_key"))).alias("_last")))
    plan = plan.join(cut, F.col("_s").eqNullSafe(F.col("_cs")), "left").drop("_cs")
    # A row per source.
    plan = written(plan, new_folder(spark, "mixing"), "plan")

    mine = F.floor(F.col("_even") * F.col("_ranges"))
    taken = (mine < F.col("_cross")) | ((mine == F.col("_cross")) & (F.col("_key") <= F.col("_last")))
    out = drawn.join(plan, same)
    out = out.withColumn("copies", F.col("_epochs") + F.when(taken, 1).otherwise(0))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col(n).alias(c) for n, c in own.items()], "size", "source_size", "target", "copies", "taken")
