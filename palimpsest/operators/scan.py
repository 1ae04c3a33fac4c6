"""Running state over ordered rows, without putting an unbounded group into one task.

A plain ``Window.partitionBy(doc).orderBy(pos)`` sends every row of a document to one task.  That is the best plan while
groups are bounded: consecutive steps share one exchange and one sort.  A document that holds a third of all rows
would become the straggler, so group sizes are counted first (``chunk_for``, keys only).  If some group is larger
than ``PLAIN_LIMIT`` rows, ``scan`` splits groups into chunks of consecutive positions, aggregates each chunk (map-side
combined), runs the window over the chunk summaries only, and adds the carried-in state to a window *inside*
each chunk.  Both ways give the same values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.session import cut_lineage

DEFAULT_CHUNK = 4096
PLAIN_LIMIT = 2_000_000
AUTO = -1
PLAIN = None


def chunk_for(df: DataFrame, keys: list[str], limit: int | None = None) -> int | None:
    """``PLAIN`` if every group has at most ``limit`` rows, else the chunk length; reads the key columns once."""
    limit = PLAIN_LIMIT if limit is None else limit
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    return PLAIN if big.isEmpty() else DEFAULT_CHUNK


@dataclass(frozen=True)
class Run:
    """One running value: kind is sum, count, max, min or last (last non-null)."""

    kind: str
    value: Column
    exclusive: bool = False


def _over(run: Run, value: Column, w) -> Column:
    if run.kind in ("sum", "count"):
        return F.sum(value).over(w)
    if run.kind == "max":
        return F.max(value).over(w)
    if run.kind == "min":
        return F.min(value).over(w)
    return F.last(value, ignorenulls=True).over(w)


def _merge(run: Run, carried: Column, inside: Column) -> Column:
    if run.kind in ("sum", "count"):
        return F.coalesce(carried, F.lit(0)) + F.coalesce(inside, F.lit(0))
    if run.kind == "max":
        return F.greatest(carried, inside)
    if run.kind == "min":
        return F.least(carried, inside)
    return F.coalesce(inside, carried)


def scan(
    df: DataFrame,
    keys: list[str],
    position: str,
    runs: dict[str, Run],
    tie: list[str] | None = None,
    reverse: bool = False,
    chunk: int | None = AUTO,
) -> DataFrame:
    """Add one column per entry of ``runs``, computed over ``keys`` in order of ``(position, *tie)``.

    ``position`` is a non-negative whole number; it need not be dense.  ``reverse`` scans from the end.
    ``chunk`` is ``PLAIN``, a chunk length, or ``AUTO`` to count the groups first; pipelines count once and pass it on.
    """
    tie = tie or []
    if chunk == AUTO:
        chunk = chunk_for(df, keys)
    if chunk is PLAIN:
        w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in [position, *tie]])
        out = []
        for name, run in runs.items():
            value = F.when(run.value.isNotNull(), 1).otherwise(0) if run.kind == "count" else run.value
            v = _over(run, value, w.rowsBetween(W.unboundedPreceding, -1 if run.exclusive else 0))
            out.append((F.coalesce(v, F.lit(0)) if run.kind in ("sum", "count") else v).alias(name))
        return df.select("*", *out)
    # both branches below read the rows once computed
    df = cut_lineage(df)
    work = df.withColumn("_chunk", F.floor(F.col(position) / F.lit(chunk)).cast("long"))
    for name, run in runs.items():
        value = F.when(run.value.isNotNull(), 1).otherwise(0) if run.kind == "count" else run.value
        work = work.withColumn(f"_v_{name}", value)

    order_key = F.struct(*[F.col(c) for c in [position, *tie]])
    totals = []
    for name, run in runs.items():
        value = F.col(f"_v_{name}")
        if run.kind in ("sum", "count"):
            total = F.sum(value)
        elif run.kind == "max":
            total = F.max(value)
        elif run.kind == "min":
            total = F.min(value)
        else:
            pick = F.min_by if reverse else F.max_by
            total = pick(value, F.when(value.isNotNull(), order_key))
        totals.append(total.alias(f"_t_{name}"))
    summary = work.groupBy(*keys, "_chunk").agg(*totals)

    def sorting(cols):
        return [F.col(c).desc() if reverse else F.col(c).asc() for c in cols]

    before = W.partitionBy(*keys).orderBy(*sorting(["_chunk"])).rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(
        *keys, "_chunk", *[_over(run, F.col(f"_t_{n}"), before).alias(f"_c_{n}") for n, run in runs.items()]
    )
    joined = work.join(carry, [*keys, "_chunk"], "left")
    inside = W.partitionBy(*keys, "_chunk").orderBy(*sorting([position, *tie]))
    for name, run in runs.items():
        w = inside.rowsBetween(W.unboundedPreceding, -1 if run.exclusive else 0)
        joined = joined.withColumn(name, _merge(run, F.col(f"_c_{name}"), _over(run, F.col(f"_v_{name}"), w)))
    drop = ["_chunk"] + [f"_{p}_{n}" for n in runs for p in "vc"]
    return joined.drop(*drop)


def number_rows(df: DataFrame, keys: list[str], position: str, out: str, tie: list[str] | None = None,
                chunk: int | None = AUTO) -> DataFrame:
    """Zero-based row number over ``keys`` in order of ``(position, *tie)``."""
    return scan(df, keys, position, {out: Run("count", F.lit(1), exclusive=True)}, tie=tie, chunk=chunk)


def previous(df: DataFrame, keys: list[str], position: str, out: str, value: Column, tie: list[str] | None = None,
             chunk: int | None = AUTO) -> DataFrame:
    """``lag(value, 1)``; wrap nullable values in a struct so that a null row is not skipped."""
    return scan(df, keys, position, {out: Run("last", value, exclusive=True)}, tie=tie, chunk=chunk)


def following(df: DataFrame, keys: list[str], position: str, out: str, value: Column, tie: list[str] | None = None,
              chunk: int | None = AUTO) -> DataFrame:
    """``lead(value, 1)``; wrap nullable values in a struct so that a null row is not skipped."""
    return scan(df, keys, position, {out: Run("last", value, exclusive=True)}, tie=tie, reverse=True, chunk=chunk)


def attach(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` left joined with ``other``, which has one row per ``keys``, by a window over both.

    A join would send both sides through an exchange by all ``keys``; a window is content with rows that lie together by some of
    them already, as rows of one table do, and it holds no group as a whole.
    """
    rest = [c for c in other.columns if c not in keys]
    right = other.dropna(subset=keys).select(*keys, F.struct(*rest).alias("_r"))
    none = F.lit(None).cast(right.schema["_r"].dataType).alias("_r")
    both = df.select("*", F.lit(True).alias("_mine"), none).unionByName(right.withColumn("_mine", F.lit(False)), allowMissingColumns=True)
    found = F.first("_r", ignorenulls=True).over(W.partitionBy(*keys))
    return both.withColumn("_r", found).filter("_mine").select(*df.columns, *[F.col("_r")[c].alias(c) for c in rest])


def attach_all(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Like :func:`attach` where ``other`` may have several rows per ``keys``: each of them makes one row, as in a left join."""
    rest = [c for c in other.columns if c not in keys]
    every = other.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_all"))
    return attach(df, every, keys).select(*df.columns, F.explode_outer("_all").alias("_one")).select(*df.columns, "_one.*")
