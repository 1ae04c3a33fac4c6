"""Centroid clustering of integer vectors (method: PCA-rotated filtering).

Vectors are turned into integers once and stored with their leading coordinates in a rotated basis and the norm of the rest. The squared distance of two
leading parts plus the squared difference of the two norms is never more than the squared distance, so it bounds every centroid from below; the centroid of
the least bound is measured first, in integers, and then those whose bound doesn't exceed what was found. The rotation (leading axes of all vectors'
covariance) decides how many centroids have to be measured, never the result.

Integers have no bound: vectors whose components are within ``small(width)`` are worked on in 64 bits, others in Python's integers; a centroid too far away to be
the nearest of any small vector is left out for those. Sums of a round are made in each task, cut into limbs of ``LIMB`` bits and added by Spark, so a new centroid is exact whatever the number of rows. The centroids (16 of 64 numbers) are
all that tasks and driver exchange.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import new_folder, written
from palimpsest.llm.vectors import lists, matrix

WIDTH, CLUSTERS, ROUNDS = 64, 16, 3
#: Leading coordinates of the rotated basis that are stored.
LEADING = 16
#: Bits of a limb of a sum.
LIMB = 40
#: Rounding of the bound, in parts of the squared norms it is made of.
SLACK = 1e-9

STORED = "vec_id long, whole array<long>, large array<double>, leading array<double>, rest double"


def small(width: int) -> tuple[int, int]:
    """Largest component of a small vector, and of a centroid that may be nearest to one while another centroid is small.

    Small ones differ by at most 2 * s in each of ``width`` components; a component that differs by more than 2 * s * sqrt(width) is farther than that.
    Distances up to there fit in 63 bits.
    """
    s = 1 << 30
    while width * (s + _reach(s, width)) ** 2 >= 1 << 63:
        s >>= 1
    return s, _reach(s, width)


def _reach(s: int, width: int) -> int:
    return s + 2 * s * (math.isqrt(width - 1) + 1)


def integers(values: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of doubles, exact at any size; ``scale`` is a power of two."""
    return [math.floor(scale * x) if abs(x) < 1e300 else int(x) * scale for x in values.tolist()]


def kept_vectors(rows: DataFrame, width: int, vec_id: str, embedding: str) -> DataFrame:
    vector = F.col(f"`{embedding}`").cast("array<double>")
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), vector.alias("x")).where(F.size("x") == width)
    return rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def rotation(kept: DataFrame, width: int, leading: int) -> np.ndarray:
    """The leading axes of the covariance of all vectors, as columns; sums are made in tasks and added by Spark."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            # Directions count, not lengths: one very long vector doesn't decide the basis.
            x = matrix(b.column("x"))
            norm = np.abs(x).max(1, keepdims=True)
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(total.size, dtype=np.int32)), "value": pa.array(total.reshape(-1))})

    got = kept.select("x").mapInArrow(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    total = got.sort_values("place")["value"].to_numpy().reshape(width + 1, width + 1) if len(got) else np.zeros((width + 1, width + 1))
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))[1]
    return axes[:, ::-1][:, :leading]


def stored(kept: DataFrame, axes: np.ndarray, scale: int) -> DataFrame:
    """Integers with their leading rotated coordinates and the norm of the rest; vectors with large components keep their doubles instead."""

    most = small(len(axes))[0]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"))
            large = (np.abs(x) > most / scale).any(1)
            q = np.floor(scale * np.where(large[:, None], 0.0, x)).astype(np.int64)
            lead, rest = rotated(q.astype(np.float64), axes)
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id"), _masked(lists(q), large), _masked(lists(x), ~large), lists(lead), pa.array(rest)],
                names=["vec_id", "whole", "large", "leading", "rest"])

    return kept.mapInArrow(turn, STORED)


def _masked(column: pa.ListArray, null: np.ndarray) -> pa.Array:
    return column.filter(pa.array(~null)).take(pa.array(np.cumsum(~null) - 1, mask=null)) if null.any() else column


def rotated(q: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lead = q @ axes
    return lead, np.sqrt(np.maximum((q * q).sum(1) - (lead * lead).sum(1), 0.0))


class Centroids:
    """Centroids as Python integers, and what the bounds need of those that may be nearest to small vectors."""

    def __init__(self, whole: list[list[int]], axes: np.ndarray):
        most, reach = small(len(axes))
        self.whole, self.small = whole, any(all(abs(v) <= most for v in c) for c in whole)
        self.number = np.array([i for i, c in enumerate(whole) if all(abs(v) <= reach for v in c)], np.int64)
        self.q = np.array([whole[i] for i in self.number], np.int64).reshape(len(self.number), len(axes))
        self.lead, self.rest = rotated(self.q.astype(np.float64), axes)
        self.norm = (self.q.astype(np.float64) ** 2).sum(1)

    def nearest(self, q: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and exact squared distance of the nearest centroid of each small vector, and how many centroids were measured."""
        bound = ((lead * lead).sum(1)[:, None] - 2 * lead @ self.lead.T + (self.lead * self.lead).sum(1)) + (rest[:, None] - self.rest) ** 2
        bound -= SLACK * ((lead * lead).sum(1)[:, None] + (rest * rest)[:, None] + self.norm) + SLACK
        first = bound.argmin(1)
        best, place = _squared(q, self.q[first]), first.copy()
        measured = len(q)
        for c in range(len(self.q)):
            open_ = np.flatnonzero((bound[:, c] <= best) & (first != c))
            measured += len(open_)
            d = _squared(q[open_], self.q[c])
            better = (d < best[open_]) | ((d == best[open_]) & (c < place[open_]))
            best[open_[better]], place[open_[better]] = d[better], c
        return self.number[place], best, measured

    def of_integers(self, q: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), i) for i, c in enumerate(self.whole))[::-1]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: Centroids, scale: int):
    """For each batch: ids, integers (Python's where large), cluster, distance (Python integers where large)."""
    for b in batches:
        large = b.column("whole").is_null().to_numpy(zero_copy_only=False)
        number, distance = np.zeros(len(large), np.int64), np.zeros(len(large), object)
        plain = ~large if centroids.small else np.zeros(len(large), bool)
        part = b.filter(pa.array(plain))
        q = matrix(part.column("whole")).astype(np.int64) if len(part) else np.empty((0, 0), np.int64)
        if len(part):
            number[plain], near, _ = centroids.nearest(q, matrix(part.column("leading")), part.column("rest").to_numpy())
            distance[plain] = near
        others = []
        for i in np.flatnonzero(~plain):
            own = integers(np.array(b.column("large")[i].as_py()), scale) if large[i] else b.column("whole")[i].as_py()
            number[i], distance[i] = centroids.of_integers(own)
            others.append((number[i], own))
        yield b.column("vec_id"), number, distance, (number[plain], q), others


def _limbs(value: int) -> list[int]:
    sign, value, out = (-1, -value, []) if value < 0 else (1, value, [])
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def _round(table: DataFrame, centroids: Centroids, width: int, scale: int) -> list[list[int]]:
    """The centroids after one round: floor of the mean of their vectors, unchanged where there are none."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.whole)
        n, total = [0] * k, [[0] * width for _ in range(k)]
        for _, _, _, (number, q), others in _assigned(batches, centroids, scale):
            for c in np.unique(number):
                mine = q[number == c]
                n[c] += len(mine)
                total[c] = [a + b for a, b in zip(total[c], mine.sum(0).tolist(), strict=True)]
            for c, own in others:
                n[c] += 1
                total[c] = [a + b for a, b in zip(total[c], own, strict=True)]
        rows = [(c, j, i, v) for c in range(k) for j, s in enumerate([*total[c], n[c]]) for i, v in enumerate(_limbs(s))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["cluster", "place", "limb", "value"])

    got = table.mapInArrow(sums, "cluster long, place long, limb long, value long").groupBy("cluster", "place", "limb")
    new = [[0] * (width + 1) for _ in centroids.whole]
    for r in got.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        new[r.cluster][r.place] += int(r.value) << (LIMB * r.limb)
    return [[s // c[-1] for s in c[:-1]] if c[-1] else old for c, old in zip(new, centroids.whole, strict=True)]


def cluster(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = 64, seed: str = "1:", leading: int = LEADING,
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector of ``width`` finite numbers.

    Centroids start as the ``k`` vectors whose id has the smallest hash (rows of equal ids: in order of their numbers), or all if there are fewer. A null id
    starts no centroid unless ids run out of hashes; its vector is clustered like any other. Repeated rows are vectors of their own. Null vectors, those of
    another length, and those that hold null or non-finite numbers are left out; an empty table gives no rows. Distances and inertias that 64 bits can't hold
    are null. Other columns are not read.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, "centroids")
    kept = kept_vectors(rows, width, vec_id, embedding)
    axes = rotation(kept, width, leading)
    table = written(stored(kept, axes, scale), folder, "vectors")
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    start = table.orderBy(digest.asc_nulls_last(), F.col("whole").asc_nulls_last(), "large").limit(k).select("whole", "large").collect()
    whole = [list(r.whole) if r.whole is not None else integers(np.array(r.large), scale) for r in start]
    for _ in range(rounds):
        whole = _round(table, Centroids(whole, axes), width, scale)
    last = Centroids(whole, axes)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in whole]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, number, distance, _, _ in _assigned(batches, last, scale):
            fits = [int(d) if d < 1 << 63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = written(table.mapInArrow(assign, "vec_id long, cluster int, distance long"), folder, "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count(F.when(F.col("distance").isNull(), 1)).alias("lost")).collect()
    known = {r.cluster: int(r.d) if not r.lost and r.d is not None else None for r in sums}
    total = None if None in known.values() else sum(known.values())
    listed = [(c, _fits(d), _fits(total), hashes[c]) for c, d in known.items()]
    # One row per centroid.
    facts = spark.createDataFrame(listed, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _fits(value: int | None) -> int | None:
    return value if value is not None and value < 1 << 63 else None
