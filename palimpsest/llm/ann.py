"""Approximate nearest neighbours by inner product (method: cross-polytope hashing).

Vectors are made unit vectors by one more coordinate that fills them up to the largest length there is, so that the nearest by angle are those with the
largest inner product. A hash function turns them by fast pseudo-rotations (three rounds of random signs and a Hadamard transform) and takes the signed
axis nearest to the result. A table joins a few hash functions to a bucket. Every vector stands in one bucket of each table; a query looks up, in each
table, the bucket of its nearest axes and those of the next nearest. What it meets there is compared exactly, in blocks of one bucket's queries by its
vectors: only the best of a block leave it, so neither candidates nor pairs are ever listed. Large buckets are cut into several blocks.

Equal vectors are one vector to the tables; a class of them is represented by its smallest ids, more of which than an answer holds can't be in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.shared import new_folder, written
from palimpsest.llm.vectors import matrix, usable

#: Tables of the index.
TABLES = 12
#: Vectors of a bucket, about, that the number of hash functions per table aims at.
BUCKET_ROWS = 400
#: Of the axes of each hash function, the share that queries look up.
PROBED = 1 / 10
#: Most vectors, and most queries, of a block.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024
#: Dot products at a time in a block.
AT_ONCE = 256


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random rotation of the rows of ``x``, filled up with zeros to a power of two."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    y = np.zeros((n, width))
    y[:, :d] = x
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, width))
    for row in signs:
        y *= row
        step = 1
        while step < width:
            z = y.reshape(n, width // (2 * step), 2, step)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(n, width)
            step *= 2
        y /= np.sqrt(width)
    return y


def axes_of(dimension: int) -> int:
    """Signed axes that a hash function tells apart: two for each of the coordinates kept, the largest power of two up to ``dimension``."""
    return 2 * (1 << (dimension.bit_length() - 1))


def _turned(x: np.ndarray, table: int, function: int) -> np.ndarray:
    """Coordinates of the rows on all signed axes of one hash function."""
    y = rotated(x, 1000 * table + function)[:, :axes_of(x.shape[1] - 1) // 2]
    return np.concatenate([y, -y], 1)


def buckets(x: np.ndarray, functions: int, table: int) -> np.ndarray:
    """The bucket of each row in a table."""
    out = np.zeros(len(x), np.int64)
    for f in range(functions):
        y = _turned(x, table, f)
        out = out * y.shape[1] + np.argmax(y, 1)
    return out


def probes(x: np.ndarray, functions: int, table: int, share: float) -> np.ndarray:
    """The buckets of a table that each row looks up, nearest first."""
    found, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for f in range(functions):
        y = _turned(x, table, f)
        few = max(1, round(share * y.shape[1]))
        order = np.argsort(-y, 1, kind="stable")[:, :few]
        lost = y.max(1, keepdims=True) - np.take_along_axis(y, order, 1)
        found = (found[:, :, None] * y.shape[1] + order[:, None, :]).reshape(len(x), -1)
        loss = (loss[:, :, None] + lost[:, None, :] ** 2).reshape(len(x), -1)
    return np.take_along_axis(found, np.argsort(loss, 1, kind="stable"), 1)


def search(rows: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, probed: float = PROBED,
           vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` rows with the largest inner product that each query finds: query_id, rank (from 1), vec_id, score.

    A query is not compared with the row of its own id. Scores are inner products of the original vectors in double precision; ties go to the smaller
    id. Rows and queries without a usable vector (see ``vectors.usable``) take no part. Rows of one id answer as one, with the best score of any of their
    vectors. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, "neighbours")
    base = usable(rows, vec_id, embedding).distinct()
    asked = usable(queries, vec_id, embedding)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    # A class of equal vectors: its smallest ids, one more than an answer holds (a query leaves out its own).
    place = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    members = base.withColumn("place", place).where(F.col("place") <= k + 1)
    classes = members.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first(squares).alias("square"))
    classes = written(classes, folder, "classes")
    size = classes.agg(F.count("*"), F.max("square"), F.max(F.size("embedding"))).first()
    n, longest, dimension = size[0], size[1] or 1.0, size[2] or 1
    axes = axes_of(dimension)
    # Few vectors need no hash function: they are one bucket, in one table.
    functions = max(0, round(np.log(max(n, 1) / BUCKET_ROWS) / np.log(axes)))
    tables = tables if functions else 1

    def filled(x: np.ndarray, most: float) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1) / most))
        return np.concatenate([x / np.sqrt(most), rest[:, None]], 1)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("embedding"))
            if not len(x):
                continue
            unit = filled(x, longest)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(buckets(unit, functions, t)), b.column("embedding"), b.column("ids")],
                                                 ["t", "bucket", "embedding", "ids"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x = matrix(b.column("embedding"))
                unit = np.concatenate([x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros((len(x), 1))], 1)
                for t in range(tables):
                    p = probes(unit, functions, t, probed)
                    row = pa.array(np.repeat(np.arange(len(x)), p.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(p.size, t, np.int32)), pa.array(p.reshape(-1)), b.column("vec_id").take(row), b.column("embedding").take(row)],
                                                     ["t", "bucket", "query_id", "query"])

    filed = classes.select("embedding", "ids").mapInArrow(file, "t int, bucket long, embedding array<double>, ids array<long>")
    looked = asked.mapInArrow(look, "t int, bucket long, query_id long, query array<double>")
    # Buckets beyond a block are cut on both sides.
    held = filed.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK_VECTORS).alias("parts"))
    wanted = looked.groupBy("t", "bucket").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("turns"))
    cells = written(held.join(wanted, ["t", "bucket"]), folder, "cells")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn")
    left = filed.join(cells, ["t", "bucket"]).select("t", "bucket", F.pmod(F.xxhash64("ids"), "parts").alias("part"), copies, "embedding", "ids")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    right = looked.join(cells, ["t", "bucket"]).select("t", "bucket", copies, F.pmod(F.xxhash64("query_id"), "turns").alias("turn"), "query_id", "query")
    keys = ["t", "bucket", "part", "turn"]
    right = right.select(*[F.col(c).alias(f"q_{c}") for c in keys], "query_id", "query")

    def block(vectors: pa.Table, asking: pa.Table) -> pa.Table:
        out = ([], [], [])
        if vectors.num_rows and asking.num_rows:
            x, q = matrix(vectors.column("embedding")), matrix(asking.column("query"))
            ids, own = vectors.column("ids").to_pylist(), asking.column("query_id").to_pylist()
            few = min(k + 8, len(x))
            for at in range(0, len(q), AT_ONCE):
                s = q[at:at + AT_ONCE] @ x.T
                top = np.argpartition(-s, few - 1, 1)[:, :few] if few < len(x) else np.tile(np.arange(len(x)), (len(s), 1))
                # The same sum in the same order for every pair, so that equal vectors tie.
                exact = (q[at:at + AT_ONCE, None, :] * x[top]).sum(2)
                for i in range(len(s)):
                    me, best = own[at + i], []
                    for j in np.argsort(-exact[i], kind="stable"):
                        best += [(-exact[i, j], v) for v in ids[top[i, j]] if v != me]
                    for score, v in sorted(best)[:k]:
                        out[0].append(me)
                        out[1].append(v)
                        out[2].append(-score)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    met = left.groupBy(*keys).cogroup(right.groupBy(*[f"q_{c}" for c in keys])).applyInArrow(block, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A vector met in several tables has the same score in each.
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
