"""Token ids as flat binary files (method: flat unsigned integers plus 64-bit document offsets, mapped into memory).

Layout of a folder, for each part ``p`` (documents of one range of doc_id, in ascending order; null ids come first, equal ids in order of text):

    p.ids       unsigned little-endian integers, 16 bits if the vocabulary allows, otherwise 32
    p.docs      64-bit doc_id of each document (0 for null, see ``n_null``)
    p.offsets   64-bit start of each document in the whole collection, and the end of the last one

``manifest`` is a Parquet table: part, dtype, n_docs, n_null, n_tokens, base. The base of a part is the prefix sum of the tokens of all parts before it.
Files are written under a name of their own and moved in place, so a task that runs twice leaves the same files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.bytescan import text_bytes
from palimpsest.llm.shared import map_file, put_file, written
from palimpsest.llm.tokens import encoder


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text and write the collection to ``folder`` (a shared, mounted one); returns the manifest.

    A null text is empty: its document is the end id alone. Repeated rows are documents of their own. An empty table gives an empty manifest.
    Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        ids, sizes, keys, nulls = [], [], [], 0
        for b in batches:
            got, count = enc.encode(*text_bytes(b.column("text")))
            ends = np.cumsum(count)
            ids.append(np.insert(got, ends, end_id).astype(enc.dtype))
            sizes.append(count + 1)
            nulls += b.column("doc_id").null_count
            keys.append(b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        if not keys or not sum(map(len, keys)):
            return
        flat, size = np.concatenate(ids), np.concatenate(sizes)
        name = f"{folder}/{part:06d}"
        put_file(f"{name}.ids", flat)
        put_file(f"{name}.docs", np.concatenate(keys))
        put_file(f"{name}.sizes", size.astype("<i8"))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "dtype": [enc.dtype], "n_docs": [len(size)], "n_null": [nulls], "n_tokens": [len(flat)]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranged = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    parts = written(ranged.mapInArrow(write, "part int, dtype string, n_docs long, n_null long, n_tokens long"), folder, "parts")
    # One row per file: a small table, whatever the size of the texts.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    manifest = written(parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), folder, "manifest")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base in zip(b.column("part").to_pylist(), b.column("base").to_pylist(), strict=True):
                size = map_file(f"{folder}/{part:06d}.sizes", "<i8")
                put_file(f"{folder}/{part:06d}.offsets", base + np.concatenate([[0], np.cumsum(size)]).astype("<i8"))
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

    manifest.select("part", "base").repartition(n, "part").mapInArrow(place, "done int").agg(F.sum("done")).collect()
    return manifest


def map_documents(spark: SparkSession, folder: str, of: Callable[[np.ndarray], dict], schema: str, most: int = 4096) -> DataFrame:
    """Read the collection back from its files: doc_id, start, n_tokens, and what ``of`` makes of the ids of each document (``schema`` names its columns).

    Files are mapped, not loaded; a part is read in pieces of ``most`` documents, which tasks share.
    """
    names = [c.strip().split()[0] for c in schema.split(",")] if schema else []
    out = "doc_id long, start long, n_tokens long" + (f", {schema}" if schema else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                name = f"{folder}/{r['part']:06d}"
                ids, keys, at = map_file(f"{name}.ids", r["dtype"]), map_file(f"{name}.docs", "<i8"), map_file(f"{name}.offsets", "<i8")
                first, last = r["piece"] * most, min(r["n_docs"], (r["piece"] + 1) * most)
                made = [of(ids[at[i] - r["base"]:at[i + 1] - r["base"]]) for i in range(first, last)]
                null = np.arange(first, last) < r["n_null"]
                columns = {"doc_id": pa.array(np.asarray(keys[first:last]), mask=null), "start": pa.array(np.asarray(at[first:last])),
                           "n_tokens": pa.array(np.diff(at[first:last + 1]))}
                yield pa.RecordBatch.from_pydict(columns | {c: pa.array([m[c] for m in made]) for c in names})

    manifest = spark.read.schema("part int, dtype string, n_docs long, n_null long, n_tokens long, base long").parquet(f"{folder}/manifest")
    pieces = manifest.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n_docs") - 1) / most).cast("int"))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, "part", "piece").mapInArrow(read, out)
