"""A corpus pipeline: documents to packed token sequences, one stage after the other, each written as Parquet and read again.

Documents in no known language go, one document of each group of near copies stays, sources are mixed to their weights (documents are repeated as often
as the mix takes them), and what is there is packed into sequences. Stages take any columns besides those of ``documents`` along; nulls, empty texts,
repeated rows and empty tables have the results that the operators define.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import jaccard, lang_id, mixing, packing
from palimpsest.llm.shared import new_folder, written

#: Documents of which a smaller share of n-grams belongs to the predicted language are in no known language.
LEAST_SHARE = 0.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known. The model is learned from those that have one, but for the fifth that is held out (null ids, too)."""
    model = lang_id.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return lang_id.in_known_language(docs, model, "text", LEAST_SHARE)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the one with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it doesn't take go. Quality weights come from ``labels``."""
    needed = ("doc_id", "source", "text")
    other = {f"other{i}": c for i, c in enumerate(docs.columns) if c not in needed}
    plain = docs.select(*needed, *[F.col(f"`{c}`").alias(n) for n, c in other.items()])
    taken = mixing.mix(plain, mixing.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))).where("copies > 0")
    names = {c: n for n, c in other.items()} | {c: c for c in needed}
    repeated = taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return repeated.select(*[F.col(names[c]).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack_pieces(written(digest, new_folder(spark, "packing"), "pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("jaccard_join", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Neither language models nor tokens can be expressed in SQL; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the result of the last one."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
