"""The operators of this subpackage as named queries over the given tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import (
    ann, audit_sql, byte_bpe, centroids, embed_dedup, filter_audit, jaccard, lang_id, licenses, lm_score, mixing, native_sql, packing, token_files, url_filter)
from palimpsest.llm.shared import new_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_masked_lm_score")
def op1_masked_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document."""
    return lm_score.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the four fifths that are not held out; a null doc_id is in neither part."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = lang_id.fit(docs.where(fold != 0))
    found = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), lang_id.predicted(model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from the memory-mapped files."""
    folder = new_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.map_documents(spark, folder, lambda ids: {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}, "ids_crc32 long")


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack_pieces(written(digest, new_folder(spark, "packing"), "pieces"))


@query("op5_nearest_neighbours")
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


@query("op6_jaccard_join", native_sql.jaccard_sql())
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@query("op7_license_scan", native_sql.licence_sql())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op8_mixing", native_sql.mixing_sql())
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes; quality weights come from ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, mixing.quality_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_embedding_near_dedup")
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of near copies and its component."""
    return embed_dedup.near_copies(table(spark, sf_dir, "embeddings"))


#: Host, path and verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query("op10_url_filter", native_sql.url_sql(URL_RULES))
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page. A page's outcome is bad if the labelled document that its URL numbers is poor or toxic."""
    labels = table(spark, sf_dir, "labels").where("doc_id is not null")
    poor = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcomes = labels.groupBy(F.col("doc_id").alias("_doc")).agg(F.max(poor).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(url_filter.split_url("url")[1], r"/([0-9]+)([.]html)?/?$", 1).try_cast("long")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge(pages.withColumn("_doc", number).join(outcomes, "_doc", "left"), rules, outcome="bad")
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op11_filter_audit", audit_sql.filters_sql())
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(ids, byte_bpe.token_bytes(spark, ranks)))


@query("op13_centroid_clusters", audit_sql.clusters_sql())
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after three rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))
