"""Byte-level BPE encoding and decoding (method: global distinct-word shuffle).

Texts are cut into pre-tokens. Those of a block of documents are exploded into distinct ones and their places in the block. Distinct pre-tokens are dealt by
hash to buckets; where they meet, each is encoded once, whatever the number of blocks that have it, and its ids go back to the blocks, where they are put in
their places. A pre-token is sent once from a block however often it occurs, so the commonest word of the corpus is sent as often as there are blocks. What a
block sends to a bucket is one row (of packed words, of packed ids on the way back): texts of very many different words would otherwise cost more bytes
for the rows than for the words. Decoding joins ids with the table of token bytes, which is as large as the vocabulary, so it goes to all tasks and is
joined in place.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType


#: Characters of text in a block; a longer document is a block of its own.
BLOCK = 1 << 22
#: Documents in a block, at most.
BLOCK_DOCS = 20_000
#: Bytes of text for each bucket of words: a worker holds the distinct words of one bucket at a time.
BUCKET_BYTES = 1 << 24
#: Ids that are turned into bytes at a time.
PART_IDS = 1 << 18

SENT = "block long, bucket int, check long, payload binary"
PLACED = "block long, check long, payload binary, buckets binary, doc_ids array<long>, ends array<long>"

# Letters, digits and white space among the first 256 characters.
_LETTERS, _DIGITS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f.read().splitlines())}


@functools.cache
def _library(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


@functools.cache
def _latin_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of the first 256 characters, with its classes spelled out; None if it has others than letters, digits and white space."""
    classes = {"\\p{L}": _LETTERS, "\\p{N}": _DIGITS, "\\s": _BLANKS}
    parts = re.split(r"(\[[^\]]*\])", pattern)
    for i, part in enumerate(parts):
        for name, members in classes.items():
            part = part.replace(name, members if i % 2 else f"[{members}]")
        parts[i] = part.replace("\\S", f"[^{_BLANKS}]") if not i % 2 else part
    plain = "".join(parts)
    known = plain.replace(_BLANKS, "")
    return None if "\\" in known or "(?i" in known else re.compile(plain)


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """What cuts a text into pre-tokens."""
    latin, every = _latin_pattern(pattern), _pattern(pattern).findall
    if latin is None:
        return every

    def cut(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return every(text)
        return latin.findall(text)

    return cut


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers from 0 up, compressed: their lowest bytes, then the next ones, as many as are needed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    """The numbers of :func:`squeeze`."""
    width, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((8, n), np.uint8)
    out[:width] = np.frombuffer(pa.decompress(data[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(out.T).view("<u8").reshape(-1).astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    """Byte strings, compressed: their sizes, then their bytes."""
    sizes, body = squeeze(np.fromiter(map(len, words), np.int64, len(words))), b"".join(words)
    return len(sizes).to_bytes(8, "little") + len(body).to_bytes(8, "little") + sizes + pa.compress(body, "zstd", asbytes=True)


def unpack_words(data: bytes) -> list[bytes]:
    """The byte strings of :func:`pack_words`."""
    n, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    body = pa.decompress(data[16 + n:], size, "zstd", asbytes=True)
    ends = np.cumsum(unsqueeze(data[16:16 + n])).tolist()
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


class Block:
    """Documents in a row: their distinct pre-tokens, frequent ones first, the bucket of each, and the places of all."""

    def __init__(self, docs: list[tuple[int | None, str | None]], cut: Callable[[str], list[str]], buckets: int):
        numbers: dict[str, int] = defaultdict(itertools.count().__next__)
        parts, total = [], 0
        self.ends, self.check = [], 0
        for _, text in docs:
            got = cut(text) if text else []
            parts.append(np.fromiter(map(numbers.__getitem__, got), np.int32, len(got)))
            total += len(got)
            self.ends.append(total)
            self.check = zlib.crc32((text or "").encode(), self.check)
        found = np.concatenate(parts)
        # Frequent words have small numbers, which take fewer bytes.
        order = np.argsort(-np.bincount(found, minlength=len(numbers)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.places = rank[found]
        words = list(numbers)
        self.words = [words[i].encode() for i in order.tolist()]
        self.home = np.fromiter(map(zlib.crc32, self.words), np.int64, len(words)) % buckets

    def sent(self, number: int) -> pa.RecordBatch:
        """What it sends to each bucket: packed words."""
        by_home = np.argsort(self.home, kind="stable")
        used, first = np.unique(self.home[by_home], return_index=True)
        rows = [pack_words([self.words[i] for i in own.tolist()]) for own in np.split(by_home, first[1:])] if len(used) else []
        n = len(used)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(used.astype(np.int32)), pa.array(np.full(n, self.check)), pa.array(rows, pa.binary())],
                                          names=["block", "bucket", "check", "payload"])

    def placed(self, number: int, docs: list[tuple[int | None, str | None]]) -> pa.RecordBatch:
        """Its documents with their ends, all places, and the bucket of each word."""
        return pa.RecordBatch.from_arrays([
            pa.array([number]), pa.array([self.check]), pa.array([squeeze(self.places)], pa.binary()), pa.array([squeeze(self.home)], pa.binary()),
            pa.array([[d for d, _ in docs]], pa.list_(pa.int64())), pa.array([self.ends], pa.list_(pa.int64()))],
            names=["block", "check", "payload", "buckets", "doc_ids", "ends"])


def explode_words(docs: DataFrame, pattern: str, buckets: int, places: bool) -> DataFrame:
    """Blocks of documents (doc_id, text): what each sends to the buckets, or with ``places`` what stays.

    Cutting is cheaper than keeping the places of all words until the ids are there, so ``docs`` is read once for either. It has to give the same rows in the
    same order both times, as a scan of a table does, also when a task runs again; that is checked block by block.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(pattern)
        numbers = itertools.count(TaskContext.get().partitionId() << 36)

        def made(held):
            block = Block(held, cut, buckets)
            return block.placed(next(numbers), held) if places else block.sent(next(numbers))

        held, size = [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                held.append((doc_id, text.as_py()))
                size += len(held[-1][1] or "")
                if size >= BLOCK or len(held) >= BLOCK_DOCS:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    return docs.mapInArrow(explode, PLACED if places else SENT)


def encode_words(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """What blocks sent (rows of block, bucket and packed words, those of a bucket one after the other) with ids in place of words.

    Each word of a bucket is encoded when it comes for the first time; what is held is the vocabulary of one bucket.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _library(path, pattern)._encode_single_piece
        bucket, known = None, {}
        for b in batches:
            out = []
            for own, payload in zip(b.column("bucket").to_pylist(), b.column("payload"), strict=True):
                if own != bucket:
                    bucket, known = own, {}
                ids = []
                for w in unpack_words(payload.as_py()):
                    if (got := known.get(w)) is None:
                        got = known[w] = one(w)
                    ids.append(got)
                sizes = squeeze(np.fromiter(map(len, ids), np.int64, len(ids)))
                flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64)
                out.append(len(sizes).to_bytes(8, "little") + sizes + squeeze(flat))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), b.column("check"), pa.array(out, pa.binary())],
                                             names=["of_block", "number", "of_check", "ids"])

    return words.mapInArrow(encode, "of_block long, number int, of_check long, ids binary")


def _reassembled(block: dict, answers: list[bytes]) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents of a block, all their ids, and where each document's begin (one more); ``answers`` are in order of buckets."""
    seq, home, ends = unsqueeze(block["payload"]), unsqueeze(block["buckets"]), np.array(block["ends"], np.int64)
    sizes, flats = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in answers:
        n = int.from_bytes(a[:8], "little")
        sizes.append(unsqueeze(a[8:8 + n]))
        flats.append(unsqueeze(a[8 + n:]))
    size, pool = np.concatenate(sizes), np.concatenate(flats).astype(np.int32)
    # Words came back bucket by bucket.
    by_home = np.argsort(home, kind="stable")
    begin = np.empty(len(home), np.int64)
    begin[by_home] = np.cumsum(size) - size
    n_ids = np.empty(len(home), np.int64)
    n_ids[by_home] = size
    at, out = np.concatenate([[0], np.cumsum(n_ids[seq])]), []
    for first in range(0, len(seq), 1 << 20):
        part = seq[first:first + (1 << 20)]
        per = n_ids[part]
        out.append(pool[np.repeat(begin[part] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))])
    return block["doc_ids"], np.concatenate(out) if out else pool[:0], at[np.concatenate([[0], ends])]


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every document, as the library encodes ordinary text.

    A null or empty text has no ids; its row stays. Repeated rows and null or equal doc_ids are documents of their own. An empty table gives no rows. Other
    columns are not read. A very long text is a block of its own and must fit one row, as it did in the source. ``docs`` is read twice and must give the same
    rows in the same order (see ``explode_words``), else the job stops.
    """
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size // BUCKET_BYTES) + 1
    words = explode_words(plain, pattern, buckets, places=False).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answers = encode_words(words, path, pattern)

    def gather(places: pa.Table, ids: pa.Table) -> pa.Table:
        block = places.to_pylist()[0]
        if any(c != block["check"] for c in ids["of_check"].to_pylist()):
            raise RuntimeError("documents came in another order when they were read again; write them first")
        keys, flat, at = _reassembled(block, ids.sort_by("number")["ids"].to_pylist())
        return pa.table({"doc_id": pa.array(keys, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))})

    left = explode_words(plain, pattern, buckets, places=True)
    return left.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(gather, "doc_id long, ids array<int>")


def token_bytes(spark: SparkSession, path: str) -> DataFrame:
    """id and bytes of every token: as many rows as the vocabulary."""
    return spark.createDataFrame([(i, bytearray(t)) for t, i in ranks(path).items()], "id int, token binary")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and the size of each value."""
    column = column.cast(pa.large_binary()).combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, np.uint8), np.diff(at)


def decode(encoded: DataFrame, tokens: DataFrame) -> DataFrame:
    """``encoded`` (with ids, an array of int) with the column ``decoded``: the bytes of its ids, one after the other.

    ``tokens`` (id, token) is sent to all tasks: it is bounded by the vocabulary. No ids give no bytes; null ids, or an id that ``tokens`` lacks, null.
    Other columns stay as they are, one named ``decoded`` is replaced.
    """
    spark = encoded.sparkSession
    rows = tokens.orderBy("id").toArrow()
    pool, size = _flat(rows["token"])
    table = np.full(max(rows["id"].to_pylist(), default=-1) + 2, -1)
    table[rows["id"].to_numpy()] = np.arange(len(size))
    sent = spark.sparkContext.broadcast((table, np.append(size, 0), np.append(np.cumsum(size) - size, 0), pool))
    encoded = encoded.drop("decoded")
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])
    names = encoded.columns

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size, begin, pool = sent.value

        def some(ids: np.ndarray) -> np.ndarray:
            per = size[ids]
            return pool[np.repeat(begin[ids] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))]

        def one(ids: pa.Array | None) -> bytes | None:
            if ids is None:
                return None
            ids = ids.fill_null(-1).to_numpy(zero_copy_only=False)
            out = []
            for first in range(0, len(ids), PART_IDS):
                part = ids[first:first + PART_IDS]
                known = table[np.where((part >= 0) & (part < len(table)), part, len(table) - 1)]
                if (known < 0).any():
                    return None
                out.append(some(known).tobytes())
            return b"".join(out)

        for b in batches:
            out = pa.array([one(x.values) for x in b.column(names.index("ids"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*names, "decoded"])

    return encoded.mapInArrow(join, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, number of ids, and digests of the ids in decimal and of the decoded bytes."""
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
