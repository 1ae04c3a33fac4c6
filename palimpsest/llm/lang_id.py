"""Language identification (method: language-bitmask n-gram filters).

A model is one bit-sliced Bloom filter: row ``r`` of a table holds one bit per language. An n-gram sets its language's bit in a few rows; the bitwise
and of these rows is the set of all languages that may hold the n-gram, in one lookup for all languages. Per language, the n-grams of a text that it
holds are counted, the count is corrected for the false positives expected from how full the language's slice is, and the largest count decides.

N-grams are runs of letters of ``N`` bytes, lower-cased in ASCII; everything between letters counts as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.bytescan import LOWER, document_starts, mixed, slices, text_bytes
from palimpsest.llm.shared import release, tidied

#: Bytes of an n-gram.
N = 5
#: Rows of the filter that an n-gram sets.
ROWS = 3
#: Bits per n-gram of the fullest language.
BITS = 12
#: Training documents of a language, about (a bounded sample, taken by a hash of the text).
TRAIN_DOCS = 3000
#: N-grams that a language keeps, the most frequent first.
MAX_GRAMS = 100_000
#: An n-gram belongs to a language if its share there is at least this part of its largest share in any language.
RELATIVE = 0.25
#: It must have been seen so often.
MIN_SEEN = 2
#: Undetermined: no letter.
UNDETERMINED = "und"

_FOLD = np.full(256, ord(" "), np.uint8)
for _b in range(256):
    if chr(LOWER[_b]).islower() and LOWER[_b] < 128 or _b >= 128:
        _FOLD[_b] = LOWER[_b]


@dataclass
class Model:
    languages: list[str]
    #: Rows by groups of 64 languages.
    table: np.ndarray
    #: Per language, the chance that an n-gram it doesn't hold seems to be there.
    false_rate: np.ndarray
    #: The language of texts without any known n-gram: the one with most training documents.
    fallback: int


def grams(buf: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of all documents and the document of each. A document counts as set between blanks."""
    folded = _FOLD[buf]
    # One blank before each document and after the last; runs of blanks become one.
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    put = at[:-1]
    folded = np.insert(folded, put, ord(" "))
    doc = np.insert(doc, put, np.arange(len(at) - 1))
    blank = folded == ord(" ")
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | (doc[1:] != doc[:-1])
    folded, doc = np.append(folded[keep], np.full(n, ord(" "), np.uint8)), np.append(doc[keep], np.full(n, -1))
    m = len(folded) - n
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key = np.zeros(m, np.uint64)
    for i in range(n):
        key = (key << np.uint64(8)) | folded[i:i + m]
    # A window may reach into the next document's blank, which stands for its own end, but not beyond.
    whole = (doc[:m] >= 0) & ((doc[n - 2:n - 2 + m] == doc[:m]))
    reach = doc[n - 1:n - 1 + m] != doc[:m]
    key[reach] = (key[reach] >> np.uint64(8) << np.uint64(8)) | np.uint64(ord(" "))
    # Short documents: their letters alone, filled up with blanks.
    short = np.flatnonzero((doc[:m] != np.concatenate([[-1], doc[:m - 1]])) & ~whole)
    for i in short:
        own = folded[i:i + n].copy()
        own[doc[i:i + n] != doc[i]] = ord(" ")
        key[i] = int.from_bytes(own.tobytes(), "big")
    whole[short] = True
    whole &= key != np.uint64(int.from_bytes(b" " * n, "big"))
    return key[whole], doc[:m][whole]


def _rows(key: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Rows of the filter that belong to the n-grams (double hashing)."""
    h = mixed(key)
    step = (h >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64(size - 1)
    for i in range(ROWS):
        yield ((h + np.uint64(i) * step) & mask).astype(np.int64)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", per_language: int = TRAIN_DOCS) -> Model:
    """Learn which n-grams each language holds from ``docs`` with a non-null language and text.

    Reads languages and hashes of all texts to set each language's sampling rate, so that about ``per_language`` documents of each take part.
    The driver receives at most ``MAX_GRAMS`` n-grams of each language. Without any training document the model has no language.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    known = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(known)
    if not languages:
        return Model([], np.zeros((1, 1), np.uint64), np.zeros(0), 0)
    rate = {k: min(1.0, per_language / known[k]) for k in languages}
    rates = F.create_map(*[F.lit(x) for k in languages for x in (k, int(rate[k] * 2**31))])
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(2**31)) < F.element_at(rates, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, at = text_bytes(b.column("text"))
            names = np.array(b.column("lang").to_pylist(), object)
            for first, last in slices(at):
                key, doc = grams(buf[at[first]:at[last]], at[first:last + 1] - at[first])
                for name in set(names[first:last]):
                    own, n = np.unique(key[(names[first:last] == name)[doc]], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(own), pa.string()), "gram": own.astype(np.int64), "n": n})

    seen = sample.mapInArrow(tidied(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_SEEN)
    total = F.create_map(*[F.lit(x) for k in languages for x in (k, float(rate[k] * known[k]))])
    # One row per n-gram holds its count in every language; share is per training document.
    shares = seen.groupBy("gram").agg(F.collect_list(F.struct((F.col("n") / F.element_at(total, F.col("lang"))).alias("share"), "lang", "n")).alias("of"))
    kept = shares.select("gram", F.explode(F.filter("of", lambda x: x["share"] >= RELATIVE * F.array_max(F.transform("of", lambda y: y["share"])))).alias("x"))
    kept = kept.select("gram", "x.lang", "x.n")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = kept.withColumn("place", place).where(F.col("place") <= MAX_GRAMS).select("lang", "gram").toPandas()
    members = [best["gram"][best["lang"] == name].to_numpy(np.int64).astype(np.uint64) for name in languages]
    return build(languages, members, max(range(len(languages)), key=lambda i: (known[languages[i]], -i)))


def build(languages: list[str], members: list[np.ndarray], fallback: int) -> Model:
    """The bit-sliced filter of the languages' n-grams."""
    size = 1 << max(10, int(np.ceil(np.log2(BITS * max([1, *map(len, members)])))))
    table = np.zeros((-(-len(languages) // 64), size), np.uint64)
    for i, own in enumerate(members):
        for row in _rows(own, size):
            table[i // 64, row] |= np.uint64(1 << (i % 64))
    held = np.array([np.count_nonzero(table[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))])
    narrow = table.astype(np.uint8) if len(languages) <= 8 else table
    return Model(languages, narrow, (held / size) ** ROWS, fallback)


def predict_bytes(model: Model, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language of each document (-1: no letter) and the corrected share of its n-grams that the language holds."""
    best, score = np.full(len(at) - 1, -1), np.zeros(len(at) - 1)
    if not model.languages:
        return best, score
    for first, last in slices(at, 1 << 19):
        own, off = buf[at[first]:at[last]], at[first:last + 1] - at[first]
        key, doc = grams(own, off)
        held = None
        for row in _rows(key, model.table.shape[1]):
            got = model.table[:, row]
            held = got if held is None else held & got
        n = np.bincount(doc, minlength=last - first).astype(float)
        estimates = np.zeros((len(model.languages), last - first))
        for i, false in enumerate(model.false_rate):
            hits = np.bincount(doc[(held[i // 64] >> held.dtype.type(i % 64) & held.dtype.type(1)).astype(bool)], minlength=last - first)
            estimates[i] = np.clip((hits - n * false) / (1 - false) if false < 1 else 0.0, 0, None)
        top = np.argmax(estimates, axis=0)
        value = estimates[top, np.arange(last - first)]
        best[first:last] = np.where(value > 0, top, model.fallback)
        score[first:last] = np.clip(value / np.maximum(n, 1), 0, 1)
        letters = np.concatenate([[0], np.cumsum((_FOLD[own] != ord(" ")) & (own < 128))])
        for d in np.flatnonzero(letters[off[1:]] == letters[off[:-1]]):
            if not any(c.isalpha() for c in own[off[d]:off[d + 1]].tobytes().decode("utf-8", "replace")):
                best[first + d], score[first + d] = -1, 0.0
    return best, score


def predicted(model: Model, text: str | Column = "text") -> Column:
    """A column (lang_pred, score) of each text. A null text or one without a letter is ``und`` with score 0.

    A text with letters of which no n-gram is known gets the most frequent training language with score 0.
    """
    names = np.array([*model.languages, UNDETERMINED], object)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        best, score = predict_bytes(model, *text_bytes(pa.array(texts, pa.string(), from_pandas=True)))
        release()
        return pd.DataFrame({"lang_pred": names[best], "score": score})

    return of(F.col(text) if isinstance(text, str) else text)


def accepted(model: Model, text: str | Column = "text", least: float = 0.0) -> Column:
    """Whether a text is in a known language: it has a letter, and at least ``least`` of its n-grams belong to the language predicted."""

    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        best, score = predict_bytes(model, *text_bytes(pa.array(texts, pa.string(), from_pandas=True)))
        return pd.Series((best >= 0) & (score >= least))

    return of(F.col(text) if isinstance(text, str) else text)


def in_known_language(docs: DataFrame, model: Model, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text is accepted, in Arrow batches.

    A null text goes; rows, repeated ones too, and all other columns stay as they are.
    """
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score = predict_bytes(model, *text_bytes(b.column(place)))
            yield b.filter(pa.array((best >= 0) & (score >= least)))

    return docs.mapInArrow(tidied(keep), docs.schema)
