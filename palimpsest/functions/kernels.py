"""The small Arrow kernels: everything per row that Spark has no built-in for."""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import runs

OPCODE = T.StructType(
    [T.StructField("tag", T.StringType())] + [T.StructField(c, T.IntegerType()) for c in ("i1", "i2", "j1", "j2")]
)


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def compose(text: Column) -> Column:
    """Unicode NFC.  Below U+0300 it is the identity, so such rows cross to Python only as nulls."""
    return F.coalesce(_nfc(F.when(text.rlike("[^\\x{0}-\\x{2ff}]"), text)), text)


@functools.lru_cache(maxsize=50_000)
def _remembered(a: str, b: str) -> float:
    """Ratios of short texts; column titles come back for table after table."""
    return _ratio(a, b)


def _ratio(a, b) -> float:
    return 2.0 * runs.matched(a, b) / (len(a) + len(b)) if len(a) + len(b) else 1.0


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2M/(|a|+|b|) over characters; null in, null out."""
    return pd.Series([None if x is None or y is None else _remembered(x, y) if len(x) + len(y) < 200 else _ratio(x, y)
                      for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.ArrayType(OPCODE))
def list_opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Opcodes that turn list ``a`` into list ``b``, longest common run first."""
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        out.append([dict(zip(("tag", "i1", "i2", "j1", "j2"), op)) for op in runs.opcodes(list(x), list(y))])
    return pd.Series(out)


EDGE = T.StructType([T.StructField("ki", T.IntegerType()), T.StructField("kj", T.IntegerType()),
                     T.StructField("sim", T.DoubleType())])


def _similarity(x, y, floor: float, letters_x: Counter, letters_y: Counter) -> float | None:
    """Similarity of two items of one kind, or None once an upper bound shows that it is below ``floor``."""
    same = x["ctx"] == y["ctx"]
    if x["kind"] == "table":
        # tables without cells are told apart by their signatures
        lone = x["rows"] is None or y["rows"] is None
        r = _ratio((x["sig"] or "").strip(), (y["sig"] or "").strip()) if lone else _ratio(list(x["rows"]), list(y["rows"]))
        return max(0.5, r) if same else min(1.0, r + 0.15)
    p, q = x["text"], y["text"]
    if x["kind"] == "shape" and (not p or not q):
        return 0.45 if same else (0.05 if p == q else 0.0)
    bonus = x["bonus"] if same else 0.0
    n = len(p) + len(q)
    if n and (2.0 * min(len(p), len(q)) / n + bonus < floor or 2.0 * sum((letters_x & letters_y).values()) / n + bonus < floor):
        return None
    return min(1.0, _ratio(p, q) + bonus)


@F.pandas_udf(T.ArrayType(EDGE))
def tile_edges(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similar pairs inside one bounded tile of a replace slice; only items of one kind come together.

    Items carry ``k`` (index in slice), ``kind``, ``text`` or ``rows``, ``ctx`` (heading path), ``bonus`` (for the
    same path) and ``cut`` (threshold at their own length; longer texts have lower ones, so the smaller counts).
    Length and letter bounds come before the exact ratio: matched characters can exceed neither.
    """
    out = []
    for left, right in zip(a, b):
        edges = []
        rights = [(y, Counter(y["text"] or "")) for y in right]
        for x in left:
            letters = Counter(x["text"] or "")
            for y, other in rights:
                cut = min(x["cut"], y["cut"])
                sim = _similarity(x, y, cut - 1e-9, letters, other)
                if sim is not None and sim >= cut:
                    edges.append({"ki": int(x["k"]), "kj": int(y["k"]), "sim": float(sim)})
        out.append(edges)
    return pd.Series(out)
