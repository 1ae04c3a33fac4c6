"""Packing token documents into sequences (method: Martello-Toth dominance reduction, then best fit on what remains).

Only how many pieces there are of each length matters to the solution, so the instance is a histogram of at most ``capacity`` numbers, whatever the
number of documents. It is solved on the driver: the reduction fixes one to three lengths at a time, as often as they occur, wherever they provably
dominate every other filling of a sequence that holds the longest of them; best fit in decreasing order packs the rest. The solution is a list of
patterns (lengths with their places, and how many sequences look like this), at most a few per length. Each piece then finds its place from its rank among
the pieces of its length, which Spark computes in bounded groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.bytescan import text_bytes
from palimpsest.llm.shared import tidied
from palimpsest.llm.tokens import encoder

#: Pieces of one length that are ranked together in a task.
RANKED_TOGETHER = 200_000


@dataclass
class Pattern:
    lengths: tuple[int, ...]
    times: int


def _most_at(counts: np.ndarray) -> np.ndarray:
    """For each value the largest length at most so large that still occurs (0: none)."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def _smallest(counts: np.ndarray, n: int) -> list[int]:
    """The ``n`` smallest pieces, repeats counted."""
    out: list[int] = []
    for x in np.flatnonzero(counts)[:n]:
        out += [int(x)] * int(min(n - len(out), counts[x]))
    return out[:n]


def _dominating(counts: np.ndarray, size: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths that share a sequence with a piece of ``size`` in some best solution, or None if that isn't known.

    ``counts`` are the other pieces. A filling dominates another if the pieces of the other can be dealt to its pieces, none exceeding its own.
    """
    room = capacity - size
    most = _most_at(counts)
    first = int(most[room])
    if first == 0:
        return ()
    three = _smallest(counts, 3)
    if first == room or len(three) < 2 or three[0] + three[1] > room:
        return (first,)
    if len(three) == 3 and sum(three) <= room:
        return None
    # At most two others fit. The best pair decides whether one piece alone is as good.
    lengths = np.flatnonzero(counts[:room + 1])
    second = most[room - lengths]
    same = (second == lengths) & (counts[lengths] < 2)
    if same.any():
        less = most[np.maximum(lengths - 1, 0)]
        second = np.where(same, less, second)
    pairs = np.where(second > 0, lengths + second, 0)
    best = int(pairs.max(initial=0))
    if first >= best:
        return (first,)
    partner = int(most[room - first])
    if partner == first and counts[first] < 2:
        partner = int(most[first - 1])
    # The smaller of any two that fit is at most half the room.
    if partner and partner >= int(most[room // 2]):
        return (first, partner)
    return None


def reduce_instance(counts: np.ndarray, capacity: int) -> tuple[list[Pattern], np.ndarray]:
    """Patterns that some best solution has, and the pieces that are left (Martello and Toth's reduction on counts)."""
    left, fixed = counts.copy(), []
    for size in range(capacity, 0, -1):
        while left[size]:
            left[size] -= 1
            others = _dominating(left, size, capacity)
            left[size] += 1
            if others is None:
                break
            lengths, need = (size, *others), {}
            for x in lengths:
                need[x] = need.get(x, 0) + 1
            # The reasons stay true while all of these lengths last and none of the others goes.
            times = int(min(left[x] // n for x, n in need.items()))
            for x, n in need.items():
                left[x] -= n * times
            fixed.append(Pattern(lengths, times))
    return fixed, left


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit in decreasing order on counts: equal sequences are kept as one pattern with a number."""
    by_room: dict[int, list[Pattern]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(p: Pattern, room: int) -> None:
        by_room.setdefault(room, []).append(p)
        rooms[room] = True

    for size in range(capacity, 0, -1):
        n = int(counts[size])
        while n:
            fitting = np.flatnonzero(rooms[size:])
            room = size + int(fitting[0]) if len(fitting) else capacity
            if len(fitting):
                p = by_room[room].pop()
                if not by_room[room]:
                    rooms[room] = False
            else:
                p = Pattern((), n)
            each = room // size
            full = min(p.times, n // each)
            if full:
                put(Pattern(p.lengths + (size,) * each, full), room - each * size)
                n -= full * each
            rest = p.times - full
            if rest and n and full < p.times:
                here = min(n, each)
                put(Pattern(p.lengths + (size,) * here, 1), room - here * size)
                n -= here
                rest -= 1
            if rest and p.lengths:
                put(Pattern(p.lengths, rest), room)
    return [p for row in by_room.values() for p in row]


def solve(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """A packing of ``counts[x]`` pieces of each length ``x``."""
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _places(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """For each length, runs of ranks with their pattern: key of length and first rank, how many in a sequence, first sequence, first offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for p in patterns:
        offset, i = 0, 0
        while i < len(p.lengths):
            x, j = p.lengths[i], i
            while j < len(p.lengths) and p.lengths[j] == x:
                j += 1
            rows.append((x, used.get(x, 0), j - i, sequence, offset))
            used[x] = used.get(x, 0) + (j - i) * p.times
            offset += x * (j - i)
            i = j
        sequence += p.times
    rows.sort()
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(5))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every text, add the end id, and cut what is longer than ``capacity``: doc_id, piece, start, length, ids (little-endian 32-bit), and columns to keep.

    A null text is empty. Repeated rows stay rows of their own. The last piece of a document may be shorter.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(c) for c in keep])
    kept = rows.select("doc_id", *keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["piece int", "start long", "length long", "ids binary"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                flat, count = enc.encode(*text_bytes(b.column("text")))
                flat = np.insert(flat, np.cumsum(count), end_id).astype("<u4")
                size = count + 1
                pieces = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                ends = np.cumsum(length) * 4
                ids = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(flat)])
                kept = [b.column(c).take(pa.array(row)) for c in ("doc_id", *keep)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), ids.cast(pa.binary())],
                    ["doc_id", *keep, "piece", "start", "length", "ids"])

    return rows.mapInArrow(tidied(cut), schema)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Give every piece a ``sequence_id`` and its ``offset`` there, using few sequences of at most ``capacity``.

    ``pieces`` should be cheap to read twice (a written table). Pieces of one length are exchangeable; ``order`` decides among them, and pieces equal in
    all of it get places in any order. Lengths must lie between 1 and ``capacity``. Columns ``sequence_id`` and ``offset`` of the input are replaced.
    """
    counts = np.zeros(capacity + 1, np.int64)
    # At most ``capacity`` rows reach the driver.
    for size, n in pieces.groupBy(length).count().collect():
        counts[size] = n
    if counts[0]:
        raise ValueError("a piece needs at least one token")
    places = _places(solve(counts, capacity))
    salts = int(counts.max() // RANKED_TOGETHER) + 1
    clean = [c for c in pieces.columns if c not in ("sequence_id", "offset", "_salt", "_rank", "_before")]
    salted = pieces.select(*clean, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int").alias("_salt"))
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy(length, "_salt").orderBy(*order)).cast("long") - 1)
    sizes = salted.groupBy(length, "_salt").count()
    before = W.partitionBy(length).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(length, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    if salts == 1:
        ranked = ranked.withColumn("_before", F.lit(0).cast("long"))
    else:
        ranked = ranked.join(bases, [length, "_salt"])
    of_length, first, each, sequence, offset = places
    width = int(counts.max()) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = of_length * width + first
        for b in batches:
            size = b.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("_rank").to_numpy(zero_copy_only=False) + b.column("_before").to_numpy(zero_copy_only=False)
            run = np.searchsorted(key, size * width + rank, side="right") - 1
            into = rank - first[run]
            columns = [b.column(c) for c in clean]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[run] + into // each[run]), pa.array(offset[run] + (into % each[run]) * size)],
                                             [*clean, "sequence_id", "offset"])

    kept = ranked.select(*clean).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["sequence_id long", "offset long"])
    return ranked.mapInArrow(tidied(place), schema)
