"""Words of many UTF-8 texts at once, as numpy arrays: boundaries, documents and 64-bit hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel works on at a time; a longer document is worked on alone.
SLICE_BYTES = 1 << 17

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LANES = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xDA942042E4DD58B5))
#: Byte ranges longer than this are hashed one by one by the standard library.
LONG = 4096


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column and where each begins (one more entry than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes each, at least one document each."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finalizer: bijective)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes wherever they stand; ``lane`` 0 or 1 gives one of two independent ones.

    Eight bytes at a time go through a finalizer that is not linear, so no pattern of repeats makes different ranges equal.
    """
    size = end - start
    h = mixed(size.astype(np.uint64) * _STEP + _LANES[lane])
    if not len(size):
        return h
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(8, np.uint8)]), 8)
    left = np.flatnonzero(size <= LONG)
    done = 0
    while len(left := left[size[left] > done]):
        block = windows[start[left] + done].view("<u8")[:, 0]
        rest = size[left] - done
        short = rest < 8
        block[short] &= (np.uint64(1) << (np.uint64(8) * rest[short].astype(np.uint64))) - np.uint64(1)
        h[left] = mixed((h[left] ^ block) + _LANES[lane])
        done += 8
    for i in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(buf[start[i]:end[i]].tobytes(), digest_size=16).digest()
        h[i] = np.frombuffer(digest, "<u8")[lane]
    return h


def document_starts(at: np.ndarray, n: int) -> np.ndarray:
    """True where a document begins, for each of ``n`` bytes."""
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    return first[:n]


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of bytes other than ASCII white space."""
    n = len(buf)
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, e
    solid = ~SPACE[buf]
    begins = document_starts(at, n)
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    before[begins] = False
    after = np.zeros(n, bool)
    after[:-1] = solid[1:] & ~begins[1:]
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1
