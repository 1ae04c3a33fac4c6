"""Longest common runs of two sequences in numpy: for texts and lists that are too long for a quadratic walk.

Equal substrings of length 1, 2, 4, ... get equal numbers, once for both sequences (one sort per length).  The longest common run of an interval is then found from
the greatest power of two that both sides of it share, which leaves few places, and extended bit by bit.  That costs time in proportion to the interval, whatever
the number of equal pairs.  Small intervals are searched as strings, whose ``in`` and ``find`` pass over many places at once; lists become strings with one
character per distinct element.  Both ways give the runs of the standard library.
"""

from __future__ import annotations

import itertools

import numpy as np

#: Intervals with fewer pairs of places are searched as strings.
SMALL = 2_000_000
#: Runs from which on their last half is looked up first.
HALVED = 8


def codes(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers for the elements of two texts or lists, equal for equal elements."""
    if isinstance(a, str):
        return tuple(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for x in (a, b))
    seen: dict = {}
    return tuple(np.fromiter((seen.setdefault(x, len(seen)) for x in s), np.int64, len(s)) for s in (a, b))


def as_text(a, b) -> tuple[str, str]:
    """Two lists as texts with equal characters for equal elements."""
    if isinstance(a, str):
        return a, b
    letter = {e: chr(i) for i, e in enumerate(dict.fromkeys(itertools.chain(a, b)))}
    return "".join(map(letter.__getitem__, a)), "".join(map(letter.__getitem__, b))


def _length(a: str, i: int, b: str, j: int, known: int) -> int:
    """How far two texts agree from ``i`` and ``j`` on; they do for ``known`` characters."""
    end = min(len(a) - i, len(b) - j)
    if a[i + known:i + end] == b[j + known:j + end]:
        return end
    step = 8
    while known + step < end and a[i + known:i + known + step] == b[j + known:j + known + step]:
        known, step = known + step, step * 2
    end = min(end, known + step)
    while known < end - 1:
        middle = (known + end) // 2
        if a[i + known:i + middle] == b[j + known:j + middle]:
            known = middle
        else:
            end = middle
    return known


def _longest(a: str, b: str, top: int) -> tuple[int, int, int]:
    """Start on both sides and length of the longest common run, the first one of ``a``, then of ``b``; it is known to be no longer than ``top``."""
    top = min(top, len(a), len(b))
    i = best = at = there = 0
    while best < top and i + best < len(a):
        if best >= HALVED:
            # a longer run from here, or from anywhere up to this half, holds it whole
            half = i + best + 1 - best // 2
            if a[half:i + best + 1] not in b:
                i = half + 1
                continue
        j = b.find(a[i:i + best + 1])
        while j >= 0:
            best, at, there = _length(a, i, b, j, best + 1), i, j
            if best >= top or i + best >= len(a):
                break
            j = b.find(a[i:i + best + 1], j + 1)
        i += 1
    return at, there, best


def text_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """All common runs of two texts, longest first inside every interval, in no order."""
    found, todo = [], [(0, len(a), 0, len(b), len(a))]
    while todo:
        alo, ahi, blo, bhi, top = todo.pop()
        i, j, n = _longest(a[alo:ahi], b[blo:bhi], top)
        if n:
            i, j = i + alo, j + blo
            found.append((i, j, n))
            todo += [(alo, i, blo, j, n), (i + n, ahi, j + n, bhi, n)]
    return found


class Runs:
    """Numbers of the substrings of length 2**k of two sequences, for every k that has common ones."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        x, y = codes(a, b)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while len(x) and len(y):
            both = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
            x, y = both[:len(x)], both[len(x):]
            if not self._common(x, y, int(both.max()) + 1):
                break
            self.levels.append((x.astype(np.int32), y.astype(np.int32)))
            step, size = 1 << (len(self.levels) - 1), int(both.max()) + 1
            x, y = (s[:len(s) - step] * size + s[step:] if len(s) > step else s[:0] for s in (x, y))
        self.mark = np.zeros(max((int(max(x.max(), y.max())) + 1 for x, y in self.levels), default=0), bool)

    @staticmethod
    def _common(x: np.ndarray, y: np.ndarray, size: int) -> bool:
        mark = np.zeros(size, bool)
        mark[y] = True
        return bool(mark[x].any())

    def longest(self, alo: int, ahi: int, blo: int, bhi: int, top: int) -> tuple[int, int, int, int]:
        """Start on both sides and length of the longest common run, the first one of the first sequence, then of the second; and its power of two."""
        for k in range(min(top, min(ahi - alo, bhi - blo).bit_length() - 1), -1, -1):
            n = 1 << k
            x, y = self.levels[k][0][alo:ahi - n + 1], self.levels[k][1][blo:bhi - n + 1]
            self.mark[y] = True
            hit = np.flatnonzero(self.mark[x])
            self.mark[y] = False
            if len(hit):
                break
        else:
            return alo, blo, 0, -1
        self.mark[x[hit]] = True
        there = np.flatnonzero(self.mark[y])
        self.mark[x[hit]] = False
        p, q, who_p, who_q = hit + alo, there + blo, x[hit].astype(np.int64), y[there].astype(np.int64)
        for j in range(k - 1, -1, -1):
            step = 1 << j
            fits_p, fits_q = np.flatnonzero(p + n + step <= ahi), np.flatnonzero(q + n + step <= bhi)
            if not len(fits_p) or not len(fits_q):
                continue
            size = len(self.a) + len(self.b) + 1
            longer_p = who_p[fits_p] * size + self.levels[j][0][p[fits_p] + n]
            longer_q = who_q[fits_q] * size + self.levels[j][1][q[fits_q] + n]
            common = np.intersect1d(longer_p, longer_q)
            if len(common):
                keep_p, keep_q = np.isin(longer_p, common), np.isin(longer_q, common)
                p, q = p[fits_p[keep_p]], q[fits_q[keep_q]]
                who_p, who_q = np.searchsorted(common, longer_p[keep_p]), np.searchsorted(common, longer_q[keep_q])
                n += step
        return int(p[0]), int(q[who_q == who_p[0]][0]), n, k

    def blocks(self) -> list[tuple[int, int, int]]:
        """All common runs, longest first inside every interval, in order of place."""
        found, todo = [], [(0, len(self.a), 0, len(self.b), len(self.levels) - 1)]
        while todo:
            alo, ahi, blo, bhi, top = todo.pop()
            if alo >= ahi or blo >= bhi or top < 0:
                continue
            if (ahi - alo) * (bhi - blo) <= SMALL:
                found += [(alo + i, blo + j, n) for i, j, n in text_blocks(*as_text(self.a[alo:ahi], self.b[blo:bhi]))]
                continue
            i, j, n, k = self.longest(alo, ahi, blo, bhi, top)
            if n:
                found.append((i, j, n))
                todo += [(alo, i, blo, j, k), (i + n, ahi, j + n, bhi, k)]
        return sorted(found)


def common_runs(a, b) -> list[tuple[int, int, int]]:
    """The common runs of two sequences in order of place."""
    if not len(a) or not len(b):
        return []
    return Runs(a, b).blocks() if len(a) * len(b) > SMALL else sorted(text_blocks(*as_text(a, b)))


def matched(a, b) -> int:
    """How many elements of two sequences lie in common runs."""
    return sum(n for _, _, n in common_runs(a, b))


def opcodes(a, b) -> list[tuple[str, int, int, int, int]]:
    """What turns ``a`` into ``b``: equal runs that follow each other without a gap are one."""
    out, i, j = [], 0, 0
    for ai, bj, n in [*common_runs(a, b), (len(a), len(b), 0)]:
        tag = "replace" if i < ai and j < bj else "delete" if i < ai else "insert" if j < bj else ""
        if tag:
            out.append((tag, i, ai, j, bj))
        if n:
            if out and out[-1][0] == "equal" and out[-1][2] == ai and out[-1][4] == bj:
                out[-1] = ("equal", out[-1][1], ai + n, out[-1][3], bj + n)
            else:
                out.append(("equal", ai, ai + n, bj, bj + n))
        i, j = ai + n, bj + n
    return out
