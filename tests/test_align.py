"""Alignment against the standard library, for the gathered path and for the distributed one."""

import difflib
import random

import pytest

from palimpsest.operators.align import opcodes


def _groups(n, seed):
    rng = random.Random(seed)
    out = []
    for g in range(n):
        alphabet = "abcdefgh"[: rng.randint(1, 8)]
        a = [rng.choice(alphabet) for _ in range(rng.randint(0, 14))]
        b = [rng.choice(alphabet) for _ in range(rng.randint(0, 14))]
        if g % 3 == 0:  # an edited copy
            a = [f"{c}{i}" for i, c in enumerate(a + a)]
            b = [c for i, c in enumerate(a) if i % 5 != 2]
            if g % 2:
                b = b[4:] + b[:4]
        out.append((a, b))
    return out


@pytest.mark.parametrize("max_items,max_matches", [(10_000, 1_000_000), (5, 4)])
def test_opcodes_equal_stdlib(spark, max_items, max_matches):
    groups = _groups(60, seed=3)
    rows = [(g, s, i, k) for g, (a, b) in enumerate(groups) for s, seq in (("A", a), ("B", b))
            for i, k in enumerate(seq)]
    items = spark.createDataFrame(rows, "g int, side string, idx int, key string")
    got = {}
    for r in opcodes(items, ["g"], max_items, max_matches).collect():
        got.setdefault(r.g, []).append((r.tag, r.i1, r.i2, r.j1, r.j2))
    for g, (a, b) in enumerate(groups):
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        assert sorted(got.get(g, []), key=lambda o: (o[1], o[3])) == want, (a, b)
