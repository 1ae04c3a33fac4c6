"""Replace slices, greedy picks and word spans against brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import matching as m
from palimpsest.operators import wording as w
from palimpsest.session import cut_lineage


def test_rounds_equal_fold(spark):
    rng = random.Random(11)
    rows = [(g, i, j, rng.randint(0, 4)) for g in range(5) for i in range(8) for j in range(8) if rng.random() < 0.5]
    edges = spark.createDataFrame(rows, "g int, ki int, kj int, r int")
    fold = {tuple(x) for x in m.greedy_picks(edges, ["g"], ["r"]).collect()}
    rounds = {tuple(x) for x in m.greedy_picks(edges, ["g"], ["r"], max_edges=0).collect()}
    want = set()
    for g in range(5):
        a, b = set(), set()
        for _, i, j in sorted((r, i, j) for gg, i, j, r in rows if gg == g):
            if i not in a and j not in b:
                a.add(i), b.add(j), want.add((g, i, j))
    assert fold == want and rounds == want


def test_served_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(m, "SERVED", 16)
    rng = random.Random(5)
    rows = [(g, i, j, i // 2, rng.randint(0, 9)) for g in range(2) for i in range(70) for j in range(70)]
    edges = spark.createDataFrame(rows, "g int, ki int, kj int, at int, r int")
    got = {tuple(x) for x in m.greedy_picks(edges, ["g"], ["at", "ki", "r"], max_edges=100, served=["at", "ki"]).collect()}
    want = set()
    for g in range(2):
        used = set()
        for i in range(70):
            free = sorted((r, j) for gg, ii, j, _, r in rows if (gg, ii) == (g, i) and j not in used)
            used.add(free[0][1])
            want.add((g, i, free[0][1]))
    assert got == want


def _slices(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    out = []
    for _ in range(8):
        def item():
            kind = rng.choice(["paragraph", "heading"])
            return kind, " ".join(rng.choice(words) for _ in range(rng.randint(2, 6))), rng.choice(["X", "Y"])
        out.append(([item() for _ in range(rng.randint(1, 6))], [item() for _ in range(rng.randint(1, 6))]))
    return out


def _brute(a, b, i1, j1):
    """Opcodes of one slice: threshold, global greedy, then anchors."""
    cut = {"paragraph": 0.65, "heading": 0.72}
    cand = []
    for i, (ka, ta, ca) in enumerate(a):
        for j, (kb, tb_, cb) in enumerate(b):
            if ka == kb:
                s = min(1.0, difflib.SequenceMatcher(None, ta, tb_, autojunk=False).ratio() + (0.08 if ca == cb else 0))
                if s >= cut[ka]:
                    cand.append((-s, abs(i - j), i, j))
    pairs, ua, ub = [], set(), set()
    for _, _, i, j in sorted(cand):
        if i not in ua and j not in ub:
            ua.add(i), ub.add(j), pairs.append((i, j))
    i2, j2 = i1 + len(a), j1 + len(b)
    one = len(a) == len(b) == 1
    ops = [("replace", i1 + i, i1 + i + 1, j1 + j, j1 + j + 1) for i, j in pairs]
    for i in set(range(len(a))) - ua:
        at = j1 if one else j2
        ops.append(("delete", i1 + i, i1 + i + 1, at, at))
    for j in set(range(len(b))) - ub:
        later = sorted((q, p) for p, q in pairs if q > j)
        before = sorted((q, p) for p, q in pairs if q < j)
        at = i1 + later[0][1] if later else i1 + before[-1][1] + 1 if before else i2
        ops.append(("insert", at, at, j1 + j, j1 + j + 1))
    return sorted(ops)


@pytest.mark.parametrize("tile", [256, 2])
def test_slices_equal_brute_force(spark, tile):
    rows, ops, want = [], [], {}
    for g, (a, b) in enumerate(_slices(5)):
        i1, j1 = 3, 5
        rows += [(g, "A", i1 + i, *x) for i, x in enumerate(a)] + [(g, "B", j1 + j, *x) for j, x in enumerate(b)]
        ops.append((g, "replace", i1, i1 + len(a), j1, j1 + len(b)))
        want[g] = _brute(a, b, i1, j1)
    blocks = spark.createDataFrame(rows, "g int, side string, idx int, type string, norm string, heading_ctx string")
    o = spark.createDataFrame(ops, "g int, tag string, i1 int, i2 int, j1 int, j2 int")
    got = {}
    for r in m.refine(o, blocks, ["g"], tile).collect():
        got.setdefault(r.g, []).append((r.tag, r.i1, r.i2, r.j1, r.j2))
    assert {g: sorted(x) for g, x in got.items()} == want


def test_word_spans_rebuild_both_sides(spark):
    rng = random.Random(2)
    words = ["a", "b,", "c;", "(d", "e)", "f"]
    rows = []
    for i in range(60):
        x = [rng.choice(words) for _ in range(rng.randint(0, 8))]
        y = [t for t in x if rng.random() > 0.3] + [rng.choice(words)]
        rows.append((i, " ".join(x), " ".join(y)))
    d = spark.createDataFrame(rows, "id int, x string, y string")
    norm = d.select("id", *[F.split(w.norm_for_diff(F.col(c)), " ").alias(c) for c in "xy"])
    toks = {r.id: ([t for t in r.x if t], [t for t in r.y if t]) for r in norm.collect()}
    for r in w.word_spans(d, "x", "y", "x", "y").collect():
        a, b = toks[r.id]
        if a == b:
            assert [s.type for s in r.spans] == ([] if not a else ["equal"])
            continue
        ops = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        assert [s.type for s in r.spans] == [o[0] for o in ops]
        for s, (_, i1, i2, j1, j2) in zip(r.spans, ops):
            assert s.old_text.replace(" ", "") == "".join(a[i1:i2])
            assert s.new_text.replace(" ", "") == "".join(b[j1:j2])


def test_lines_are_aligned_before_words(spark):
    d = spark.createDataFrame([(1, "one\ntwo words\nthree\nfour", "one\ntwo other words\nfour\nfive")], "id int, x string, y string")
    s = w.text_diff(d, ["id"], "x", "y", "x", "y").collect()[0].spans
    assert [x.type for x in s] == ["equal", "newline", "equal", "insert", "equal", "newline", "delete", "newline", "equal", "newline", "insert"]


def test_rescue_is_in_order_and_keeps_other_blocks(spark):
    """The first delete takes the better insert; further blocks of its run stay deleted."""
    ident = "struct<heading_ctx:string,cols:int,rows:int,row_texts:array<string>,tokens:array<string>,idx:int>"
    rows = [("A", 0, ["r1", "r2"]), ("A", 3, ["r1", "r2"]), ("B", 1, ["r1", "zz"]), ("B", 2, ["r1", "r2"])]
    idents = spark.createDataFrame([(1, s, i, ("", 2, 2, t, t, i)) for s, i, t in rows], f"g int, side string, idx int, ident {ident}")
    blocks = spark.createDataFrame([(1, s, i, "table") for s, i, _ in rows] + [(1, "A", 1, "paragraph")], "g int, side string, idx int, type string")
    ops = spark.createDataFrame([(1, "delete", 0, 2, 0, 0, 0), (1, "delete", 3, 4, 3, 3, 0), (1, "insert", 3, 3, 1, 2, 0), (1, "insert", 4, 4, 2, 3, 0)],
                                "g int, tag string, i1 int, i2 int, j1 int, j2 int, phase int")
    totals = spark.createDataFrame([(1, 8)], "g int, total_blocks int")
    got = {(r.tag, r.i1, r.i2, r.j1, r.j2) for r in m.rescue_tables(cut_lineage(ops), blocks, idents, totals, ["g"], tile=2).collect()}
    assert got == {("replace", 0, 1, 2, 3), ("replace", 3, 4, 1, 2), ("delete", 1, 2, 0, 0)}
