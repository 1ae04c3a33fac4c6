"""Structure operators against plain state machines, with plain windows and with chunks."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import structure as st
from palimpsest.operators import tables as tb
from palimpsest.operators.scan import PLAIN

NODE = "d int, ord int, uid string, type string, level int, text string"


def _outline(seed):
    rng = random.Random(seed)
    rows = []
    for d in range(6):
        for i in range(30):
            if rng.random() < 0.5:
                text = rng.choice(["", "One", "Two", "Revision  History", "目次", "Deep"])
                rows.append((d, i, f"n{i:03d}", "heading", rng.randint(1, 4), text))
            else:
                rows.append((d, i, f"n{i:03d}", "paragraph", None, f"text {i}"))
    return rows


def _machine(rows):
    """Skipped sections and heading paths, one row after the other."""
    out, stack, skip, doc = {}, [], None, None
    for d, i, _, kind, level, text in rows:
        if d != doc:
            stack, skip, doc = [], None, d
        if kind == "heading":
            if skip is not None and level <= skip:
                skip = None
            if skip is None and any(p in " ".join(text.lower().split()) for p in ("revision history", "目次")):
                skip = level
            if skip is not None:
                continue
            if text.strip():
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, text))
        elif skip is not None:
            continue
        out[d, i] = " > ".join(t for _, t in stack) or None
    return out


@pytest.mark.parametrize("chunk", [PLAIN, 4])
def test_skips_and_paths(spark, chunk):
    rows = _outline(7)
    n = st.drop_skipped_sections(spark.createDataFrame(rows, NODE), ["d"], chunk)
    got = {(r.d, r.ord): r.heading_ctx for r in st.heading_paths(n, ["d"], chunk).collect()}
    assert got == _machine(rows)


def test_deep_headings_keep_their_path(spark):
    rows = [(1, i, f"n{i}", "heading", i + 1, f"h{i + 1}") for i in range(12)] + [(1, 12, "a", "heading", 11, "again"), (1, 13, "b", "paragraph", None, "text")]
    got = [r.heading_ctx for r in st.heading_paths(spark.createDataFrame(rows, NODE), ["d"], PLAIN).orderBy("ord").collect()]
    assert got[11] == " > ".join(f"h{i + 1}" for i in range(12)) and got[13] == " > ".join([*(f"h{i + 1}" for i in range(10)), "again"])


@pytest.mark.parametrize("chunk", [PLAIN, 5])
def test_contents_fields(spark, chunk):
    rng = random.Random(3)
    rows, want = [], {}
    for d in range(5):
        depth, opened, last = 0, None, None
        for e in range(60):
            kind = rng.choice(["begin", "begin", "end", "end", "toc", None])
            if kind == "toc" and last != "begin":
                kind = None
            if kind == "begin":
                depth += 1
            elif kind == "end":
                depth = max(0, depth - 1)
                if opened is not None and depth < opened:
                    opened = None
            elif kind == "toc":
                opened = depth
            last = kind
            rows.append((d, e // 3, e, kind))
            want[d, e // 3] = opened is not None
    ev = spark.createDataFrame(rows, "d int, pos int, seq int, kind string")
    got = {(r.d, r.pos): r.in_toc for r in st.contents_field_rows(ev, ["d"], chunk).collect()}
    assert got == want


def test_contents_lines_need_four_in_a_row(spark):
    texts = ["Intro", "a .... 1", "b .... 2", "c .... 3", "Body", "d .... 4", "e .... 5", "f .... 6", "g … ... 7", "End"]
    b = spark.createDataFrame([(1, i, f"u{i}", "paragraph", None, t) for i, t in enumerate(texts)], NODE)
    kept = {r.ord for r in st.drop_contents_runs(b, ["d"]).collect()}
    assert kept == {0, 1, 2, 3, 4, 9}


def test_orphan_continuation_cell_keeps_columns(spark):
    cells = spark.createDataFrame(
        [(1, 0, 0, 1, "continue", "x"), (1, 0, 1, 2, None, "y"), (1, 0, 2, 1, "restart", "z"), (1, 1, 0, 3, None, "w"),
         (1, 1, 1, 1, "continue", "")], "t int, row int, cell_no int, col_span int, vmerge string, text string")
    got = {(r.anchor_row, r.anchor_col, r.row_span, r.col_span, r.text) for r in tb.resolve_grid(cells, ["t"]).collect()}
    assert got == {(0, 1, 1, 2, "y"), (0, 3, 2, 1, "z"), (1, 0, 1, 3, "w")}


def test_two_row_header_is_skipped_once(spark):
    def table(uid, rows):
        return [(1, "A", uid, r, c, 1, 1, t) for r, line in enumerate(rows) for c, t in enumerate(line)]

    head = [["Item", "Note"], ["", ""], ["sub", "sub"]]
    rows = table("t0", head[:1] + head[2:] + [["a", "1"], ["continued on next page", ""]]) + table("t1", head[:1] + head[2:] + [["b", "2"]])
    cells = spark.createDataFrame(rows, "pair_id int, side string, table_uid string, anchor_row int, anchor_col int, row_span int, col_span int, text string")
    by = ["pair_id", "side"]
    blocks = spark.createDataFrame([(1, "A", 0, "table", "t0"), (1, "A", 1, "table", "t1")], "pair_id int, side string, idx int, type string, table_uid string")
    groups = tb.merge_groups(blocks, tb.header_keys(cells, [*by, "table_uid"]), by)
    m = tb.merge_runs(cells, groups, by)
    got = sorted((r.anchor_row, r.anchor_col, r.text) for r in m.collect())
    assert got == [(0, 0, "Item"), (0, 1, "Note"), (1, 0, "sub"), (1, 1, "sub"), (2, 0, "a"), (2, 1, "1"), (3, 0, "b"), (3, 1, "2")]


def test_page_defaults(spark):
    d = spark.createDataFrame([(None, None, None), (3, None, None), (3, 4, 2)], "p int, s int, e int")
    cols = st.page_fields(F.col("p"), F.col("s"), F.col("e"))
    got = [tuple(r) for r in d.select(*[c.alias(n) for n, c in cols.items()]).collect()]
    assert got == [(1, 1, 1), (3, 3, 3), (3, 4, 4)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_marks_are_looked_up_in_a_text_computed_once(spark):
    df = spark.createDataFrame([("Continued  on next page",), ("Continue",), ("",), (None,)], "text string")
    got = df.select(st.is_continuation(F.col("text")).alias("x"))
    assert [r["x"] for r in got.collect()] == [True, False, False, False]
    assert "regexp_replace" not in _plan(got).split("lambdafunction", 1)[1]


def test_contents_runs_need_one_pass_over_plain_documents(spark):
    """The same rows with and without chunks, repeated rows and null keys included, and no join by runs for plain documents."""
    lines = ["Chapter ..... 1", "Chapter ..... 2", "Chapter ..... 3", "Chapter ..... 4", "text", "Part ..... 9", "Part ..... 9"]
    rows = [(d, i, f"n{i % 6}", kind, None, t) for d in (0, 1, None) for i, t in enumerate(lines) for kind in ("paragraph",)]
    rows += [(0, 4, "n4", "paragraph", None, "text"), (1, 8, "n8", None, None, "Chapter ..... 5")]
    df = spark.createDataFrame(rows, NODE)
    plain, chunked = (st.drop_contents_runs(df, ["d"], chunk=c) for c in (PLAIN, 2))
    assert sorted(map(str, plain.collect())) == sorted(map(str, chunked.collect()))
    assert [r["n"] for r in plain.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()] == [7, 4, 4]
    assert "Join" not in _plan(plain)


def test_blank_texts_are_those_whose_signature_form_is_empty(spark):
    from palimpsest.functions.text import has_text, norm_for_signature
    odd = [chr(i) for i in range(0x3100)] + [None, "", " ​\n", ", ", "( )", "﻿", "­　"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert df.filter(has_text(F.col("t")) != (norm_for_signature(F.col("t")) != "")).count() == 0
