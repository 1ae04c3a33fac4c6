"""Labels cut by page breaks: joined again in the first two columns, in one pass over the cells."""

import pytest

from palimpsest.catalog import QUERIES, load_all
from palimpsest.operators import tables as tb
from test_exchanges import sf  # noqa: F401

load_all()


def test_labels_are_rejoined_without_counting_cells(spark, sf, monkeypatch):  # noqa: F811
    monkeypatch.setattr(tb, "chunk_for", lambda *a: pytest.fail("cells are built to be counted"))
    df = QUERIES["m6_rejoined_labels"](spark, sf)
    assert df.count() > 0 and df._jdf.queryExecution().optimizedPlan().toString().count("min_by(") == 1


def test_rejoined_labels_with_missing_values(spark):
    """Only the first two columns are joined; rows without a place stay alone and show nothing of their cell."""
    cells = spark.createDataFrame([(1, 0, 0, 1, 1, "a "), (1, 1, 0, 2, 1, " a"), (1, 3, 0, 1, 1, "b"), (1, 0, 2, 1, 1, "a"), (1, 1, 2, 1, 1, "a"),
                                   (1, 0, 1, 1, 1, None), (1, 1, 1, 1, 1, None), (1, 0, None, 1, 1, "n"), (2, None, 0, 1, 1, "lost")],
                                  "k int, anchor_row int, anchor_col int, row_span int, col_span int, text string")
    got = sorted(map(tuple, tb.rejoin_labels(cells, ["k"]).collect()), key=str)
    assert got == sorted([(1, 0, 0, 3, 1, "a "), (1, 3, 0, 1, 1, "b"), (1, 0, 2, 1, 1, "a"), (1, 1, 2, 1, 1, "a"), (1, 0, 1, 1, 1, None),
                          (1, 1, 1, 1, 1, None), (1, 0, None, 1, 1, "n"), (2, None, 0, 1, None, None)], key=str)
