"""A cross-section of the named queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, rows_of

SF = "/root/testdata/sf0.001"
PICKED = ["t3_norm_for_signature", "t13_counter_rendering", "g1_heading_signature", "g7_cell_signature", "f1_skip_sections", "w1_heading_paths",
          "w4_w5_list_labels", "l1_line_opcodes", "l9_table_pair_resolution", "m5_merged_tables", "b4_row_alignment", "j6_mapped_columns",
          "f12_table_noise", "h2_shape_changes", "s2_nodes_from_json", "j9_w12_inherited_pages", "a12_cell_content", "q4_latest_state"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
