import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.llm import queries
from tools.check_oracles import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_all_operators_are_registered():
    names = entry.queries()
    assert all(any(q.startswith(f"op{i}_") for q in names) for i in range(1, 11)) and "pipeline" in names
