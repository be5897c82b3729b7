from pathlib import Path

import duckdb
import pytest

from tracery.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(want.columns)
    rows = lambda columns, data: sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in data)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(list(want.columns), want.fetchall())
