import os
from pathlib import Path

import duckdb
import pytest

from sparkloom.llm import queries

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found, want = queries.QUERIES[name](spark, str(SF)), con.sql(queries.ORACLE_SQL[name]).to_arrow_table()
    names = sorted(found.columns)
    assert names == sorted(want.column_names)
    rows = lambda table: sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in (r[c] for c in names)) for r in table.to_pylist())
    assert rows(found.toArrow()) == rows(want)
