import os

import duckdb
import pytest

from tesselar.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.execute(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[k] for k in order) for r in want.fetchall())
