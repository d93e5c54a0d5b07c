"""The operators that SQL can express against DuckDB."""

import duckdb
import pytest

from traceloom.llm import queries

TABLES = "documents pages conversations".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    names = sorted(got.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert names == sorted(want.columns)
    left = sorted(map(repr, map(tuple, got.select(*names).collect())))
    right = sorted(map(repr, duck.sql(f"SELECT {', '.join(names)} FROM want").fetchall()))
    assert left == right
