"""Every registered query of the trace library against its SQL on DuckDB."""

import math

import duckdb
import pytest

from traceloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(frame, names):
    return sorted((tuple(plain(x) for x in r) for r in frame), key=lambda r: tuple((x is None, str(x)) for x in r)), names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir)
    names = sorted(got.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert names == sorted(want.columns)
    left = sorted(map(repr, (tuple(plain(x) for x in r) for r in got.select(*names).collect())))
    right = sorted(map(repr, (tuple(plain(x) for x in r) for r in duck.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM want").fetchall())))
    assert left == right


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0
