"""One user with more events on a day than a live tracer records, against SQL."""

import datetime
import math

import duckdb
import pytest

from traceloom.plans import registry

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
KINDS = ["view", "click", "signup", "purchase", "error"]
HOT = 12_000
NAMES = ["call_freq", "call_bigrams", "trace_depth_stats", "causal_precedence", "state_transitions", "volume_stats", "version_l1_distance", "distance_v2", "distance_v3", "distance_v5"]


@pytest.fixture(scope="module")
def hot_dir(spark, tmp_path_factory):
    at = datetime.datetime(2024, 1, 2)
    second = datetime.timedelta(seconds=1)
    # the kinds change their shares after event 10,000, so that a cut shows in every feature
    kind = lambda i: KINDS[(i * i // 7) % 5] if i < 10_000 else KINDS[i % 4]
    rows = [(i, at + i * second, 1, kind(i), float(i % 97) - 40, f'{{"k": {i % 89}}}') for i in range(HOT)]
    rows += [(HOT + i, at + datetime.timedelta(days=14 + i % 3) + i * second, 1 + i % 2, kind(3 * i), float(i), f'{{"k": {i % 13}}}') for i in range(60)]
    rows += [(HOT + 60 + i, at + i * second, 2, kind(i), float(i), f'{{"k": {i % 11}}}') for i in range(40)]
    path = tmp_path_factory.mktemp("hot")
    spark.createDataFrame(rows, EVENTS).coalesce(2).write.parquet(f"{path}/events.parquet")
    return str(path)


def plain(rows):
    told = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted(repr(tuple(told(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_all_events_of_a_hot_day_count(spark, hot_dir, name):
    got = registry.queries()[name](spark, hot_dir)
    names = sorted(got.columns)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{hot_dir}/events.parquet/*.parquet'")
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert plain(got.select(*names).collect()) == plain(want)
