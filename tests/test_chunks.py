"""Traces looked along in chunks: rows do not change with the chunks' size."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from test_hot_traces import hot_dir, plain  # noqa: F401  the fixture
from traceloom.operators import sequences
from traceloom.plans import registry
from traceloom.sources import traces

EVENTS = "program_id string, run_idx int, input_idx int, seq int, event_type string, function_name string, snapshot map<string,string>"


def random_events(spark, seed, n_traces=12):
    rng, rows = random.Random(seed), []
    for t in range(n_traces):
        for i in range(rng.choice([0, 1, 3, 20, 70])):
            kind = rng.choices(["call", "return", "exception"], [5, 4, 1])[0]
            rows.append((f"p{t % 3}", t % 2, t, i, kind, rng.choice("abc"), {"x": str(rng.randint(-1, 1))}))
    return spark.createDataFrame(rows, EVENTS).repartition(3), rows


def told(df):
    names = sorted(df.columns)
    return sorted(repr(tuple(r)) for r in df.select(*names).collect())


def test_chunks_do_not_change_rows(spark, monkeypatch):
    events, _ = random_events(spark, 1)
    forms = (sequences.in_traces, sequences.in_programs, sequences.depths, sequences.precedence, sequences.run_lengths)
    whole = [told(f(events)) for f in forms]
    for chunk in (1, 7):
        monkeypatch.setattr(sequences, "CHUNK", chunk)
        assert [told(f(events)) for f in forms] == whole


def plain_in_traces(rows):
    """pos, prior, run_pos, depth, next_type, next1, next2 and next_seen of every event, one after the other."""
    first, found = {}, []
    for r in sorted(rows, key=lambda r: r[:4]):
        if r[4] == "call":
            names = first.setdefault(r[0], [])
            names += [r[5]] * (r[5] not in names)
    index = lambda r: first.get(r[0], []).index(r[5]) if r[5] in first.get(r[0], []) else None
    for key in {r[:3] for r in rows}:
        trace = sorted((r for r in rows if r[:3] == key), key=lambda r: r[3])
        depth, calls, run = 0, [], None
        for i, r in enumerate(trace):
            prior = calls[-1] if calls else None
            depth = max(0, depth + {"call": 1, "return": -1}.get(r[4], 0))
            if r[4] == "call":
                run = len(calls) if prior is None or prior != index(r) else run
                calls.append(index(r))
            later = [index(x) for x in trace[i + 1 :] if x[4] == "call"]
            seen = next(((x[4], index(x) if x[4] == "call" else None) for x in trace[i + 1 :] if x[4] != "return"), None)
            found.append((*r[:4], len(calls) - 1 if r[4] == "call" else None, prior, run, depth, trace[i + 1][4] if i + 1 < len(trace) else None, *(later + [None, None])[:2], seen))
    return sorted(map(repr, found))


@pytest.mark.parametrize("chunk", [2, 1 << 16])
def test_events_in_traces_equal_plain_ones(spark, monkeypatch, chunk):
    monkeypatch.setattr(sequences, "CHUNK", chunk)
    events, rows = random_events(spark, 7)
    got = sequences.in_traces(events).select("program_id", "run_idx", "input_idx", "seq", "pos", "prior", "run_pos", "depth", "next_type", "next1", "next2", "next_seen").collect()
    assert sorted(repr((*r[:11], None if r.next_seen is None else tuple(r.next_seen))) for r in got) == plain_in_traces(rows)


@pytest.mark.parametrize("name", ["causal_precedence", "state_transitions", "distance_v5"])
def test_a_hot_day_in_chunks(spark, hot_dir, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(sequences, "CHUNK", 500)
    got = registry.queries()[name](spark, hot_dir)
    names = sorted(got.columns)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{hot_dir}/events.parquet/*.parquet'")
    assert plain(got.select(*names).collect()) == plain(duck.sql(f"SELECT {', '.join(names)} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_order_by_slices(spark):
    rows = [("a", 0, 3.0, 1), ("a", 0, 1.0, 2), ("a", 1, 0.5, 3), ("b", 5, 2.0, 4), ("a", None, None, 5), ("a", 1, 0.25, 6)]
    df = spark.createDataFrame(rows, "k string, part int, at double, id int")
    got = traces.in_order(df, ["k"], "part", ["at"]).select("id", "seq").collect()
    assert {tuple(r) for r in got} == {(5, 0), (2, 1), (1, 2), (6, 3), (3, 4), (4, 0)}


def plain_latency(rows):
    sums = {}
    for key in {r[:3] for r in rows}:
        stack = []
        for r in sorted((r for r in rows if r[:3] == key), key=lambda r: r[3]):
            if r[4] == "call":
                stack.append(r)
            elif r[4] == "return" and stack and stack[-1][5] == r[5]:
                n, total = sums.get((r[0], r[5]), (0, 0))
                sums[r[0], r[5]] = (n + 1, total + r[3] - stack.pop()[3])
    return sorted((p, f, n, total) for (p, f), (n, total) in sums.items())


@pytest.mark.parametrize("chunk, group", [(2, 3), (1 << 16, 256)])
def test_calls_close_in_chunks(spark, monkeypatch, chunk, group):
    monkeypatch.setattr(sequences, "CHUNK", chunk)
    monkeypatch.setattr(sequences, "GROUP", group)
    events, rows = random_events(spark, 5)
    assert sorted(tuple(r) for r in sequences.closed_calls(events).select("program_id", "function_name", "n", "events").collect()) == plain_latency(rows)
    assert sequences.closed_calls(events.limit(0)).count() == 0
    assert sequences.call_latency(events).where(F.col("latency") <= 0).count() == 0
