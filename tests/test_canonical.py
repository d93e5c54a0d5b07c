"""Canonical forms, shortcut verdicts, labels and the cap of traces, by hand."""

import datetime

import pytest

from traceloom.operators import canonical, metrics, recorded
from traceloom.sources import traces


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_canonical_histograms(spark):
    given = [("p", "calls", "a", 0.0), ("p", "calls", "b", 2.0), ("p", "branches", "If", 0.333333), ("p", "timing", "f", 1.5), ("p", "timing", "g", -1.0), ("p", "types", "int", -3.0), ("p", "own", "x", -1.0), ("p", "calls", "b", 1.0)]
    given += [("p", "loops", str(i), w) for i, w in enumerate((0.0, 2.0, 0.0, 1.0, 0.0, 0.0))] + [("q", "loops", "0", 0.0)]
    rows = spark.createDataFrame(given, "program_id string, family string, key string, weight double")
    once = canonical.canonical_histograms(rows)
    want = [("p", "branches", "If", 0.3333), ("p", "calls", "b", 2.0), ("p", "own", "x", -1.0), ("p", "timing", "f", 1.0), ("p", "types", "int", 0.0), *[("p", "loops", str(i), w) for i, w in enumerate((0.0, 2.0, 0.0, 1.0))]]
    assert rows_of(once) == sorted(want) == rows_of(canonical.canonical_histograms(once))
    assert canonical.canonical_histograms(rows.limit(0)).count() == 0


def test_canonical_scalars(spark):
    rows = spark.createDataFrame([("p", 1.23456, -2, -0.5, 0.123456, "x")], "program_id string, mutation_rate double, state_space_size long, time_min double, branch_entropy double, other string")
    once = canonical.canonical_scalars(rows)
    assert rows_of(once) == [("p", 1.0, 0, 0.0, 0.1235, "x")] == rows_of(canonical.canonical_scalars(once)) and once.dtypes == rows.dtypes


def test_shortcuts_are_fooled(spark):
    schema = "pair_id string, truth string, agree boolean, a_exceptions double, b_exceptions double, a_items long, b_items long, a_functions long, b_functions long"
    rows = spark.createDataFrame([("x", "CHANGED", False, 0.5, 0.505, 3, 3, 1, 1), ("y", "EQUIV", True, 0.0, 0.0, 4, 4, 1, 2), ("z", "CHANGED", None, 0.0, 0.5, None, 0, 2, 1)], schema)
    found = recorded.shortcut_verdicts(rows)
    assert rows_of(found.select("pair_id", "label", "exception_fraction", "volume", "functions")) == [("x", "CHANGED", "EQUIV", "EQUIV", "EQUIV"), ("y", "EQUIV", "EQUIV", "EQUIV", "CHANGED"), ("z", "CHANGED", "CHANGED", "EQUIV", "CHANGED")]
    assert {r.method: r.right for r in recorded.shortcut_summary(found).collect()} == {"label": 3, "exception_fraction": 2, "volume": 1, "functions": 1}


def test_labels(spark):
    rows = spark.createDataFrame([("EQUIVALENT",), ("CHANGED",), (None,), ("",)], "expected_label string")
    assert [r.label for r in metrics.encoded_labels(rows).collect()] == [0, 1, 1, 1]


def test_a_capped_trace_is_truncated(spark):
    at = datetime.datetime(2024, 1, 3)
    log = spark.createDataFrame([(i, at + datetime.timedelta(seconds=i), 1 + i // 5, "view", 1.0, '{"k": 1}') for i in range(8)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events = traces.event_traces(log, cap=4)
    assert {(r.program_id, r.n_events, r.truncated) for r in traces.trace_table(events, cap=4).collect()} == {("1:A", 4, True), ("2:A", 3, False)}
    assert {r.n_events for r in traces.trace_table(traces.event_traces(log)).collect()} == {5, 3}
    assert pytest.approx(0) == traces.trace_table(traces.event_traces(log)).where("truncated").count()
