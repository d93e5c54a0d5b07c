"""Hand-made traces with expectations worked out on paper."""

import pytest
from pyspark.sql import functions as F

from traceloom.functions import measures, reprs
from traceloom.operators import distances, genomes, metrics, sequences, states
from traceloom.sources import tables, traces

EVENTS = "program_id string, run_idx int, input_idx int, seq int, event_type string, function_name string, snapshot map<string,string>, ts timestamp, value double, k long"


def trace(spark, told, program="p"):
    """told: (type, function[, snapshot]) in order."""
    rows = [(program, 0, 0, i, t[0], t[1], t[2] if len(t) > 2 else {}, None, 0.0, i) for i, t in enumerate(told)]
    return spark.createDataFrame(rows, EVENTS)


def calls(spark, names, program="p"):
    return trace(spark, [("call", n) for n in names], program)


def pairs_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_anonymous_order_and_grams(spark):
    events = calls(spark, ["b", "a", "b", "b", "a"])
    assert pairs_of(sequences.anonymise(events), "function_name", "idx") == [("a", 1), ("b", 0)]
    assert pairs_of(sequences.call_ngrams(events, 2), "gram", "n") == [("(0,0)", 1), ("(0,1)", 2), ("(1,0)", 1)]


def test_grams_stay_in_their_trace_unless_asked(spark):
    events = calls(spark, ["a", "b"]).union(calls(spark, ["b", "a"]).withColumn("input_idx", F.lit(1)))
    assert pairs_of(sequences.call_ngrams(events, 2), "gram", "n") == [("(0,1)", 1), ("(1,0)", 1)]
    assert pairs_of(sequences.call_ngrams(events, 2, by_trace=False), "gram", "n") == [("(0,1)", 1), ("(1,0)", 1), ("(1,1)", 1)]


def test_depth_is_clamped(spark):
    events = trace(spark, [("return", "x"), ("call", "a"), ("call", "b"), ("return", "b"), ("return", "a"), ("return", "a"), ("call", "c")])
    assert [r.depth for r in sequences.depths(events).orderBy("seq").collect()] == [0, 1, 2, 1, 0, 0, 1]
    assert sequences.trace_depths(events).first().max_depth == 2


def test_runs_and_loop_score(spark):
    runs = sequences.run_lengths(calls(spark, ["a", "b", "a", "a", "b"]))
    assert pairs_of(runs, "idx", "length") == [(0, 1), (0, 2), (1, 1), (1, 1)]
    assert sequences.loop_score(runs).first().loop_score == pytest.approx((0.1875**0.5) / 1.25)


def test_seven_calls_split_two_two_three(spark):
    # thirds a b | a a | a b a: entropies 1, 0, H(2/3)
    found = dict(pairs_of(sequences.phase_diversity(calls(spark, ["a", "b", "a", "a", "a", "b", "a"])), "phase", "diversity"))
    assert found[0] == pytest.approx(1.0) and found[1] == 0.0 and found[2] == pytest.approx(0.9182958)


def test_precedence_counts_all_pairs(spark):
    r = sequences.precedence(calls(spark, ["a", "b", "a", "b"])).first()
    assert (r.i, r.j, r.n_ij, r.n_ji) == (0, 1, 3, 1)


def test_exception_contexts(spark):
    events = trace(spark, [("call", "a"), ("exception", "E"), ("call", "b"), ("exception", "E"), ("exception", "F"), ("return", "b")])
    assert pairs_of(sequences.exception_contexts(events), "pre", "type", "post") == [(0, "E", 1), (1, "E", -1), (1, "F", -1)]
    assert sequences.recovery_rate(events).first().recovery_rate == pytest.approx(1 / 3)


def test_latency_matches_the_innermost_call_only(spark):
    events = trace(spark, [("call", "a"), ("call", "b"), ("return", "a"), ("return", "b"), ("return", "a"), ("return", "a")])
    assert pairs_of(sequences.call_latency(events), "function_name", "latency") == [("a", 4.0), ("b", 2.0)]


def test_state_transition_kinds(spark):
    events = trace(spark, [
        ("call", "f", {"x": "1", "gone": "[]"}), ("call", "f", {"x": "-1", "lock": "<l>", "new": "None"}), ("exception", "E", {"x": "0", "lock": "None", "new": "None"}), ("call", "f", {"x": "5", "new": "None"}),
    ])
    assert pairs_of(states.state_transitions(events), "pre", "kind", "post") == sorted([
        ("POSITIVE", "state_mutation", "NEGATIVE"), ("EMPTY_COLLECTION", "state_deletion", "ABSENT"), ("ABSENT", "resource_acquire", "NON_NULL"), ("ABSENT", "error_transition", "NULL"),
        ("NEGATIVE", "error_transition", "ZERO"), ("NON_NULL", "error_transition", "NULL"), ("NORMAL", "error_transition", "EXCEPTION_STATE"),
        ("ZERO", "error_recovery", "POSITIVE"), ("NULL", "resource_release", "ABSENT"), ("EXCEPTION_STATE", "error_recovery", "NORMAL"),
    ])


def test_reprs(spark):
    told = {"None": "NULL", "True": "POSITIVE", "False": "ZERO", "0": "ZERO", "-1": "NEGATIVE", "1.5": "POSITIVE", "''": "EMPTY_COLLECTION", "'x'": "NON_NULL", "[]": "EMPTY_COLLECTION", "[1]": "SINGLETON", "[1, [2, 3]]": "MULTI_ELEMENT", "[(1, 2)]": "SINGLETON", "{}": "EMPTY_COLLECTION", "{1: 2}": "SINGLETON", "{1, 2}": "MULTI_ELEMENT", "<obj>": "NON_NULL", "b'x'": "NON_NULL", "b''": "EMPTY_COLLECTION", "Foo(1)": "NON_NULL", "?": "UNKNOWN"}
    types = {"None": "NoneType", "True": "bool", "0": "int", "1.5": "float", "'x'": "str", "[1]": "list", "{1, 2}": "dict", "(1,)": "tuple", "b'x'": "bytes", "Foo(1)": "Foo", "<obj>": "obj", "?": "unknown"}
    df = spark.createDataFrame([(x,) for x in {*told, *types}], "r string").select("r", reprs.abstract_value(F.col("r")).alias("v"), reprs.type_name(F.col("r")).alias("t"))
    rows = {r.r: r for r in df.collect()}
    assert {x: rows[x].v for x in told} == told
    assert {x: rows[x].t for x in types} == types


def test_distance_axioms(spark, sf_dir):
    events = traces.event_traces(tables.read_table(spark, sf_dir, "events"))
    table = traces.trace_table(events)
    same = events.select("program_id").distinct().select(F.col("program_id").alias("pair_id"), F.col("program_id").alias("left"), F.col("program_id").alias("right"))
    assert all(abs(r.distance) < 1e-9 for r in distances.distance_v5(events, table, same).collect())
    pairs = traces.version_pairs(events)
    flipped = pairs.select("pair_id", F.col("right").alias("left"), F.col("left").alias("right"))
    a, b = (dict(pairs_of(distances.distance_v5(events, table, p), "pair_id", "distance")) for p in (pairs, flipped))
    assert all(a[k] == pytest.approx(b[k]) and 0 <= a[k] <= 1 for k in a)


def test_renaming_functions_changes_nothing_anonymous(spark):
    a, b = calls(spark, ["x", "y", "x", "z"], "a"), calls(spark, ["q", "r", "q", "s"], "b")
    pairs = spark.createDataFrame([("1", "a", "b")], "pair_id string, left string, right string")
    grams = genomes.histogram(sequences.call_ngrams(a.union(b), 2), "bigrams", "gram", "share")
    assert distances.kernels(grams, pairs).first().l1 == pytest.approx(0.0)


def test_empty_traces(spark):
    none = calls(spark, ["a"]).limit(0)
    for f in (sequences.anonymise, sequences.run_lengths, sequences.phase_diversity, sequences.precedence, states.state_transitions, sequences.exception_triples):
        assert f(none).count() == 0


def test_both_divergences_of_a_half_empty_pair(spark):
    rows = spark.createDataFrame([("a", "f", "x", 1.0), ("a", "f", "y", 1.0)], "program_id string, family string, key string, weight double")
    pairs = spark.createDataFrame([("1", "a", "b")], "pair_id string, left string, right string")
    assert distances.rooted_jsd(rows, pairs).first().jsd_root == pytest.approx(0.0)  # the empty side is uniform
    assert distances.kernels(rows, pairs).first().jsd == pytest.approx(0.5)  # the empty side is zero


def scores(spark, rows):
    return spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(rows)], "pair_id long, score double, label long").withColumn("g", F.lit(1))


def test_auroc_with_ties_and_lone_classes(spark):
    assert metrics.auroc(scores(spark, [(0.1, 1), (0.5, 1), (0.5, 0), (0.9, 0)]), ["g"]).first().auroc == pytest.approx(0.875)
    assert metrics.auroc(scores(spark, [(0.1, 1), (0.5, 1)]), ["g"]).first().auroc == 0.5


def test_holm_stops_after_the_first_failure(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p_value double")
    assert [(r.test, r.reject, r.stopped) for r in metrics.holm(tests).orderBy("rank").collect()] == [("a", True, False), ("c", False, False), ("b", False, True)]


def test_threshold_and_area(spark):
    rows = scores(spark, [(0.2, 1), (0.4, 0), (0.6, 1), (0.8, 0)])
    best = metrics.best_threshold(rows, ["g"]).first()
    assert (best.threshold, best.f1) == (pytest.approx(0.8), pytest.approx(0.8))
    assert metrics.auprc(rows, ["g"], "pair_id").first().auprc == pytest.approx(0.5 * 1.0 + 0.5 * (0.5 + 2 / 3) / 2)


def test_tail_of_chi_square(spark):
    assert spark.range(1).select(measures.chi2_sf_1df(F.lit(3.841459)).alias("p")).first().p == pytest.approx(0.05, abs=1e-5)
    assert measures.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_java_lines(spark):
    lines = ["TRACE ENTER foo depth=1", "noise", "TRACE EXCEPTION foo depth=1 java.lang.Error", "TRACE EXIT foo depth=0"]
    df = spark.createDataFrame([("p", 0, 0, i, x) for i, x in enumerate(lines)], "program_id string, run_idx int, input_idx int, line_no int, value string")
    assert pairs_of(tables.java_traces(df).fillna(""), "seq", "event_type", "depth", "exception_type") == [(0, "call", 1, ""), (2, "exception", 1, "java.lang.Error"), (3, "return", 0, "")]


def test_bundles_survive_json(spark, tmp_path):
    rows = [("p", "h", "2024-01-01T00:00:00", "v1", {"b": "2", "a": "1"}, {}, None)]
    bundles = spark.createDataFrame(rows, tables.BUNDLES)
    assert tables.round_trips(bundles)
    tables.write_bundles(bundles, str(tmp_path / "b"))
    assert tables.read_bundles(spark, str(tmp_path / "b")).count() == 1


@pytest.mark.parametrize("name", ["distance_v5", "distance_hybrid"])
def test_distances_read_only_staged_tables(spark, sf_dir, name):
    from traceloom.plans import registry

    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "parquet" in plan and "events.parquet" not in plan


def test_order_crosses_traces(spark):
    # runs, grams and contexts over three traces, one of them without a call
    def rows(i, told):
        return trace(spark, told).withColumn("input_idx", F.lit(i))

    events = rows(0, [("call", "a"), ("call", "a"), ("exception", "E")]).union(rows(1, [("return", "a")])).union(rows(2, [("call", "a"), ("call", "b"), ("exception", "E")])).union(rows(3, [("exception", "F"), ("call", "b")]))
    assert pairs_of(sequences.run_lengths(events), "idx", "length") == [(0, 3), (1, 2)]
    assert pairs_of(sequences.call_ngrams(events, 3, by_trace=False), "gram", "n") == [("(0,0,0)", 1), ("(0,0,1)", 1), ("(0,1,1)", 1)]
    assert pairs_of(sequences.exception_contexts(events), "pre", "type", "post") == [(0, "E", 0), (1, "E", -1), (1, "F", 1)]
    r = sequences.precedence(events).first()
    assert (r.n_ij, r.n_ji) == (6, 0)
