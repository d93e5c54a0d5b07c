"""Tokens of sources, linearised trees, joint n-grams and the registry of dimensions, worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from traceloom.operators import dimensions, lexer, sequences, static, texts
from traceloom.sources import traces


def sources(spark, *told):
    return spark.createDataFrame([(f"p{i}", s) for i, s in enumerate(told)], "program_id string, source string")


def test_tokens_leave_out_comments_and_mark_keywords(spark):
    table = lexer.tokens(sources(spark, "def F(x):  # no\n    '''Doc'''\n    return x + 1.5 if x is None else True\n", None, "", "x = (1\n"))
    found = {r.doc_id: r.tokens for r in lexer.token_lists(table).collect()}
    assert found["p0"] == ["f", "(", "x", ")", ":", "'''doc'''", "x", "+", "1.5", "x", "none", "true"]
    assert {r.token for r in table.where("kind = 'keyword'").collect()} == {"def", "return", "if", "is", "else"}
    assert found["p3"] == ["x", "=", "(", "1"] and "p1" not in found and "p2" not in found
    assert lexer.token_lists(table, ("name", "number", "string")).where("doc_id = 'p0'").first().tokens == ["f", "x", "'''doc'''", "x", "1.5", "x", "none", "true"]


def test_trees_are_read_level_by_level_without_docstrings(spark):
    tree = static.nodes(sources(spark, '"""Doc."""\ndef f(x):\n    "doc"\n    return x\n', "def f(x):\n    return x\n", "x", "def f("))
    found = {r.program_id: r.kinds for r in static.linearised(tree).collect()}
    assert found["p1"] == ["Module", "FunctionDef", "arguments", "Return", "arg", "Name", "Load"]
    # the kinds of a docstring's constant are below it, so they stay out of the comparison with their statement only
    assert [k for k in found["p0"] if k != "Constant"] == found["p1"]
    pairs = spark.createDataFrame([("a", "p1", "p1"), ("b", "p1", "p2"), ("c", "p3", "p3"), ("d", "p1", "p3")], "pair_id string, left string, right string")
    rows = {r.pair_id: r.similarity for r in static.tree_edit_similarity(tree, pairs).collect()}
    # Module Expr Name Load against seven kinds: four edits
    assert rows["a"] == 1.0 and rows["b"] == pytest.approx(1 - 4 / 7) and rows["c"] == 1.0 and rows["d"] == 0.0


def test_joint_features(spark):
    row = spark.createDataFrame([(1, ["ab", "c"]), (2, []), (3, ["x"])], "doc_id int, tokens array<string>").select("doc_id", texts.joint_features(F.col("tokens")).alias("f"))
    assert {r.doc_id: r.f for r in row.collect()} == {1: ["W1:ab", "W1:c", "W2:ab_c", "C3:ab ", "C3:b c", "C4:ab c"], 2: [], 3: ["W1:x"]}


EVENTS = "program_id string, run_idx int, input_idx int, seq int, event_type string, function_name string, snapshot map<string,string>, ts timestamp, value double, k long"


def test_subsets_of_dimensions(spark):
    rows = [(p, 0, 0, i, "call", n, {"x": "1"}, None, 0.0, i) for p, names in (("l", "ab"), ("r", "aa")) for i, n in enumerate(names)]
    events = spark.createDataFrame(rows, EVENTS)
    tree = static.nodes(sources(spark, "").select(F.lit("l").alias("program_id"), F.lit("for x in y:\n    pass").alias("source")).union(spark.createDataFrame([("r", "if x:\n    pass")], "program_id string, source string")))
    pairs = spark.createDataFrame([("q", "l", "r")], "pair_id string, left string, right string")
    inputs = dimensions.Inputs(pairs, events, traces.trace_table(events), tree)
    whole = dimensions.distances_of(inputs).first().asDict()
    assert list(whole) == ["pair_id", *dimensions.REGISTRY] and whole["CONTROL"] == 0.5 and whole["EXECUTION"] == pytest.approx(0.25)
    for only in (["TEMPORAL"], ["STATE", "DATA"], ["RESOURCE", "ERROR", "EXECUTION"]):
        part = dimensions.distances_of(inputs, only).first().asDict()
        assert part == {k: v for k, v in whole.items() if k == "pair_id" or k in only}
    weights = {"CONTROL": 0.2, "EXECUTION": 0.1}
    assert dimensions.distance_of(inputs, ["CONTROL", "EXECUTION"]).first().distance == pytest.approx(sum(w * whole[d] for d, w in weights.items()) / 0.3)
    assert dimensions.distances_of(dimensions.Inputs(pairs, tree=tree)).columns == ["pair_id", "CONTROL", "DATA", "ERROR"]
    with pytest.raises(ValueError, match="NONE"):
        dimensions.distances_of(inputs, ["NONE"])


def test_what_a_subset_does_not_need_is_not_planned(spark, monkeypatch):
    events = spark.createDataFrame([("l", 0, 0, 0, "call", "a", {"x": "1"}, datetime.datetime(2024, 1, 1), 0.0, 1)], EVENTS)
    pairs = spark.createDataFrame([("q", "l", "l")], "pair_id string, left string, right string")

    def never(*_):
        raise AssertionError

    for name in ("in_traces", "phase_timing"):
        monkeypatch.setattr(sequences, name, never)
    assert dimensions.distances_of(dimensions.Inputs(pairs, events, traces.trace_table(events)), ["RESOURCE", "INTERACTION"]).first().RESOURCE == 0.0


def test_own_dimensions_can_be_added(spark, monkeypatch):
    monkeypatch.setattr(dimensions, "REGISTRY", dict(dimensions.REGISTRY))
    dimensions.register(dimensions.Dimension("SIZE", distance=lambda tree, pairs: pairs.select("pair_id", F.lit(0.5).alias("distance"))))
    pairs = spark.createDataFrame([("q", "p0", "p0")], "pair_id string, left string, right string")
    assert dimensions.distances_of(dimensions.Inputs(pairs, tree=static.nodes(sources(spark, "x"))), ["SIZE"]).first().SIZE == 0.5
