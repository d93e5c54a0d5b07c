"""Recorded outputs judged by hand-made rules, reprs of any depth, power, and rows that the queries don't reach."""

import math

import pytest
from pyspark.sql import functions as F

from traceloom.functions import measures, reprs
from traceloom.operators import recorded
from traceloom.operators.ordering import numbered, running
from traceloom.sources import tables
from traceloom.sources.staging import Workspace
from traceloom.streaming import live

OUTPUTS = "program_id string, input_idx int, repr string, exception string, ms double"
PAIRS = "pair_id string, left string, right string"


def test_elements_of_any_depth(spark):
    deep = "[" * 40 + "1, 2" + "]" * 40
    told = {"[]": 0, "[1]": 1, "[1, [2, 3]]": 2, deep: 1, f"[{deep}, {deep}, 3]": 3, "{1: (2, 3), 4: 5}": 2, "( )": 0}
    rows = spark.createDataFrame([(x,) for x in told], "r string").select("r", reprs.elements(F.col("r")).alias("n")).collect()
    assert {r.r: r.n for r in rows} == told


def test_equal_reprs_and_partitions(spark):
    equal = {("1.0", "1.0000000000000002"): True, ("1.0", "1.1"): False, ("1", "1.0"): False, (None, None): True, (None, "1"): False, ("'a'", "'a'"): True, ("0.0", "1.0e-13"): True}
    rows = spark.createDataFrame(list(equal), "a string, b string").select("a", "b", recorded.equal_reprs(F.col("a"), F.col("b")).alias("e")).collect()
    assert {(r.a, r.b): r.e for r in rows} == equal
    keys = {"None": "None", "True": "bool:True", "-3": "int:negative", "0": "int:zero", "7": "int:positive", "0.0": "float:zero", "2.5": "float:nonzero", "nan": "float:nan", "inf": "float:inf:True", "''": "str:empty", "'x'": "str:nonempty", "[]": "seq:empty", "(1,)": "seq:multi", "[4]": "seq:single", "[4, 5]": "seq:multi", "{1: 2}": "dict:1", "Foo(1)": "other:Foo"}
    rows = spark.createDataFrame([(x,) for x in keys], "r string").select("r", recorded.partition_key(F.col("r")).alias("k")).collect()
    assert {r.r: r.k for r in rows} == keys | {"(1,)": "seq:multi"}


def test_labels_and_regressions(spark):
    rows = [("a", 0, "1", None, 2.0), ("a", 1, None, "E", 2.0), ("b", 0, "1", None, 1.0), ("b", 1, None, "F", 1.0), ("c", 0, "1", None, 2.0), ("c", 1, None, "E", 2.0), ("c", 2, "9", None, 2.0)]
    outputs = spark.createDataFrame(rows, OUTPUTS)
    pairs = spark.createDataFrame([("1", "a", "b"), ("2", "a", "c"), ("3", "a", "z")], PAIRS)
    labels = {r.pair_id: (r.n_tested, r.n_diffs, r.label) for r in recorded.oracle_labels(outputs, pairs).collect()}
    assert labels == {"1": (2, 1, "CHANGED"), "2": (2, 0, "LIKELY_EQUIVALENT"), "3": (0, 0, "UNKNOWN")}
    found = {r.pair_id: r for r in recorded.regression_distances(outputs, pairs).collect()}
    assert (found["1"].exception_fraction, found["1"].exception_types, found["1"].output_divergence) == (0.0, 1.0, 0.5)
    assert found["1"].volume_ratio == pytest.approx(0.1, abs=1e-5) and found["1"].distance == pytest.approx(0.2 + 0.01 + 0.2, abs=1e-5)
    assert found["2"].exception_fraction == pytest.approx(1 / 6) and found["2"].output_divergence == 0.0
    rates = recorded.detection_rates(recorded.regression_distances(outputs, pairs).withColumn("kind", F.lit("k")), "kind").first()
    assert (rates.n, rates.by_output, rates.by_exception, rates.n_silent) == (2, 0.5, 1.0, 0)


def test_confidence_of_labels(spark):
    rows = [(20_000, 0), (2_000, 0), (100, 0), (100, 3), (0, 0)]
    table = spark.createDataFrame(rows, "n_tested long, n_diffs long")
    found = {(r.n_tested, r.n_diffs): (r.tier, r.confidence) for r in recorded.calibrated(table, F.lit(True), F.lit(True)).collect()}
    assert found == {(20_000, 0): ("GT-T2", 0.999), (2_000, 0): ("GT-T3", 0.98), (100, 0): ("GT-T4", 0.9), (100, 3): ("GT-T4", 0.999), (0, 0): ("GT-T4", 0.5)}
    changed = {(r.n_tested, r.n_diffs): (r.tier, r.confidence) for r in recorded.calibrated(table, F.lit(False), F.lit(True)).collect()}
    assert changed[100, 3] == ("GT-T1", 0.999) and changed[100, 0] == ("GT-T4", pytest.approx(0.5 + 0.45 * (1 - math.exp(-0.2))))


def test_boundary_inputs_and_exposure(spark):
    constants = spark.createDataFrame([("1", v) for v in (3, -1, 1, 90, 3)], "pair_id string, value int")
    assert [r.value for r in recorded.nearest_zero(constants, 3).orderBy("rank").collect()] == [-1, 1, 3]
    inputs = [(r.kind, r.elements) for r in recorded.boundary_inputs(constants.where("value = 90").withColumn("value", F.lit(1))).collect()]
    assert inputs == [("scalar", [0]), ("scalar", [1]), ("scalar", [2]), ("list", [0]), ("list", [1]), ("list", [2]), ("list", [0, 1]), ("list", [1, 2]), ("falling", []), ("falling", [1]), ("falling", [2, 1])]
    tested = spark.createDataFrame([("1", [3], "1", None, "1", None), ("1", [1], "1", None, "2", None), ("1", [90], None, "TimeoutError", "2", None)], "pair_id string, near array<int>, a_repr string, a_exception string, b_repr string, b_exception string")
    r = recorded.exposure(tested, constants).first()
    assert (r.n_constants, r.exercised, r.n_tested, r.n_divergent, r.diverges, r.confidence) == (4, 2, 2, 1, True, 0.5)


def test_power():
    assert measures.mcnemar_power(4, 0.2) == 0.0
    shift = math.sqrt(200) / 3
    assert measures.mcnemar_power(1000, 0.2) == pytest.approx(measures.normal_cdf(shift - 1.959964) + measures.normal_cdf(-shift - 1.959964), abs=1e-6)
    d = measures.least_effect(64)
    assert measures.mann_whitney_power(64, d) == pytest.approx(0.8, abs=1e-3) and measures.mann_whitney_power(64, d - 0.01) < 0.8
    p = measures.least_discordance(500)
    assert measures.mcnemar_power(500, p) == pytest.approx(0.8, abs=1e-3)
    n = measures.least_pairs(0.8, 0.2)
    assert measures.mcnemar_power(n, 0.2) >= 0.8 > measures.mcnemar_power(n - 1, 0.2)


def test_ranges(spark):
    rows = spark.range(500).select(F.nullif(F.col("id") % 3, F.lit(2)).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("x"), "id").repartition(5)
    with Workspace(spark, "test") as work:
        got = [(r.x, r.id) for r in numbered(rows, [F.col("x"), F.col("id")], work).orderBy("no").collect()]
        assert got == sorted((r.x, r.id) for r in rows.collect())
        sums = running(rows, ["g"], [F.col("x"), F.col("id")], {"n": F.lit(1).cast("long"), "s": F.col("id")}, work).collect()
    held = {g: sorted((r.x, r.id) for r in rows.collect() if r.g == g) for g in (0, 1, None)}
    want = {(g, i): (k + 1, sum(j for _, j in x[: k + 1])) for g, x in held.items() for k, (_, i) in enumerate(x)}
    assert {(r.g, r.id): (r.n, r.s) for r in sums} == want


def test_files_of_pairs_and_sources(spark, tmp_path):
    (tmp_path / "pairs.jsonl").write_text('{"pair_id": "1", "split": "test", "seed": 3}\nnot json\n{"pair_id": "2", "split": "dev"}\n')
    assert sorted(r.pair_id for r in tables.read_pairs(spark, str(tmp_path / "pairs.jsonl")).collect()) == ["1", "2"]
    assert tables.read_pairs(spark, str(tmp_path / "pairs.jsonl"), split="test").first().seed == 3
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        tables.read_pairs(spark, str(tmp_path / "pairs.jsonl"), tolerant=False).collect()
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\ny = 2\n")
    r = tables.read_sources(spark, str(tmp_path / "src")).select("source", tables.source_hash().alias("h")).first()
    assert r.source == "x = 1\ny = 2\n" and len(r.h) == 16


def test_live_counts(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    counts = live.live_call_counts(log)
    assert counts.agg(F.sum("n")).first()[0] == log.count()
