"""The leakage audit and label encoding on rows worked out by hand."""

from traceloom.operators import audits, metrics

ROWS = "program string, pair_id string, family string, category string, split string, subject int"


def audit(spark, rows, corpus):
    found = audits.leakage_audit(spark.createDataFrame(rows, ROWS), spark.createDataFrame([(c,) for c in corpus], "program string"))
    return {(r.check, r.subject): (r.splits, r.n) for r in found.collect()}


def test_each_check_and_what_is_clean(spark):
    rows = [
        ("a", "1", "SP1", "sort", "train", 0), ("a", "2", "SP1", "sort", "test", 0), ("b", "3", "SP2", "graph", "dev", 0), ("b", "3", "SP1", "sort", "dev", 0),
        ("c", "4", "SP2", "text", "test", 0), ("c", "1", "SC1", "text", "test", 0), ("d", "5", "SC1", "text", None, 0), (None, "6", None, None, "val", 0),
    ]
    found = audit(spark, rows, ["a", "b", "c", "d", "e", "e", None])
    assert found == {
        ("program", "a"): ("test,train", 2), ("pair", "1"): ("test,train", 2), ("family", "SP1"): ("dev,test,train", 3), ("family", "SP2"): ("dev,test", 2),
        ("category", "text"): ("test", 2), ("orphan", "d"): ("", 0), ("orphan", "e"): ("", 0),
    }


def test_empty_tables(spark):
    assert audit(spark, [], []) == {}
    assert audit(spark, [], ["a"]) == {("orphan", "a"): ("", 0)}
    assert audit(spark, [("a", "1", "f", "c", "dev", 1)], []) == {}


def test_labels(spark):
    rows = spark.createDataFrame([("EQUIVALENT",), ("CHANGED",), ("UNKNOWN",), (None,)], "expected_label string")
    assert {r.expected_label: r.label for r in metrics.encoded_labels(rows).collect()} == {"EQUIVALENT": 0, "CHANGED": 1, "UNKNOWN": 1, None: 1}
