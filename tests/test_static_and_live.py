import pytest
from pyspark.sql import functions as F

from traceloom.operators import static, texts
from traceloom.streaming import live

SOURCE = '''
def f(n):
    for i in range(n):
        while i and n or i:
            g(i)
    try:
        return [x for x in range(n) if x if n]
    except ValueError:
        raise
    except:
        pass

def g(i):
    return f(i) if i else 0
'''


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("p", SOURCE), ("q", SOURCE.replace("while", "if")), ("bad", "def ("), ("none", None), ("empty", "")]
    return static.nodes(spark.createDataFrame(rows, "program_id string, source string")).cache()


def test_control_features(tree):
    p = tree.where("program_id = 'p'")
    assert {(r.kind, r.n) for r in static.branch_profile(p).collect()} == {("For", 1), ("While", 1), ("Try", 1)}
    assert {(r.depth, r.n) for r in static.loop_nesting(p).collect()} == {(1, 1), (2, 1)}
    # for, while, try, two boolean operators' further operands, two filters, one conditional expression
    assert static.control_summary(p).first().complexity == 1 + 3 + 2 + 2 + 1
    assert {(r.caller, r.callee, r.n) for r in static.call_edges(p).collect()} == {("f", "range", 2), ("f", "g", 1), ("g", "f", 1)}
    assert tuple(static.error_summary(p).select("tries", "handlers", "bare_handlers", "raises").first()) == (1, 2, 1, 1)
    assert tree.where("program_id = 'bad'").count() == 0


def test_static_distances(spark, tree):
    pairs = spark.createDataFrame([("1", "p", "q"), ("2", "p", "p"), ("3", "bad", "none")], "pair_id string, left string, right string")
    found = {r.pair_id: r.distance for r in static.control_distance(tree, pairs).collect()}
    assert found == {"1": pytest.approx(0.5 / 3), "2": 0.0, "3": 0.0}
    alike = {r.pair_id: r.similarity for r in static.node_type_similarity(tree, pairs).collect()}
    assert alike["2"] == 1.0 and 0.8 < alike["1"] < 1.0


def test_token_edit_similarity(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r.s for r in df.select(texts.token_edit_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [0.5, 1.0, 0.0]


def test_live_sessions(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    running = live.live_sessions(stream).writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).start()
    running.processAllAvailable()
    running.stop()
    got = spark.table("sessions")
    want = live.live_sessions(table)
    assert 0 < got.count() <= want.count()
    assert got.exceptAll(want).isEmpty()
