"""Static features of small sources, worked out by hand."""

import re

import pytest

from traceloom.operators import flow, identity, languages, static
from traceloom.sources import tables

SOURCE = '''
def f(a, b=1, *c):
    x = a + b * 2.5
    if x > 1 and 'k' in c:
        return [x, None]
    try:
        g(x)
    except (ValueError, os.error):
        return None
    except KeyError:
        raise
    finally:
        x -= 1
    assert x != 0
    for i in range(3):
        while i:
            i = i - 1
    return {i: True for i in c}

def g(y):
    return f(y) if y else g(y - 1)
'''
PAIRS = "pair_id string, left string, right string"


@pytest.fixture(scope="module")
def tree(spark):
    renamed = re.sub(r"\bx\b", "value", re.sub(r"\bf\b", "first", SOURCE))
    rows = [("p", SOURCE), ("q", renamed), ("r", "y = 1.5\n"), ("bad", "def ("), ("none", None)]
    return static.nodes(spark.createDataFrame(rows, "program_id string, source string")).cache()


def test_data_genome(spark, tree):
    r = static.data_features(tree).where("program_id = 'p'").first().asDict()
    told = {c: n for c, n in r.items() if ":" in c and n}
    assert told == {
        "types:int": 7, "types:float": 1, "types:str": 1, "types:None": 2, "types:bool": 1, "arithmetic:Add": 1, "arithmetic:Mul": 1, "arithmetic:Sub": 3,
        "comparisons:Gt": 1, "comparisons:In": 1, "comparisons:NotEq": 1, "containers:list": 1, "containers:dict": 1, "containers:tuple": 1,
    }
    assert r["flow"] == pytest.approx(3 / 16)
    pairs = spark.createDataFrame([("1", "p", "q"), ("2", "p", "r"), ("3", "r", "r")], PAIRS)
    found = {x.pair_id: x.distance for x in static.data_distance(tree, pairs).collect()}
    assert found["1"] == found["3"] == pytest.approx(0.0) and 0.3 < found["2"] <= 1
    once = static.canonical_data(static.data_features(tree))
    assert once.exceptAll(static.canonical_data(once)).isEmpty()


def test_error_genome(spark, tree):
    r = static.error_summary(tree).where("program_id = 'p'").first()
    assert (r.tries, r.handlers, r.bare_handlers, r.raises, r.finals, r.assertions, r.raised, r.caught, r.pattern, r.coverage) == (1, 2, 0, 1, 1, 1, ["<re-raise>"], ["KeyError", "ValueError, error"], "mixed", 0.5)
    pairs = spark.createDataFrame([("1", "p", "q"), ("2", "p", "r")], PAIRS)
    found = {x.pair_id: x.distance for x in static.error_distance(tree, pairs).collect()}
    # five of six counts differ from 0, the sets are apart, and so are the patterns
    assert found == {"1": 0.0, "2": pytest.approx(0.4 + 0.3 * 5 / 6 + 0.3)}


def test_fingerprints_and_root(spark, tree):
    prints = {(r.program_id, r.top): r.asDict() for r in identity.fingerprints(tree).collect()}
    f, g = prints["p", 0], prints["p", 1]
    want = {
        "has_return_value": True, "branches": 6, "recursive_calls": 0, "has_loop": True, "has_nested_loop": True, "has_handler": True, "nesting_depth": 2, "comprehensions": 1,
        "literal_types": "NoneType,bool,float,int,list,str,tuple", "builtin_calls": "range", "module_calls": 1, "params": 2, "has_defaults": True, "has_varargs": True,
    }
    assert {k: f[k] for k in want} == want
    assert (g["recursive_calls"], g["module_calls"], g["params"], g["branches"], g["has_loop"]) == (1, 2, 1, 0, False)
    strip = lambda r: {k: v for k, v in r.items() if k != "program_id"}
    assert strip(prints["q", 0]) == strip(f) and strip(prints["q", 1]) == strip(g)
    matched = identity.matched_functions(identity.fingerprints(tree), spark.createDataFrame([("1", "p", "q")], PAIRS)).collect()
    assert sorted((r.a, r.b, r.likeness) for r in matched) == [(0, 0, 1.0), (1, 1, 1.0)]
    roots = {r.program_id: (r.root, r.program_hash) for r in identity.program_identity(tree).collect()}
    assert roots["p"] == roots["q"] and roots["p"][0] == 0  # both call each other
    assert identity.call_roots(static.nodes(spark.createDataFrame([("s", "def a():\n  pass\ndef b():\n  a()\n")], "program_id string, source string"))).first().top == 1


def test_control_flow_and_dependencies(spark):
    rows = [("a", "x = 1\nif x:\n    y = 2\n"), ("b", "x = 1\n"), ("c", "x = a\ny = x\nprint(x)\n"), ("d", "x = a\n"), ("bad", "def ("), ("e", SOURCE)]
    sources = spark.createDataFrame(rows, "program_id string, source string")
    pairs = spark.createDataFrame([("1", "a", "b"), ("2", "e", "e"), ("3", "c", "d"), ("4", "bad", "bad")], PAIRS)
    flows = flow.control_flow(sources).cache()
    assert (flows.where("program_id = 'a' AND edge IS NULL").count(), flows.where("program_id = 'a' AND edge IS NOT NULL").count()) == (4, 4)
    blocks = {r.pair_id: r.similarity for r in flow.block_similarity(flows, pairs).collect()}
    assert (blocks["1"], blocks["2"], blocks["4"]) == (0.5, 1.0, 1.0)
    alike = {r.pair_id: r.similarity for r in flow.flow_similarity(flows, pairs).collect()}
    assert (alike["1"], alike["2"], alike["4"]) == (pytest.approx(0.0625), 1.0, 1.0)
    facts = {r.pair_id: r.similarity for r in flow.dependency_similarity(flow.dependency_facts(sources), pairs).collect()}
    assert facts["3"] == pytest.approx(0.40625) and facts["2"] == pytest.approx(1.0)


JAVA = '''public class A {
  public static int fact(int n) {
    if (n <= 1) { return 1; }
    for (int i = 0; i < n; i++) { log(i); }
    return n * fact(n - 1);
  }
}
'''


def test_features_across_languages(spark):
    python = static.nodes(spark.createDataFrame([("py", "def fact(n):\n    if n <= 1:\n        return 1\n    for i in range(n):\n        log(i)\n    return n * fact(n - 1)\n")], "program_id string, source string"))
    rows = languages.python_features(python).union(languages.java_features(spark.createDataFrame([("java", JAVA)], "program_id string, source string")))
    found = {r.program_id: tuple(r)[1:] for r in rows.collect()}
    assert found["py"] == (1, 1, 1, 3, 3, True, True, False) and found["java"] == (1, 1, 1, 2, 3, True, True, False)
    pairs = spark.createDataFrame([("1", "py", "java"), ("2", "py", "none")], PAIRS)
    alike = {r.pair_id: r.similarity for r in languages.feature_similarity(rows, pairs).collect()}
    assert alike == {"1": pytest.approx(0.6 * (1 - (1 / 3) / 5) + 0.4), "2": 0.5}


def test_java_program_traces(spark):
    lines = ["TRACE ENTER foo depth=1", "TRACE ENTER bar depth=2", "TRACE EXCEPTION bar depth=2 E", "TRACE ENTER bar depth=2"]
    df = spark.createDataFrame([("p", 0, 0, i, x) for i, x in enumerate(lines)], "program_id string, run_idx int, input_idx int, line_no int, value string")
    r = languages.java_program_traces(tables.java_traces(df)).first()
    assert (r.n_events, r.coverage, r.max_depth, r.exception) == (4, [1000, 2001], 2, "E")
