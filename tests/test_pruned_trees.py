"""Node tables hold what a query reads, and programs share batches."""

import hashlib

import pyarrow as pa
import pytest

from traceloom.operators import identity, lexer, sequences, static
from traceloom.plans import registry


def test_programs_share_batches_of_nodes():
    batch = pa.RecordBatch.from_pydict({"program_id": [f"p{i}" for i in range(40)], "source": ["f(x)\n"] * 38 + [None, "def ("]})
    whole = list(static.node_batches([batch], list(static.COLUMNS), None))
    assert len(whole) == 1 and whole[0].num_rows == 38 * 7 + 1
    calls = list(static.node_batches([batch], ["program_id", "name"], frozenset(["Call"])))
    assert [b.to_pydict() for b in calls] == [{"program_id": [f"p{i}" for i in range(38)], "name": ["f"] * 38}]


#: Columns that each query reads of the node table, beside program_id, and some kind of node that it doesn't.
READ = {
    "source_calls": (["kind", "name", "function"], "Constant"),
    "source_data": (["kind", "detail", "extra"], "Call"),
    "source_errors": (["kind", "name", "detail", "extra", "path", "in_handler"], "Call"),
    "node_type_similarity": (["kind"], None),
    "static_dimensions": (["kind", "name", "function", "detail", "extra", "path", "in_handler"], "Name"),
    "function_fingerprints": (["kind", "name", "detail", "path", "top", "nested", "loops", "callee", "body"], "Name"),
}


@pytest.mark.parametrize("name", READ)
def test_queries_parse_for_what_they_read(spark, sf_dir, monkeypatch, name):
    asked, nodes = [], static.nodes

    def pruned(sources, columns=static.COLUMNS, kinds=None):
        asked.append((columns, kinds))
        return nodes(sources, columns, kinds)

    monkeypatch.setattr(static, "nodes", pruned)
    found = sorted(map(repr, registry.queries()[name](spark, sf_dir).collect()))
    columns, unread = READ[name]
    assert [sorted(c) for c, _ in asked] == [sorted(columns)] and (unread is None or unread not in asked[0][1])
    monkeypatch.setattr(static, "nodes", lambda sources, *_: nodes(sources))
    assert found == sorted(map(repr, registry.queries()[name](spark, sf_dir).collect()))


def test_fixed_keys_meet_without_a_long_table(spark):
    sources = [("p", "x = 1 + 2.5\ny = [None, 'a' in 'ab']\n"), ("q", "x = 1 * 2\n"), ("e", "")]
    tree = static.nodes(spark.createDataFrame(sources, "program_id string, source string"), ["kind", "detail", "extra"], static.DATA_KINDS)
    pairs = spark.createDataFrame([("1", "p", "q"), ("2", "p", "p"), ("3", "e", "e"), ("4", "e", "p")], "pair_id string, left string, right string")
    rows = static.data_distance(tree, pairs)
    assert "Generate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    found = {r.pair_id: r.distance for r in rows.collect()}
    assert found["2"] == 0.0 and found["3"] == 0.0 and 0 < found["1"] < 1 and 0 < found["4"] < 1


def test_fingerprints_take_one_shuffle(spark):
    source = "def f(x, y=1):\n    def g():\n        return f(x) + h(y) + len([y])\n    for i in x:\n        while i: pass\n\ndef h(x):\n    pass\n\ndef h(x):\n    f(f)(x)\n\nclass C:\n    def f(self): h(1)\n"
    tree = static.nodes(spark.createDataFrame([("p", source)], "program_id string, source string"))
    prints = identity.fingerprints(tree)
    assert prints._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    f, empty, h = prints.orderBy("top").collect()
    assert (f.recursive_calls, f.module_calls, f.params, f.has_defaults, f.has_nested_loop, f.builtin_calls, f.literal_types) == (1, 2, 2, True, True, "len", "int,list")
    assert (empty.module_calls, h.module_calls, h.recursive_calls, h.literal_types) == (0, 1, 0, "")
    assert empty.body_hash == hashlib.sha256(b"Pass").hexdigest()[:8]
    assert {tuple(r) for r in identity.module_calls(tree).collect()} == {("p", 0, 0, 1), ("p", 0, 2, 1), ("p", 2, 0, 1)}


SOURCES = ['"""Doc."""\ndef f(x):\n    "doc"\n    return x\n\nclass C:\n    \'c\'\n    async def g(self): "d"\n', "def f(x):\n    return [y for y in x if y]\n", "x = f'{x!r}' + 'a'\nif x: pass\nelse: y()", "def f(", None, ""]


def test_linear_texts_are_linearised_trees(spark):
    sources = spark.createDataFrame([(f"p{i}", s) for i, s in enumerate(SOURCES)], "program_id string, source string")
    names = {character: c.__name__ for c, character in static.CHARACTERS.items()}
    texts_ = static.linear_texts(sources)
    lists = static.linearised(static.nodes(sources))
    assert {r.program_id: [names[c] for c in r.kinds] for r in texts_.collect()} == {r.program_id: r.kinds for r in lists.collect()}
    pairs = spark.createDataFrame([(f"{a}{b}", f"p{a}", f"p{b}") for a in range(6) for b in range(a, 6)], "pair_id string, left string, right string")
    for cap in (None, 5):
        rows = static.linear_similarity(texts_, pairs, cap)
        assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in static.linear_similarity(lists, pairs, cap).collect()}
    assert rows.rdd.getNumPartitions() == 4


def test_token_sets_are_token_lists_without_repeats(spark):
    sources = spark.createDataFrame([(f"p{i}", s) for i, s in enumerate([*SOURCES, "if X is None or x is True: x = (1"])], "program_id string, source string")
    for kinds in (("name", "number", "operator", "string"), ("name", "keyword")):
        sets = lexer.token_sets(sources, kinds)
        assert "Exchange" not in sets._jdf.queryExecution().executedPlan().toString()
        whole = lexer.token_lists(lexer.tokens(sources), kinds)
        assert {r.doc_id: r.tokens for r in sets.collect()} == {r.doc_id: list(dict.fromkeys(r.tokens)) for r in whole.collect()}


def test_two_dimensions_need_neither_traces_nor_other_families(spark, sf_dir, monkeypatch):
    def never(*_):
        raise AssertionError

    for name in ("in_traces", "in_programs"):
        monkeypatch.setattr(sequences, name, never)
    assert registry.queries()["distance_of_two_dimensions"](spark, sf_dir).count() > 0


def test_the_next_event_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(sequences, "CHUNK", 3)
    rows = [(p, 0, 0, i, "call" if i % 2 else "return", f"{p}{i}") for p, n in (("a", 8), ("b", 3), ("c", 1), ("d", 7)) for i in range(n)]
    events = spark.createDataFrame(rows, "program_id string, run_idx int, input_idx int, seq int, event_type string, function_name string")
    found = {(r.program_id, r.seq): (r.next_type, r.next_name) for r in sequences.with_next(events).collect()}
    kinds = {(p, i): (t, f) for p, _, _, i, t, f in rows}
    assert found == {(p, i): kinds.get((p, i + 1), (None, None)) for p, i in kinds}
    whole = sequences.in_traces(events).select("program_id", "seq", "next_type", "next_name").collect()
    assert found == {(r.program_id, r.seq): (r.next_type, r.next_name) for r in whole}
