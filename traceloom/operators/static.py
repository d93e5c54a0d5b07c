"""Static features of Python sources: one small parser emits a node table, all the rest is grouping."""

from __future__ import annotations

import ast
from collections.abc import Callable, Collection, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.measures import clamp, entropy_parts, ratio
from traceloom.operators.distances import both_rows, gap, met, relative_gap
from traceloom.operators.genomes import histogram
from traceloom.sources.staging import dealt

PROGRAM = "program_id"
NODES = (
    "program_id string, node_id int, parent_id int, kind string, name string, function string, control_depth int, extra int, "
    "detail string, path string, top int, in_body boolean, nested int, loops int, in_handler int, level int, docstring boolean, callee int, body string"
)
TYPES = dict(c.split() for c in NODES.split(", "))
COLUMNS = tuple(TYPES)
ARROW = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[t] for t in TYPES.values()]
#: Rows of a batch of nodes, at least, but for the last one.
ROWS = 50_000
LOOPS = ("For", "AsyncFor", "While")
BRANCHES = (*LOOPS, "If", "Try", "TryStar")
FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")
DOCUMENTED = ("Module", *FUNCTIONS, "ClassDef")
#: What counts as control in a function's fingerprint.
CONTROL = ("If", "For", "While", "Try", "ExceptHandler", "With", "AsyncFor", "AsyncWith")
COMPREHENSIONS = ("ListComp", "SetComp", "DictComp", "GeneratorExp")


def exception_name(node: ast.AST) -> str:
    """The name of an exception in a raise or a handler: the last part of a dotted one, the called one, several joined; empty if it has none."""
    if isinstance(node, ast.Tuple):
        return ", ".join(filter(None, map(exception_name, node.elts)))
    if isinstance(node, ast.Call):
        return exception_name(node.func)
    return getattr(node, "id", None) or getattr(node, "attr", None) or ""


def signature(node: ast.AST) -> tuple[str | None, int, str | None]:
    a = node.args
    told = (len(a.args) + len(a.posonlyargs) + len(a.kwonlyargs), int(bool(a.defaults or a.kw_defaults)), int(a.vararg is not None or a.kwarg is not None))
    return node.name, 0, ",".join(map(str, told))


def called(node: ast.AST) -> tuple[str | None, int, str | None]:
    match node.func:
        case ast.Name(id=name):
            return name, 0, "name"
        case ast.Attribute(attr=name):
            return name, 0, "attribute"
    return "<expr>", 0, "expression"


def returned(node: ast.AST) -> tuple[str | None, int, str | None]:
    if node.value is None:
        return None, 0, "bare"
    return None, 0, "none" if isinstance(node.value, ast.Constant) and node.value.value is None else "value"


def operator(node: ast.AST) -> tuple[str | None, int, str | None]:
    return None, 0, type(node.op).__name__


#: A node's name (function, called name, identifier, exception), a count (operands beyond the first, filters, whether there is a value or a finally) and a detail (type of a constant, operators, form of a call, return or signature). Other kinds have none of these.
DESCRIBED: dict[type, Callable[[ast.AST], tuple[str | None, int, str | None]]] = {
    ast.FunctionDef: signature, ast.AsyncFunctionDef: signature, ast.ClassDef: lambda n: (n.name, 0, None), ast.Call: called,
    ast.BoolOp: lambda n: (type(n.op).__name__, len(n.values) - 1, None), ast.comprehension: lambda n: (None, len(n.ifs), None),
    ast.ExceptHandler: lambda n: ((exception_name(n.type) if n.type else None), 0, None), ast.Raise: lambda n: ((exception_name(n.exc) if n.exc else "<re-raise>"), 0, None),
    ast.Constant: lambda n: (None, 0, type(n.value).__name__), ast.BinOp: operator, ast.AugAssign: operator,
    ast.Compare: lambda n: (None, 0, ",".join(type(op).__name__ for op in n.ops)), ast.Return: returned,
    ast.AnnAssign: lambda n: (None, int(n.value is not None), None), ast.Try: lambda n: (None, int(bool(n.finalbody)), None), ast.Name: lambda n: (n.id, 0, None),
}
PLAIN = (None, 0, None)


def is_text(node: ast.AST) -> bool:
    return isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)


def parsed(source: str | None) -> ast.Module | None:
    """The tree of a source; one that doesn't parse has none."""
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError):
        return None


#: Classes of nodes that no other node can be below, but for a name's context.
LEAVES = frozenset(c for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST) and not c._fields) | {ast.Name, ast.Constant}


def unread(columns: Collection[str], kinds: Collection[str] | None) -> frozenset[type]:
    """The leaves that need not be visited, if neither they nor the numbers of nodes nor the kinds in bodies are read."""
    if kinds is None or {"node_id", "parent_id", "body"} & {*columns}:
        return frozenset()
    contexts = {"Load", "Store", "Del"} & {*kinds}
    return frozenset(c for c in LEAVES if c.__name__ not in kinds and not (c is ast.Name and contexts))


def node_rows(program_id: str | int, source: str | None, kinds: frozenset[str] | None = None, passed: Collection[type] = ()) -> list[tuple]:
    """The nodes of a source in preorder, or those of some kinds; a source that doesn't parse has none. passed: leaves that aren't visited, nor numbered.

    What encloses a node is told to all children of one field at once: parent, function, path of functions, top-level function, whether in its body, depths of control, nesting, loops and handlers, level, whether in a docstring.
    callee: of a call by plain name, the place of the module's function of that name, of several the last. body: of a module's function, the kinds of the nodes in its body, in order; it is told if functions of both kinds are among the kinds.
    """
    tree = parsed(source)
    if tree is None:
        return []
    rows, todo, tops, number = [], [(tree, (-1, "<module>", "", None, False, 0, 0, 0, 0, 0, False))], 0, 0
    places = {f.name: i for i, f in enumerate(f for f in tree.body if type(f).__name__ in FUNCTIONS)}
    heads, bodies = [], []
    while todo:
        node, (parent, function, path, top, in_body, control, nested, loops, handlers, level, docstring) = todo.pop()
        cls = type(node)
        kind = cls.__name__
        own = kind in FUNCTIONS
        own_top = own and parent == 0
        if own_top:
            top, nested, loops, tops = tops, 0, 0, tops + 1
            heads.append(len(rows))
            bodies.append([])
        elif in_body:
            bodies[top].append(kind)
        if kind in CONTROL:
            nested, loops = nested + 1, loops + (kind in LOOPS)
        if kinds is None or kind in kinds:
            describe = DESCRIBED.get(cls)
            name, extra, detail = describe(node) if describe else PLAIN
            callee = places.get(name) if detail == "name" and cls is ast.Call else None
            rows.append((program_id, number, parent, kind, name, function, control, extra, detail, path, top, in_body, nested, loops, handlers, level, docstring, callee, None))
        if fields := cls._fields:
            if own:
                function, path = node.name, f"{path}/{node.name}"
            control += kind in BRANCHES
            level += 1
            around = (number, function, path, top, in_body, control, nested, loops, handlers, level, docstring)
            children = []
            for field in fields:
                value = getattr(node, field, None)
                if isinstance(value, ast.AST):
                    if type(value) not in passed:
                        children.append((value, around))
                elif value and isinstance(value, list):
                    into = around
                    if field == "body" and (own_top or kind == "ExceptHandler"):
                        into = (number, function, path, top, True if own_top else in_body, control, nested, loops, handlers + (not own_top), level, docstring)
                    told = [(c, into) for c in value if isinstance(c, ast.AST) and type(c) not in passed]
                    if field == "body" and kind in DOCUMENTED and is_text(value[0]) and told[0][0] is value[0]:
                        told[0] = (value[0], (*into[:-1], True))
                    children += told
            children.reverse()
            todo += children
        number += 1
    if kinds is None or kinds.issuperset(FUNCTIONS):
        for at, body in zip(heads, bodies, strict=True):
            rows[at] = (*rows[at][:-1], "/".join(body))
    return rows


def node_batches(batches: Iterable[pa.RecordBatch], kept: list[str], kinds: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """The nodes of batches of program_id, source. Programs share batches of ROWS nodes or a little more, so that a program costs what its nodes do."""
    places, passed = [COLUMNS.index(c) for c in kept], unread(kept, kinds)

    def table(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        told = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(told[0], pa.int64())) if i == 0 else pa.array(told[i], ARROW[i]) for i in places], kept)

    for batch in batches:
        ids, rows = batch.column(PROGRAM), []
        for place, source in enumerate(batch.column("source")):
            rows += node_rows(place, source.as_py(), kinds, passed)
            if len(rows) >= ROWS:
                yield table(ids, rows)
                rows = []
        if rows:
            yield table(ids, rows)


def nodes(sources: DataFrame, columns: Collection[str] = COLUMNS, kinds: Iterable[str] | None = None) -> DataFrame:
    """The node table of program_id, source, or those of its columns and kinds of nodes that are read.

    Every tree has one ``Module``: with it among the kinds, no program that parses is left out.
    """
    wanted, kept = None if kinds is None else frozenset(kinds), [c for c in COLUMNS if c in columns or c == PROGRAM]
    rows = sources.select(F.col(PROGRAM).cast("string"), F.col("source").cast("string"))
    return rows.mapInArrow(lambda batches: node_batches(batches, kept, wanted), ", ".join(f"{c} {TYPES[c]}" for c in kept))


#: Kinds of nodes that the features of control, besides calls, are about; ``Module`` stands for programs without any other.
CONTROL_KINDS = ("Module", *BRANCHES, "IfExp", "BoolOp", "comprehension")


def branch_profile(tree: DataFrame) -> DataFrame:
    """program_id, kind, share of the branching statements."""
    counts = tree.where(F.col("kind").isin(*BRANCHES)).groupBy(PROGRAM, "kind").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(PROGRAM)))


def call_edges(tree: DataFrame) -> DataFrame:
    """program_id, caller, callee, n."""
    return tree.where("kind = 'Call'").groupBy(PROGRAM, F.col("function").alias("caller"), F.col("name").alias("callee")).agg(F.count("*").alias("n"))


def loop_nesting(tree: DataFrame) -> DataFrame:
    """program_id, depth, n: loops by the number of control statements around them, themselves included."""
    return tree.where(F.col("kind").isin(*LOOPS)).groupBy(PROGRAM, (F.col("control_depth") + 1).alias("depth")).agg(F.count("*").alias("n"))


def control_summary(tree: DataFrame) -> DataFrame:
    """program_id, complexity (predicates plus one), branch_entropy in bits."""
    predicate = F.when(F.col("kind").isin(*BRANCHES, "IfExp"), 1).when(F.col("kind").isin("BoolOp", "comprehension"), F.col("extra")).otherwise(0)
    sums = tree.groupBy(PROGRAM).agg((F.sum(predicate) + 1).alias("complexity"))
    bits = branch_profile(tree).groupBy(PROGRAM).agg(F.sum(entropy_parts(F.col("share"), F.lit(1.0))).alias("bits"))
    return sums.join(bits, PROGRAM, "left").select(PROGRAM, "complexity", F.coalesce("bits", F.lit(0.0)).alias("branch_entropy"))


#: The keys of the histograms of data; an operator's name in the tree, if it is another.
VALUE_TYPES = {"int": "int", "str": "str", "float": "float", "bool": "bool", "None": "NoneType"}
ARITHMETIC = {"Add": "Add", "Sub": "Sub", "Mul": "Mult", "Div": "Div", "Mod": "Mod", "FloorDiv": "FloorDiv", "Pow": "Pow"}
COMPARISONS = ("Eq", "NotEq", "Lt", "LtE", "Gt", "GtE", "In", "NotIn")
CONTAINERS = {"list": ("List", "ListComp"), "dict": ("Dict", "DictComp"), "set": ("Set", "SetComp"), "tuple": ("Tuple",)}
ASSIGNMENTS = ("Assign", "AugAssign")
STATEMENTS = (
    *ASSIGNMENTS, "AnnAssign", "Expr", "Return", "Delete", "Pass", "Break", "Continue", "Raise", "Assert", "Import", "ImportFrom", "If", "For", "While", "With", "Try", "FunctionDef", "AsyncFunctionDef", "ClassDef",
    "Global", "Nonlocal",
)


#: Kinds of nodes that the features of data are about.
DATA_KINDS = ("Module", "Constant", "BinOp", "Compare", *(k for kinds in CONTAINERS.values() for k in kinds), *STATEMENTS)


def data_features(tree: DataFrame) -> DataFrame:
    """program_id, flow (share of assignments among the statements) and a count for each key of the data histograms, ``<family>:<key>``."""
    kind, detail = F.col("kind"), F.col("detail")
    count = lambda c: F.sum(c.cast("long"))
    compared = lambda op: F.size(F.filter(F.split("detail", ","), lambda x: x == op))
    assigned = kind.isin(*ASSIGNMENTS) | ((kind == "AnnAssign") & (F.col("extra") == 1))
    return tree.groupBy(PROGRAM).agg(
        ratio(count(assigned), count(kind.isin(*STATEMENTS))).alias("flow"),
        *[count((kind == "Constant") & (detail == t)).alias(f"types:{key}") for key, t in VALUE_TYPES.items()],
        *[count(kind.isin("BinOp", "AugAssign") & (detail == op)).alias(f"arithmetic:{key}") for key, op in ARITHMETIC.items()],
        *[F.sum(F.when(kind == "Compare", compared(op)).otherwise(0)).cast("long").alias(f"comparisons:{op}") for op in COMPARISONS],
        *[count(kind.isin(*kinds)).alias(f"containers:{key}") for key, kinds in CONTAINERS.items()],
    )


def root_divergence(a: list[Column], b: list[Column]) -> Column:
    """Root of the base-2 divergence of two histograms over fixed keys; an empty side is uniform over them."""
    total = lambda side: F.aggregate(F.array(*side), F.lit(0.0), lambda s, x: s + x)
    shares = lambda side: F.transform(F.array(*side), lambda x: F.when(total(side) > 0, x / total(side)).otherwise(1 / len(side)))
    part = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)
    parts = F.zip_with(shares(a), shares(b), lambda p, q: part(p, q) + part(q, p))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))


def data_distance(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, distance: mean of the root divergences of types, arithmetic, comparisons and containers, of half the L1 of the constants' shares, and of the gap of flow.

    Constants are the scalar types without None. Keys are fixed, so both sides meet in one row.
    """
    features = data_features(tree)
    rows = both_rows(pairs, features)
    side = lambda s, keys: [F.col(f"`{s}_{c}`").cast("double") for c in keys]
    of = lambda family: [c for c in features.columns if c.startswith(f"{family}:")]
    roots = sum((root_divergence(side("a", of(f)), side("b", of(f))) for f in ("types", "arithmetic", "comparisons", "containers")), F.lit(0.0))
    scalars = [c for c in of("types") if c != "types:None"]
    shares = lambda s: [ratio(x, sum(side(s, scalars), F.lit(0.0))) for x in side(s, scalars)]
    l1 = F.least(F.lit(1.0), sum((F.abs(x - y) for x, y in zip(shares("a"), shares("b"), strict=True)), F.lit(0.0)) / 2)
    return rows.select("pair_id", ((roots + l1 + gap("flow")) / 6).alias("distance"))


#: Kinds of nodes that the features of errors are about.
ERROR_KINDS = ("Module", "Try", "TryStar", "ExceptHandler", "Raise", "Assert", "Return", *FUNCTIONS)


def error_summary(tree: DataFrame) -> DataFrame:
    """program_id, counts of try statements, handlers, bare handlers, raises, finally clauses and assertions; the sets raised and caught; the pattern by which handlers go on; the share of functions with a try.

    pattern: raise, return_none, return_sentinel, mixed, or none. Functions are told apart by their path of names.
    """
    kind, name = F.col("kind"), F.col("name")
    count = lambda c: F.sum(c.cast("long"))
    any_of = lambda c: F.coalesce(F.max((c & (F.col("in_handler") > 0)).cast("int")), F.lit(0))
    names = lambda c: F.array_sort(F.collect_set(F.when(c & (name != ""), name)))
    tried = kind.isin("Try", "TryStar")
    rows = tree.groupBy(PROGRAM).agg(
        count(tried).alias("tries"), count(kind == "ExceptHandler").alias("handlers"), count((kind == "ExceptHandler") & name.isNull()).alias("bare_handlers"), count(kind == "Raise").alias("raises"),
        count((kind == "Try") & (F.col("extra") == 1)).alias("finals"), count(kind == "Assert").alias("assertions"), names(kind == "Raise").alias("raised"), names(kind == "ExceptHandler").alias("caught"),
        any_of(kind == "Raise").alias("r"), any_of((kind == "Return") & F.col("detail").isin("bare", "none")).alias("n"), any_of((kind == "Return") & (F.col("detail") == "value")).alias("s"),
        count(kind.isin(*FUNCTIONS)).alias("functions"), F.size(F.collect_set(F.when(tried & (F.col("path") != ""), F.col("path")))).alias("covered"),
    )
    pattern = F.when(F.col("r") + F.col("n") + F.col("s") > 1, "mixed").when(F.col("r") == 1, "raise").when(F.col("n") == 1, "return_none").when(F.col("s") == 1, "return_sentinel").otherwise("none")
    return rows.withColumn("pattern", pattern).withColumn("coverage", ratio(F.col("covered"), F.col("functions"))).drop("r", "n", "s", "functions", "covered")


def error_distance(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, distance: 0.4 of the Jaccard distance of all exceptions named, 0.3 of the mean relative gap of six counts, 0.3 if the patterns differ."""
    features = error_summary(tree).withColumn("named", F.array_union("raised", "caught")).withColumn("n_raised", F.size("raised")).withColumn("n_caught", F.size("caught"))
    rows = both_rows(pairs, features)
    union = F.size(F.array_union("a_named", "b_named"))
    jaccard = F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect("a_named", "b_named")) / union)
    counts = sum((relative_gap(c) for c in ("bare_handlers", "tries", "finals", "assertions", "n_raised", "n_caught")), F.lit(0.0)) / 6
    return rows.select("pair_id", clamp(0.4 * jaccard + 0.3 * counts + 0.3 * (F.col("a_pattern") != F.col("b_pattern")).cast("int")).alias("distance"))


def canonical_data(features: DataFrame) -> DataFrame:
    """Data features in canonical form: counts not below 0, flow between 0 and 1 with four digits, columns by name."""
    counts = sorted(c for c in features.columns if ":" in c)
    return features.select(PROGRAM, F.round(clamp(F.col("flow")), 4).alias("flow"), *[F.greatest(F.lit(0), F.col(f"`{c}`")).alias(c) for c in counts])


def canonical_errors(features: DataFrame) -> DataFrame:
    """Error features in canonical form: sorted distinct names, counts not below 0, coverage between 0 and 1."""
    counts = [c for c, t in features.dtypes if t == "bigint"]
    kept = {"raised": F.array_sort(F.array_distinct("raised")), "caught": F.array_sort(F.array_distinct("caught")), "coverage": clamp(F.col("coverage"))} | {c: F.greatest(F.lit(0), F.col(c)) for c in counts}
    return features.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in features.columns])


def control_distance(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, distance: half the branch profiles' distance and half that of the call edges as sets."""
    edge = F.concat_ws("→", "caller", "callee")
    told = histogram(branch_profile(tree), "branches", "kind", "share").union(histogram(call_edges(tree).withColumn("edge", edge), "edges", "edge", "n"))
    branch, both = F.col("family") == "branches", (F.col("a") > 0) & (F.col("b") > 0)
    found = met(told, pairs).groupBy("pair_id").agg(
        F.least(F.lit(1.0), F.sum(F.when(branch, F.abs(F.col("a") - F.col("b")))) / 2).alias("branches"), (1 - F.sum(F.when(~branch, both.cast("int"))) / F.sum(F.when(~branch, 1))).alias("edges")
    )
    rows = pairs.select("pair_id").join(found, "pair_id", "left").na.fill(0.0)
    return rows.select("pair_id", (0.5 * F.col("branches") + 0.5 * F.col("edges")).alias("distance"))


def node_type_similarity(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, similarity: half the Jaccard similarity of the node kinds, half 1 - L1 of their counts over all nodes."""
    counts = tree.groupBy(PROGRAM, "kind").agg(F.count("*").alias("n"))
    rows = met(histogram(counts, "kinds", "kind", "n"), pairs)
    alike = F.sum(((F.col("a") > 0) & (F.col("b") > 0)).cast("int")) / F.count("*")
    l1 = F.sum(F.abs(F.col("a") - F.col("b"))) / F.sum(F.col("a") + F.col("b"))
    return rows.groupBy("pair_id").agg((0.5 * alike + 0.5 * (1 - l1)).alias("similarity"))


def linearised(tree: DataFrame) -> DataFrame:
    """program_id, kinds: the kinds of a program's nodes level by level, from left to right, without docstrings."""
    held = F.array_sort(F.collect_list(F.struct("level", "node_id", "kind")))
    return tree.where(~F.col("docstring")).groupBy(PROGRAM).agg(F.transform(held, lambda n: n["kind"]).alias("kinds"))


def linear_texts(sources: DataFrame) -> DataFrame:
    """program_id, kinds: what ``linearised`` tells of a source, as a text of one character a node, in one row a source; kinds have the characters of their places among all of Python's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, tree) for i, x in enumerate(batch.column("source")) if (tree := parsed(x.as_py())) is not None]
            yield pa.RecordBatch.from_arrays([batch.column(PROGRAM).take(pa.array([i for i, _ in found], pa.int64())), pa.array([linear_text(tree) for _, tree in found], pa.string())], [PROGRAM, "kinds"])

    return sources.select(F.col(PROGRAM).cast("string"), F.col("source").cast("string")).mapInArrow(run, f"{PROGRAM} string, kinds string")


#: A character for each class of nodes; the first is that of code point 256.
CHARACTERS = {c: chr(256 + i) for i, c in enumerate(sorted((c for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST)), key=lambda c: c.__name__))}


def linear_text(tree: ast.Module) -> str:
    """The classes of a tree's nodes level by level, from left to right, without docstrings, as characters."""
    told, row = [], [tree]
    while row:
        told += [CHARACTERS[type(n)] for n in row]
        after = []
        for node in row:
            documented = type(node).__name__ in DOCUMENTED
            for field in node._fields:
                value = getattr(node, field, None)
                if isinstance(value, ast.AST):
                    after.append(value)
                elif value and isinstance(value, list):
                    after += [c for c in (value[1:] if documented and field == "body" and is_text(value[0]) else value) if isinstance(c, ast.AST)]
        row = after
    return "".join(told)


def tree_edit_similarity(tree: DataFrame, pairs: DataFrame, cap: int | None = None) -> DataFrame:
    """pair_id, similarity: 1 - edit distance of the linearised trees over the longer one's length; 1 if both are empty. cap: compare the first so many nodes only, as a limited tool would."""
    return linear_similarity(linearised(tree), pairs, cap)


def linear_similarity(kinds: DataFrame, pairs: DataFrame, cap: int | None = None) -> DataFrame:
    """``tree_edit_similarity`` of trees that are linearised already, by ``linearised`` or ``linear_texts``."""
    from traceloom.operators.texts import token_edit_similarity

    side = lambda name, key: kinds.select(F.col(PROGRAM).alias(key), F.col("kinds").alias(name))
    text = dict(kinds.dtypes)["kinds"] == "string"
    none = F.lit("") if text else F.array().cast("array<string>")
    rows = pairs.join(side("a", "left"), "left", "left").join(side("b", "right"), "right", "left")
    return dealt(rows).select("pair_id", token_edit_similarity(F.coalesce("a", none), F.coalesce("b", none), cap, text).alias("similarity"))
