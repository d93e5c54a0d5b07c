"""Control flow and dependencies of Python sources: a small walker emits blocks, edges and facts, the comparing is grouping."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.measures import ratio
from traceloom.operators.distances import both_rows, kernels, relative_gap
from traceloom.operators.genomes import histogram
from traceloom.operators.sequences import PROGRAM

#: A block has tokens; an edge has a target and a kind (seq, true, false, loop, except).
FLOW = "program_id string, block int, tokens string, target int, edge string"
FACTS = "program_id string, function int, role string, name string, other string, depth int"


def token(node: ast.AST) -> str:
    return "<Name>" if isinstance(node, ast.Name) else "<Literal>" if isinstance(node, ast.Constant) else type(node).__name__


class Flow:
    """Blocks of straight-line statements and the edges between them."""

    def __init__(self, body: list[ast.stmt]):
        self.blocks: list[list[str]] = []
        self.edges: list[tuple[int, int, str]] = []
        self.follow(body, self.block())

    def block(self, *entered: tuple[int, str]) -> int:
        """A new block that the given blocks lead to."""
        self.blocks.append([])
        at = len(self.blocks) - 1
        self.edges += [(source, at, kind) for source, kind in entered]
        return at

    def follow(self, body: list[ast.stmt], at: int) -> int:
        """The block in which statements that begin in a block end."""
        for node in body:
            at = self.statement(node, at)
        return at

    def statement(self, node: ast.stmt, at: int) -> int:
        note = self.blocks[at].append
        match node:
            case ast.If():
                note("If")
                yes = self.follow(node.body, self.block((at, "true")))
                no = self.follow(node.orelse, self.block((at, "false")))
                return self.block((yes, "seq"), (no, "seq"))
            case ast.For() | ast.While() | ast.AsyncFor():
                note(type(node).__name__)
                self.edges.append((self.follow(node.body, self.block((at, "loop"))), at, "loop"))
                ends = [(self.follow(node.orelse, self.block((at, "false"))), "seq")] if node.orelse else []
                return self.block((at, "seq"), *ends)
            case ast.Try():
                note("Try")
                tried = self.follow(node.body, self.block((at, "seq")))
                ends = [tried]
                for handler in node.handlers:
                    entry = self.block((at, "except"))
                    self.blocks[entry].append("ExceptHandler")
                    ends.append(self.follow(handler.body, entry))
                if node.orelse:
                    ends.append(self.follow(node.orelse, self.block((tried, "seq"))))
                after = self.block(*[(end, "seq") for end in ends])
                return self.block((self.follow(node.finalbody, after), "seq")) if node.finalbody else after
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                note("ClassDef" if isinstance(node, ast.ClassDef) else "FunctionDef")
                self.follow(node.body, self.block())
                return at
            case ast.With() | ast.AsyncWith():
                note("With")
                return self.follow(node.body, at)
        for part in (node, *ast.iter_child_nodes(node)):
            note(token(part))
        return at


def names(nodes: list[ast.AST], loaded: bool) -> set[str]:
    """Identifiers below nodes; loaded: only those that are read."""
    return {n.id for node in nodes for n in ast.walk(node) if isinstance(n, ast.Name) and (not loaded or isinstance(n.ctx, ast.Load))}


def facts_of(body: list[ast.stmt]) -> Iterator[tuple[str, str | None, str | None, int]]:
    """(role, name, other, depth) of one function, without functions within: def and use of a name, call of a name with a name, assignment at a depth."""
    todo: list[tuple[ast.AST, int]] = [(s, 0) for s in body]
    while todo:
        node, depth = todo.pop()
        defined, used, deeper, inside = set(), set(), [], True
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                inside = False
            case ast.Assign():
                defined, used = names(node.targets, False), names([node.value], True)
            case ast.AugAssign():
                own = names([node.target], False) if isinstance(node.target, ast.Name) else set()
                defined, used, inside = own, own | names([node.value], True), False
            case ast.AnnAssign():
                inside = False
                if node.value is not None:
                    defined, used = names([node.target], False) if isinstance(node.target, ast.Name) else set(), names([node.value], True)
            case ast.For():
                defined, used, deeper, inside = names([node.target], False), names([node.iter], True), node.body + node.orelse, False
            case ast.If() | ast.While():
                used, deeper, inside = names([node.test], True), node.body + node.orelse, False
            case ast.Call(func=ast.Name(id=callee)) | ast.Call(func=ast.Attribute(attr=callee)):
                yield from (("call", callee, n, depth) for n in names(node.args, True))
        if isinstance(node, ast.Assign | ast.AugAssign) or isinstance(node, ast.AnnAssign) and node.value is not None:
            yield "assign", None, None, depth
        yield from (("def", n, None, depth) for n in defined)
        yield from (("use", n, None, depth) for n in used)
        todo += [(s, depth + 1) for s in deeper]
        if inside:
            todo += [(c, depth) for c in ast.iter_child_nodes(node)]


def parsed(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError):
        return None


def flow_rows(program_id: str, source: str | None) -> list[tuple]:
    """The control flow of a source; one that doesn't parse has none."""
    if (tree := parsed(source)) is None:
        return []
    flow = Flow(tree.body)
    return [(program_id, i, "/".join(t), None, None) for i, t in enumerate(flow.blocks)] + [(program_id, a, None, b, kind) for a, b, kind in flow.edges]


def fact_rows(program_id: str, source: str | None) -> list[tuple]:
    """The facts of all functions of a source, and of its statements outside; a function has a row of its own."""
    if (tree := parsed(source)) is None:
        return []
    bodies = [n.body for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    outside = [s for s in tree.body if not isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    rows = []
    for i, body in enumerate(bodies + ([outside] if outside else [])):
        rows.append((program_id, i, "function", None, None, 0))
        rows += [(program_id, i, *fact) for fact in facts_of(body)]
    return rows


def rows_of(sources: DataFrame, rows, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [r for p, s in zip(batch["program_id"], batch["source"], strict=True) for r in rows(p, s)]
            yield pd.DataFrame(found, columns=columns).convert_dtypes() if found else pd.DataFrame(columns=columns)

    return sources.select("program_id", "source").mapInPandas(run, schema)


def control_flow(sources: DataFrame) -> DataFrame:
    """Blocks and edges of program_id, source."""
    return rows_of(sources, flow_rows, FLOW)


def dependency_facts(sources: DataFrame) -> DataFrame:
    """Definitions, uses, calls and assignments of program_id, source."""
    return rows_of(sources, fact_rows, FACTS)


def padded(pairs: DataFrame, found: DataFrame, empty: dict[str, float]) -> DataFrame:
    """All pairs, with given values where nothing was found."""
    return pairs.select("pair_id").join(found, "pair_id", "left").na.fill(empty)


def block_similarity(flow: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, similarity: Jaccard of the sets of blocks, each by its tokens, without empty ones; 1 if both have none."""
    blocks = flow.where("tokens != ''").groupBy(PROGRAM, "tokens").agg(F.count("*").alias("n"))
    found = kernels(histogram(blocks, "blocks", "tokens", "n"), pairs).select("pair_id", (1 - F.col("jaccard")).alias("similarity"))
    return padded(pairs, found, {"similarity": 1.0})


def flow_similarity(flow: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, similarity: half the relative closeness of the numbers of blocks and edges, half the weighted Jaccard of the kinds of edges, 1 without edges."""
    edges = flow.where("edge IS NOT NULL").groupBy(PROGRAM, "edge").agg(F.count("*").alias("n"))
    alike = kernels(histogram(edges, "edges", "edge", "n"), pairs).select("pair_id", (1 - F.col("weighted")).alias("edges"))
    sizes = flow.groupBy(PROGRAM).agg(F.count("*").alias("n"))
    size = lambda s, key: sizes.select(F.col(PROGRAM).alias(key), F.col("n").alias(f"{s}_size"))
    rows = pairs.join(size("a", "left"), "left", "left").join(size("b", "right"), "right", "left").na.fill(0, ["a_size", "b_size"]).join(alike, "pair_id", "left")
    return rows.select("pair_id", (0.5 * (1 - relative_gap("size")) + 0.5 * F.coalesce("edges", F.lit(1.0))).alias("similarity"))


def dependency_edges(facts: DataFrame) -> DataFrame:
    """program_id, edge: each name defined in a function with each name used in it, over all functions."""
    side = lambda role, name: facts.where(F.col("role") == role).select(PROGRAM, "function", F.col("name").alias(name)).distinct()
    pairs = side("def", "d").join(side("use", "u"), [PROGRAM, "function"])
    return pairs.select(PROGRAM, F.concat_ws("→", "d", "u").alias("edge")).distinct()


def dependency_features(facts: DataFrame) -> DataFrame:
    """program_id, ratio (mean share of definitions among a function's names), depth (mean greatest depth of its assignments), edges, calls (distinct callee and argument)."""
    distinct = lambda role: F.count_distinct(F.when(F.col("role") == role, F.col("name")))
    each = facts.groupBy(PROGRAM, "function").agg(distinct("def").alias("d"), distinct("use").alias("u"), F.max(F.when(F.col("role") == "assign", F.col("depth")).otherwise(0)).alias("depth"))
    means = each.groupBy(PROGRAM).agg(F.avg(ratio(F.col("d"), F.col("d") + F.col("u"))).alias("ratio"), F.avg("depth").alias("depth"))
    edges = dependency_edges(facts).groupBy(PROGRAM).agg(F.count("*").alias("edges"))
    calls = facts.where("role = 'call'").groupBy(PROGRAM).agg(F.count_distinct("name", "other").alias("calls"))
    return means.join(edges, PROGRAM, "left").join(calls, PROGRAM, "left").na.fill(0)


def dependency_similarity(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, similarity: half 1 - the mean gap of four features over the greater, half the Jaccard of the edges, 1 if both have none."""
    graph = kernels(histogram(dependency_edges(facts).withColumn("n", F.lit(1)), "edges", "edge", "n"), pairs).select("pair_id", (1 - F.col("jaccard")).alias("graph"))
    rows = both_rows(pairs, dependency_features(facts)).join(graph, "pair_id", "left")
    gaps = sum((relative_gap(c, 1e-9) for c in ("ratio", "depth", "edges", "calls")), F.lit(0.0))
    return rows.select("pair_id", (0.5 * (1 - gaps / 4) + 0.5 * F.coalesce("graph", F.lit(1.0))).alias("similarity"))
