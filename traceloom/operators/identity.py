"""Functions without their names: fingerprints from the node table, their likeness, greedy matching, and a program's root."""

from __future__ import annotations

import builtins

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators.sequences import PROGRAM
from traceloom.operators.static import COMPREHENSIONS, CONTROL, FUNCTIONS, LOOPS

#: Weights of the parts of a fingerprint's likeness.
EXACT = {"body_hash": 4.0, "literal_types": 1.5, "builtin_calls": 1.5, "has_return_value": 1.0, "has_defaults": 0.5, "has_varargs": 0.5, "has_loop": 1.0, "has_nested_loop": 1.0, "has_handler": 1.0}
RELATIVE = {"params": 2.0, "branches": 2.0, "nesting_depth": 1.5, "comprehensions": 1.5, "recursive_calls": 1.0, "module_calls": 1.0}
LITERALS = {"List": "list", "Dict": "dict", "Set": "set", "Tuple": "tuple"}
#: Fixed value: the least likeness of matched functions.
LEAST = 0.4


def top_functions(tree: DataFrame) -> DataFrame:
    """program_id, top, function, signature of the functions of a module, in order."""
    return tree.where(F.col("kind").isin(*FUNCTIONS) & (F.col("parent_id") == 0)).select(PROGRAM, "top", F.col("name").alias("function"), F.split("detail", ",").alias("signature"))


def module_calls(tree: DataFrame) -> DataFrame:
    """program_id, caller, callee, n: calls by plain name of functions of the module, by their places; of two functions of one name the last is meant."""
    return tree.where("callee IS NOT NULL AND top IS NOT NULL").groupBy(PROGRAM, F.col("top").alias("caller"), "callee").agg(F.count("*").alias("n"))


#: Kinds of nodes that fingerprints are about, besides the kinds in a function's body, which its own node tells.
PRINTED = (*FUNCTIONS, *CONTROL, *COMPREHENSIONS, *LITERALS, "Return", "Call", "Constant")


def fingerprints(tree: DataFrame) -> DataFrame:
    """program_id, top and fifteen features of each function of a module that renaming leaves as they are, in one grouping."""
    kind, name = F.col("kind"), F.col("name")
    some = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)) == 1
    count = lambda c: F.sum(c.cast("long"))
    csv = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    literal = F.when(kind == "Constant", F.col("detail"))
    for node, told in LITERALS.items():
        literal = literal.when(kind == node, told)
    called = F.when((kind == "Call") & name.isin(*dir(builtins)), name)
    # the path of a node begins with the function of the module that it is in
    own = F.split_part("path", F.lit("/"), F.lit(2))
    head = kind.isin(*FUNCTIONS) & (F.col("path") == "")
    rows = tree.where("top IS NOT NULL").groupBy(PROGRAM, "top").agg(
        some((kind == "Return") & (F.col("detail") != "bare")).alias("has_return_value"), count(kind.isin(*CONTROL)).alias("branches"), count((kind == "Call") & (F.col("detail") == "name") & (name == own)).alias("recursive_calls"),
        some(kind.isin(*LOOPS)).alias("has_loop"), some(kind.isin(*LOOPS) & (F.col("loops") > 1)).alias("has_nested_loop"), some(kind.isin("Try", "ExceptHandler")).alias("has_handler"), F.max("nested").alias("nesting_depth"),
        count(kind.isin(*COMPREHENSIONS)).alias("comprehensions"), csv(literal).alias("literal_types"), csv(called).alias("builtin_calls"), F.substring(F.sha2(F.max("body"), 256), 1, 8).alias("body_hash"),
        F.split(F.max(F.when(head, F.col("detail"))), ",").alias("signature"), F.count("callee").alias("module_calls"),
    )
    signature = lambda i: F.col("signature")[i].cast("int")
    told = {"params": signature(0), "has_defaults": signature(1) == 1, "has_varargs": signature(2) == 1}
    return rows.select(*[c for c in rows.columns if c not in ("signature", "module_calls")], *[c.alias(n) for n, c in told.items()], "module_calls")


def likeness(a: str = "a", b: str = "b") -> Column:
    """Weighted likeness of two fingerprints in columns a_* and b_*: exact parts are equal or not, counts relative to the greater."""
    of = lambda c: (F.col(f"{a}_{c}"), F.col(f"{b}_{c}"))
    total = F.lit(0.0)
    for c, w in EXACT.items():
        x, y = of(c)
        total = total + w * (x == y).cast("int")
    for c, w in RELATIVE.items():
        x, y = of(c)
        total = total + w * F.when(x == y, 1.0).otherwise(1 - F.abs(x - y) / F.greatest(x, y))
    return total / (sum(EXACT.values()) + sum(RELATIVE.values()))


def matched_functions(prints: DataFrame, pairs: DataFrame, least: float = LEAST) -> DataFrame:
    """pair_id, a, b, likeness: functions of both programs matched greedily, the most alike first, ties by their places. Programs are paired, not all functions."""
    side = lambda s, key: prints.select(F.col(PROGRAM).alias(key), F.col("top").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in (*EXACT, *RELATIVE)])
    tried = pairs.join(side("a", "left"), "left").join(side("b", "right"), "right").select("pair_id", "a", "b", likeness().alias("likeness")).where(F.col("likeness") >= least)

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        taken_a, taken_b, kept = set(), set(), []
        for r in rows.sort_values(["likeness", "a", "b"], ascending=[False, True, True]).itertuples():
            if r.a not in taken_a and r.b not in taken_b:
                taken_a.add(r.a)
                taken_b.add(r.b)
                kept.append((r.pair_id, r.a, r.b, r.likeness))
        return pd.DataFrame(kept, columns=["pair_id", "a", "b", "likeness"])

    kind = pairs.schema["pair_id"].dataType.simpleString()
    return tried.groupBy("pair_id").applyInPandas(match, f"pair_id {kind}, a int, b int, likeness double")


def call_roots(tree: DataFrame) -> DataFrame:
    """program_id, top of the functions of a module that no other function of it calls."""
    callees = module_calls(tree).where("caller != callee").select(PROGRAM, F.col("callee").alias("top"))
    return top_functions(tree).select(PROGRAM, "top").join(callees, [PROGRAM, "top"], "left_anti")


def program_identity(tree: DataFrame) -> DataFrame:
    """program_id, root, program_hash: the root is the function that no other calls, with the fewest branches, then the most parameters, then the first; 0 if all call each other."""
    prints = fingerprints(tree)
    hashes = prints.groupBy(PROGRAM).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("body_hash")), "|"), 256), 1, 16).alias("program_hash"))
    best = call_roots(tree).join(prints.select(PROGRAM, "top", "branches", "params"), [PROGRAM, "top"]).groupBy(PROGRAM).agg(F.min(F.struct("branches", (-F.col("params")).alias("p"), "top")).alias("best"))
    return hashes.join(best, PROGRAM, "left").select(PROGRAM, F.coalesce("best.top", F.lit(0)).alias("root"), "program_hash")
