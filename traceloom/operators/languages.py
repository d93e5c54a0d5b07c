"""Programs of different languages: neutral features of Python and Java sources, their likeness, and traces of Java programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators.distances import relative_gap
from traceloom.operators.sequences import PROGRAM, with_index
from traceloom.operators.static import FUNCTIONS, LOOPS
from traceloom.sources.traces import TRACE

NUMBERS = ("n_functions", "n_loops", "n_conditions", "n_calls", "complexity")
FLAGS = ("recursion", "returns", "exceptions")
#: Patterns that stand in for a parser of Java.
METHOD = r"(?:public|private|protected|static|final)\s+[\w\[\]<>]+\s+(\w+)\s*\("
LOOP, CONDITION, CALL, RETURN = r"\b(?:for|while)\s*\(", r"\bif\s*\(", r"(\w+)\s*\(", r"\breturn\b"
KEYWORDS = ("if", "while", "for", "switch", "catch")
#: The likeness of a pair one of whose sources has no features.
NEUTRAL = 0.5


def python_features(tree: DataFrame) -> DataFrame:
    """program_id, numbers and flags from the node table: functions, loops, conditions, calls, complexity; recursion by name, returns, handlers."""
    kind, name = F.col("kind"), F.col("name")
    count = lambda c: F.sum(c.cast("long"))
    names = lambda c: F.collect_set(F.when(c, name))
    rows = tree.groupBy(PROGRAM).agg(
        count(kind.isin(*FUNCTIONS)).alias("n_functions"), count(kind.isin(*LOOPS)).alias("n_loops"), count(kind == "If").alias("n_conditions"), count(kind == "Call").alias("n_calls"), count(kind == "ExceptHandler").alias("handlers"),
        count(kind == "Return").alias("r"), F.arrays_overlap(names(kind.isin(*FUNCTIONS)), names((kind == "Call") & (F.col("detail") == "name"))).alias("recursion"),
    )
    complexity = 1 + F.col("n_loops") + F.col("n_conditions") + F.col("handlers")
    return rows.select(PROGRAM, "n_functions", "n_loops", "n_conditions", "n_calls", complexity.alias("complexity"), "recursion", (F.col("r") > 0).alias("returns"), (F.col("handlers") > 0).alias("exceptions"))


def java_features(sources: DataFrame) -> DataFrame:
    """The same of program_id, source in Java, by patterns; calls are distinct names, and any handler or throw counts once."""
    found = lambda pattern: F.regexp_count("source", F.lit(pattern)).cast("long")
    methods = F.regexp_extract_all("source", F.lit(METHOD), F.lit(1))
    calls = F.array_except(F.array_distinct(F.regexp_extract_all("source", F.lit(CALL), F.lit(1))), F.array(*map(F.lit, KEYWORDS)))
    thrown = F.contains("source", F.lit("catch")) | F.contains("source", F.lit("throw"))
    rows = sources.where("source IS NOT NULL").select(PROGRAM, F.size(methods).cast("long").alias("n_functions"), found(LOOP).alias("n_loops"), found(CONDITION).alias("n_conditions"), F.size(calls).cast("long").alias("n_calls"), F.arrays_overlap(methods, calls).alias("recursion"), F.col("source").rlike(RETURN).alias("returns"), thrown.alias("exceptions"))
    return rows.select(PROGRAM, "n_functions", "n_loops", "n_conditions", "n_calls", (1 + F.col("n_loops") + F.col("n_conditions") + F.col("exceptions").cast("int")).alias("complexity"), "recursion", "returns", "exceptions")


def feature_similarity(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, similarity: 0.6 of the mean closeness of the numbers, 0.4 of the share of equal flags; neutral if a side has no features."""
    side = lambda s, key: features.select(F.col(PROGRAM).alias(key), *[F.col(c).alias(f"{s}_{c}") for c in (*NUMBERS, *FLAGS)])
    rows = pairs.join(side("a", "left"), "left", "left").join(side("b", "right"), "right", "left")
    numbers = 1 - sum((relative_gap(c) for c in NUMBERS), F.lit(0.0)) / len(NUMBERS)
    flags = sum(((F.col(f"a_{c}") == F.col(f"b_{c}")).cast("int") for c in FLAGS), F.lit(0)) / len(FLAGS)
    return rows.select("pair_id", F.coalesce(0.6 * numbers + 0.4 * flags, F.lit(NEUTRAL)).alias("similarity"))


def java_program_traces(events: DataFrame) -> DataFrame:
    """One row a trace of Java events (with depth and exception_type): coverage, n_events, max_depth, exception.

    There are no lines; a call's depth and the anonymous index of its method, ``depth * 1000 + idx``, stand for one.
    """
    line = F.when(F.col("event_type") == "call", (F.col("depth") * 1000 + F.col("idx")).cast("long"))
    raised: Column = F.max(F.when(F.col("event_type") == "exception", F.struct("seq", "exception_type")))
    return with_index(events).groupBy(*TRACE).agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set(line)).alias("coverage"), F.max(F.when(F.col("event_type") == "call", F.col("depth")).otherwise(0)).alias("max_depth"), raised["exception_type"].alias("exception"))
