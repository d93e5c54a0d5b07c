"""A registry of dimensions: what each compares, so that any subset is planned once over shared tables.

A dimension names the parts of its distance: measures of histogram families, scalars of programs whose gaps count, or a distance on the node
table of its own. ``distances_of`` collects what the wanted ones need: families are counted in one pass, dealt to the pairs in one join and compared
in one grouping, scalars are joined once, and what no dimension asks for isn't computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators import genomes, sequences, states, static
from traceloom.operators.distances import V1_WEIGHTS, both_rows, combined, gap, relative_gap, wide_kernels
from traceloom.operators.sequences import PROGRAM


@dataclass(frozen=True)
class Inputs:
    """What programs are described by; a table that isn't there leaves out the dimensions that need it. tree: the node table of ``static.nodes``; counted: ``genomes.occurrences`` that are there already."""

    pairs: DataFrame
    events: DataFrame | None = None
    traces: DataFrame | None = None
    tree: DataFrame | None = None
    counted: DataFrame | None = None


@dataclass(frozen=True)
class Dimension:
    """measures: name of a part -> (family, measure of ``distances.kernels``). scalars: columns of programs. combine: parts and gaps to a distance. distance: on the node table instead."""

    name: str
    measures: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    scalars: frozenset[str] = frozenset()
    combine: Callable[[], Column] | None = None
    distance: Callable[[DataFrame, DataFrame], DataFrame] | None = None

    def possible(self, inputs: Inputs) -> bool:
        return inputs.tree is not None if self.distance else inputs.events is not None and inputs.traces is not None


def time_gap() -> Column:
    """Distance of the vectors of times, relative to the greater of each, over its greatest."""
    squares = reduce(lambda a, b: a + b, [F.pow(relative_gap(n, 1e-12), 2) for n in ("time_mean", "time_std", "time_min", "time_max")])
    return F.least(F.sqrt(squares) / 2, F.lit(1.0))


def half(a: Column, b: Column) -> Column:
    return 0.5 * a + 0.5 * b


TIMES = frozenset({"time_mean", "time_std", "time_min", "time_max", "exception_rate"})
REGISTRY: dict[str, Dimension] = {}


def register(dimension: Dimension) -> Dimension:
    """Add a dimension, or replace one of its name."""
    REGISTRY[dimension.name] = dimension
    return dimension


for each in (
    Dimension("CONTROL", distance=static.control_distance),
    Dimension("DATA", distance=static.data_distance),
    Dimension("ERROR", distance=static.error_distance),
    Dimension("EXECUTION", {"lines": ("lines", "jaccard"), "names": ("names", "l1")}, combine=lambda: half(F.col("lines"), F.col("names"))),
    Dimension("STATE", {"depths": ("depths", "l2"), "types": ("types", "jaccard")}, frozenset({"mutation_rate"}), lambda: (gap("mutation_rate") + F.col("depths") + F.col("types")) / 3),
    Dimension("RESOURCE", {}, TIMES, lambda: half(time_gap(), gap("exception_rate"))),
    Dimension("TEMPORAL", {"grams": ("event_bigrams", "jaccard"), "timing": ("timing", "l1")}, combine=lambda: half(F.col("grams"), F.col("timing"))),
    Dimension("INTERACTION", {"outputs": ("outputs", "jsd"), "patterns": ("patterns", "jaccard")}, combine=lambda: half(F.col("outputs"), F.col("patterns"))),
):
    register(each)

#: Families that events or traces have besides those counted in one pass.
FAMILIES: dict[str, Callable[[Inputs], DataFrame]] = {
    "lines": lambda i: genomes.histogram(genomes.coverage_lines(i.traces), "lines", "line", "n"),
    "timing": lambda i: genomes.histogram(sequences.phase_timing(i.events), "timing", "function_name", "share"),
    "types": lambda i: genomes.histogram(states.heap_types(i.events), "types", "type", "n"),
    "outputs": lambda i: genomes.histogram(genomes.output_histogram(i.traces), "outputs", "category", "n"),
    "patterns": lambda i: genomes.histogram(genomes.call_patterns(i.events), "patterns", "pattern", "n"),
}
SCALARS: dict[str, Callable[[Inputs], DataFrame]] = {
    "trace": lambda i: i.traces.groupBy(PROGRAM).agg(
        F.avg(F.col("exception").isNotNull().cast("int")).alias("exception_rate"), F.avg("execution_time_ms").alias("time_mean"), F.stddev_pop("execution_time_ms").alias("time_std"),
        F.min("execution_time_ms").alias("time_min"), F.max("execution_time_ms").alias("time_max"),
    ),
    "state": lambda i: states.state_summary(i.events).select(PROGRAM, "mutation_rate"),
}
SCALAR_OF = {**dict.fromkeys(TIMES, "trace"), "mutation_rate": "state"}


def families_of(wanted: Iterable[Dimension]) -> set[str]:
    return {family for d in wanted for family, _ in d.measures.values()}


def distances_of(inputs: Inputs, only: Iterable[str] | None = None) -> DataFrame:
    """pair_id and a column for each dimension wanted that the inputs allow, in the registry's order; all of them if ``only`` isn't given."""
    names = set(REGISTRY if only is None else only)
    if unknown := names - set(REGISTRY):
        raise ValueError(f"no such dimension: {sorted(unknown)}")
    wanted = [d for d in REGISTRY.values() if d.name in names and d.possible(inputs)]
    live, own = [d for d in wanted if d.combine], [d for d in wanted if d.distance]
    rows = inputs.pairs
    if scalars := {SCALAR_OF[s] for d in live for s in d.scalars}:
        rows = both_rows(rows, genomes.joined([SCALARS[s](inputs) for s in sorted(scalars)]))
    if families := families_of(live):
        counted = families & set(genomes.COUNTED)
        found = [FAMILIES[f](inputs) for f in sorted(families - counted)]
        if counted:
            ready = genomes.occurrences(inputs.events, counted) if inputs.counted is None else genomes.of_families(inputs.counted, *counted)
            found.append(genomes.weighted_occurrences(ready))
        told = wide_kernels(reduce(DataFrame.union, found), inputs.pairs, {part: m for d in live for part, m in d.measures.items()})
        rows = rows.join(told, "pair_id")
    rows = rows.select("pair_id", *[d.combine().alias(d.name) for d in live])
    for d in own:
        rows = rows.join(d.distance(inputs.tree, inputs.pairs).select("pair_id", F.col("distance").alias(d.name)), "pair_id", "left")
    return rows.select("pair_id", *[d.name for d in wanted])


def distance_of(inputs: Inputs, only: Iterable[str] | None = None, weights: Mapping[str, float] = V1_WEIGHTS) -> DataFrame:
    """pair_id, distance over the dimensions wanted that the inputs allow, their weights shared anew; a pair lacks no dimension that others have, but counts a missing value as 0."""
    found = distances_of(inputs, only)
    return combined(found.na.fill(0.0, [c for c in found.columns if c != "pair_id"]), weights)
