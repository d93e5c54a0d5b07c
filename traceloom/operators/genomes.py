"""Feature bundles of programs: one wide row of scalars, and histograms in one long table.

A histogram row is (program_id, family, key, weight). Distances need nothing else.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.measures import entropy_parts, normalised_entropy, ratio
from traceloom.functions.reprs import exception_class, output_category, type_name
from traceloom.operators import sequences, states
from traceloom.operators.sequences import PROGRAM
from traceloom.sources.traces import TRACE

NEIGHBOURS = 5


def coverage_lines(traces: DataFrame) -> DataFrame:
    return traces.select(PROGRAM, F.explode("coverage").alias("line")).groupBy(PROGRAM, "line").agg(F.count("*").alias("n"))


def coverage_consistency(traces: DataFrame) -> DataFrame:
    """Mean Jaccard similarity of each trace's lines with those of the next NEIGHBOURS traces; 1 for a lone trace."""
    order = Window.partitionBy(PROGRAM).orderBy("run_idx", "input_idx")
    placed = traces.select(PROGRAM, "coverage", (F.row_number().over(order) - 1).alias("at"))
    near = placed.select(PROGRAM, F.col("coverage").alias("mine"), F.explode(F.sequence(F.col("at") + 1, F.col("at") + NEIGHBOURS)).alias("at"))
    union = F.size(F.array_union("mine", "coverage"))
    alike = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("mine", "coverage")) / F.when(union != 0, union))
    means = near.join(placed, [PROGRAM, "at"]).groupBy(PROGRAM).agg(F.avg(alike).alias("mean"))
    return traces.select(PROGRAM).distinct().join(means, PROGRAM, "left").select(PROGRAM, F.coalesce("mean", F.lit(1.0)).alias("coverage_consistency"))


def ordered_traces(events: DataFrame, traces: DataFrame) -> DataFrame:
    """The traces with what ``sequences.trace_order`` tells of them."""
    return traces if "n_calls" in traces.columns else traces.join(sequences.trace_order(events), TRACE)


def trace_signatures(events: DataFrame, traces: DataFrame) -> DataFrame:
    """program_id, signature, n: hashes of a trace's lines, number of calls and exception class."""
    told = F.concat_ws("|", F.array_join(F.col("coverage").cast("array<string>"), ","), F.col("n_calls").cast("string"), F.coalesce(exception_class(F.col("exception")), F.lit("")))
    return ordered_traces(events, traces).groupBy(PROGRAM, F.substring(F.md5(told), 1, 8).alias("signature")).agg(F.count("*").alias("n"))


def hot_path_stability(events: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Share of the traces that begin with the most common first three calls; a trace without a call counts. order: of ``sequences.trace_order``."""
    paths = sequences.trace_order(events) if order is None else order
    return paths.groupBy(PROGRAM, "path").agg(F.count("*").alias("n")).groupBy(PROGRAM).agg((F.max("n") / F.sum("n")).alias("hot_path_stability"))


def exception_causality(events: DataFrame, traces: DataFrame) -> DataFrame:
    """program_id, causality_hash: of the sorted (function, exception class, depth) of all exception events."""
    told = sequences.in_traces(events).where("event_type = 'exception'").select(*TRACE, F.coalesce("idx", F.lit(-1)).alias("fn"), "depth")
    told = told.join(traces.where("exception IS NOT NULL").select(*TRACE, exception_class(F.col("exception")).alias("class")), TRACE)
    tuples = F.array_sort(F.collect_list(F.struct("fn", "class", "depth")))
    joined = F.array_join(F.transform(tuples, lambda t: F.concat_ws(":", t["fn"].cast("string"), t["class"], t["depth"].cast("string"))), "|")
    hashes = told.groupBy(PROGRAM).agg(F.substring(F.sha2(joined, 256), 1, 16).alias("hash"))
    none = F.substring(F.sha2(F.lit("no_exceptions"), 256), 1, 16)
    return traces.select(PROGRAM).distinct().join(hashes, PROGRAM, "left").select(PROGRAM, F.coalesce("hash", none).alias("causality_hash"))


def joined(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, PROGRAM, "left"), frames)


def trace_scalars(events: DataFrame, traces: DataFrame) -> DataFrame:
    """The scalars of the output-free genomes: coverage, exceptions, depth, lengths, times."""
    std = lambda c: F.stddev_pop(c)
    sums = traces.groupBy(PROGRAM).agg(
        F.count("*").alias("n_traces"), F.avg(F.col("exception").isNotNull().cast("int")).alias("exception_rate"), F.avg(F.col("truncated").cast("int")).alias("truncated_rate"),
        F.avg("n_events").alias("length_mean"), std("n_events").alias("length_std"), F.min("n_events").alias("length_min"), F.max("n_events").alias("length_max"),
        F.avg("execution_time_ms").alias("time_mean"), std("execution_time_ms").alias("time_std"), F.min("execution_time_ms").alias("time_min"), F.max("execution_time_ms").alias("time_max"),
    )
    lines = coverage_lines(traces).groupBy(PROGRAM).agg(F.count("*").alias("coverage_size"))
    depths = traces if "max_depth" in traces.columns else sequences.trace_depths(events)
    deep = depths.groupBy(PROGRAM).agg(F.avg("max_depth").alias("depth_mean"), F.max("max_depth").alias("depth_max"), F.var_pop("max_depth").alias("depth_variance"))
    found = joined([sums, lines, deep, coverage_consistency(traces)])
    return found.withColumn("coverage_size", F.coalesce("coverage_size", F.lit(0)))


def ordered_scalars(events: DataFrame, traces: DataFrame) -> DataFrame:
    """The scalars that the third genome adds: input sensitivity, stability, causality."""
    sensitivity = sequences.diversity(trace_signatures(events, traces), [PROGRAM], "input_sensitivity")
    return joined([sensitivity, hot_path_stability(events, traces if "path" in traces.columns else None), exception_causality(events, traces)])


#: Families of histograms that follow from an event and what stands around it.
COUNTED = ("calls", "bigrams", "flat2", "trigrams", "triples", "runs", "phases", "names", "event_bigrams", "depths")
#: Families whose weights are shares of the program's total; others keep their counts.
SHARED = ("calls", "bigrams", "flat2", "trigrams", "phase0", "phase1", "phase2", "names", "depths")


def occurrences(events: DataFrame, families: Iterable[str] = COUNTED) -> DataFrame:
    """program_id, family, key, n, total: every key of the families, how often it occurs, and the sum of what occurrences weigh, in one pass.

    calls, bigrams: of a trace; flat2, trigrams: across traces; phases: families phase0 to phase2, of the calls in each third; runs: of calls, weighing their lengths.
    """
    wanted = set(families)
    around = sequences.with_next if wanted <= {"names", "event_bigrams"} else sequences.in_programs if wanted & {"flat2", "trigrams", "triples", "runs", "phases"} else sequences.in_traces
    rows = around(events)
    if "triples" in wanted:
        rows = rows.withColumn("post", sequences.post()).withColumn("raised", F.col("function_name"))
    call = sequences.is_call()
    keys: dict[str, tuple[Column, Column]] = {}
    add = lambda family, key, name=None: keys.update({family: (F.lit(family) if name is None else name, key)}) if family in wanted else None
    add("calls", F.when(call, F.col("idx")))
    for family, n, by_trace in (("bigrams", 2, True), ("flat2", 2, False), ("trigrams", 3, False)):
        if family in wanted:
            add(family, F.when(call, sequences.gram(n, by_trace)))
    if "triples" in wanted:
        add("triples", F.when(F.col("event_type") == "exception", sequences.bracketed("pre", "raised", "post")))
    if "runs" in wanted:
        add("runs", F.when(F.col("run_length").isNotNull(), F.col("idx")))
    if "phases" in wanted:
        add("phases", F.when(call, F.col("idx")), F.concat(F.lit("phase"), sequences.phase().cast("string")))
    add("names", F.when(call, F.col("function_name")))
    add("event_bigrams", sequences.event_gram())
    add("depths", F.col("depth"))
    weight = lambda family: F.col("run_length") if family == "runs" else F.lit(1).cast("long")
    told = [F.when(key.isNotNull(), F.struct(name.alias("family"), key.cast("string").alias("key"), weight(family).alias("weight"))) for family, (name, key) in keys.items()]
    rows = rows.select(PROGRAM, F.explode(F.array_compact(F.array(*told))).alias("o")).select(PROGRAM, "o.*")
    return rows.groupBy(PROGRAM, "family", "key").agg(F.count("*").alias("n"), F.sum("weight").alias("total"))


def weighted_occurrences(counted: DataFrame) -> DataFrame:
    """Histogram rows of ``occurrences``: shares, mean lengths of runs, or counts."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(PROGRAM, "family"))
    weight = F.when(F.col("family").isin(*SHARED), share).when(F.col("family") == "runs", F.col("total") / F.col("n")).otherwise(F.col("n").cast("double"))
    return counted.select(PROGRAM, "family", "key", weight.alias("weight"))


def family_entropies(counted: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """program_id and the normalised entropy of each named family; null where a program lacks it."""
    rows = sequences.diversity(counted.where(F.col("family").isin(*names)), [PROGRAM, "family"], "h")
    return rows.groupBy(PROGRAM).agg(*[F.max(F.when(F.col("family") == f, F.col("h"))).alias(name) for f, name in names.items()])


def run_scalars(events: DataFrame) -> DataFrame:
    """program_id, recovery_rate (null without an exception), loop_score: in one pass."""
    rows = sequences.in_programs(events)
    raised = F.when(F.col("event_type") == "exception", sequences.recovered().cast("int"))
    spread = F.when(F.count("run_length") < 2, 0.0).otherwise(ratio(F.stddev_pop("run_length"), F.avg("run_length")))
    return rows.groupBy(PROGRAM).agg(F.avg(raised).alias("recovery_rate"), spread.alias("loop_score"))


TEMPORAL_ENTROPIES = {"flat2": "bigram_entropy", "trigrams": "trigram_entropy", "phase0": "phase0", "phase1": "phase1", "phase2": "phase2"}


def temporal_scalars(events: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """The scalars of the fifth, temporal genome: gram entropies, recovery, phases, loops."""
    counted = occurrences(events, ("flat2", "trigrams", "phases")) if counted is None else counted
    return joined([run_scalars(events), family_entropies(counted, TEMPORAL_ENTROPIES)]).na.fill(0.0)


def histogram(rows: DataFrame, family: str, key: str, weight: str) -> DataFrame:
    return rows.select(PROGRAM, F.lit(family).alias("family"), F.col(key).cast("string").alias("key"), F.col(weight).cast("double").alias("weight"))


def exception_classes(traces: DataFrame) -> DataFrame:
    """program_id, class, n of the traces that end in an exception."""
    return traces.where("exception IS NOT NULL").groupBy(PROGRAM, exception_class(F.col("exception")).alias("class")).agg(F.count("*").alias("n"))


def of_families(counted: DataFrame, *families: str) -> DataFrame:
    return counted.where(F.col("family").isin(*families))


def call_histograms(events: DataFrame, traces: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Families calls, bigrams and exceptions (of the output-free genomes). counted: ``occurrences`` that are there already."""
    counted = occurrences(events, ("calls", "bigrams")) if counted is None else of_families(counted, "calls", "bigrams")
    return weighted_occurrences(counted).union(histogram(exception_classes(traces), "exceptions", "class", "n"))


def temporal_histograms(events: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Families trigrams, triples, causal and runs of the temporal genome."""
    counted = occurrences(events, ("trigrams", "triples", "runs")) if counted is None else of_families(counted, "trigrams", "triples", "runs")
    causal = sequences.precedence(events).where("p > 0.5").select(PROGRAM, sequences.bracketed("i", "j").alias("pair"), F.lit(1).alias("n"))
    return weighted_occurrences(counted).union(histogram(causal, "causal", "pair", "n"))


def state_histograms(events: DataFrame) -> DataFrame:
    """Family transitions, with raw counts."""
    key = F.concat_ws("|", F.col("func_idx").cast("string"), "pre", "kind", "post")
    return histogram(states.state_transitions(events).withColumn("key", key), "transitions", "key", "n")


def first_histograms(events: DataFrame, traces: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Families of the first genomes: lines, names, event_bigrams, timing, depths, types, outputs, patterns."""
    own = ("names", "event_bigrams", "depths")
    counted = occurrences(events, own) if counted is None else of_families(counted, *own)
    return reduce(DataFrame.union, [
        weighted_occurrences(counted), histogram(coverage_lines(traces), "lines", "line", "n"), histogram(sequences.phase_timing(events), "timing", "function_name", "share"),
        histogram(states.heap_types(events), "types", "type", "n"), histogram(output_histogram(traces), "outputs", "category", "n"), histogram(call_patterns(events), "patterns", "pattern", "n"),
    ])


def output_histogram(traces: DataFrame) -> DataFrame:
    """program_id, category, n: output categories of the traces. Only the interaction genome looks at outputs."""
    return traces.groupBy(PROGRAM, output_category(F.col("return_repr"), F.col("exception")).alias("category")).agg(F.count("*").alias("n"))


def output_types(traces: DataFrame) -> DataFrame:
    return traces.groupBy(PROGRAM, type_name(F.col("return_repr")).alias("type")).agg(F.count("*").alias("n"))


def io_signature(traces: DataFrame) -> DataFrame:
    """program_id, io_signature: hash of the sorted category counts."""
    told = F.array_sort(F.collect_list(F.concat_ws(":", "category", F.col("n").cast("string"))))
    return output_histogram(traces).groupBy(PROGRAM).agg(F.substring(F.sha2(F.array_join(told, "|"), 256), 1, 16).alias("io_signature"))


def call_patterns(events: DataFrame, top: int = 10) -> DataFrame:
    """program_id, pattern, n: the most frequent whole call sequences of traces."""
    calls = events.where("event_type = 'call'").groupBy(*TRACE).agg(F.array_sort(F.collect_list(F.struct("seq", "function_name"))).alias("calls"))
    counts = calls.groupBy(PROGRAM, F.array_join(F.transform("calls", lambda c: c["function_name"]), "|").alias("pattern")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(PROGRAM).orderBy(F.desc("n"), "pattern"))).where(F.col("rank") <= top).drop("rank")


def temporal_entropy(events: DataFrame) -> DataFrame:
    """Entropy of the event types, in nats."""
    counts = events.groupBy(PROGRAM, "event_type").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(PROGRAM))
    return counts.withColumn("nats", -p * F.log(p)).groupBy(PROGRAM).agg(F.sum("nats").alias("temporal_entropy"))


def volume(events: DataFrame, traces: DataFrame) -> DataFrame:
    """How much a program does, for shortcut checks: events, calls, functions, exceptions, time."""
    counts = events.groupBy(PROGRAM).agg(
        F.count("*").alias("n_events"), F.sum((F.col("event_type") == "call").cast("long")).alias("n_calls"),
        F.count_distinct(F.when(F.col("event_type") == "call", F.col("function_name"))).alias("n_functions"), F.avg((F.col("event_type") == "exception").cast("int")).alias("exception_fraction"),
    )
    return joined([counts, traces.groupBy(PROGRAM).agg(F.sum("execution_time_ms").alias("wall_ms"))])


def noise_floor(per_run: DataFrame, keys: list[str], value: str, limit: float = 0.10, sample: bool = False) -> DataFrame:
    """Mean, spread and coefficient of variation of a feature over runs, and whether it is noisy.

    sample: divide by n - 1.
    """
    spread = F.stddev_samp(value) if sample else F.stddev_pop(value)
    rows = per_run.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(spread, F.lit(0.0)).alias("std"))
    cv = F.when(F.col("mean") == 0, 0.0).otherwise(F.col("std") / F.abs("mean"))
    return rows.withColumn("cv", cv).withColumn("noisy", F.col("cv") > limit)


def shannon(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Entropy of the counts ``n`` in bits."""
    total = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    parts = counts.withColumn("bits", entropy_parts(F.col("n"), total))
    return parts.groupBy(*keys).agg(F.sum("bits").alias(name), normalised_entropy(F.sum("bits"), F.count("*")).alias(f"{name}_normalised"))
