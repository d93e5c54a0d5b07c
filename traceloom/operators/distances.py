"""Distances in [0, 1] between the programs of each pair.

pairs: pair_id, left, right. One join deals the histograms to the pairs, one grouping
meets both sides of each key, and one more yields every measure of every family. Two
empty histograms have distance 0; a family that neither side has yields no row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.measures import clamp
from traceloom.operators import genomes, states
from traceloom.operators.sequences import PROGRAM

#: Weights of the parts of each distance.
V2_WEIGHTS = {"coverage": 0.30, "calls": 0.30, "exception": 0.15, "depth": 0.15, "consistency": 0.10}
V3_WEIGHTS = {"coverage": 0.20, "bigrams": 0.25, "calls": 0.20, "exception": 0.10, "depth": 0.10, "consistency": 0.05, "sensitivity": 0.05, "causality": 0.05}
TEMPORAL_WEIGHTS = {"trigrams": 0.20, "entropy": 0.10, "triples": 0.10, "recovery": 0.15, "causal": 0.15, "phases": 0.10, "loops": 0.20}
V5_WEIGHTS = {"v3": 0.50, "temporal": 0.25, "state": 0.25}
V1_WEIGHTS = {"CONTROL": 0.20, "DATA": 0.15, "STATE": 0.15, "RESOURCE": 0.10, "TEMPORAL": 0.10, "ERROR": 0.10, "INTERACTION": 0.10, "EXECUTION": 0.10}


def sides(pairs: DataFrame) -> DataFrame:
    return pairs.select("pair_id", F.explode(F.array(F.struct(F.col("left").alias(PROGRAM), F.lit(0).alias("side")), F.struct(F.col("right").alias(PROGRAM), F.lit(1).alias("side")))).alias("s")).select("pair_id", "s.*")


def met(histograms: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, family, key, a, b: both sides' weights of each key, 0 where a side lacks it."""
    dealt = histograms.join(sides(pairs), PROGRAM)
    side = lambda i: F.sum(F.when(F.col("side") == i, F.col("weight")).otherwise(0.0))
    return dealt.groupBy("pair_id", "family", "key").agg(side(0).alias("a"), side(1).alias("b"))


def kernels(histograms: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, family, l1, l2, jaccard, weighted, cosine, jsd, scaled of each family that a side has.

    l1: half the L1 distance, at most 1. l2: L2 distance over the root of 2. jaccard: of the keys.
    weighted: 1 - sum of min over sum of max. cosine: similarity, 0 with an empty side.
    jsd: divergence of the shares over ln 2, an empty side counting as zeros. scaled: half the L1 distance over the greatest weight, or 1.
    """
    rows = met(histograms, pairs)
    total = rows.groupBy("pair_id", "family").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    shares = rows.join(total, ["pair_id", "family"])
    p, q = F.col("a") / F.greatest("ta", F.lit(1e-300)), F.col("b") / F.greatest("tb", F.lit(1e-300))
    part = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    jsd = F.sum((part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2) / F.log(F.lit(2.0))
    both, either = F.sum(((F.col("a") > 0) & (F.col("b") > 0)).cast("int")), F.count("*")
    norms = F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b")))
    return shares.groupBy("pair_id", "family").agg(
        F.least(F.lit(1.0), F.sum(F.abs(F.col("a") - F.col("b"))) / 2).alias("l1"),
        (F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))) / F.sqrt(F.lit(2.0))).alias("l2"),
        (1 - both / either).alias("jaccard"), (1 - F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("weighted"),
        F.when(norms == 0, 0.0).otherwise(F.sum(F.col("a") * F.col("b")) / norms).alias("cosine"), F.least(F.lit(1.0), jsd).alias("jsd"),
        (F.sum(F.abs(F.col("a") - F.col("b"))) / F.greatest(F.max("a"), F.max("b"), F.lit(1.0)) / 2).alias("scaled"),
    )


def rooted_jsd(histograms: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, family, jsd_root: root of the base-2 divergence; an empty side is uniform over the keys of both."""
    rows = met(histograms, pairs)
    total = rows.groupBy("pair_id", "family").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count("*").alias("keys"))
    share = lambda x, t: F.when(F.col(t) > 0, F.col(x) / F.col(t)).otherwise(1 / F.col("keys"))
    shares = rows.join(total, ["pair_id", "family"]).select("pair_id", "family", share("a", "ta").alias("p"), share("b", "tb").alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(0.0)
    return shares.groupBy("pair_id", "family").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum((part("p") + part("q")) / 2))).alias("jsd_root"))


def wide_kernels(histograms: DataFrame, pairs: DataFrame, wanted: Mapping[str, tuple[str, str]]) -> DataFrame:
    """pair_id and one column a wanted (family, measure); 0 where neither side has the family."""
    found = kernels(histograms, pairs).groupBy("pair_id").agg(*[F.max(F.when(F.col("family") == f, F.col(m))).alias(name) for name, (f, m) in wanted.items()])
    return pairs.select("pair_id").join(found, "pair_id", "left").na.fill(0.0)


def both_rows(pairs: DataFrame, scalars: DataFrame) -> DataFrame:
    """pairs with every scalar of the left program as a_<name> and of the right as b_<name>."""
    named = lambda side, key: scalars.select(F.col(PROGRAM).alias(key), *[F.col(c).alias(f"{side}_{c}") for c in scalars.columns if c != PROGRAM])
    return pairs.join(named("a", "left"), "left").join(named("b", "right"), "right")


def gap(name: str) -> Column:
    return F.abs(F.col(f"a_{name}") - F.col(f"b_{name}"))


def relative_gap(name: str, least: float = 1.0) -> Column:
    return gap(name) / F.greatest(F.col(f"a_{name}"), F.col(f"b_{name}"), F.lit(least))


def weighted(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted sum, clamped to [0, 1]."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * parts[name]
    return clamp(total)


def behaviour_parts(events: DataFrame, traces: DataFrame, pairs: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """pair_id and the parts of the second and third distance, before weights. counted: ``genomes.occurrences`` that are there already."""
    told = wide_kernels(genomes.call_histograms(events, traces, counted), pairs, {"calls": ("calls", "l1"), "bigrams": ("bigrams", "l1"), "classes": ("exceptions", "jaccard")})
    scalars = genomes.joined([genomes.trace_scalars(events, traces), genomes.ordered_scalars(events, traces)])
    rows = both_rows(pairs, scalars).join(told, "pair_id")
    return rows.select(
        "pair_id", relative_gap("coverage_size").alias("coverage"), "calls", "bigrams", (0.5 * F.col("classes") + 0.5 * gap("exception_rate")).alias("exception"),
        relative_gap("depth_mean").alias("depth"), gap("coverage_consistency").alias("consistency"), gap("input_sensitivity").alias("sensitivity"),
        F.when(F.col("a_causality_hash") == F.col("b_causality_hash"), 0.0).otherwise(1.0).alias("causality"),
    )


def of(names: Mapping[str, float]) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def distance_v2(parts: DataFrame) -> DataFrame:
    return parts.select("pair_id", weighted(of(V2_WEIGHTS), V2_WEIGHTS).alias("distance"))


def distance_v3(parts: DataFrame, weights: Mapping[str, float] = V3_WEIGHTS) -> DataFrame:
    """The third distance, or with other weights one of its ablations."""
    return parts.select("pair_id", weighted(of(weights), weights).alias("distance"))


def temporal_parts(events: DataFrame, pairs: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """pair_id and the parts of the temporal distance. counted: ``genomes.occurrences`` that are there already."""
    told = wide_kernels(genomes.temporal_histograms(events, counted), pairs, {"trigrams": ("trigrams", "l1"), "triples": ("triples", "jaccard"), "causal": ("causal", "jaccard"), "run_gap": ("runs", "scaled")})
    rows = both_rows(pairs, genomes.temporal_scalars(events, counted)).join(told, "pair_id")
    phases = gap("phase0") + gap("phase1") + gap("phase2")
    return rows.select(
        "pair_id", "trigrams", (0.5 * gap("bigram_entropy") + 0.5 * gap("trigram_entropy")).alias("entropy"), "triples", gap("recovery_rate").alias("recovery"), "causal",
        F.least(F.lit(1.0), phases / 2).alias("phases"), F.least(F.lit(1.0), 0.5 * F.least(F.lit(1.0), F.col("run_gap")) + 0.5 * relative_gap("loop_score")).alias("loops"),
    )


def distance_temporal(parts: DataFrame) -> DataFrame:
    return parts.select("pair_id", weighted(of(TEMPORAL_WEIGHTS), TEMPORAL_WEIGHTS).alias("distance"))


def distance_state(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Weighted Jaccard distance of the raw transition counts."""
    return wide_kernels(genomes.state_histograms(events), pairs, {"distance": ("transitions", "weighted")})


def distance_v5(events: DataFrame, traces: DataFrame, pairs: DataFrame, failed: float = 1.0, counted: DataFrame | None = None) -> DataFrame:
    """pair_id, v3, temporal, state, distance. A pair whose extraction failed has the distance ``failed``; the library form has 0.5."""
    frames = {"v3": distance_v3(behaviour_parts(events, traces, pairs, counted)), "temporal": distance_temporal(temporal_parts(events, pairs, counted)), "state": distance_state(events, pairs)}
    rows = pairs.select("pair_id")
    for name, frame in frames.items():
        rows = rows.join(frame.withColumnRenamed("distance", name), "pair_id", "left")
    whole = weighted({"v3": F.col("v3"), "temporal": F.coalesce("temporal", "v3"), "state": F.coalesce("state", "v3")}, V5_WEIGHTS)
    return rows.withColumn("distance", F.when(F.col("v3").isNull(), failed).otherwise(whole))


def first_distances(events: DataFrame, traces: DataFrame, pairs: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """pair_id and the first distances of the five dynamic dimensions: EXECUTION, STATE, RESOURCE, TEMPORAL, INTERACTION."""
    told = wide_kernels(genomes.first_histograms(events, traces, counted), pairs, {
        "lines": ("lines", "jaccard"), "names": ("names", "l1"), "grams": ("event_bigrams", "jaccard"), "timing": ("timing", "l1"), "depths": ("depths", "l2"),
        "types": ("types", "jaccard"), "outputs": ("outputs", "jsd"), "patterns": ("patterns", "jaccard"),
    })
    scalars = genomes.joined([genomes.trace_scalars(events, traces), states.state_summary(events)])
    rows = both_rows(pairs, scalars).join(told, "pair_id")
    squares = F.lit(0.0)
    for name in ("time_mean", "time_std", "time_min", "time_max"):
        squares = squares + F.pow(relative_gap(name, 1e-12), 2)
    return rows.select(
        "pair_id", (0.5 * F.col("lines") + 0.5 * F.col("names")).alias("EXECUTION"), ((gap("mutation_rate") + F.col("depths") + F.col("types")) / 3).alias("STATE"),
        (0.5 * F.least(F.sqrt(squares) / 2, F.lit(1.0)) + 0.5 * gap("exception_rate")).alias("RESOURCE"), (0.5 * F.col("grams") + 0.5 * F.col("timing")).alias("TEMPORAL"),
        (0.5 * F.col("outputs") + 0.5 * F.col("patterns")).alias("INTERACTION"),
    )


def combined(dimensions: DataFrame, weights: Mapping[str, float] = V1_WEIGHTS, only: list[str] | None = None) -> DataFrame:
    """pair_id, distance: weights shared anew among the dimensions that are there; 0 if none is."""
    present = [d for d in weights if d in dimensions.columns and (only is None or d in only)]
    total = sum(weights[d] for d in present)
    if not present or total <= 0:
        return dimensions.select("pair_id", F.lit(0.0).alias("distance"))
    return dimensions.select("pair_id", weighted({d: clamp(F.col(d)) for d in present}, {d: weights[d] / total for d in present}).alias("distance"))


def hybrid(static: DataFrame, dynamic: DataFrame, w_static: float = 0.4, w_dynamic: float = 0.6) -> DataFrame:
    """Weighted mean of two distance tables; a pair without a static distance has the dynamic one."""
    rows = dynamic.join(static.select("pair_id", F.col("distance").alias("static")), "pair_id", "left")
    mean = (w_static * F.col("static") + w_dynamic * F.col("distance")) / (w_static + w_dynamic)
    return rows.select("pair_id", clamp(F.coalesce(mean, F.col("distance"))).alias("distance"))


def ablations(parts: DataFrame, weights: Mapping[str, float] = V3_WEIGHTS) -> DataFrame:
    """pair_id, config, distance: the full distance, each part alone, and each part left out with the rest shared anew."""
    configs = {"full": dict(weights)} | {f"only_{n}": {n: 1.0} for n in weights}
    configs |= {f"without_{n}": {m: w / (1 - weights[n]) for m, w in weights.items() if m != n} for n in weights}
    told = F.array(*[F.struct(F.lit(name).alias("config"), weighted(of(w), w).alias("distance")) for name, w in configs.items()])
    return parts.select("pair_id", F.explode(told).alias("c")).select("pair_id", "c.*")


SHORTCUT_WEIGHTS = {"wall_ms": 0.30, "n_calls": 0.30, "n_functions": 0.25, "exception_fraction": 0.15}


def shortcut_similarity(volumes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, one 1 / (1 + gap) a volume measure, and their weighted sum: what mere size tells."""
    rows = both_rows(pairs, volumes.select(PROGRAM, *SHORTCUT_WEIGHTS))
    alike = {n: 1 / (1 + gap(n)) for n in SHORTCUT_WEIGHTS}
    return rows.select("pair_id", *[c.alias(n) for n, c in alike.items()], weighted(alike, SHORTCUT_WEIGHTS).alias("similarity"))


def trace_similarity(events: DataFrame, traces: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, similarity: mean of the similarities of named calls, lines, return types and exceptions. It looks at outputs."""
    names = genomes.weighted_occurrences(genomes.occurrences(events, ["names"])).union(genomes.histogram(genomes.coverage_lines(traces), "lines", "line", "n"))
    types = genomes.output_types(traces)
    types = types.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(PROGRAM)))
    classes = genomes.histogram(genomes.exception_classes(traces), "exceptions", "class", "n")
    told = names.union(genomes.histogram(types, "types", "type", "share")).union(classes)
    rows = wide_kernels(told, pairs, {"names": ("names", "l1"), "lines": ("lines", "jaccard"), "types": ("types", "l1"), "classes": ("exceptions", "jaccard")})
    return rows.select("pair_id", (1 - (F.col("names") + F.col("lines") + F.col("types") + F.col("classes")) / 4).alias("similarity"))
