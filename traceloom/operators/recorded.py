"""Judging two versions of a program by their recorded outputs: equality, labels, confidence, regressions, boundary inputs.

outputs: program_id, input_idx, repr (of the value returned, null after an exception), exception (its class or null), ms. Nothing is run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.measures import ratio
from traceloom.functions.reprs import elements, exception_class, type_name
from traceloom.operators.sequences import PROGRAM

#: Tolerances of equal floating-point outputs.
RELATIVE, ABSOLUTE = 1e-9, 1e-12
#: Greatest confidence of each tier of labels.
TIERS = {"GT-T2": 0.999, "GT-T3": 0.980, "GT-T4 broad": 0.960, "GT-T4 limited": 0.900}


def outputs_of(traces: DataFrame) -> DataFrame:
    """The outputs of recorded traces; the exception's class stands for the exception."""
    raised = F.col("exception").isNotNull()
    return traces.select(PROGRAM, "input_idx", F.when(~raised, F.col("return_repr")).alias("repr"), F.when(raised, exception_class(F.col("exception"))).alias("exception"), F.col("execution_time_ms").alias("ms"))


def equal_reprs(a: Column, b: Column) -> Column:
    """Are two outputs equal? The reprs are, or both are floats that differ by no more than rounding; nan equals nan."""
    x, y = a.try_cast("double"), b.try_cast("double")
    floats = (type_name(a) == "float") & (type_name(b) == "float")
    close = F.abs(x - y) <= F.greatest(RELATIVE * F.greatest(F.abs(x), F.abs(y)), F.lit(ABSOLUTE))
    return a.eqNullSafe(b) | F.coalesce(floats & close, F.lit(False))


def partition_key(value: Column) -> Column:
    """The coarse class of an input, from its repr: type and sign, emptiness or size."""
    r, kind = F.trim(value), type_name(value)
    number = r.try_cast("double")
    sized = F.when(elements(r) == 0, "seq:empty").when(elements(r) == 1, "seq:single").otherwise("seq:multi")
    # pairs of a dict are split by the same commas as elements
    return (
        F.when(kind == "NoneType", "None").when(kind == "bool", F.concat(F.lit("bool:"), r))
        .when(kind == "int", F.when(number < 0, "int:negative").when(number == 0, "int:zero").otherwise("int:positive"))
        .when(r == "nan", "float:nan").when(r == "inf", "float:inf:True").when(r == "-inf", "float:inf:False")
        .when(kind == "float", F.when(number == 0, "float:zero").otherwise("float:nonzero"))
        .when(kind == "str", F.when(F.length(r) == 2, "str:empty").otherwise("str:nonempty"))
        .when(kind.isin("list", "tuple"), sized).when(kind == "dict", F.concat(F.lit("dict:"), elements(r).cast("string")))
        .otherwise(F.concat(F.lit("other:"), kind))
    )


def zipped(outputs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, at, and both sides' outputs: the n-th of the left version with the n-th of the right, as long as both have one."""
    placed = outputs.withColumn("at", F.row_number().over(Window.partitionBy(PROGRAM).orderBy("input_idx")) - 1)
    side = lambda name, key: placed.select(F.col(PROGRAM).alias(key), "at", *[F.col(c).alias(f"{name}_{c}") for c in ("repr", "exception")])
    return pairs.join(side("a", "left"), "left").join(side("b", "right"), ["right", "at"])


def agreement() -> Column:
    return equal_reprs(F.col("a_repr"), F.col("b_repr")) & F.col("a_exception").eqNullSafe(F.col("b_exception"))


def oracle_labels(outputs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, n_tested, n_diffs, label: CHANGED if an output differs, LIKELY_EQUIVALENT if all agree, UNKNOWN without outputs of both."""
    counts = zipped(outputs, pairs).groupBy("pair_id").agg(F.count("*").alias("n_tested"), F.sum((~agreement()).cast("long")).alias("n_diffs"))
    rows = pairs.select("pair_id").join(counts, "pair_id", "left").na.fill(0)
    return rows.withColumn("label", F.when(F.col("n_diffs") > 0, "CHANGED").when(F.col("n_tested") > 0, "LIKELY_EQUIVALENT").otherwise("UNKNOWN"))


def calibrated(rows: DataFrame, preserving: Column, certified: Column) -> DataFrame:
    """Adds tier and confidence of a label from n_tested and n_diffs.

    preserving: the transformation is meant to keep behaviour. Without a difference the confidence is one less the upper bound of the
    error rate after n tests without an error, at 95 per cent, capped by tier; certified: by a transformation that is proven.
    """
    n = F.col("n_tested")
    raw = F.pow(F.lit(0.05), 1 / F.greatest(n, F.lit(1)))
    told = lambda tier, confidence: F.struct(F.lit(tier[:5]).alias("tier"), confidence.alias("confidence"))
    capped = lambda name: told(name, F.least(raw, F.lit(TIERS[name])))
    few = F.when(n >= 10_000, capped("GT-T2")).when((n >= 1_000) & certified, capped("GT-T3")).when(n >= 1_000, capped("GT-T4 broad")).otherwise(capped("GT-T4 limited"))
    kept = F.when(F.col("n_diffs") > 0, told("GT-T4", F.lit(0.999))).otherwise(few)
    changed = F.when(F.col("n_diffs") > 0, told("GT-T1", F.lit(0.999))).otherwise(told("GT-T4", F.least(0.5 + 0.45 * (1 - F.exp(-n / 500.0)), F.lit(0.95))))
    return rows.withColumn("c", F.when(n == 0, told("GT-T4", F.lit(0.5))).when(preserving, kept).otherwise(changed)).select("*", "c.tier", "c.confidence").drop("c")


#: Weights of the regression distance.
REGRESSION_WEIGHTS = {"exception_fraction": 0.30, "exception_types": 0.20, "volume_ratio": 0.10, "output_divergence": 0.40}


def regression_distances(outputs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, the parts of the regression distance between two versions, and their weighted sum ``distance``.

    Gap of the shares of exceptions, Jaccard distance of their types, ratio of the mean times (a tenth of what is above one), and the
    share of zipped outputs that differ; an exception's type is its output.
    """
    sums = outputs.groupBy(PROGRAM).agg(F.avg(F.col("exception").isNotNull().cast("int")).alias("rate"), F.array_sort(F.collect_set("exception")).alias("types"), F.avg("ms").alias("ms"))
    side = lambda name, key: sums.select(F.col(PROGRAM).alias(key), *[F.col(c).alias(f"{name}_{c}") for c in ("rate", "types", "ms")])
    shown = lambda s: F.coalesce(F.concat(F.lit("EXC:"), F.col(f"{s}_exception")), F.substring(f"{s}_repr", 1, 200))
    divergence = zipped(outputs, pairs).groupBy("pair_id").agg(F.avg((~shown("a").eqNullSafe(shown("b"))).cast("int")).alias("output_divergence"))
    rows = pairs.join(side("a", "left"), "left").join(side("b", "right"), "right").join(divergence, "pair_id", "left")
    union = F.size(F.array_union("a_types", "b_types"))
    slow, fast = F.greatest("a_ms", "b_ms") + 1e-6, F.least("a_ms", "b_ms") + 1e-6
    rows = rows.select(
        "pair_id", F.abs(F.col("a_rate") - F.col("b_rate")).alias("exception_fraction"), F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect("a_types", "b_types")) / union).alias("exception_types"),
        F.least(F.lit(1.0), (slow / fast - 1) / 10).alias("volume_ratio"), F.coalesce("output_divergence", F.lit(0.0)).alias("output_divergence"),
    )
    total = F.lit(0.0)
    for name, weight in REGRESSION_WEIGHTS.items():
        total = total + weight * F.col(name)
    return rows.withColumn("distance", total)


def detection_rates(distances: DataFrame, by: str) -> DataFrame:
    """by, n, and the shares of pairs whose regression shows in outputs, exceptions and volume; silent: in neither of the last two, and how many of these outputs show."""
    output = F.col("output_divergence") > 0
    raised, slower = (F.col("exception_fraction") > 0) | (F.col("exception_types") > 0), F.col("volume_ratio") > 0.05
    silent = ~raised & ~slower
    count = lambda c: F.sum(c.cast("long"))
    rows = distances.groupBy(by).agg(F.count("*").alias("n"), count(output).alias("o"), count(raised).alias("e"), count(slower).alias("v"), count(silent).alias("n_silent"), count(silent & output).alias("silent_detected"))
    return rows.select(by, "n", *[ratio(F.col(c), F.col("n")).alias(name) for c, name in (("o", "by_output"), ("e", "by_exception"), ("v", "by_volume"))], "n_silent", "silent_detected")


def nearest_zero(constants: DataFrame, cap: int = 40) -> DataFrame:
    """The ``cap`` distinct constants of each pair nearest zero, the negative of two equally near first. constants: pair_id, value."""
    order = Window.partitionBy("pair_id").orderBy(F.abs("value"), "value")
    return constants.select("pair_id", "value").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def boundary_inputs(constants: DataFrame) -> DataFrame:
    """The rows of constants (value) with an input beside each: kind and elements, eleven for every constant.

    One below, the constant and one above: alone, in a list of one, neighbours in lists of two, and as lengths of falling ranges.
    """
    v = F.col("value").cast("long")
    near = [v - 1, v, v + 1]
    made = lambda kind, *items: F.struct(F.lit(kind).alias("kind"), F.array(*items).alias("elements"))
    falling = lambda n: F.struct(F.lit("falling").alias("kind"), F.when(n > 0, F.sequence(n, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("elements"))
    inputs = [*[made("scalar", x) for x in near], *[made("list", x) for x in near], made("list", v - 1, v), made("list", v, v + 1), *[falling(F.greatest(x, F.lit(0).cast("long"))) for x in near]]
    return constants.select("*", F.explode(F.array(*inputs)).alias("i")).select(*constants.columns, "i.kind", "i.elements")


def exposure(tested: DataFrame, constants: DataFrame) -> DataFrame:
    """pair_id, n_constants, exercised, n_tested, n_divergent, diverges, confidence: how far recorded outputs on boundary inputs expose a change.

    tested: pair_id, near (constants that the input lies at or next to), and both sides' outputs as of ``zipped``; timeouts are left out.
    confidence: the share of constants that an input came near to.
    """
    live = tested.where("coalesce(a_exception, '') != 'TimeoutError' AND coalesce(b_exception, '') != 'TimeoutError'")
    sums = live.groupBy("pair_id").agg(F.count("*").alias("n_tested"), F.sum((~agreement()).cast("long")).alias("n_divergent"))
    wanted = constants.select("pair_id", "value").distinct()
    met = live.select("pair_id", F.explode("near").alias("value")).distinct().join(wanted, ["pair_id", "value"], "left_semi").groupBy("pair_id").agg(F.count("*").alias("exercised"))
    rows = wanted.groupBy("pair_id").agg(F.count("*").alias("n_constants")).join(met, "pair_id", "left").join(sums, "pair_id", "full").na.fill(0)
    return rows.withColumn("diverges", F.col("n_divergent") > 0).withColumn("confidence", F.round(ratio(F.col("exercised"), F.col("n_constants")), 4))


def flat_distance(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, distance: sum of the gaps of all numeric features over the sum of their sizes, or 1. features: program_id and numbers."""
    names = [c for c in features.columns if c != PROGRAM]
    side = lambda s, key: features.select(F.col(PROGRAM).alias(key), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"{s}_{c}") for c in names])
    rows = pairs.join(side("a", "left"), "left").join(side("b", "right"), "right")
    gaps, sizes = F.lit(0.0), F.lit(0.0)
    for c in names:
        gaps, sizes = gaps + F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")), sizes + F.abs(f"a_{c}") + F.abs(f"b_{c}")
    return rows.select("pair_id", F.least(F.lit(1.0), gaps / F.greatest(sizes, F.lit(1.0))).alias("distance"))


def shortcut_verdicts(sides: DataFrame) -> DataFrame:
    """pair_id, truth, label and, for three shortcuts, verdict and whether it is right: what a tool that looks at mere size would say of each pair.

    sides: pair_id, truth (EQUIV or CHANGED), agree (all outputs of both sides), and of both sides (a_*, b_*) the share of outputs that are exceptions, the number of output items, and of functions.
    label: EQUIV if all outputs agree. Shares count as equal if they differ by less than 0.01. A missing number counts as 0.
    """
    of = lambda s, c: F.coalesce(F.col(f"{s}_{c}"), F.lit(0))
    told = lambda same: F.when(same, "EQUIV").otherwise("CHANGED")
    verdicts = {
        "label": told(F.coalesce("agree", F.lit(False))), "exception_fraction": told(F.abs(of("a", "exceptions") - of("b", "exceptions")) < 0.01),
        "volume": told(of("a", "items") == of("b", "items")), "functions": told(of("a", "functions") == of("b", "functions")),
    }
    return sides.select("pair_id", "truth", *[v.alias(n) for n, v in verdicts.items()], *[(v == F.col("truth")).alias(f"{n}_right") for n, v in verdicts.items()])


def shortcut_summary(verdicts: DataFrame) -> DataFrame:
    """method, pairs, right, accuracy of the label and of each shortcut."""
    methods = ("label", "exception_fraction", "volume", "functions")
    rows = verdicts.select(F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}_right").cast("long").alias("right")) for m in methods])).alias("r")).select("r.*")
    return rows.groupBy("method").agg(F.count("*").alias("pairs"), F.sum("right").alias("right"), F.avg("right").alias("accuracy"))
