"""Canonical forms of feature bundles: histograms in the long form, and scalars. Applying one twice changes nothing more."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROGRAM = "program_id"


@dataclass(frozen=True)
class Rule:
    """drop: entries that are not positive go. low, high: bounds that others are brought to. digits: that they are rounded to."""

    drop: bool = False
    low: float | None = 0.0
    high: float | None = None
    digits: int | None = None

    def of(self, value: Column) -> Column:
        value = value if self.low is None else F.greatest(F.lit(self.low), value)
        value = value if self.high is None else F.least(F.lit(self.high), value)
        return value if self.digits is None else F.round(value, self.digits)


COUNTS, SHARES = Rule(drop=True), Rule(drop=True, high=1.0)
#: Families of histograms by dimension; a family that isn't named stays as it is.
FAMILIES = {
    "branches": Rule(low=None, digits=4), "loops": Rule(), "names": COUNTS, "calls": COUNTS, "instructions": Rule(), "types": Rule(), "depths": Rule(), "assignments": Rule(), "latency": COUNTS,
    "event_bigrams": COUNTS, "timing": SHARES, "outputs": COUNTS, "output_types": COUNTS, "patterns": COUNTS,
}
SCALARS = {
    "branch_entropy": Rule(low=None, digits=4), "mutation_rate": Rule(high=1.0, digits=4), "state_space_size": Rule(), "state_transition_count": Rule(), "truncated_rate": Rule(high=1.0), "exception_rate": Rule(high=1.0),
    "temporal_entropy": Rule(), "n_calls": Rule(), "n_variables": Rule(), **{f"{what}_{stat}": Rule() for what in ("time", "length") for stat in ("mean", "std", "min", "max")},
}


def canonical_histograms(rows: DataFrame) -> DataFrame:
    """program_id, family, key, weight with each family's rule; the zeros at the end of a profile by depth (family ``loops``) go. Keys that repeat are one entry, of the greatest weight."""
    once = rows.groupBy(PROGRAM, "family", "key").agg(F.max("weight").alias("weight"))
    dropped = reduce(Column.__or__, [(F.col("family") == f) & (F.col("weight") <= 0) for f, r in FAMILIES.items() if r.drop])
    weight = reduce(lambda w, fr: w.when(F.col("family") == fr[0], fr[1].of(F.col("weight"))), FAMILIES.items(), F.when(F.lit(False), F.col("weight"))).otherwise(F.col("weight"))
    clean = once.where(~dropped).withColumn("weight", weight)
    # a profile has as many rows as it is deep
    deepest = F.max(F.when(F.col("weight") > 0, F.col("key").try_cast("int"))).over(Window.partitionBy(PROGRAM, "family"))
    kept = clean.withColumn("deepest", F.when(F.col("family") == "loops", F.coalesce(deepest, F.lit(-1))))
    return kept.where((F.col("family") != "loops") | (F.col("key").try_cast("int") <= F.col("deepest"))).drop("deepest")


def canonical_scalars(features: DataFrame) -> DataFrame:
    """A row of scalars for each program with each column's rule; other columns stay."""
    kinds = dict(features.dtypes)
    return features.select(*[SCALARS[c].of(F.col(c)).cast(kinds[c]).alias(c) if c in SCALARS else F.col(c) for c in features.columns])
