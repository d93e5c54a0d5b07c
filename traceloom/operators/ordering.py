"""Row numbers over a whole table without one task for all: ranges are numbered on their own and then placed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.sources.staging import Workspace


def numbered(rows: DataFrame, order: list[Column], work: Workspace, name: str = "no") -> DataFrame:
    """The rows with their place in an order, from 0. Rows that the order doesn't tell apart are numbered in any way."""
    ranged = work.stage(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("size"))
    # as many rows as there are ranges
    before = F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(sizes.select("range", before.alias("before")), "range")
    at = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return placed.withColumn(name, F.col("before") + at).drop("range", "before")


def joined_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, where nulls are equal too."""
    named = right.select(*[F.col(k).alias(f"other_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in keys])
    return left.join(named, same).drop(*[f"other_{k}" for k in keys])


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], work: Workspace) -> DataFrame:
    """Adds for each row the sums, within its stratum, over the rows up to it in an order that tells all rows of a stratum apart.

    Strata and order are dealt in ranges; a range adds up its own rows, and what the ranges before it hold of the stratum is added.
    """
    named = rows.select("*", *[value.alias(f"own_{name}") for name, value in sums.items()])
    ranged = work.stage(named.repartitionByRange(*by, *order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*by, "range").agg(*[F.sum(f"own_{name}").alias(f"all_{name}") for name in sums])
    parts = parts.select(*by, "range", *[F.coalesce(F.sum(f"all_{name}").over(before), F.lit(0)).alias(f"before_{name}") for name in sums])
    inner = Window.partitionBy(*by, "range").orderBy(*order)
    summed = joined_on(ranged, parts, [*by, "range"])
    return summed.select(*rows.columns, *[(F.col(f"before_{name}") + F.sum(f"own_{name}").over(inner)).alias(name) for name in sums])
