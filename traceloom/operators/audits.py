"""Audits of data sets: splits, leakage, duplicates, diversity, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.operators.ordering import joined_on, running
from traceloom.sources.staging import Workspace


def assign_splits(items: DataFrame, category: str, key: str, seed: int = 42) -> DataFrame:
    """key, category, split: train, dev, val and test by 50, 15, 15, 20 per cent of each category, in the order of a hash.

    Sizes are rounded half to even. A category of fewer than five goes to train, but for one item each to test and dev as far as there are.
    """
    order = [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]
    with Workspace(items.sparkSession, "splits") as work:
        places = running(items.select(key, category), [category], order, {"at": F.lit(1).cast("long")}, work)
        sizes = items.groupBy(category).agg(F.count("*").alias("n"))
        rows = work.keep(joined_on(places.withColumn("at", F.col("at") - 1), sizes, [category]), "places")
    train, dev, val = (F.bround(F.col("n") * x) for x in (0.50, 0.15, 0.15))
    large = F.when(F.col("at") < train, "train").when(F.col("at") < train + dev, "dev").when(F.col("at") < train + dev + val, "val").otherwise("test")
    small = F.when(F.col("at") < F.col("n") - 2, "train").when(F.col("at") == F.col("n") - 1, "test").otherwise("dev")
    return rows.select(key, category, F.when(F.col("n") < 5, small).otherwise(large).alias("split"))


def split_counts(rows: DataFrame, row: str, split: str = "split", names: tuple[str, ...] = ("train", "dev", "val", "test")) -> DataFrame:
    """Counts of each row value by split, zeros included."""
    return rows.groupBy(row).pivot(split, list(names)).count().na.fill(0)


def shared_keys(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("n")).where("splits > 1")


def only_in(rows: DataFrame, key: str, there: str, not_there: str, split: str = "split") -> DataFrame:
    """Keys of one split that another lacks."""
    return rows.where(F.col(split) == there).select(key).distinct().join(rows.where(F.col(split) == not_there).select(key), key, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def histogram(rows: DataFrame, value: str, width: int, bins: int) -> DataFrame:
    """bin, low, n of fixed-width bins, empty ones included; the last bin takes all beyond."""
    at = F.least(F.floor(F.col(value) / width), F.lit(bins - 1)).cast("long")
    counts = rows.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.col("bin") * width).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def label_issues(pairs: DataFrame) -> DataFrame:
    """issue, n: ids that repeat, labels that contradict the transformation family, missing fields."""
    ids = repeated(pairs, ["pair_id"]).agg(F.lit("repeated_id").alias("issue"), F.count("*").alias("n"))
    wrong = (F.col("transformation_type").startswith("SP") & (F.col("expected_label") != "EQUIVALENT")) | (F.col("transformation_type").startswith("SC") & (F.col("expected_label") == "EQUIVALENT"))
    labels = pairs.agg(F.lit("label").alias("issue"), F.coalesce(F.sum(wrong.cast("long")), F.lit(0)).alias("n"))
    missing = pairs.agg(F.lit("missing").alias("issue"), F.coalesce(F.sum(F.expr("base_id IS NULL OR variant_id IS NULL OR expected_label IS NULL").cast("long")), F.lit(0)).alias("n"))
    return ids.union(labels).union(missing)


def applicability(items: DataFrame, mapping: DataFrame, category: str, target: str) -> DataFrame:
    """target, n: to how many items each target of a mapping (category, target) applies, those without any included."""
    counts = items.groupBy(category).agg(F.count("*").alias("held"))
    return mapping.select(category, target).distinct().join(counts, category, "left").groupBy(target).agg(F.coalesce(F.sum("held"), F.lit(0)).alias("n"))


def subsample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows, the first in the order of a seeded hash of their key: a sampling operator, the same in any engine."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def leakage_audit(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """check, subject, splits, n: what the splits of pairs share, in one grouping.

    rows: program, pair_id, family, category, split. corpus: program of all programs there are.
    program and pair: those that stand in several splits. family: those of both dev and test, which is no leak but is shown.
    category: those of test that dev lacks, so that a threshold is chosen without them. orphan: programs of the corpus without a split.
    n: rows of the subject. Nulls are no subject; rows without a split aren't assigned.
    """
    told = {"program": "program", "pair": "pair_id", "family": "family", "category": "category"}
    subjects = F.array(*[F.struct(F.lit(check).alias("check"), F.col(c).cast("string").alias("subject")) for check, c in told.items()])
    counts = rows.where("split IS NOT NULL").select("split", F.explode(subjects).alias("s")).select("split", "s.*").where("subject IS NOT NULL").groupBy("check", "subject", "split").agg(F.count("*").alias("n"))
    held = counts.groupBy("check", "subject").agg(F.array_sort(F.collect_list("split")).alias("splits"), F.sum("n").alias("n"))
    within = lambda split: F.array_contains("splits", split)
    several = F.col("check").isin("program", "pair") & (F.size("splits") > 1)
    found = held.where(several | ((F.col("check") == "family") & within("dev") & within("test")) | ((F.col("check") == "category") & within("test") & ~within("dev")))
    assigned = rows.where("split IS NOT NULL").select(F.col("program").cast("string").alias("subject"))
    orphans = corpus.select(F.col("program").cast("string").alias("subject")).where("subject IS NOT NULL").distinct().join(assigned, "subject", "left_anti")
    shown = found.select("check", "subject", F.array_join("splits", ",").alias("splits"), "n")
    return shown.unionByName(orphans.select(F.lit("orphan").alias("check"), "subject", F.lit("").alias("splits"), F.lit(0).cast("long").alias("n")))
