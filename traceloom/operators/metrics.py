"""Evaluation of scores against labels, by grouping and windows over distinct scores.

scores: score (a similarity) and label (1 CHANGED, 0 EQUIVALENT); a lower score speaks for 1.
All operators take ``by``, columns that name strata; every stratum is evaluated on its own.
Windows run over distinct scores of a stratum, which grouping has added up before.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.measures import chi2_sf_1df, ratio
from traceloom.operators.ordering import joined_on, numbered, running
from traceloom.sources.staging import Workspace


def levels(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, score, pos, neg, and both below the score and in all. Distinct scores are ranked in ranges, so that continuous ones don't meet in one task."""
    grouped = scores.groupBy(*by, "score").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") == 0).cast("long")).alias("neg"))
    with Workspace(scores.sparkSession, "levels") as work:
        grouped = work.stage(grouped, "grouped")
        summed = running(grouped, by, [F.col("score")], {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")}, work)
        whole = grouped.groupBy(*by).agg(F.sum("pos").alias("pos_all"), F.sum("neg").alias("neg_all"))
        below = summed.withColumn("pos_below", F.col("pos_upto") - F.col("pos")).withColumn("neg_below", F.col("neg_upto") - F.col("neg")).drop("pos_upto", "neg_upto")
        return work.keep(joined_on(below, whole, by), "levels")


def ranked_levels(grouped: DataFrame, by: list[str]) -> DataFrame:
    """Levels of rows that are added up already: by, score, pos, neg."""
    order = Window.partitionBy(*by).orderBy("score")
    below, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    zero = F.lit(0)
    return grouped.select("*", F.coalesce(F.sum("pos").over(below), zero).alias("pos_below"), F.coalesce(F.sum("neg").over(below), zero).alias("neg_below"), F.sum("pos").over(whole).alias("pos_all"), F.sum("neg").over(whole).alias("neg_all"))


def encoded_labels(pairs: DataFrame, relation: str = "expected_label") -> DataFrame:
    """Adds label: 0 for EQUIVALENT, 1 for any other relation."""
    return pairs.withColumn("label", F.when(F.col(relation) == "EQUIVALENT", 0).otherwise(1))


def mid_ranks(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, score, n, mid_rank: the mean of the ranks, from 1, that equal scores share."""
    n, below = F.col("pos") + F.col("neg"), F.col("pos_below") + F.col("neg_below")
    return levels(scores, by).select(*by, "score", n.alias("n"), (below + (n + 1) / 2).alias("mid_rank"))


def auroc(scores: DataFrame, by: list[str], empty: float = 0.5) -> DataFrame:
    """by, auroc, n_positive, n_negative, tie_fraction: P(score of 1 < score of 0) with ties as halves; ``empty`` for a lone class."""
    return auroc_of_levels(levels(scores, by), by, empty)


def auroc_of_levels(rows: DataFrame, by: list[str], empty: float = 0.5) -> DataFrame:
    rows = rows.groupBy(*by).agg(
        F.sum(F.col("neg") * (F.col("pos_below") + F.col("pos") / 2)).alias("won"), F.sum(F.col("pos") * F.col("neg")).alias("tied"), F.max("pos_all").alias("n_positive"), F.max("neg_all").alias("n_negative")
    )
    pairs = (F.col("n_positive") * F.col("n_negative")).cast("double")
    return rows.select(*by, ratio(F.col("won"), pairs, empty).alias("auroc"), "n_positive", "n_negative", ratio(F.col("tied"), pairs).alias("tie_fraction"))


def auroc_of_types(scores: DataFrame, kind: str) -> DataFrame:
    """kind, auroc, n_positive, n_negative, tie_fraction: the label 0 of each kind against the label 1 of all kinds.

    The 1s are ranked once, by distinct scores; each kind's 0s look up how many are below.
    """
    ranked = levels(scores.withColumn("all", F.lit(0)), ["all"]).select("score", "pos", "pos_below", "pos_all")
    kept = scores.where("label = 0").groupBy(kind, "score").agg(F.count("*").alias("n")).join(ranked, "score")
    sums = kept.groupBy(kind).agg(F.sum(F.col("n") * (F.col("pos_below") + F.col("pos") / 2)).alias("won"), F.sum(F.col("n") * F.col("pos")).alias("tied"), F.max("pos_all").alias("n_positive"), F.sum("n").alias("n_negative"))
    pairs = (F.col("n_positive") * F.col("n_negative")).cast("double")
    return sums.select(kind, ratio(F.col("won"), pairs, 0.5).alias("auroc"), "n_positive", "n_negative", ratio(F.col("tied"), pairs).alias("tie_fraction"))


def ranked_methods(scores: DataFrame) -> DataFrame:
    """method, f1, auroc, rank, behind: methods by the F1 at their best threshold, and how far each is behind the best. scores: method, score, label."""
    best = best_threshold(scores, ["method"]).select("method", "f1")
    rows = best.join(auroc(scores, ["method"]).select("method", "auroc"), "method").select("method", F.round("f1", 6).alias("f1"), F.round("auroc", 6).alias("auroc"))
    # as many rows as there are methods
    return rows.select("*", F.row_number().over(Window.orderBy(F.desc("f1"), "method")).alias("rank"), (F.col("f1") - F.max("f1").over(Window.partitionBy(F.lit(0)))).alias("behind"))


def confusion(scores: DataFrame, threshold: Column | float, by: list[str]) -> DataFrame:
    """by, tp, fp, fn, tn, precision, recall, f1, accuracy; a score below the threshold predicts 1."""
    hit, one = F.col("score") < threshold, F.col("label") == 1
    count = lambda c: F.sum(c.cast("long"))
    rows = scores.groupBy(*by).agg(count(hit & one).alias("tp"), count(hit & ~one).alias("fp"), count(~hit & one).alias("fn"), count(~hit & ~one).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return rows.select(*by, "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def best_threshold(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, f1: the lowest threshold of the best F1 among the scores, 0 if they are above, and just beyond the last."""
    rows = levels(scores, by)
    at = rows.select(*by, F.col("score").alias("threshold"), "pos_below", "neg_below", "pos_all")
    ends = rows.groupBy(*by).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.max("pos_all").alias("pos_all"), F.max("neg_all").alias("neg_all"))
    zero = ends.where("low > 0").select(*by, F.lit(0.0).alias("threshold"), F.lit(0).alias("pos_below"), F.lit(0).alias("neg_below"), "pos_all")
    beyond = ends.select(*by, (F.col("high") + 1e-6).alias("threshold"), F.col("pos_all").alias("pos_below"), F.col("neg_all").alias("neg_below"), "pos_all")
    f1 = ratio(2 * F.col("pos_below"), F.col("pos_below") + F.col("neg_below") + F.col("pos_all"))
    tried = at.union(zero).union(beyond).withColumn("f1", f1)
    best = tried.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("low"))).alias("b"))
    return best.select(*by, (-F.col("b.low")).alias("threshold"), F.col("b.f1").alias("f1"))


def ordered(scores: DataFrame, by: list[str], tie: str, work: Workspace) -> DataFrame:
    """by, label, k, tp, and p and n of the stratum: rows in order of score and ``tie``, with how many rows and rows of label 1 come so far."""
    rows = running(scores.select(*by, "score", tie, "label"), by, [F.col("score"), F.col(tie)], {"k": F.lit(1).cast("long"), "tp": F.col("label")}, work)
    whole = scores.groupBy(*by).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    return joined_on(rows, whole, by)


def tpr_at_fpr(scores: DataFrame, budget: float, by: list[str], tie: str) -> DataFrame:
    """by, tpr: the recall reached by the last row, in order of score, whose false positive rate is within the budget. tie: column that orders equal scores, without nulls."""
    with Workspace(scores.sparkSession, "tpr") as work:
        within = F.max(F.when((F.col("k") - F.col("tp")) / F.col("n") <= budget, F.col("tp") / F.col("p")))
        return work.keep(ordered(scores, by, tie, work).where("p > 0 AND n > 0").groupBy(*by).agg(F.coalesce(within, F.lit(0.0)).alias("tpr")), "tpr")


def auprc(scores: DataFrame, by: list[str], tie: str) -> DataFrame:
    """by, auprc: trapezoids under precision over recall, from precision 1 at recall 0, row by row in order of score and ``tie``."""
    with Workspace(scores.sparkSession, "auprc") as work:
        before = F.when(F.col("k") == 1, 1.0).otherwise((F.col("tp") - F.col("label")) / (F.col("k") - 1))
        area = F.col("label") / F.col("p") * (F.col("tp") / F.col("k") + before) / 2
        return work.keep(ordered(scores, by, tie, work).where("p > 0").groupBy(*by).agg(F.sum(area).alias("auprc")), "auprc")


def holm(tests: DataFrame, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """test, p_value, rank, corrected_alpha, reject, stopped: Holm's step-down; stopped is true after the first failure, not on it."""
    by = by or []
    order = Window.partitionBy(*by).orderBy("p_value", "test")
    m = F.count("*").over(Window.partitionBy(*by))
    rows = tests.withColumn("rank", F.row_number().over(order)).withColumn("corrected_alpha", alpha / (m - F.col("rank") + 1))
    failed = F.coalesce(F.max((F.col("p_value") > F.col("corrected_alpha")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    return rows.select(*by, "test", "p_value", "rank", "corrected_alpha", (~failed & (F.col("p_value") <= F.col("corrected_alpha"))).alias("reject"), failed.alias("stopped"))


def effect_sizes(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, glass_delta (population deviation of label 0), cohens_d (pooled, n - 1) of the scores of label 1 against label 0."""
    of = lambda f, k: f(F.when(F.col("label") == k, F.col("score")))
    rows = scores.groupBy(*by).agg(*[of(f, k).alias(f"{n}{k}") for k in (0, 1) for n, f in (("mean", F.avg), ("pop", F.stddev_pop), ("var", F.var_samp), ("n", F.count))])
    gap = F.col("mean1") - F.col("mean0")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("var1") + (F.col("n0") - 1) * F.col("var0")) / (F.col("n1") + F.col("n0") - 2))
    return rows.select(*by, ratio(gap, F.col("pop0")).alias("glass_delta"), ratio(gap, pooled).alias("cohens_d"))


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; null where either side doesn't vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-12, F.covar_pop(x, y) / F.when(spread > 1e-12, spread))


def mcnemar(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """by, b, c, statistic, p_value of paired outcomes (first, second: right or wrong), with continuity correction.

    The tail is that of chi-square with one degree of freedom itself, not of an argument that lacks the root of 2.
    """
    rows = outcomes.groupBy(*by).agg(F.sum((F.col("first") & ~F.col("second")).cast("long")).alias("b"), F.sum((~F.col("first") & F.col("second")).cast("long")).alias("c"))
    statistic = ratio(F.pow(F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)), 2), F.col("b") + F.col("c"))
    return rows.withColumn("statistic", statistic).withColumn("p_value", chi2_sf_1df(F.col("statistic")))


def hashed(*parts: Column) -> Column:
    """A number from md5 of the parts joined by bars, the same in any engine: its first 8 hexadecimal digits."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def resampled(scores: DataFrame, rounds: int, seed: int, unit: str) -> DataFrame:
    """Bootstrap: for each round as many draws of a unit, with replacement, as there are units: round, score, pos, neg.

    unit: a column; rows of one unit are drawn together, so a program's pairs can be a cluster. Draw i of round b takes
    the unit numbered hash(seed, b, i) mod n. A unit's rows are added up by score before it is drawn.
    """
    spark = scores.sparkSession
    with Workspace(spark, "resampled") as work:
        units = work.stage(numbered(scores.where(F.col(unit).isNotNull()).select(unit).distinct(), [F.col(unit)], work), "units")
        n = max(units.count(), 1)
        held = scores.join(units, unit).groupBy("no", "score").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") == 0).cast("long")).alias("neg"))
        held = work.keep(held, "units")
    draws = spark.range(rounds * n).select(F.floor(F.col("id") / n).alias("round"), (F.col("id") % n).alias("i"))
    picked = draws.select("round", (hashed(F.lit(seed), F.col("round"), F.col("i")) % n).alias("no"))
    return picked.join(held, "no").groupBy("round", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def bootstrap_ci(scores: DataFrame, rounds: int = 200, seed: int = 42, unit: str = "pair_id", alpha: float = 0.05) -> DataFrame:
    """low, high: percentile interval of the AUROC by rank of the rounds, rank floor(alpha/2 B) and ceil((1 - alpha/2) B) - 1 from 0."""
    drawn = ranked_levels(resampled(scores, rounds, seed, unit), ["round"])
    each = auroc_of_levels(drawn, ["round"]).withColumn("at", F.row_number().over(Window.orderBy("auroc", "round")) - 1)
    low, high = math.floor(alpha / 2 * rounds), math.ceil((1 - alpha / 2) * rounds) - 1
    return each.agg(F.max(F.when(F.col("at") == low, F.col("auroc"))).alias("low"), F.max(F.when(F.col("at") == high, F.col("auroc"))).alias("high"))


def permuted(scores: DataFrame, rounds: int, seed: int, key: str) -> DataFrame:
    """For each round the labels dealt anew in the order of a hash. Adds ``round``."""
    spark = scores.sparkSession
    with Workspace(spark, "permuted") as work:
        rows = numbered(scores.select("score", "label", key), [F.col(key)], work)
        rows = work.keep(rows.withColumn("no", F.col("no") + 1), "rows")
    dealt = rows.select(key, "label").join(F.broadcast(spark.range(rounds).select(F.col("id").alias("round"))))
    order = Window.partitionBy("round").orderBy(hashed(F.lit(seed), F.col("round"), F.col(key)), key)
    labels = dealt.select("round", "label", F.row_number().over(order).alias("no"))
    return labels.join(rows.select("no", "score"), "no").select("round", "score", "label")


def permutation_p(scores: DataFrame, rounds: int = 200, seed: int = 42, key: str = "pair_id") -> DataFrame:
    """auroc, p_value: share of the rounds whose AUROC is at least the real one; no smoothing."""
    real = auroc(scores.withColumn("all", F.lit(0)), ["all"]).select("auroc")
    each = auroc(permuted(scores, rounds, seed, key), ["round"]).select(F.col("auroc").alias("dealt"))
    return each.join(F.broadcast(real)).groupBy("auroc").agg(F.avg((F.col("dealt") >= F.col("auroc")).cast("int")).alias("p_value"))


def swap_p(pairs: DataFrame, rounds: int = 200, seed: int = 42, key: str = "pair_id") -> DataFrame:
    """delta, p_value of paired scores a, b: share of the rounds in which coins that swap the pair give as large a mean difference."""
    spark = pairs.sparkSession
    real = pairs.agg(F.avg(F.col("a") - F.col("b")).alias("delta"))
    coin = F.when(hashed(F.lit(seed), F.col("round"), F.col(key)) % 2 == 0, 1).otherwise(-1)
    rounds_table = spark.range(rounds).select(F.col("id").alias("round"))
    each = pairs.join(F.broadcast(rounds_table)).groupBy("round").agg(F.avg(coin * (F.col("a") - F.col("b"))).alias("dealt"))
    return each.join(F.broadcast(real)).groupBy("delta").agg(F.avg((F.abs("dealt") >= F.abs("delta")).cast("int")).alias("p_value"))


#: Rows that a split of labels can tell apart, by the bound of numpy's draws.
MOST_ROWS = 10**9


def in_score_ranges(rows: DataFrame, work: Workspace) -> DataFrame:
    """Distinct scores dealt in ranges: adds ``range``, whose numbers grow with the score."""
    return work.stage(rows.repartitionByRange("score").withColumn("range", F.spark_partition_id()), "ranges")


def split_labels(sizes: np.ndarray, ones: np.ndarray, seed: list[int]) -> np.ndarray:
    """How many of ``ones[b]`` labels fall on each level in round b, if all ways to deal them to the rows are alike: (rounds, levels). sizes: rows of each level."""
    dealt = np.empty((len(ones), len(sizes)), np.int64)
    for b, n in enumerate(ones.tolist()):
        dealt[b] = np.random.default_rng([*seed, b]).multivariate_hypergeometric(sizes, n, method="marginals")
    return dealt


def dealt_wins(sizes: dict[int, int], ones: int, rounds: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For a range of levels, twice the pairs that each round's dealt labels win there: round, twice.

    Every task splits the labels over the ranges alike, by the seed; then it splits its range's share over its levels. sizes: rows of each range.
    """
    names = sorted(sizes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        here = names.index(int(group["range"].iloc[0]))
        shares = split_labels(np.array([sizes[r] for r in names]), np.full(rounds, ones), [seed, 0])
        n = group.sort_values("score")["n"].to_numpy()
        twice, below = np.empty(rounds, np.int64), shares[:, :here].sum(axis=1)
        for b in range(rounds):
            x = np.random.default_rng([seed, 1 + here, b]).multivariate_hypergeometric(n, shares[b, here], method="marginals")
            twice[b] = ((n - x) * (2 * (below[b] + np.cumsum(x) - x) + x)).sum()
        return pd.DataFrame({"round": np.arange(rounds), "twice": twice})

    return run


def permutation_p_of_levels(scores: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """auroc, p_value, rounds: share of the rounds of dealt labels whose AUROC is at least the real one.

    Rows of equal score are alike, so no row is dealt: a round splits the labels over the distinct scores by the multivariate hypergeometric distribution, first over ranges of
    scores and then, in each range on its own, over its scores. Work is rounds times distinct scores, spread by ranges. Without rows of both labels
    the AUROC is 0.5 and p is 1. At most MOST_ROWS rows can be dealt; more raise.
    """
    with Workspace(scores.sparkSession, "dealt") as work:
        grouped = scores.where("label IN (0, 1)").groupBy("score").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("pos"))
        ranged = in_score_ranges(grouped, work)
        told = ranged.groupBy("range").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()  # as many rows as there are ranges
        sizes, ones = {r["range"]: r["n"] for r in told}, sum(r["pos"] for r in told)
        total = sum(sizes.values())
        if total > MOST_ROWS:
            raise ValueError(f"{total} rows: labels of at most {MOST_ROWS} can be dealt")
        upto = running(ranged.drop("range").withColumn("all", F.lit(0)), ["all"], [F.col("score")], {"upto": F.col("pos")}, work)
        real = upto.withColumn("pos_below", F.col("upto") - F.col("pos")).withColumn("neg", F.col("n") - F.col("pos"))
        won = real.agg(F.coalesce(F.sum(F.col("neg") * (2 * F.col("pos_below") + F.col("pos"))), F.lit(0)).alias("real"))
        if not ones or ones == total:
            return work.keep(won.select(F.lit(0.5).alias("auroc"), F.lit(1.0).alias("p_value"), F.lit(rounds).cast("long").alias("rounds")), "p")
        each = ranged.groupBy("range").applyInPandas(dealt_wins(sizes, ones, rounds, seed), "round long, twice long").groupBy("round").agg(F.sum("twice").alias("twice"))
        p = each.join(F.broadcast(won)).groupBy("real").agg(F.avg((F.col("twice") >= F.col("real")).cast("int")).alias("p_value"), F.count("*").alias("rounds"))  # one row beside the rounds
        return work.keep(p.select((F.col("real") / (2.0 * ones * (total - ones))).alias("auroc"), "p_value", "rounds"), "p")


def swap_p_of_levels(pairs: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """delta, p_value, rounds of paired scores a, b: share of the rounds of fair coins that swap pairs with as large a mean difference.

    Pairs of equal difference are alike: a round draws how many of them keep their order. Work is rounds times distinct differences, spread by ranges. Pairs that lack a score are left out.
    """
    with Workspace(pairs.sparkSession, "swapped") as work:
        gap = F.col("a") - F.col("b")
        grouped = pairs.select(F.abs(gap).alias("score"), gap.alias("gap")).where("score IS NOT NULL").groupBy("score").agg(F.count("*").alias("n"), F.sum("gap").alias("sum"))
        ranged = in_score_ranges(grouped, work)
        real = ranged.agg(F.sum("n").alias("pairs"), (F.sum("sum") / F.sum("n")).alias("delta"))

        def run(group: pd.DataFrame) -> pd.DataFrame:
            levels = group.sort_values("score")
            n, size = levels["n"].to_numpy(), levels["score"].to_numpy()
            at, sums = int(group["range"].iloc[0]), np.empty(rounds)
            for b in range(rounds):
                kept = np.random.default_rng([seed, at, b]).binomial(n, 0.5)
                sums[b] = (size * (2 * kept - n)).sum()
            return pd.DataFrame({"round": np.arange(rounds), "sum": sums})

        each = ranged.groupBy("range").applyInPandas(run, "round long, sum double").groupBy("round").agg(F.sum("sum").alias("sum"))
        # sums of the same differences in another order differ by rounding
        as_large = F.abs(F.col("sum") / F.col("pairs")) >= F.abs("delta") * (1 - 1e-12)
        p = each.join(F.broadcast(real)).groupBy("delta").agg(F.avg(as_large.cast("int")).alias("p_value"), F.count("*").alias("rounds"))  # one row beside the rounds
        return work.keep(p, "p")
