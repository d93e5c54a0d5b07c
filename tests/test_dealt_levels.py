"""Permutation and swap tests on counts of distinct scores."""

from itertools import combinations, product

import numpy as np
import pytest

from traceloom.operators import metrics

SCORES = [0.1, 0.1, 0.2, 0.2, 0.2, 0.5, 0.7, 0.7, 0.9]
ONES = (0, 2, 3, 5)


def twice_won(ones):
    return sum(2 * (SCORES[i] < SCORES[j]) + (SCORES[i] == SCORES[j]) for i in ones for j in range(len(SCORES)) if j not in ones)


@pytest.mark.parametrize("ranges", [1, 4])
def test_permutation_p_against_all_ways_to_deal(spark, ranges):
    real = twice_won(ONES)
    ways = [twice_won(c) for c in combinations(range(len(SCORES)), len(ONES))]
    exact = sum(w >= real for w in ways) / len(ways)
    rows = spark.createDataFrame([(s, int(i in ONES)) for i, s in enumerate(SCORES)], "score double, label int")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        r = metrics.permutation_p_of_levels(rows, 4000).first()
        again = metrics.permutation_p_of_levels(rows, 4000).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert r == again and r.rounds == 4000
    assert r.auroc == pytest.approx(real / (2 * len(ONES) * (len(SCORES) - len(ONES))))
    assert r.p_value == pytest.approx(exact, abs=4 * (exact * (1 - exact) / 4000) ** 0.5)


def test_splits_deal_all_labels_alike():
    dealt = metrics.split_labels(np.array([3, 1, 4]), np.full(6000, 4), [1])
    assert (dealt.sum(1) == 4).all() and (dealt <= [3, 1, 4]).all()
    assert dealt.mean(0) == pytest.approx([1.5, 0.5, 2.0], abs=0.05)
    # of 70 ways, those with the lone row of the second level: C(7, 3)
    assert (dealt[:, 1] == 1).mean() == pytest.approx(35 / 70, abs=0.03)


def test_permutation_of_one_label_or_no_rows(spark):
    rows = spark.createDataFrame([(0.5, 1), (0.6, 1)], "score double, label int")
    for df in (rows, rows.limit(0)):
        assert tuple(metrics.permutation_p_of_levels(df, 10).first()) == (0.5, 1.0, 10)


def test_ten_million_rows_cost_their_distinct_scores(spark):
    rows = spark.range(10_000_000).selectExpr("(id % 997) / 997D AS score", "CAST((id * 2654435761) % 7 < 3 AS INT) AS label")
    r = metrics.permutation_p_of_levels(rows, 200).first()
    assert r.auroc == pytest.approx(0.5, abs=0.001) and 0 <= r.p_value <= 1


def test_swap_p_against_all_coins(spark):
    gaps = [0.5, -0.25, 0.5, 1.0, 0.0, 0.75, -0.5]
    delta = sum(gaps) / len(gaps)
    exact = np.mean([abs(sum(c * g for c, g in zip(coins, gaps, strict=True)) / len(gaps)) >= abs(delta) for coins in product((1, -1), repeat=len(gaps))])
    rows = spark.createDataFrame([(g, 0.0) for g in gaps] + [(None, 1.0)], "a double, b double")
    r = metrics.swap_p_of_levels(rows, 4000).first()
    assert r.delta == pytest.approx(delta) and r.p_value == pytest.approx(exact, abs=0.03)
