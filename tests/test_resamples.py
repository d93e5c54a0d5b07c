"""Resampling at the registered number of rounds, against brute force on a small fixture."""

import hashlib
import math

import pytest

from traceloom.operators import metrics
from traceloom.plans import registry
from traceloom.plans import scores as plans

B = 1000
ROWS = [(f"p{i:02}", f"s{i % 5}", (i * 7 % 11) / 10, (i * 5 % 7) / 10, int((i * 7 % 11) + i * i % 9 < 8)) for i in range(30)]


def drawn(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def auroc(rows):
    one, zero = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((a < b) + (a == b) / 2 for a in one for b in zero) / (len(one) * len(zero)) if one and zero else 0.5


@pytest.fixture
def given(spark, monkeypatch):
    rows = spark.createDataFrame(ROWS, "pair_id string, source string, score double, other double, label long")
    monkeypatch.setattr(plans, "scored", lambda spark, sf_dir: rows)


def interval(by):
    units = sorted({r[by] for r in ROWS})
    each = []
    for b in range(B):
        picked = [units[drawn(42, b, i) % len(units)] for i in range(len(units))]
        each.append(auroc([(r[2], r[4]) for u in picked for r in ROWS if r[by] == u]))
    each.sort()
    return each[math.floor(0.025 * B)], each[math.ceil(0.975 * B) - 1]


@pytest.mark.parametrize(("name", "by"), [("bootstrap_auroc", 0), ("cluster_bootstrap_auroc", 1)])
def test_bootstrap_of_a_thousand_rounds(spark, given, name, by):
    r = registry.queries()[name](spark, "").first()
    assert (r.low, r.high) == pytest.approx(interval(by), abs=1e-6)


def test_permutations_of_a_thousand_rounds(spark, given):
    keys, real = sorted(r[0] for r in ROWS), auroc([(r[2], r[4]) for r in ROWS])
    label = {r[0]: r[4] for r in ROWS}
    ordered = sorted(ROWS)
    dealt = [[label[k] for k in sorted(keys, key=lambda k: (drawn(42, b, k), k))] for b in range(B)]
    beyond = sum(auroc([(r[2], y) for r, y in zip(ordered, labels, strict=True)]) >= real for labels in dealt)
    r = registry.queries()["permutation_test"](spark, "").first()
    assert (r.auroc, r.p_value) == pytest.approx((real, beyond / B), abs=1e-6)


def test_swaps_of_a_thousand_rounds(spark, given):
    gaps = {r[0]: r[2] - r[3] for r in ROWS}
    delta = sum(gaps.values()) / len(gaps)
    dealt = [sum(g if drawn(42, b, k) % 2 == 0 else -g for k, g in gaps.items()) / len(gaps) for b in range(B)]
    r = registry.queries()["swap_test"](spark, "").first()
    # equal sums can differ in their last bit from one order of adding to another
    near = [sum(abs(d) >= abs(delta) + e for d in dealt) / B for e in (1e-9, -1e-9)]
    assert r.delta == pytest.approx(delta, abs=1e-6) and near[0] <= r.p_value <= near[1] and near[1] - near[0] < 0.05


def test_a_lone_class_and_no_rows(spark):
    rows = spark.createDataFrame([("a", 0.1, 1), ("b", 0.2, 1)], "pair_id string, score double, label long")
    assert metrics.bootstrap_ci(rows, 40).first().low == 0.5
    assert metrics.bootstrap_ci(rows.limit(0), 40).first().low is None
