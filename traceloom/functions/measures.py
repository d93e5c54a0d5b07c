"""Measures as column expressions: entropies, clamps, effect sizes, the normal distribution."""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """top / bottom, or a fixed value where the bottom is 0."""
    return F.when(bottom == 0, empty).otherwise(top / F.when(bottom != 0, bottom))


def entropy_parts(n: Column, total: Column) -> Column:
    """A count's share of the entropy in bits, to be summed."""
    return F.when(n > 0, -(n / total) * F.log2(n / total)).otherwise(0.0)


def normalised_entropy(bits: Column, distinct: Column) -> Column:
    """Bits over the log of the number of distinct values; 0 for at most one value."""
    return F.when(distinct <= 1, 0.0).otherwise(bits / F.log2(distinct.cast("double")))


def binary_entropy(p: Column) -> Column:
    p = clamp(p, 1e-9, 1 - 1e-9)
    return -(p * F.log2(p) + (1 - p) * F.log2(1 - p))


def cohens_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def hanley_mcneil_se(auroc: Column, positives: Column, negatives: Column) -> Column:
    q1, q2 = auroc / (2 - auroc), 2 * auroc * auroc / (1 + auroc)
    return F.sqrt((auroc * (1 - auroc) + (positives - 1) * (q1 - auroc * auroc) + (negatives - 1) * (q2 - auroc * auroc)) / (positives * negatives))


def normal_sf(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0, to 1.5e-7.

    Fixed values: formula 7.1.26 of Abramowitz and Stegun.
    """
    x = z / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * poly * F.exp(-x * x)


def chi2_sf_1df(chi2: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom: twice the normal tail at its root."""
    return F.least(F.lit(1.0), 2 * normal_sf(F.sqrt(chi2)))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """Inverse of normal_cdf by bisection."""
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if normal_cdf(middle) < p else (low, middle)
    return (low + high) / 2


def both_tails(shift: float, alpha: float) -> float:
    """Power of a two-sided normal test whose statistic is shifted."""
    critical = normal_ppf(1 - alpha / 2)
    return min(1.0, normal_cdf(shift - critical) + normal_cdf(-shift - critical))


#: Of the discordant pairs two thirds lie on one side; the rank-sum test's efficiency against the t-test is pi / 3.
SIDE, EFFICIENCY = 2 / 3, math.pi / 3


def mcnemar_power(n: int, discordant: float, alpha: float = 0.05) -> float:
    """Power of McNemar's test on n pairs; discordant: the share of pairs on which the methods differ."""
    return 0.0 if n * discordant < 1 else both_tails(math.sqrt(n * discordant) * (2 * SIDE - 1), alpha)


def mann_whitney_power(n: int, effect: float, alpha: float = 0.05) -> float:
    """Power of the rank-sum test with n in each group, for an effect in standard deviations."""
    return both_tails(effect * math.sqrt(EFFICIENCY) * math.sqrt(n / 2), alpha)


def least_discordance(n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """The least share of discordant pairs that n pairs detect with a power."""
    return round(smallest(lambda p: mcnemar_power(n, p, alpha) >= power, 0.001, 0.999), 4)


def least_effect(n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """The least effect that n in each group detect with a power."""
    return round(smallest(lambda d: mann_whitney_power(n, d, alpha) >= power, 0.01, 5.0), 4)


#: The numbers of pairs within which one is sought.
PAIRS = range(10, 20_001)


def least_pairs(power: float, discordant: float, alpha: float = 0.05) -> int:
    """The least number of pairs that reach a power, by bisection, as power grows with them; the greatest if none does."""
    at = bisect.bisect_left(PAIRS, power, key=lambda n: mcnemar_power(n, discordant, alpha))
    return PAIRS[min(at, len(PAIRS) - 1)]


def normal_cdf_of(x: Column) -> Column:
    return F.when(x >= 0, 1 - normal_sf(x)).otherwise(normal_sf(-x))


def both_tails_of(shift: Column, alpha: float) -> Column:
    critical = normal_ppf(1 - alpha / 2)
    return clamp(normal_cdf_of(shift - critical) + normal_cdf_of(-shift - critical))


def mcnemar_power_of(n: Column, discordant: float, alpha: float = 0.05) -> Column:
    return F.when(n * discordant < 1, 0.0).otherwise(both_tails_of(F.sqrt(n * discordant) * (2 * SIDE - 1), alpha))


def mann_whitney_power_of(n: Column, effect: float, alpha: float = 0.05) -> Column:
    return both_tails_of(effect * math.sqrt(EFFICIENCY) * F.sqrt(n / 2), alpha)


def smallest(reaches, low: float, high: float) -> float:
    """Least x between two bounds for which a monotone condition holds, by bisection."""
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if reaches(middle) else (middle, high)
    return high
