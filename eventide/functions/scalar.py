"""Column functions: time buckets, the normal distribution, binning, fees, payoffs, intervals of confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the normal tail (Abramowitz and Stegun 26.2.17).
PHI_P = 0.2316419
PHI_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def finite(x) -> Column:
    """x where it is a finite number, else null."""
    x = _c(x)
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a, b) -> Column:
    """a / b, null where b is 0 or either is missing."""
    return F.try_divide(_c(a), _c(b))


def log_ratio(a, b) -> Column:
    """ln(a / b), null unless both are positive."""
    a, b = _c(a), _c(b)
    return F.when((a > 0) & (b > 0), F.ln(F.try_divide(a, b)))


#: Part of a unit of the last digit by which rounded() moves its border.
OFF_GRID = 0.0031


def rounded(x, digits: int) -> Column:
    """x to so many decimals, for reports.  The border lies at 0.4969 of a unit instead of a half: means and quantiles of
    values with few decimals often lie on a half exactly, where the order of a sum's terms would decide."""
    return F.round(_c(x) + off_grid(digits), digits)


def off_grid(digits: int) -> float:
    return float(f"{OFF_GRID * 10.0**-digits:.3g}")


#: Grid on which exact_sum() adds the greater part of a number.
SUM_GRID = 2.0**20


def exact_sum(x) -> Column:
    """The sum of a group's doubles, rounded once, so that no order of rows and no split into partial sums changes it; for
    sums whose sign decides, where terms that cancel would leave a rest by their order.

    Numbers are parted into multiples of 2 ** -20 and rests below that.  Both add up without rounding while the sums of the
    parts stay below 2 ** 33 (less than 131,072 rests, and no bit below 2 ** -57 among them)."""
    x = _c(x).cast("double")
    small = F.abs(x) < 2.0**32
    high = F.when(small, F.rint(x * SUM_GRID) / SUM_GRID).otherwise(x)
    return F.sum(high) + F.sum(F.when(small, x - high).otherwise(0.0))


def bucket(ts, width: int) -> Column:
    return F.floor(_c(ts) / width)


def next_boundary(ts, width: int) -> Column:
    """The first multiple of width strictly after ts."""
    return (bucket(ts, width) + 1) * width


def hour_of_day(seconds) -> Column:
    return F.floor(F.pmod(_c(seconds), F.lit(86400)) / 3600)


def day_of_week(seconds) -> Column:
    """Sunday is 0."""
    return F.pmod(F.floor(_c(seconds) / 86400) + 4, F.lit(7))


def millis_to_micros(ts) -> Column:
    """Epochs in milliseconds or microseconds as microseconds: anything under 2e12 is milliseconds."""
    ts = _c(ts)
    return F.when(ts < 2_000_000_000_000, ts * 1000).otherwise(ts)


def normal_cdf(z) -> Column:
    """Phi(z), to 7.5e-8."""
    z = _c(z)
    t = 1 / (1 + F.lit(PHI_P) * F.abs(z))
    poly = F.lit(0.0)
    for b in reversed(PHI_B):
        poly = (poly + b) * t
    tail = F.exp(-z * z / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def cut(x, breaks: Sequence[float], labels: Sequence[str], closed: str = "left") -> Column:
    """The label of the interval that x falls into: len(labels) = len(breaks) + 1."""
    x, out = _c(x), F.when(_c(x).isNull(), F.lit(None).cast("string"))
    for b, label in zip(breaks, labels):
        out = out.when(x < b if closed == "left" else x <= b, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def mirrored(price, side) -> Column:
    """The price of the side that is bought: the other side's complement."""
    return F.when(_c(side) == "up", _c(price)).otherwise(1 - _c(price))


def taker_fee(shares, price, rate, exponent=1.0) -> Column:
    """shares * rate * (p (1 - p)) ** exponent, to five decimals, halves up."""
    p = _c(price)
    return F.floor(_c(shares) * _c(rate) * F.pow(p * (1 - p), _c(exponent)) * 1e5 + 0.5) / 1e5


def break_even(price, rate) -> Column:
    """The win rate at which buying at this price and paying the fee neither wins nor loses."""
    p = _c(price)
    return p + _c(rate) * p * (1 - p)


def wilson(wins, n, z: float = 1.96) -> tuple[Column, Column]:
    """The bounds of the Wilson interval; null without trials."""
    n = F.when(_c(n) > 0, _c(n).cast("double"))
    p = _c(wins) / n
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - half, middle + half


def two_proportion_z(w1, n1, w2, n2) -> Column:
    """z of the difference of two rates; null with an empty arm or without variance."""
    w1, n1, w2, n2 = _c(w1), F.when(_c(n1) > 0, _c(n1)), _c(w2), F.when(_c(n2) > 0, _c(n2))
    p = (w1 + w2) / (n1 + n2)
    return ratio(w1 / n1 - w2 / n2, F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2)))


def runs_z(runs, n1, n0) -> Column:
    """z of the number of runs; null where it has no variance, as with one outcome of each kind or of one kind only."""
    n1, n0 = _c(n1).cast("double"), _c(n0).cast("double")
    n, m = n1 + n0, 2 * n1 * n0
    return ratio(_c(runs) - (1 + ratio(m, n)), F.sqrt(ratio(m * (m - n), n * n * (n - 1))))


def imbalance(bid, ask) -> Column:
    total = _c(bid) + _c(ask)
    return F.when(total > 0, (_c(bid) - _c(ask)) / total)


def payoff(stake, price, won, rate) -> Column:
    """Hold to the end: what the shares pay, less the stake and the fee; null at a price of 0."""
    shares = ratio(_c(stake), _c(price))
    return shares * _c(won) - _c(stake) - shares * _c(rate) * _c(price) * (1 - _c(price))


def barrier_exit(target, stop_price, final, touched) -> Column:
    """The price at which a position ends: its target if touched, else the stop's price, else what it settles at."""
    return F.when(_c(touched), _c(target)).otherwise(F.coalesce(_c(stop_price), _c(final)))


PHI_SQL = "CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"


def normal_cdf_sql(z: str) -> str:
    """The same formula as DuckDB SQL."""
    t = f"(1 / (1 + {PHI_P}::DOUBLE * abs({z})))"
    poly = "0.0::DOUBLE"
    for b in reversed(PHI_B):
        poly = f"(({poly} + {b}::DOUBLE) * {t})"
    tail = f"(exp(-({z}) * ({z}) / 2) * 0.3989422804014327::DOUBLE * {poly})"
    return PHI_SQL.format(z=z, tail=tail)
