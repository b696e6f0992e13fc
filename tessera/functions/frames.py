"""Windows and column expressions that operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(by: str = "asset", at: str = "dt"):
    return W.partitionBy(by).orderBy(at)


def trailing(n: int, by: str = "asset", at: str = "dt"):
    """The last n rows, the current one included."""
    return ordered(by, at).rowsBetween(-(n - 1), 0)


def prior(n: int, by: str = "asset", at: str = "dt"):
    """The n rows before the current one."""
    return ordered(by, at).rowsBetween(-n, -1)


def running(by: str = "asset", at: str = "dt"):
    return ordered(by, at).rowsBetween(W.unboundedPreceding, 0)


def before(by: str = "asset", at: str = "dt"):
    return ordered(by, at).rowsBetween(W.unboundedPreceding, -1)


def group(by: str = "dt"):
    return W.partitionBy(by)


def full(value: Column, x: Column, n: int, frame) -> Column:
    """value where the frame holds n non-null x, else null."""
    return F.when(F.count(x).over(frame) == n, value)


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def simple_return(x: Column, w) -> Column:
    return ratio(x, F.lag(x).over(w)) - 1


def zscore(x: Column, w, keep_null: bool = False) -> Column:
    """Population z-score; a missing value or no spread gives 0."""
    z = ratio(x - F.avg(x).over(w), F.stddev_pop(x).over(w))
    return z if keep_null else F.coalesce(z, F.lit(0.0))


def tied_rank(x: Column, by: Sequence[str]) -> Column:
    """1-based average rank of equal values among non-null ones."""
    own = W.partitionBy(*by).orderBy(x.asc_nulls_last())  # one sort gives both, and all ranks of a group share its shuffle
    peers = own.rangeBetween(W.currentRow, W.currentRow)
    return F.when(x.isNotNull(), F.rank().over(own) + (F.count(F.lit(1)).over(peers) - 1) / 2)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, null without spread, as an aggregate."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def sharpe(r: Column, periods: float = 252.0) -> Column:
    return ratio(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(periods))


def dot(values: Column, weights: Sequence[float]) -> Column:
    """Inner product of an array column with literal weights."""
    lit = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(values, lit, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def chebyshev_u(degree: int, x: Column) -> Column:
    """U_degree(x), the recurrence unrolled."""
    before_, now = F.lit(0.0), F.lit(1.0)
    for _ in range(degree):
        before_, now = now, 2 * x * now - before_
    return now


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def flag(x: Column) -> Column:
    """Comparisons with missing values are false."""
    return F.coalesce(x, F.lit(False))


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)
