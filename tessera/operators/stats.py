"""Aggregates, performance measures, correlations and checks."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import frames as fr


def median_mad(df: DataFrame, x: str, by: str) -> DataFrame:
    """(by, med, mad): two passes over the groups' values."""
    med = df.groupBy(by).agg(F.median(x).alias("med"))
    return df.join(med, by).groupBy(by, "med").agg(F.median(F.abs(F.col(x) - F.col("med"))).alias("mad")).select(by, "med", "mad")


def mad_sigma(panel: DataFrame, x: str = "close", by: str = "asset", at: str = "dt") -> DataFrame:
    """Noise level from the first differences: 1.4826 * MAD / sqrt(2)."""
    d = panel.select(by, (F.col(x) - F.lag(x).over(fr.ordered(by, at))).alias("d"))
    return median_mad(d, "d", by).select(by, (1.4826 * F.col("mad") / F.sqrt(F.lit(2.0))).alias("sigma"))


def equity(returns: DataFrame, by: list[str], ret: str = "ret", at: str = "dt") -> DataFrame:
    """equity: compounded returns, missing ones left out; peak: its running maximum."""
    w = W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    live = returns.filter(F.col(ret).isNotNull()).withColumn("equity", F.product(1 + F.col(ret)).over(w))
    return live.withColumn("peak", F.max("equity").over(w))


def drawdown(returns: DataFrame, by: list[str], ret: str = "ret", at: str = "dt", convention: str = "report") -> DataFrame:
    """Deepest fall. report: peak starts at 1, result at most 0; backtest: peak starts at the first equity, result at least 0."""
    e = equity(returns, by, ret, at)
    if convention == "report":
        x = F.min(F.col("equity") / F.greatest("peak", F.lit(1.0)) - 1)
    elif convention == "backtest":
        x = F.max(1 - F.col("equity") / F.col("peak"))
    else:
        raise ValueError("convention is report or backtest")
    return e.groupBy(*by).agg(fr.tidy(x).alias("max_drawdown"))


def performance(returns: DataFrame, by: list[str], ret: str = "ret", at: str = "dt", periods: float = 252) -> DataFrame:
    """observations, total and annual return, Sharpe (null without spread) and drawdown by group; missing returns are left out."""
    e = equity(returns, by, ret, at)
    r = F.col(ret)
    wealth = F.product(1 + r)
    return e.groupBy(*by).agg(
        F.count("*").alias("observations"), fr.tidy(wealth - 1).alias("total_return"), fr.tidy(F.pow(wealth, F.lit(float(periods)) / F.count("*")) - 1).alias("annual_return"),
        fr.tidy(fr.sharpe(r, periods)).alias("sharpe"), fr.tidy(F.min(F.col("equity") / F.greatest("peak", F.lit(1.0)) - 1)).alias("max_drawdown"),
    )


def rank_ic(panel: DataFrame, score: str, target: str, at: str = "dt") -> DataFrame:
    """(dt, ic, n): correlation of tied ranks by date, null without spread."""
    ranked = panel.filter(F.col(score).isNotNull() & F.col(target).isNotNull()).select(at, fr.tied_rank(F.col(score), [at]).alias("a"), fr.tied_rank(F.col(target), [at]).alias("b"))
    return ranked.groupBy(at).agg(fr.correlation(F.col("a"), F.col("b")).alias("ic"), F.count("*").alias("n"))


def pair_correlations(panel: DataFrame, x: str, by: str = "asset", at: str = "dt") -> DataFrame:
    """(i, j, corr) over common dates: the join is on dates, the pairs are those of the assets of one date."""
    a = panel.select(F.col(at), F.col(by).alias("i"), F.col(x).alias("xi"))
    b = panel.select(F.col(at), F.col(by).alias("j"), F.col(x).alias("xj"))
    return a.join(b, at).filter("i < j").groupBy("i", "j").agg(fr.correlation(F.col("xi"), F.col("xj")).alias("corr"))


def hit_rates(panel: DataFrame, up: Column, actual: Column, by: list[str]) -> DataFrame:
    """accuracy of the sign, and the same weighted by the size of the actual value."""
    hit = up == (actual >= 0)
    return panel.groupBy(*by).agg(fr.tidy(F.avg(hit.cast("double"))).alias("accuracy"), fr.tidy(fr.ratio(F.sum(F.when(hit, F.abs(actual)).otherwise(0.0)), F.sum(F.abs(actual)))).alias("weighted"))


def p_value(null: DataFrame, x: str, observed: DataFrame) -> DataFrame:
    """(p): (1 + runs at least as large as observed) / (1 + runs); observed is one row (obs)."""
    return null.join(F.broadcast(observed)).agg(((1 + F.count_if(F.col(x) >= F.col("obs"))) / (1.0 + F.count(x))).alias("p"))


def inner_product(a: Column, b: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: x * y), weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)


def offsets(counts: DataFrame, at: str = "dt", n: str = "n") -> DataFrame:
    """First row number of each date's block when rows are laid out by date. One row a date: the running sum is over dates only."""
    return counts.withColumn("first_row", F.sum(n).over(W.orderBy(at)) - F.col(n))


def leak_test(panel: DataFrame, operator: Callable[[DataFrame], DataFrame], upto: str, at: str = "dt", x: str = "close") -> DataFrame:
    """(changed): rows up to a date that change when all later values do; 0 for a causal operator."""
    later = F.col(at) > F.lit(upto).cast("date")
    shocked = panel.withColumn(x, F.when(later, F.col(x) * 3 + 17).otherwise(F.col(x)))
    a, b = (operator(p).filter(~later) for p in (panel, shocked))
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias("changed"))


def expanding_median(df: DataFrame, x: str, name: str, by: str = "asset", at: str = "dt", least: int = 1) -> DataFrame:
    """name: the median of the values before a row, null with fewer than `least`; missing ones are left out. One ordered pass a series, with the
    lower half of the past in one heap and the upper half in another."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(at)
        low, high, out = [], [], []  # low holds negatives, and one more than high if the count is odd
        for v in frame[x]:
            n = len(low) + len(high)
            out.append(None if n < max(least, 1) else -low[0] if n % 2 else (high[0] - low[0]) / 2)
            if v is not None and v == v:
                heapq.heappush(high, -heapq.heappushpop(low, -float(v)))
                if len(high) > len(low):
                    heapq.heappush(low, -heapq.heappop(high))
        return frame.assign(**{name: pd.Series(out, index=frame.index, dtype=object)})

    return df.groupBy(by).applyInPandas(one, f"{kinds}, {name} double")


def priority_pick(df: DataFrame, by: list[str], value: str, preferred: Column, order: Column) -> DataFrame:
    """One value a group: that of the first preferred row, or else of the first row."""
    return df.groupBy(*by).agg(F.min_by(value, F.struct((~F.coalesce(preferred, F.lit(False))).alias("_p"), order.alias("_o"))).alias(value))
