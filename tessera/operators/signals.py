"""Technical and cross-sectional signals, volatility and risk filters, costs and position rules: windows and column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import frames as fr


def sma(n: int, x: str = "close", by: str = "asset") -> Column:
    """Mean of the last n rows, null unless all are present."""
    w = fr.trailing(n, by)
    return fr.full(F.avg(x).over(w), F.col(x), n, w)


def technical(panel: DataFrame, fast: int = 20, slow: int = 60, span: int = 20, trend_filter: bool = True, by: str = "asset") -> DataFrame:
    """Crosses of two means, breaks of the prior span's extremes, the slow trend's filter on crosses, and the signal. All windows share one
    shuffle and one sort by asset. Prior extremes are of lows and highs where the panel has both, else of closes."""
    if not 1 <= fast < slow or span < 1:
        raise ValueError("windows must be positive and the fast one the shorter")
    high, low = ("high", "low") if {"high", "low"} <= set(panel.columns) else ("close", "close")
    o, before = fr.ordered(by), fr.prior(span, by)
    out = panel.withColumns({"fast_sma": sma(fast, by=by), "slow_sma": sma(slow, by=by), "support": fr.full(F.min(low).over(before), F.col(low), span, before), "resistance": fr.full(F.max(high).over(before), F.col(high), span, before)})
    f, s, c = F.col("fast_sma"), F.col("slow_sma"), F.col("close")
    out = out.withColumns({"pf": F.lag(f).over(o), "ps": F.lag(s).over(o)})
    pf, ps = F.col("pf"), F.col("ps")
    out = out.withColumns(
        {
            "golden_cross": fr.flag((f > s) & (pf <= ps)), "death_cross": fr.flag((f < s) & (pf >= ps)), "breakout": fr.flag(c > F.col("resistance")), "breakdown": fr.flag(c < F.col("support")),
            "slow_trend": F.signum(s - ps).cast("int"),
        }
    ).drop("pf", "ps")
    t = F.col("slow_trend")
    falling, rising = (fr.flag(t < 0), fr.flag(t > 0)) if trend_filter else (F.lit(False), F.lit(False))
    out = out.withColumns({"suppressed_golden": F.col("golden_cross") & falling, "suppressed_death": F.col("death_cross") & rising})
    bull = (F.col("golden_cross") & ~F.col("suppressed_golden")) | F.col("breakout")
    bear = (F.col("death_cross") & ~F.col("suppressed_death")) | F.col("breakdown")
    return out.withColumn("signal", F.when(c.isNull(), 0).when(bull & ~bear, 1).when(bear & ~bull, -1).otherwise(0))


def candles(bars: DataFrame) -> DataFrame:
    """Body and shadows as shares of the range, and the range over the close; null without a range."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = F.nullif(h - l, F.lit(0.0))
    return bars.withColumns({"body": F.abs(c - o) / span, "upper_shadow": (h - F.greatest(o, c)) / span, "lower_shadow": (F.least(o, c) - l) / span, "range_fraction": fr.ratio(h - l, c)})


def combine_factors(panel: DataFrame, weights: dict[str, float], standardize: bool = True, at: str = "dt") -> DataFrame:
    """score: weighted sum of the factors' z-scores by date, standardised again. A factor that the panel lacks is an error."""
    if missing := set(weights) - set(panel.columns):
        raise KeyError(f"no factor {sorted(missing)}")
    w = fr.group(at)
    total = reduce(Column.__add__, [(fr.zscore(F.col(k), w) if standardize else F.col(k)) * F.lit(float(v)) for k, v in weights.items()])
    out = panel.withColumn("score", total)
    return out.withColumn("score", fr.zscore(F.col("score"), w)) if standardize else out


def rolling_volatility(ret: str = "ret", lookback: int = 21, periods: float = 252, minimum: int | None = None, by: str = "asset") -> Column:
    """Annualised sample deviation of the last rows: the frame must be full, with `minimum` returns present."""
    w = fr.trailing(lookback, by)
    enough = (F.count(F.lit(1)).over(w) == lookback) & (F.count(ret).over(w) >= (lookback if minimum is None else minimum))
    return F.when(enough, F.stddev_samp(ret).over(w) * F.sqrt(F.lit(float(periods))))


def volatility_adjusted(signal: Column, vol: Column, target: float = 0.1, most: float = 2.0) -> Column:
    """signal * min(target / vol, most); no volatility known gives 0, zero volatility the most."""
    return F.when(vol.isNull() | signal.isNull(), 0.0).when(vol == 0, signal * most).otherwise(signal * F.least(F.lit(target) / F.nullif(vol, F.lit(0.0)), F.lit(most)))


def momentum(panel: DataFrame, lookback: int = 21, saturation: float = 2.0, threshold: float = 0.0, ret: str = "ret", by: str = "asset", at: str = "dt") -> DataFrame:
    """momentum: tanh of the cross-sectional z-score of the summed returns, 0 below the threshold, null unless the window is complete."""
    w = fr.trailing(lookback, by, at)
    out = panel.withColumn("_sum", fr.full(F.sum(ret).over(w), F.col(ret), lookback, w))
    x = F.tanh(fr.zscore(F.col("_sum"), fr.group(at)) / saturation)
    return out.withColumn("momentum", F.when(F.col("_sum").isNotNull(), F.when(F.abs(x) < threshold, 0.0).otherwise(x))).drop("_sum")


def long_short(scores: DataFrame, quantile: float = 0.2, score: str = "score", by: str = "asset", at: str | list[str] = "dt") -> DataFrame:
    """weight: +-1/n for the best and worst n = max(1, floor(quantile * count)) of a date, 0 between; ties by name."""
    if not 0 < quantile < 0.5:
        raise ValueError("quantile must lie between 0 and 0.5")
    day = [at] if isinstance(at, str) else at
    live = scores.filter(F.col(score).isNotNull())
    order = W.partitionBy(*day).orderBy(F.desc(score), by)
    live = live.withColumns({"_k": F.row_number().over(order), "_n": F.count("*").over(W.partitionBy(*day))})
    nq = F.greatest(F.lit(1), F.floor(F.lit(quantile) * F.col("_n") + 1e-12))
    return live.withColumn("weight", F.when(F.col("_k") <= nq, 1 / nq).when(F.col("_k") > F.col("_n") - nq, -1 / nq).otherwise(0.0)).drop("_k", "_n")


def rank_features(rows: DataFrame, columns: list[str], at: str = "dt") -> DataFrame:
    """The columns as average ranks by date, centred and scaled: (rank - 0.5) / n - 0.5, missing ones staying so. Many columns of a date are ranked in one
    pass over its cross-section instead of a sort each."""
    import pandas as pd

    kinds = ", ".join(f"{f.name} {'double' if f.name in columns else f.dataType.simpleString()}" for f in rows.schema)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(**((frame[columns].rank() - 0.5) / len(frame) - 0.5))

    return rows.groupBy(at).applyInPandas(one, kinds)


def first_last(scores: DataFrame, n: int, score: str, by: str, at: str) -> DataFrame:
    """weight: +-1/n for the n highest and lowest scores of a date."""
    up, down = W.partitionBy(at).orderBy(F.desc(score), by), W.partitionBy(at).orderBy(score, F.desc(by))
    return scores.withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down)}).withColumn("weight", (F.when(F.col("_u") <= n, 1.0).otherwise(0.0) - F.when(F.col("_d") <= n, 1.0).otherwise(0.0)) / n).drop("_u", "_d")


def cost_guard(signal: Column, edge: Column, turnover: Column, spread: float = 2.9, reference: float = 1.989, multiple: float = 1.0) -> dict[str, Column]:
    """Break-even and required edge, approval and their ratio (infinite where nothing is required)."""
    even = spread * turnover / reference
    need = multiple * even
    ok = edge.isNotNull() & turnover.isNotNull() & fr.flag(signal != 0) & fr.flag(F.abs(edge) >= need)
    return {"break_even_bps": even, "required_edge_bps": need, "approved": ok, "efficiency": F.when(need == 0, float("inf")).otherwise(F.abs(edge) / F.nullif(need, F.lit(0.0)))}


def share_quantity(cash: Column, price: Column, unit: int = 1000, odd: bool = True) -> dict[str, Column]:
    n = F.floor(cash / price).cast("long")
    lots = F.floor(n / unit).cast("long")
    rest = n - lots * unit if odd else F.lit(0).cast("long")
    return {"board_lots": lots, "odd_lot_shares": rest, "total_shares": lots * unit + rest, "notional": (lots * unit + rest) * price}


def settlement(cash: Column, requested: Column, pending: Column) -> dict[str, Column]:
    """Cash settled and not bound; proceeds not yet settled do not count."""
    free = F.greatest(F.lit(0.0), cash - pending)
    return {"available_settled_cash": free, "approved": requested <= free + 1e-9 * F.greatest(F.lit(1.0), free)}


def stop_loss(entry: Column, price: Column, loss: float = 0.07) -> Column:
    return (entry - price) / entry >= loss - 1e-12


def limit_price(side: Column, price: Column, bps: float) -> Column:
    up = 1 + bps / 1e4
    return F.round(F.when(side == "BUY", price * up).otherwise(price * (2 - up)), 8)


def risk_assess(weights: DataFrame, book: DataFrame, target: float = 0.1, lookback: int = 21, periods: float = 252, most: float = 2.0, max_drawdown: float = 0.15, min_stop: float = 0.05, recovery: float = 0.2) -> DataFrame:
    """weights (book, asset, w, approved) scaled by the state of their book (book, dt, ret, equity): volatility of the last returns, drawdown
    against the peak, a stop that tightens as volatility rises, and a scale that shrinks on the way to it. The guard comes before
    leverage; a stopped book holds nothing."""
    last = W.partitionBy("book").orderBy(F.desc("dt"))
    r = book.filter("ret is not null").withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= lookback)
    vol = r.groupBy("book").agg(F.when(F.count("*") == lookback, F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))).alias("vol"))
    state = book.groupBy("book").agg((F.max_by("equity", "dt") / F.max("equity") - 1).alias("drawdown")).join(vol, "book", "left")
    good = F.coalesce(F.col("vol") > 0, F.lit(False))
    state = state.withColumns({
        "volatility_scale": F.when(good, F.least(F.lit(most), target / F.nullif(F.col("vol"), F.lit(0.0)))).otherwise(0.0),
        "stop": F.when(good, F.least(F.greatest(max_drawdown * target / F.nullif(F.col("vol"), F.lit(0.0)), F.lit(min_stop)), F.lit(max_drawdown))).otherwise(F.lit(max_drawdown)),
    })
    state = state.withColumns({"drawdown_scale": recovery + (1 - recovery) * F.greatest(F.lit(0.0), 1 - F.abs("drawdown") / F.col("stop")), "stopped_out": F.col("drawdown") <= -F.col("stop")})
    guarded = F.when(F.col("approved"), F.col("w")).otherwise(0.0)
    out = weights.join(state, "book").withColumn("guarded", guarded)
    return out.withColumn("risk_adjusted", F.when(F.col("stopped_out"), 0.0).otherwise(F.col("guarded") * F.col("volatility_scale") * F.col("drawdown_scale")))


def turnover(weights: DataFrame, w: str = "weight", by: str = "asset", at: str = "dt") -> DataFrame:
    """(dt, turnover): summed changes of weight, an absent row being 0 before; the first date's is its gross weight."""
    change = F.abs(F.col(w) - F.coalesce(F.lag(w).over(fr.ordered(by, at)), F.lit(0.0)))
    return weights.withColumn("_c", change).groupBy(at).agg(F.sum("_c").alias("turnover"))
