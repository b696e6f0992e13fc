"""Total returns, implied yields, the hold state and the decision loop."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import frames as fr
from tessera.operators import align, features
from tessera.operators import signals as sig


def total_return(panel: DataFrame, rates: DataFrame, unit, day_count: float = 360.0) -> DataFrame:
    """panel with diff (own rate minus the unit's, as of each date) and growth: price relative times one plus the carry since the row before."""
    p = panel.select("dt", "asset", "close")
    own = align.as_of(p, rates.select(F.col("cur").alias("asset"), "valid_from", "rate"), "asset", "dt", "valid_from", "rate")
    num = _unit(own, rates, unit)
    o = fr.ordered()
    days = F.datediff("dt", F.lag("dt").over(o))
    out = num.withColumn("diff", F.col("rate") - F.col("num"))
    return out.withColumn("growth", fr.ratio(F.col("close"), F.lag("close").over(o)) * (1 + F.col("diff") * days / day_count))


def _unit(own: DataFrame, rates: DataFrame, unit) -> DataFrame:
    """The unit's rate on each date: dates are matched as one small series, then joined back, so that no key holds all rows."""
    dates = own.select("dt").distinct().withColumn("key", F.lit(1))
    num = rates.filter(F.col("cur") == unit).select(F.lit(1).alias("key"), "valid_from", F.col("rate").alias("num"))
    return own.join(align.as_of(dates, num, "key", "dt", "valid_from", "num").drop("key"), "dt")


def implied_yield(panel: DataFrame, adjusted: str, unadjusted: str, periods: float = 252, geometric: bool = False) -> DataFrame:
    """(asset, yield): growth of adjusted over unadjusted prices: a log rate per `periods` rows, or the difference of compound rates per year."""
    g = panel.groupBy("asset").agg(
        F.min_by(adjusted, "dt").alias("a0"), F.max_by(adjusted, "dt").alias("a1"), F.min_by(unadjusted, "dt").alias("u0"), F.max_by(unadjusted, "dt").alias("u1"),
        (F.count("*") - 1).alias("n"), (F.datediff(F.max("dt"), F.min("dt")) / 365.2425).alias("years"),
    )
    a, u = F.col("a1") / F.col("a0"), F.col("u1") / F.col("u0")
    y = F.pow(a, 1 / F.nullif(F.col("years"), F.lit(0.0))) - F.pow(u, 1 / F.nullif(F.col("years"), F.lit(0.0))) if geometric else (F.ln(a) - F.ln(u)) * periods / F.nullif(F.col("n"), F.lit(0))
    return g.select("asset", y.alias("yield"))


def hold_state(signals: DataFrame, loss: float = 0.07, by: str = "asset", at: str = "dt") -> DataFrame:
    """held (0 or 1), entry and breached after each row: enter on +1, leave on -1 or when the price has fallen `loss` below the entry. A recursion on
    an asset's own rows: one ordered pass a group."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(at)
        held, entry, out = 0, None, []
        for price, signal in zip(frame["close"], frame["signal"], strict=True):
            breached = entry is not None and (entry - price) / entry >= loss - 1e-12
            if breached or signal < 0:
                held, entry = 0, None
            elif signal > 0 and entry is None:
                held, entry = 1, price
            out.append((held, entry, breached))
        h, e, b = zip(*out, strict=True) if out else ((), (), ())
        return frame.assign(held=list(h), entry=pd.Series(list(e), index=frame.index, dtype=object), breached=list(b))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signals.schema)
    return signals.groupBy(by).applyInPandas(one, kinds + ", held int, entry double, breached boolean")


def sandbox(panel: DataFrame, fast: int, slow: int, span: int, edge_bps: float = 2.9, cash: float = 1e8, periods: float = 52, lookback: int = 21, book: str = "book", loss: float = 0.07, spread: float = 2.9, reference: float = 1.989, target: float = 0.1, most: float = 2.0, max_drawdown: float = 0.15, min_stop: float = 0.05, recovery: float = 0.2, unit: int = 1000) -> DataFrame:
    """Decisions by date and asset: signal, hold state, equal weights over what is held, the cost guard on the change of weight, volatility and drawdown
    scales, shares. All but the equity's way back into the next weights is done by the cluster; that recursion is one ordered pass over
    a row a date of its book."""
    h = hold_state(sig.technical(panel, fast, slow, span), loss)
    h = h.withColumns({"ret": F.coalesce(fr.simple_return(F.col("close"), fr.ordered()), F.lit(0.0)), "book": F.lit(book)})
    rows = F.array_sort(F.collect_list(F.struct("asset", "close", "signal", "held", "breached", "ret")))
    days = h.groupBy("book", "dt").agg(rows.alias("rows"), F.avg("ret").alias("mean"), F.sum("held").alias("n"))
    recent = W.partitionBy("book").orderBy("dt").rowsBetween(-(lookback - 1), 0)
    vol = F.when(F.count("*").over(recent) == lookback, F.stddev_samp("mean").over(recent) * F.sqrt(F.lit(float(periods))))
    days = days.withColumn("vol", vol)
    ratio = fr.ratio(F.lit(target), F.col("vol"))
    days = days.select(
        "book", "dt", "rows", F.transform("rows", lambda r: r["asset"]).alias("assets"), F.transform("rows", lambda r: r["ret"]).alias("moves"), F.transform("rows", lambda r: r["held"] / F.greatest("n", F.lit(1))).alias("targets"),
        F.when(F.col("vol") > 0, F.least(F.lit(most), ratio)).otherwise(0.0).alias("scale"), F.when(F.col("vol") > 0, F.least(F.greatest(max_drawdown * ratio, F.lit(min_stop)), F.lit(max_drawdown))).otherwise(F.lit(max_drawdown)).alias("stop"),
    )

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        equity, peak, weights, out = 1.0, 1.0, {}, []
        for r in frame.sort_values("dt").itertuples():
            move = dict(zip(r.assets, r.moves, strict=True))
            equity *= 1 + sum(w * move.get(a, 0.0) for a, w in weights.items())
            peak = max(peak, equity)
            fall = equity / peak - 1
            brake = 0.0 if fall <= -r.stop else recovery + (1 - recovery) * max(0.0, 1 - abs(fall) / r.stop)
            need = [spread * abs(t - weights.get(a, 0.0)) / reference for a, t in zip(r.assets, r.targets, strict=True)]
            weight = [t * r.scale * brake if t > 0 and edge_bps >= x else 0.0 for t, x in zip(r.targets, need, strict=True)]
            weights = dict(zip(r.assets, weight, strict=True))
            out.append((r.book, r.dt, equity, fall, need, weight))
        return pd.DataFrame(out, columns=["book", "dt", "equity", "drawdown", "need", "weights"])

    way = days.drop("rows").groupBy("book").applyInPandas(one, "book string, dt date, equity double, drawdown double, need array<double>, weights array<double>")
    z = F.explode(F.arrays_zip("rows", "need", "weights", "targets")).alias("z")
    flat = days.join(way, ["book", "dt"]).select("book", "dt", "equity", "drawdown", "scale", (F.col("drawdown") <= -F.col("stop")).alias("stopped_out"), z)
    r, w = F.col("z.rows"), F.col("z.weights")
    shares = sig.share_quantity(cash * w, r["close"], unit)
    approved = (F.col("z.targets") > 0) & (edge_bps >= F.col("z.need"))
    return flat.select(
        "book", "dt", r["asset"].alias("asset"), r["close"].alias("close"), r["signal"].alias("signal"), r["held"].alias("held"), r["breached"].alias("breached"), w.alias("weight"), F.col("z.need").alias("required_edge_bps"),
        approved.alias("approved"), "equity", "drawdown", "scale", "stopped_out", shares["board_lots"].alias("board_lots"), shares["odd_lot_shares"].alias("odd_lot_shares"),
    )


def summary(log: DataFrame, replayed: DataFrame | None = None) -> DataFrame:
    """Counts of a run's decisions; with the log as read back, also how many came back, and whether every decision did."""
    out = log.agg(F.count("*").alias("written"), F.count_if("approved").alias("approved"), F.count_if(F.col("board_lots") * 1000 + F.col("odd_lot_shares") > 0).alias("sized"), F.count_if("breached").alias("stops"), F.count_if("stopped_out").alias("stopped_out"))
    if replayed is None:
        return out
    back = replayed.agg(F.count("*").alias("replayed"), F.count_if((F.col("weight") != 0) & ~F.col("approved")).alias("unapproved"))
    return out.join(F.broadcast(back)).withColumn("complete", (F.col("replayed") == F.col("written")) & (F.col("unapproved") == 0))  # one row


def orchestrate(panel: DataFrame, window: int, modes: int, mode: int, threshold: float, edge_per_z: float = 2.9, positions: DataFrame | None = None, target: float = 1.0, close_on_flat: bool = False) -> DataFrame:
    """The latest date's decisions: aligned log returns, signal, edge, distance to the target position, turnover, guard. A flat signal is not
    approved, so an open position stays unless close_on_flat."""
    x = F.ln("close")
    r = panel.withColumn("ret", x - F.lag(x).over(fr.ordered()))
    s = features.wavelet_signal(r, window, modes, mode, threshold)
    last = s.filter("score is not null").withColumn("_k", F.rank().over(W.partitionBy("asset").orderBy(F.desc("dt")))).filter("_k = 1").drop("_k")
    own = positions if positions is not None else last.select("asset", F.lit(0.0).alias("quantity"))
    d = last.join(own, "asset", "left").withColumn("delta", F.col("signal") * target - F.coalesce("quantity", F.lit(0.0)))
    g = sig.cost_guard(F.col("signal"), F.abs("score") * edge_per_z, F.abs("delta"))
    ok = g["approved"] | ((F.col("signal") == 0) & (F.col("delta") != 0)) if close_on_flat else g["approved"]
    return d.select("asset", "dt", "score", "signal", (F.abs("score") * edge_per_z).alias("expected_edge_bps"), g["required_edge_bps"].alias("required_edge_bps"), F.abs("delta").alias("projected_turnover"), ok.alias("approved"))
