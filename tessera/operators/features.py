"""Causal features of trailing windows, the wavelet signal and the risk filter."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import frames as fr
from tessera.functions.basis import EPS, basis, edge_weights, projector, signal_projector
from tessera.operators.stats import expanding_median

KINDS = ["trend", "trendT", "curv", "dev", "vol", "rough"]


def weights(window: int, modes: int = 4, k: int = 1, weighting: str = "uniform") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(projector, edge weights, fitted values' weights) of one window length. Rows of the projector sum to 0 beyond the constant, so the window may
    be shifted by its last value without a change of any but the value at the edge."""
    a, edge = edge_weights(window, modes, k - 1, weighting)
    return a, edge, basis(k - 1, modes, np.linspace(0, 1, window)).T @ a


def _six(close, edge0, edge1, edge2, sd, energies, greatest=np.maximum, absolute=np.abs, zero=0.0):
    level, spread = greatest(absolute(edge0), EPS), greatest(sd, EPS)
    rough = sum(energies[2:], zero) / greatest(sum(energies[1:], zero), EPS)
    return dict(zip(KINDS, (edge1 / level, edge1 / spread, edge2 / level, (close - edge0) / spread, sd / level, rough), strict=True))


def causal_features(panel: DataFrame, windows: Sequence[int] = (21, 63, 252), modes: int = 4, k: int = 1, weighting: str = "uniform", engine: str = "hof", smooth: bool = False, by: str = "asset", at: str = "dt", x: str = "close") -> DataFrame:
    """W{w}_{kind} for each window length, from an asset's last w rows alone; rows before the longest window are left out. The projection of a
    window is a fixed linear map: engine "hof" takes dot products with literal weights inside the plan, "arrow" one matrix product
    an asset. smooth adds W{w}_smooth and W{w}_slope (per day). A missing value in a window makes its features null."""
    windows = sorted(windows)
    if engine == "arrow":
        return _arrow(panel, windows, modes, k, weighting, smooth, by, at, x)
    out = panel
    for w in windows:
        frame = fr.trailing(w, by, at)
        out = out.withColumn(f"_w{w}", fr.full(F.collect_list(x).over(frame), F.col(x), w, frame))
        if smooth:
            out = out.withColumn(f"_span{w}", F.datediff(F.col(at), F.lag(at, w - 1).over(fr.ordered(by, at))))
    out = out.filter(F.col(f"_w{windows[-1]}").isNotNull())
    now = F.col(x)
    greatest = lambda c, e: F.greatest(c, F.lit(e))
    for w in windows:
        a, edge, fit = weights(w, modes, k, weighting)
        shifted = F.transform(f"_w{w}", lambda v: v - now)
        out = out.withColumn("_s", shifted)
        s = F.col("_s")
        lit = lambda m: F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in m])
        dots = F.transform(lit(np.vstack([a, edge])), lambda row: _dot(s, row))
        resid = F.zip_with(s, F.transform(lit(fit), lambda row: _dot(s, row)), lambda v, f: v - f)
        out = out.withColumns({"_d": dots, "_r": resid})
        n = len(a)
        mean = F.aggregate("_r", F.lit(0.0), lambda t, v: t + v) / w
        out = out.withColumn("_m", mean)
        sd = F.sqrt(F.aggregate(F.transform("_r", lambda v: (v - F.col("_m")) * (v - F.col("_m"))), F.lit(0.0), lambda t, v: t + v) / (w - 1))
        d = [F.col("_d")[i] for i in range(n + 3)]
        energies = [sum((d[c * modes + m] * d[c * modes + m] for c in range(1, n // modes)), d[m] * d[m]) for m in range(modes)]
        six = _six(now, d[n] + now, d[n + 1], d[n + 2], sd, energies, greatest, F.abs, F.lit(0.0))
        new = {f"W{w}_{kind}": c for kind, c in six.items()}
        if smooth:
            new |= {f"W{w}_smooth": d[n] + now, f"W{w}_slope": d[n + 1] / F.nullif(F.col(f"_span{w}"), F.lit(0))}
        out = out.withColumns(new).drop("_s", "_d", "_r", "_m")
    return out.drop(*[f"_{k}{w}" for w in windows for k in ("w", "span")])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)


def _arrow(panel, windows, modes, k, weighting, smooth, by, at, x):
    names = [f"W{w}_{kind}" for w in windows for kind in KINDS + (["smooth", "slope"] if smooth else [])]
    own = {w: weights(w, modes, k, weighting) for w in windows}

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(at)
        v, n = frame[x].to_numpy(float), len(frame)
        days = (pd.to_datetime(frame[at]) - pd.Timestamp(0)).dt.total_seconds().to_numpy() / 86400
        out = frame[[at, by, x]].copy()
        new = {c: np.full(n, np.nan) for c in names}
        for w, (a, edge, fit) in own.items():
            if n < w:
                continue
            s = np.lib.stride_tricks.sliding_window_view(v, w)
            s = s - s[:, -1:]
            c, e = s @ a.T, s @ edge.T
            sd = (s - s @ fit.T).std(axis=1, ddof=1)
            cells = c.reshape(len(c), -1, modes)
            energies = list((cells**2).sum(1).T)
            now = v[w - 1 :]
            for kind, val in _six(now, e[:, 0] + now, e[:, 1], e[:, 2], sd, energies).items():
                new[f"W{w}_{kind}"][w - 1 :] = val
            if smooth:
                new[f"W{w}_smooth"][w - 1 :] = e[:, 0] + now
                new[f"W{w}_slope"][w - 1 :] = e[:, 1] / np.maximum(days[w - 1 :] - days[: n - w + 1], EPS)
        out = out.assign(**new).iloc[windows[-1] - 1 :]
        return out.astype(object).where(out.notna(), None) if out.isna().any().any() else out

    kinds = {f.name: f.dataType.simpleString() for f in panel.schema}
    schema = f"{at} {kinds[at]}, {by} {kinds[by]}, {x} double, " + ", ".join(f"{c} double" for c in names)
    return panel.select(at, by, F.col(x).cast("double").alias(x)).groupBy(by).applyInPandas(one, schema)


def wavelet_signal(returns: DataFrame, window: int, modes: int, mode: int = 1, threshold: float = 0.0, ret: str = "ret", by: str = "asset", at: str = "dt") -> DataFrame:
    """score: one coefficient of the standardised window, standardised by date; signal: its sign where it reaches the threshold. With fewer
    than two assets on a date there is no score, and the signal is 0."""
    a = signal_projector(window, modes)[mode]
    frame = fr.trailing(window, by, at)
    win = fr.full(F.collect_list(ret).over(frame), F.col(ret), window, frame)
    mean, sd = F.avg(ret).over(frame), F.stddev_pop(ret).over(frame)
    out = returns.withColumns({"_w": win, "_m": mean, "_sd": sd}).withColumn("_c", (fr.dot(F.col("_w"), a) - F.col("_m") * float(a.sum())) / F.nullif(F.col("_sd"), F.lit(0.0)))
    out = out.withColumn("score", fr.zscore(F.col("_c"), fr.group(at), keep_null=True))
    signal = F.when(fr.flag(F.abs("score") >= threshold), F.signum("score").cast("int")).otherwise(0)
    return out.withColumn("signal", signal).drop("_w", "_m", "_sd", "_c")


def equal_weight_index(panel: DataFrame, x: str = "close", by: str = "asset", at: str = "dt") -> DataFrame:
    """(asset, dt, ret, level): mean return by date, the first 0, compounded. One row a date is left, so the running product is small."""
    r = panel.withColumn("ret", fr.simple_return(F.col(x), fr.ordered(by, at))).groupBy(at).agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("ret"))
    r = r.withColumn("asset", F.lit("index"))
    return r.withColumn("level", F.product(1 + F.col("ret")).over(fr.running("asset", at))).select("asset", at, "ret", "level")


def ewma_volatility(series: DataFrame, seed: int, decay: float = 0.94, periods: float = 252, by: str = "asset", at: str = "dt") -> DataFrame:
    """vol: square root of v, seeded at row `seed` with the population variance of rows 2..seed, then v = decay * v + (1 - decay) * r**2 of the row
    before. A recursion: one ordered pass over each series in its own group."""
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(at)
        r, out = frame["ret"].to_numpy(float), [None] * len(frame)
        if len(r) >= seed:
            v = float(np.var(r[1:seed]))
            for i in range(seed - 1, len(r)):
                if i >= seed:
                    v = decay * v + (1 - decay) * r[i - 1] ** 2
                out[i] = float(np.sqrt(v * periods))
        return frame.assign(vol=pd.Series(out, index=frame.index, dtype=object))

    schema = ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", vol double"
    return series.groupBy(by).applyInPandas(one, schema)


def risk_filter(panel: DataFrame, windows: Sequence[int] = (21, 63), modes: int = 4, cap: float = 1.0, floor: float = 0.0, min_history: int = 252, smooth: int = 5, estimator: str = "wavelet", decay: float = 0.94, periods: float = 252, warmup: str = "null") -> DataFrame:
    """(dt, ret, level, vol, target, exposure) of the equal-weight index: target is the expanding median of earlier volatilities, exposure the
    clipped ratio, averaged over the last rows. Before there is a target, exposure is null, or the floor with warmup="floor"."""
    if not floor < cap:
        raise ValueError("the floor must lie below the cap")
    index = equal_weight_index(panel)
    if estimator == "ewma":
        v = ewma_volatility(index, max(windows), decay, periods)
    elif estimator == "wavelet":
        longest = causal_features(index.withColumnRenamed("level", "close"), list(windows), modes)
        mean = sum((F.col(f"W{w}_vol") for w in windows), F.lit(0.0)) / len(windows) * float(np.sqrt(periods))
        v = index.join(longest.select("dt", mean.alias("vol")), "dt", "left")
    else:
        raise ValueError("estimator is wavelet or ewma")
    o = W.partitionBy("asset").orderBy("dt")
    v = expanding_median(v.select("asset", "dt", "ret", "level", "vol"), "vol", "target", least=min_history)
    v = v.withColumn("target", F.when(F.col("vol").isNotNull(), F.col("target")))
    raw = fr.clip(F.col("target") / F.greatest("vol", F.lit(EPS)), floor, cap)
    v = v.withColumn("exposure", raw if warmup == "null" else F.coalesce(raw, F.lit(float(floor))))
    frame = o.rowsBetween(-(smooth - 1), 0)
    smoothed = F.when(F.col("exposure").isNotNull(), fr.clip(F.avg("exposure").over(frame), floor, cap))
    return v.withColumn("exposure", smoothed).select("dt", "ret", "level", "vol", "target", "exposure")


def risk_diagnostics(filtered: DataFrame) -> DataFrame:
    e = F.col("exposure")
    change = F.abs(e - F.lag(e).over(W.partitionBy(F.lit(1)).orderBy("dt")))
    return filtered.withColumn("_c", change).agg(F.count(e).alias("n_valid"), F.avg(e).alias("mean_exposure"), F.stddev_samp(e).alias("std_exposure"), F.avg((e < 1).cast("double")).alias("share_derisked"), F.avg("_c").alias("turnover"))


def feature_diagnostics(panel: DataFrame, windows: Sequence[int], modes: int = 4, k: int = 1, weighting: str = "uniform", by: str = "asset") -> DataFrame:
    """(asset, window, first_valid_row, edge_lookback, operator_cond): the first row with features, which is the longest window's in all columns; how many
    rows the right edge looks back on; and the condition number of the window's projection."""
    cells = 1 << (k - 1)
    rows = [(int(w), w / cells, float(np.linalg.cond(projector(w, modes, k - 1, weighting)))) for w in windows]
    lengths = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.lit(e).alias("edge_lookback"), F.lit(c).alias("operator_cond")) for w, e, c in rows])).alias("z")
    counts = panel.groupBy(by).agg(F.count("*").alias("_n"))
    return counts.select(by, F.when(F.col("_n") >= max(windows), max(windows)).alias("first_valid_row"), lengths).select(by, "z.window", "first_valid_row", "z.edge_lookback", "z.operator_cond")
