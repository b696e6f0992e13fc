"""Folds, ridge and logistic fits, long-short evaluation, costs, null tests and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import frames as fr
from tessera.functions.basis import EPS
from tessera.operators import stats


def folds(spark: SparkSession, n: int | DataFrame, initial: int = 500, step: int = 21, embargo: int = 1, scheme: str = "expanding", window: int = 750, least: int = 20) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end) over positions 1..n; folds with fewer than `least` training positions go. n is a number
    or a table of one row with a column n, so that counting dates is part of the plan."""
    if scheme not in ("expanding", "rolling"):
        raise ValueError("scheme is expanding or rolling")
    if not initial > 0 < step or embargo < 0:
        raise ValueError("the first training span and the step must be positive, the embargo not negative")
    ns = n if isinstance(n, DataFrame) else spark.range(1).select(F.lit(n).alias("n"))
    n_ = F.col("n").cast("long")
    last = F.ceil((n_ - initial) / step).cast("long") - 1
    f = ns.filter(n_ > initial).select(F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("fold"), n_.alias("n"))
    start = initial + 1 + F.col("fold") * step
    end = start - 1 - embargo
    f = f.select("fold", (F.lit(1).cast("long") if scheme == "expanding" else F.greatest(F.lit(1).cast("long"), end - window + 1)).alias("train_start"), end.alias("train_end"), start.alias("test_start"), F.least(start + step - 1, n_).alias("test_end"))
    return f.filter(F.col("train_end") - F.col("train_start") + 1 >= least)


def n_dates(rows: DataFrame, at: str = "dt") -> DataFrame:
    """(n): the number of dates, as a table of one row."""
    return rows.agg(F.count_distinct(at).alias("n"))


def positions(rows: DataFrame, at: str = "dt", by: Sequence[str] = ()) -> DataFrame:
    """(by..., dt, pos): dates numbered from 1 in order, in each group. One row a date and group."""
    dates = rows.select(*by, at).distinct()
    return dates.withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy(at)).cast("long"))


def moments(rows: DataFrame, features: Sequence[str], target: str, at: str = "dt", by: Sequence[str] = ()) -> DataFrame:
    """(by..., dt, e, v): the upper triangle of the Gram matrix of 1, the features and the target on each date, element by element; that of any run of dates is a
    sum of these. Each batch adds up its own rows first, in one product a batch, so that little is shuffled however many rows a date has.
    Rows with a missing value are left out."""
    names, keys = [*features, target], [*by, at]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    up = np.triu_indices(len(names) + 1)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.dropna(subset=names)
            if not len(frame):
                continue
            group = frame.groupby(keys, sort=False).ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            first = np.append(0, np.flatnonzero(np.diff(group[order])) + 1)
            z = np.column_stack([np.ones(len(frame)), frame[names].to_numpy(float)])[order]
            out = frame.iloc[order[first]][keys].copy()
            out["g"] = list(np.add.reduceat(z[:, up[0]] * z[:, up[1]], first, axis=0))
            yield out

    sums = rows.select(*keys, *names).mapInPandas(partial, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", g array<double>")
    return sums.select(*keys, F.posexplode("g").alias("e", "v")).groupBy(*keys, "e").agg(F.sum("v").alias("v"))


def fold_moments(rows: DataFrame, features: Sequence[str], target: str, fold_table: DataFrame, at: str = "dt", by: Sequence[str] = ()) -> DataFrame:
    """The moments of each fold's training span, in each group, as columns s_n, s_i and s_i_j: running sums of each element over dates, taken at both
    ends, so all folds share one pass over the rows."""
    m = moments(rows, features, target, at, by).join(positions(rows, at, by), [*by, at])
    w = W.partitionBy(*by, "e").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    run = m.select(*by, "e", "pos", F.sum("v").over(w).alias("v"))
    hi = run.select(*by, "e", F.col("pos").alias("train_end"), F.col("v").alias("hi"))
    lo = run.select(*by, "e", (F.col("pos") + 1).alias("train_start"), F.col("v").alias("lo"))
    f = hi.join(fold_table, "train_end").join(lo, [*by, "e", "train_start"], "left")
    keys = [*by, *fold_table.columns]
    g = f.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("e", (F.col("hi") - F.coalesce("lo", F.lit(0.0))).alias("v")))).alias("g"))
    p = len(features) + 1
    place = {ij: k for k, ij in enumerate((i, j) for i in range(p + 1) for j in range(i, p + 1))}
    v = lambda i, j: F.col("g")[place[i, j]]["v"]
    pairs = [v(i + 1, j + 1).alias(f"s_{i}_{j}") for i in range(p) for j in range(i, p)]
    return g.select(*keys, v(0, 0).cast("long").alias("s_n"), *[v(0, i + 1).alias(f"s_{i}") for i in range(p)], *pairs)


def ridge_fits(rows: DataFrame, features: Sequence[str], target: str, fold_table: DataFrame, penalty: float, standardize: bool = True, intercept: bool = True, at: str = "dt", by: Sequence[str] = ()) -> DataFrame:
    """(by..., fold..., n, mean, scale, beta): ridge from the folds' moments; each fold is one solve of len(features) unknowns. Standardised with the
    training span's mean and sample deviation (1 where that is 0); the intercept carries no penalty."""
    m = fold_moments(rows, features, target, fold_table, at, by)
    p, keys = len(features), [*by, *fold_table.columns]
    kinds = {f.name: f.dataType.simpleString() for f in m.schema}

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                n = float(r["s_n"])
                s = np.array([r[f"s_{i}"] for i in range(p + 1)], float)
                g = np.zeros((p + 1, p + 1))
                for i in range(p + 1):
                    for j in range(i, p + 1):
                        g[i, j] = g[j, i] = r[f"s_{i}_{j}"]
                mean, scale = np.zeros(p), np.ones(p)
                if standardize:
                    mean = s[:p] / n
                    scale = np.sqrt(np.maximum(np.diag(g)[:p] - n * mean**2, 0) / max(n - 1, 1))
                    scale[scale < EPS] = 1
                xx = (g[:p, :p] - np.outer(mean, s[:p]) - np.outer(s[:p], mean) + n * np.outer(mean, mean)) / np.outer(scale, scale)
                xy = (g[:p, p] - mean * s[p]) / scale
                sx = (s[:p] - n * mean) / scale
                if intercept:
                    a = np.block([[np.array([[n]]), sx[None]], [sx[:, None], xx + penalty * np.eye(p)]])
                    beta = np.linalg.solve(a, np.append(s[p], xy))
                else:
                    beta = np.append(0.0, np.linalg.solve(xx + penalty * np.eye(p), xy))
                out.append({**{c: r[c] for c in keys}, "n": int(n), "mean": mean.tolist(), "scale": scale.tolist(), "beta": beta.tolist()})
            yield pd.DataFrame(out, columns=[*keys, "n", "mean", "scale", "beta"])

    return m.mapInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", n long, mean array<double>, scale array<double>, beta array<double>")


def predict(rows: DataFrame, features: Sequence[str], fits: DataFrame, at: str = "dt", by: Sequence[str] = ()) -> DataFrame:
    """score of the rows in each fold's test span. Test spans are disjoint runs of dates: fits are spread over their dates first, so that the join
    is on equal positions."""
    spread = fits.select(*by, "fold", "mean", "scale", "beta", F.explode(F.sequence("test_start", "test_end")).alias("pos"))
    by_date = positions(rows, at, by).join(spread, [*by, "pos"])
    score = F.col("beta")[0]
    for i, f in enumerate(features):
        score = score + F.col("beta")[i + 1] * (F.col(f) - F.col("mean")[i]) / F.col("scale")[i]
    return rows.join(by_date, [*by, at]).withColumn("score", score).drop("mean", "scale", "beta", "pos")


def logistic_irls(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 50, tol: float = 1e-8) -> np.ndarray:
    """L2 logistic regression, labels +-1, the intercept (first) free, by iterated weighted least squares."""
    a = np.hstack([np.ones((len(x), 1)), x])
    beta, hold = np.zeros(a.shape[1]), np.diag(np.append(0.0, np.full(x.shape[1], penalty)))
    target = (np.asarray(y) > 0).astype(float)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -500, 500)))
        w = np.maximum(p * (1 - p), 1e-8)
        step = np.linalg.solve((a * w[:, None]).T @ a + hold, a.T @ (target - p) - hold @ beta)
        if not np.isfinite(step).all():
            break
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    return beta


def select_penalty(x: np.ndarray, y: np.ndarray, grid: Sequence[float], fit: Callable = logistic_irls, least: int = 40) -> float:
    """The first penalty of best accuracy on the last quarter of the training rows; the grid's median if there are too few."""
    cut = int(len(x) * 0.75)
    if len(x) < least or len(set(np.sign(y[:cut]))) < 2:
        return float(np.median(grid))
    acc = []
    for g in grid:
        beta = fit(x[:cut], y[:cut], g)
        acc.append(float(((beta[0] + x[cut:] @ beta[1:] >= 0) == (y[cut:] > 0)).mean()))
    return float(grid[int(np.argmax(acc))])


def walkforward_logistic(rows: DataFrame, features: Sequence[str], target: str, fold_table: DataFrame, penalty: float | Sequence[float] = 1.0, by: str = "asset", at: str = "dt") -> DataFrame:
    """(asset, dt, fold, prob, penalty): one series a group, its folds fitted one after the other, labels the sign of the target (0 is up)."""
    plan = [r.asDict() for r in fold_table.collect()]  # bounds alone: one row a fold
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=[*features, target]).sort_values(at)
        x, y = frame[list(features)].to_numpy(float), np.where(frame[target].to_numpy(float) >= 0, 1.0, -1.0)
        parts = []
        for f in plan:
            tr, te = slice(f["train_start"] - 1, f["train_end"]), slice(f["test_start"] - 1, min(f["test_end"], len(x)))
            if len(x[te]) == 0 or len(x[tr]) < max(20, x.shape[1] + 2):
                continue
            mean, sd = x[tr].mean(0), x[tr].std(0, ddof=1)
            sd[sd < EPS] = 1
            z, zt = (x[tr] - mean) / sd, (x[te] - mean) / sd
            lam = float(penalty) if np.isscalar(penalty) else select_penalty(z, y[tr], penalty)
            beta = logistic_irls(z, y[tr], lam)
            parts.append(frame.iloc[te][[by, at]].assign(fold=f["fold"], prob=1 / (1 + np.exp(-(beta[0] + zt @ beta[1:]))), penalty=lam))
        return pd.concat(parts) if parts else pd.DataFrame(columns=[by, at, "fold", "prob", "penalty"])

    return rows.groupBy(by).applyInPandas(one, f"{by} {kinds[by]}, {at} {kinds[at]}, fold long, prob double, penalty double")


def evaluate_positions(series: DataFrame, cost_bps: float = 0.0, periods: float = 252, by: str = "asset", at: str = "dt") -> DataFrame:
    """Metrics by series of (pos, fwd, test): pos is 0 outside test; a change of pos costs, on the row where it happens; metrics are over test
    rows, equity and drawdown over all."""
    o = fr.ordered(by, at)
    pos = F.when(F.col("test"), F.col("pos")).otherwise(0.0)
    s = series.withColumn("_p", pos).withColumn("_turn", F.abs(F.col("_p") - F.coalesce(F.lag("_p").over(o), F.lit(0.0))))
    s = s.withColumn("_ret", F.col("_p") * F.coalesce("fwd", F.lit(0.0)) - cost_bps / 1e4 * F.col("_turn"))
    s = s.withColumn("_eq", F.product(1 + F.col("_ret")).over(fr.running(by, at))).withColumn("_peak", F.max("_eq").over(fr.running(by, at)))
    t = lambda c: F.when(F.col("test"), c)
    hit = F.signum("_p") == F.when(F.col("fwd") >= 0, 1).otherwise(-1)
    return s.groupBy(by).agg(
        F.count_if("test").alias("n_test"), fr.tidy(F.avg(t(hit.cast("double")))).alias("accuracy"), fr.tidy(fr.ratio(F.sum(t(F.when(hit, F.abs("fwd")).otherwise(0.0))), F.sum(t(F.abs("fwd"))))).alias("hit_rate"),
        fr.tidy(fr.sharpe(t(F.col("_ret")), periods)).alias("sharpe"), fr.tidy(F.max(1 - F.col("_eq") / F.col("_peak"))).alias("max_drawdown"), fr.tidy(F.avg(t(F.col("_turn")))).alias("turnover"),
    )


def cs_target(panel: DataFrame, fwd: str = "fwd", at: str = "dt") -> Column:
    """Forward return, demeaned by date over its population deviation; null without spread."""
    w = fr.group(at)
    sd = F.stddev_pop(fwd).over(w)
    return F.when(sd >= EPS, (F.col(fwd) - F.avg(fwd).over(w)) / sd)


def hold_between(weights: DataFrame, every: int | Sequence[int], by: str = "asset", at: str = "dt", w: str = "weight", keys: Sequence[str] = ()) -> DataFrame:
    """Weights of every `every`th date, held until the next one: each date is mapped to its rebalance date and joined on that. keys name books of their
    own; several intervals make as many books, told by a column `every`."""
    d = weights.select(*keys, at).distinct().withColumn("_j", F.row_number().over(W.partitionBy(*keys).orderBy(at)) - 1)
    first = d.select(*keys, F.col("_j").alias("_r"), F.col(at).alias("_from"))
    many = not isinstance(every, int)
    d = d.withColumn("every", F.explode(F.lit(list(every))) if many else F.lit(every))
    plan = d.withColumn("_r", F.col("_j") - F.col("_j") % F.col("every")).join(first, [*keys, "_r"]).select(*keys, *["every"] * many, at, "_from")
    return plan.join(weights.select(*keys, F.col(at).alias("_from"), by, w), [*keys, "_from"]).select(*keys, *["every"] * many, at, by, w)


def long_short_returns(weights: DataFrame, fwd: DataFrame, cost_bps: float = 0.0, by: str = "asset", at: str = "dt", keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., dt, gross, turnover, net): a missing forward return contributes 0. Weights of an asset that leaves count as sold. keys name books of their
    own."""
    w = weights.select(*keys, at, by, "weight")
    dates = w.select(*keys, at).distinct().withColumn("_pos", F.row_number().over(W.partitionBy(*keys).orderBy(at)))
    w = w.join(dates, [*keys, at])
    prev = w.select(*keys, (F.col("_pos") + 1).alias("_pos"), by, F.col("weight").alias("_before"))
    both = w.select(*keys, "_pos", by, "weight").join(prev, [*keys, "_pos", by], "full").join(dates, [*keys, "_pos"])
    both = both.join(fwd.select(at, by, "fwd"), [at, by], "left")
    x, b = F.coalesce("weight", F.lit(0.0)), F.coalesce("_before", F.lit(0.0))
    out = both.groupBy(*keys, at).agg(F.sum(x * F.coalesce("fwd", F.lit(0.0))).alias("gross"), F.sum(F.abs(x - b)).alias("turnover"))
    return out.withColumn("net", F.col("gross") - cost_bps / 1e4 * F.col("turnover"))


def trailing_sigma(book: DataFrame, window: int, at: str = "dt") -> DataFrame:
    """sigma: deviation of the gross returns of the `window` rows before, with enough of them. One row a date."""
    o = W.orderBy(at)
    past = o.rowsBetween(-window, -1)
    return book.withColumn("sigma", F.when((F.row_number().over(o) > window) & (F.count("gross").over(past) >= max(5, window // 2)), F.stddev_samp("gross").over(past)))


def cost_components(weights: DataFrame, fwd: DataFrame, gamma: float = 0.0, impact: float = 0.0, impact_q: float = 1.0, borrow_bps: float = 0.0, window: int = 63, periods: float = 252, by: str = "asset", at: str = "dt") -> DataFrame:
    """(dt, gross, turnover, shorts, vol_mult, impact, borrow) before any spread. The reference level of volatility is the whole sample's median, as is usual
    for this model: it looks ahead by that one constant."""
    b = long_short_returns(weights, fwd, 0.0, by, at).join(weights.groupBy(at).agg(F.sum(F.greatest(-F.col("weight"), F.lit(0.0))).alias("shorts")), at, "left")
    b = trailing_sigma(b, window, at)
    b = b.join(F.broadcast(b.agg(F.median("sigma").alias("sigma_ref"))))
    fill = F.coalesce("sigma", "sigma_ref", F.lit(0.0))
    return b.withColumns({
        "vol_mult": F.coalesce(F.pow(fr.ratio(F.col("sigma"), F.col("sigma_ref")), F.lit(float(gamma))), F.lit(1.0)),
        "impact": impact * fill * F.col("turnover") * F.sqrt(F.col("turnover") / impact_q), "borrow": borrow_bps / (1e4 * periods) * F.coalesce("shorts", F.lit(0.0)),
    }).drop("sigma", "sigma_ref")


def cost_sweep(components: DataFrame, spreads: Sequence[float] = (0, 1, 2, 5, 10, 20, 50), periods: float = 252, at: str = "dt") -> DataFrame:
    """Metrics for each spread in bps: dates times the few spreads, then the usual measures."""
    grid = components.withColumn("spread", F.explode(F.array(*[F.lit(float(s)) for s in spreads])))
    cost = F.col("spread") / 1e4 * F.col("vol_mult") * F.col("turnover") + F.col("impact") + F.col("borrow")
    grid = grid.withColumns({"cost": cost, "ret": F.col("gross") - cost})
    perf = stats.performance(grid, ["spread"], periods=periods)
    return perf.join(grid.groupBy("spread").agg(fr.tidy(F.avg("cost") * periods).alias("annual_cost"), fr.tidy(F.avg("turnover")).alias("mean_turnover")), "spread")


def breakeven(sweep: DataFrame, y: str = "sharpe", x: str = "spread") -> DataFrame:
    """(breakeven): the spread at which y first crosses 0, linearly; null if y starts at or below 0, infinite if it never falls to 0."""
    o = W.partitionBy(F.lit(1)).orderBy(x)
    s = sweep.select(F.col(x).alias("x"), F.col(y).alias("y"), F.lead(x).over(o).alias("x1"), F.lead(y).over(o).alias("y1"))
    cross = F.when((F.col("y") > 0) & (F.col("y1") <= 0), F.col("x") + (F.col("x1") - F.col("x")) * F.col("y") / F.nullif(F.col("y") - F.col("y1"), F.lit(0.0)))
    return s.agg(F.min_by("y", "x").alias("first"), F.min(cross).alias("at")).select(F.when(F.col("first") <= 0, F.lit(None)).otherwise(F.coalesce("at", F.lit(float("inf")))).alias("breakeven"))


def subperiods(returns: DataFrame, periods: list[tuple[str, str, str]], by: str = "asset", ret: str = "ret", at: str = "dt", per_year: float = 252) -> DataFrame:
    """Metrics by named period (name, first, last day) and strategy."""
    name = F.array_compact(F.array(*[F.when(F.col(at).between(F.lit(a).cast("date"), F.lit(z).cast("date")), F.lit(n)) for n, a, z in periods]))
    return stats.performance(returns.withColumn("period", F.explode(name)), ["period", by], ret, at, per_year)


def comparison(metrics: DataFrame, names: Sequence[str], column: str = "sharpe", by: str = "asset") -> DataFrame:
    return metrics.groupBy(by).pivot("period", list(names)).agg(F.first(column))


def parameter_grid(spark: SparkSession, *axes: tuple[str, Sequence]) -> DataFrame:
    """All combinations of the named values."""
    out = spark.range(1).drop("id")
    for name, values in axes:
        out = out.withColumn(name, F.explode(F.lit(list(values))))
    return out


def run_grid(configs: Sequence[dict], runner: Callable[[dict], DataFrame], by: list[str], periods: float = 252) -> DataFrame:
    """Metrics by configuration; runner returns (dt, ret). One plan holds all runs."""
    runs = [runner(c).select("dt", "ret").withColumns({k: F.lit(c[k]) for k in by}) for c in configs]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return stats.performance(out, by, periods=periods)


def key(*parts: Column | str | int) -> Column:
    """A random key that is the same everywhere: md5 of the parts."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def null_permute(rows: DataFrame, seed: int, run: int | Sequence[int], mode: str = "date", by: str = "asset", at: str = "dt") -> DataFrame:
    """([run,] dt, asset, source): the asset whose target this one gets. date: a new order each date; asset: one order throughout. Several runs
    are told by a column."""
    if mode not in ("date", "asset"):
        raise ValueError("mode is date or asset")
    runs = [] if isinstance(run, int) else ["run"]
    own = rows.select(at, by) if isinstance(run, int) else rows.select(at, by, F.explode(F.lit(list(run))).alias("run"))
    which = F.lit(str(run)) if isinstance(run, int) else F.col("run").cast("string")
    k = key(seed, which, F.col(at).cast("string"), F.col(by)) if mode == "date" else key(seed, which, F.col(by))
    a = own.select(*runs, at, F.col(by).alias("source"), F.row_number().over(W.partitionBy(*runs, at).orderBy(k, by)).alias("_i"))
    b = own.select(*runs, at, by, F.row_number().over(W.partitionBy(*runs, at).orderBy(by)).alias("_i"))
    return b.join(a, [*runs, at, "_i"]).select(*runs, at, by, "source")


def null_index(ns: DataFrame, mode: str, seed: int, runs: int, block: int = 21) -> DataFrame:
    """(..., run, pos, source) for positions 1..n of each row of ns, a table of n and whatever names the series. shift: circular by a hashed distance
    of at least max(min(252, n // 3), n // 20); blockperm: blocks in hashed order, the last one short; block: blocks from hashed starts, with
    replacement. The draws of a run are the same for all series."""
    if mode not in ("shift", "blockperm", "block"):
        raise ValueError("mode is shift, block or blockperm")
    own, n = [c for c in ns.columns if c != "n"], F.col("n")
    one = F.lit(1).cast("long")
    run = ns.withColumn("n", n.cast("long")).filter(n > 0).withColumn("run", F.explode(F.sequence(one, F.lit(runs).cast("long"))))
    number = lambda *p: F.conv(F.substring(key(*p), 1, 8), 16, 10).cast("long")
    if mode == "shift":
        low = F.greatest(F.least(F.lit(252).cast("long"), F.floor(n / 3)), F.floor(n / 20))
        r = run.withColumn("sh", low + F.pmod(number(seed, F.col("run").cast("string")), F.greatest(one, n - 2 * low)))
        r = r.select(*own, "run", "n", "sh", F.explode(F.sequence(one, n)).alias("pos"))
        return r.select(*own, "run", "pos", (F.pmod(F.col("pos") - 1 - F.col("sh"), n) + 1).alias("source"))
    b = run.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / block).cast("long") - 1)))
    k = [seed, F.col("run").cast("string"), F.col("b").cast("string")]
    if mode == "blockperm":
        b = b.withColumns({"size": F.least(F.lit(block).cast("long"), n - F.col("b") * block), "k": key(*k)})
        w = W.partitionBy(*own, "run").orderBy("k", "b").rowsBetween(W.unboundedPreceding, -1)
        b = b.withColumn("at", F.coalesce(F.sum("size").over(w), F.lit(0)))
        spread = b.select(*own, "run", F.posexplode(F.sequence(F.col("b") * block + 1, F.col("b") * block + F.col("size"))).alias("i", "source"), "at")
        return spread.select(*own, "run", (F.col("at") + F.col("i") + 1).alias("pos"), "source")
    size = F.least(F.lit(block).cast("long"), n)
    b = b.withColumn("start", 1 + F.pmod(number(*k), n - size + 1))
    spread = b.select(*own, "run", "n", "b", F.posexplode(F.sequence(F.col("start"), F.col("start") + size - 1)).alias("i", "source"))
    return spread.select(*own, "run", "n", (F.col("b") * block + F.col("i") + 1).alias("pos"), "source").filter(F.col("pos") <= n).drop("n")


def cross_sectional_backtest(rows: DataFrame, features: Sequence[str], target: str, fold_table: DataFrame, penalty: float = 10.0, fwd: str = "fwd", runs: int = 0, mode: str = "date", seed: int = 7, quantile: float = 0.2, cost_bps: float = 0.0, periods: float = 252, by: str = "asset", at: str = "dt") -> DataFrame:
    """(run, n_dates, ic_mean, ic_ir, sharpe): a pooled ridge without intercept, refitted by fold, its scores' rank correlation and long-short book over the test
    spans. Run 0 is the data; in runs 1.. the targets and forward returns of a date are dealt to its assets anew, the same way for
    both, and every fold is fitted again. All runs are one plan: the run is one more key of the same aggregates."""
    from tessera.operators import signals

    real = rows.select(at, by, *features, target, fwd).withColumn("run", F.lit(0))
    if runs:
        dealt = null_permute(rows, seed, range(1, runs + 1), mode, by, at)
        theirs = rows.select(at, F.col(by).alias("source"), target, fwd)
        real = real.unionByName(rows.select(at, by, *features).join(dealt, [at, by]).join(theirs, [at, "source"]).drop("source"))
    fits = ridge_fits(real, features, target, fold_table, penalty, standardize=False, intercept=False, at=at, by=["run"])
    scored = predict(real, features, fits, at, ["run"])
    day = ["run", at]
    ranked = scored.withColumns({"_a": fr.tied_rank(F.col("score"), day), "_b": fr.tied_rank(F.col(fwd), day)})
    held = signals.long_short(ranked, quantile, "score", by, day)
    if cost_bps:
        w = W.partitionBy("run", by).orderBy(at)
        held = held.withColumn("_c", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0))))
    cost = cost_bps / 1e4 * F.sum("_c") if cost_bps else F.lit(0.0)
    both = held.groupBy(*day).agg(fr.correlation(F.col("_a"), F.col("_b")).alias("ic"), (F.sum(F.col("weight") * F.coalesce(fwd, F.lit(0.0))) - cost).alias("ret"))
    return both.groupBy("run").agg(F.count("*").alias("n_dates"), F.avg("ic").alias("ic_mean"), fr.ratio(F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"), fr.sharpe(F.col("ret"), periods).alias("sharpe"))


def series_backtest(rows: DataFrame, features: Sequence[str], fold_table: DataFrame, penalty: float = 1.0, fwd: str = "fwd", runs: int = 0, mode: str = "shift", seed: int = 7, block: int = 21, periods: float = 252, by: str = "asset", at: str = "dt") -> DataFrame:
    """(asset, run, n_test, accuracy, sharpe): a ridge on each series, refitted by fold on the signs of the forward returns, which it predicts over the
    test spans. Run 0 is the data; in runs 1.. the forward returns move along the series by null_index and all folds are fitted again."""
    own = rows.select(by, at, *features, fwd).withColumn("pos", F.row_number().over(W.partitionBy(by).orderBy(at)).cast("long"))
    real = own.withColumn("run", F.lit(0).cast("long"))
    if runs:
        moved = null_index(own.groupBy(by).agg(F.count("*").alias("n")), mode, seed, runs, block)
        theirs = own.select(by, F.col("pos").alias("source"), fwd)
        real = real.unionByName(own.drop(fwd).join(moved, [by, "pos"]).join(theirs, [by, "source"]).drop("source"))
    real = real.withColumn("_label", F.when(F.col(fwd) >= 0, 1.0).otherwise(-1.0))
    fits = ridge_fits(real, features, "_label", fold_table, penalty, at="pos", by=[by, "run"])
    scored = predict(real.drop(at), features, fits, "pos", [by, "run"])
    side = F.when(F.col("score") >= 0, 1.0).otherwise(-1.0)
    return scored.groupBy(by, "run").agg(F.count("*").alias("n_test"), F.avg((side == F.col("_label")).cast("double")).alias("accuracy"), fr.sharpe(side * F.col(fwd), periods).alias("sharpe"))


def null_p_values(runs: DataFrame, measures: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., runs, m, p_m...): each measure of run 0 and (1 + runs at least as large) / (1 + runs)."""
    first = runs.filter("run = 0").select(*by, *measures)
    null = runs.filter("run > 0").select(*by, *[F.col(m).alias(f"_{m}") for m in measures])
    both = null.join(first, list(by)) if by else null.join(F.broadcast(first))  # one row
    p = [((1 + F.count_if(F.col(f"_{m}") >= F.col(m))) / (1.0 + F.count(F.lit(1)))).alias(f"p_{m}") for m in measures]
    return both.groupBy(*by, *measures).agg(F.count(F.lit(1)).alias("runs"), *p)


def volatility_matched(returns: DataFrame, strategy: str, benchmark: str, at: str = "dt", periods: float = 252) -> DataFrame:
    """(name, sharpe, volatility, max_drawdown, total_return) of a strategy and of its benchmark scaled to the strategy's volatility. One row a date."""
    both = returns.filter(F.col(strategy).isNotNull() & F.col(benchmark).isNotNull())
    scale = both.agg(fr.ratio(F.stddev_samp(strategy), F.stddev_samp(benchmark)).alias("_k"))
    pair = F.explode(F.array(F.struct(F.lit("strategy").alias("name"), F.col(strategy).alias("ret")), F.struct(F.lit("benchmark").alias("name"), (F.col(benchmark) * F.col("_k")).alias("ret"))))
    long = both.join(F.broadcast(scale)).select(at, pair.alias("x")).select(at, "x.*")  # one row
    perf = stats.performance(long, ["name"], at=at, periods=periods)
    return perf.join(long.groupBy("name").agg(fr.tidy(F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))).alias("volatility")), "name").select("name", "sharpe", "volatility", "max_drawdown", "total_return")


def bonferroni(p_values: DataFrame, p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """adjusted: each p-value times the number of tests of its group, at most 1."""
    return p_values.withColumn("adjusted", F.least(F.lit(1.0), F.col(p) * F.count(p).over(W.partitionBy(*by))))


def universe_subsets(assets: DataFrame, sizes: Sequence[int], draws: int, seed: int = 20260908, by: str = "asset") -> DataFrame:
    """(size, draw, asset): the first `size` assets in hashed order, for each draw."""
    d = assets.select(by).distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("size", F.explode(F.lit(list(sizes))))
    k = key(seed, F.col("size").cast("string"), F.col("draw").cast("string"), F.col(by))
    return d.withColumn("_k", F.row_number().over(W.partitionBy("size", "draw").orderBy(k, by))).filter(F.col("_k") <= F.col("size")).select("size", "draw", by)
