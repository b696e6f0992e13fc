"""Backtests, costs, null tests, reports, decisions, stores and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import frames as fr
from tessera.operators import backtest as bt
from tessera.operators import align, decisions, stats
from tessera.operators import features as feat
from tessera.operators import signals as sig
from tessera.plans.panels import returns
from tessera.plans.registry import Registry
from tessera.plans.signals import LS, TECH, _weights, feature_tables, score_sql
from tessera.sources import panels as src
from tessera.sources import stores
from tessera.streaming import bars as stream

query = Registry()

#: Dates of the weekly panel that the fold queries count on.
FOLDS = "fd AS (SELECT k AS fold, 1::BIGINT AS train_start, 101 + k * 13 - 2 AS train_end, 101 + k * 13 AS test_start, least(101 + k * 13 + 12, n) AS test_end FROM (SELECT unnest(range(0, (n - 100 + 12) // 13)) AS k, n FROM (SELECT count(DISTINCT dt) AS n FROM p)))"


def _fwd(spark, sf):
    return returns(spark, sf).withColumn("fwd", F.lead("ret").over(fr.ordered()))


@query("walkforward_folds", f"WITH $PW, {FOLDS} SELECT * FROM fd")
def _(spark, sf):
    return bt.folds(spark, bt.n_dates(src.weekly(spark, sf)), 100, 13)


@query("fold_standardize", f"""WITH $PW, $R, $F, {FOLDS}, u AS (SELECT dt, ret, dense_rank() OVER (ORDER BY dt) AS pos FROM f WHERE ret IS NOT NULL AND fwd IS NOT NULL)
SELECT fold, count(*) AS n, round(avg(ret), 6) + 0.0 AS mean, round(stddev_samp(ret), 6) AS sd FROM fd JOIN u ON pos BETWEEN train_start AND train_end GROUP BY fold""")
def _(spark, sf):
    panel = src.weekly(spark, sf)
    rows = _fwd(spark, sf).filter("ret is not null and fwd is not null")
    m = bt.fold_moments(rows, ["ret"], "fwd", bt.folds(spark, bt.n_dates(panel), 100, 13))
    mean = F.col("s_0") / F.col("s_n")
    return m.select("fold", F.col("s_n").alias("n"), fr.tidy(mean).alias("mean"), F.round(F.sqrt((F.col("s_0_0") - F.col("s_n") * mean * mean) / (F.col("s_n") - 1)), 6).alias("sd"))


@query("ridge_1f", f"""WITH $PW, $R, $F, {FOLDS}, u AS (SELECT dt, ret, fwd, dense_rank() OVER (ORDER BY dt) AS pos FROM f WHERE ret IS NOT NULL AND fwd IS NOT NULL),
s AS (SELECT fold, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS sd, sum(ret * fwd) AS xy, sum(fwd) AS sy FROM fd JOIN u ON pos BETWEEN train_start AND train_end GROUP BY fold)
SELECT fold, n, round(((xy - m * sy) / sd) / (n - 1 + 1.0), 6) + 0.0 AS beta, round(sy / n, 6) + 0.0 AS intercept FROM s""")
def _(spark, sf):
    rows = _fwd(spark, sf).filter("ret is not null and fwd is not null")
    f = bt.ridge_fits(rows, ["ret"], "fwd", bt.folds(spark, bt.n_dates(src.weekly(spark, sf)), 100, 13), 1.0)
    return f.select("fold", "n", fr.tidy(F.col("beta")[1]).alias("beta"), fr.tidy(F.col("beta")[0]).alias("intercept"))


def _cs(spark, sf):
    """Features and standardised target of the weekly cross-section, ranked by date. Written, as several steps read them."""
    f = feat.causal_features(src.weekly(spark, sf), [13, 21], engine="arrow")
    f = f.withColumn("ret", fr.simple_return(F.col("close"), fr.ordered())).withColumn("fwd", F.lead("ret").over(fr.ordered()))
    f = f.withColumn("y", bt.cs_target(f))
    names = ["W13_trendT", "W13_vol", "W21_dev"]
    ok = f.filter("y is not null and fwd is not null")
    n = F.count("*").over(fr.group())
    ranked = ok.withColumns({c: (fr.tied_rank(F.col(c), ["dt"]) - 0.5) / n - 0.5 for c in names})
    return stores.settle(ranked.select("dt", "asset", *names, "y", "fwd")), names


def _ranked_sql() -> str:
    """Tables up to u (dt, asset, x1, x2, x3, y, fwd, pos) and fd, the folds over its dates."""
    rank = lambda c: f"(rank() OVER (PARTITION BY dt ORDER BY {c}) + (count(*) OVER (PARTITION BY dt, {c}) - 1) / 2 - 0.5) / count(*) OVER (PARTITION BY dt) - 0.5"
    return f"""{feature_tables(13)}, {feature_tables(21)}, j AS (SELECT a.dt, a.asset, a.close, a.trendT, a.vol, b.dev FROM ft13 a JOIN ft21 b USING (dt, asset)),
jr AS (SELECT *, close / lag(close) OVER (PARTITION BY asset ORDER BY dt) - 1 AS ret FROM j), jf AS (SELECT *, lead(ret) OVER (PARTITION BY asset ORDER BY dt) AS fwd FROM jr),
jy AS (SELECT *, CASE WHEN stddev_pop(fwd) OVER w >= 2.220446049250313e-16 THEN (fwd - avg(fwd) OVER w) / stddev_pop(fwd) OVER w END AS y FROM jf WINDOW w AS (PARTITION BY dt)),
u AS (SELECT dt, asset, {rank("trendT")} AS x1, {rank("vol")} AS x2, {rank("dev")} AS x3, y, fwd, dense_rank() OVER (ORDER BY dt) AS pos FROM jy WHERE y IS NOT NULL AND fwd IS NOT NULL),
fd AS (SELECT k AS fold, 99 + k * 13 AS train_end, 101 + k * 13 AS test_start, 113 + k * 13 AS test_end FROM (SELECT unnest(range(0, (n - 100 + 12) // 13)) AS k FROM (SELECT max(pos) AS n FROM u)))"""


#: The solution of three symmetric equations a b = v by minors.
THREE = """(SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a13 * a23) + a13 * (a12 * a23 - a13 * a22) AS det FROM g),
be AS (SELECT *, (v1 * (a22 * a33 - a23 * a23) + v2 * (a13 * a23 - a12 * a33) + v3 * (a12 * a23 - a13 * a22)) / det AS b1, (v1 * (a13 * a23 - a12 * a33) + v2 * (a11 * a33 - a13 * a13) + v3 * (a12 * a13 - a11 * a23)) / det AS b2,
  (v1 * (a12 * a23 - a13 * a22) + v2 * (a12 * a13 - a11 * a23) + v3 * (a11 * a22 - a12 * a12)) / det AS b3 FROM h)"""


@query("cs_ridge_score", f"""WITH $PW, {_ranked_sql()}, g AS (SELECT fold, test_start, test_end, sum(x1 * x1) + 10 AS a11, sum(x1 * x2) AS a12, sum(x1 * x3) AS a13, sum(x2 * x2) + 10 AS a22, sum(x2 * x3) AS a23, sum(x3 * x3) + 10 AS a33,
  sum(x1 * y) AS v1, sum(x2 * y) AS v2, sum(x3 * y) AS v3 FROM fd JOIN u ON pos <= train_end GROUP BY 1, 2, 3), h AS {THREE}
SELECT dt, asset, fold, round(b1 * x1 + b2 * x2 + b3 * x3, 6) + 0.0 AS score, round(fwd, 6) + 0.0 AS fwd FROM be JOIN u ON pos BETWEEN test_start AND test_end""")
def _(spark, sf):
    rows, names = _cs(spark, sf)
    fits = bt.ridge_fits(rows, names, "y", bt.folds(spark, bt.n_dates(rows), 100, 13), 10.0, standardize=False, intercept=False)
    return bt.predict(rows, names, fits).select("dt", "asset", "fold", fr.tidy(F.col("score")).alias("score"), fr.tidy(F.col("fwd")).alias("fwd"))


@query("walkforward_ridge", f"""WITH $PW, {_ranked_sql()}, m AS (SELECT fold, test_start, test_end, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, stddev_samp(x1) AS s1, stddev_samp(x2) AS s2, stddev_samp(x3) AS s3, avg(y) AS my, max(train_end) AS te FROM fd JOIN u ON pos <= train_end GROUP BY 1, 2, 3),
z AS (SELECT m.*, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, (x3 - m3) / s3 AS z3, y - my AS c FROM m JOIN u ON pos <= te),
g AS (SELECT fold, test_start, test_end, m1, m2, m3, s1, s2, s3, my, sum(z1 * z1) + 1 AS a11, sum(z1 * z2) AS a12, sum(z1 * z3) AS a13, sum(z2 * z2) + 1 AS a22, sum(z2 * z3) AS a23, sum(z3 * z3) + 1 AS a33, sum(z1 * c) AS v1, sum(z2 * c) AS v2, sum(z3 * c) AS v3 FROM z GROUP BY ALL), h AS {THREE},
s AS (SELECT dt, asset, fold, my + b1 * (x1 - m1) / s1 + b2 * (x2 - m2) / s2 + b3 * (x3 - m3) / s3 AS score FROM be JOIN u ON pos BETWEEN test_start AND test_end)
SELECT dt, asset, fold, round(score, 6) + 0.0 AS score, CASE WHEN round(score, 6) >= 0 THEN 1 ELSE -1 END AS position FROM s""")
def _(spark, sf):
    rows, names = _cs(spark, sf)
    fits = bt.ridge_fits(rows, names, "y", bt.folds(spark, bt.n_dates(rows), 100, 13), 1.0)
    return bt.predict(rows, names, fits).select("dt", "asset", "fold", fr.tidy(F.col("score")).alias("score"), F.when(fr.tidy(F.col("score")) >= 0, 1).otherwise(-1).alias("position"))


@query("walkforward_logistic")
def _(spark, sf):
    rows, names = _cs(spark, sf)
    return bt.walkforward_logistic(rows, names, "fwd", bt.folds(spark, bt.n_dates(rows), 100, 52), 1.0)


@query("lambda_select")
def _(spark, sf):
    rows, names = _cs(spark, sf)
    return bt.walkforward_logistic(rows, names, "fwd", bt.folds(spark, bt.n_dates(rows), 150, 104), [0.1, 1.0, 10.0]).select("asset", "fold", "penalty").distinct()


@query("cs_target", "WITH $PW, $R, $F SELECT dt, asset, CASE WHEN stddev_pop(fwd) OVER w >= 2.220446049250313e-16 THEN round((fwd - avg(fwd) OVER w) / stddev_pop(fwd) OVER w, 6) + 0.0 END AS y FROM f WINDOW w AS (PARTITION BY dt)")
def _(spark, sf):
    f = _fwd(spark, sf)
    return f.select("dt", "asset", fr.tidy(bt.cs_target(f)).alias("y"))


EVAL = """u AS (SELECT asset, dt, fwd, ret, row_number() OVER (PARTITION BY asset ORDER BY dt) > 100 AS test FROM f),
a AS (SELECT *, CASE WHEN test THEN POS ELSE 0.0 END::DOUBLE AS pz FROM u), b AS (SELECT *, abs(pz - coalesce(lag(pz) OVER (PARTITION BY asset ORDER BY dt), 0)) AS turn FROM a),
c AS (SELECT *, pz * coalesce(fwd, 0) - BPS / 1e4 * turn AS sr, sign(pz) = CASE WHEN fwd >= 0 THEN 1 ELSE -1 END AS hit FROM b), e AS (SELECT *, product(1 + sr) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS eq FROM c),
g AS (SELECT *, max(eq) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS peak FROM e)
SELECT asset, count(*) FILTER (test) AS n_test, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END) FILTER (test), 6) + 0.0 AS accuracy, round(sum(CASE WHEN hit THEN abs(fwd) ELSE 0 END) FILTER (test) / nullif(sum(abs(fwd)) FILTER (test), 0), 6) + 0.0 AS hit_rate,
round(avg(sr) FILTER (test) / nullif(stddev_samp(sr) FILTER (test), 0) * sqrt(52), 6) + 0.0 AS sharpe, round(max(1 - eq / peak), 6) + 0.0 AS max_drawdown, round(avg(turn) FILTER (test), 6) + 0.0 AS turnover FROM g GROUP BY asset"""


def _evaluate(spark, sf, pos, bps):
    s = _fwd(spark, sf).withColumn("test", F.row_number().over(fr.ordered()) > 100).withColumn("pos", pos)
    return bt.evaluate_positions(s, bps, 52)


@query("evaluate_positions", "WITH $PW, $R, $F, " + EVAL.replace("POS", "CASE WHEN ret >= 0 THEN 1 ELSE -1 END").replace("BPS", "2.0"))
def _(spark, sf):
    return _evaluate(spark, sf, F.when(F.col("ret") >= 0, 1.0).otherwise(-1.0), 2.0)


@query("baselines", "WITH $PW, $R, $F, " + EVAL.replace("POS", "1").replace("BPS", "0.0"))
def _(spark, sf):
    return _evaluate(spark, sf, F.lit(1.0), 0.0)


LSR = f"""{LS}, dl AS (SELECT dt, row_number() OVER (ORDER BY dt) AS pos FROM (SELECT DISTINCT dt FROM wt)), wp AS (SELECT pos, asset, weight FROM wt JOIN dl USING (dt)),
bo AS (SELECT coalesce(a.pos, b.pos + 1) AS pos, coalesce(a.asset, b.asset) AS asset, coalesce(a.weight, 0) AS x, coalesce(b.weight, 0) AS y FROM wp a FULL JOIN wp b ON a.pos = b.pos + 1 AND a.asset = b.asset),
ls AS (SELECT dl.dt, sum(x * coalesce(fwd, 0)) AS gross, sum(abs(x - y)) AS turnover FROM bo JOIN dl ON dl.pos = bo.pos LEFT JOIN f ON f.dt = dl.dt AND f.asset = bo.asset GROUP BY 1)"""


@query("cs_ls_returns", f"WITH $PW, $R, $F, {LSR} SELECT dt, round(gross, 6) + 0.0 AS gross, round(turnover, 6) + 0.0 AS turnover, round(gross - 5.0 / 1e4 * turnover, 6) + 0.0 AS net FROM ls")
def _(spark, sf):
    x = bt.long_short_returns(_weights(spark, sf), _fwd(spark, sf), 5.0)
    return x.select("dt", *[fr.tidy(F.col(c)).alias(c) for c in ("gross", "turnover", "net")])


@query("cs_rebalance_every", f"WITH $PW, $R, {LS}, dl AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS j FROM (SELECT DISTINCT dt FROM wt)) SELECT a.dt, wt.asset, round(wt.weight, 6) + 0.0 AS weight FROM dl a JOIN dl b ON b.j = a.j - a.j % 4 JOIN wt ON wt.dt = b.dt")
def _(spark, sf):
    return bt.hold_between(_weights(spark, sf), 4).withColumn("weight", fr.tidy(F.col("weight")))


IC = """q AS (SELECT dt, rank() OVER (PARTITION BY dt ORDER BY ret) + (count(*) OVER (PARTITION BY dt, ret) - 1) / 2 AS a, rank() OVER (PARTITION BY dt ORDER BY fwd) + (count(*) OVER (PARTITION BY dt, fwd) - 1) / 2 AS b FROM f WHERE ret IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT dt, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic, count(*) AS n FROM q GROUP BY dt)"""


@query("cs_summary", f"WITH $PW, $R, $F, {IC} SELECT count(ic) AS n, round(avg(ic), 6) + 0.0 AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) + 0.0 AS ic_ir, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)), 6) + 0.0 AS ic_t, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END), 6) AS ic_hit FROM ic WHERE ic IS NOT NULL")
def _(spark, sf):
    ic = stats.rank_ic(_fwd(spark, sf), "ret", "fwd").filter("ic is not null")
    ir = fr.ratio(F.avg("ic"), F.stddev_samp("ic"))
    return ic.agg(F.count("ic").alias("n"), fr.tidy(F.avg("ic")).alias("ic_mean"), F.round(F.stddev_samp("ic"), 6).alias("ic_std"), fr.tidy(ir).alias("ic_ir"), fr.tidy(ir * F.sqrt(F.count("ic"))).alias("ic_t"), F.round(F.avg((F.col("ic") > 0).cast("double")), 6).alias("ic_hit"))


@query("rolling_ic", f"WITH $PW, $R, $F, {IC} SELECT dt, CASE WHEN count(ic) OVER w = 26 THEN round(avg(ic) OVER w, 6) + 0.0 END AS rolling_ic FROM ic WINDOW w AS (ORDER BY dt ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    w = fr.trailing(26, "one")
    ic = stats.rank_ic(_fwd(spark, sf), "ret", "fwd").withColumn("one", F.lit(1))
    return ic.select("dt", fr.tidy(fr.full(F.avg("ic").over(w), F.col("ic"), 26, w)).alias("rolling_ic"))


@query("cs_baseline", "WITH $PW, $R, $F SELECT dt, round(avg(fwd), 6) + 0.0 AS ret FROM f WHERE fwd IS NOT NULL GROUP BY dt")
def _(spark, sf):
    return _fwd(spark, sf).filter("fwd is not null").groupBy("dt").agg(fr.tidy(F.avg("fwd")).alias("ret"))


@query("ic_decay", "WITH $PW, $R, $F, h AS (SELECT dt, ret, unnest([1, 2, 4])::INTEGER AS horizon, unnest([lead(ret, 1) OVER o, lead(ret, 2) OVER o, lead(ret, 4) OVER o]) AS y FROM r WINDOW o AS (PARTITION BY asset ORDER BY dt)), "
       "q AS (SELECT horizon, dt, rank() OVER (PARTITION BY horizon, dt ORDER BY ret) + (count(*) OVER (PARTITION BY horizon, dt, ret) - 1) / 2 AS a, rank() OVER (PARTITION BY horizon, dt ORDER BY y) + (count(*) OVER (PARTITION BY horizon, dt, y) - 1) / 2 AS b FROM h WHERE ret IS NOT NULL AND y IS NOT NULL), "
       "i AS (SELECT horizon, dt, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM q GROUP BY 1, 2) SELECT horizon, round(avg(ic), 6) + 0.0 AS ic FROM i GROUP BY 1")
def _(spark, sf):
    r = returns(spark, sf).withColumns({f"y{k}": F.lead("ret", k).over(fr.ordered()) for k in (1, 2, 4)})
    h = F.explode(F.array(*[F.struct(F.lit(k).alias("horizon"), F.col(f"y{k}").alias("y")) for k in (1, 2, 4)]))
    q = r.select("dt", "ret", h.alias("h")).select("dt", "ret", "h.*").filter("ret is not null and y is not null")
    ranked = q.select("horizon", "dt", fr.tied_rank(F.col("ret"), ["horizon", "dt"]).alias("a"), fr.tied_rank(F.col("y"), ["horizon", "dt"]).alias("b"))
    ic = ranked.groupBy("horizon", "dt").agg(fr.correlation(F.col("a"), F.col("b")).alias("ic"))
    return ic.groupBy("horizon").agg(fr.tidy(F.avg("ic")).alias("ic"))


COST = f"""{LSR}, sh AS (SELECT dt, sum(greatest(-weight, 0)) AS shorts FROM wt GROUP BY dt), cg AS (SELECT ls.dt, gross, turnover, shorts, CASE WHEN row_number() OVER (ORDER BY ls.dt) > 21 AND count(gross) OVER b >= 10 THEN stddev_samp(gross) OVER b END AS sigma FROM ls LEFT JOIN sh USING (dt) WINDOW b AS (ORDER BY dt ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)),
rf AS (SELECT median(sigma) AS ref FROM cg), cc AS (SELECT dt, gross, turnover, shorts, coalesce(pow(sigma / nullif(ref, 0), 0.5), 1) AS vol_mult, 0.1 * coalesce(sigma, ref, 0) * turnover * sqrt(turnover / 1.0) AS impact, 50.0 / (1e4 * 52) * coalesce(shorts, 0) AS borrow FROM cg, rf)"""


def _costs(spark, sf):
    return bt.cost_components(_weights(spark, sf), _fwd(spark, sf), 0.5, 0.1, 1.0, 50.0, 21, 52)


@query("cost_components", f"WITH $PW, $R, $F, {COST} SELECT dt, round(gross, 6) + 0.0 AS gross, round(turnover, 6) + 0.0 AS turnover, round(shorts, 6) + 0.0 AS shorts, round(vol_mult, 6) + 0.0 AS vol_mult, round(impact, 6) + 0.0 AS impact, round(borrow, 9) + 0.0 AS borrow FROM cc")
def _(spark, sf):
    c = _costs(spark, sf)
    return c.select("dt", *[fr.tidy(F.col(x)).alias(x) for x in ("gross", "turnover", "shorts", "vol_mult", "impact")], fr.tidy(F.col("borrow"), 9).alias("borrow"))


SWEEP = f"""{COST}, gr AS (SELECT *, spread / 1e4 * vol_mult * turnover + impact + borrow AS cost FROM cc, (SELECT unnest([0, 1, 2, 5, 10, 20, 50])::DOUBLE AS spread)), rr AS (SELECT *, gross - cost AS ret FROM gr),
eq AS (SELECT *, product(1 + ret) OVER (PARTITION BY spread ORDER BY dt ROWS UNBOUNDED PRECEDING) AS eq FROM rr), pk AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY spread ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS peak FROM eq)"""


@query("cost_sweep", f"WITH $PW, $R, $F, {SWEEP} SELECT spread, count(*) AS observations, round(avg(ret) / stddev_samp(ret) * sqrt(52), 4) + 0.0 AS sharpe, round(min(eq / peak - 1), 4) + 0.0 AS max_drawdown, round(avg(cost) * 52, 5) + 0.0 AS annual_cost, round(avg(turnover), 6) + 0.0 AS mean_turnover FROM pk GROUP BY spread")
def _(spark, sf):
    s = bt.cost_sweep(_costs(spark, sf), periods=52)
    return s.select("spread", "observations", fr.tidy(F.col("sharpe"), 4).alias("sharpe"), fr.tidy(F.col("max_drawdown"), 4).alias("max_drawdown"), fr.tidy(F.col("annual_cost"), 5).alias("annual_cost"), "mean_turnover")


@query("breakeven_spread", f"""WITH $PW, $R, $F, {SWEEP}, sw AS (SELECT spread, avg(ret) / stddev_samp(ret) * sqrt(52) AS y FROM pk GROUP BY spread), ld AS (SELECT *, lead(spread) OVER o AS x1, lead(y) OVER o AS y1 FROM sw WINDOW o AS (ORDER BY spread))
SELECT CASE WHEN arg_min(y, spread) <= 0 THEN NULL ELSE round(coalesce(min(CASE WHEN y > 0 AND y1 <= 0 THEN spread + (x1 - spread) * y / (y - y1) END), 'infinity'::DOUBLE), 3) END AS breakeven FROM ld""")
def _(spark, sf):
    return bt.breakeven(bt.cost_sweep(_costs(spark, sf), periods=52)).select(F.round("breakeven", 3).alias("breakeven"))


PERIODS = [("early", "1992-01-01", "1995-06-30"), ("late", "1995-07-01", "1998-12-31")]
SUB = """pr AS (SELECT * FROM (VALUES ('early', DATE '1992-01-01', DATE '1995-06-30'), ('late', DATE '1995-07-01', DATE '1998-12-31')) v(period, a, z)), sp AS (SELECT period, asset, dt, ret FROM r JOIN pr ON dt BETWEEN a AND z WHERE ret IS NOT NULL)"""


@query("subperiod_metrics", f"WITH $PW, $R, {SUB} SELECT period, asset, count(*) AS observations, round(product(1 + ret) - 1, 6) + 0.0 AS total_return, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52), 6) + 0.0 AS sharpe FROM sp GROUP BY 1, 2")
def _(spark, sf):
    return bt.subperiods(returns(spark, sf), PERIODS, per_year=52).select("period", "asset", "observations", "total_return", "sharpe")


@query("subperiod_comparison", f"WITH $PW, $R, {SUB}, m AS (SELECT period, asset, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52), 6) + 0.0 AS s FROM sp GROUP BY 1, 2) SELECT asset, max(s) FILTER (period = 'early') AS early, max(s) FILTER (period = 'late') AS late FROM m GROUP BY asset")
def _(spark, sf):
    return bt.comparison(bt.subperiods(returns(spark, sf), PERIODS, per_year=52), ["early", "late"])


@query("param_grid", "SELECT w AS window, t AS threshold, q AS every FROM (SELECT unnest([21, 63])::INTEGER AS w), (SELECT unnest([0.0, 0.5])::DOUBLE AS t), (SELECT unnest([1, 21, 63])::INTEGER AS q)")
def _(spark, sf):
    return bt.parameter_grid(spark, ("window", [21, 63]), ("threshold", [0.0, 0.5]), ("every", [1, 21, 63]))


def _grid(spark, sf):
    panel = stores.settle(_fwd(spark, sf))  # every configuration reads it

    def run(c):
        m = sig.momentum(panel, c["window"]).withColumn("score", F.col("momentum"))
        w = bt.hold_between(sig.long_short(m), c["every"])
        return bt.long_short_returns(w, panel, 2.0).select("dt", F.col("net").alias("ret"))

    return bt.run_grid([{"window": w, "every": e} for w in (4, 13) for e in (1, 4)], run, ["window", "every"], 52)


def _summed(w: int) -> str:
    return f"SELECT {w} AS win, dt, asset, CASE WHEN count(ret) OVER w = {w} THEN sum(ret) OVER w END AS s FROM r WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


GRID = f"""m AS ({_summed(4)} UNION ALL {_summed(13)}),
t AS (SELECT *, tanh(coalesce((s - avg(s) OVER w) / nullif(stddev_pop(s) OVER w, 0), 0) / 2.0) AS score FROM m WINDOW w AS (PARTITION BY win, dt)),
k AS (SELECT win, dt, asset, row_number() OVER (PARTITION BY win, dt ORDER BY score DESC, asset) AS k, count(*) OVER (PARTITION BY win, dt) AS n FROM t WHERE s IS NOT NULL),
wt AS (SELECT win, dt, asset, CASE WHEN k <= q THEN 1.0 / q WHEN k > n - q THEN -1.0 / q ELSE 0 END::DOUBLE AS weight FROM (SELECT *, greatest(1, floor(0.2 * n + 1e-12)) AS q FROM k)),
dl AS (SELECT win, dt, row_number() OVER (PARTITION BY win ORDER BY dt) AS pos FROM (SELECT DISTINCT win, dt FROM wt)),
hl AS (SELECT a.win, every, a.pos, asset, weight FROM dl a, (SELECT unnest([1, 4]) AS every) JOIN dl b ON b.win = a.win AND b.pos = a.pos - (a.pos - 1) % every JOIN wt ON wt.win = a.win AND wt.dt = b.dt),
pv AS (SELECT win, every, pos + 1 AS pos, asset, weight AS old FROM hl),
bo AS (SELECT win, every, pos, asset, coalesce(weight, 0) AS x, coalesce(old, 0) AS y FROM hl FULL JOIN pv USING (win, every, pos, asset)),
ls AS (SELECT bo.win, every, dl.dt, sum(x * coalesce(fwd, 0)) - 2.0 / 1e4 * sum(abs(x - y)) AS ret FROM bo JOIN dl ON dl.win = bo.win AND dl.pos = bo.pos LEFT JOIN f ON f.dt = dl.dt AND f.asset = bo.asset GROUP BY 1, 2, 3),
eq AS (SELECT *, product(1 + ret) OVER (PARTITION BY win, every ORDER BY dt ROWS UNBOUNDED PRECEDING) AS equity FROM ls),
pk AS (SELECT *, greatest(max(equity) OVER (PARTITION BY win, every ORDER BY dt ROWS UNBOUNDED PRECEDING), 1) AS peak FROM eq),
gr AS (SELECT win AS window, every, count(*) AS observations, round(product(1 + ret) - 1, 6) + 0.0 AS total_return, round(pow(product(1 + ret), 52.0 / count(*)) - 1, 6) + 0.0 AS annual_return,
  round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52), 6) + 0.0 AS sharpe, round(min(equity / peak - 1), 6) + 0.0 AS max_drawdown FROM pk GROUP BY 1, 2)"""


@query("grid_metrics", f"WITH $PW, $R, $F, {GRID} SELECT * FROM gr")
def _(spark, sf):
    return _grid(spark, sf)


@query("grid_summary", f"WITH $PW, $R, $F, {GRID} SELECT count(sharpe) AS n, round(avg(sharpe), 5) + 0.0 AS mean, round(stddev_samp(sharpe), 5) AS std, min(sharpe) AS lo, max(sharpe) AS hi, avg((sharpe > 0)::DOUBLE) AS positive FROM gr")
def _(spark, sf):
    s = F.col("sharpe")
    return _grid(spark, sf).agg(F.count(s).alias("n"), fr.tidy(F.avg(s), 5).alias("mean"), F.round(F.stddev_samp(s), 5).alias("std"), F.min(s).alias("lo"), F.max(s).alias("hi"), F.avg((s > 0).cast("double")).alias("positive"))


SUBSETS = "us AS (SELECT sz AS size, dr AS draw, asset, row_number() OVER (PARTITION BY sz, dr ORDER BY md5('20260908|' || sz || '|' || dr || '|' || asset), asset) AS k FROM (SELECT DISTINCT asset FROM p), (SELECT unnest([8, 16])::INTEGER AS sz), (SELECT unnest(range(1, 7))::INTEGER AS dr)), su AS (SELECT size, draw, asset FROM us WHERE k <= size)"


@query("universe_subsets", f"WITH $PW, {SUBSETS} SELECT * FROM su")
def _(spark, sf):
    return bt.universe_subsets(src.weekly(spark, sf), [8, 16], 6)


@query("universe_summary", f"WITH $PW, $R, {SUBSETS}, x AS (SELECT size, draw, dt, avg(ret) AS ret FROM su JOIN r USING (asset) WHERE ret IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT size, draw, avg(ret) / stddev_samp(ret) * sqrt(52) AS s FROM x GROUP BY 1, 2) SELECT size, count(*) AS draws, round(avg(s), 6) + 0.0 AS mean, round(quantile_cont(s, 0.05), 6) + 0.0 AS p05, round(quantile_cont(s, 0.95), 6) + 0.0 AS p95 FROM m GROUP BY size")
def _(spark, sf):
    r = returns(spark, sf).filter("ret is not null")
    x = r.join(bt.universe_subsets(r, [8, 16], 6), "asset").groupBy("size", "draw", "dt").agg(F.avg("ret").alias("ret"))
    m = x.groupBy("size", "draw").agg(fr.sharpe(F.col("ret"), 52).alias("s"))
    return m.groupBy("size").agg(F.count("*").alias("draws"), fr.tidy(F.avg("s")).alias("mean"), fr.tidy(F.percentile("s", 0.05)).alias("p05"), fr.tidy(F.percentile("s", 0.95)).alias("p95"))


for _mode, _key in (("date", "'7|1|' || CAST(dt AS VARCHAR) || '|' || asset"), ("asset", "'7|1|' || asset")):
    query(f"null_permute_{_mode}", f"WITH $PW, a AS (SELECT dt, asset AS source, row_number() OVER (PARTITION BY dt ORDER BY md5({_key}), asset) AS i FROM p), o AS (SELECT dt, asset, row_number() OVER (PARTITION BY dt ORDER BY asset) AS i FROM p) SELECT dt, asset, source FROM o JOIN a USING (dt, i)")(
        lambda spark, sf, mode=_mode: bt.null_permute(src.weekly(spark, sf), 7, 1, mode)
    )

HEX = "('0x' || substr(md5({}), 1, 8))::BIGINT"
NN = "nn AS (SELECT count(DISTINCT dt) AS n FROM p), lo AS (SELECT n, greatest(least(252, n // 3), n // 20) AS low FROM nn), rs AS (SELECT unnest(range(1, 6)) AS run)"
SHIFT = f"ms AS (SELECT run, pos, (pos - 1 - sh) - n * floor((pos - 1 - sh) / n::DOUBLE)::BIGINT + 1 AS source FROM (SELECT run, n, unnest(range(1, n + 1)) AS pos, low + {HEX.format("'7|' || run")} % greatest(1, n - 2 * low) AS sh FROM rs, lo))"
PERM = "b AS (SELECT run, b, least(21, n - b * 21) AS size, md5('7|' || run || '|' || b) AS k FROM rs, (SELECT n, unnest(range((n + 20) // 21)) AS b FROM nn)), c AS (SELECT *, (sum(size) OVER (PARTITION BY run ORDER BY k, b) - size)::BIGINT AS at_ FROM b), mp AS (SELECT run, at_ + i + 1 AS pos, b * 21 + i + 1 AS source FROM (SELECT run, b, at_, unnest(range(size)) AS i FROM c))"
BOOT = f"mb AS (SELECT run, b * 21 + i + 1 AS pos, start + i AS source FROM (SELECT run, b, n, 1 + {HEX.format("'7|' || run || '|' || b")} % (n - 20) AS start FROM rs, (SELECT n, unnest(range((n + 20) // 21)) AS b FROM nn)), (SELECT unnest(range(21)) AS i) WHERE b * 21 + i + 1 <= n)"
for _name, _mode, _sql, _table in (("null_shift", "shift", SHIFT, "ms"), ("null_block_perm", "blockperm", PERM, "mp"), ("null_block_boot", "block", BOOT, "mb")):
    query(_name, f"WITH $PW, {NN}, {_sql} SELECT run, pos, source FROM {_table}")(lambda spark, sf, mode=_mode: bt.null_index(bt.n_dates(src.weekly(spark, sf)), mode, 7, 5))


TRI = """m AS (SELECT d.dt, d.asset, d.close, rt.rate, b.rate AS num FROM d ASOF LEFT JOIN rt ON d.asset = rt.cur AND d.dt >= rt.valid_from ASOF LEFT JOIN (SELECT * FROM rt WHERE cur = 1) b ON d.dt >= b.valid_from),
g AS (SELECT dt, asset, close, close / lag(close) OVER o * (1 + (rate - num) * (dt - lag(dt) OVER o) / 360.0) AS g, rate - num AS diff FROM m WINDOW o AS (PARTITION BY asset ORDER BY dt))"""


@query("total_return_index", f"WITH $PD, $RT, {TRI} SELECT dt, asset, round(ln(product(coalesce(g, 1)) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS log_tri FROM g")
def _(spark, sf):
    t = decisions.total_return(src.daily(spark, sf), src.rates(spark, sf), 1)
    t = t.withColumn("tri", F.product(F.coalesce("growth", F.lit(1.0))).over(fr.running()))
    return t.select("dt", "asset", fr.tidy(F.ln("tri")).alias("log_tri"))


@query("mean_annual_carry", f"WITH $PD, $RT, {TRI} SELECT asset, round(avg(diff), 6) + 0.0 AS carry FROM g GROUP BY asset")
def _(spark, sf):
    t = decisions.total_return(src.daily(spark, sf), src.rates(spark, sf), 1)
    return t.groupBy("asset").agg(fr.tidy(F.avg("diff")).alias("carry"))


YIELD = "y AS (SELECT asset, arg_min(close, dt) AS a0, arg_max(close, dt) AS a1, arg_min(open, dt) AS u0, arg_max(open, dt) AS u1, count(*) - 1 AS n, (max(dt) - min(dt)) / 365.2425 AS years FROM d GROUP BY asset)"


@query("implied_yield_log", f"WITH $PD, {YIELD} SELECT asset, round((ln(a1 / a0) - ln(u1 / u0)) * 252 / n, 6) + 0.0 AS yield FROM y")
def _(spark, sf):
    return decisions.implied_yield(src.daily(spark, sf), "close", "open").select("asset", fr.tidy(F.col("yield")).alias("yield"))


@query("implied_yield_geo", f"WITH $PD, {YIELD} SELECT asset, round(pow(a1 / a0, 1 / years) - pow(u1 / u0, 1 / years), 6) + 0.0 AS yield FROM y")
def _(spark, sf):
    return decisions.implied_yield(src.daily(spark, sf), "close", "open", geometric=True).select("asset", fr.tidy(F.col("yield")).alias("yield"))


@query("dividend_spread", f"WITH $PD, {YIELD} SELECT round(max(v) - min(v), 6) + 0.0 AS spread FROM (SELECT (ln(a1 / a0) - ln(u1 / u0)) * 252 / n AS v FROM y)")
def _(spark, sf):
    y = decisions.implied_yield(src.daily(spark, sf), "close", "open")
    return y.agg(fr.tidy(F.max("yield") - F.min("yield")).alias("spread"))


@query("hold_state", f"""WITH RECURSIVE $PW, {TECH}, n AS (SELECT asset, dt, close, CASE WHEN bull AND NOT bear THEN 1 WHEN bear AND NOT bull THEN -1 ELSE 0 END AS signal, row_number() OVER (PARTITION BY asset ORDER BY dt) AS k FROM z),
st(asset, k, held, entry) AS (SELECT asset, 0::BIGINT, 0, NULL::DOUBLE FROM n WHERE k = 1 UNION ALL SELECT n.asset, n.k, CASE WHEN n.signal < 0 OR coalesce((entry - close) / entry >= 0.07 - 1e-12, FALSE) THEN 0 WHEN n.signal > 0 AND entry IS NULL THEN 1 ELSE held END,
  CASE WHEN n.signal < 0 OR coalesce((entry - close) / entry >= 0.07 - 1e-12, FALSE) THEN NULL WHEN n.signal > 0 AND entry IS NULL THEN close ELSE entry END FROM st JOIN n ON n.asset = st.asset AND n.k = st.k + 1)
SELECT n.dt, n.asset, n.signal, st.held, st.entry FROM st JOIN n ON n.asset = st.asset AND n.k = st.k""")
def _(spark, sf):
    return decisions.hold_state(sig.technical(src.weekly(spark, sf), 5, 20, 10)).select("dt", "asset", "signal", "held", "entry")


@query("orchestrator_decisions", f"""WITH $PW, r AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY asset ORDER BY dt) AS ret FROM p), {score_sql()},
z AS (SELECT *, sign(score)::INTEGER AS signal, row_number() OVER (PARTITION BY asset ORDER BY dt DESC) AS k FROM w2 WHERE score IS NOT NULL)
SELECT asset, dt, round(score, 5) + 0.0 AS score, signal, round(abs(score) * 2.9, 5) AS expected_edge_bps, round(2.9 * abs(signal) / 1.989, 5) AS required_edge_bps, abs(signal)::DOUBLE AS projected_turnover,
  signal <> 0 AND abs(score) * 2.9 >= 2.9 * abs(signal) / 1.989 AS approved FROM z WHERE k = 1""")
def _(spark, sf):
    d = decisions.orchestrate(src.weekly(spark, sf), 12, 4, 1, 0.0)
    return d.withColumns({"score": fr.tidy(F.col("score"), 5), "expected_edge_bps": F.round("expected_edge_bps", 5), "required_edge_bps": F.round("required_edge_bps", 5)})


RECORD = "SELECT o_orderkey AS instrument, o_totalprice AS score, o_orderstatus = 'F' AS approved, o_orderpriority AS priority FROM orders"


def _records(spark, sf):
    return src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("instrument"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").alias("approved"), F.col("o_orderpriority").alias("priority"))


for _format in ("json", "csv", "parquet"):
    query(f"{_format.replace('json', 'jsonl')}_roundtrip", RECORD)(lambda spark, sf, f=_format: stores.roundtrip(_records(spark, sf), f))


@query("jsonl_replay", RECORD.replace("SELECT ", "SELECT row_number() OVER (ORDER BY o_orderkey, o_totalprice) AS seq, "))
def _(spark, sf):
    r = _records(spark, sf)
    return stores.roundtrip(align.numbered(r, ["instrument", "score"], "seq"), "json").select("seq", *r.columns)


@query("decision_record", "SELECT o_orderkey AS instrument, o_totalprice AS score, '{\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}' AS metadata FROM orders")
def _(spark, sf):
    o = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("instrument"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return stores.decision_record(o, ["instrument", "score"])


@query("stream_bars_5s", "SELECT event_type AS asset, to_timestamp(floor(epoch(ts) / 5) * 5)::TIMESTAMP AS dt, min(value) AS low, max(value) AS high, arg_min(value, event_id) AS open, arg_max(value, event_id) AS close, count(*) AS n FROM events WHERE value > 0 GROUP BY 1, 2")
def _(spark, sf):
    return stream.run_bars(spark, f"{sf}/events.parquet")


@query("cs_ic_series", f"WITH $PW, $R, $F, {IC} SELECT dt, round(ic, 6) + 0.0 AS ic FROM ic WHERE n >= 10")
def _(spark, sf):
    return stats.rank_ic(_fwd(spark, sf), "ret", "fwd").filter("n >= 10").select("dt", fr.tidy(F.col("ic")).alias("ic"))


@query("cs_folds", """WITH $PW, $R, $F, dd AS (SELECT dt, count(*) AS c, row_number() OVER (ORDER BY dt) AS pos FROM (SELECT dt FROM f WHERE ret IS NOT NULL AND fwd IS NOT NULL) GROUP BY dt HAVING count(*) >= 10),
k AS (SELECT unnest(range(0, (n - 100 + 12) // 13)) AS fold, n FROM (SELECT count(*) AS n FROM dd)) SELECT fold, 101 + fold * 13 AS test_start, least(101 + fold * 13 + 12, max(n)) AS test_end, sum(c)::BIGINT AS train_rows FROM k JOIN dd ON pos <= 99 + fold * 13 GROUP BY fold""")
def _(spark, sf):
    counts = _fwd(spark, sf).filter("ret is not null and fwd is not null").groupBy("dt").agg(F.count("*").alias("n")).filter("n >= 10")
    o = stats.offsets(counts).join(bt.positions(counts), "dt")
    f = bt.folds(spark, counts.count(), 100, 13)
    return f.join(o, f.train_end == o.pos).select("fold", "test_start", "test_end", (F.col("first_row") + F.col("n")).alias("train_rows"))


@query("cost_sigma", f"WITH $PW, $R, $F, {COST} SELECT dt, round(sigma, 6) AS sigma FROM cg")
def _(spark, sf):
    return bt.trailing_sigma(bt.long_short_returns(_weights(spark, sf), _fwd(spark, sf)), 21).select("dt", F.round("sigma", 6).alias("sigma"))


@query("reversal_1d", "WITH $PW, $R, $F, k AS (SELECT dt, asset, fwd, row_number() OVER (PARTITION BY dt ORDER BY -ret DESC, asset) AS k, count(*) OVER (PARTITION BY dt) AS n FROM f WHERE ret IS NOT NULL), q AS (SELECT *, greatest(1, floor(0.2 * n + 1e-12)) AS q FROM k) SELECT dt, round(sum(CASE WHEN k <= q THEN fwd / q WHEN k > n - q THEN -fwd / q ELSE 0 END), 6) + 0.0 AS ret FROM q WHERE fwd IS NOT NULL GROUP BY dt")
def _(spark, sf):
    w = sig.long_short(_fwd(spark, sf).withColumn("score", -F.col("ret"))).filter("fwd is not null")
    return w.groupBy("dt").agg(fr.tidy(F.sum(F.col("weight") * F.col("fwd"))).alias("ret"))
