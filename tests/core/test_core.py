"""Goldens, identities, causality, rules and round trips of the panel library."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import basis as b
from tessera.functions import config
from tessera.functions import frames as fr
from tessera.operators import align, backtest, decisions, features, signals, stats, wavelets
from tessera.sources import panels, stores
from tessera.streaming import bars as stream

SF = "/root/testdata/sf0.001"


def panel(spark, columns, start="2020-01-01"):
    rows = [(pd.Timestamp(start).date() + pd.Timedelta(days=i).to_pytimedelta(), a, None if x is None else float(x)) for a, xs in columns.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "dt date, asset string, close double")


def column(df, name, asset="a"):
    return [r[name] for r in df.filter(F.col("asset") == asset).orderBy("dt").collect()]


# the basis


def test_integration_blocks_golden():
    own, later = b.integration_blocks(2, 4)
    assert (own == np.array([[1 / 8, 1 / 16, 0, 0], [-3 / 32, 0, 1 / 32, 0], [1 / 24, -1 / 48, 0, 1 / 48], [-1 / 32, 0, -1 / 64, 0]])).all()
    assert (later[:, 0] == [1 / 4, 0, 1 / 12, 0]).all() and not later[:, 1:].any()


@pytest.mark.parametrize("j", range(4))
@pytest.mark.parametrize("m", range(2, 7))
def test_identities(j, m):
    x, w = b.quadrature(2 * m)
    assert abs(b.u_table(m, x) * w @ b.u_table(m, x).T * b.scale(j) ** 2 / 2 ** (j + 1) - np.eye(m)).max() < 1e-14
    h = b.product_blocks(j, np.random.default_rng(1).normal(size=(1 << j) * m), m)
    assert abs(h - h.transpose(0, 2, 1)).max() < 1e-13
    p, d = b.integration_matrix(j, m), np.kron(np.eye(1 << j), b.differentiation_block(j, m))
    rows = [i for i in range(len(p)) if i % m != m - 1]
    assert abs((p @ d - np.eye(len(p)))[rows]).max() < 1e-12
    u = np.linspace(-1, 1, 20001)
    for k in range(m):
        assert abs(np.trapezoid(b.chebyshev_u(k, u), u) - (2 / (k + 1) if k % 2 == 0 else 0)) < 1e-5


def test_expansion_converges_at_fourth_order():
    f, t = lambda t: np.exp(t) * np.sin(4 * t), np.linspace(0, 1, 4001)
    err = []
    for j in range(6):
        s = b.expand(f, j, 4) @ b.basis(j, 4, t)
        err.append(math.sqrt(np.mean((s - f(t)) ** 2)))
    order = np.log2(np.array(err[2:-1]) / np.array(err[3:]))
    assert (abs(order - 4) < 0.1).all()


def test_odes_golden():
    c = b.solve_linear_ode(2, 4, 2.0, lambda t: t)
    assert abs(c[0] - 0.003866313244751) < 1e-14
    t = np.linspace(0, 1, 401)
    exact = t / 2 - 0.25 + 0.25 * np.exp(-2 * t)
    assert abs(c @ b.basis(2, 4, t) - exact).max() < 1.1e-5
    c = b.solve_linear_ode(4, 6, lambda t: t, lambda t: t)
    assert abs(c @ b.basis(4, 6, t) - (1 - np.exp(-(t**2) / 2))).max() < 1e-11


def test_ode_table_equals_the_driver(spark):
    rows = spark.createDataFrame([(1, 2.0, 0.0, 0.0, 1.0, 0.0), (2, 0.0, 1.0, 0.0, 1.0, 0.5)], "id long, a double, b double, f0 double, f1 double, y0 double")
    got = wavelets.solve_odes(spark, rows, 2, 4).orderBy("id", "cell", "mode").toPandas()
    assert np.allclose(got[got.id == 1].c, b.solve_linear_ode(2, 4, 2.0, lambda t: t), atol=1e-15)
    assert np.allclose(got[got.id == 2].c, b.solve_linear_ode(2, 4, lambda t: t, lambda t: t, 0.5), atol=1e-15)


def test_integration_by_running_sums_equals_the_matrix(spark):
    c = np.random.default_rng(2).normal(size=(4, 3))
    df = spark.createDataFrame([("a", n, c[n].tolist()) for n in range(4)], "asset string, cell int, c array<double>")
    got = np.array([r.c for r in wavelets.apply_integration(df, 2, 3).orderBy("cell").collect()]).ravel()
    assert np.allclose(got, b.integration_matrix(2, 3).T @ c.ravel(), atol=1e-15)
    coo = np.zeros((12, 12))
    for r in wavelets.integration_coo(spark, 2, 3).collect():
        coo[r.i, r.j] = r.v
    assert (coo == b.integration_matrix(2, 3)).all()


# features


def test_engines_agree_and_windows_do_not_look_ahead(spark):
    rng = np.random.default_rng(3)
    p = panel(spark, {a: (100 * np.exp(np.cumsum(rng.normal(0, 0.01, 90)))).tolist() for a in "abc"})
    one = features.causal_features(p, [13, 21], smooth=True).orderBy("asset", "dt").toPandas()
    two = features.causal_features(p, [13, 21], smooth=True, engine="arrow").orderBy("asset", "dt").toPandas()
    names = [c for c in two if c[0] == "W"]
    assert len(one) == len(two) == 3 * 70 and np.allclose(one[names].astype(float), two[names].astype(float), rtol=1e-8, atol=1e-9)
    for op in (lambda q: features.causal_features(q, [13]), lambda q: signals.technical(q, 5, 20, 10), lambda q: signals.momentum(q.withColumn("ret", fr.simple_return(F.col("close"), fr.ordered())), 8)):
        assert stats.leak_test(p, op, "2020-02-20").first().changed == 0
    assert stats.leak_test(p, lambda q: wavelets.denoise_batch(q, 2, 4), "2020-02-20").first().changed > 0


def test_a_polynomial_is_reproduced(spark):
    t = np.linspace(0, 1, 40)
    p = panel(spark, {"a": (5 + 2 * t - 3 * t**2 + t**3).tolist()})
    got = wavelets.denoise_batch(p, 0, 4).orderBy("dt").toPandas()
    assert abs(got.smooth - got.close).max() < 2e-3
    f = features.causal_features(p, [21], smooth=True).orderBy("dt").toPandas()
    assert abs(f.W21_smooth - f.close).max() < 1e-10 and abs(f.W21_dev).max() < 1e5


def test_denoising_reaches_the_published_error(spark):
    """750 points of a sine, a slow walk and noise of 1.2: about 0.284 is published, a moving mean has 0.325."""
    rng = np.random.default_rng(42)
    t = np.arange(750)
    clean = {a: 100 + 12 * np.sin(2 * np.pi * t / 250) + np.cumsum(0.06 * rng.normal(size=750)) for a in "abcdef"}
    p = panel(spark, {a: (x + rng.normal(0, 1.2, 750)).tolist() for a, x in clean.items()})
    truth = np.concatenate([clean[a] for a in "abcdef"])
    for kappa, most in ((0.0, 0.31), (0.5, 1.0)):
        s = wavelets.denoise_batch(p, 3, 4, kappa=kappa).orderBy("asset", "dt").toPandas().smooth
        assert np.sqrt(np.mean((s - truth) ** 2)) < most


def test_ewma_and_risk_filter(spark):
    rng = np.random.default_rng(4)
    p = panel(spark, {a: (100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120)))).tolist() for a in "ab"})
    v = features.ewma_volatility(features.equal_weight_index(p), 21).orderBy("dt").toPandas()
    r, x = v.ret.to_numpy(), float(np.var(v.ret[1:21]))
    for i in range(21, 120):
        x = 0.94 * x + 0.06 * r[i - 1] ** 2
    assert abs(v.vol.iloc[-1] - math.sqrt(x * 252)) < 1e-12 and v.vol[:20].isna().all()
    f = features.risk_filter(p, [13, 21], min_history=30, estimator="ewma").orderBy("dt").toPandas()
    assert f.exposure.dropna().between(0, 1).all() and f.exposure[:50].isna().all() and f.exposure[51:].notna().all()
    g = features.risk_filter(p, [13, 21], min_history=30, estimator="ewma", warmup="floor").orderBy("dt").toPandas()
    assert (g.exposure[:50] == 0).all()


# signals


def test_sma_and_missing_values(spark):
    p = panel(spark, {"a": [1.0, 2, 3, 4, 5, 6]})
    assert column(p.select("*", signals.sma(2).alias("s")), "s") == [None, 1.5, 2.5, 3.5, 4.5, 5.5]
    assert column(p.select("*", signals.sma(3).alias("s")), "s")[2] == 2.0
    q = panel(spark, {"a": [1.0, None, 3, 4, 5]})
    assert column(q.select("*", signals.sma(2).alias("s")), "s") == [None, None, None, 3.5, 4.5]


def test_signals_exclude_one_another(spark):
    rng = np.random.default_rng(5)
    p = panel(spark, {a: (100 * np.exp(np.cumsum(rng.normal(0, 0.012, 120)))).tolist() for a in "abc"})
    t = signals.technical(p, 5, 20, 10).toPandas()
    assert not (t.golden_cross & t.death_cross).any() and not (t.breakout & t.breakdown).any()
    assert set(t.signal) <= {-1, 0, 1} and (t[t.suppressed_golden].golden_cross).all()
    raw = signals.technical(p, 5, 20, 10, trend_filter=False).toPandas()
    assert not raw.suppressed_golden.any()
    with pytest.raises(ValueError):
        signals.technical(p, 20, 5)


def test_candles(spark):
    b_ = spark.createDataFrame([(100.0, 110.0, 99.0, 101.0), (5.0, 5.0, 5.0, 5.0)], "open double, high double, low double, close double")
    got = signals.candles(b_).collect()
    assert (got[0].body, got[0].upper_shadow, got[0].lower_shadow) == (1 / 11, 9 / 11, 1 / 11)
    assert got[1].body is None and got[1].range_fraction == 0


def scalar(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalar_rules(spark):
    q = signals.share_quantity(F.lit(75_500.0), F.lit(50.0))
    assert tuple(scalar(spark, *[c.alias(k) for k, c in q.items()])) == (1, 510, 1510, 75_500.0)
    assert scalar(spark, *[signals.stop_loss(F.lit(e), F.lit(p)).alias(n) for n, e, p in (("a", 100.0, 93.0), ("b", 100.0, 93.01), ("c", 10.0, 9.30))]) == (True, False, True)
    s = signals.settlement(F.lit(100.0), F.lit(60.0), F.lit(40.0))
    assert tuple(scalar(spark, *[c.alias(k) for k, c in s.items()])) == (60.0, True)
    g = signals.cost_guard(F.lit(0), F.lit(100.0), F.lit(1.0))
    assert scalar(spark, g["approved"].alias("x")).x is False
    v = [signals.volatility_adjusted(F.lit(1.0), F.lit(x).cast("double")).alias(n) for n, x in (("a", 0.0), ("b", None), ("c", 0.2))]
    assert tuple(scalar(spark, *v)) == (2.0, 0.0, 0.5)
    assert tuple(scalar(spark, *[signals.limit_price(F.lit(x), F.lit(100.0), 10).alias(x) for x in ("BUY", "SELL")])) == (100.1, 99.9)
    with pytest.raises(KeyError):
        signals.combine_factors(spark.range(1), {"nope": 1.0})


def test_long_short_ties_go_by_name(spark):
    d = pd.Timestamp("2020-01-01").date()
    s = spark.createDataFrame([(d, a, 1.0) for a in "edcba"], "dt date, asset string, score double")
    assert {r.asset: r.weight for r in signals.long_short(s, 0.2).collect()} == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": -1.0}


# alignment


def test_as_of_and_fill(spark):
    p = panel(spark, {"a": [1.0] * 60})
    r = spark.createDataFrame([("a", "2020-01-10", 1.0), ("a", "2020-01-20", 2.0)], "asset string, v string, rate double").selectExpr("asset", "to_date(v) AS valid_from", "rate")
    got = column(align.as_of(p, r, "asset", "dt", "valid_from", "rate", 1), "rate")
    assert got == [None] * 9 + [1.0] * 10 + [2.0] * 32 + [None] * 9
    q = panel(spark, {"a": [None, 1.0, None, None, 4.0, None]})
    assert column(align.fill_linear(q), "filled") == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_positions_and_checks(spark):
    i = spark.createDataFrame([("x", 1, "S", "USD", "STK"), ("y", 0, "T", "USD", "STK"), ("z", 5, "U", "USD", "STK")], "name string, con_id int, symbol string, currency string, sec_type string")
    p = spark.createDataFrame([(1, "other", "USD", "STK", 3), (7, "T", "USD", "STK", 4), (0, "U", "USD", "STK", 5), (6, "U", "USD", "STK", 9)], "con_id int, symbol string, currency string, sec_type string, quantity int")
    assert {r.name: r.quantity for r in align.match_positions(i, p).collect()} == {"x": 3, "y": 4, "z": 5}
    assert panels.require_total_return(" adjusted_last ") == "ADJUSTED_LAST"
    with pytest.raises(ValueError):
        panels.require_total_return("TRADES")
    assert panels.require_total_return("TRADES", True) == "TRADES"
    m = panels.synthetic(spark, ["a", "b"], 50, 1)
    assert m.exceptAll(panels.synthetic(spark, ["a", "b"], 50, 1)).count() == 0
    assert m.filter("high < low or high < open or low > close").count() == 0 and m.count() == 100


# backtests


def test_ridge_by_moments_equals_the_direct_fit(spark):
    rng = np.random.default_rng(6)
    days = pd.date_range("2020-01-01", periods=60)
    frame = pd.DataFrame([(d.date(), a, *rng.normal(size=3)) for d in days for a in "abcde"], columns=["dt", "asset", "x", "z", "y"])
    f = backtest.folds(spark, 60, 30, 10)
    got = {r.fold: r for r in backtest.ridge_fits(spark.createDataFrame(frame), ["x", "z"], "y", f, 2.0).collect()}
    for r in f.collect():
        tr = frame[(frame.dt >= days[r.train_start - 1].date()) & (frame.dt <= days[r.train_end - 1].date())]
        x = tr[["x", "z"]].to_numpy()
        x = np.hstack([np.ones((len(x), 1)), (x - x.mean(0)) / x.std(0, ddof=1)])
        beta = np.linalg.solve(x.T @ x + 2.0 * np.diag([0, 1, 1]), x.T @ tr.y.to_numpy())
        assert np.allclose(got[r.fold].beta, beta, atol=1e-10)
    rolling = backtest.folds(spark, 60, 30, 10, scheme="rolling", window=25).collect()
    assert all(r.train_end - r.train_start == 24 for r in rolling)


def test_ranks_of_many_columns_equal_the_windows(spark):
    rng = np.random.default_rng(18)
    rows = [(f"d{i % 3}", f"a{i}", None if i % 11 == 4 else float(rng.integers(0, 6)), float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "dt string, asset string, x double, z double")
    n = F.count("*").over(fr.group())
    want = df.withColumns({c: (fr.tied_rank(F.col(c), ["dt"]) - 0.5) / n - 0.5 for c in ("x", "z")})
    got = {r.asset: r for r in signals.rank_features(df, ["x", "z"]).collect()}
    for r in want.collect():
        assert (got[r.asset].x is None) == (r.x is None) and abs((got[r.asset].x or 0) - (r.x or 0)) < 1e-12 and abs(got[r.asset].z - r.z) < 1e-12


def test_logistic_reaches_a_stationary_point():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3))
    y = np.sign(x @ [1.0, -0.5, 0] + rng.normal(size=300))
    beta = backtest.logistic_irls(x, y, 1.0)
    p = 1 / (1 + np.exp(-(beta[0] + x @ beta[1:])))
    assert abs(((y > 0) - p).sum()) < 1e-6 and abs(x.T @ ((y > 0) - p) - beta[1:]).max() < 1e-6
    assert backtest.select_penalty(x[:10], y[:10], [0.1, 1, 10]) == 1
    assert backtest.select_penalty(x, y, [0.1, 1, 10]) in (0.1, 1, 10)


def test_null_maps_and_breakeven(spark):
    ns = spark.createDataFrame([("a", 100), ("b", 63)], "asset string, n long")
    for mode in ("shift", "blockperm"):
        got = backtest.null_index(ns, mode, 1, 3, 21).groupBy("asset", "run").agg(F.count_distinct("source").alias("n"), F.count_distinct("pos").alias("m")).collect()
        assert len(got) == 6 and all((r.n, r.m) == ({"a": 100, "b": 63}[r.asset],) * 2 for r in got)
    assert backtest.null_index(ns, "block", 1, 1, 21).filter("source < 1 or source > 100").count() == 0
    with pytest.raises(ValueError):
        backtest.null_index(ns, "x", 1, 1)
    s = spark.createDataFrame([(0.0, 2.0), (1.0, 1.0), (2.0, -1.0)], "spread double, sharpe double")
    assert backtest.breakeven(s).first().breakeven == 1.5
    assert backtest.breakeven(s.filter("spread > 1")).first().breakeven is None
    assert backtest.breakeven(s.filter("spread < 2")).first().breakeven == math.inf


def test_cross_sectional_null_equals_a_refit(spark):
    """Several features, each run fitted anew in NumPy on the targets that its own map deals out."""
    rng = np.random.default_rng(16)
    days = pd.date_range("2020-01-01", periods=50)
    frame = pd.DataFrame([(d.date(), f"a{i:02}", *rng.normal(size=4)) for d in days for i in range(12)], columns=["dt", "asset", "x", "z", "y", "fwd"])
    rows = spark.createDataFrame(frame)
    f = backtest.folds(spark, 50, 30, 10)
    got = {r.run: r for r in backtest.cross_sectional_backtest(rows, ["x", "z"], "y", f, 2.0, runs=2, mode="date", seed=3, periods=52).collect()}
    maps = {0: frame.assign(source=frame.asset), **{k: frame.merge(backtest.null_permute(rows, 3, k, "date").toPandas(), on=["dt", "asset"]) for k in (1, 2)}}
    own = frame.set_index(["dt", "asset"])
    for run, m in maps.items():
        m = m.sort_values(["dt", "asset"])
        theirs = own.loc[list(zip(m.dt, m.source, strict=True))]
        m = m.assign(y=theirs.y.to_numpy(), fwd=theirs.fwd.to_numpy())
        ics, rets = [], []
        for r in f.collect():
            at = m.dt.map({d.date(): k for k, d in enumerate(days, 1)})
            tr, te = m[(at >= r.train_start) & (at <= r.train_end)], m[(at >= r.test_start) & (at <= r.test_end)]
            x = tr[["x", "z"]].to_numpy()
            te = te.assign(score=te[["x", "z"]].to_numpy() @ np.linalg.solve(x.T @ x + 2 * np.eye(2), x.T @ tr.y))
            for _, day in te.groupby("dt"):
                ics.append(day.score.rank().corr(day.fwd.rank()))
                day = day.sort_values("score")
                rets.append(day.fwd.tail(2).mean() - day.fwd.head(2).mean())
        assert abs(got[run].ic_mean - np.mean(ics)) < 1e-9 and got[run].n_dates == len(ics)
        assert abs(got[run].sharpe - np.mean(rets) / np.std(rets, ddof=1) * 52**0.5) < 1e-9
    p = backtest.null_p_values(spark.createDataFrame([(0, 0.2), (1, 0.1), (2, 0.2), (3, 0.3)], "run int, m double"), ["m"]).first()
    assert (p.runs, p.p_m) == (3, 0.75)


def test_expanding_median_and_numbers(spark):
    rng = np.random.default_rng(17)
    v = [None if i % 7 == 3 else float(x) for i, x in enumerate(rng.integers(0, 9, 60))]
    p = panel(spark, {"a": v, "b": v[::-1]})
    got = stats.expanding_median(p, "close", "med", least=3).orderBy("asset", "dt").collect()
    for a, x in (("a", v), ("b", v[::-1])):
        past = [[q for q in x[:i] if q is not None] for i in range(len(x))]
        assert [r.med for r in got if r.asset == a] == [float(np.median(q)) if len(q) >= 3 else None for q in past]
    n = align.numbered(p.filter("close is not null"), ["asset", "dt"], "seq").orderBy("asset", "dt").collect()
    assert [r.seq for r in n] == list(range(1, len(n) + 1))


def test_antiderivatives_and_condition(spark):
    t = np.linspace(0, 1, 2001)
    exact, psi = b.antiderivative(2, 4, t), b.basis(2, 4, t)
    rough = np.concatenate([np.zeros((16, 1)), np.cumsum((psi[:, 1:] + psi[:, :-1]) / 2 * np.diff(t), axis=1)], axis=1)
    assert abs(exact - rough).max() < 5e-3
    d = features.feature_diagnostics(panel(spark, {"a": [1.0] * 30}), [13, 21]).orderBy("window").collect()
    assert [(r.first_valid_row, r.edge_lookback) for r in d] == [(21, 13.0), (21, 21.0)] and all(r.operator_cond >= 1 for r in d)
    assert features.feature_diagnostics(panel(spark, {"a": [1.0] * 20}), [21]).first().first_valid_row is None


def test_drawdown_conventions(spark):
    r = panel(spark, {"a": [-0.5, 0.1, -0.2]}).withColumnRenamed("close", "ret")
    assert stats.drawdown(r, ["asset"]).first().max_drawdown == -0.56
    assert stats.drawdown(r, ["asset"], convention="backtest").first().max_drawdown == 0.2
    with pytest.raises(ValueError):
        stats.drawdown(r, ["asset"], convention="x")


# decisions, stores, streams


def test_hold_state_and_sandbox(spark):
    p = panel(spark, {"a": [100.0, 100, 93.01, 93.0, 100, 100]}).withColumn("signal", F.when(F.dayofmonth("dt").isin(1, 5), 1).when(F.dayofmonth("dt") == 6, -1).otherwise(0))
    h = decisions.hold_state(p)
    assert column(h, "held") == [1, 1, 1, 0, 1, 0] and column(h, "entry") == [100.0, 100.0, 100.0, None, 100.0, None]
    w = panels.weekly(spark, SF)
    one, two = (decisions.sandbox(w, 5, 20, 10) for _ in range(2))
    assert one.exceptAll(two).count() == 0
    s = decisions.summary(one).first()
    assert s.written == w.count() and s.approved <= s.written and one.filter("weight != 0 and not approved").count() == 0


@pytest.mark.parametrize("kind", stores.FORMATS)
def test_logs_are_appended_and_replayed(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a,\"b\"\n", True), (2, None, False)], "seq int, note string, ok boolean")
    for _ in range(2):
        stores.append(df, str(tmp_path / "log"), kind)
    got = stores.replay(spark, str(tmp_path / "log"), df.schema, kind, ["seq"]).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in df.collect() for _ in range(2)]


def test_malformed_lines_are_errors(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"seq": 1}\n\n{"seq": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        stores.replay(spark, str(tmp_path), "seq int").collect()


def test_decision_lines_are_numbered_and_checked(spark, tmp_path):
    df = spark.createDataFrame([(2, None, True), (1, "a", False)], "seq int, note string, ok boolean")
    stores.append_decisions(df, str(tmp_path / "log"))
    line = json.loads(next(x for x in stores.decision_lines(df).collect() if '"seq":2' in x.value).value)
    assert list(line) == sorted(line) and line["note"] is None and line["timestamp"].endswith("+00:00")
    assert {(r.seq, r.note, r.ok) for r in stores.replay_decisions(spark, str(tmp_path / "log"), df.schema).collect()} == {(2, None, True), (1, "a", False)}
    (tmp_path / "bad.jsonl").write_text('{"seq": 1}\n\n{"seq": \n')
    with pytest.raises(Exception, match="malformed decision at .*bad.jsonl:3"):
        stores.replay_decisions(spark, str(tmp_path / "bad.jsonl"), "seq int").collect()


def test_stream_equals_batch(spark, tmp_path):
    got = stream.run_bars(spark, f"{SF}/events.parquet")
    batch = stream.bars(spark.read.parquet(f"{SF}/events.parquet"))
    assert got.exceptAll(batch.select(got.columns)).count() == 0 and got.count() == batch.count()


def test_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("date,USD,JPY\n2020-01-01,1.5,.\n2020-02-01,2.0,0.1\n")
    got = {(r.cur, str(r.valid_from)): r.rate for r in panels.read_rates_csv(spark, str(tmp_path / "r.csv")).collect()}
    assert got == {("USD", "2020-02-01"): 0.015, ("USD", "2020-03-01"): 0.02, ("JPY", "2020-03-01"): 0.001}
    (tmp_path / "fx.json").write_text(json.dumps({"rates": {"2020-01-02": {"USD": 1.1, "JPY": 120.0}, "2020-01-03": {"USD": 1.2}}}))
    assert panels.read_dated_json(spark, str(tmp_path / "fx.json")).count() == 3
    chart = {"chart": {"result": [{"meta": {"symbol": "SPY"}, "timestamp": [1577975400], "indicators": {"quote": [{"close": [10.0]}], "adjclose": [{"adjclose": [9.5]}]}}]}}
    (tmp_path / "c.json").write_text(json.dumps(chart))
    r = panels.read_chart_json(spark, str(tmp_path / "c.json")).first()
    assert (str(r.dt), r.asset, r.close) == ("2020-01-02", "SPY", 9.5)
    p, made = panel(spark, {"a": [1.0], "b": [2.0]}), str(tmp_path / "cache")
    with pytest.raises(FileNotFoundError):
        panels.cached(spark, made, ["a"], offline=True)
    assert panels.cached(spark, made, ["a", "b"], build=lambda: p).count() == 2
    assert panels.cached(spark, made, ["a"], start="2020-01-01", offline=True).count() == 2
    with pytest.raises(FileNotFoundError):
        panels.cached(spark, made, ["c"], offline=True)


GOOD = {
    "schema_version": 1, "system": {"host": "h", "paper_only": True, "submit_orders": False, "port": 7497, "client_id": 1, "account": None},
    "trading_rules": {"max_break_even_bps": 2.9, "unit_shares": 1000, "allow_odd_lots": True, "stop_loss_pct": 0.07, "reference_turnover": 1.989, "order_slippage_bps": 0.0},
    "indicators": {"wavelet_window_size": 21, "wavelet_mode_count": 4, "wavelet_signal_mode": 1, "wavelet_threshold": 0.0, "sma_fast_window": 20, "sma_slow_window": 60, "support_resistance_window": 20, "sma_trend_filter": True},
    "risk": {"x": {"y": 3}}, "data_store": {}, "orchestration": {},
}


def test_config(tmp_path):
    at = tmp_path / "c.json"

    def load(change=None):
        raw = json.loads(json.dumps(GOOD))
        if change:
            section, key, value = change
            raw[section][key] = value
        at.write_text(json.dumps(raw))
        return config.load(at)

    c = load()
    assert c.get("risk.x.y") == 3 and c.get("system.port") == 7497 and c.get("risk.no", 5) == 5
    with pytest.raises(config.ConfigError):
        c.get("risk.no")
    for change in (("system", "paper_only", False), ("system", "submit_orders", True), ("system", "port", "7497"), ("trading_rules", "stop_loss_pct", 1.5), ("indicators", "sma_fast_window", 60), ("indicators", "wavelet_signal_mode", 4), ("system", "extra", 1)):
        with pytest.raises(config.ConfigError):
            load(change)


def test_every_query_has_a_plan(spark):
    from tessera.plans import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.queries()) > 150
