"""Rolling windows, signals, ranks, risk and sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import frames as fr
from tessera.operators import features as feat
from tessera.operators import signals as sig
from tessera.operators import stats
from tessera.plans.panels import returns
from tessera.plans.registry import Registry
from tessera.sources import panels as src

query = Registry()

TECH = """w AS (SELECT *, CASE WHEN count(close) OVER f5 = 5 THEN avg(close) OVER f5 END AS fast_sma, CASE WHEN count(close) OVER f20 = 20 THEN avg(close) OVER f20 END AS slow_sma,
  CASE WHEN count(close) OVER b10 = 10 THEN min(close) OVER b10 END AS support, CASE WHEN count(close) OVER b10 = 10 THEN max(close) OVER b10 END AS resistance FROM p
  WINDOW f5 AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), f20 AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b10 AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, lag(fast_sma) OVER o AS pf, lag(slow_sma) OVER o AS ps FROM w WINDOW o AS (PARTITION BY asset ORDER BY dt)),
e AS (SELECT *, coalesce(fast_sma > slow_sma AND pf <= ps, FALSE) AS golden_cross, coalesce(fast_sma < slow_sma AND pf >= ps, FALSE) AS death_cross, coalesce(close > resistance, FALSE) AS breakout, coalesce(close < support, FALSE) AS breakdown, CAST(sign(slow_sma - ps) AS INTEGER) AS slow_trend FROM l),
s AS (SELECT *, golden_cross AND coalesce(slow_trend < 0, FALSE) AS suppressed_golden, death_cross AND coalesce(slow_trend > 0, FALSE) AS suppressed_death FROM e),
z AS (SELECT *, (golden_cross AND NOT suppressed_golden) OR breakout AS bull, (death_cross AND NOT suppressed_death) OR breakdown AS bear FROM s)"""


def _tech(spark, sf):
    return sig.technical(src.weekly(spark, sf), 5, 20, 10)


def _columns(name, columns, extra=""):
    @query(name, f"WITH $PW, {TECH} SELECT dt, asset, {columns}{extra} FROM z")
    def _(spark, sf):
        return _tech(spark, sf).select("dt", "asset", *columns.split(", "))


_columns("sma", "fast_sma, slow_sma")
_columns("support_resistance", "support, resistance")
_columns("sma_crosses", "golden_cross, death_cross")
_columns("breakouts", "breakout, breakdown")
_columns("trend_filter", "slow_trend, suppressed_golden, suppressed_death")


@query("technical_signal", f"WITH $PW, {TECH} SELECT dt, asset, close, golden_cross, death_cross, breakout, breakdown, CASE WHEN bull AND NOT bear THEN 1 WHEN bear AND NOT bull THEN -1 ELSE 0 END AS signal FROM z")
def _(spark, sf):
    return _tech(spark, sf).select("dt", "asset", "close", "golden_cross", "death_cross", "breakout", "breakdown", "signal")


@query("candle_anatomy", """WITH $PD SELECT dt, asset, round(abs(close - open) / nullif(high - low, 0), 6) AS body, round((high - greatest(open, close)) / nullif(high - low, 0), 6) AS upper_shadow,
round((least(open, close) - low) / nullif(high - low, 0), 6) AS lower_shadow, round((high - low) / nullif(close, 0), 6) AS range_fraction FROM d""")
def _(spark, sf):
    c = sig.candles(src.daily(spark, sf))
    return c.select("dt", "asset", *[F.round(x, 6).alias(x) for x in ("body", "upper_shadow", "lower_shadow", "range_fraction")])


@query("rolling_vol", "WITH $PW, $R SELECT dt, asset, CASE WHEN count(*) OVER w = 13 AND count(ret) OVER w >= 13 THEN round(stddev_samp(ret) OVER w * sqrt(52), 6) END AS vol FROM r WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    return returns(spark, sf).select("dt", "asset", F.round(sig.rolling_volatility("ret", 13, 52), 6).alias("vol"))


@query("movmean", "WITH $PW SELECT dt, asset, round(avg(close) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS movmean FROM p")
def _(spark, sf):
    return src.weekly(spark, sf).select("dt", "asset", F.round(F.avg("close").over(fr.trailing(5)), 4).alias("movmean"))


@query("window_array", "WITH $PW, w AS (SELECT dt, asset, list(close) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a FROM p) SELECT dt, asset, list_aggregate(a, 'string_agg', ',') AS values FROM (SELECT dt, asset, list_transform(a, lambda x: x::BIGINT) AS a FROM w WHERE len(a) = 5)")
def _(spark, sf):
    a = F.collect_list("close").over(fr.trailing(5))
    w = src.weekly(spark, sf).withColumn("a", a).filter(F.size("a") == 5)
    return w.select("dt", "asset", F.array_join(F.transform("a", lambda x: x.cast("long").cast("string")), ",").alias("values"))


Z = "(close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0)"


@query("cs_zscore", f"WITH $PW SELECT dt, asset, round(coalesce({Z}, 0), 6) + 0.0 AS z FROM p WINDOW w AS (PARTITION BY dt)")
def _(spark, sf):
    return src.weekly(spark, sf).select("dt", "asset", fr.tidy(fr.zscore(F.col("close"), fr.group())).alias("z"))


RANK = "rank() OVER (PARTITION BY dt ORDER BY close) + (count(*) OVER (PARTITION BY dt, close) - 1) / 2"


@query("tied_rank", f"WITH $PW SELECT dt, asset, {RANK} AS rank FROM p")
def _(spark, sf):
    return src.weekly(spark, sf).select("dt", "asset", fr.tied_rank(F.col("close"), ["dt"]).alias("rank"))


@query("rank_normalize", f"WITH $PW SELECT dt, asset, round(({RANK} - 0.5) / count(*) OVER (PARTITION BY dt) - 0.5, 6) + 0.0 AS x FROM p")
def _(spark, sf):
    r = fr.tied_rank(F.col("close"), ["dt"])
    return src.weekly(spark, sf).select("dt", "asset", fr.tidy((r - 0.5) / F.count("close").over(fr.group()) - 0.5).alias("x"))


@query("z_normalize", "WITH $PW SELECT dt, asset, round((close - avg(close) OVER w) / CASE WHEN coalesce(stddev_samp(close) OVER w, 0) < 2.220446049250313e-16 THEN 1 ELSE stddev_samp(close) OVER w END, 6) + 0.0 AS x FROM p WINDOW w AS (PARTITION BY dt)")
def _(spark, sf):
    w, x = fr.group(), F.col("close")
    sd = F.stddev_samp(x).over(w)
    return src.weekly(spark, sf).select("dt", "asset", fr.tidy((x - F.avg(x).over(w)) / F.when(F.coalesce(sd, F.lit(0.0)) < 2.220446049250313e-16, 1.0).otherwise(sd)).alias("x"))


@query("combine_factors", f"""WITH $PW, $R, a AS (SELECT dt, asset, coalesce({Z}, 0) AS z1, coalesce((ret - avg(ret) OVER w) / nullif(stddev_pop(ret) OVER w, 0), 0) AS z2 FROM r WINDOW w AS (PARTITION BY dt)),
b AS (SELECT *, 0.7 * z1 + 0.3 * z2 AS s FROM a) SELECT dt, asset, round(coalesce((s - avg(s) OVER w) / nullif(stddev_pop(s) OVER w, 0), 0), 6) + 0.0 AS score FROM b WINDOW w AS (PARTITION BY dt)""")
def _(spark, sf):
    return sig.combine_factors(returns(spark, sf), {"close": 0.7, "ret": 0.3}).select("dt", "asset", fr.tidy(F.col("score")).alias("score"))


VOL = "v AS (SELECT dt, asset, close, ret, CASE WHEN count(*) OVER w = 13 AND count(ret) OVER w >= 13 THEN stddev_samp(ret) OVER w * sqrt(52) END AS vol FROM r WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 12 PRECEDING AND CURRENT ROW))"


@query("vol_adjusted_signal", f"WITH $PW, $R, {VOL} SELECT dt, asset, CASE WHEN vol IS NULL OR ret IS NULL THEN 0.0 WHEN vol = 0 THEN sign(ret) * 2.0 ELSE round(sign(ret) * least(0.1 / nullif(vol, 0), 2.0), 6) + 0.0 END::DOUBLE AS x FROM v")
def _(spark, sf):
    v = returns(spark, sf).withColumn("vol", sig.rolling_volatility("ret", 13, 52))
    return v.select("dt", "asset", fr.tidy(sig.volatility_adjusted(F.signum("ret"), F.col("vol"))).alias("x"))


@query("momentum_tanh", """WITH $PW, $R, m AS (SELECT dt, asset, CASE WHEN count(ret) OVER w = 8 THEN sum(ret) OVER w END AS s FROM r WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
t AS (SELECT *, tanh(coalesce((s - avg(s) OVER w) / nullif(stddev_pop(s) OVER w, 0), 0) / 2.0) AS x FROM m WINDOW w AS (PARTITION BY dt)) SELECT dt, asset, CASE WHEN s IS NOT NULL THEN CASE WHEN abs(x) < 0.1 THEN 0.0 ELSE round(x, 6) + 0.0 END END::DOUBLE AS momentum FROM t""")
def _(spark, sf):
    return sig.momentum(returns(spark, sf), 8, 2.0, 0.1).select("dt", "asset", fr.tidy(F.col("momentum")).alias("momentum"))


LS = """k AS (SELECT dt, asset, ret AS score, row_number() OVER (PARTITION BY dt ORDER BY ret DESC, asset) AS k, count(*) OVER (PARTITION BY dt) AS n FROM r WHERE ret IS NOT NULL),
wt AS (SELECT dt, asset, CASE WHEN k <= q THEN 1.0 / q WHEN k > n - q THEN -1.0 / q ELSE 0 END::DOUBLE AS weight FROM (SELECT *, greatest(1, floor(0.2 * n + 1e-12)) AS q FROM k))"""


def _weights(spark, sf):
    return sig.long_short(returns(spark, sf).withColumn("score", F.col("ret")))


@query("long_short_weights", f"WITH $PW, $R, {LS} SELECT dt, asset, round(weight, 6) + 0.0 AS weight FROM wt")
def _(spark, sf):
    return _weights(spark, sf).select("dt", "asset", fr.tidy(F.col("weight")).alias("weight"))


@query("turnover", f"WITH $PW, $R, {LS}, c AS (SELECT dt, abs(weight - coalesce(lag(weight) OVER (PARTITION BY asset ORDER BY dt), 0)) AS c FROM wt) SELECT dt, round(sum(c), 6) + 0.0 AS turnover FROM c GROUP BY dt")
def _(spark, sf):
    return sig.turnover(_weights(spark, sf)).withColumn("turnover", fr.tidy(F.col("turnover")))


@query("carry_trade_weights", """WITH $RT, k AS (SELECT *, row_number() OVER (PARTITION BY valid_from ORDER BY rate DESC, cur) AS u, row_number() OVER (PARTITION BY valid_from ORDER BY rate, cur DESC) AS dn FROM (SELECT cur, valid_from, round(rate, 6) AS rate FROM rt))
SELECT valid_from, cur, round((CASE WHEN u <= 3 THEN 1.0 ELSE 0 END - CASE WHEN dn <= 3 THEN 1.0 ELSE 0 END) / 3, 6)::DOUBLE + 0.0 AS weight FROM k""")
def _(spark, sf):
    r = src.rates(spark, sf).withColumn("rate", F.round("rate", 6))
    return sig.first_last(r, 3, "rate", "cur", "valid_from").select("valid_from", "cur", fr.tidy(F.col("weight")).alias("weight"))


@query("cost_guard", "WITH $PW, $R SELECT dt, asset, round(2.9 * abs(ret) / 1.989, 6) AS required_edge_bps, ret IS NOT NULL AND abs(ret * 2.9) >= 2.9 * abs(ret) / 1.989 AND ret <> 0 AS approved, round(CASE WHEN ret = 0 THEN 0 ELSE abs(ret * 2.9) / nullif(2.9 * abs(ret) / 1.989, 0) END, 6) AS efficiency FROM r WHERE ret IS NOT NULL")
def _(spark, sf):
    r = returns(spark, sf).filter("ret is not null")
    g = sig.cost_guard(F.signum("ret"), F.col("ret") * 2.9, F.abs("ret"))
    return r.select("dt", "asset", F.round(g["required_edge_bps"], 6).alias("required_edge_bps"), g["approved"].alias("approved"), F.round(F.when(F.col("ret") == 0, 0.0).otherwise(g["efficiency"]), 6).alias("efficiency"))


@query("settlement_check", "SELECT o_orderkey, greatest(0, 200000 - o_totalprice / 3) AS available_settled_cash, o_totalprice <= greatest(0, 200000 - o_totalprice / 3) + 1e-9 * greatest(1, greatest(0, 200000 - o_totalprice / 3)) AS approved FROM orders")
def _(spark, sf):
    s = sig.settlement(F.lit(200000.0), F.col("o_totalprice"), F.col("o_totalprice") / 3)
    return src.table(spark, sf, "orders").select("o_orderkey", *[c.alias(k) for k, c in s.items()])


@query("share_quantity", "SELECT o_orderkey, n // 1000 AS board_lots, n % 1000 AS odd_lot_shares, n AS total_shares FROM (SELECT o_orderkey, floor(o_totalprice / 37.5)::BIGINT AS n FROM orders)")
def _(spark, sf):
    q = sig.share_quantity(F.col("o_totalprice"), F.lit(37.5))
    return src.table(spark, sf, "orders").select("o_orderkey", *[q[k].alias(k) for k in ("board_lots", "odd_lot_shares", "total_shares")])


@query("stop_loss", "WITH $PD, l AS (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY dt) AS entry FROM d) SELECT dt, asset, (entry - close) / entry >= 0.07 - 1e-12 AS breached FROM l WHERE entry IS NOT NULL")
def _(spark, sf):
    b = src.daily(spark, sf).withColumn("entry", F.lag("close").over(fr.ordered())).filter("entry is not null")
    return b.select("dt", "asset", sig.stop_loss(F.col("entry"), F.col("close")).alias("breached"))


@query("limit_price", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 + 2.9 / 1e4) ELSE l_extendedprice * (2 - (1 + 2.9 / 1e4)) END, 2) AS price FROM lineitem")
def _(spark, sf):
    side = F.when(F.col("l_returnflag") == "R", "BUY").otherwise("SELL")
    return src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(sig.limit_price(side, F.col("l_extendedprice"), 2.9), 2).alias("price"))


RISK = """x AS (SELECT asset, dt, ret, product(1 + ret) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS equity, row_number() OVER (PARTITION BY asset ORDER BY dt DESC) AS k FROM r WHERE ret IS NOT NULL),
st AS (SELECT asset, arg_max(equity, dt) / max(equity) - 1 AS dd, CASE WHEN count(*) FILTER (k <= 21) = 21 THEN stddev_samp(ret) FILTER (k <= 21) * sqrt(52) END AS vol FROM x GROUP BY asset),
s2 AS (SELECT *, CASE WHEN vol > 0 THEN least(2.0, 0.1 / vol) ELSE 0 END AS vs, CASE WHEN vol > 0 THEN least(greatest(0.15 * 0.1 / vol, 0.05), 0.15) ELSE 0.15 END AS stop FROM st)"""


@query("risk_assess", f"WITH $PW, $R, {RISK} SELECT asset AS book, round(vol, 6) AS vol, round(dd, 6) + 0.0 AS drawdown, round(stop, 6) AS stop, dd <= -stop AS stopped_out, CASE WHEN dd <= -stop THEN 0.0 ELSE round(vs * (0.2 + 0.8 * greatest(0, 1 - abs(dd) / stop)), 6) END::DOUBLE AS risk_adjusted FROM s2")
def _(spark, sf):
    book = stats.equity(returns(spark, sf), ["asset"]).select(F.col("asset").alias("book"), "dt", "ret", "equity")
    w = book.select("book").distinct().select("book", F.lit("x").alias("asset"), F.lit(1.0).alias("w"), F.lit(True).alias("approved"))
    return sig.risk_assess(w, book, periods=52).select("book", F.round("vol", 6).alias("vol"), fr.tidy(F.col("drawdown")).alias("drawdown"), F.round("stop", 6).alias("stop"), "stopped_out", fr.tidy(F.col("risk_adjusted")).alias("risk_adjusted"))


def _dots(weights):
    return "[" + ", ".join(repr(float(x)) + "::DOUBLE" for x in weights) + "]"


def feature_tables(w: int, modes: int = 4, weighting: str = "uniform", source: str = "p") -> str:
    """The same algebra in SQL: dot products of the window, shifted by its last value, with fixed weights. Tables up to ft{w} (dt, asset, close and
    the six features), from dt, asset and close of `source`."""
    a, e, fit = feat.weights(w, modes, 1, weighting)
    rows = ", ".join(f"list_dot_product(s, {_dots(x)}) AS c{m}" for m, x in enumerate(a))
    edges = ", ".join(f"list_dot_product(s, {_dots(x)}) AS e{i}" for i, x in enumerate(e))
    resid = ", ".join(f"s[{i + 1}] - list_dot_product(s, {_dots(x)})" for i, x in enumerate(fit))
    eps = "2.220446049250313e-16"
    return f"""wa{w} AS (SELECT dt, asset, close, list(close) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS win FROM {source}),
wb{w} AS (SELECT dt, asset, close, list_transform(win, lambda x: x - close) AS s FROM wa{w} WHERE len(win) = {w}),
wc{w} AS (SELECT dt, asset, close, {rows}, {edges}, [{resid}] AS resid FROM wb{w}),
wd{w} AS (SELECT *, e0 + close AS edge, greatest(list_aggregate(resid, 'stddev_samp'), {eps}) AS sd FROM wc{w}),
ft{w} AS (SELECT dt, asset, close, e1 / greatest(abs(edge), {eps}) AS trend, e1 / sd AS trendT, e2 / greatest(abs(edge), {eps}) AS curv, (close - edge) / sd AS dev, sd / greatest(abs(edge), {eps}) AS vol, (c2 * c2 + c3 * c3) / greatest(c1 * c1 + c2 * c2 + c3 * c3, {eps}) AS rough FROM wd{w})"""


DIGITS = {"trend": 6, "trendT": 4, "curv": 5, "dev": 6, "vol": 6, "rough": 6}


def _feature_sql(w: int, modes: int = 4, weighting: str = "uniform") -> str:
    return f"{feature_tables(w, modes, weighting)} SELECT dt, asset, " + ", ".join(f"round({c}, {d}) + 0.0 AS W{w}_{c}" for c, d in DIGITS.items()) + f" FROM ft{w}"


def _tidy_features(f, w):
    return f.select("dt", "asset", *[fr.tidy(F.col(f"W{w}_{k}"), d).alias(f"W{w}_{k}") for k, d in DIGITS.items()])


for _name, _w, _kind in (("wavelet_features_w21", 21, "uniform"), ("wavelet_features_cheb", 13, "chebyshev")):
    query(_name, "WITH $PW, " + _feature_sql(_w, weighting=_kind))(lambda spark, sf, w=_w, kind=_kind: _tidy_features(feat.causal_features(src.weekly(spark, sf), [w], weighting=kind), w))


@query("wavelet_features_multi", f"WITH $PW SELECT * FROM (WITH {_feature_sql(21)}) a JOIN (WITH {_feature_sql(52)}) b USING (dt, asset)")
def _(spark, sf):
    f = feat.causal_features(src.weekly(spark, sf), [21, 52], engine="arrow")
    return _tidy_features(f, 21).join(_tidy_features(f, 52), ["dt", "asset"])


def _smooth_sql(windows: list[int]) -> str:
    edges = {w: feat.weights(w, 4, 1, "uniform")[1] for w in windows}
    wins = ", ".join(f"list(close) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS a{w}, date_diff('day', lag(dt, {w - 1}) OVER (PARTITION BY asset ORDER BY dt), dt) AS days{w}" for w in windows)
    shifted = ", ".join(f"list_transform(a{w}, lambda x: x - close) AS s{w}, days{w}" for w in windows)
    out = ", ".join(f"round(list_dot_product(s{w}, {_dots(e[0])}) + close, 3) + 0.0 AS W{w}_smooth, round(list_dot_product(s{w}, {_dots(e[1])}) / days{w}, 3) + 0.0 AS W{w}_slope" for w, e in edges.items())
    return f"w0 AS (SELECT dt, asset, close, {wins} FROM p), w1 AS (SELECT dt, asset, close, {shifted} FROM w0 WHERE len(a{max(windows)}) = {max(windows)}) SELECT dt, asset, {out} FROM w1"


@query("causal_smooth_slope", "WITH $PW, " + _smooth_sql([13, 21]))
def _(spark, sf):
    f = feat.causal_features(src.weekly(spark, sf), [13, 21], smooth=True, engine="arrow")
    return f.select("dt", "asset", *[fr.tidy(F.col(c), 3).alias(c) for c in ("W13_smooth", "W13_slope", "W21_smooth", "W21_slope")])


def score_sql(w: int = 12, modes: int = 4) -> str:
    """Tables up to w2 (dt, asset, score), from the returns in r."""
    from tessera.functions.basis import signal_projector

    a = signal_projector(w, modes)
    return f"""w0 AS (SELECT dt, asset, list(ret) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS win, count(ret) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS n FROM r),
w1 AS (SELECT dt, asset, CASE WHEN n = {w} THEN (list_dot_product(list_transform(win, lambda x: coalesce(x, 0)), {_dots(a[1])}) - list_avg(win) * {float(a[1].sum())!r}) / nullif(list_aggregate(win, 'stddev_pop'), 0) END AS c FROM w0),
w2 AS (SELECT dt, asset, (c - avg(c) OVER (PARTITION BY dt)) / nullif(stddev_pop(c) OVER (PARTITION BY dt), 0) AS score FROM w1)"""


@query("wavelet_signal", f"WITH $PW, $R, {score_sql()} SELECT dt, asset, round(score, 5) + 0.0 AS score, CASE WHEN abs(score) >= 0.5 THEN sign(score)::INTEGER ELSE 0 END AS signal FROM w2")
def _(spark, sf):
    s = feat.wavelet_signal(returns(spark, sf), 12, 4, 1, 0.5)
    return s.select("dt", "asset", fr.tidy(F.col("score"), 5).alias("score"), "signal")


INDEX = """ix AS (SELECT dt, avg(ret) AS r FROM r GROUP BY dt), iy AS (SELECT dt, coalesce(r, 0) AS r, product(1 + coalesce(r, 0)) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) AS level FROM ix)"""


@query("equal_weight_index", f"WITH $PW, $R, {INDEX} SELECT dt, round(r, 6) + 0.0 AS ret, round(ln(level), 6) + 0.0 AS log_level FROM iy")
def _(spark, sf):
    return feat.equal_weight_index(src.weekly(spark, sf)).select("dt", fr.tidy(F.col("ret")).alias("ret"), fr.tidy(F.ln("level")).alias("log_level"))


EWMA = f"""{INDEX}, n AS (SELECT dt, r, row_number() OVER (ORDER BY dt) AS k FROM iy), s0 AS (SELECT var_pop(r) AS v FROM n WHERE k BETWEEN 2 AND 21),
e(k, v) AS (SELECT 21::BIGINT, v FROM s0 UNION ALL SELECT e.k + 1, 0.94 * e.v + 0.06 * n.r * n.r FROM e JOIN n ON n.k = e.k)"""
TARGETS = """tg AS (SELECT *, CASE WHEN vol IS NOT NULL AND count(vol) OVER b >= 52 THEN quantile_cont(vol, 0.5) OVER b END AS target FROM vv WINDOW b AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ex AS (SELECT *, CASE WHEN target IS NOT NULL THEN least(greatest(target / greatest(vol, 2.220446049250313e-16), 0), 1) END AS x FROM tg),
sm AS (SELECT dt, vol, target, CASE WHEN x IS NOT NULL THEN least(greatest(avg(x) OVER (ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0), 1) END AS exposure FROM ex)"""
FILTER = f"{EWMA}, vv AS (SELECT n.dt, CASE WHEN e.v IS NOT NULL THEN sqrt(e.v * 52) END AS vol FROM n LEFT JOIN e ON n.k = e.k), {TARGETS}"
WAVELET = f"""{INDEX}, il AS (SELECT dt, 'index' AS asset, level AS close FROM iy), {feature_tables(13, source="il")}, {feature_tables(21, source="il")},
vv AS (SELECT iy.dt, (a.vol + b.vol) / 2 * sqrt(52) AS vol FROM iy LEFT JOIN ft13 a ON a.dt = iy.dt LEFT JOIN ft21 b ON b.dt = iy.dt), {TARGETS}"""


@query("ewma_vol", f"WITH RECURSIVE $PW, $R, {EWMA} SELECT n.dt, round(sqrt(e.v * 52), 6) AS vol FROM e JOIN n ON n.k = e.k")
def _(spark, sf):
    v = feat.ewma_volatility(feat.equal_weight_index(src.weekly(spark, sf)), 21, periods=52)
    return v.filter("vol is not null").select("dt", F.round("vol", 6).alias("vol"))


def _filtered(spark, sf, estimator="ewma"):
    return feat.risk_filter(src.weekly(spark, sf), [13, 21], min_history=52, estimator=estimator, periods=52)


@query("risk_filter_ewma", f"WITH RECURSIVE $PW, $R, {FILTER} SELECT dt, round(vol, 6) AS vol, round(target, 6) AS target, round(exposure, 6) AS exposure FROM sm")
def _(spark, sf):
    return _filtered(spark, sf).select("dt", *[F.round(c, 6).alias(c) for c in ("vol", "target", "exposure")])


@query("risk_filter_wavelet", f"WITH $PW, $R, {WAVELET} SELECT dt, round(vol, 6) AS vol, round(target, 6) AS target, round(exposure, 6) AS exposure FROM sm")
def _(spark, sf):
    return _filtered(spark, sf, "wavelet").select("dt", *[F.round(c, 6).alias(c) for c in ("vol", "target", "exposure")])


@query("risk_diagnostics", f"WITH RECURSIVE $PW, $R, {FILTER}, ch AS (SELECT *, abs(exposure - lag(exposure) OVER (ORDER BY dt)) AS c FROM sm) SELECT count(exposure) AS n_valid, round(avg(exposure), 6) AS mean_exposure, round(stddev_samp(exposure), 6) AS std_exposure, round(avg(CASE WHEN exposure < 1 THEN 1.0 WHEN exposure >= 1 THEN 0 END), 6) AS share_derisked, round(avg(c), 6) AS turnover FROM ch")
def _(spark, sf):
    d = feat.risk_diagnostics(_filtered(spark, sf))
    return d.select("n_valid", *[F.round(c, 6).alias(c) for c in d.columns[1:]])
