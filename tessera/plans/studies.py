"""Whole studies: backtests with their nulls, diagnostics, logs, documents and made panels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import frames as fr
from tessera.operators import backtest as bt
from tessera.operators import decisions, stats
from tessera.operators import features as feat
from tessera.operators import signals as sig
from tessera.plans.backtests import FOLDS, HEX, IC, NN, PERM, RECORD, SHIFT, TRI, _fwd
from tessera.plans.panels import returns
from tessera.plans.registry import Registry
from tessera.plans.signals import LS, TECH, _weights
from tessera.sources import panels as src
from tessera.sources import stores
from tessera.streaming import bars as stream

query = Registry()

# the cross-section and its permutations

RUNS, PENALTY = 5, 10


def _ranked(spark, sf):
    """Ranks of the last return, standardised forward returns. Written, as every run reads them."""
    f = _fwd(spark, sf).withColumn("y", bt.cs_target(None))
    ok = f.filter("ret is not null and y is not null and fwd is not null")
    x = (fr.tied_rank(F.col("ret"), ["dt"]) - 0.5) / F.count("*").over(fr.group()) - 0.5
    return stores.settle(ok.select("dt", "asset", x.alias("x"), "y", "fwd"))


def _cross_sql(mode: str) -> str:
    """Tables up to cs (run, n_dates, ic_mean, sharpe)."""
    k = "'7|' || run || '|' || CAST(dt AS VARCHAR) || '|' || asset" if mode == "date" else "'7|' || run || '|' || asset"
    return f"""yy AS (SELECT *, CASE WHEN stddev_pop(fwd) OVER w >= 2.220446049250313e-16 THEN (fwd - avg(fwd) OVER w) / stddev_pop(fwd) OVER w END AS y FROM f WINDOW w AS (PARTITION BY dt)),
u AS (SELECT dt, asset, (rank() OVER (PARTITION BY dt ORDER BY ret) + (count(*) OVER (PARTITION BY dt, ret) - 1) / 2 - 0.5) / count(*) OVER (PARTITION BY dt) - 0.5 AS x, y, fwd FROM yy WHERE ret IS NOT NULL AND y IS NOT NULL AND fwd IS NOT NULL),
rn AS (SELECT dt, asset, unnest(range(1, {RUNS + 1})) AS run FROM u), pa AS (SELECT run, dt, asset AS source, row_number() OVER (PARTITION BY run, dt ORDER BY md5({k}), asset) AS i FROM rn), po AS (SELECT run, dt, asset, row_number() OVER (PARTITION BY run, dt ORDER BY asset) AS i FROM rn),
al AS (SELECT 0 AS run, dt, asset, x, y, fwd FROM u UNION ALL SELECT run, dt, po.asset, o.x, s.y, s.fwd FROM po JOIN pa USING (run, dt, i) JOIN u o ON o.dt = po.dt AND o.asset = po.asset JOIN u s ON s.dt = po.dt AND s.asset = pa.source),
dp AS (SELECT dt, row_number() OVER (ORDER BY dt) AS pos FROM (SELECT DISTINCT dt FROM u)), fo AS (SELECT k AS fold, 99 + k * 13 AS train_end, 101 + k * 13 AS test_start, 113 + k * 13 AS test_end FROM (SELECT unnest(range(0, (n - 100 + 12) // 13)) AS k FROM (SELECT max(pos) AS n FROM dp))),
mo AS (SELECT run, pos, sum(x * y) AS xy, sum(x * x) AS xx FROM al JOIN dp USING (dt) GROUP BY 1, 2), bb AS (SELECT run, fold, test_start, test_end, sum(xy) / (sum(xx) + {PENALTY}) AS beta FROM fo JOIN mo ON pos <= train_end GROUP BY 1, 2, 3, 4),
sc AS (SELECT al.run, al.dt, asset, beta * x AS score, fwd FROM al JOIN dp USING (dt) JOIN bb ON bb.run = al.run AND pos BETWEEN test_start AND test_end),
rk AS (SELECT *, rank() OVER (PARTITION BY run, dt ORDER BY score) + (count(*) OVER (PARTITION BY run, dt, score) - 1) / 2 AS a, rank() OVER (PARTITION BY run, dt ORDER BY fwd) + (count(*) OVER (PARTITION BY run, dt, fwd) - 1) / 2 AS b,
  row_number() OVER (PARTITION BY run, dt ORDER BY score DESC, asset) AS k, greatest(1, floor(0.2 * count(*) OVER (PARTITION BY run, dt) + 1e-12)) AS q, count(*) OVER (PARTITION BY run, dt) AS n FROM sc),
dd AS (SELECT run, dt, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic, sum(CASE WHEN k <= q THEN fwd / q WHEN k > n - q THEN -fwd / q ELSE 0 END) AS ret FROM rk GROUP BY 1, 2),
cs AS (SELECT run, count(*) AS n_dates, avg(ic) AS ic_mean, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52) AS sharpe FROM dd GROUP BY run)"""


def _cross(spark, sf, mode):
    rows = _ranked(spark, sf)
    return bt.cross_sectional_backtest(rows, ["x"], "y", bt.folds(spark, bt.n_dates(rows), 100, 13), PENALTY, runs=RUNS, mode=mode, seed=7, periods=52)


for _mode in ("date", "asset"):
    query(f"cs_backtest_{_mode}", f"WITH $PW, $R, $F, {_cross_sql(_mode)} SELECT run, n_dates, round(ic_mean, 6) + 0.0 AS ic_mean, round(sharpe, 5) + 0.0 AS sharpe FROM cs")(
        lambda spark, sf, mode=_mode: _cross(spark, sf, mode).select("run", "n_dates", fr.tidy(F.col("ic_mean")).alias("ic_mean"), fr.tidy(F.col("sharpe"), 5).alias("sharpe"))
    )
    query(f"cs_null_{_mode}", f"WITH $PW, $R, $F, {_cross_sql(_mode)}, o AS (SELECT ic_mean, sharpe FROM cs WHERE run = 0) SELECT round(o.ic_mean, 6) + 0.0 AS ic_mean, round(o.sharpe, 5) + 0.0 AS sharpe, count(*) AS runs, round((1 + count(*) FILTER (cs.ic_mean >= o.ic_mean)) / (1.0 + count(*)), 6) AS p_ic_mean, round((1 + count(*) FILTER (cs.sharpe >= o.sharpe)) / (1.0 + count(*)), 6) AS p_sharpe FROM cs, o WHERE run > 0 GROUP BY o.ic_mean, o.sharpe")(
        lambda spark, sf, mode=_mode: bt.null_p_values(_cross(spark, sf, mode), ["ic_mean", "sharpe"]).select(
            fr.tidy(F.col("ic_mean")).alias("ic_mean"), fr.tidy(F.col("sharpe"), 5).alias("sharpe"), "runs", F.round("p_ic_mean", 6).alias("p_ic_mean"), F.round("p_sharpe", 6).alias("p_sharpe")
        )
    )


# single series and their shifted or block-permuted returns


def _series_sql(map_: str, table: str) -> str:
    """Tables up to ws (asset, run, n_test, accuracy): the maps by each series' own length."""
    own = map_.replace("FROM rs, lo)", "FROM rs, (SELECT *, greatest(least(252, n // 3), n // 20) AS low FROM nn))")
    return f"""u AS (SELECT asset, ret AS x, fwd, row_number() OVER (PARTITION BY asset ORDER BY dt) AS pos FROM f WHERE ret IS NOT NULL AND fwd IS NOT NULL), cn AS (SELECT asset, count(*) AS size FROM u GROUP BY asset), nn AS (SELECT DISTINCT size AS n FROM cn), rs AS (SELECT unnest(range(1, 4)) AS run),
{_by_length(own, table)}, al AS (SELECT 0 AS run, asset, pos, x, fwd FROM u UNION ALL SELECT m.run, u.asset, u.pos, u.x, s.fwd FROM u JOIN cn USING (asset) JOIN {table} m ON m.n = cn.size AND m.pos = u.pos JOIN u s ON s.asset = u.asset AND s.pos = m.source),
lb AS (SELECT *, CASE WHEN fwd >= 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS y FROM al),
fo AS (SELECT k AS fold, 99 + k * 13 AS train_end, 101 + k * 13 AS test_start, 113 + k * 13 AS test_end FROM (SELECT unnest(range(0, (n - 100 + 12) // 13)) AS k FROM (SELECT max(n) AS n FROM nn))),
ft AS (SELECT run, asset, fold, any_value(test_start) AS test_start, any_value(test_end) AS test_end, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd, sum(x * y) AS xy, sum(y) AS sy FROM fo JOIN lb ON pos <= train_end GROUP BY 1, 2, 3 HAVING max(pos) = any_value(train_end)),
sc AS (SELECT lb.run, lb.asset, y, fwd, CASE WHEN sy / n + ((xy - m * sy) / sd) / (n - 1 + 1.0) * (x - m) / sd >= 0 THEN 1.0 ELSE -1.0 END AS side FROM lb JOIN ft ON ft.run = lb.run AND ft.asset = lb.asset AND pos BETWEEN test_start AND test_end),
ws AS (SELECT asset, run, count(*) AS n_test, avg((side = y)::INTEGER::DOUBLE) AS accuracy, avg(side * fwd) / nullif(stddev_samp(side * fwd), 0) * sqrt(52) AS sharpe FROM sc GROUP BY 1, 2)"""


def _by_length(sql: str, table: str) -> str:
    """The maps carry the length they are for."""
    if table == "ms":
        return sql.replace("SELECT run, pos, (pos - 1 - sh)", "SELECT n, run, pos, (pos - 1 - sh)")
    return (
        sql.replace("SELECT run, b, least(21", "SELECT n, run, b, least(21").replace("PARTITION BY run ORDER BY k, b", "PARTITION BY n, run ORDER BY k, b")
        .replace("mp AS (SELECT run, at_", "mp AS (SELECT n, run, at_").replace("FROM (SELECT run, b, at_, unnest", "FROM (SELECT n, run, b, at_, unnest")
    )


def _series(spark, sf, mode):
    rows = stores.settle(_fwd(spark, sf).filter("ret is not null and fwd is not null").select("asset", "dt", F.col("ret").alias("x"), "fwd"))
    longest = rows.groupBy("asset").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    return bt.series_backtest(rows, ["x"], bt.folds(spark, longest, 100, 13), 1.0, runs=3, mode=mode, seed=7, periods=52)


for _name, _mode, _map, _table in (("shift", "shift", SHIFT, "ms"), ("block_perm", "blockperm", PERM, "mp")):
    query(f"walkforward_null_{_name}", f"WITH $PW, $R, $F, {_series_sql(_map, _table)}, o AS (SELECT asset, accuracy FROM ws WHERE run = 0) SELECT o.asset, round(o.accuracy, 6) AS accuracy, count(*) AS runs, round((1 + count(*) FILTER (ws.accuracy >= o.accuracy)) / (1.0 + count(*)), 6) AS p_accuracy FROM ws JOIN o USING (asset) WHERE run > 0 GROUP BY 1, 2")(
        lambda spark, sf, mode=_mode: bt.null_p_values(_series(spark, sf, mode), ["accuracy"], ["asset"]).select("asset", F.round("accuracy", 6).alias("accuracy"), "runs", F.round("p_accuracy", 6).alias("p_accuracy"))
    )


@query("direction_accuracy", "WITH $PW, $R, $F, u AS (SELECT ret, CASE WHEN fwd > 0 THEN 1.0 WHEN fwd < 0 THEN -1.0 ELSE 0 END::DOUBLE AS y, dt <= DATE '1996-06-30' AS train FROM f WHERE ret IS NOT NULL AND fwd IS NOT NULL), "
       "m AS (SELECT avg(ret) AS m, stddev_samp(ret) AS sd FROM u WHERE train), z AS (SELECT (ret - m) / sd AS z, y, train FROM u, m), g AS (SELECT count(*) + 0.001 AS n, sum(z) AS sz, sum(z * z) + 0.001 AS zz, sum(y) AS sy, sum(z * y) AS zy FROM z WHERE train), "
       "b AS (SELECT (sy * zz - sz * zy) / (n * zz - sz * sz) AS b0, (n * zy - sz * sy) / (n * zz - sz * sz) AS b1 FROM g) SELECT count(*) AS n_test, round(avg((sign(b0 + b1 * z) = y)::INTEGER::DOUBLE), 6) AS accuracy FROM z, b WHERE NOT train")
def _(spark, sf):
    """A ridge with a fixed split by date, the intercept penalised too, and how often its sign is right afterwards."""
    u = _fwd(spark, sf).filter("ret is not null and fwd is not null").select("ret", F.signum("fwd").alias("y"), (F.col("dt") <= F.lit("1996-06-30").cast("date")).alias("train"))
    m = u.filter("train").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"))
    z = u.join(F.broadcast(m)).select(((F.col("ret") - F.col("m")) / F.col("sd")).alias("z"), "y", "train")  # one row
    g = z.filter("train").agg((F.count("*") + 1e-3).alias("n"), F.sum("z").alias("sz"), (F.sum(F.col("z") * F.col("z")) + 1e-3).alias("zz"), F.sum("y").alias("sy"), F.sum(F.col("z") * F.col("y")).alias("zy"))
    det = F.col("n") * F.col("zz") - F.col("sz") * F.col("sz")
    b = g.select(((F.col("sy") * F.col("zz") - F.col("sz") * F.col("zy")) / det).alias("b0"), ((F.col("n") * F.col("zy") - F.col("sz") * F.col("sy")) / det).alias("b1"))
    right = F.signum(F.col("b0") + F.col("b1") * F.col("z")) == F.col("y")
    return z.filter("not train").join(F.broadcast(b)).agg(F.count("*").alias("n_test"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))  # one row


# extensions that are reported beside a backtest

MATCH = """bk AS (SELECT wt.dt, sum(weight * coalesce(fwd, 0)) AS strategy FROM wt LEFT JOIN f USING (dt, asset) GROUP BY 1), bm AS (SELECT dt, avg(fwd) AS benchmark FROM f WHERE fwd IS NOT NULL GROUP BY dt), bo AS (SELECT dt, strategy, benchmark FROM bk JOIN bm USING (dt)),
sc AS (SELECT stddev_samp(strategy) / nullif(stddev_samp(benchmark), 0) AS k FROM bo), lo AS (SELECT 'strategy' AS name, dt, strategy AS ret FROM bo UNION ALL SELECT 'benchmark', dt, benchmark * k FROM bo, sc),
eq AS (SELECT *, product(1 + ret) OVER (PARTITION BY name ORDER BY dt ROWS UNBOUNDED PRECEDING) AS eq FROM lo), pk AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY name ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS peak FROM eq)"""


@query("vol_matched", f"WITH $PW, $R, $F, {LS}, {MATCH} SELECT name, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52), 6) + 0.0 AS sharpe, round(stddev_samp(ret) * sqrt(52), 6) + 0.0 AS volatility FROM lo GROUP BY name")
def _(spark, sf):
    f = _fwd(spark, sf)
    book = _weights(spark, sf).join(f.select("dt", "asset", "fwd"), ["dt", "asset"], "left").groupBy("dt").agg(F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("strategy"))
    market = f.filter("fwd is not null").groupBy("dt").agg(F.avg("fwd").alias("benchmark"))
    return bt.volatility_matched(book.join(market, "dt"), "strategy", "benchmark", periods=52).select("name", "sharpe", "volatility")


MOM = "mm AS (SELECT dt, asset, ret, fwd, lag(close, 4) OVER o / lag(close, 52) OVER o - 1 AS mom FROM f WINDOW o AS (PARTITION BY asset ORDER BY dt))"


@query("momentum_skip", f"WITH $PW, $R, $F, {MOM}, q AS (SELECT dt, rank() OVER (PARTITION BY dt ORDER BY mom) + (count(*) OVER (PARTITION BY dt, mom) - 1) / 2 AS a, rank() OVER (PARTITION BY dt ORDER BY fwd) + (count(*) OVER (PARTITION BY dt, fwd) - 1) / 2 AS b FROM mm WHERE mom IS NOT NULL AND fwd IS NOT NULL) SELECT dt, count(*) AS n, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) + 0.0 AS ic FROM q GROUP BY dt")
def _(spark, sf):
    """The year's return without the last month, held against the next week's."""
    o = fr.ordered()
    m = _fwd(spark, sf).withColumn("mom", fr.ratio(F.lag("close", 4).over(o), F.lag("close", 52).over(o)) - 1)
    return stats.rank_ic(m, "mom", "fwd").select("dt", "n", fr.tidy(F.col("ic")).alias("ic"))


@query("score_last_return", f"WITH $PW, $R, $F, {MOM}, q AS (SELECT dt, rank() OVER (PARTITION BY dt ORDER BY mom) + (count(*) OVER (PARTITION BY dt, mom) - 1) / 2 AS a, rank() OVER (PARTITION BY dt ORDER BY ret) + (count(*) OVER (PARTITION BY dt, ret) - 1) / 2 AS b FROM mm WHERE mom IS NOT NULL AND ret IS NOT NULL), i AS (SELECT dt, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic FROM q GROUP BY dt) SELECT round(avg(ic), 6) + 0.0 AS corr, count(ic) AS n FROM i")
def _(spark, sf):
    """How much a score is the last return under another name: the mean rank correlation of both."""
    o = fr.ordered()
    m = _fwd(spark, sf).withColumn("mom", fr.ratio(F.lag("close", 4).over(o), F.lag("close", 52).over(o)) - 1)
    return stats.rank_ic(m, "mom", "ret").agg(fr.tidy(F.avg("ic")).alias("corr"), F.count("ic").alias("n"))


@query("bonferroni", "WITH $PW, $R, m AS (SELECT asset, avg(ret) AS a FROM r GROUP BY asset), p2 AS (SELECT x.asset, (1 + count(*) FILTER (y.a >= x.a)) / (1.0 + count(*)) AS p FROM m x, m y GROUP BY x.asset) SELECT asset, round(p, 6) AS p, round(least(1, p * count(*) OVER ()), 6) AS adjusted FROM p2")
def _(spark, sf):
    """Each asset's mean return against all assets', with the p-values adjusted for their number."""
    m = returns(spark, sf).groupBy("asset").agg(F.avg("ret").alias("a"))
    order = W.partitionBy(F.lit(1)).orderBy(F.desc("a"))  # one row an asset
    n = F.count("a").over(W.partitionBy(F.lit(1)))
    ranked = m.withColumn("p", (1 + F.count("a").over(order.rangeBetween(W.unboundedPreceding, 0))) / (1.0 + n))
    return bt.bonferroni(ranked).select("asset", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


def _grid(spark, sf):
    """All configurations in one pass: they are keys of the same windows, joins and aggregates."""
    panel = stores.settle(_fwd(spark, sf))
    by_window = [sig.momentum(panel, w).select("dt", "asset", F.lit(w).alias("window"), "momentum") for w in (4, 13)]
    scored = by_window[0].unionByName(by_window[1]).withColumn("threshold", F.explode(F.lit([0.0, 0.5])))
    scored = scored.withColumn("score", F.when(F.abs("momentum") < F.col("threshold"), 0.0).otherwise(F.col("momentum")))
    held = sig.long_short(scored, at=["window", "threshold", "dt"]).withColumn("weight", F.when(F.col("score") == 0, 0.0).otherwise(F.col("weight")))
    book = bt.hold_between(held, [1, 21], keys=["window", "threshold"])
    keys = ["window", "threshold", "every"]
    ret = bt.long_short_returns(book, panel, 2.0, keys=keys).select(*keys, "dt", F.col("net").alias("ret"))
    return stats.performance(ret, keys, periods=52)


def _summed(w: int) -> str:
    return f"SELECT {w} AS win, dt, asset, CASE WHEN count(ret) OVER w = {w} THEN sum(ret) OVER w END AS s FROM r WINDOW w AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


SENSITIVITY = f"""m AS ({_summed(4)} UNION ALL {_summed(13)}),
t0 AS (SELECT *, tanh(coalesce((s - avg(s) OVER w) / nullif(stddev_pop(s) OVER w, 0), 0) / 2.0) AS x FROM m WINDOW w AS (PARTITION BY win, dt)),
t AS (SELECT win, thr, dt, asset, s, CASE WHEN abs(x) < thr THEN 0.0 ELSE x END AS score FROM t0, (SELECT unnest([0.0, 0.5])::DOUBLE AS thr)),
k AS (SELECT win, thr, dt, asset, score, row_number() OVER (PARTITION BY win, thr, dt ORDER BY score DESC, asset) AS k, count(*) OVER (PARTITION BY win, thr, dt) AS n FROM t WHERE s IS NOT NULL),
wt AS (SELECT win, thr, dt, asset, CASE WHEN score = 0 THEN 0 WHEN k <= q THEN 1.0 / q WHEN k > n - q THEN -1.0 / q ELSE 0 END::DOUBLE AS weight FROM (SELECT *, greatest(1, floor(0.2 * n + 1e-12)) AS q FROM k)),
dl AS (SELECT win, thr, dt, row_number() OVER (PARTITION BY win, thr ORDER BY dt) AS pos FROM (SELECT DISTINCT win, thr, dt FROM wt)),
hl AS (SELECT a.win, a.thr, every, a.pos, asset, weight FROM dl a, (SELECT unnest([1, 21]) AS every) JOIN dl b ON b.win = a.win AND b.thr = a.thr AND b.pos = a.pos - (a.pos - 1) % every JOIN wt ON wt.win = a.win AND wt.thr = a.thr AND wt.dt = b.dt),
pv AS (SELECT win, thr, every, pos + 1 AS pos, asset, weight AS old FROM hl),
bo AS (SELECT win, thr, every, pos, asset, coalesce(weight, 0) AS x, coalesce(old, 0) AS y FROM hl FULL JOIN pv USING (win, thr, every, pos, asset)),
ls AS (SELECT bo.win, bo.thr, every, dl.dt, sum(x * coalesce(fwd, 0)) - 2.0 / 1e4 * sum(abs(x - y)) AS ret FROM bo JOIN dl ON dl.win = bo.win AND dl.thr = bo.thr AND dl.pos = bo.pos LEFT JOIN f ON f.dt = dl.dt AND f.asset = bo.asset GROUP BY 1, 2, 3, 4)"""


@query("sensitivity", f"WITH $PW, $R, $F, {SENSITIVITY} SELECT win AS window, thr AS threshold, every, count(*) AS observations, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52), 6) + 0.0 AS sharpe FROM ls GROUP BY 1, 2, 3")
def _(spark, sf):
    """Windows, thresholds below which a score is flat, and rebalancing every date or month."""
    return _grid(spark, sf).select("window", "threshold", "every", "observations", "sharpe")


# features, order, picks


@query("feature_diagnostics", "WITH $PW, c AS (SELECT asset, count(*) AS n FROM p GROUP BY asset) SELECT asset, w::INTEGER AS window, CASE WHEN n >= 52 THEN 52 END::INTEGER AS first_valid_row, (w / 1.0)::DOUBLE AS edge_lookback FROM c, (SELECT unnest([13, 21, 52]) AS w)")
def _(spark, sf):
    return feat.feature_diagnostics(src.weekly(spark, sf), [13, 21, 52]).select("asset", "window", "first_valid_row", "edge_lookback")


def _cond_sql() -> str:
    """The condition number with one mode is 1; with two it follows from the Gram matrix of 1 and u over equidistant times."""
    return """SELECT w::INTEGER AS window, round(greatest(sqrt(a / b), sqrt(b / a)), 6) AS operator_cond FROM (SELECT w, w::DOUBLE AS a, list_sum(list_transform(range(w), lambda i: pow(2 * (4.0 * i / (w - 1) / 2 - 1), 2))) AS b FROM (SELECT unnest([13, 21, 52]) AS w))"""


@query("operator_condition", _cond_sql())
def _(spark, sf):
    """The condition number of the projection on two modes, by window."""
    one = src.weekly(spark, sf).select(F.lit("any").alias("asset"))
    return feat.feature_diagnostics(one, [13, 21, 52], modes=2).select("window", F.round("operator_cond", 6).alias("operator_cond"))


@query("carry_order", f"WITH $PD, $RT, {TRI}, c AS (SELECT asset, round(avg(diff), 6) + 0.0 AS carry FROM g GROUP BY asset) SELECT asset, carry, row_number() OVER (ORDER BY carry DESC, asset) AS place FROM c")
def _(spark, sf):
    t = decisions.total_return(src.daily(spark, sf), src.rates(spark, sf), 1)
    c = t.groupBy("asset").agg(fr.tidy(F.avg("diff")).alias("carry"))
    return c.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("carry"), "asset")).cast("long"))  # one row an asset


@query("priority_pick", "SELECT o_custkey AS account, arg_min(o_orderkey, (CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END) * 1000000000000 + o_orderkey) AS value FROM orders GROUP BY 1")
def _(spark, sf):
    """Of an account's values the first urgent one, or else the first."""
    o = src.table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("value"), "o_orderpriority")
    return stats.priority_pick(o, ["account"], "value", F.col("o_orderpriority") == "1-URGENT", F.col("value"))


@query("set_union_names", "SELECT p_brand AS name FROM part UNION SELECT n_name FROM nation")
def _(spark, sf):
    return src.table(spark, sf, "part").select(F.col("p_brand").alias("name")).union(src.table(spark, sf, "nation").select("n_name")).distinct()


@query("chronological", "WITH $PD SELECT asset, dt, close, row_number() OVER (PARTITION BY asset ORDER BY dt) AS place FROM d")
def _(spark, sf):
    """Rows as a sink gets them, each series in order of time."""
    return src.daily(spark, sf).withColumn("place", F.row_number().over(fr.ordered()).cast("long")).select("asset", "dt", "close", "place").orderBy("asset", "dt")


# documents of rates and charts


@query("eur_rates", "SELECT CAST(l_shipdate AS DATE) AS dt, l_linenumber::VARCHAR AS cur, round(avg(l_discount::DOUBLE), 6) + 0.0 AS x FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    """Daily rates written as documents of dates and currencies, a file a partition of the dates, and read back."""
    rates = src.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("dt"), F.col("l_linenumber").cast("string").alias("cur")).agg(fr.tidy(F.avg(F.col("l_discount").cast("double"))).alias("x"))
    day = rates.groupBy(F.col("dt").cast("string").alias("dt")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cur", "x")))).alias("m"))
    month = day.groupBy(F.substring("dt", 1, 7).alias("month")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dt", F.to_json("m").alias("m"))))).alias("rates"))
    text = month.select(F.concat(F.lit('{"rates":{'), F.array_join(F.transform(F.map_entries("rates"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}}")).alias("value"), "month")
    at = stores.scratch(spark)
    text.write.partitionBy("month").text(at)
    return src.read_dated_json(spark, at)


@query("chart_json", "WITH $PD SELECT dt, asset::VARCHAR AS asset, close FROM d")
def _(spark, sf):
    """Daily closes written as one chart document a ticker and read back on the exchange's dates."""
    d = src.daily(spark, sf).select(F.col("asset").cast("string").alias("asset"), F.unix_timestamp(F.to_utc_timestamp(F.col("dt").cast("timestamp") + F.expr("interval 9 hours 30 minutes"), "America/New_York")).alias("t"), "close")
    series = d.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("t", "close"))).alias("s"))
    values = F.transform("s", lambda z: z["close"])
    result = F.struct(F.struct(F.col("asset").alias("symbol")).alias("meta"), F.transform("s", lambda z: z["t"]).alias("timestamp"), F.struct(F.array(F.struct(values.alias("close"))).alias("quote"), F.array(F.struct(values.alias("adjclose"))).alias("adjclose")).alias("indicators"))
    at = stores.scratch(spark)
    series.select(F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("value"), "asset").write.partitionBy("asset").text(at)
    return src.read_chart_json(spark, at)


@query("cached_panel", "WITH $PW SELECT dt, asset, close FROM p")
def _(spark, sf):
    """A panel through its cache: built on the first call, then read offline."""
    at = stores.scratch(spark)
    src.cached(spark, at, ["Brand#11"], build=lambda: src.weekly(spark, sf))
    return src.cached(spark, at, ["Brand#11", "Brand#22"], offline=True)


@query("synthetic_market", "SELECT unnest(['AAA', 'BBB', 'CCC']) AS asset, 500::BIGINT AS n, 0::BIGINT AS n_missing, 0::BIGINT AS n_nonpositive, 0::BIGINT AS n_crossed, 0::BIGINT AS n_half")
def _(spark, sf):
    return src.check_prices(src.synthetic(spark, ["AAA", "BBB", "CCC"], 500, 7))


NORMAL = "sqrt(-2 * ln((('0x' || substr({d}, 1, 8))::BIGINT + 1) / 4294967297.0)) * cos(2 * pi() * ((('0x' || substr({d}, 9, 8))::BIGINT + 1) / 4294967297.0))"
UNIT = "((('0x' || substr(md5('7|{}|' || asset), 1, 8))::BIGINT + 1) / 4294967297.0)"


@query("reverting_panel", f"""WITH RECURSIVE a AS (SELECT unnest(range(1, 9)) AS asset), d AS (SELECT unnest(range(1, 121)) AS t),
sh AS (SELECT t, asset, (0.6 + 0.8 * {UNIT.format("b")}) * (0.0003 + 0.009 * {NORMAL.format(d="md5('7|m|' || t)")}) + (0.010 + 0.008 * {UNIT.format("s")}) * {NORMAL.format(d="md5('7|i|' || t || '|' || asset)")} AS x FROM d, a),
xs AS (SELECT t, list(x ORDER BY asset) AS x FROM sh GROUP BY t),
st(t, s, m) AS (SELECT 1::BIGINT, list_transform(range(8), lambda i: 100.0::DOUBLE), list_transform(range(8), lambda i: 100.0::DOUBLE) UNION ALL
  SELECT t, s, list_transform(range(1, 9), lambda i: 0.95 * m[i] + 0.05 * s[i]) FROM (SELECT xs.t, st.m AS m, list_transform(range(1, 9), lambda i: st.s[i] * (1 + xs.x[i] - 0.2 * ((st.s[i] - st.m[i]) / st.m[i] - list_avg(list_transform(range(1, 9), lambda k: (st.s[k] - st.m[k]) / st.m[k]))))) AS s FROM st JOIN xs ON xs.t = st.t + 1))
SELECT t::INTEGER AS t, i::INTEGER AS asset, round(s[i], 6) + 0.0 AS close FROM st, (SELECT unnest(range(1, 9)) AS i)""")
def _(spark, sf):
    return src.reverting(spark, 120, 8, 0.2, 7).select("t", "asset", fr.tidy(F.col("close")).alias("close"))


# logs

NOW = "2026-01-02 03:04:05"


@query("decision_lines", """SELECT '{"approved":' || (o_orderstatus = 'F')::VARCHAR || ',"instrument":' || o_orderkey || ',"priority":"' || o_orderpriority || '","timestamp":"2026-01-02T03:04:05.000000+00:00"}' AS value FROM orders""")
def _(spark, sf):
    o = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("instrument"), F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "F").alias("approved"))
    return stores.decision_lines(o, F.to_timestamp(F.lit(NOW)))


@query("decisions_replayed", RECORD.replace(", o_totalprice AS score", ""))
def _(spark, sf):
    o = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("instrument"), (F.col("o_orderstatus") == "F").alias("approved"), F.col("o_orderpriority").alias("priority"))
    at = stores.scratch(spark)
    stores.append_decisions(o, at)
    return stores.replay_decisions(spark, at, o.schema).select("instrument", "approved", "priority")


@query("log_problems", "SELECT (n_nationkey + 1)::BIGINT AS line, CASE WHEN n_nationkey % 7 = 3 THEN 'malformed' WHEN n_nationkey % 7 = 4 THEN 'not an object' END AS problem FROM nation WHERE n_nationkey % 5 <> 0")
def _(spark, sf):
    """A log with blank, broken and odd lines: what is wrong with each that is not blank, by its number in the file."""
    key = F.col("n_nationkey")
    text = F.when(key % 5 == 0, " ").when(key % 7 == 3, '{"a":').when(key % 7 == 4, "[1]").otherwise(F.concat(F.lit('{"a":'), key.cast("string"), F.lit("}")))
    at = stores.scratch(spark)
    src.table(spark, sf, "nation").repartition(1).sortWithinPartitions("n_nationkey").select(text.alias("value")).write.text(at)
    return stores.read_lines(spark, at).select("line", "problem")


# the book

BOOK = f"""{TECH}, n AS (SELECT asset, dt, close, CASE WHEN bull AND NOT bear THEN 1 WHEN bear AND NOT bull THEN -1 ELSE 0 END AS signal, coalesce(close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY dt), 0) - 1, 0) AS ret, row_number() OVER (PARTITION BY asset ORDER BY dt) AS k FROM z),
st(asset, k, held, entry, breached) AS (SELECT asset, 0::BIGINT, 0, NULL::DOUBLE, FALSE FROM n WHERE k = 1 UNION ALL SELECT n.asset, n.k, CASE WHEN n.signal < 0 OR coalesce((entry - close) / entry >= 0.07 - 1e-12, FALSE) THEN 0 WHEN n.signal > 0 AND entry IS NULL THEN 1 ELSE held END,
  CASE WHEN n.signal < 0 OR coalesce((entry - close) / entry >= 0.07 - 1e-12, FALSE) THEN NULL WHEN n.signal > 0 AND entry IS NULL THEN close ELSE entry END, coalesce((entry - close) / entry >= 0.07 - 1e-12, FALSE) FROM st JOIN n ON n.asset = st.asset AND n.k = st.k + 1),
hs AS (SELECT n.dt, n.asset, n.close, n.signal, st.held, st.breached, n.ret FROM st JOIN n ON n.asset = st.asset AND n.k = st.k), an AS (SELECT asset, row_number() OVER (ORDER BY asset) AS i FROM (SELECT DISTINCT asset FROM hs)),
dy AS (SELECT dt, avg(ret) AS mean, greatest(sum(held), 1) AS nh, row_number() OVER (ORDER BY dt) AS k FROM hs GROUP BY dt),
vo AS (SELECT *, CASE WHEN count(*) OVER w = 21 THEN stddev_samp(mean) OVER w * sqrt(52) END AS vol FROM dy WINDOW w AS (ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
sc AS (SELECT *, CASE WHEN vol > 0 THEN least(2.0, 0.1 / vol) ELSE 0 END AS scale, CASE WHEN vol > 0 THEN least(greatest(0.15 * 0.1 / vol, 0.05), 0.15) ELSE 0.15 END AS stop FROM vo),
ar AS (SELECT sc.dt, sc.k, any_value(scale) AS scale, any_value(stop) AS stop, list(coalesce(ret, 0) ORDER BY i) AS r, list(coalesce(held, 0) / nh::DOUBLE ORDER BY i) AS t, list(hs.asset IS NOT NULL ORDER BY i) AS here FROM sc CROSS JOIN an LEFT JOIN hs ON hs.dt = sc.dt AND hs.asset = an.asset GROUP BY 1, 2),
bk(k, equity, peak, fall, need, w) AS (SELECT 0::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, list_transform(t, lambda x: 0.0::DOUBLE), list_transform(t, lambda x: 0.0::DOUBLE) FROM ar WHERE k = 1 UNION ALL
  SELECT k, equity, peak, fall, need, list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i] > 0 AND 2.9 >= need[i] THEN t[i] * scale * (CASE WHEN fall <= -stop THEN 0 ELSE 0.2 + 0.8 * greatest(0, 1 - abs(fall) / stop) END) ELSE 0 END)
  FROM (SELECT *, equity / peak - 1 AS fall FROM (SELECT ar.k, ar.t, ar.scale, ar.stop, bk.equity * (1 + list_dot_product(bk.w, ar.r)) AS equity, greatest(bk.peak, bk.equity * (1 + list_dot_product(bk.w, ar.r))) AS peak,
    list_transform(range(1, len(ar.t) + 1), lambda i: CASE WHEN ar.here[i] THEN 2.9 * abs(ar.t[i] - bk.w[i]) / 1.989 ELSE 0 END) AS need FROM bk JOIN ar ON ar.k = bk.k + 1))),
bl AS (SELECT 'book' AS book, hs.dt, hs.asset, close, signal, held, breached, w[i] AS weight, need[i] AS need, t[i] > 0 AND 2.9 >= need[i] AS approved, equity, fall, scale, fall <= -stop AS stopped_out, floor(1e8 * w[i] / close)::BIGINT AS shares FROM bk JOIN ar USING (k) JOIN hs USING (dt) JOIN an USING (asset))"""


def _book(spark, sf):
    return decisions.sandbox(src.weekly(spark, sf), 5, 20, 10)


@query("sandbox_run", f"WITH RECURSIVE $PW, {BOOK} SELECT book, dt, asset, close, signal, held, breached, round(weight, 6) + 0.0 AS weight, round(need, 6) + 0.0 AS required_edge_bps, approved, round(equity, 6) AS equity, round(fall, 6) + 0.0 AS drawdown, round(scale, 6) + 0.0 AS scale, stopped_out, shares // 1000 AS board_lots, shares % 1000 AS odd_lot_shares FROM bl")
def _(spark, sf):
    b = _book(spark, sf)
    return b.withColumns({c: fr.tidy(F.col(c)) for c in ("weight", "required_edge_bps", "equity", "drawdown", "scale")})


@query("decision_summary", f"WITH RECURSIVE $PW, {BOOK} SELECT count(*) AS written, count(*) AS replayed, count(*) FILTER (approved) AS approved, count(*) FILTER (shares > 0) AS sized, count(*) FILTER (breached) AS stops, count(*) FILTER (stopped_out) AS stopped_out, 0::BIGINT AS unapproved, TRUE AS complete FROM bl")
def _(spark, sf):
    """Counts of a run, and its log written and read back."""
    run = stores.settle(_book(spark, sf))
    at = stores.scratch(spark)
    stores.append_decisions(run, at)
    return decisions.summary(run, stores.replay_decisions(spark, at, run.schema))


@query("held_stream", f"""WITH RECURSIVE $PW, {TECH}, n AS (SELECT asset, dt, close, CASE WHEN bull AND NOT bear THEN 1 WHEN bear AND NOT bull THEN -1 ELSE 0 END AS signal, row_number() OVER (PARTITION BY asset ORDER BY dt) AS k FROM z),
st(asset, k, held, entry) AS (SELECT asset, 0::BIGINT, 0, NULL::DOUBLE FROM n WHERE k = 1 UNION ALL SELECT n.asset, n.k, CASE WHEN n.signal < 0 OR coalesce((entry - close) / entry >= 0.07 - 1e-12, FALSE) THEN 0 WHEN n.signal > 0 AND entry IS NULL THEN 1 ELSE held END,
  CASE WHEN n.signal < 0 OR coalesce((entry - close) / entry >= 0.07 - 1e-12, FALSE) THEN NULL WHEN n.signal > 0 AND entry IS NULL THEN close ELSE entry END FROM st JOIN n ON n.asset = st.asset AND n.k = st.k + 1)
SELECT n.dt, n.asset, st.held, st.entry FROM st JOIN n ON n.asset = st.asset AND n.k = st.k""")
def _(spark, sf):
    """The hold state as a stream with state, over the signals as they arrive."""
    s = sig.technical(src.weekly(spark, sf), 5, 20, 10).select("asset", "dt", "close", F.col("signal").cast("int").alias("signal"))
    return stream.run_held(s).select("dt", "asset", "held", "entry")
