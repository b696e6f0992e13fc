"""Sources, projections, filters, alignment, aggregates and sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import frames as fr
from tessera.operators import align, stats
from tessera.plans.registry import Registry
from tessera.sources import panels as src

query = Registry()


def returns(spark, sf):
    return src.weekly(spark, sf).withColumn("ret", fr.simple_return(F.col("close"), fr.ordered()))


def gaps(spark, sf):
    """The weekly panel with every seventh close missing."""
    return src.weekly(spark, sf).withColumn("close", F.when(F.col("close") % 7 != 0, F.col("close")))


GAPS = "g AS (SELECT dt, asset, CASE WHEN close % 7 <> 0 THEN close END AS close FROM p)"


@query("ohlcv_bars", "WITH $PD SELECT dt, asset, open, high, low, close, volume FROM d")
def _(spark, sf):
    return src.daily(spark, sf)


@query("json_map_explode", "SELECT event_id, key, CAST(json_extract_string(props, '$.' || key) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def _(spark, sf):
    m = F.from_json("props", "MAP<STRING, STRING>")
    return src.table(spark, sf, "events").select("event_id", F.explode(m).alias("key", "value"))


@query("rates_lagged", "WITH $RT SELECT cur, valid_from, round(rate, 6) + 0.0 AS rate FROM rt")
def _(spark, sf):
    return src.rates(spark, sf).withColumn("rate", fr.tidy(F.col("rate")))


@query("replay_prefix", "WITH $PD, n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY dt) AS rn FROM d) SELECT dt, asset, close, rn FROM n WHERE rn <= 100")
def _(spark, sf):
    rn = F.row_number().over(fr.ordered()).cast("long")
    return src.daily(spark, sf).select("dt", "asset", "close", rn.alias("rn")).filter("rn <= 100")


@query("select_assets", "WITH $PW SELECT * FROM p WHERE asset IN ('Brand#11', 'Brand#22', 'Brand#33')")
def _(spark, sf):
    return align.select_assets(src.weekly(spark, sf), ["Brand#11", "Brand#22", "Brand#33"])


@query("numeraire_convert", "WITH $PW, u AS (SELECT dt, close AS x FROM p WHERE asset = 'Brand#11') SELECT dt, asset, round(x / close, 6) + 0.0 AS price FROM p JOIN u USING (dt) WHERE asset <> 'Brand#11'")
def _(spark, sf):
    return align.numeraire(src.weekly(spark, sf), "Brand#11").withColumn("price", fr.tidy(F.col("price")))


@query("simple_returns", "WITH $PW, $R SELECT dt, asset, round(ret, 6) + 0.0 AS ret, round(coalesce(ret, 0), 6) + 0.0 AS ret0 FROM r")
def _(spark, sf):
    return returns(spark, sf).select("dt", "asset", fr.tidy(F.col("ret")).alias("ret"), fr.tidy(F.coalesce("ret", F.lit(0.0))).alias("ret0"))


@query("log_returns", "WITH $PW SELECT dt, asset, round(ln(close) - ln(lag(close) OVER (PARTITION BY asset ORDER BY dt)), 6) + 0.0 AS log_ret FROM p")
def _(spark, sf):
    x = F.ln("close")
    return src.weekly(spark, sf).select("dt", "asset", fr.tidy(x - F.lag(x).over(fr.ordered())).alias("log_ret"))


@query("forward_returns", "WITH $PW, $R, $F SELECT dt, asset, round(fwd, 6) + 0.0 AS fwd FROM f")
def _(spark, sf):
    return returns(spark, sf).select("dt", "asset", fr.tidy(F.lead("ret").over(fr.ordered())).alias("fwd"))


@query("direction_label", "WITH $PW, $R, $F SELECT dt, asset, CASE WHEN fwd >= 0 THEN 1 WHEN fwd < 0 THEN -1 END AS label FROM f")
def _(spark, sf):
    f = returns(spark, sf).withColumn("fwd", F.lead("ret").over(fr.ordered()))
    return f.select("dt", "asset", F.when(F.col("fwd") >= 0, 1).when(F.col("fwd") < 0, -1).alias("label"))


@query("tau_normalize", "WITH $PW SELECT dt, asset, round((dt - min(dt) OVER w) / nullif(max(dt) OVER w - min(dt) OVER w, 0), 6) + 0.0 AS tau FROM p WINDOW w AS (PARTITION BY asset)")
def _(spark, sf):
    w = fr.group("asset")
    lo, hi = F.min("dt").over(w), F.max("dt").over(w)
    return src.weekly(spark, sf).select("dt", "asset", fr.tidy(F.datediff("dt", lo) / F.nullif(F.datediff(hi, lo), F.lit(0))).alias("tau"))


@query("date_range", "WITH $PW SELECT * FROM p WHERE dt BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'")
def _(spark, sf):
    return align.date_range(src.weekly(spark, sf), "1994-01-01", "1995-12-31")


@query("common_start", "WITH $PW, s AS (SELECT max(first) AS start FROM (SELECT min(dt) AS first FROM p WHERE close > 0 GROUP BY asset)) SELECT p.* FROM p, s WHERE dt >= start")
def _(spark, sf):
    return align.common_start(src.weekly(spark, sf))


@query("complete_case_dates", f"WITH $PW, {GAPS} SELECT dt FROM g GROUP BY dt HAVING count(DISTINCT CASE WHEN close > 0 THEN asset END) = (SELECT count(DISTINCT asset) FROM g)")
def _(spark, sf):
    return align.complete_dates(gaps(spark, sf))


@query("missing_by_asset", f"WITH $PW, {GAPS} SELECT asset, (SELECT count(DISTINCT dt) FROM g) - count(DISTINCT CASE WHEN close > 0 THEN dt END) AS n_missing FROM g GROUP BY asset")
def _(spark, sf):
    return align.missing_by_asset(gaps(spark, sf))


@query("usable_mask", """WITH $PW, $R, $F, u AS (SELECT dt, asset, ret IS NOT NULL AND fwd IS NOT NULL AS usable FROM f)
SELECT dt, asset, usable, usable AND count(*) FILTER (usable) OVER (PARTITION BY dt) >= 10 AS eligible FROM u""")
def _(spark, sf):
    f = returns(spark, sf).withColumn("fwd", F.lead("ret").over(fr.ordered()))
    return align.usable(f, ["ret"], "fwd", 10).select("dt", "asset", "usable", "eligible")


@query("fill_linear", f"""WITH $PW, {GAPS}, n AS (SELECT *, dt - DATE '1970-01-01' AS t FROM g),
k AS (SELECT *, last_value(close IGNORE NULLS) OVER b AS x0, last_value(CASE WHEN close IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0,
  first_value(close IGNORE NULLS) OVER a AS x1, first_value(CASE WHEN close IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1 FROM n
  WINDOW b AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT dt, asset, round(coalesce(close, x0 + (x1 - x0) * ((t - t0) / nullif(t1 - t0, 0)), x0, x1), 4) + 0.0 AS filled FROM k""")
def _(spark, sf):
    return align.fill_linear(gaps(spark, sf)).select("dt", "asset", fr.tidy(F.col("filled"), 4).alias("filled"))


@query("validate_time", "WITH $PW SELECT asset, count(dt) - count(DISTINCT dt) AS n_duplicates, count(*) FILTER (dt IS NULL) AS n_missing_time FROM p GROUP BY asset")
def _(spark, sf):
    return src.check_time(src.weekly(spark, sf))


@query("validate_prices", "WITH $PD SELECT asset, count(*) AS n, count(*) FILTER (close IS NULL) AS n_missing, count(*) FILTER (close <= 0) AS n_nonpositive, count(*) FILTER (high < low) AS n_crossed, count(*) FILTER ((high IS NULL) <> (low IS NULL)) AS n_half FROM d GROUP BY asset")
def _(spark, sf):
    return src.check_prices(src.daily(spark, sf))


@query("align_outer", "WITH $PW SELECT a.dt, b.asset, p.close FROM (SELECT DISTINCT dt FROM p) a CROSS JOIN (SELECT DISTINCT asset FROM p) b LEFT JOIN p ON p.dt = a.dt AND p.asset = b.asset")
def _(spark, sf):
    return align.align_outer(src.weekly(spark, sf))


@query("align_inner", "WITH $PW SELECT p.* FROM p WHERE dt IN (SELECT dt FROM p WHERE close > 0 GROUP BY dt HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM p))")
def _(spark, sf):
    return align.align_inner(src.weekly(spark, sf))


@query("align_right", """WITH $PW, n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY dt DESC) AS b FROM p), m AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM p GROUP BY asset))
SELECT dt, asset, close, least - b + 1 AS position FROM n, m WHERE b <= least""")
def _(spark, sf):
    return align.align_right(src.weekly(spark, sf))


ASOF = "WITH $PD, $RT, a AS (SELECT d.dt, d.asset, rt.rate, rt.valid_from FROM d ASOF LEFT JOIN rt ON d.asset = rt.cur AND d.dt >= rt.valid_from), e AS (SELECT cur, max(valid_from) AS last FROM rt GROUP BY cur)"


def _with_rates(spark, sf, stale=None):
    bars = src.daily(spark, sf).select("dt", "asset")
    got = align.as_of(bars, src.rates(spark, sf).withColumnRenamed("cur", "asset"), "asset", "dt", "valid_from", "rate", stale)
    return got


@query("asof_rate", ASOF + " SELECT dt, asset, round(rate, 6) + 0.0 AS rate FROM a")
def _(spark, sf):
    return _with_rates(spark, sf).withColumn("rate", fr.tidy(F.col("rate")))


@query("asof_stale", ASOF + " SELECT dt, asset, CASE WHEN dt <= last + INTERVAL 1 MONTH THEN round(rate, 6) + 0.0 END AS rate FROM a JOIN e ON e.cur = a.asset")
def _(spark, sf):
    return _with_rates(spark, sf, 1).withColumn("rate", fr.tidy(F.col("rate")))


@query("rate_differential", "WITH $RT SELECT a.valid_from, a.cur, round(a.rate - b.rate, 6) + 0.0 AS diff FROM rt a JOIN rt b ON a.valid_from = b.valid_from AND b.cur = 1 WHERE a.cur <> 1")
def _(spark, sf):
    return align.differential(src.rates(spark, sf), 1, "cur", "valid_from").withColumn("diff", fr.tidy(F.col("diff")))


@query("position_match", """WITH i AS (SELECT p_partkey AS k, 'I' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE 0 END AS con_id, p_brand AS symbol, p_type AS currency, p_size AS sec_type FROM part),
q AS (SELECT p_partkey AS con_id, p_brand AS symbol, p_type AS currency, p_size AS sec_type, p_size AS quantity FROM part)
SELECT i.name, coalesce(sum(q.quantity), 0)::BIGINT AS quantity FROM i LEFT JOIN q ON CASE WHEN i.con_id <> 0 AND q.con_id <> 0 THEN i.con_id = q.con_id ELSE i.symbol = q.symbol AND i.currency = q.currency AND i.sec_type = q.sec_type END GROUP BY 1""")
def _(spark, sf):
    part = src.table(spark, sf, "part")
    key = [F.col("p_brand").alias("symbol"), F.col("p_type").alias("currency"), F.col("p_size").alias("sec_type")]
    i = part.select(F.concat(F.lit("I"), F.col("p_partkey")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).otherwise(0).alias("con_id"), *key)
    return align.match_positions(i, part.select(F.col("p_partkey").alias("con_id"), *key, F.col("p_size").alias("quantity")))


@query("semi_members", "WITH $PW SELECT * FROM p WHERE asset IN (SELECT p_brand FROM part WHERE p_size > 45)")
def _(spark, sf):
    return src.weekly(spark, sf).join(src.table(spark, sf, "part").filter("p_size > 45").select(F.col("p_brand").alias("asset")).distinct(), "asset", "left_semi")


@query("anti_unknown", "WITH $PW SELECT DISTINCT p_type AS asset FROM part WHERE p_type NOT IN (SELECT asset FROM p)")
def _(spark, sf):
    return align.unknown_names(src.weekly(spark, sf), src.table(spark, sf, "part").select(F.col("p_type").alias("asset")).distinct())


@query("align_dates_inner", "WITH $PW, b AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS dt FROM orders) SELECT p.* FROM p JOIN b USING (dt)")
def _(spark, sf):
    dates = src.table(spark, sf, "orders").select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("dt")).distinct()
    return src.weekly(spark, sf).join(dates, "dt").select("dt", "asset", "close")


@query("feature_concat", "WITH $PW, $R, a AS (SELECT dt, asset, round(ret, 6) + 0.0 AS f1 FROM r), b AS (SELECT dt, asset, round(close / avg(close) OVER (PARTITION BY dt), 6) + 0.0 AS f2 FROM p) SELECT dt, asset, f1, f2 FROM a JOIN b USING (dt, asset)")
def _(spark, sf):
    a = returns(spark, sf).select("dt", "asset", fr.tidy(F.col("ret")).alias("f1"))
    b = src.weekly(spark, sf).select("dt", "asset", fr.tidy(F.col("close") / F.avg("close").over(fr.group())).alias("f2"))
    return a.join(b, ["dt", "asset"])


@query("cs_moments", "WITH $PW SELECT dt, round(avg(close), 4) AS cs_mean, round(stddev_pop(close), 4) AS cs_std_pop, round(stddev_samp(close), 4) AS std_samp, round(var_pop(close) / 1e6, 4) AS var_pop, round(var_samp(close) / 1e6, 4) AS var_samp, count(*) AS n, min(close) AS lo, max(close) AS hi FROM p GROUP BY dt")
def _(spark, sf):
    x = F.col("close")
    return src.weekly(spark, sf).groupBy("dt").agg(
        F.round(F.avg(x), 4).alias("cs_mean"), F.round(F.stddev_pop(x), 4).alias("cs_std_pop"), F.round(F.stddev_samp(x), 4).alias("std_samp"), F.round(F.var_pop(x) / 1e6, 4).alias("var_pop"),
        F.round(F.var_samp(x) / 1e6, 4).alias("var_samp"), F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
    )


@query("median_mad", "WITH $PW, m AS (SELECT asset, median(close) AS med FROM p GROUP BY asset) SELECT asset, med, median(abs(close - med)) AS mad FROM p JOIN m USING (asset) GROUP BY asset, med")
def _(spark, sf):
    return stats.median_mad(src.weekly(spark, sf), "close", "asset")


@query("mad_sigma", "WITH $PW, x AS (SELECT asset, close - lag(close) OVER (PARTITION BY asset ORDER BY dt) AS d FROM p), m AS (SELECT asset, median(d) AS med FROM x GROUP BY asset) SELECT asset, round(1.4826 * median(abs(d - med)) / sqrt(2), 4) AS sigma FROM x JOIN m USING (asset) GROUP BY asset")
def _(spark, sf):
    return stats.mad_sigma(src.weekly(spark, sf)).withColumn("sigma", F.round("sigma", 4))


@query("expanding_median", "WITH $PW SELECT dt, asset, quantile_cont(close, 0.5) OVER (PARTITION BY asset ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS med FROM p")
def _(spark, sf):
    return stats.expanding_median(src.weekly(spark, sf), "close", "med").select("dt", "asset", "med")


@query("percentile_interval", "WITH $PW, $R SELECT asset, round(quantile_cont(ret, 0.05), 6) + 0.0 AS p05, round(quantile_cont(ret, 0.95), 6) + 0.0 AS p95 FROM r GROUP BY asset")
def _(spark, sf):
    return returns(spark, sf).groupBy("asset").agg(fr.tidy(F.percentile("ret", 0.05)).alias("p05"), fr.tidy(F.percentile("ret", 0.95)).alias("p95"))


@query("inception", "WITH $PD SELECT asset, min(dt) AS first_dt, max(dt) AS last_dt, arg_min(close, dt) AS first_close, arg_max(close, dt) AS last_close FROM d WHERE close > 0 GROUP BY asset")
def _(spark, sf):
    return src.daily(spark, sf).filter("close > 0").groupBy("asset").agg(F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.min_by("close", "dt").alias("first_close"), F.max_by("close", "dt").alias("last_close"))


PERF = """x AS (SELECT asset, dt, ret, product(1 + ret) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS eq FROM r WHERE ret IS NOT NULL),
y AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS peak1, max(eq) OVER (PARTITION BY asset ORDER BY dt ROWS UNBOUNDED PRECEDING) AS peak FROM x)"""


@query("perf_metrics", f"WITH $PW, $R, {PERF} SELECT asset, count(*) AS observations, round(product(1 + ret) - 1, 6) + 0.0 AS total_return, round(pow(product(1 + ret), 52.0 / count(*)) - 1, 6) + 0.0 AS annual_return, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52), 6) + 0.0 AS sharpe, round(min(eq / peak1 - 1), 6) + 0.0 AS max_drawdown FROM y GROUP BY asset")
def _(spark, sf):
    return stats.performance(returns(spark, sf), ["asset"], periods=52)


@query("maxdd_backtest", f"WITH $PW, $R, {PERF} SELECT asset, round(max(1 - eq / peak), 6) + 0.0 AS max_drawdown FROM y GROUP BY asset")
def _(spark, sf):
    return stats.drawdown(returns(spark, sf), ["asset"], convention="backtest")


@query("equity_curve", f"WITH $PW, $R, {PERF} SELECT asset, dt, round(eq, 6) + 0.0 AS equity, round(peak, 6) + 0.0 AS peak FROM y")
def _(spark, sf):
    return stats.equity(returns(spark, sf), ["asset"]).select("asset", "dt", fr.tidy(F.col("equity")).alias("equity"), fr.tidy(F.col("peak")).alias("peak"))


RANKED = """k AS (SELECT dt, asset, ret, fwd FROM f WHERE ret IS NOT NULL AND fwd IS NOT NULL),
q AS (SELECT dt, asset, rank() OVER (PARTITION BY dt ORDER BY ret) + (count(*) OVER (PARTITION BY dt, ret) - 1) / 2 AS a, rank() OVER (PARTITION BY dt ORDER BY fwd) + (count(*) OVER (PARTITION BY dt, fwd) - 1) / 2 AS b FROM k)"""


@query("rank_ic", f"WITH $PW, $R, $F, {RANKED} SELECT dt, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) + 0.0 AS ic, count(*) AS n FROM q GROUP BY dt")
def _(spark, sf):
    return stats.rank_ic(_pairs(spark, sf), "ret", "fwd").withColumn("ic", fr.tidy(F.col("ic")))


def _pairs(spark, sf):
    return returns(spark, sf).withColumn("fwd", F.lead("ret").over(fr.ordered())).filter("ret is not null and fwd is not null")


@query("mean_offdiag_corr", """WITH $PW, l AS (SELECT dt, asset, ln(close) - ln(lag(close) OVER (PARTITION BY asset ORDER BY dt)) AS x FROM p), z AS (SELECT * FROM l WHERE x IS NOT NULL),
c AS (SELECT a.asset AS i, b.asset AS j, covar_pop(a.x, b.x) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0) AS c FROM z a JOIN z b ON a.dt = b.dt AND a.asset < b.asset GROUP BY 1, 2) SELECT round(avg(c), 6) + 0.0 AS mean_corr, count(c) AS pairs FROM c""")
def _(spark, sf):
    x = F.ln("close")
    z = src.weekly(spark, sf).select("dt", "asset", (x - F.lag(x).over(fr.ordered())).alias("x")).filter("x is not null")
    return stats.pair_correlations(z, "x").agg(fr.tidy(F.avg("corr")).alias("mean_corr"), F.count("corr").alias("pairs"))


@query("accuracy_hitrate", f"WITH $PW, $R, $F, {RANKED} SELECT asset, round(avg(CASE WHEN (ret >= 0) = (fwd >= 0) THEN 1.0 ELSE 0 END), 6) + 0.0 AS accuracy, round(sum(CASE WHEN (ret >= 0) = (fwd >= 0) THEN abs(fwd) ELSE 0 END) / nullif(sum(abs(fwd)), 0), 6) + 0.0 AS weighted FROM k GROUP BY asset")
def _(spark, sf):
    return stats.hit_rates(_pairs(spark, sf), F.col("ret") >= 0, F.col("fwd"), ["asset"])


@query("gram_matrix", "WITH $PW, $R, $F SELECT round(sum(ret * ret), 6) AS xx, round(sum(ret * fwd), 6) + 0.0 AS xy, round(sum(fwd * fwd), 6) AS yy, round(sum(ret), 6) + 0.0 AS sx, round(sum(fwd), 6) + 0.0 AS sy, count(*) AS n FROM f WHERE ret IS NOT NULL AND fwd IS NOT NULL")
def _(spark, sf):
    x, y = F.col("ret"), F.col("fwd")
    return _pairs(spark, sf).agg(F.round(F.sum(x * x), 6).alias("xx"), fr.tidy(F.sum(x * y)).alias("xy"), F.round(F.sum(y * y), 6).alias("yy"), fr.tidy(F.sum(x)).alias("sx"), fr.tidy(F.sum(y)).alias("sy"), F.count("*").alias("n"))


@query("distinct_assets", "WITH $PW SELECT DISTINCT asset FROM p")
def _(spark, sf):
    return src.weekly(spark, sf).select("asset").distinct()


@query("null_pvalue", "WITH $PW, $R, m AS (SELECT asset, avg(ret) AS a FROM r GROUP BY asset), o AS (SELECT avg(a) AS obs FROM m) SELECT round((1 + count(*) FILTER (a >= obs)) / (1.0 + count(*)), 6) AS p FROM m, o")
def _(spark, sf):
    means = returns(spark, sf).groupBy("asset").agg(F.avg("ret").alias("a"))
    return stats.p_value(means, "a", means.agg(F.avg("a").alias("obs"))).select(F.round("p", 6).alias("p"))


@query("weighted_inner_product", "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * embedding[65 - i]::DOUBLE * sqrt(greatest(0, 1 - pow((2 * i - 65) / 64.0, 2))))), 5) + 0.0 AS wip FROM embeddings")
def _(spark, sf):
    v = F.col("embedding").cast("array<double>")
    weights = F.array(*[F.lit(max(0.0, 1 - ((2 * i - 65) / 64) ** 2) ** 0.5) for i in range(1, 65)])
    return src.table(spark, sf, "embeddings").select("vec_id", fr.tidy(stats.inner_product(v, F.reverse(v), weights), 5).alias("wip"))


@query("latest_bar", "WITH $PD SELECT asset, max(dt) AS dt, arg_max(close, dt) AS close FROM d GROUP BY asset")
def _(spark, sf):
    return src.daily(spark, sf).groupBy("asset").agg(F.max("dt").alias("dt"), F.max_by("close", "dt").alias("close"))


@query("active_span", "WITH $PW, n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY dt) AS rn FROM p) SELECT asset, min(rn) FILTER (close > 4000000) AS first_rn, max(rn) FILTER (close > 4000000) AS last_rn FROM n GROUP BY asset")
def _(spark, sf):
    n = src.weekly(spark, sf).withColumn("rn", F.row_number().over(fr.ordered()).cast("long"))
    return n.groupBy("asset").agg(F.min(F.when(F.col("close") > 4e6, F.col("rn"))).alias("first_rn"), F.max(F.when(F.col("close") > 4e6, F.col("rn"))).alias("last_rn"))


def _sets(spark, sf):
    ship = src.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("dt"))
    return ship, src.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("dt"))


for _name, _op, _sql in (("union", lambda a, b: a.union(b).distinct(), "UNION"), ("intersect", lambda a, b: a.intersect(b), "INTERSECT"), ("except", lambda a, b: a.subtract(b), "EXCEPT")):
    query(f"set_{_name}_dates", f"SELECT CAST(l_shipdate AS DATE) AS dt FROM lineitem {_sql} SELECT CAST(o_orderdate AS DATE) AS dt FROM orders")(lambda spark, sf, op=_op: op(*_sets(spark, sf)))


@query("pooled_offsets", "WITH $PW, c AS (SELECT dt, count(*) AS n FROM p GROUP BY dt) SELECT dt, n, (sum(n) OVER (ORDER BY dt) - n)::BIGINT AS first_row FROM c")
def _(spark, sf):
    return stats.offsets(src.weekly(spark, sf).groupBy("dt").agg(F.count("*").alias("n")))


@query("leak_test", "SELECT 0::BIGINT AS changed")
def _(spark, sf):
    from tessera.operators import signals

    return stats.leak_test(src.weekly(spark, sf), lambda p: signals.technical(p, 5, 20, 10), "1995-06-01")


for _name, _spark, _sql in (("cs_mean", F.avg, "avg(close)"), ("cs_std_pop", F.stddev_pop, "stddev_pop(close)"), ("std_samp", F.stddev_samp, "stddev_samp(close)")):
    query(_name, f"WITH $PW SELECT dt, round({_sql}, 4) AS {_name} FROM p GROUP BY dt")(lambda spark, sf, f=_spark, name=_name: src.weekly(spark, sf).groupBy("dt").agg(F.round(f("close"), 4).alias(name)))


@query("var_both", "WITH $PW, $R SELECT asset, round(var_pop(ret), 6) AS var_pop, round(var_samp(ret), 6) AS var_samp FROM r GROUP BY asset")
def _(spark, sf):
    return returns(spark, sf).groupBy("asset").agg(F.round(F.var_pop("ret"), 6).alias("var_pop"), F.round(F.var_samp("ret"), 6).alias("var_samp"))


@query("total_return", "WITH $PW, $R SELECT asset, round(product(1 + ret) - 1, 6) + 0.0 AS total_return FROM r WHERE ret IS NOT NULL GROUP BY asset")
def _(spark, sf):
    return stats.performance(returns(spark, sf), ["asset"], periods=52).select("asset", "total_return")


@query("sharpe", "WITH $PW, $R SELECT asset, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52), 6) + 0.0 AS sharpe FROM r GROUP BY asset")
def _(spark, sf):
    return returns(spark, sf).groupBy("asset").agg(fr.tidy(fr.sharpe(F.col("ret"), 52)).alias("sharpe"))


@query("maxdd_report", f"WITH $PW, $R, {PERF} SELECT asset, round(min(eq / peak1 - 1), 6) + 0.0 AS max_drawdown FROM y GROUP BY asset")
def _(spark, sf):
    return stats.drawdown(returns(spark, sf), ["asset"])


@query("interp_linear", """WITH $PD, o AS (SELECT a.dt, b.asset, d.close FROM (SELECT DISTINCT dt FROM d) a CROSS JOIN (SELECT DISTINCT asset FROM d) b LEFT JOIN d ON d.dt = a.dt AND d.asset = b.asset), n AS (SELECT *, dt - DATE '1970-01-01' AS t FROM o),
k AS (SELECT *, last_value(close IGNORE NULLS) OVER b AS x0, last_value(CASE WHEN close IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0,
  first_value(close IGNORE NULLS) OVER a AS x1, first_value(CASE WHEN close IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1 FROM n
  WINDOW b AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT dt, asset, round(coalesce(close, x0 + (x1 - x0) * ((t - t0) / nullif(t1 - t0, 0)), x0, x1), 4) + 0.0 AS filled FROM k""")
def _(spark, sf):
    return align.fill_linear(align.align_outer(src.daily(spark, sf))).select("dt", "asset", fr.tidy(F.col("filled"), 4).alias("filled"))
