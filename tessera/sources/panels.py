"""Panels: long (dt, asset, close, ...) tables, from raw trades or files, with validation."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Assets' names in the FX and ETF loaders of the wider ecosystem are free; only these settings deliver total returns.
TOTAL_RETURN = frozenset({"ADJUSTED_LAST"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(x: Column) -> Column:
    """NaN and infinities as null: missing is null everywhere."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("long")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly panel by brand: close is the mean price in whole cents."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = line.join(part, line.l_partkey == part.p_partkey)
    return joined.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("dt"), F.col("p_brand").alias("asset")).agg(F.round(F.sum(cents(F.col("l_extendedprice"))) / F.count("*")).alias("close"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by line number, prices in whole cents."""
    line = table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    trades = line.select(F.to_date("l_shipdate").alias("dt"), F.col("l_linenumber").alias("asset"), cents(F.col("l_extendedprice")).cast("double").alias("price"), F.col("l_quantity").alias("volume"), order.alias("seq"))
    return bars(trades, ["dt", "asset"])


def bars(trades: DataFrame, by: list[str]) -> DataFrame:
    """OHLCV from trades (price, volume, seq): one partial aggregate, no sort."""
    return trades.groupBy(*by).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume")
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly panel by event type, positive values only, in whole cents."""
    events = table(spark, sf_dir, "events").filter("value > 0")
    return events.groupBy(F.date_trunc("hour", "ts").alias("dt"), F.col("event_type").alias("asset")).agg(F.round(F.sum(cents(F.col("value"))) / F.count("*")).alias("close"))


def rates(spark: SparkSession, sf_dir: str, lag_months: int = 1) -> DataFrame:
    """Monthly rates by currency (cur, valid_from, rate), known `lag_months` later."""
    line = table(spark, sf_dir, "lineitem")
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    return line.groupBy(F.col("l_linenumber").alias("cur"), F.add_months(month, lag_months).alias("valid_from")).agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count("*") / 100).alias("rate"))


def read_rates_csv(spark: SparkSession, path: str, lag_months: int = 1, percent: bool = True) -> DataFrame:
    """Long rates from a wide CSV (date, one column a currency); '.' is missing; a month's rate is valid `lag_months` later."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    date, *names = wide.columns
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("cur"), F.expr(f"try_cast(nullif(trim(`{n}`), '.') as double)").alias("x")) for n in names]))
    long = wide.select(F.to_date(F.col(date)).alias("month"), pairs.alias("p"))
    return long.select("p.cur", F.add_months("month", lag_months).alias("valid_from"), (F.col("p.x") / (100 if percent else 1)).alias("rate")).filter("rate is not null")


def read_dated_json(spark: SparkSession, path: str) -> DataFrame:
    """(dt, cur, x) from JSON documents {"rates": {date: {currency: rate}}}; a currency without any value is an error."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", "rates MAP<STRING, MAP<STRING, DOUBLE>>").alias("j"))
    long = parsed.select(F.explode("j.rates").alias("dt", "m")).select(F.to_date("dt").alias("dt"), F.explode("m").alias("cur", "x"))
    return long.withColumn("x", finite(F.col("x")))


def read_chart_json(spark: SparkSession, path: str, price: str = "adjusted", zone: str = "America/New_York") -> DataFrame:
    """(dt, asset, close) from chart documents, one a ticker: timestamps with close and adjusted close arrays."""
    if price not in ("adjusted", "close"):
        raise ValueError("price is adjusted or close")
    schema = "chart STRUCT<result: ARRAY<STRUCT<meta: STRUCT<symbol: STRING>, timestamp: ARRAY<BIGINT>, indicators: STRUCT<quote: ARRAY<STRUCT<close: ARRAY<DOUBLE>>>, adjclose: ARRAY<STRUCT<adjclose: ARRAY<DOUBLE>>>>>>>"
    got = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["chart"]["result"]).alias("r"))
    x = F.col("r.indicators.adjclose")[0]["adjclose"] if price == "adjusted" else F.col("r.indicators.quote")[0]["close"]
    rows = got.select(F.col("r.meta.symbol").alias("asset"), F.explode(F.arrays_zip(F.col("r.timestamp").alias("t"), x.alias("x"))).alias("z"))
    return rows.select(F.to_date(F.from_utc_timestamp(F.timestamp_seconds("z.t"), zone)).alias("dt"), "asset", finite(F.col("z.x")).alias("close"))


def cached(spark: SparkSession, path: str, names: list[str], start=None, build=None, name: str = "asset", at: str = "dt", force: bool = False, offline: bool = False) -> DataFrame:
    """A parquet cache: used if it covers all names (and reaches back to `start`), else rebuilt by `build`; offline, a miss is an error."""
    if not force:
        try:
            have = spark.read.parquet(path)
            reaches = F.lit(True) if start is None else F.coalesce(F.min(at) <= F.lit(start).cast(have.schema[at].dataType), F.lit(False))
            row = have.agg(F.array_except(F.lit(names), F.collect_set(name)).alias("missing"), reaches.alias("reaches")).first()
            if not row["missing"] and row["reaches"]:
                return have
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if offline or build is None:
        raise FileNotFoundError(f"{path} does not cover what is asked for")
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def require_total_return(what_to_show: str, allow_unadjusted: bool = False) -> str:
    """The setting, normalised; one that is not adjusted for dividends is an error unless allowed."""
    kind = what_to_show.strip().upper()
    if kind not in TOTAL_RETURN and not allow_unadjusted:
        raise ValueError(f"{kind} prices leave dividends out")
    return kind


def check_time(panel: DataFrame, by: str = "asset", at: str = "dt") -> DataFrame:
    """(asset, n_duplicates, n_missing_time): times must be unique within an asset."""
    return panel.groupBy(by).agg((F.count(at) - F.count_distinct(at)).alias("n_duplicates"), F.count_if(F.col(at).isNull()).alias("n_missing_time"))


def check_prices(panel: DataFrame, by: str = "asset") -> DataFrame:
    """(asset, n, n_missing, n_nonpositive[, n_crossed, n_half]): prices must be finite and positive, high at least low, both or neither."""
    x = finite(F.col("close"))
    out = [F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_missing"), F.count_if(x <= 0).alias("n_nonpositive")]
    if {"high", "low"} <= set(panel.columns):
        out += [F.count_if(F.col("high") < F.col("low")).alias("n_crossed"), F.count_if(F.col("high").isNull() != F.col("low").isNull()).alias("n_half")]
    return panel.groupBy(by).agg(*out)


def synthetic(spark: SparkSession, assets: list[str], days: int, seed: int) -> DataFrame:
    """Daily bars of a made market: common and own log shocks; opens, highs and lows are drawn once a bar."""
    from pyspark.sql import Window as W

    def normal(*salt: str) -> Column:
        u = [(F.pmod(F.xxhash64(*[F.lit(f"{seed}{s}"), F.col("day"), *([F.col("asset")] if s != "m" else [])]), F.lit(2**40)) + 1) / (2**40 + 1.0) for s in salt]
        return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * 3.141592653589793 * u[1])

    common = F.sqrt(-2 * F.ln((F.pmod(F.xxhash64(F.lit(f"{seed}m"), "day"), F.lit(2**40)) + 1) / (2**40 + 1.0))) * F.cos(2 * 3.141592653589793 * (F.pmod(F.xxhash64(F.lit(f"{seed}n"), "day"), F.lit(2**40)) / float(2**40)))
    days_ = spark.range(days).select(F.col("id").alias("day"), F.explode(F.array(*map(F.lit, assets))).alias("asset"))
    up = W.partitionBy("asset").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    close = 100 * F.exp(F.sum(0.009 * common + 0.011 * normal("a", "b")).over(up))
    walk = days_.withColumn("close", close).withColumn("open", F.col("close") * (1 + 0.003 * normal("c", "d")))
    return walk.select(
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("day").cast("int")).alias("dt"), "asset", "open",
        (F.greatest("open", "close") * (1 + F.abs(0.004 * normal("e", "f")))).alias("high"), (F.least("open", "close") * (1 - F.abs(0.004 * normal("g", "h")))).alias("low"), "close",
    )


def normal(*key: Column | str | int) -> Column:
    """A standard normal number that is the same everywhere: two uniform ones from the md5 of a key, by Box and Muller."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]))
    u = [(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") + 1) / F.lit(2.0**32 + 1) for at in (1, 9)]
    return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * F.pi() * u[1])


def reverting(spark: SparkSession, days: int, assets: int, kappa: float, seed: int = 7) -> DataFrame:
    """(t, asset, close) of a made panel: a market factor, own noise, and a pull of strength kappa towards the own moving average, as far as it differs
    from the others'. The shocks are drawn by the cluster; prices follow from those before, in one ordered pass over a row a day."""
    import numpy as np
    import pandas as pd

    unit = lambda k: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(k), F.col("asset").cast("string"))), 1, 8), 16, 10).cast("long") + 1) / F.lit(2.0**32 + 1)
    grid = spark.range(1, days + 1).select(F.col("id").cast("int").alias("t"), F.explode(F.sequence(F.lit(1), F.lit(assets))).alias("asset"))
    market = 0.0003 + 0.009 * normal(seed, "m", F.col("t"))
    shock = (0.6 + 0.8 * unit("b")) * market + (0.010 + 0.008 * unit("s")) * normal(seed, "i", F.col("t"), F.col("asset"))
    days_ = grid.withColumn("shock", shock).groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset", "shock"))), lambda x: x["shock"]).alias("shocks")).withColumn("panel", F.lit(1))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        price, rows = np.full(assets, 100.0), []
        mean = price.copy()
        for i, x in enumerate(frame["shocks"]):
            if i:
                away = (price - mean) / np.maximum(mean, np.finfo(float).eps)
                price = price * (1 + np.asarray(x) - kappa * (away - away.mean()))
                mean = 0.95 * mean + 0.05 * price
            rows.append(price.tolist())
        return pd.DataFrame({"t": frame["t"].to_numpy(), "closes": rows})

    made = days_.groupBy("panel").applyInPandas(one, "t int, closes array<double>")
    return made.select("t", F.posexplode("closes").alias("i", "close")).select("t", (F.col("i") + 1).alias("asset"), "close")
