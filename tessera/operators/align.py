"""Selection, alignment, as-of matching and filling of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import frames as fr
from tessera.sources.panels import finite


def select_assets(panel: DataFrame, names: list, by: str = "asset") -> DataFrame:
    """Rows of the named assets; unknown_names() tells which ones the panel lacks."""
    return panel.filter(F.col(by).isin(names))


def unknown_names(panel: DataFrame, names: DataFrame, by: str = "asset") -> DataFrame:
    return names.join(panel.select(by).distinct(), by, "left_anti")


def numeraire(panel: DataFrame, unit, base=None, by: str = "asset", at: str = "dt", x: str = "close") -> DataFrame:
    """Prices in another unit: unit's price per base over the asset's; the base is worth 1, the unit itself goes."""
    own = panel.filter(F.col(by) == unit).select(at, F.col(x).alias("unit_x")) if unit != base else panel.select(at).distinct().withColumn("unit_x", F.lit(1.0))
    return panel.filter(F.col(by) != unit).join(own, at).select(at, by, fr.ratio(F.col("unit_x"), F.col(x)).alias("price"))


def date_range(panel: DataFrame, start: str | None = None, end: str | None = None, at: str = "dt") -> DataFrame:
    if start is not None:
        panel = panel.filter(F.col(at) >= F.lit(start).cast("date"))
    return panel if end is None else panel.filter(F.col(at) <= F.lit(end).cast("date"))


def valid(x: str = "close") -> Column:
    return fr.flag(finite(F.col(x)) > 0)


def common_start(panel: DataFrame, by: str = "asset", at: str = "dt") -> DataFrame:
    """Rows from the latest first valid date of any asset on."""
    first = panel.filter(valid()).groupBy(by).agg(F.min(at).alias("first")).agg(F.max("first").alias("start"))
    return panel.join(F.broadcast(first), F.col(at) >= F.col("start")).drop("start")


def complete_dates(panel: DataFrame, n_assets: int | None = None, by: str = "asset", at: str = "dt") -> DataFrame:
    """(dt) on which all assets are valid."""
    counted = panel.groupBy(at).agg(F.count_distinct(F.when(valid(), F.col(by))).alias("n"))
    if n_assets is not None:
        return counted.filter(F.col("n") == n_assets).select(at)
    total = panel.agg(F.count_distinct(by).alias("all"))
    return counted.join(F.broadcast(total), F.col("n") == F.col("all")).select(at)


def complete_cases(panel: DataFrame, by: str = "asset", at: str = "dt") -> DataFrame:
    return panel.join(complete_dates(panel, None, by, at), at, "left_semi")


def missing_by_asset(panel: DataFrame, by: str = "asset", at: str = "dt") -> DataFrame:
    """(asset, n_missing) over the union of all dates."""
    dates = panel.agg(F.count_distinct(at).alias("dates"))
    return panel.groupBy(by).agg(F.count_distinct(F.when(valid(), F.col(at))).alias("ok")).join(F.broadcast(dates)).select(by, (F.col("dates") - F.col("ok")).alias("n_missing"))


def align_outer(panel: DataFrame, by: str = "asset", at: str = "dt", x: str = "close") -> DataFrame:
    """All assets on the union of dates; absent rows become null. The grid is dates times the few asset names."""
    names = panel.select(by).distinct().agg(F.array_sort(F.collect_set(by)).alias("names"))
    grid = panel.select(at).distinct().join(F.broadcast(names)).select(at, F.explode("names").alias(by))
    return grid.join(panel.select(at, by, x), [at, by], "left")


def align_inner(panel: DataFrame, by: str = "asset", at: str = "dt") -> DataFrame:
    """Rows on the dates that all assets share: the intersection, never filled forward."""
    return complete_cases(panel, by, at)


def align_right(panel: DataFrame, by: str = "asset", at: str = "dt") -> DataFrame:
    """The last rows of each asset, as many as the shortest has, numbered 1.. (position) in time order."""
    down = W.partitionBy(by).orderBy(F.desc(at))
    least = panel.groupBy(by).agg(F.count("*").alias("n")).agg(F.min("n").alias("n_least"))
    return panel.withColumn("_back", F.row_number().over(down)).join(F.broadcast(least), F.col("_back") <= F.col("n_least")).withColumn("position", (F.col("n_least") - F.col("_back") + 1).cast("long")).drop("_back", "n_least")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, valid_from: str, value: str, stale_months: int | None = None) -> DataFrame:
    """left with the latest value whose valid_from is not after its time. One shuffle on `by` and one sort: rows of both sides are
    unioned and the last value is carried down. Beyond `stale_months` after the last known valid_from it is null."""
    l = left.withColumns({"_at": F.col(at).cast("timestamp"), "_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType), "_f": F.lit(None).cast("timestamp")})
    r = right.select(F.col(by), F.col(valid_from).cast("timestamp").alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.col(valid_from).cast("timestamp").alias("_f"))
    both = l.unionByName(r, allowMissingColumns=True)
    upto = W.partitionBy(by).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    got = both.withColumns({value: F.last("_v", ignorenulls=True).over(upto), "_last": F.max("_f").over(W.partitionBy(by))})
    if stale_months is not None:
        got = got.withColumn(value, F.when(F.col("_at") <= F.col("_last") + F.make_ym_interval(F.lit(0), F.lit(stale_months)), F.col(value)))
    return got.filter("_side = 1").select(*left.columns, value)


def match_positions(instruments: DataFrame, positions: DataFrame) -> DataFrame:
    """(name, quantity): positions summed by contract id where both sides have one, else by symbol, currency and kind; default 0.
    The disjunction is two equi-joins over disjoint pairs."""
    i, p = instruments.alias("i"), positions.alias("p")
    has = lambda x: F.coalesce(F.col(f"{x}.con_id"), F.lit(0)) != 0
    by_id = i.join(p, (F.col("i.con_id") == F.col("p.con_id")) & has("i") & has("p")).select("i.name", "p.quantity")
    same = [F.col(f"i.{c}") == F.col(f"p.{c}") for c in ("symbol", "currency", "sec_type")]
    by_key = i.join(p, same[0] & same[1] & same[2] & ~(has("i") & has("p"))).select("i.name", "p.quantity")
    total = by_id.unionByName(by_key).groupBy("name").agg(F.sum("quantity").alias("quantity"))
    return instruments.select("name").join(total, "name", "left").select("name", F.coalesce("quantity", F.lit(0)).alias("quantity"))


def fill_linear(panel: DataFrame, by: str = "asset", at: str = "dt", x: str = "close") -> DataFrame:
    """Missing values linearly in time between their neighbours, the nearest one at the ends."""
    t = F.datediff(F.col(at), F.lit("1970-01-01").cast("date")).cast("double")
    own = fr.ordered(by, at)
    back, ahead = own.rowsBetween(W.unboundedPreceding, 0), own.rowsBetween(0, W.unboundedFollowing)
    at_ok = F.when(F.col(x).isNotNull(), t)
    x0, t0 = F.last(x, ignorenulls=True).over(back), F.last(at_ok, ignorenulls=True).over(back)
    x1, t1 = F.first(x, ignorenulls=True).over(ahead), F.first(at_ok, ignorenulls=True).over(ahead)
    between = x0 + (x1 - x0) * fr.ratio(t - t0, t1 - t0)
    return panel.withColumn("filled", F.coalesce(F.col(x), between, x0, x1))


def usable(features: DataFrame, columns: list[str], target: str, min_assets: int, at: str = "dt") -> DataFrame:
    """usable: all features and the target present; eligible: at least `min_assets` such rows on the date."""
    ok = F.col(target).isNotNull()
    for c in columns:
        ok &= F.col(c).isNotNull()
    n = F.sum(F.col("usable").cast("int")).over(fr.group(at))
    return features.withColumn("usable", ok).withColumn("eligible", F.col("usable") & (n >= min_assets))


def differential(rates: DataFrame, unit, by: str = "asset", at: str = "dt", x: str = "rate") -> DataFrame:
    """rate minus the unit's rate on the same date."""
    own = rates.filter(F.col(by) == unit).select(at, F.col(x).alias("unit_rate"))
    return rates.filter(F.col(by) != unit).join(own, at).select(at, by, (F.col(x) - F.col("unit_rate")).alias("diff"))


def numbered(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Rows numbered from 1 in order. Partitions hold runs of the order; a row's number is its place in its partition and the count of the rows of those
    before, of which there is one number a partition."""
    from tessera.sources.stores import settle

    run = settle(df.repartitionByRange(*order).withColumn("_run", F.spark_partition_id()))
    before = run.groupBy("_run").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_run")) - F.col("_n")).drop("_n")
    place = F.row_number().over(W.partitionBy("_run").orderBy(*order))
    return run.join(before, "_run").withColumn(name, (F.col("_before") + place).cast("long")).select(*df.columns, name)
