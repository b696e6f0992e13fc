"""The dyadic basis over tables: evaluation, expansion, operators as coordinate rows, and batch denoising."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import basis as b
from tessera.functions import frames as fr


def locate(t: Column, level_j: int) -> tuple[Column, Column]:
    """(cell, local coordinate); null outside [0, 1]; t = 1 belongs to the last cell."""
    n = 1 << level_j
    cell = F.when(t.between(0.0, 1.0), F.least(F.floor(t * n), F.lit(n - 1)).cast("int"))
    return cell, t * (2 * n) - 2 * cell - 1


def evaluate(t: Column, level_j: int, cell: int, degree: int) -> Column:
    """One basis function, 0 outside its cell."""
    at, u = locate(t, level_j)
    return F.when(at == cell, b.scale(level_j) * fr.chebyshev_u(degree, u)).otherwise(0.0)


def basis_at(t: Column, level_j: int, modes: int) -> tuple[Column, Column]:
    """(cell, values of the cell's functions): only these are not 0."""
    cell, u = locate(t, level_j)
    return cell, F.array(*[b.scale(level_j) * fr.chebyshev_u(m, u) for m in range(modes)])


def nodes(spark: SparkSession, order: int) -> DataFrame:
    """(q, x, w) of the second-kind rule."""
    q = spark.range(1, order + 1).select(F.col("id").cast("int").alias("q"))
    a = F.col("q") * (math.pi / (order + 1))
    return q.select("q", F.cos(a).alias("x"), (math.pi / (order + 1) * F.sin(a) * F.sin(a)).alias("w"))


def expand(spark: SparkSession, f: Callable[[Column], Column], level_j: int, modes: int) -> DataFrame:
    """(cell, mode, c) of a function given as an expression of t."""
    t = (F.col("x") + 2 * F.col("cell") + 1) / 2 ** (level_j + 1)
    grid = nodes(spark, modes + 8).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit((1 << level_j) - 1)))).withColumn("y", F.col("w") * f(t))
    u = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), fr.chebyshev_u(m, F.col("x")).alias("u")) for m in range(modes)]))
    return grid.select("cell", "y", u.alias("z")).groupBy("cell", "z.mode").agg((F.sum(F.col("y") * F.col("z.u")) * (b.scale(level_j) / 2 ** (level_j + 1))).alias("c"))


def integration_blocks(spark: SparkSession, level_j: int, modes: int) -> DataFrame:
    """(i, j, own, later): the closed forms over the grid of modes."""
    own, later = b.integration_blocks(level_j, modes)
    rows = [(i, j, float(own[i, j]), float(later[i, j])) for i in range(modes) for j in range(modes)]
    return spark.createDataFrame(rows, "i int, j int, own double, later double")


def integration_coo(spark: SparkSession, level_j: int, modes: int) -> DataFrame:
    """(i, j, v) of the integration operator, rows made by the cluster and never dense."""
    blocks = integration_blocks(spark, level_j, modes).filter("own != 0 or later != 0")
    cells = spark.range(1 << level_j).select(F.col("id").alias("n"), F.explode(F.sequence(F.col("id"), F.lit((1 << level_j) - 1))).alias("k"))
    both = cells.join(F.broadcast(blocks))  # modes * modes rows
    v = F.when(F.col("n") == F.col("k"), F.col("own")).otherwise(F.col("later"))
    return both.select((F.col("n") * modes + F.col("i")).alias("i"), (F.col("k") * modes + F.col("j")).alias("j"), v.alias("v")).filter("v != 0")


def apply_integration(c: DataFrame, level_j: int, modes: int, by: str = "asset") -> DataFrame:
    """P'C in time linear in the cells: a cell's own block, and the later block on the running sum of the cells before. c: (by, cell, c array)."""
    own, later = b.integration_blocks(level_j, modes)
    before = W.partitionBy(by).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(F.col("c")[m]).over(before), F.lit(0.0)) for m in range(modes)]
    out = c.withColumn("_s", F.array(*sums))
    row = [sum((float(own[m, j]) * F.col("c")[m] + float(later[m, j]) * F.col("_s")[m] for m in range(modes)), F.lit(0.0)) for j in range(modes)]
    return out.select(by, "cell", F.array(*row).alias("c"))


def linearization(spark: SparkSession, modes: int) -> DataFrame:
    """(l, j, i) where U_i is part of U_l U_j."""
    side = F.sequence(F.lit(0), F.lit(modes - 1))
    grid = spark.range(modes).select(F.col("id").cast("int").alias("l"), F.explode(side).alias("j")).withColumn("i", F.explode(side))
    return grid.filter("abs(l - j) <= i and i <= l + j and (i + l + j) % 2 = 0")


def product_coo(c: DataFrame, level_j: int, modes: int, by: list[str] | None = None) -> DataFrame:
    """(by..., cell, i, j, v) of multiplication by the functions with coefficients (by..., cell, mode, c)."""
    tensor = F.broadcast(linearization(c.sparkSession, modes))  # at most modes cubed rows
    return c.join(tensor, c.mode == F.col("l")).groupBy(*(by or []), "cell", "i", "j").agg((F.sum("c") * b.scale(level_j)).alias("v"))


def project(panel: DataFrame, level_j: int, modes: int, order: int | None = None, by: str = "asset", at: str = "dt", x: str = "close") -> DataFrame:
    """(asset, cell, c array): batch projection of each series, linearly interpolated at the nodes in each cell, of which
    there are twice as many as observations a cell, at least modes + 8 and at most 512. An asset's nodes and
    observations are merged by one sort: every node gets the observations around it."""
    t = F.unix_date(at).cast("double")
    w = W.partitionBy(by)
    s = panel.filter(F.col(x).isNotNull()).select(by, t.alias("t"), F.col(x).alias("s"))
    s = s.withColumn("tau", fr.ratio(F.col("t") - F.min("t").over(w), F.max("t").over(w) - F.min("t").over(w))).select(by, F.coalesce("tau", F.lit(0.0)).alias("tau"), "s")
    cells = 1 << level_j
    own = s.groupBy(by).agg(F.count("*").alias("n"))
    q = F.lit(order) if order else F.greatest(F.lit(modes + 8), F.least(F.lit(512), F.ceil(2 * F.col("n") / cells))).cast("int")
    grid = own.withColumn("q", q).select(by, "q", F.explode(F.sequence(F.lit(1), F.col("q"))).alias("i"))
    angle = F.col("i") * math.pi / (F.col("q") + 1)
    grid = grid.select(by, F.cos(angle).alias("u"), (math.pi / (F.col("q") + 1) * F.sin(angle) * F.sin(angle)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    grid = grid.withColumn("tau", (F.col("u") + 2 * F.col("cell") + 1) / (2 * cells))
    both = s.withColumns({"cell": F.lit(None).cast("int"), "u": F.lit(None).cast("double"), "g": F.lit(None).cast("double")}).unionByName(grid, allowMissingColumns=True)
    o = W.partitionBy(by).orderBy("tau", F.col("cell").isNotNull())
    back, ahead = o.rowsBetween(W.unboundedPreceding, 0), o.rowsBetween(0, W.unboundedFollowing)
    ok = lambda c: F.when(F.col("s").isNotNull(), F.col(c))
    k = both.withColumns({"s0": F.last("s", True).over(back), "t0": F.last(ok("tau"), True).over(back), "s1": F.first("s", True).over(ahead), "t1": F.first(ok("tau"), True).over(ahead)}).filter("cell is not null")
    y = F.coalesce(F.col("s0") + (F.col("s1") - F.col("s0")) * fr.ratio(F.col("tau") - F.col("t0"), F.col("t1") - F.col("t0")), "s0", "s1")
    k = k.withColumn("y", y * F.col("g"))
    factor = b.scale(level_j) / 2 ** (level_j + 1)
    return k.groupBy(by, "cell").agg(F.array(*[F.sum(F.col("y") * fr.chebyshev_u(m, F.col("u"))) * factor for m in range(modes)]).alias("c"))


def denoise_batch(panel: DataFrame, level_j: int, modes: int, keep_degree: int | None = None, kappa: float = 0.0, rule: str = "soft", by: str = "asset", at: str = "dt", x: str = "close") -> DataFrame:
    """panel with smooth and slope (per day) from the whole series. NOT causal: never feed it to a model.

    Coefficients above keep_degree go; with kappa > 0 those of mode 1 up are shrunk ("soft") or cut ("hard") below kappa * noise * s_m *
    sqrt(2 ln N), where the noise comes from the first differences and s_m, the deviation of a coefficient under unit white noise,
    is the root mean square norm of the projection's rows over equidistant observations instead of a simulated one."""
    keep = modes - 1 if keep_degree is None else min(keep_degree, modes - 1)
    c = project(panel, level_j, modes, None, by, at, x).withColumn("c", F.transform("c", lambda v, m: F.when(m <= keep, v).otherwise(0.0)))
    if kappa > 0:
        from tessera.operators.stats import mad_sigma

        base = 32 << level_j
        rows = (b.projector(base, modes, level_j, "chebyshev") ** 2).sum(1).reshape(-1, modes)
        spread = np.sqrt(rows.mean(0) * base).tolist()  # times 1 / sqrt(observations)
        size = kappa * math.sqrt(2 * math.log(max(2, (1 << level_j) * modes)))
        count = panel.groupBy(by).agg(F.count(x).alias("_n"))
        c = c.join(mad_sigma(panel, x, by, at).join(count, by).select(by, (F.col("sigma") / F.sqrt("_n")).alias("sigma")), by)
        lit = F.array(*[F.lit(size * s) for s in spread])
        shrunk = lambda v, m: F.when(m == 0, v).otherwise(F.signum(v) * F.greatest(F.lit(0.0), F.abs(v) - lit[m] * F.col("sigma")) if rule == "soft" else F.when(F.abs(v) >= lit[m] * F.col("sigma"), v).otherwise(0.0))
        c = c.withColumn("c", F.transform("c", shrunk)).select(by, "cell", "c")
    w = W.partitionBy(by)
    t = F.unix_date(at).cast("double")
    lo, hi = F.min(t).over(w), F.max(t).over(w)
    p = panel.withColumns({"_span": hi - lo, "_tau": F.coalesce(fr.ratio(t - lo, hi - lo), F.lit(0.0))})
    cell, psi = basis_at(F.col("_tau"), level_j, modes)
    d = b.differentiation_block(level_j, modes)
    p = p.withColumns({"_cell": cell, "_psi": psi}).join(c.withColumnRenamed("cell", "_cell"), [by, "_cell"])
    coef = [F.col("c")[m] for m in range(modes)]
    slope = [sum((float(d[m, j]) * coef[m] for m in range(modes)), F.lit(0.0)) for j in range(modes)]
    dot = lambda v: sum((v[m] * F.col("_psi")[m] for m in range(modes)), F.lit(0.0))
    return p.select(*panel.columns, dot(coef).alias("smooth"), (dot(slope) / F.nullif(F.col("_span"), F.lit(0.0))).alias("slope"))


def denoise_diagnostics(denoised: DataFrame, by: str = "asset", x: str = "close") -> DataFrame:
    r = F.col(x) - F.col("smooth")
    return denoised.groupBy(by).agg(F.stddev_samp(r).alias("residual_std"), (10 * F.log10(F.var_samp(x) / F.greatest(F.var_samp(r), F.lit(b.EPS)))).alias("snr_gain_db"), F.count(x).alias("n"))


def block_jump(c: DataFrame, level_j: int, modes: int, by: str = "asset") -> DataFrame:
    """(asset, jump): largest step of the reconstruction at a border between cells."""
    at_end = [b.scale(level_j) * (m + 1) for m in range(modes)]
    end = sum((F.col("c")[m] * at_end[m] for m in range(modes)), F.lit(0.0))
    start = sum((F.col("c")[m] * ((-1) ** m * at_end[m]) for m in range(modes)), F.lit(0.0))
    o = W.partitionBy(by).orderBy("cell")
    return c.withColumn("_j", F.abs(F.lead(start).over(o) - end)).groupBy(by).agg(F.max("_j").alias("jump"))


def solve_odes(spark: SparkSession, problems: DataFrame, level_j: int, modes: int) -> DataFrame:
    """(id, cell, mode, c) of y' + (a + b t) y = f0 + f1 t, y(0) = y0, for rows (id, a, b, f0, f1, y0): one small solve a row, in batches."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                a = r.a if not r.b else (lambda t, r=r: r.a + r.b * t)
                c = b.solve_linear_ode(level_j, modes, a, lambda t, r=r: r.f0 + r.f1 * t, r.y0)
                yield pd.DataFrame({"id": r.id, "cell": np.repeat(np.arange(1 << level_j), modes), "mode": np.tile(np.arange(modes), 1 << level_j), "c": c})

    return problems.select("id", "a", "b", "f0", "f1", "y0").mapInPandas(solve, "id long, cell int, mode int, c double")


def antiderivative(t: Column, level_j: int, cell: int, degree: int) -> Column:
    """The integral from 0 to t of one basis function, exactly."""
    at, u = locate(t, level_j)
    inside = F.when(at == cell, u).when(at > cell, 1.0).otherwise(-1.0)
    before, now = F.lit(1.0), inside
    for _ in range(degree):
        before, now = now, 2 * inside * now - before
    return b.scale(level_j) / 2 ** (level_j + 1) * (now - (-1) ** (degree + 1)) / (degree + 1)


def evaluate_series(c: DataFrame, times: DataFrame, level_j: int, modes: int) -> DataFrame:
    """(id, t, value) of the functions with coefficients (id, cell, mode, c) at each time of (t)."""
    cell, psi = basis_at(F.col("t"), level_j, modes)
    at = times.select("t", cell.alias("cell"), F.posexplode(psi).alias("mode", "psi"))
    return c.join(at, ["cell", "mode"]).groupBy("id", "t").agg(F.sum(F.col("c") * F.col("psi")).alias("value"))


def verify(spark: SparkSession, level_j: int, modes: int) -> DataFrame:
    """(identity, deviation): how far the operators' tables are from what defines them: orthonormal functions under the weight, the integration
    operator against exact antiderivatives for all modes but the last, the product operator's symmetry and its projection."""
    n = 2 * modes + 8
    u = [fr.chebyshev_u(m, F.col("x")) for m in range(modes)]
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col("w") * u[i] * u[j]).alias("v")) for i in range(modes) for j in range(modes)]))
    gram = nodes(spark, n).select(pairs.alias("z")).select("z.*").groupBy("i", "j").agg((F.sum("v") * (b.scale(level_j) ** 2 / 2 ** (level_j + 1))).alias("v"))
    ortho = gram.agg(F.max(F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("deviation")).withColumn("identity", F.lit("orthonormality"))
    # the operator's rows times the basis, against the integrals
    times = spark.range(1001).select(F.least(F.col("id") / F.lit(1000.0), F.lit(1 - b.EPS)).alias("t"))
    cell, psi = basis_at(F.col("t"), level_j, modes)
    at = times.select("t", cell.alias("at"), F.posexplode(psi).alias("mode", "psi")).withColumn("j", F.col("at") * modes + F.col("mode"))
    approx = integration_coo(spark, level_j, modes).join(at, "j").groupBy("i", "t").agg(F.sum(F.col("v") * F.col("psi")).alias("v"))
    exact = F.explode(F.array(*[F.struct(F.lit(c * modes + m).cast("long").alias("i"), antiderivative(F.col("t"), level_j, c, m).alias("exact")) for c in range(1 << level_j) for m in range(modes - 1)]))
    both = times.select("t", exact.alias("z")).select("t", "z.*").join(approx, ["i", "t"], "left")
    integral = both.agg(F.max(F.abs(F.col("exact") - F.coalesce("v", F.lit(0.0)))).alias("deviation")).withColumn("identity", F.lit("integration"))
    # multiplication by sum of c psi, its coefficients running over the flat index
    cells = 1 << level_j
    c = spark.range(cells * modes).select(F.floor(F.col("id") / modes).cast("int").alias("cell"), (F.col("id") % modes).cast("int").alias("mode"), ((F.col("id") + 1) / (cells * modes)).alias("c"))
    h = product_coo(c, level_j, modes)
    turned = h.select("cell", F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    symmetry = h.join(turned, ["cell", "i", "j"], "left").agg(F.max(F.abs(F.col("v") - F.coalesce("w", F.lit(0.0)))).alias("deviation")).withColumn("identity", F.lit("product symmetry"))
    f = c.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("mode", "c"))), lambda z: z["c"]).alias("c"))
    value = sum((F.col("c")[m] * u[m] for m in range(modes)), F.lit(0.0)) * b.scale(level_j)
    inner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col("w") * value * u[i] * u[j]).alias("p")) for i in range(modes) for j in range(modes)]))
    grid = f.withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(n)))).join(nodes(spark, n), "q")
    projected = grid.select("cell", inner.alias("z")).select("cell", "z.*").groupBy("cell", "i", "j").agg((F.sum("p") * (b.scale(level_j) ** 2 / 2 ** (level_j + 1))).alias("p"))
    projection = projected.join(h, ["cell", "i", "j"], "left").agg(F.max(F.abs(F.col("p") - F.coalesce("v", F.lit(0.0)))).alias("deviation")).withColumn("identity", F.lit("product projection"))
    return ortho.unionByName(integral).unionByName(symmetry).unionByName(projection).select("identity", "deviation")
