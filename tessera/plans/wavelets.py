"""Basis, operators and batch denoising."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import basis as b
from tessera.functions import frames as fr
from tessera.operators import wavelets as wav
from tessera.plans.registry import Registry
from tessera.sources import panels as src

query = Registry()

T = "e AS (SELECT event_id, (event_id % 1001) / 1000.0::DOUBLE AS t FROM events), l AS (SELECT event_id, t, least(floor(t * 8), 7)::INTEGER AS cell FROM e), u AS (SELECT event_id, t, cell, t * 16 - 2 * cell - 1 AS u FROM l)"
A = repr(b.scale(3))
U = ["1.0::DOUBLE", "2 * u", "4 * u * u - 1", "8 * u * u * u - 4 * u"]


def _times(spark, sf):
    return src.table(spark, sf, "events").select("event_id", ((F.col("event_id") % 1001) / F.lit(1000.0)).alias("t"))


@query("chebyshev_u", f"WITH {T} SELECT event_id, round({U[2]}, 6) + 0.0 AS u2, round({U[3]}, 6) + 0.0 AS u3 FROM u")
def _(spark, sf):
    _, u = wav.locate(F.col("t"), 3)
    return _times(spark, sf).select("event_id", fr.tidy(fr.chebyshev_u(2, u)).alias("u2"), fr.tidy(fr.chebyshev_u(3, u)).alias("u3"))


@query("cell_locate", f"WITH {T} SELECT event_id, cell, round(u, 6) + 0.0 AS u FROM u")
def _(spark, sf):
    cell, u = wav.locate(F.col("t"), 3)
    return _times(spark, sf).select("event_id", cell.alias("cell"), fr.tidy(u).alias("u"))


@query("wavelet_eval", f"WITH {T} SELECT event_id, CASE WHEN cell = 2 THEN round({A} * ({U[2]}), 6) + 0.0 ELSE 0 END::DOUBLE AS psi FROM u")
def _(spark, sf):
    return _times(spark, sf).select("event_id", fr.tidy(wav.evaluate(F.col("t"), 3, 2, 2)).alias("psi"))


@query("basis_eval", f"WITH {T} SELECT event_id, cell, " + ", ".join(f"round({A} * ({x}), 5) + 0.0 AS p{m}" for m, x in enumerate(U)) + " FROM u")
def _(spark, sf):
    cell, psi = wav.basis_at(F.col("t"), 3, 4)
    return _times(spark, sf).select("event_id", cell.alias("cell"), psi.alias("p")).select("event_id", "cell", *[fr.tidy(F.col("p")[m], 5).alias(f"p{m}") for m in range(4)])


@query("cell_weight", f"WITH {T} SELECT event_id, round(sqrt(greatest(0, 1 - u * u)), 6) AS w FROM u")
def _(spark, sf):
    _, u = wav.locate(F.col("t"), 3)
    return _times(spark, sf).select("event_id", F.round(F.sqrt(F.greatest(F.lit(0.0), 1 - u * u)), 6).alias("w"))


NODES = "n AS (SELECT q, cos(q * pi() / 13) AS x, pi() / 13 * sin(q * pi() / 13) * sin(q * pi() / 13) AS w FROM (SELECT unnest(range(1, 13))::INTEGER AS q))"


@query("quadrature_nodes", f"WITH {NODES} SELECT q, round(x, 9) + 0.0 AS x, round(w, 9) AS w FROM n")
def _(spark, sf):
    return wav.nodes(spark, 12).select("q", fr.tidy(F.col("x"), 9).alias("x"), F.round("w", 9).alias("w"))


@query("expand_function", f"""WITH {NODES}, g AS (SELECT cell, x, w * exp((x + 2 * cell + 1) / 8) * sin(4 * (x + 2 * cell + 1) / 8) AS y FROM n, (SELECT unnest(range(4))::INTEGER AS cell)),
m AS (SELECT cell, unnest([0, 1, 2, 3])::INTEGER AS mode, unnest([y, y * 2 * x, y * (4 * x * x - 1), y * (8 * x * x * x - 4 * x)]) AS v FROM g) SELECT cell, mode, round(sum(v) * {b.scale(2) / 8!r}, 9) + 0.0 AS c FROM m GROUP BY 1, 2""")
def _(spark, sf):
    return wav.expand(spark, lambda t: F.exp(t) * F.sin(4 * t), 2, 4).select("cell", "mode", fr.tidy(F.col("c"), 9).alias("c"))


BLOCKS = """m AS (SELECT unnest(range(4))::INTEGER AS i), bl AS (SELECT a.i, c.i AS j,
  (CASE WHEN c.i = 0 THEN pow(-1, a.i) / (8 * (a.i + 1)) ELSE 0 END + CASE WHEN a.i >= 1 AND c.i = a.i - 1 THEN -1 / (16.0 * (a.i + 1)) WHEN c.i = a.i + 1 THEN 1 / (16.0 * (a.i + 1)) ELSE 0 END)::DOUBLE AS own,
  (CASE WHEN c.i = 0 AND a.i % 2 = 0 THEN 1 / (4.0 * (a.i + 1)) ELSE 0 END)::DOUBLE AS later FROM m a, m c)"""


@query("omi_blocks", f"WITH {BLOCKS} SELECT i, j, round(own, 12) + 0.0 AS own, round(later, 12) AS later FROM bl")
def _(spark, sf):
    return wav.integration_blocks(spark, 2, 4).select("i", "j", fr.tidy(F.col("own"), 12).alias("own"), F.round("later", 12).alias("later"))


@query("omi_coo", f"WITH {BLOCKS}, c AS (SELECT a.n, b.n AS k FROM (SELECT unnest(range(4)) AS n) a JOIN (SELECT unnest(range(4)) AS n) b ON a.n <= b.n) SELECT n * 4 + i AS i, k * 4 + j AS j, round(v, 12) + 0.0 AS v FROM (SELECT n, k, i, j, CASE WHEN n = k THEN own ELSE later END AS v FROM c, bl) WHERE v <> 0")
def _(spark, sf):
    return wav.integration_coo(spark, 2, 4).withColumn("v", fr.tidy(F.col("v"), 12))


TENSOR = "m3 AS (SELECT unnest(range(4))::INTEGER AS i), t3 AS (SELECT a.i AS l, b.i AS j, c.i AS i FROM m3 a, m3 b, m3 c WHERE abs(a.i - b.i) <= c.i AND c.i <= a.i + b.i AND (a.i + b.i + c.i) % 2 = 0)"


@query("lambda_tensor", f"WITH {TENSOR} SELECT l, j, i FROM t3")
def _(spark, sf):
    return wav.linearization(spark, 4)


COEFFICIENTS = "c AS (SELECT vec_id, (i // 4)::INTEGER AS cell, (i % 4)::INTEGER AS mode, embedding[i + 1]::DOUBLE AS c FROM embeddings, (SELECT unnest(range(64)) AS i))"


def _coefficients(spark, sf):
    """Each vector's 64 components as those of a function: 16 cells of 4 modes."""
    e = src.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "c"))
    return e.select("vec_id", F.floor(F.col("i") / 4).cast("int").alias("cell"), (F.col("i") % 4).alias("mode"), F.col("c").cast("double").alias("c"))


@query("pom_coo", f"WITH {TENSOR}, {COEFFICIENTS} SELECT vec_id, cell, i, j, round(sum(c) * {b.scale(4)!r}, 6) + 0.0 AS v FROM c JOIN t3 ON mode = l GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return wav.product_coo(_coefficients(spark, sf), 4, 4, ["vec_id"]).withColumn("v", fr.tidy(F.col("v")))


@query("diff_matrix", "SELECT m, j, (8.0 * 2 * (j + 1))::DOUBLE AS v FROM (SELECT unnest(range(6))::INTEGER AS m) a, (SELECT unnest(range(6))::INTEGER AS j) b WHERE j < m AND (m - j) % 2 = 1")
def _(spark, sf):
    d = b.differentiation_block(2, 6)
    return spark.createDataFrame([(m, j, float(d[m, j])) for m in range(6) for j in range(6) if d[m, j]], "m int, j int, v double")


BLOCKS16 = BLOCKS.replace("(8 * (a.i + 1))", "(32 * (a.i + 1))").replace("16.0 * (a.i + 1)", "64.0 * (a.i + 1)").replace("4.0 * (a.i + 1)), ", "16.0 * (a.i + 1)), ").replace("1 / (4.0 * (a.i + 1))", "1 / (16.0 * (a.i + 1))")


@query("omi_apply", f"""WITH {BLOCKS16}, {COEFFICIENTS},
x AS (SELECT c.vec_id, k.cell, bl.j AS mode, c.c * CASE WHEN c.cell = k.cell THEN own ELSE later END AS v FROM c JOIN (SELECT unnest(range(16))::INTEGER AS cell) k ON c.cell <= k.cell JOIN bl ON bl.i = c.mode)
SELECT vec_id, cell, mode, round(sum(v), 6) + 0.0 AS c FROM x GROUP BY 1, 2, 3""")
def _(spark, sf):
    e = src.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    c = e.select("vec_id", F.explode(F.array(*[F.struct(F.lit(n).alias("cell"), F.slice("e", 4 * n + 1, 4).alias("c")) for n in range(16)])).alias("z")).select("vec_id", "z.*")
    return wav.apply_integration(c, 4, 4, "vec_id").select("vec_id", "cell", F.posexplode("c").alias("mode", "c")).withColumn("c", fr.tidy(F.col("c")))


def _ode(spark, rows, level_j, modes, digits):
    """Solutions at 41 times, by the operators' equations."""
    c = wav.solve_odes(spark, spark.createDataFrame(rows, "id long, a double, b double, f0 double, f1 double, y0 double"), level_j, modes)
    times = spark.range(41).select((F.col("id") / F.lit(40.0)).alias("t"))
    return wav.evaluate_series(c, times, level_j, modes).select("id", "t", fr.tidy(F.col("value"), digits).alias("y"))


AT = "tt AS (SELECT unnest(range(41)) / 40.0::DOUBLE AS t)"


@query("ode_const_coef", f"WITH {AT} SELECT unnest([1, 2])::BIGINT AS id, t, round(unnest([t / 2 - 0.25 + exp(-2 * t) / 4, 3 * exp(-t) - 1 + t]), 4) + 0.0 AS y FROM tt")
def _(spark, sf):
    return _ode(spark, [(1, 2.0, 0.0, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 0.0, 1.0, 2.0)], 6, 4, 4)


@query("ode_var_coef", f"WITH {AT} SELECT unnest([1, 2])::BIGINT AS id, t, round(unnest([1 - exp(-t * t / 2), exp(-t - t * t / 2)]), 6) + 0.0 AS y FROM tt")
def _(spark, sf):
    return _ode(spark, [(1, 0.0, 1.0, 0.0, 1.0, 0.0), (2, 1.0, 1.0, 0.0, 0.0, 1.0)], 4, 6, 6)


@query("verify_identities", "SELECT unnest(['orthonormality', 'integration', 'product symmetry', 'product projection']) AS identity, unnest([2, 4])::INTEGER AS level_j, 0.0::DOUBLE AS deviation WHERE FALSE UNION ALL SELECT i, j::INTEGER, 0.0::DOUBLE FROM (SELECT unnest(['orthonormality', 'integration', 'product symmetry', 'product projection']) AS i), (SELECT unnest([2, 4]) AS j)")
def _(spark, sf):
    both = [wav.verify(spark, j, m).withColumn("level_j", F.lit(j)) for j, m in ((2, 4), (4, 6))]
    return both[0].unionByName(both[1]).select("identity", "level_j", fr.tidy(F.col("deviation"), 9).alias("deviation"))


@query("omi_published", "SELECT i::INTEGER AS i, j::INTEGER AS j, own::DOUBLE AS own, later::DOUBLE AS later FROM (VALUES (0, 0, 1/8, 1/4), (0, 1, 1/16, 0), (0, 2, 0, 0), (0, 3, 0, 0), (1, 0, -3/32, 0), (1, 1, 0, 0), (1, 2, 1/32, 0), (1, 3, 0, 0), (2, 0, 1/24, 1/12), (2, 1, -1/48, 0), (2, 2, 0, 0), (2, 3, 1/48, 0), (3, 0, -1/32, 0), (3, 1, 0, 0), (3, 2, -1/64, 0), (3, 3, 0, 0)) v(i, j, own, later)")
def _(spark, sf):
    """The blocks of the integration operator at level 2 with 4 modes, as published."""
    return wav.integration_blocks(spark, 2, 4).select("i", "j", (F.col("own") + 0.0).alias("own"), "later")


@query("wavelet_scale", "SELECT j::INTEGER AS level_j, round(sqrt(pow(2, j + 2) / pi()), 9) AS scale FROM (SELECT unnest(range(21)) AS j)")
def _(spark, sf):
    return spark.range(21).select(F.col("id").cast("int").alias("level_j"), F.round(F.sqrt(F.pow(F.lit(2.0), F.col("id") + 2) / F.pi()), 9).alias("scale"))


@query("wavelet_antiderivative", f"WITH {T}, v AS (SELECT event_id, CASE WHEN cell = 2 THEN u WHEN cell > 2 THEN 1 ELSE -1 END::DOUBLE AS u FROM u) SELECT event_id, round({A} / 16 * (4 * u * u * u - 3 * u + 1) / 3, 6) + 0.0 AS integral FROM v")
def _(spark, sf):
    return _times(spark, sf).select("event_id", fr.tidy(wav.antiderivative(F.col("t"), 3, 2, 2)).alias("integral"))


J, M = 3, 4


def _project_sql() -> str:
    f = b.scale(J) / 2 ** (J + 1)
    return f"""sp AS (SELECT asset, min(dt) AS lo, max(dt) AS hi FROM p GROUP BY asset), s AS (SELECT asset, dt, close, (dt - lo) / (hi - lo)::DOUBLE AS tau, (hi - lo)::DOUBLE AS span FROM p JOIN sp USING (asset)),
nq AS (SELECT asset, greatest({M + 8}, least(512, ceil(2.0 * count(*) / {1 << J})))::INTEGER AS q FROM p GROUP BY asset), ni AS (SELECT asset, q, unnest(range(1, q + 1)) AS i FROM nq),
nu AS (SELECT asset, cos(i * pi() / (q + 1)) AS u, pi() / (q + 1) * sin(i * pi() / (q + 1)) * sin(i * pi() / (q + 1)) AS g FROM ni), nd AS (SELECT asset, cell, u, g, (u + 2 * cell + 1) / {2 << J} AS tau FROM nu, (SELECT unnest(range({1 << J}))::INTEGER AS cell)),
nb AS (SELECT nd.*, s.tau AS t0, s.close AS s0 FROM nd ASOF JOIN s ON nd.asset = s.asset AND nd.tau >= s.tau), na AS (SELECT nb.*, s.tau AS t1, s.close AS s1 FROM nb ASOF JOIN s ON nb.asset = s.asset AND nb.tau <= s.tau),
y AS (SELECT asset, cell, u, g * coalesce(s0 + (s1 - s0) * ((tau - t0) / nullif(t1 - t0, 0)), s0) AS y FROM na),
co AS (SELECT asset, cell, sum(y) * {f!r} AS c0, sum(y * 2 * u) * {f!r} AS c1, sum(y * (4 * u * u - 1)) * {f!r} AS c2, sum(y * (8 * u * u * u - 4 * u)) * {f!r} AS c3 FROM y GROUP BY 1, 2)"""


def _denoise_sql(degree: int = 3) -> str:
    a, d = b.scale(J), b.differentiation_block(J, M)
    c = [f"c{m}" if m <= degree else "0" for m in range(M)]
    u = [x.replace("u", "uu") for x in U]
    value = " + ".join(f"{c[m]} * ({u[m]})" for m in range(M))
    slope = " + ".join(f"{float(d[m, j])!r} * {c[m]} * ({u[j]})" for m in range(M) for j in range(M) if d[m, j])
    return f"""{_project_sql()}, at_ AS (SELECT asset, dt, close, span, tau, least(floor(tau * {1 << J}), {(1 << J) - 1})::INTEGER AS cell FROM s), au AS (SELECT *, tau * {2 << J} - 2 * cell - 1 AS uu FROM at_),
dn AS (SELECT asset, dt, close, {a!r} * ({value}) AS smooth, {a!r} * ({slope}) / span AS slope FROM au JOIN co USING (asset, cell))"""


@query("denoise", f"WITH $PW, {_denoise_sql()} SELECT asset, dt, round(smooth, 3) + 0.0 AS smooth FROM dn")
def _(spark, sf):
    return wav.denoise_batch(src.weekly(spark, sf), J, M).select("asset", "dt", fr.tidy(F.col("smooth"), 3).alias("smooth"))


@query("denoise_derivative", f"WITH $PW, {_denoise_sql()} SELECT asset, dt, round(slope, 3) + 0.0 AS slope FROM dn")
def _(spark, sf):
    return wav.denoise_batch(src.weekly(spark, sf), J, M).select("asset", "dt", fr.tidy(F.col("slope"), 3).alias("slope"))


@query("denoise_keepdegree", f"WITH $PW, {_denoise_sql(1)} SELECT asset, dt, round(smooth, 3) + 0.0 AS smooth FROM dn")
def _(spark, sf):
    return wav.denoise_batch(src.weekly(spark, sf), J, M, keep_degree=1).select("asset", "dt", fr.tidy(F.col("smooth"), 3).alias("smooth"))


def _threshold_sql() -> str:
    base = 32 << J
    rows = (b.projector(base, M, J, "chebyshev") ** 2).sum(1).reshape(-1, M)
    size = [math.sqrt(2 * math.log(M << J)) * x for x in np.sqrt(rows.mean(0) * base).tolist()]
    shrunk = ", ".join(f"sign(c{m}) * greatest(0, abs(c{m}) - {size[m]!r} * sigma / sqrt(n)) AS c{m}" for m in range(1, M))
    sql = _denoise_sql().replace("JOIN co USING", "JOIN ct USING")
    noise = f"""df AS (SELECT asset, close - lag(close) OVER (PARTITION BY asset ORDER BY dt) AS d FROM p), md AS (SELECT asset, median(d) AS med, count(*) AS n FROM df GROUP BY asset), sg AS (SELECT asset, any_value(n) AS n, 1.4826 * median(abs(d - med)) / sqrt(2) AS sigma FROM df JOIN md USING (asset) GROUP BY asset),
ct AS (SELECT asset, cell, c0, {shrunk} FROM co JOIN sg USING (asset)), at_ AS ("""
    return sql.replace("at_ AS (", noise, 1)


@query("denoise_threshold", f"WITH $PW, {_threshold_sql()} SELECT asset, dt, round(smooth, 3) + 0.0 AS smooth FROM dn")
def _(spark, sf):
    return wav.denoise_batch(src.weekly(spark, sf), J, M, kappa=1.0).select("asset", "dt", fr.tidy(F.col("smooth"), 3).alias("smooth"))


@query("denoise_diagnostics", f"WITH $PW, {_denoise_sql()} SELECT asset, round(stddev_samp(close - smooth), 3) AS residual_std, round(10 * log10(var_samp(close) / var_samp(close - smooth)), 6) AS snr_gain_db, count(close) AS n FROM dn GROUP BY asset")
def _(spark, sf):
    return wav.denoise_diagnostics(wav.denoise_batch(src.weekly(spark, sf), J, M)).select("asset", F.round("residual_std", 3).alias("residual_std"), F.round("snr_gain_db", 6).alias("snr_gain_db"), "n")


ENDS = [b.scale(J) * (m + 1) for m in range(M)]


@query("block_jump", f"WITH $PW, {_project_sql()}, j AS (SELECT asset, abs(lead({' + '.join(f'c{m} * {(-1) ** m * e!r}' for m, e in enumerate(ENDS))}) OVER (PARTITION BY asset ORDER BY cell) - ({' + '.join(f'c{m} * {e!r}' for m, e in enumerate(ENDS))})) AS x FROM co) SELECT asset, round(max(x), 3) AS jump FROM j GROUP BY asset")
def _(spark, sf):
    return wav.block_jump(wav.project(src.weekly(spark, sf), J, M), J, M).withColumn("jump", F.round("jump", 3))
