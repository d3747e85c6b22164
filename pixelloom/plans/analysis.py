"""Queries of mixtures, crystals and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import crystal as L
from ..operators import detector as D
from ..operators import mixture as M
from ..operators.filters import in_circle
from .base import NX, NY, peaks, peaks_ref, pixels, register, rounded, samples, sql, table

_MODEL = [M.Component(0.5, 15.0, 120.0), M.Component(0.3, 60.0, 500.0), M.Component(0.2, 120.0, 2500.0)]


def _density_sql(k: int) -> str:
    c = _MODEL[k]
    return f"({c.weight} / sqrt(2 * pi() * {c.var}) * exp(-(v - {c.mean}) * (v - {c.mean}) / (2 * {c.var})))"


_P = ", p AS (SELECT id, v, " + ", ".join(f"{_density_sql(k)} AS p{k}" for k in range(3)) + " FROM samples), t AS (SELECT *, p0 + p1 + p2 AS s FROM p)"


@register("gmm_init", sql(", r AS (SELECT min(v) AS lo, max(v) AS hi FROM samples) SELECT CAST(i AS INTEGER) AS k, round(0.25, 6) * 1.0::DOUBLE AS weight, round(lo + (2 * i + 1) * (hi - lo) / 8, 6) AS mean, round(power((hi - lo) / 8, 2), 6) AS var FROM r, (SELECT unnest(range(4)) AS i) s", "samples"))
def gmm_init(spark, d):
    model = M.initial(samples(spark, d), 4)
    return rounded(spark.createDataFrame([(k, c.weight, c.mean, c.var) for k, c in enumerate(model)], "k int, weight double, mean double, var double"))


@register("gmm_density", sql(_P + " SELECT id, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2 FROM t", "samples"))
def gmm_density(spark, d):
    return M.densities(samples(spark, d), _MODEL).select("id", *(F.round(F.get("p", F.lit(k)), 9).alias(f"p{k}") for k in range(3)))


@register("gmm_estep", sql(_P + " SELECT id, round(p0 / s, 6) AS t0, round(p1 / s, 6) AS t1, round(p2 / s, 6) AS t2 FROM t", "samples"))
def gmm_estep(spark, d):
    return M.responsibilities(samples(spark, d), _MODEL).select("id", *(F.round(F.get("tau", F.lit(k)), 6).alias(f"t{k}") for k in range(3)))


def _mstep_sql() -> str:
    each = " UNION ALL ".join(f"SELECT {k} AS k, v, p{k} / s AS tau FROM t" for k in range(3))
    return sql(
        _P + f""", e AS ({each}), m AS (SELECT k, sum(tau) AS n, sum(tau * v) / sum(tau) AS mean FROM e GROUP BY k),
        var AS (SELECT e.k, sum(tau * power(v - m.mean, 2)) / max(m.n) AS var FROM e JOIN m ON e.k = m.k GROUP BY e.k)
        SELECT m.k, round(m.n / (SELECT count(*) FROM samples), 6) AS weight, round(m.mean, 5) AS mean, round(var.var, 4) AS var FROM m JOIN var ON m.k = var.k""",
        "samples",
    )


@register("gmm_mstep", _mstep_sql())
def gmm_mstep(spark, d):
    model, _ = M.step(samples(spark, d), _MODEL)
    return spark.createDataFrame([(k, round(c.weight, 6), round(c.mean, 5), round(c.var, 4)) for k, c in enumerate(model)], "k int, weight double, mean double, var double")


@register("gmm_fit")
def gmm_fit(spark, d):
    """Iterative to convergence; a test checks that the likelihood never falls and that known mixtures are found."""
    model, llh = M.fit(samples(spark, d), 3)
    return rounded(spark.createDataFrame([(k, c.weight, c.mean, c.var, llh) for k, c in enumerate(model)], "k int, weight double, mean double, var double, llh double"), 3)


@register(
    "gmm_scores",
    sql(
        _P + """, a AS (SELECT sum(ln(s)) AS llh, -sum(CASE WHEN p0 > 0 THEN p0 / s * ln(p0 / s) ELSE 0 END + CASE WHEN p1 > 0 THEN p1 / s * ln(p1 / s) ELSE 0 END + CASE WHEN p2 > 0 THEN p2 / s * ln(p2 / s) ELSE 0 END) AS en FROM t)
        SELECT metric, round(value, 2) AS value FROM (SELECT 'nllh' AS metric, -llh AS value FROM a UNION ALL SELECT 'en', en FROM a UNION ALL SELECT 'aic', -2 * llh + 16 FROM a UNION ALL SELECT 'gic', -2 * llh + 16 FROM a
          UNION ALL SELECT 'bic', -2 * llh + 8 * ln(8) FROM a UNION ALL SELECT 'clc', -2 * llh + 2 * en FROM a UNION ALL SELECT 'icl', -2 * llh + 2 * en + 8 * ln(8) FROM a UNION ALL SELECT 'awe', -2 * llh + 2 * en + 16 * (1.5 + ln(8)) FROM a) u""",
        "samples",
    ),
)
def gmm_scores(spark, d):
    n, llh, en = M.entropy(samples(spark, d), _MODEL)
    return rounded(spark.createDataFrame(list(M.scores(llh, en, n, 3).items()), "metric string, value double"), 2)


@register("gmm_assign", sql(_P + " SELECT id, CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS BIGINT) AS component FROM t", "samples"))
def gmm_assign(spark, d):
    return M.assign(samples(spark, d), _MODEL)


@register("align_unit_cell", sql("SELECT image_id, peak_id, round((x * 1.5 + y * 0.25) / 0.5 + 3, 6) AS x, round((x * -0.2 + y * 2) / 0.5 + 4, 6) AS y FROM peaks", "peaks"))
def align_unit_cell(spark, d):
    return rounded(L.align_cell(peaks(spark, d), ((2.0, 0.0), (0.0, 4.0)), ((3.0, -0.4), (1.0, 8.0)), (3.0, 4.0), 0.5).select("image_id", "peak_id", "x", "y"))


_CELL = [(0, "Sr", 0.0, 0.0), (1, "Ti", 2.0, 1.5), (2, "O", 2.0, 0.0)]


@register("lattice_3d", sql(", atom(idx, symbol, cx, cy) AS (VALUES (0, 'Sr', 0.0, 0.0), (1, 'Ti', 2.0, 1.5), (2, 'O', 2.0, 0.0)) SELECT image_id, peak_id, idx, symbol, round(x + cx, 6) AS x, round(y + cy, 6) AS y FROM peaks, atom WHERE x + cx >= 0 AND x + cx < 64 AND y + cy >= 0 AND y + cy < 48", "peaks"))
def lattice_3d(spark, d):
    atoms = spark.createDataFrame(_CELL, "idx int, symbol string, x double, y double")
    return rounded(L.tile_lattice(atoms, peaks(spark, d), NX, NY).select("image_id", "peak_id", "idx", "symbol", "x", "y"))


@register("lattice_vectors_fft", "SELECT p_partkey, round((p_size + 1) / (power(p_size + 1, 2) + power(p_partkey % 11, 2)), 6) AS ax, round((p_partkey % 11) / (power(p_size + 1, 2) + power(p_partkey % 11, 2)), 6) AS ay FROM part")
def lattice_vectors_fft(spark, d):
    v = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 1).cast("double").alias("gx"), (F.col("p_partkey") % 11).cast("double").alias("gy"))
    return rounded(L.reciprocal_to_real(v).select("p_partkey", "ax", "ay"))


@register("fft_peaks")
def fft_peaks(spark, d):
    """A test finds the vectors of a known lattice."""
    return rounded(L.fft_peaks(pixels(spark, d), NX, NY))


@register("displacement", sql("SELECT p.image_id, p.peak_id, round((p.x - r.x) * 0.1, 6) AS ux, round((p.y - r.y) * 0.1, 6) AS uy FROM peaks p JOIN peaks_ref r ON p.image_id = r.image_id AND p.peak_id = r.peak_id", "peaks", "peaks_ref"))
def displacement(spark, d):
    return rounded(L.displacement(peaks(spark, d), peaks_ref(spark, d), 0.1).select("image_id", "peak_id", "ux", "uy"))


@register(
    "strain_atomic",
    sql(
        """, m AS (SELECT p.image_id, p.peak_id, p.x, p.y, r.x * 1.013 AS rx, r.y * 0.987 AS ry FROM peaks p JOIN peaks_ref r ON p.image_id = r.image_id AND p.peak_id = r.peak_id),
        e AS (SELECT a.image_id, a.peak_id, b.rx - a.rx AS x0, b.ry - a.ry AS y0, b.x - a.x AS x1, b.y - a.y AS y1 FROM m a JOIN m b ON a.image_id = b.image_id AND a.peak_id <> b.peak_id AND power(a.rx - b.rx, 2) + power(a.ry - b.ry, 2) < 64),
        s AS (SELECT image_id, peak_id, sum(x1 * x0) AS a, sum(x1 * y0) AS b, sum(y1 * x0) AS c, sum(y1 * y0) AS d, sum(x0 * x0) AS p, sum(x0 * y0) AS q, sum(y0 * y0) AS r FROM e GROUP BY 1, 2),
        f AS (SELECT image_id, peak_id, CASE WHEN abs(p * r - q * q) > 1e-9 THEN p * r - q * q END AS det, a, b, c, d, p, q, r FROM s)
        SELECT k.image_id, k.peak_id, round((a * r - b * q) / det - 1, 6) + 0.0 AS exx, round((d * p - c * q) / det - 1, 6) + 0.0 AS eyy,
          round(((b * p - a * q) / det + (c * r - d * q) / det) / 2, 6) + 0.0 AS exy, round(((b * p - a * q) / det - (c * r - d * q) / det) / 2, 6) + 0.0 AS omega
        FROM peaks k LEFT JOIN f ON k.image_id = f.image_id AND k.peak_id = f.peak_id""",
        "peaks", "peaks_ref",
    ),
)
def strain_atomic(spark, d):
    ref = peaks_ref(spark, d).withColumns({"x": F.col("x") * 1.013, "y": F.col("y") * 0.987})  # a strained reference
    return rounded(L.local_strain(peaks(spark, d), ref, 8.0))


@register(
    "strain_xy",
    sql(
        """, m AS (SELECT p.image_id, p.peak_id, r.x AS rx, r.y AS ry, p.x - r.x AS ux, p.y - r.y AS uy FROM peaks p JOIN peaks_ref r ON p.image_id = r.image_id AND p.peak_id = r.peak_id),
        n AS (SELECT v.name, a.image_id, a.peak_id, b.ux - a.ux AS dx, b.uy - a.uy AS dy,
            row_number() OVER (PARTITION BY v.name, a.image_id, a.peak_id ORDER BY power(a.rx + v.vx - b.rx, 2) + power(a.ry + v.vy - b.ry, 2), b.peak_id) AS k
          FROM m a JOIN (VALUES ('a', 8.0, 0.0), ('b', 0.0, 8.0)) v(name, vx, vy) ON true JOIN m b ON a.image_id = b.image_id AND power(a.rx + v.vx - b.rx, 2) + power(a.ry + v.vy - b.ry, 2) < 6.25)
        SELECT m.image_id, m.peak_id, round(a.dx / 8, 6) + 0.0 AS exx, round(b.dy / 8, 6) + 0.0 AS eyy, round((a.dy / 8 + b.dx / 8) / 2, 6) + 0.0 AS exy, round((b.dx / 8 - a.dy / 8) / 2, 6) + 0.0 AS omega
        FROM m LEFT JOIN n a ON m.image_id = a.image_id AND m.peak_id = a.peak_id AND a.name = 'a' AND a.k = 1 LEFT JOIN n b ON m.image_id = b.image_id AND m.peak_id = b.peak_id AND b.name = 'b' AND b.k = 1""",
        "peaks", "peaks_ref",
    ),
)
def strain_xy(spark, d):
    return rounded(L.strain_along(peaks(spark, d), peaks_ref(spark, d), (8.0, 0.0), (0.0, 8.0), 2.5))


@register(
    "detector_init",
    sql(
        """, k AS (SELECT i, exp(-i * i / 8.0) AS w FROM (SELECT unnest(range(-2, 3)) AS i) t), n AS (SELECT sum(w) AS total FROM k),
        o AS (SELECT p.image_id, p.y, p.x, p.v, a.w * b.w AS w, CASE WHEN p.x + a.i < 0 THEN -(p.x + a.i) WHEN p.x + a.i > 63 THEN 126 - (p.x + a.i) ELSE p.x + a.i END AS qx, CASE WHEN p.y + b.i < 0 THEN -(p.y + b.i) WHEN p.y + b.i > 47 THEN 94 - (p.y + b.i) ELSE p.y + b.i END AS qy FROM pixels p, k a, k b)
        SELECT o.image_id, o.y, o.x, max(o.v) AS v, round(sum(q.v * w) / max(total * total), 5) AS blur FROM o JOIN pixels q ON o.image_id = q.image_id AND q.x = o.qx AND q.y = o.qy, n GROUP BY 1, 2, 3""",
        "pixels",
    ),
)
def detector_init(spark, d):
    return rounded(D.smooth(pixels(spark, d), NX, NY), 5)


@register(
    "masks",
    sql(
        """, e AS (SELECT image_id, min(v) AS lo, (max(v) - min(v)) / 256 AS w FROM pixels GROUP BY image_id),
        h AS (SELECT p.image_id, CAST(least(floor((v - lo) / w), 255) AS INTEGER) AS bin, count(*) AS n, max(lo) AS lo, max(w) AS w FROM pixels p JOIN e ON p.image_id = e.image_id GROUP BY 1, 2),
        c AS (SELECT a.image_id, a.bin, max(a.lo) AS lo, max(a.w) AS w, sum(CASE WHEN b.bin <= a.bin THEN b.n ELSE 0 END) * 1.0 AS n0, sum(CASE WHEN b.bin > a.bin THEN b.n ELSE 0 END) * 1.0 AS n1, sum(CASE WHEN b.bin <= a.bin THEN b.n * b.bin ELSE 0 END) * 1.0 AS m0, sum(CASE WHEN b.bin > a.bin THEN b.n * b.bin ELSE 0 END) * 1.0 AS m1 FROM h a JOIN h b ON a.image_id = b.image_id GROUP BY 1, 2),
        r AS (SELECT image_id, lo + (bin + 1) * w AS t, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN n1 > 0 THEN round(n0 * n1 * power(m0 / n0 - m1 / n1, 2), 3) ELSE 0 END DESC, bin) AS k FROM c)
        SELECT p.image_id, p.y, p.x, p.v >= r.t AS mask FROM pixels p JOIN r ON p.image_id = r.image_id WHERE r.k = 1""",
        "pixels",
    ),
)
def masks(spark, d):
    return D.otsu_mask(pixels(spark, d)).select("image_id", "y", "x", "mask")


@register("mask_edge", sql(", m AS (SELECT p.image_id, y, x, v > q AS mask FROM pixels p JOIN (SELECT image_id, quantile_cont(v, 0.2) AS q FROM pixels GROUP BY image_id) c ON p.image_id = c.image_id) SELECT m.image_id, m.y, m.x, m.mask AND 4 = (SELECT count(*) FROM m o WHERE o.image_id = m.image_id AND o.mask AND abs(o.x - m.x) + abs(o.y - m.y) = 1) AS mask FROM m", "pixels"))
def mask_edge(spark, d):
    return D.edge_mask(D.percentile_mask(pixels(spark, d), 20)).select("image_id", "y", "x", "mask")


@register("watershed_mask")
def watershed_mask(spark, d):
    """A test holds the flooding against a plain one with a heap."""
    return D.watershed_mask(D.smooth(pixels(spark, d), NX, NY).select("image_id", "y", "x", F.round("blur", 6).alias("v"))).select("image_id", "y", "x", "mask")


@register("watershed_cells")
def watershed_cells(spark, d):
    return D.watershed_cells(pixels(spark, d), peaks(spark, d)).select("image_id", "y", "x", "peak_id")


_LEVELS = "SELECT image_id, avg(v) FILTER (WHERE power(x - 31.5, 2) + power(y - 23.5, 2) < {}) AS det, quantile_cont(v, 0.2) AS bg FROM pixels GROUP BY image_id"


@register("dose_scale", sql(f", e AS ({_LEVELS.format(100)}), d AS ({_LEVELS.format(400)}) SELECT e.image_id, round((e.det - e.bg) / (d.det - d.bg) / 2, 6) AS scale FROM e JOIN d ON e.image_id = d.image_id", "pixels"))
def dose_scale(spark, d):
    e, full = (A.detector_levels(pixels(spark, d), in_circle(NX, NY, r)) for r in (10, 20))
    return rounded(D.dose_scale(e, full, 2.0))


@register("detector_gain", sql(f", e AS ({_LEVELS.format(100)}) SELECT image_id, round((det - bg) * 0.5, 6) AS gain, round((det - bg) * 0.5 + bg, 6) AS top FROM e", "pixels"))
def detector_gain(spark, d):
    levels = A.detector_levels(pixels(spark, d), in_circle(NX, NY, 10))
    return rounded(D.detector_gain(levels, levels.select("image_id", F.lit(0.5).alias("scale"))))
