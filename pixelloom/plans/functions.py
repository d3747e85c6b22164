"""Queries of the scalar, optical and grid functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import grids as G
from ..functions import models as M
from ..functions import optics as E
from .base import NX, NY, peaks, pixels, register, rounded, samples, sql, table
from .spatial import near_pairs

_R2 = "((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y))"
_PAIR = "FROM pixels p JOIN peaks k ON p.image_id = k.image_id AND greatest(abs(p.x - k.x), abs(p.y - k.y)) < {}"
_IDS = "p.image_id, p.y, p.x, k.peak_id"


def _pairs(spark, d, reach):
    return near_pairs(pixels(spark, d), peaks(spark, d), reach, box=True)


def _pair_query(spark, d, value):
    return rounded(_pairs(spark, d, 3.0).select("image_id", "y", "x", F.col("peak_id_r").alias("peak_id"), value.alias("m")))


@register("gaussian", sql(f"SELECT {_IDS}, round(10 * exp(-{_R2} / (2 * 1.5 * 1.5)), 6) AS m {_PAIR.format(3)}", "pixels", "peaks"))
def gaussian(spark, d):
    return _pair_query(spark, d, M.gaussian(F.col("d2"), F.lit(10.0), F.lit(1.5)))


@register("lorentzian", sql(f"SELECT {_IDS}, round(10 * 2.25 / ({_R2} + 2.25), 6) AS m {_PAIR.format(3)}", "pixels", "peaks"))
def lorentzian(spark, d):
    return _pair_query(spark, d, M.lorentzian(F.col("d2"), F.lit(10.0), F.lit(1.5)))


@register("voigt", sql(f"SELECT {_IDS}, round(10 * (0.9 * exp(-{_R2} / 4.5) + (1 - 0.9) * power(1.2, 3) / power({_R2} + 1.44, 1.5)), 6) AS m {_PAIR.format(3)}", "pixels", "peaks"))
def voigt(spark, d):
    return _pair_query(spark, d, M.voigt(F.col("d2"), F.lit(10.0), F.lit(1.5), F.lit(1.2), F.lit(0.9)))


def _sum_sql(model: str) -> str:
    return sql(
        f""", s AS (SELECT p.image_id, p.y, p.x, sum({model}) AS m {_PAIR.format(5)} GROUP BY 1, 2, 3)
        SELECT p.image_id, p.y, p.x, round(coalesce(s.m, 0) + 2, 6) AS model FROM pixels p LEFT JOIN s ON p.image_id = s.image_id AND p.x = s.x AND p.y = s.y""",
        "pixels", "peaks",
    )


def _sum_query(spark, d, model):
    return rounded(M.render(pixels(spark, d), peaks(spark, d), model, 5.0, 2.0).select("image_id", "y", "x", "model"))


@register("gaussian_sum", _sum_sql(f"(1 + k.atom_type) * exp(-{_R2} / 2)"))
def gaussian_sum(spark, d):
    return _sum_query(spark, d, M.gaussian(F.col("d2"), 1.0 + F.col("atom_type_r"), F.lit(1.0)))


@register("lorentzian_sum", _sum_sql(f"(1 + k.atom_type) * power(1.44, 2) / power({_R2} + 1.44, 2)"))
def lorentzian_sum(spark, d):
    return _sum_query(spark, d, M.lorentzian_squared(F.col("d2"), 1.0 + F.col("atom_type_r"), F.lit(1.2)))


@register("voigt_sum", _sum_sql(f"(1 + k.atom_type) * (0.8 * exp(-{_R2} / 2) + (1 - 0.8) * power(1.2, 3) / power({_R2} + 1.44, 1.5))"))
def voigt_sum(spark, d):
    return _sum_query(spark, d, M.voigt(F.col("d2"), 1.0 + F.col("atom_type_r"), F.lit(1.0), F.lit(1.2), F.lit(0.8)))


@register(
    "scs_volume",
    sql("SELECT image_id, peak_id, round(2 * pi() * x * 4 * 0.01, 6) AS g, round(pi() * x * 2.25 * 0.01, 6) AS l, round(0.9 * 2 * pi() * x * 4 * 0.01 + (1 - 0.9) * pi() * x * 2.25 * 0.01, 6) AS v FROM peaks", "peaks"),
)
def scs_volume(spark, d):
    args = (F.col("x"), F.lit(2.0), F.lit(1.5), F.lit(0.9), 0.1)
    return rounded(peaks(spark, d).select("image_id", "peak_id", *(M.volume(k, *args).alias(k[0]) for k in ("gaussian", "lorentzian", "voigt"))))


@register(
    "gauss_rotated",
    sql("""SELECT image_id, y, x, round(0.1 + 5 * exp(-(power((x - 30) * cos(0.5) + (y - 20) * sin(0.5), 2) / (2 * 36.0) + power((y - 20) * cos(0.5) - (x - 30) * sin(0.5), 2) / (2 * 100.0))), 6) AS m FROM pixels""", "pixels"),
)
def gauss_rotated(spark, d):
    return rounded(pixels(spark, d).select("image_id", "y", "x", M.rotated_gaussian(F.col("x"), F.col("y"), 5, 30, 20, 6, 10, 0.5, 0.1).alias("m")))


@register("butterworth", sql("SELECT image_id, y, x, round(v / (1 + power((x - 32) / 16.0, 8)) / (1 + power((y - 24) / 12.0, 8)), 6) AS v FROM pixels", "pixels"))
def butterworth(spark, d):
    w = M.butterworth(F.col("x"), F.col("y"), NX, NY, 0.25, 4)
    return rounded(pixels(spark, d).select("image_id", "y", "x", (F.col("v") * w).alias("v")))


@register(
    "gaussian_kernel",
    sql(""", k AS (SELECT i, exp(-i * i / (2 * 1.5 * 1.5)) AS w FROM (SELECT unnest(range(-10, 11)) AS i) t), n AS (SELECT sum(w) AS total FROM k)
      SELECT p.image_id, p.y, p.x, round(sum(q.v * a.w * b.w) / max(total * total), 5) AS blur
      FROM pixels p JOIN pixels q ON p.image_id = q.image_id AND abs(p.x - q.x) <= 10 AND abs(p.y - q.y) <= 10 JOIN k a ON a.i = p.x - q.x JOIN k b ON b.i = p.y - q.y, n GROUP BY 1, 2, 3""", "pixels"),
)
def gaussian_kernel(spark, d):
    return rounded(M.gaussian_filter(pixels(spark, d), 1.5).select("image_id", "y", "x", "blur"), 5)


@register("curves", sql("SELECT id, round(power(v + 1, 0.7) * 2 + 3, 5) AS e, round(2 * v + 1, 5) AS p1, round(((0.001 * v + 0.02) * v - 3) * v + 4, 4) AS p3 FROM samples", "samples"))
def curves(spark, d):
    v = F.col("v")
    out = samples(spark, d).select(
        "id", F.round(M.power_curve(v + 1, 0.7, 2, 3), 5).alias("e"), F.round(M.polynomial(v, [2, 1]), 5).alias("p1"), F.round(M.polynomial(v, [0.001, 0.02, -3, 4]), 4).alias("p3")
    )
    return out


@register("safe_ln", sql("SELECT id, round(ln(greatest(v - 1, 2.2250738585072014e-308)), 6) AS l, round(exp(v / 100), 6) AS e FROM samples", "samples"))
def safe_ln(spark, d):
    return rounded(samples(spark, d).select("id", M.safe_ln(F.col("v") - 1).alias("l"), F.exp(F.col("v") / 100).alias("e")))


@register("add_channel", sql("SELECT id, v, round(0.5 * v * v - v + 2, 6) AS v2 FROM samples", "samples"))
def add_channel(spark, d):
    return rounded(samples(spark, d).select("id", "v", M.polynomial(F.col("v"), [0.5, -1, 2]).alias("v2")))


_ENERGY = "(60000 + p_partkey % 240000)"


@register(
    "wavenumber",
    f"SELECT p_partkey, round(sqrt({_ENERGY} * ({_ENERGY} + 2 * 510998.9461)) / 12398.419739, 6) AS k, round(({_ENERGY} + 510998.9461) / 510998.9461, 6) AS m, round(1.77 / (sqrt({_ENERGY} * ({_ENERGY} + 2 * 510998.9461)) / 12398.419739) / power(10 + p_size, 2) * 1e6, 4) AS depth FROM part",
)
def wavenumber(spark, d):
    e = (60000 + F.col("p_partkey") % 240000).cast("double")
    a = (F.col("p_size") + 10).cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(E.wavenumber(e), 6).alias("k"), F.round(E.mass_correction(e), 6).alias("m"), F.round(E.depth_of_field(e, a), 4).alias("depth"))


_AB = [(20.0, 0.3, 1, 2), (100.0, 0.1, 2, 1), (1000.0, 0.5, 2, 3), (12000.0, 0.7, 3, 0)]
_GRID_SQL = "SELECT p_partkey, (p_partkey % 50) / 100.0 AS q, p_size / 10.0 AS phi FROM part"
_CHI_SQL = "2 * pi() / 0.025 * (power(q * 0.025, 2) / 2 * 50 + " + " + ".join(f"power(q * 0.025, {n + 1}) * {a} / {n + 1} * cos({m} * (phi - {t if m else 0}))" for a, t, n, m in _AB) + ")"


def _chi(spark, d):
    grid = table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") % 50) / 100.0).alias("q"), (F.col("p_size") / 10.0).alias("phi"))
    return E.with_chi(grid, spark.createDataFrame(_AB, "amplitude double, angle double, n int, m int"), 0.025, 50.0)


@register("chi", f"SELECT p_partkey, round({_CHI_SQL}, 6) AS chi FROM ({_GRID_SQL}) g")
def chi(spark, d):
    return rounded(_chi(spark, d).select("p_partkey", "chi"))


@register("ctf", f"SELECT p_partkey, round(CASE WHEN q <= 0.3 THEN cos({_CHI_SQL}) ELSE 0 END, 6) + 0.0 AS re, round(CASE WHEN q <= 0.3 THEN -sin({_CHI_SQL}) ELSE 0 END, 6) + 0.0 AS im FROM ({_GRID_SQL}) g")
def ctf(spark, d):
    wave = E.transfer_function(F.col("chi"), F.col("q"), F.lit(0.3))
    return rounded(_chi(spark, d).select("p_partkey", wave.alias("w")).select("p_partkey", "w.re", "w.im"))


@register(
    "probe_wave",
    f""", x AS (SELECT p_partkey, p_partkey % 7 AS image_id, q, {_CHI_SQL} AS c FROM ({_GRID_SQL}) g), n AS (SELECT image_id, sqrt(count(*)) AS n FROM x WHERE q <= 0.3 GROUP BY image_id)
      SELECT p_partkey, round(CASE WHEN q <= 0.3 THEN cos(c) / n ELSE 0 END, 6) + 0.0 AS re, round(CASE WHEN q <= 0.3 THEN -sin(c) / n ELSE 0 END, 6) + 0.0 AS im FROM x JOIN n ON x.image_id = n.image_id""".replace(", x AS", "WITH x AS", 1),
)
def probe_wave(spark, d):
    waves = _chi(spark, d).select("p_partkey", (F.col("p_partkey") % 7).alias("image_id"), E.transfer_function(F.col("chi"), F.col("q"), F.lit(0.3)).alias("ctf"))
    return rounded(E.normalized(waves).select("p_partkey", "ctf.re", "ctf.im"))


@register("plane_wave", sql("SELECT image_id, y, x, round(cos(2 * pi() * (x * 3 / 64 + y * 2 / 48)) / sqrt(64 * 48), 6) + 0.0 AS re, round(sin(2 * pi() * (x * 3 / 64 + y * 2 / 48)) / sqrt(64 * 48), 6) + 0.0 AS im FROM pixels", "pixels"))
def plane_wave(spark, d):
    return rounded(pixels(spark, d).select("image_id", "y", "x", E.plane_wave(F.col("x"), F.col("y"), NX, NY, 3, 2).alias("w")).select("image_id", "y", "x", "w.re", "w.im"))


@register("chromatic", sql("SELECT id, round(exp(-v * v / (2 * power(13e6 * 0.8 / (2 * sqrt(2 * ln(2))) / 300000, 2))) / (13e6 * 0.8 / (2 * sqrt(2 * ln(2))) / 300000 * sqrt(2 * pi())), 8) AS p FROM samples", "samples"))
def chromatic(spark, d):
    spread = 0.8 / (2 * math.sqrt(2 * math.log(2)))
    return samples(spark, d).select("id", F.round(E.defocus_density(F.col("v"), 13e6, spread, 300000), 8).alias("p"))


# The quantiles of the normal distribution at 1/14, 3/14 ... 13/14.
_QUANTILES = "(0, -1.4652337926855226), (1, -0.7916386077433746), (2, -0.36610635680056963), (3, 0.0), (4, 0.36610635680056963), (5, 0.7916386077433746), (6, 1.4652337926855226)"


@register("chromatic_quadrature", f"SELECT p_partkey, node, round(q * 13e6 * (0.3 + p_size / 100.0) / (100000 + 1000 * p_size), 6) + 0.0 AS df FROM part, (VALUES {_QUANTILES}) t(node, q)")
def chromatic_quadrature(spark, d):
    """A beam for each part: its size tells the energy and the spread."""
    size = F.col("p_size").cast("double")
    beams = E.quadrature(table(spark, d, "part"), 7, 13e6, 0.3 + size / 100, 100000 + 1000 * size)
    return rounded(beams.select("p_partkey", "node", "df"))


@register("tilt_convert", "SELECT p_partkey, round(p_size * 1e-3 / 0.025, 6) AS inv, round(p_size * 1e-3 / 0.025 * 20) AS px FROM part")
def tilt_convert(spark, d):
    t = F.col("p_size").cast("double")
    args = (t, "mrad", F.lit(0.025), F.lit(20.0))
    return table(spark, d, "part").select("p_partkey", F.round(E.tilt(*args, "invA"), 6).alias("inv"), E.tilt(*args, "pixels").alias("px"))


@register(
    "aberration_phase",
    sql(""", u AS (SELECT image_id, y, x, (x - 32) / 64.0 * 0.025 AS u, (y - 24) / 48.0 * 0.025 AS v, (x - 32) / 64.0 AS k FROM pixels)
      SELECT image_id, y, x, round(2 * pi() / 0.025 * (-80 * (u * u + v * v) / 2 + 30 * (u * u - v * v) / 2 + 500 * (u * u * u - 3 * u * v * v) / 3 + 12000 * power(u * u + v * v, 2) / 4), 5) AS phase,
        round(sin(pi() * 0.025 * k * k * (0.5 * 12000 * 0.025 * 0.025 * k * k - 80)), 6) + 0.0 AS contrast FROM u""", "pixels"),
)
def aberration_phase(spark, d):
    kx, ky = (F.col("x") - 32) / 64.0, (F.col("y") - 24) / 48.0
    phase = E.named_phase(kx, ky, 0.025, {"C1": -80.0, "A1": 30.0, "A2": 500.0, "C3": 12000.0})
    out = pixels(spark, d).select("image_id", "y", "x", (F.round(phase, 5) + F.lit(0.0)).alias("phase"), E.phase_contrast(kx, 80.0, 12000.0, 0.025).alias("contrast"))
    return out.withColumn("contrast", F.round("contrast", 6) + F.lit(0.0))


@register("rotate_vector", sql("SELECT image_id, peak_id, round(x * cos(0.4) - y * sin(0.4), 6) AS rx, round(x * sin(0.4) + y * cos(0.4), 6) AS ry, CAST(atom_type AS DOUBLE) AS rz FROM peaks", "peaks"))
def rotate_vector(spark, d):
    r = G.rotate(F.col("x"), F.col("y"), F.col("atom_type").cast("double"), (0, 0, 2), 0.4)
    return rounded(peaks(spark, d).select("image_id", "peak_id", *(c.alias(n) for c, n in zip(r, ("rx", "ry", "rz"), strict=True))))


_SIZES = """, z AS (SELECT image_id, max(x) + 1 AS nx, max(y) + 1 AS ny FROM pixels GROUP BY image_id)"""


@register(
    "q_grid",
    sql(_SIZES + """ SELECT p.image_id, y, x, round(CASE WHEN 2 * x < nx THEN x ELSE x - nx END / (nx * 0.25), 6) + 0.0 AS qx, round(CASE WHEN 2 * y < ny THEN y ELSE y - ny END / (ny * 0.5), 6) + 0.0 AS qy
      FROM pixels p JOIN z ON p.image_id = z.image_id""", "pixels"),
)
def q_grid(spark, d):
    return rounded(G.q_grid(pixels(spark, d), 0.25, 0.5))


@register(
    "fft2",
    sql(
        _SIZES + """, r AS (SELECT p.image_id, p.y, u, sum(v * cos(2 * pi() * ((u - nx // 2) * (x - nx // 2) % nx) / nx)) AS re, -sum(v * sin(2 * pi() * ((u - nx // 2) * (x - nx // 2) % nx) / nx)) AS im
          FROM pixels p JOIN z ON p.image_id = z.image_id, (SELECT unnest(range(64)) AS u) t WHERE u < nx GROUP BY 1, 2, 3),
        c AS (SELECT r.image_id, w, u, cos(2 * pi() * ((w - ny // 2) * (y - ny // 2) % ny) / ny) AS c, sin(2 * pi() * ((w - ny // 2) * (y - ny // 2) % ny) / ny) AS s, re, im
          FROM r JOIN z ON r.image_id = z.image_id, (SELECT unnest(range(48)) AS w) t WHERE w < ny)
        SELECT image_id, CAST(w AS INTEGER) AS y, CAST(u AS INTEGER) AS x, round(sum(re * c + im * s), 3) + 0.0 AS re, round(sum(im * c - re * s), 3) + 0.0 AS im FROM c GROUP BY 1, 2, 3""",
        "pixels",
    ),
)
def fft2(spark, d):
    return rounded(G.fft2(pixels(spark, d)), 3)


_PHASE = "2 * pi() * ((({0} - n{2} // 2) * ({1} - n{2} // 2)) % n{2}) / n{2}"


def _pass(made: str, source: str, axis: str, to: str, other: str, count: int, sign: str) -> str:
    """SQL of a direct transform along one axis of the table ``source`` (re, im)."""
    angle = _PHASE.format(to, axis, axis[0] if axis in "xy" else {"u": "x", "w": "y"}[axis])
    size = f"n{axis}" if axis in "xy" else {"u": "nx", "w": "ny"}[axis]
    return f"""{made} AS (SELECT s.image_id, {other}, {to}, sum(re * cos({angle}) {sign} im * sin({angle})) AS re, sum(im * cos({angle}) {"-" if sign == "+" else "+"} re * sin({angle})) AS im
      FROM {source} s JOIN z ON s.image_id = z.image_id, (SELECT unnest(range({count})) AS {to}) t WHERE {to} < {size} GROUP BY 1, 2, 3)"""


@register(
    "band_pass",
    sql(
        _SIZES + ", w0 AS (SELECT image_id, y, x, v AS re, 0.0 AS im FROM pixels), "
        + ", ".join((_pass("f1", "w0", "x", "u", "y", 64, "+"), _pass("f2", "f1", "y", "w", "u", 48, "+")))
        + """, k AS (SELECT f.image_id, w, u, re, im FROM f2 f JOIN z ON f.image_id = z.image_id WHERE sqrt(power((u - nx // 2)::DOUBLE / nx, 2) + power((w - ny // 2)::DOUBLE / ny, 2)) >= 0.05
            AND sqrt(power((u - nx // 2)::DOUBLE / nx, 2) + power((w - ny // 2)::DOUBLE / ny, 2)) < 0.3), """
        + ", ".join((_pass("b1", "k", "u", "x", "w", 64, "-"), _pass("b2", "b1", "w", "y", "x", 48, "-")))
        + " SELECT b.image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(re / (nx * ny), 4) + 0.0 AS v FROM b2 b JOIN z ON b.image_id = z.image_id",
        "pixels",
    ),
)
def band_pass(spark, d):
    return rounded(G.band_pass(pixels(spark, d), 0.05, 0.3), 4)


@register(
    "fourier_zoom",
    sql(
        _SIZES + """, hx AS (SELECT z.image_id, j, x, sum(cos(2 * pi() * k * (30 + (j - 8) / 4.0 - x) / nx)) / nx AS c, sum(sin(2 * pi() * k * (30 + (j - 8) / 4.0 - x) / nx)) / nx AS s
          FROM z, (SELECT unnest(range(16)) AS j) a, (SELECT unnest(range(64)) AS x) b, (SELECT unnest(range(-32, 32)) AS k) f WHERE x < nx AND k >= -(nx // 2) AND k < nx - nx // 2 GROUP BY z.image_id, j, x, nx),
        hy AS (SELECT z.image_id, i, y, sum(cos(2 * pi() * k * (20 + (i - 8) / 4.0 - y) / ny)) / ny AS c, sum(sin(2 * pi() * k * (20 + (i - 8) / 4.0 - y) / ny)) / ny AS s
          FROM z, (SELECT unnest(range(16)) AS i) a, (SELECT unnest(range(48)) AS y) b, (SELECT unnest(range(-24, 24)) AS k) f WHERE y < ny AND k >= -(ny // 2) AND k < ny - ny // 2 GROUP BY z.image_id, i, y, ny),
        r AS (SELECT p.image_id, p.y, j, sum(v * c) AS re, sum(v * s) AS im FROM pixels p JOIN hx ON p.image_id = hx.image_id AND p.x = hx.x GROUP BY 1, 2, 3)
        SELECT r.image_id, CAST(hy.i AS INTEGER) AS i, CAST(r.j AS INTEGER) AS j, 20 + (hy.i - 8) / 4.0::DOUBLE AS y, 30 + (r.j - 8) / 4.0::DOUBLE AS x, round(sum(re * c - im * s), 4) + 0.0 AS v
        FROM r JOIN hy ON r.image_id = hy.image_id AND r.y = hy.y GROUP BY r.image_id, hy.i, r.j""",
        "pixels",
    ),
)
def fourier_zoom(spark, d):
    return rounded(G.fourier_zoom(pixels(spark, d), (30.0, 20.0), 4.0, (16, 16)), 4)


@register("label_seeds", sql("SELECT image_id, CAST(round(y) AS INTEGER) AS y, CAST(round(x) AS INTEGER) AS x, max(peak_id) + 1 AS label FROM peaks GROUP BY 1, 2, 3", "peaks"))
def label_seeds(spark, d):
    return G.seeds(peaks(spark, d))


_SYMBOL_SQL = f"string_split('{' '.join(G.SYMBOLS)}', ' ')[p_size + 1]"


@register("column_elements", f"SELECT p_partkey, {_SYMBOL_SQL} AS symbol, CASE {_SYMBOL_SQL} WHEN 'Sr' THEN CAST(0 AS BIGINT) WHEN 'Ti' THEN 1 WHEN 'O' THEN 2 END AS atom_type FROM part")
def column_elements(spark, d):
    atoms = table(spark, d, "part").withColumn("z", F.col("p_size"))
    return G.column_elements(atoms, ["Sr", "Ti", "O"]).select("p_partkey", "symbol", F.col("atom_type").cast("long").alias("atom_type"))
