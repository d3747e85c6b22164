"""Fits of peak models to images.

The gradient of the squared residual is one grouped aggregate over pixel-peak pairs within reach, so
a round of Adam is a Spark job whatever the image's size; parameters stay a table. Local fits (one
cell, one tile with its halo, one small image) are bounded groups and use a small Levenberg-Marquardt
solver in the worker.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import gaussian, volume
from ..plans.loops import NotConverged, cut
from ..plans.spatial import near_pairs
from .aggregates import voronoi_integrate
from .joins import label_pixels
from .refinement import fit_blocks

#: Means up to which a Poisson draw goes term by term.
NORMAL = 60.0
#: Length of each unit in Angstrom.
UNITS = {"A": 1.0, "nm": 10.0, "pm": 0.01, "um": 1e4}


def init_params(pixels: DataFrame, peaks: DataFrame, width: float, background: bool = True) -> DataFrame:
    """Start values: height of the pixel under each peak less the image's least value, one width, its Lorentzian equivalent."""
    base = pixels.groupBy("image_id").agg(F.min("v").alias("background"))
    at = pixels.select("image_id", F.col("y").alias("py"), F.col("x").alias("px"), "v")
    p = peaks.withColumns({"py": F.col("y").cast("int"), "px": F.col("x").cast("int")}).join(at, ["image_id", "py", "px"], "left").join(F.broadcast(base), "image_id")
    floor = F.col("background") if background else F.lit(0.0)
    return p.select(
        "image_id", "peak_id", "x", "y", "atom_type", (F.coalesce("v", floor) - floor).alias("height"), F.lit(width).alias("sigma"),
        F.lit(width / math.sqrt(2 * math.log(2))).alias("gamma"), F.lit(0.9).alias("ratio"), floor.alias("background"),
    )


def covered(pixels: DataFrame, peaks: DataFrame, n: int) -> DataFrame:
    """Pixels within n of any rounded peak along both axes."""
    at = peaks.select("image_id", "peak_id", F.round("x").alias("x"), F.round("y").alias("y"))
    return near_pairs(pixels, at, float(max(n, 1)), box=True, closed=True, how="left_semi").select("image_id", "y", "x") if n else pixels.limit(0).select("image_id", "y", "x")


def guess_radius(pixels: DataFrame, peaks: DataFrame, most: int | None = None) -> float:
    """Grows boxes round all peaks until one step adds less than half of the best step; sqrt(area per peak) / pi.

    ``most`` limits the boxes; else they may grow until they cover the images, after which a step adds nothing.
    """
    if most is None:
        ends = pixels.select("x", "y").unionByName(peaks.select("x", "y")).agg(*(F.max(c) - F.min(c) for c in ("x", "y"))).first()
        most = math.ceil(max(ends[0] or 0, ends[1] or 0)) + 2
    n_peaks, areas, best = peaks.count(), [0], 0
    for n in range(1, most + 1):
        areas.append(covered(pixels, peaks, n).count())
        gain = areas[-1] - areas[-2]
        best = max(best, gain)
        if gain < best / 2:
            break
    return math.sqrt(areas[-2] / max(n_peaks, 1)) / math.pi


def _model_pairs(pixels: DataFrame, params: DataFrame, reach: float) -> DataFrame:
    """Pairs of pixels and peaks with ``g``, the unit Gaussian of the peak at the pixel."""
    pairs = near_pairs(pixels, params, reach, box=True)
    return pairs.withColumn("g", gaussian(F.col("d2"), F.lit(1.0), F.col("sigma_r")))


def normal_equations(pixels: DataFrame, params: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Overlaps (i, j, a) of unit peaks and their products with the image (i, b), for heights by least squares."""
    pairs = _model_pairs(pixels, params, reach).select("image_id", "y", "x", F.col("peak_id_r").alias("i"), "g", "v")
    other = pairs.select("image_id", "y", "x", F.col("i").alias("j"), F.col("g").alias("h"))
    a = pairs.join(other, ["image_id", "y", "x"]).groupBy("image_id", "i", "j").agg(F.sum(F.col("g") * F.col("h")).alias("a"))
    b = pairs.groupBy("image_id", "i").agg(F.sum(F.col("g") * F.col("v")).alias("b"))
    return a, b


def linear_heights(pixels: DataFrame, params: DataFrame, reach: float, rounds: int = 500, tolerance: float = 1e-5) -> DataFrame:
    """Heights (image_id, peak_id, height), not negative, that fit best by projected Jacobi rounds.

    The matrix is a sparse table; each round is a join and a sum, so no image has to fit into one task.
    The step is damped by each row's absolute sum, so that the rounds converge for any overlap. They end
    when none moves a height by more than ``tolerance`` of the largest; it is looked at every tenth round.
    """
    a, b = normal_equations(pixels, params, reach)
    a = cut(a)
    rows = a.groupBy("image_id", "i").agg(F.sum(F.abs("a")).alias("w"))
    state = b.join(rows, ["image_id", "i"]).withColumn("h", F.lit(0.0))
    for k in range(rounds):
        ah = a.join(state.select("image_id", F.col("i").alias("j"), "h"), ["image_id", "j"]).groupBy("image_id", "i").agg(F.sum(F.col("a") * F.col("h")).alias("ah"))
        moved = F.greatest(F.lit(0.0), F.col("h") + (F.col("b") - F.col("ah")) / F.col("w"))
        new = state.join(ah, ["image_id", "i"]).withColumns({"move": F.abs(moved - F.col("h")), "h": moved}).drop("ah")
        state = cut(new)
        if k % 10 == 9:
            move, top = state.agg(F.max("move"), F.max("h")).first()
            if move is None or move <= tolerance * top:
                break
    else:
        warnings.warn(f"heights still move after {rounds} rounds", NotConverged, stacklevel=2)
    return state.select("image_id", F.col("i").alias("peak_id"), F.col("h").alias("height"))


def gradient(pixels: DataFrame, params: DataFrame, reach: float) -> DataFrame:
    """Derivatives of half the squared residual by x, y, height and sigma of each peak (params: those columns and background)."""
    pairs = _model_pairs(pixels, params, reach)
    total = Window.partitionBy("image_id", "y", "x")
    r = F.sum(F.col("height_r") * F.col("g")).over(total) + F.col("background_r") - F.col("v")
    hg = F.col("height_r") * F.col("g")
    s2 = F.col("sigma_r") * F.col("sigma_r")
    terms = {"gx": hg * (F.col("x") - F.col("x_r")) / s2, "gy": hg * (F.col("y") - F.col("y_r")) / s2, "gh": F.col("g"), "gs": hg * F.col("d2") / (s2 * F.col("sigma_r"))}
    return pairs.withColumn("r", r).groupBy("image_id", F.col("peak_id_r").alias("peak_id")).agg(*(F.sum(F.col("r") * t).alias(n) for n, t in terms.items()))


def loss(pixels: DataFrame, params: DataFrame, reach: float) -> float:
    """Half the squared residual over all pixels within reach of a peak."""
    at = _model_pairs(pixels, params, reach).groupBy("image_id", "y", "x").agg((F.sum(F.col("height_r") * F.col("g")) + F.first("background_r") - F.first("v")).alias("r"))
    return at.agg(F.sum(F.col("r") * F.col("r")) / 2).first()[0] or 0.0


#: Step sizes of Adam.
RATES = {"x": 0.05, "y": 0.05, "height": 0.05, "sigma": 0.02}


def adam_round(pixels: DataFrame, state: DataFrame, reach: float, k: int, rates: dict[str, float] | None = None, chosen: Column | None = None) -> DataFrame:
    """The parameters with their running means (m_*, s_*) after round k; ``chosen`` limits it to a batch of peaks."""
    rates, names = rates or RATES, {"x": "gx", "y": "gy", "height": "gh", "sigma": "gs"}
    j = state.join(gradient(pixels, state, reach), ["image_id", "peak_id"], "left")
    use = F.col("gx").isNotNull() if chosen is None else F.col("gx").isNotNull() & chosen
    new = {}
    for c, d in names.items():
        m = 0.9 * F.col(f"m_{c}") + 0.1 * F.col(d)
        s = 0.999 * F.col(f"s_{c}") + 0.001 * F.col(d) * F.col(d)
        step = rates[c] * (m / (1 - 0.9**k)) / (F.sqrt(s / (1 - 0.999**k)) + 1e-8)
        new |= {f"m_{c}": F.when(use, m).otherwise(F.col(f"m_{c}")), f"s_{c}": F.when(use, s).otherwise(F.col(f"s_{c}")), c: F.when(use, F.col(c) - step).otherwise(F.col(c))}
    new["sigma"] = F.greatest(F.lit(0.3), new["sigma"])
    return j.withColumns(new).drop(*names.values())


def adam_start(params: DataFrame) -> DataFrame:
    return params.withColumns({f"{m}_{c}": F.lit(0.0) for c in RATES for m in "ms"})


def fit_adam(pixels: DataFrame, params: DataFrame, reach: float, rounds: int = 1000, rates: dict[str, float] | None = None, tolerance: float = 1e-3, look: int = 5) -> DataFrame:
    """Adam on x, y, height and sigma of all peaks.

    It ends when ``look`` rounds change the squared residual by less than ``tolerance`` of it, or else warns.
    """
    state, pixels = adam_start(params), pixels.persist()
    last = loss(pixels, params, reach)
    for k in range(1, rounds + 1):
        state = cut(adam_round(pixels, state, reach, k, rates))
        if k % look == 0:
            now = loss(pixels, state, reach)
            if abs(last - now) <= tolerance * last:
                break
            last = now
    else:
        warnings.warn(f"the residual still changes after {rounds} rounds of Adam", NotConverged, stacklevel=2)
    pixels.unpersist()
    return state.select(*params.columns)


def refine_benchmark(pixels: DataFrame, peaks: DataFrame, atom_size: float = 0.7, dx: float = 1.0, **how) -> DataFrame:
    """Peaks (places in units of length, ``dx`` a pixel) fitted to an image: x, y (pixels), height, sigma, background, the
    fitted cross-section ``scs`` and the Voronoi sum ``scs_voronoi`` above the background, both in squared units of length,
    and whether the peak has settled.

    From start values of the width ``atom_size`` by blocks until the residual settles. Cells reach as far as five widths.
    """
    sigma = atom_size / dx
    start = init_params(pixels, peaks.withColumns({"x": F.col("x") / dx, "y": F.col("y") / dx}), sigma)
    fitted = fit_blocks(pixels, start, 3 * sigma, **how)
    flat = pixels.join(F.broadcast(pixels.groupBy("image_id").agg(F.min("v").alias("background"))), "image_id")
    cells = voronoi_integrate(flat.withColumn("v", F.col("v") - F.col("background")).drop("background"), fitted, 5 * sigma)
    scs = volume("gaussian", F.col("height"), F.col("sigma"), F.col("gamma"), F.col("ratio"), dx)
    voronoi = cells.select("image_id", "peak_id", (F.col("total") * dx * dx).alias("scs_voronoi"))
    return fitted.join(voronoi, ["image_id", "peak_id"]).select("image_id", "peak_id", "x", "y", "height", "sigma", "background", scs.alias("scs"), "scs_voronoi", "converged")


def solve(model: Callable[[np.ndarray], np.ndarray], start: np.ndarray, data: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, bool]:
    """Least squares by Levenberg-Marquardt with forward differences: parameters, and whether they have settled."""
    p, damp, done = start.astype(float), 1e-2, False
    r = model(p) - data
    for _ in range(rounds):
        steps = 1e-6 * np.maximum(1.0, np.abs(p))
        jac = np.stack([(model(p + h * e) - data - r) / h for h, e in zip(steps, np.eye(len(p)), strict=True)], axis=1)
        a, g = jac.T @ jac, jac.T @ r
        while damp < 1e12:
            move = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), -g, rcond=None)[0]
            new = model(p + move) - data
            if np.isfinite(new).all() and new @ new < r @ r:
                break
            damp *= 10
        else:
            return p, True  # no step of any length is better
        done = bool(np.abs(move).max() < 1e-9 or r @ r - new @ new <= 1e-12 * (r @ r))
        p, r, damp = p + move, new, damp / 10
        if done:
            break
    return p, done


def _peaks_model(x: np.ndarray, y: np.ndarray, kind: str) -> Callable[[np.ndarray], np.ndarray]:
    """Sum of n peaks with common widths and a constant: parameters x, y, h of each, then sigma, gamma, ratio, background."""

    def model(p: np.ndarray) -> np.ndarray:
        px, py, h = p[:-4].reshape(3, -1)
        sigma, gamma, ratio, base = p[-4:]
        d2 = (x[:, None] - px) ** 2 + (y[:, None] - py) ** 2
        if kind == "gaussian":
            f = np.exp(-d2 / (2 * sigma**2))
        elif kind == "lorentzian":
            f = (gamma**2 / (d2 + gamma**2)) ** 2
        else:
            f = ratio * np.exp(-d2 / (2 * sigma**2)) + (1 - ratio) * np.abs(gamma) ** 3 / (d2 + gamma**2) ** 1.5
        return f @ h + base

    return model


def fit_patches(pixels: DataFrame, params: DataFrame, tile: int, halo: int, kind: str = "gaussian", rounds: int = 60) -> DataFrame:
    """Tiles of the images fitted each with its halo; only peaks of the tile's own area are taken.

    Tiles are independent, so one pass is one shuffle of pixels (each to the tiles whose halo holds it) and peaks.
    ``converged`` tells whether the tile's fit has settled within the rounds; a tile without pixels keeps its start.
    """
    lo, hi = (lambda c: F.floor((F.col(c) - halo) / tile)), (lambda c: F.floor((F.col(c) + halo) / tile))

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("tx", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("ty", F.explode(F.sequence(lo("y"), hi("y"))))

    names = ["image_id", "peak_id", "x", "y", "height", "sigma", "gamma", "ratio", "background"]

    def fit(key: tuple, px: pd.DataFrame, pk: pd.DataFrame) -> pd.DataFrame:
        own = (np.floor(pk.x / tile) == key[1]) & (np.floor(pk.y / tile) == key[2])
        if not own.any() or not len(px):
            return pk.loc[own, names].assign(converged=True)
        start = np.concatenate([pk.x, pk.y, pk.height, [pk.sigma.mean(), pk.gamma.mean(), pk.ratio.mean(), pk.background.mean()]])
        p, settled = solve(_peaks_model(px.x.to_numpy(float), px.y.to_numpy(float), kind), start, px.v.to_numpy(float), rounds)
        out = pk[names].assign(converged=settled)
        out["x"], out["y"], out["height"] = p[:-4].reshape(3, -1)
        out["sigma"], out["gamma"], out["ratio"], out["background"] = abs(p[-4]), abs(p[-3]), p[-2], p[-1]
        return out[own]

    left = dealt(pixels.select("image_id", "y", "x", F.col("v").cast("double").alias("v"))).groupBy("image_id", "tx", "ty")
    right = dealt(params.select(*names)).groupBy("image_id", "tx", "ty")
    kinds = dict(params.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", converged boolean"
    return left.cogroup(right).applyInPandas(fit, schema)


def fit_cells(pixels: DataFrame, params: DataFrame, radius: float, rounds: int = 60) -> DataFrame:
    """Each Voronoi cell fitted with a single Gaussian; cells of few pixels keep their start. ``converged`` tells
    whether the fit has settled within the rounds."""
    cells = label_pixels(pixels, params, radius).filter("peak_id IS NOT NULL")
    start = params.select("image_id", "peak_id", F.col("x").alias("px"), F.col("y").alias("py"), "height", "sigma", "background")
    kinds = dict(params.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        p0 = np.array([one.px, one.py, one.height, one.sigma, 1.0, 1.0, one.background])
        p, settled = solve(_peaks_model(pdf.x.to_numpy(float), pdf.y.to_numpy(float), "gaussian"), p0, pdf.v.to_numpy(float), rounds) if len(pdf) > 5 else (p0, True)
        return pd.DataFrame({"image_id": [one.image_id], "peak_id": [one.peak_id], "x": [p[0]], "y": [p[1]], "height": [p[2]], "sigma": [abs(p[3])], "converged": [settled]})

    schema = f"image_id {kinds['image_id']}, peak_id long, x double, y double, height double, sigma double, converged boolean"
    fitted = cells.join(start, ["image_id", "peak_id"]).groupBy("image_id", "peak_id").applyInPandas(fit, schema)
    rest = params.join(fitted, ["image_id", "peak_id"], "left_anti").withColumn("converged", F.lit(True)).select(*fitted.columns)
    return fitted.unionByName(rest)


def refine_com_step(pixels: DataFrame, peaks: DataFrame, radius: float) -> DataFrame:
    """Centre of mass of each cell, its pixels scaled from 0 to 1; a flat or empty cell keeps its place."""
    cells = label_pixels(pixels, peaks, radius).filter("peak_id IS NOT NULL")
    ends = cells.groupBy("image_id", "peak_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    w = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    com = cells.join(ends, ["image_id", "peak_id"]).filter("hi > lo").groupBy("image_id", "peak_id").agg((F.sum(F.col("x") * w) / F.sum(w)).alias("cx"), (F.sum(F.col("y") * w) / F.sum(w)).alias("cy"))
    out = peaks.join(com, ["image_id", "peak_id"], "left")
    return out.withColumns({"x": F.coalesce("cx", "x"), "y": F.coalesce("cy", "y")}).select(*peaks.columns)


def refine_com(pixels: DataFrame, peaks: DataFrame, radius: float, rounds: int = 100, least: float = 1.0) -> DataFrame:
    """Steps until the mean move is below ``least`` pixels, or else a warning."""
    for k in range(rounds):
        new = cut(refine_com_step(pixels, peaks, radius))
        old = peaks.select("image_id", "peak_id", F.col("x").alias("ox"), F.col("y").alias("oy"))
        move = new.join(old, ["image_id", "peak_id"]).agg(F.avg((F.abs(F.col("x") - F.col("ox")) + F.abs(F.col("y") - F.col("oy"))) / 2)).first()[0]
        peaks = new
        if move is None or move < least:
            break
    else:
        warnings.warn(f"peaks still move after {rounds} rounds", NotConverged, stacklevel=2)
    return peaks


def calibrate(vectors: DataFrame, a: float, b: float) -> DataFrame:
    """Pixel size from lattice vectors in pixels and the cell's lengths: the mean of both ratios."""
    la = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay"))
    lb = F.sqrt(F.col("bx") * F.col("bx") + F.col("by") * F.col("by"))
    return vectors.withColumn("dx", (a / la + b / lb) / 2)


def fisher_information(pixels: DataFrame, params: DataFrame, reach: float) -> DataFrame:
    """Information of x, y and height under Poisson noise, one row for each image, peak and parameter pair: sum of df/dp df/dq / f."""
    pairs = _model_pairs(pixels, params, reach)
    f = F.sum(F.col("height_r") * F.col("g")).over(Window.partitionBy("image_id", "y", "x")) + F.col("background_r")
    s2 = F.col("sigma_r") * F.col("sigma_r")
    hg = F.col("height_r") * F.col("g")
    d = F.array(hg * (F.col("x") - F.col("x_r")) / s2, hg * (F.col("y") - F.col("y_r")) / s2, F.col("g"))
    terms = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.struct(F.floor(k / 3).alias("p"), (k % 3).alias("q")))
    each = pairs.withColumns({"f": f, "d": d}).filter("f > 0").select("image_id", F.col("peak_id_r").alias("peak_id"), "d", "f", F.explode(terms).alias("t"))
    value = F.get("d", F.col("t.p").cast("int")) * F.get("d", F.col("t.q").cast("int")) / F.col("f")
    return each.groupBy("image_id", "peak_id", F.col("t.p").cast("int").alias("p"), F.col("t.q").cast("int").alias("q")).agg(F.sum(value).alias("info"))


def cramer_rao(info: DataFrame) -> DataFrame:
    """Least standard errors (sx, sy, sh) of each peak: roots of the diagonal of the pseudo-inverse; and whether the image
    determines all three (the determinant isn't nothing against the product of the diagonal)."""

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((3, 3))
        m[pdf.p, pdf.q] = pdf["info"]
        s = np.sqrt(np.maximum(np.diag(np.linalg.pinv(m)), 0))
        determined = bool(np.linalg.det(m) > 1e-9 * np.prod(np.diag(m)))
        return pd.DataFrame([[pdf.image_id.iloc[0], pdf.peak_id.iloc[0], *s, determined]], columns=["image_id", "peak_id", "sx", "sy", "sh", "determined"])

    return info.groupBy("image_id", "peak_id").applyInPandas(bound, "image_id int, peak_id long, sx double, sy double, sh double, determined boolean")


def poisson_llh(pixels: DataFrame) -> DataFrame:
    """Poisson log-likelihood of v given model > 0, without the term that the data alone decide."""
    return pixels.groupBy("image_id").agg(F.sum(F.col("v") * F.log("model") - F.col("model")).alias("llh"))


def poisson_noise(pixels: DataFrame, seed: int = 0) -> DataFrame:
    """A Poisson draw with mean v for each pixel (0 below 0), told by a hash of its place, so that reruns agree.

    Pixels of a mean up to NORMAL count the terms of the distribution that a uniform number exceeds; above,
    the draw is a rounded normal one of the same mean and variance, with the correction of third order.
    """
    uniform = lambda n: (F.pmod(F.xxhash64(F.lit(seed), F.lit(n), "image_id", "y", "x"), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def draw(v: pd.Series, u: pd.Series, w: pd.Series) -> pd.Series:
        mean, u, w = np.maximum(v.to_numpy(float), 0.0), u.to_numpy(), w.to_numpy()
        z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * w)
        out = np.maximum(np.round(mean + np.sqrt(mean) * z + (z * z - 1) / 6), 0.0)
        low = mean <= NORMAL
        term = np.exp(-mean[low])
        below, k, few = term.copy(), 0, np.zeros(int(low.sum()))
        while (on := (u[low] > below) & (term > 0)).any():
            k += 1
            few[on] = k
            term = term * mean[low] / k
            below = below + term
        out[low] = few
        return pd.Series(out)

    return pixels.withColumn("v", F.pandas_udf(draw, "double")("v", uniform(1), uniform(2)))


def average_over(grid: DataFrame, points: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Mean of an expression over all quadrature points (a few rows, broadcast) for each key."""
    return grid.crossJoin(F.broadcast(points)).groupBy(*keys).agg(F.avg(value).alias("mean"))
