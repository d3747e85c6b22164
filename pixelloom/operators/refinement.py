"""Fits of peak models that run until they settle, on images of any size.

``fit_blocks`` goes over the image by blocks: a residual image is kept as a table, each block takes the
model of its own peaks out of it, fits them in the worker with the others held, and puts them back.
``fit_all`` moves all parameters of all peaks at once by Gauss-Newton steps whose sums are one grouped
aggregate. ``fit_rotated`` does so for one elliptical Gaussian for each image.
"""

from __future__ import annotations

import math
import random
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import gaussian, lorentzian_squared, voigt
from ..plans.loops import NotConverged, cut
from ..plans.spatial import near_pairs

#: Parameters that a fit of each model moves.
MOVED = {"gaussian": ("x", "y", "height", "sigma"), "lorentzian": ("x", "y", "height", "gamma"), "voigt": ("x", "y", "height", "sigma", "gamma", "ratio")}
NAMES = ("x", "y", "height", "sigma", "gamma", "ratio")
#: Least width in pixels.
NARROWEST = 0.3
#: Peaks that are fitted together within a block.
TOGETHER = 48


def _shape(kind: str, dx: np.ndarray, dy: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The model of height 1 and the derivatives of the model by each parameter."""
    d2, h, s, c = dx * dx + dy * dy, p["height"], p["sigma"], p["gamma"]
    if kind == "gaussian":
        f = np.exp(-d2 / (2 * s * s))
        slope, own = f / (s * s), {"sigma": h * f * d2 / s**3}
    elif kind == "lorentzian":
        f = (c * c / (d2 + c * c)) ** 2
        slope, own = 4 * f / (d2 + c * c), {"gamma": h * f * 4 * d2 / (c * (d2 + c * c))}
    else:
        g, t, m = np.exp(-d2 / (2 * s * s)), np.abs(c) ** 3 / (d2 + c * c) ** 1.5, p["ratio"]
        f = m * g + (1 - m) * t
        slope = m * g / (s * s) + (1 - m) * 3 * t / (d2 + c * c)
        own = {"sigma": h * m * g * d2 / s**3, "gamma": h * (1 - m) * t * (3 / c - 3 * c / (d2 + c * c)), "ratio": h * (g - t)}
    return f, {"x": h * slope * dx, "y": h * slope * dy, "height": f, **own}


class _Window:
    """Pixels round a few peaks and the sum of these peaks' models on them, cut off at ``reach``."""

    def __init__(self, kind: str, x: np.ndarray, y: np.ndarray, reach: float):
        self.kind, self.x, self.y, self.reach = kind, x, y, reach

    def model(self, p: dict[str, np.ndarray], names: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The sum, and its derivatives by ``names`` of each peak, name by name."""
        dx, dy = self.x[:, None] - p["x"], self.y[:, None] - p["y"]
        near = np.maximum(np.abs(dx), np.abs(dy)) < self.reach
        f, by = _shape(self.kind, dx, dy, p)
        return (p["height"] * f * near).sum(axis=1), np.concatenate([by[n] * near for n in names], axis=1) if names else np.zeros((len(dx), 0))


def _limited(p: dict[str, np.ndarray], box: tuple[float, float, float, float], widest: float) -> dict[str, np.ndarray]:
    """Parameters within their bounds: places in the box, heights not negative, widths between the least and ``widest``."""
    ends = {"x": box[:2], "y": box[2:], "height": (0.0, np.inf), "sigma": (NARROWEST, widest), "gamma": (NARROWEST, widest), "ratio": (0.0, 1.0)}
    return {n: np.clip(v, *ends[n]) for n, v in p.items()}


def _fitted(w: _Window, target: np.ndarray, p: dict[str, np.ndarray], names: tuple[str, ...], box: tuple, rounds: int) -> dict[str, np.ndarray]:
    """Levenberg-Marquardt on a few peaks, projected onto the bounds."""
    damp = 1e-3
    f, jac = w.model(p, names)
    r = f - target
    for _ in range(rounds):
        a, g = jac.T @ jac, jac.T @ r
        while damp < 1e8:
            move = np.linalg.solve(a + np.diag(damp * np.diag(a) + 1e-9), -g)
            new = _limited(p | dict(zip(names, [p[n] + m for n, m in zip(names, np.split(move, len(names)), strict=True)], strict=True)), box, w.reach)
            off = w.model(new)[0] - target
            if np.isfinite(off).all() and off @ off < r @ r:
                break
            damp *= 10
        else:
            break
        gain = r @ r - off @ off
        p, damp = new, max(damp / 10, 1e-9)
        f, jac = w.model(p, names)
        settled, r = gain <= 1e-4 * (r @ r), off
        if settled:
            break
    return p


def _tile(c: str, edge: float, off: float) -> Column:
    return F.floor((F.col(c) - off) / edge).cast("long")


def _core(reach: float) -> float:
    """The width of a square's middle."""
    return max(4 * reach, 8.0)


def _spread(state: DataFrame, reach: float) -> int:
    """Partitions for a pass over the squares of ``state``: one for each three squares' pixels, up to Spark's own number.
    By the bytes, which are few for the work of a fit, Spark would put the squares of many images into one task."""
    squares = state.count() / (2 * _core(reach)) ** 2
    return max(1, min(math.ceil(squares / 3), int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _sweep(state: DataFrame, kind: str, names: tuple[str, ...], reach: float, rounds: int, seed: int, parts: int) -> DataFrame:
    """Every peak fitted once: four passes over squares that partition the images, each with the peaks of its middle.

    ``state`` has pixels with their residual ``r`` and peaks (``peak`` is true) in one table. A square is twice as wide
    as its middle, and no peak's model reaches beyond the square, so all squares of a pass can be fitted at once, in
    ``parts`` partitions.
    """
    core = _core(reach)
    wide, slack = 2 * core, core / 2 - reach
    rng = random.Random(seed)
    ox, oy = rng.uniform(0, wide), rng.uniform(0, wide)

    def one_pass(sx: float, sy: float) -> DataFrame:
        def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            # in one order, so that sums are the same however the rows came
            pdf = pdf.drop(columns=["__tx", "__ty"]).sort_values(["peak", "peak_id", "y", "x"], ignore_index=True)
            x0, y0 = key[1] * wide + ox + sx + core / 2, key[2] * wide + oy + sy + core / 2
            peak = pdf.peak.to_numpy(bool)
            px, py = pdf.x.to_numpy(float), pdf.y.to_numpy(float)
            own = np.flatnonzero(peak & (px >= x0) & (px < x0 + core) & (py >= y0) & (py < y0 + core))
            lit = np.flatnonzero(~peak)
            if not len(own) or not len(lit):
                return pdf
            own = own[np.lexsort((pdf.peak_id.to_numpy()[own], np.floor(px[own] / reach), np.floor(py[own] / reach)))]
            # no farther than the model may reach, and not out of the image
            box = (max(x0 - slack, px[lit].min()), min(x0 + core + slack, px[lit].max()), max(y0 - slack, py[lit].min()), min(y0 + core + slack, py[lit].max()))
            r = pdf.r.to_numpy(float).copy()
            values = {n: pdf[n].to_numpy(float).copy() for n in (*NAMES, "moved")}
            for at in range(0, len(own), TOGETHER):
                some = own[at : at + TOGETHER]
                p = {n: values[n][some] for n in NAMES}
                far = reach + slack
                near = lit[(px[lit] > p["x"].min() - far) & (px[lit] < p["x"].max() + far) & (py[lit] > p["y"].min() - far) & (py[lit] < p["y"].max() + far)]
                before = _Window(kind, px[lit], py[lit], reach)
                target = r[lit] + before.model(p)[0]
                inside = np.isin(lit, near)
                new = _fitted(_Window(kind, px[near], py[near], reach), target[inside], p, names, box, rounds)
                r[lit] = target - before.model(new)[0]
                step = np.max([np.abs(new[n] - p[n]) / (1.0 if n in ("x", "y") else np.maximum(np.abs(p[n]), 1e-9)) for n in names], axis=0)
                for n in NAMES:
                    values[n][some] = new[n]
                values["moved"][some] = np.maximum(values["moved"][some], step)
            return pdf.assign(r=r, **values)

        tiles = {"__tx": _tile("x", wide, ox + sx), "__ty": _tile("y", wide, oy + sy)}
        dealt = state.withColumns(tiles).repartition(parts, "image_id", *tiles)
        return dealt.groupBy("image_id", *tiles).applyInPandas(fit, state.schema)

    for sx, sy in rng.sample([(0.0, 0.0), (core, 0.0), (0.0, core), (core, core)], 4):
        state = one_pass(sx, sy)
    return cut(state)


def _model(kind: str, suffix: str = "_r") -> Column:
    height, sigma, gamma, ratio = (F.col(n + suffix) for n in NAMES[2:])
    d2 = F.col("d2")
    return {"gaussian": lambda: gaussian(d2, height, sigma), "lorentzian": lambda: lorentzian_squared(d2, height, gamma), "voigt": lambda: voigt(d2, height, sigma, gamma, ratio)}[kind]()


def residual(pixels: DataFrame, params: DataFrame, reach: float, kind: str = "gaussian") -> DataFrame:
    """(image_id, y, x, r): the image less the background and the models of all peaks, cut off at ``reach``."""
    sums = near_pairs(pixels, params, reach, box=True).groupBy("image_id", "y", "x").agg(F.sum(_model(kind)).alias("model"))
    base = params.groupBy("image_id").agg(F.avg("background").alias("background"))
    out = pixels.join(sums, ["image_id", "y", "x"], "left").join(base, "image_id", "left")
    return out.select("image_id", "y", "x", (F.col("v") - F.coalesce("background", F.lit(0.0)) - F.coalesce("model", F.lit(0.0))).alias("r"))


def _levelled(state: DataFrame) -> DataFrame:
    """The background raised by the mean residual of each image."""
    mean = state.filter("NOT peak").groupBy("image_id").agg(F.avg("r").alias("mean"))
    out = state.join(mean, "image_id", "left")
    shift = F.coalesce("mean", F.lit(0.0))
    return out.withColumns({"r": F.col("r") - shift, "background": F.col("background") + shift}).select(*state.columns)


def fit_blocks(
    pixels: DataFrame, params: DataFrame, reach: float, kind: str = "gaussian", epochs: int = 40, tolerance: float = 1e-3, rounds: int = 50, background: bool = True, seed: int = 0
) -> DataFrame:
    """All peaks fitted by block coordinates, with a column ``converged`` (the peak moved by less than 0.01, in pixels
    or of its value, in the last epoch).

    Heights alone first and last (a linear fit of each block), in between epochs in which every peak is fitted once with
    its neighbours in a block to convergence, and the background levelled. Blocks lie anew in each epoch. It ends when
    an epoch lessens the squared residual by less than ``tolerance`` of it, or else warns.
    """
    kinds = dict(params.dtypes)
    pixels, params = cut(pixels), cut(params)
    nothing = [F.lit(0.0).alias(n) for n in (*NAMES[2:], "background", "moved")]
    lit = residual(pixels, params, reach, kind).select("image_id", F.lit(False).alias("peak"), F.lit(0).cast("long").alias("peak_id"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "r", *nothing)
    peaks = params.select("image_id", F.lit(True).alias("peak"), F.col("peak_id").cast("long").alias("peak_id"), *(F.col(n).cast("double").alias(n) for n in (*NAMES, "background")), F.lit(0.0).alias("r"), F.lit(0.0).alias("moved"))
    state = cut(lit.unionByName(peaks))
    parts = _spread(state, reach)
    state = _sweep(state, kind, ("height",), reach, rounds, -1, parts)
    sums = lambda: state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    last = sums()
    for k in range(epochs):
        state = (_levelled(state) if background else state).withColumn("moved", F.lit(0.0))
        state = _sweep(state, kind, MOVED[kind], reach, rounds, seed + k, parts)
        now = sums()
        if last - now <= tolerance * last:
            break
        last = now
    else:
        warnings.warn(f"the residual still falls after {epochs} epochs", NotConverged, stacklevel=2)
    moved = state.filter("peak").select("image_id", "peak_id", (F.col("moved") < 0.01).alias("converged"))
    state = _sweep(state, kind, ("height",), reach, rounds, -2, parts)
    out = state.filter("peak").join(moved, ["image_id", "peak_id"])
    new = [F.col(n).cast(kinds[n]).alias(n) for n in (*NAMES, "background")]
    rest = params.drop(*NAMES, "background", "converged")
    return rest.join(out.select("image_id", "peak_id", *new, "converged"), ["image_id", "peak_id"]).select(*[c for c in params.columns if c != "converged"], "converged")


def _slopes(kind: str) -> tuple[Column, dict[str, Column]]:
    """As ``_shape`` has it, over the columns of pixel-peak pairs."""
    dx, dy, d2 = F.col("x") - F.col("x_r"), F.col("y") - F.col("y_r"), F.col("d2")
    h, s, c, m = (F.col(n + "_r") for n in NAMES[2:])
    q = d2 + c * c
    if kind == "gaussian":
        f = gaussian(d2, F.lit(1.0), s)
        slope, own = f / (s * s), {"sigma": h * f * d2 / (s * s * s)}
    elif kind == "lorentzian":
        f = lorentzian_squared(d2, F.lit(1.0), c)
        slope, own = 4 * f / q, {"gamma": h * f * 4 * d2 / (c * q)}
    else:
        g, t = gaussian(d2, F.lit(1.0), s), voigt(d2, F.lit(1.0), s, c, F.lit(0.0))
        f = m * g + (1 - m) * t
        slope, own = m * g / (s * s) + (1 - m) * 3 * t / q, {"sigma": h * m * g * d2 / (s * s * s), "gamma": h * (1 - m) * t * (3 / c - 3 * c / q), "ratio": h * (g - t)}
    return f, {"x": h * slope * dx, "y": h * slope * dy, "height": f, **own}


def normal_sums(pixels: DataFrame, params: DataFrame, reach: float, kind: str = "gaussian") -> DataFrame:
    """``params`` with, for each peak, ``g`` (derivatives of half the squared residual), ``a`` (its own part of the normal
    matrix, by rows) and ``loss`` (its share of half the squared residual).

    Each pixel's part is scaled by the sum of all models there over the peak's own. Then the parts of the peaks
    bound the whole matrix from above, and all peaks can step at once. Per pixel and per peak: sums, combined before the shuffle.
    """
    f, slopes = _slopes(kind)
    names = MOVED[kind]
    pairs = near_pairs(pixels, params, reach, box=True).withColumn("f", f + 1e-12)
    at = Window.partitionBy("image_id", "y", "x")
    joined = pairs.withColumns({"model": F.sum(F.col("height_r") * F.col("f")).over(at), "whole": F.sum("f").over(at)})
    joined = joined.withColumns({f"d_{n}": slopes[n] for n in names} | {"off": F.col("model") + F.col("background_r") - F.col("v"), "share": F.col("f") / F.col("whole")})
    d = [F.col(f"d_{n}") for n in names]
    sums = [F.sum(F.col("off") * x) for x in d]
    square = {(i, j): F.sum(d[i] * d[j] / F.col("share")) for i in range(len(d)) for j in range(i, len(d))}
    whole = F.array(*(square[min(i, j), max(i, j)] for i in range(len(d)) for j in range(len(d))))
    each = joined.groupBy("image_id", F.col("peak_id_r").alias("peak_id")).agg(F.array(*sums).alias("g"), whole.alias("a"), F.sum(F.col("off") * F.col("off") * F.col("share") / 2).alias("loss"))
    return params.join(each, ["image_id", "peak_id"], "left")


def _stepped(state: DataFrame, kind: str, length: float, reach: float, columns: list[str]) -> DataFrame:
    """Parameters after a Gauss-Newton step of each peak, ``length`` times as far but at most a pixel."""
    names = MOVED[kind]
    schema = state.select(*columns).schema

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            has = b.a.notna().to_numpy()
            if has.any():
                a = np.stack(b.a[has]).reshape(-1, len(names), len(names))
                g = np.stack(b.g[has])
                diagonal = np.einsum("kii->ki", a)
                diagonal += 1e-3 * diagonal + 1e-9
                move = -length * np.linalg.solve(a, g[:, :, None])[:, :, 0]
                far = np.abs(move[:, :2]).max(axis=1, keepdims=True)
                move /= np.maximum(far, 1.0)
                p = {n: b.loc[has, n].to_numpy(float) + move[:, i] for i, n in enumerate(names)}
                for n, v in _limited(p, (-np.inf, np.inf, -np.inf, np.inf), reach).items():
                    b.loc[has, n] = v
            yield b[columns]

    return state.mapInPandas(step, schema)


def fit_all(pixels: DataFrame, params: DataFrame, reach: float, kind: str = "gaussian", rounds: int = 1000, tolerance: float = 1e-3, look: int = 2) -> DataFrame:
    """All parameters of all peaks at once, by Gauss-Newton steps of a common length; the background stays.

    Steps grow while they lessen the squared residual; one that doesn't is taken back and halved. It ends when
    ``look`` rounds lessen it by less than ``tolerance`` of it, or else warns.
    """
    columns = params.columns
    params = params.select(*(F.col(c).cast("double").alias(c) if c in NAMES else F.col(c) for c in columns))
    best, length, past, pixels = None, 1.0, [], cut(pixels)
    for _ in range(rounds):
        new = cut(normal_sums(pixels, params, reach, kind))
        loss = new.agg(F.sum("loss")).first()[0] or 0.0
        if best is None or loss < past[-1]:
            best, length = new, 1.3 * length
            past.append(loss)
            if len(past) > look and past[-1 - look] - loss <= tolerance * past[-1 - look]:
                break
        else:
            length /= 2
            if length < 1e-6:
                break
        params = _stepped(best, kind, length, reach, columns)
    else:
        warnings.warn(f"the residual still falls after {rounds} rounds", NotConverged, stacklevel=2)
    return best.select(*columns)


#: Parameters of the elliptical Gaussian.
ROTATED = ("a", "x0", "y0", "sx", "sy", "theta", "offset")


def _rotated_sums(pixels: DataFrame, state: DataFrame) -> DataFrame:
    """(image_id, now, g, m): half the squared residual at the trial parameters, its derivatives, and the normal matrix by rows."""
    a, x0, y0, sx, sy, theta, offset = (F.get("trial", F.lit(i)) for i in range(7))
    tried = pixels.join(state.filter("NOT converged").select("image_id", "trial"), "image_id")
    c, s, x, y = F.cos(theta), F.sin(theta), F.col("x") - x0, F.col("y") - y0
    tried = tried.select("image_id", "v", "trial", c.alias("c"), s.alias("s"), (x * c + y * s).alias("u"), (y * c - x * s).alias("w"))
    u, w, c, s = (F.col(n) for n in "uwcs")
    p, q = u / (sx * sx), w / (sy * sy)
    e = F.exp(-(u * p + w * q) / 2)
    tried = tried.withColumn("e", e)
    ae = a * F.col("e")
    slopes = (F.col("e"), ae * (p * c - q * s), ae * (p * s + q * c), ae * u * p / sx, ae * w * q / sy, -ae * (p * w - q * u), F.lit(1.0))
    tried = tried.select("image_id", (offset + ae - F.col("v")).alias("r"), *(d.alias(f"d{i}") for i, d in enumerate(slopes)))
    d, r = [F.col(f"d{i}") for i in range(7)], F.col("r")
    square = {(i, j): F.sum(d[i] * d[j]) for i in range(7) for j in range(i, 7)}
    matrix = F.array(*(square[min(i, j), max(i, j)] for i in range(7) for j in range(7)))
    return tried.groupBy("image_id").agg((F.sum(r * r) / 2).alias("now"), F.array(*(F.sum(r * x) for x in d)).alias("g"), matrix.alias("m"))


def fit_rotated(pixels: DataFrame, start: dict[str, float], rounds: int = 200) -> DataFrame:
    """One rotated elliptical Gaussian for each image, of any size: a, x0, y0, sx, sy, theta, offset, and whether the fit has settled.

    ``start`` has the parameters to start from; the amplitude and the offset come from the image unless they are given.
    The centre stays within the image, and the widths below its size.
    A round is one grouped sum over all pixels and a system of seven equations for each image.
    """
    pixels = cut(pixels.select("image_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("v").cast("double").alias("v")))
    guess = {"a": F.max("v") - F.min("v"), "offset": F.min("v")} | {n: F.lit(float(v)) for n, v in start.items()}
    ends = F.struct(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))))
    first = pixels.groupBy("image_id").agg(F.array(*(guess[n].cast("double") for n in ROTATED)).alias("trial"), ends.alias("ends"))
    state = first.select("image_id", "ends", F.col("trial").alias("p"), "trial", F.lit(math.inf).alias("loss"), F.lit(1e-2).alias("damp"), *(F.lit(None).cast("array<double>").alias(c) for c in "gm"), F.lit(False).alias("converged"))
    schema = state.schema

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                e0, p, trial, loss, damp, g, m, done = r.ends, r.p, r.trial, r.loss, r.damp, r.g, r.m, bool(r.converged)
                if not done and r.now is not None and not np.isnan(r.now):
                    moved = np.abs(np.asarray(trial) - np.asarray(p)).max()
                    if r.now < loss:
                        done = bool(math.isfinite(loss) and loss - r.now <= 1e-4 * loss)
                        p, loss, damp, g, m = trial, r.now, damp / 10, r.new_g, r.new_m
                    else:
                        damp *= 10
                        done = bool(damp > 1e10 or 0 < moved < 1e-10)
                    a = np.asarray(m, float).reshape(7, 7)
                    trial = np.asarray(p) - np.linalg.lstsq(a + np.diag(damp * np.diag(a) + 1e-12), np.asarray(g, float), rcond=None)[0]
                    e = r.ends
                    size = max(e["high_x"] - e["low_x"], e["high_y"] - e["low_y"], 1.0)
                    widths = np.sign(trial[3:5]) * np.clip(np.abs(trial[3:5]), NARROWEST, size)
                    trial = np.concatenate((trial[:1], np.clip(trial[1:3], (e["low_x"], e["low_y"]), (e["high_x"], e["high_y"])), widths, trial[5:]))
                out.append((r.image_id, e0, p, trial, loss, damp, g, m, done))
            yield pd.DataFrame(out, columns=schema.names)

    state = cut(state)
    for _ in range(rounds):
        sums = _rotated_sums(pixels, state).withColumnsRenamed({"g": "new_g", "m": "new_m"})
        state = cut(state.join(sums, "image_id", "left").mapInPandas(update, schema))
        if state.filter("NOT converged").isEmpty():
            break
    else:
        warnings.warn(f"fits still move after {rounds} rounds", NotConverged, stacklevel=2)
    value = lambda i, n: (F.abs(F.get("p", F.lit(i))) if n in ("sx", "sy") else F.get("p", F.lit(i))).alias(n)
    return state.select("image_id", *(value(i, n) for i, n in enumerate(ROTATED)), "converged")
