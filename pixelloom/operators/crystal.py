"""Crystal mapping: cells on images, displacement and strain."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grids import fft2
from ..plans.spatial import near_pairs
from .windows import local_maxima

Vector = tuple[float, float]


def align_cell(atoms: DataFrame, old: tuple[Vector, Vector], new: tuple[Vector, Vector], origin: Vector, dx: float, mode: str = "affine") -> DataFrame:
    """Atoms of a cell brought onto the image's vectors: rows times a matrix, then to pixels, then moved to the origin.

    affine: any linear map; perfect: the nearest rotation (or reflection, where the cells differ in handedness).
    """
    m = np.linalg.inv(np.array(old, float)) @ np.array(new, float)
    if mode == "perfect":
        u, _, vt = np.linalg.svd(m)
        m = u @ vt
    (a, b), (c, e) = m.tolist()
    x, y = F.col("x"), F.col("y")
    return atoms.withColumns({"x": (x * a + y * c) / dx + origin[0], "y": (x * b + y * e) / dx + origin[1]})


def tile_lattice(atoms: DataFrame, origins: DataFrame, nx: int, ny: int) -> DataFrame:
    """The cell's atoms at every origin of every image, within the image. The cell is a few rows and is broadcast."""
    cell = F.broadcast(atoms.select(F.col("idx"), "symbol", F.col("x").alias("cx"), F.col("y").alias("cy")))
    out = origins.crossJoin(cell).withColumns({"x": F.col("x") + F.col("cx"), "y": F.col("y") + F.col("cy")}).drop("cx", "cy")
    return out.filter((F.col("x") >= 0) & (F.col("x") < nx) & (F.col("y") >= 0) & (F.col("y") < ny))


def fft_peaks(pixels: DataFrame, nx: int, ny: int, k: int = 30, reach: int = 2) -> DataFrame:
    """The k strongest local maxima of each image's spectrum, under a Hann window: frequencies gx, gy in cycles a pixel.

    The middle (frequency 0) is left out; the log amplitude ranks, ties by place.
    """
    hann = lambda c, n: 0.5 - 0.5 * F.cos(2 * math.pi * (F.col(c) + 0.5) / n)
    mean = pixels.groupBy("image_id").agg(F.avg("v").alias("__mean"))
    flat = pixels.join(F.broadcast(mean), "image_id").withColumn("v", (F.col("v") - F.col("__mean")) * hann("x", nx) * hann("y", ny)).drop("__mean")
    power = fft2(flat).withColumn("v", F.log1p(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))))
    peaks = local_maxima(power.select("image_id", "y", "x", "v"), reach, 0.0, reach, nx, ny).filter((F.col("x") != nx // 2) | (F.col("y") != ny // 2))
    top = Window.partitionBy("image_id").orderBy(F.desc(F.round("v", 9)), "y", "x")
    best = peaks.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
    return best.select("image_id", "rank", ((F.col("x") - nx // 2) / nx).alias("gx"), ((F.col("y") - ny // 2) / ny).alias("gy"), "v")


def reciprocal_to_real(vectors: DataFrame) -> DataFrame:
    """g / |g|**2."""
    n = F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")
    return vectors.withColumns({"ax": F.col("gx") / n, "ay": F.col("gy") / n})


def displacement(peaks: DataFrame, ref: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    r = ref.select("image_id", "peak_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return peaks.join(r, ["image_id", "peak_id"]).select(
        "image_id", "peak_id", "rx", "ry", ((F.col("x") - F.col("rx")) * pixel_size).alias("ux"), ((F.col("y") - F.col("ry")) * pixel_size).alias("uy")
    )


def _strain(f00, f01, f10, f11) -> dict:
    """Small-strain parts of a deformation gradient."""
    return {"exx": f00 - 1, "eyy": f11 - 1, "exy": (f01 + f10) / 2, "omega": (f01 - f10) / 2}


def local_strain(peaks: DataFrame, ref: DataFrame, cutoff: float) -> DataFrame:
    """Strain by least squares over the neighbourhood in the reference: F = X inv(Y) with X = sum d d0', Y = sum d0 d0'.

    Null where the neighbours lie on one line or there are none.
    """
    moved = displacement(peaks, ref).select("image_id", "peak_id", F.col("rx").alias("x"), F.col("ry").alias("y"), "ux", "uy")
    pairs = near_pairs(moved, moved, cutoff).filter("peak_id <> peak_id_r")
    x0, y0 = F.col("x_r") - F.col("x"), F.col("y_r") - F.col("y")
    x1, y1 = x0 + F.col("ux_r") - F.col("ux"), y0 + F.col("uy_r") - F.col("uy")
    sums = {"a": x1 * x0, "b": x1 * y0, "c": y1 * x0, "d": y1 * y0, "p": x0 * x0, "q": x0 * y0, "r": y0 * y0}
    s = pairs.groupBy("image_id", "peak_id").agg(*(F.sum(e).alias(n) for n, e in sums.items()))
    a, b, c, d, p, q, r = (F.col(n) for n in "abcdpqr")
    det = p * r - q * q
    ok = F.when(F.abs(det) > 1e-9, det)
    f = _strain((a * r - b * q) / ok, (b * p - a * q) / ok, (c * r - d * q) / ok, (d * p - c * q) / ok)
    return peaks.select("image_id", "peak_id").join(s.select("image_id", "peak_id", *(e.alias(n) for n, e in f.items())), ["image_id", "peak_id"], "left")


def strain_along(peaks: DataFrame, ref: DataFrame, a: Vector, b: Vector, reach: float) -> DataFrame:
    """Strain from the displacement differences to the next columns along both lattice vectors.

    With the differences as rows of D and the vectors as rows of L, the gradient is inv(L) D. Null at the rim.
    """
    moved = displacement(peaks, ref).select("image_id", "peak_id", F.col("rx").alias("x"), F.col("ry").alias("y"), "ux", "uy")
    out = moved
    for name, (vx, vy) in (("a", a), ("b", b)):
        ahead = moved.withColumns({"x": F.col("x") + vx, "y": F.col("y") + vy})
        pairs = near_pairs(ahead, moved, reach)
        best = pairs.groupBy("image_id", "peak_id").agg(F.min(F.struct("d2", "peak_id_r", (F.col("ux_r") - F.col("ux")).alias("dx"), (F.col("uy_r") - F.col("uy")).alias("dy"))).alias(name))
        out = out.join(best, ["image_id", "peak_id"], "left")
    (i00, i01), (i10, i11) = np.linalg.inv(np.array([a, b], float)).tolist()
    ax, ay, bx, by = F.col("a.dx"), F.col("a.dy"), F.col("b.dx"), F.col("b.dy")
    g = {"xx": i00 * ax + i01 * bx, "xy": i00 * ay + i01 * by, "yx": i10 * ax + i11 * bx, "yy": i10 * ay + i11 * by}
    return out.select("image_id", "peak_id", g["xx"].alias("exx"), g["yy"].alias("eyy"), ((g["xy"] + g["yx"]) / 2).alias("exy"), ((g["yx"] - g["xy"]) / 2).alias("omega"))
