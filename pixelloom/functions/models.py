"""Peak models as column expressions, and images rendered from peaks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spatial import near_pairs

#: Least positive normal double: logarithms are clamped there.
TINY = 2.2250738585072014e-308


def r2(x: Column, y: Column, px: Column, py: Column) -> Column:
    return (x - px) * (x - px) + (y - py) * (y - py)


def gaussian(d2: Column, height: Column, width: Column) -> Column:
    return height * F.exp(-d2 / (2 * width * width))


def lorentzian(d2: Column, height: Column, gamma: Column) -> Column:
    return height * gamma * gamma / (d2 + gamma * gamma)


def lorentzian_squared(d2: Column, height: Column, gamma: Column) -> Column:
    """The form that image sums use; its plane integral is finite."""
    share = gamma * gamma / (d2 + gamma * gamma)
    return height * share * share


def voigt(d2: Column, height: Column, sigma: Column, gamma: Column, ratio: Column) -> Column:
    tail = F.pow(gamma, F.lit(3.0)) / F.pow(d2 + gamma * gamma, F.lit(1.5))
    return height * (ratio * F.exp(-d2 / (2 * sigma * sigma)) + (1 - ratio) * tail)


def rotated_gaussian(x: Column, y: Column, a: float, x0: float, y0: float, sx: float, sy: float, theta: float, offset: float) -> Column:
    """Elliptical Gaussian turned by theta."""
    c, s = math.cos(theta), math.sin(theta)
    u, v = (x - x0) * c + (y - y0) * s, (y - y0) * c - (x - x0) * s
    return F.lit(offset) + a * F.exp(-(u * u / (2 * sx * sx) + v * v / (2 * sy * sy)))


def render(pixels: DataFrame, peaks: DataFrame, model: Column, reach: float, background: float = 0.0) -> DataFrame:
    """Adds ``model``: the sum over the peaks closer than ``reach`` along both axes, plus the background.

    ``model`` is an expression over d2 and the peaks' columns with suffix ``_r``. Sums are combined before the shuffle.
    """
    sums = near_pairs(pixels, peaks, reach, box=True).groupBy("image_id", "y", "x").agg(F.sum(model).alias("model"))
    out = pixels.join(sums, ["image_id", "y", "x"], "left")
    return out.withColumn("model", F.coalesce("model", F.lit(0.0)) + background)


def volume(kind: str, height: Column, sigma: Column, gamma: Column, ratio: Column, dx: float = 1.0, exact: bool = False) -> Column:
    """Plane integral of a peak. ``exact`` gives the Voigt tail its full weight; without it, half."""
    g = 2 * math.pi * height * sigma * sigma * dx * dx
    l = math.pi * height * gamma * gamma * dx * dx  # noqa: E741
    return {"gaussian": g, "lorentzian": l, "voigt": ratio * g + (1 - ratio) * l * (2 if exact else 1)}[kind]


def butterworth(x: Column, y: Column, nx: int, ny: int, cutoff: float, order: int) -> Column:
    """Window that is 1 in the middle: the product of one factor for each axis, counted from the middle."""
    if not 0 < cutoff <= 0.5:
        raise ValueError("the cutoff lies above 0 and is at most 0.5")

    def along(c: Column, n: int) -> Column:
        return 1 / (1 + F.pow((c - n // 2) / (cutoff * n), F.lit(2 * order)))

    return along(x, nx) * along(y, ny)


def gaussian_filter(pixels: DataFrame, sigma: float, reach: int = 10) -> DataFrame:
    """Adds ``blur``: convolution with a normalised kernel of 2 reach + 1 steps a side, zero outside the image.

    The kernel is a product, so rows and then columns are summed, each pixel going out 2 (2 reach + 1) times.
    """
    total = sum(math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1))
    kernel = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(math.exp(-k * k / (2 * sigma * sigma)) / total).alias("w")) for k in range(-reach, reach + 1)))).alias("s")
    rows = pixels.select("image_id", "y", "x", "v", kernel).groupBy("image_id", "y", (F.col("x") + F.col("s.k")).alias("x")).agg(F.sum(F.col("v") * F.col("s.w")).alias("v"))
    both = rows.select("image_id", "y", "x", "v", kernel).groupBy("image_id", (F.col("y") + F.col("s.k")).alias("y"), "x").agg(F.sum(F.col("v") * F.col("s.w")).alias("blur"))
    return pixels.join(both, ["image_id", "y", "x"])


def power_curve(x: Column, a: float, b: float, c: float) -> Column:
    return F.pow(x, F.lit(a)) * b + c


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """By Horner's rule, highest degree first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + c
    return out


def safe_ln(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(TINY)))
