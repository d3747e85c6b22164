"""Electron optics as column expressions; complex values are structs of re and im."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of physics: electron rest energy in eV, and Planck's constant times light speed in eV Angstrom.
REST_ENERGY = 510998.9461
HC = 12398.419739

#: Coefficient, order n, symmetry m and description of the usual aberrations up to fifth order.
ABERRATIONS = (
    ("C10", 1, 0, "defocus"), ("C12", 1, 2, "two-fold astigmatism"), ("C21", 2, 1, "axial coma"), ("C23", 2, 3, "three-fold astigmatism"),
    ("C30", 3, 0, "spherical"), ("C32", 3, 2, "star"), ("C34", 3, 4, "four-fold astigmatism"), ("C41", 4, 1, "fourth-order coma"),
    ("C43", 4, 3, "three-lobe"), ("C45", 4, 5, "five-fold astigmatism"), ("C50", 5, 0, "fifth-order spherical"), ("C52", 5, 2, "fifth-order two-fold"),
    ("C54", 5, 4, "fifth-order four-fold"), ("C56", 5, 6, "six-fold astigmatism"),
)


def wavenumber(energy: Column) -> Column:
    """1/Angstrom at an energy in eV."""
    return F.sqrt(energy * (energy + 2 * REST_ENERGY)) / HC


def mass_correction(energy: Column) -> Column:
    return (energy + REST_ENERGY) / REST_ENERGY


def depth_of_field(energy: Column, alpha_mrad: Column) -> Column:
    return 1.77 / wavenumber(energy) / (alpha_mrad * alpha_mrad) * 1e6


def with_chi(grid: DataFrame, aberrations: DataFrame, wavelength: float, defocus: float, *keys: str) -> DataFrame:
    """Adds ``chi`` to grid rows (q, phi): the defocus term and all aberrations (amplitude, angle, n, m).

    The aberrations are a table of a few rows, broadcast and summed for each row; an angle counts only where m is not 0.
    """
    terms = F.broadcast(aberrations.agg(F.collect_list(F.struct("amplitude", "angle", "n", "m")).alias("__terms")))
    ql = F.col("q") * wavelength

    def add(acc: Column, a: Column) -> Column:
        angle = F.when(a["m"] == 0, F.lit(0.0)).otherwise(a["m"] * (F.col("phi") - a["angle"]))
        return acc + F.pow(ql, a["n"] + 1) * a["amplitude"] / (a["n"] + 1) * F.cos(angle)

    total = F.aggregate("__terms", ql * ql / 2 * defocus, add)
    return grid.crossJoin(terms).withColumn("chi", 2 * math.pi / wavelength * total).drop("__terms")  # one row


def transfer_function(chi: Column, q: Column, aperture: Column) -> Column:
    """exp(-i chi) inside the aperture, 0 outside."""
    open_ = q <= aperture
    zero = F.lit(0.0)
    return F.struct(F.when(open_, F.cos(chi)).otherwise(zero).alias("re"), F.when(open_, -F.sin(chi)).otherwise(zero).alias("im"))


def normalized(waves: DataFrame, wave: str = "ctf", key: str = "image_id") -> DataFrame:
    """Waves scaled so that their intensities add up to 1 in each image."""
    w = F.col(wave)
    total = waves.groupBy(key).agg(F.sqrt(F.sum(w["re"] * w["re"] + w["im"] * w["im"])).alias("__n"))
    return waves.join(F.broadcast(total), key).withColumn(wave, F.struct((w["re"] / F.col("__n")).alias("re"), (w["im"] / F.col("__n")).alias("im"))).drop("__n")


def plane_wave(x: Column, y: Column, nx: int, ny: int, kx: float, ky: float) -> Column:
    """Unit total intensity, tilted by whole or fractional frequencies."""
    phase = 2 * math.pi * (x * kx / nx + y * ky / ny)
    return F.struct((F.cos(phase) / math.sqrt(nx * ny)).alias("re"), (F.sin(phase) / math.sqrt(nx * ny)).alias("im"))


def energy_spread(value: Column, convention: str) -> Column:
    """Standard deviation from a spread given as std, FWHM or 1/e half width."""
    factors = {"std": 1.0, "FWHM": 1 / (2 * math.sqrt(2 * math.log(2))), "1/e": 1 / math.sqrt(2)}
    if convention not in factors:
        raise ValueError(f"no such convention: {convention}")
    return value * factors[convention]


def defocus_density(df: Column, cc: float, spread: float, energy: float) -> Column:
    """Gaussian density of the defocus that an energy spread (std) makes through chromatic aberration."""
    width = cc * spread / energy
    return F.exp(-df * df / (2 * width * width)) / (width * math.sqrt(2 * math.pi))


def quadrature(rows: DataFrame, n: int, cc: float, spread: Column, energy: Column) -> DataFrame:
    """Each row n times, with ``node`` (from 0) and ``df``: defocus values of equal probability, the middle quantile of each n-th part."""
    points = F.array(*(F.lit(NormalDist().inv_cdf((k + 0.5) / n)) for k in range(n)))
    out = rows.select("*", F.posexplode(points).alias("node", "df"))
    return out.withColumn("df", F.col("df") * (F.lit(float(cc)) * spread / energy))


def tilt(value: Column, units: str, wavelength: Column, size: Column, to: str) -> Column:
    """mrad to inverse Angstrom or to whole pixels of a grid of that size."""
    inverse = {"mrad": value * 1e-3 / wavelength, "invA": value, "pixels": value / size}[units]
    return inverse if to == "invA" else F.round(inverse * size)


def named_phase(kx: Column, ky: Column, wavelength: float, coefficients: dict[str, float]) -> Column:
    """Phase of C1, A1, A2, B2, C3, A3 and C5 on a plane of spatial frequencies; A and B act along x."""
    u, v = kx * wavelength, ky * wavelength
    rr = u * u + v * v
    zero = F.lit(0.0)
    forms = {
        "C1": rr / 2, "A1": (u * u - v * v) / 2, "A2": (u * u * u - 3 * u * v * v) / 3, "B2": rr * u,
        "C3": rr * rr / 4, "A3": (u * u * u * u - 6 * u * u * v * v + v * v * v * v) / 4, "C5": rr * rr * rr / 6,
    }
    return 2 * math.pi / wavelength * sum((c * forms[k] for k, c in coefficients.items()), zero)


def phase_contrast(u: Column, defocus: float, cs: float, wavelength: float) -> Column:
    return F.sin(math.pi * wavelength * u * u * (0.5 * cs * wavelength * wavelength * u * u - defocus))
