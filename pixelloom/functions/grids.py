"""Grids, vectors and Fourier functions. A row or column of an image is the unit of a Fourier transform."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def q_grid(pixels: DataFrame, dx: float, dy: float) -> DataFrame:
    """(image_id, y, x, qx, qy): the frequencies of each image's samples, whose pixels are ``dx`` by ``dy``."""
    along = lambda c, n, step: F.when(F.col(c) < F.floor((F.col(n) + 1) / 2), F.col(c)).otherwise(F.col(c) - F.col(n)) / (F.col(n) * F.lit(float(step)))
    return _sized(pixels).select("image_id", "y", "x", along("x", "nx", dx).alias("qx"), along("y", "ny", dy).alias("qy"))


def rotate(x: Column, y: Column, z: Column, axis: tuple[float, float, float], angle: float) -> tuple[Column, Column, Column]:
    """A vector turned about an axis, by the rotation matrix of axis and angle."""
    a = np.array(axis, float) / np.linalg.norm(axis)
    cross = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    m = np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * (cross @ cross)
    return tuple(float(r[0]) * x + float(r[1]) * y + float(r[2]) * z for r in m)


def _along(df: DataFrame, axis: str, other: str, n: str, made: str, transform) -> DataFrame:
    """Transforms (re, im) along one axis: a group is one line of an image, its length is in the column ``n``.

    ``transform`` turns the line's numbers (0 where there are none) and gives new ones, counted by ``made``.
    """
    kind = dict(df.dtypes)
    kept = [c for c in df.columns if c not in (axis, other, "image_id", "re", "im")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros(int(pdf[n].iloc[0]), complex)
        line[pdf[axis].to_numpy()] = pdf.re.to_numpy() + 1j * pdf.im.to_numpy()
        out = transform(line)
        return pd.DataFrame({"image_id": pdf.image_id.iloc[0], other: pdf[other].iloc[0], **{c: pdf[c].iloc[0] for c in kept}, made: np.arange(len(out)), "re": out.real, "im": out.imag})

    schema = f"image_id {kind['image_id']}, {other} {kind[other]}, " + "".join(f"{c} {kind[c]}, " for c in kept) + f"{made} int, re double, im double"
    return df.groupBy("image_id", other).applyInPandas(run, schema)


def _sized(waves: DataFrame) -> DataFrame:
    """Adds the width and height (nx, ny) of each image: one row for each, so that the table is broadcast."""
    ends = waves.groupBy("image_id").agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"))
    return waves.join(F.broadcast(ends), "image_id")


def _transform(waves: DataFrame, f) -> DataFrame:
    """Both axes, first along the rows and then along the columns."""
    rows = _along(_sized(waves.select("image_id", "y", "x", "re", "im")), "x", "y", "nx", "u", f)
    # a row that the image lacks is 0 and stays so; the columns are of full length
    return _along(rows, "y", "u", "ny", "v", f).select("image_id", F.col("v").alias("y"), F.col("u").alias("x"), "re", "im")


def _waves(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "y", "x", F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))


def fft2(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, re, im): transform of each image with frequency 0 in the middle."""
    return _transform(_waves(pixels), lambda line: np.fft.fftshift(np.fft.fft(np.fft.ifftshift(line))))


def ifft2(waves: DataFrame) -> DataFrame:
    """(image_id, y, x, re, im): back from a transform with frequency 0 in the middle; a probe from its transfer function."""
    return _transform(waves, lambda line: np.fft.fftshift(np.fft.ifft(np.fft.ifftshift(line))))


def band_pass(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """Each image with only the frequencies (in cycles a sample) from ``low`` to below ``high``."""
    waves = _sized(fft2(pixels))
    along = lambda c, n: (F.col(c) - F.floor(F.col(n) / 2)) / F.col(n)
    f = F.sqrt(along("x", "nx") * along("x", "nx") + along("y", "ny") * along("y", "ny"))
    kept = (f >= low) & (f < high)
    cut = {c: F.when(kept, F.col(c)).otherwise(0.0) for c in ("re", "im")}
    return ifft2(waves.withColumns(cut).drop("nx", "ny")).select("image_id", "y", "x", F.col("re").alias("v"))


def fourier_zoom(pixels: DataFrame, center: tuple[float, float], factor: float, shape: tuple[int, int]) -> DataFrame:
    """Fourier interpolation of each image on a fine grid round a place (x, y): first along the rows, then along the columns."""
    ys, xs = (c + (np.arange(n) - n // 2) / factor for c, n in ((center[1], shape[0]), (center[0], shape[1])))

    def at(places: np.ndarray):
        def interpolate(line: np.ndarray) -> np.ndarray:
            n = len(line)
            return np.exp(2j * np.pi * np.outer(places, np.fft.fftfreq(n) * n) / n) @ np.fft.fft(line) / n

        return interpolate

    rows = _along(_sized(_waves(pixels)), "x", "y", "nx", "j", at(xs))
    out = _along(rows, "y", "j", "ny", "i", at(ys))
    place = lambda k, c, n: c + (F.col(k) - n // 2) / factor
    return out.select("image_id", "i", "j", place("i", center[1], shape[0]).alias("y"), place("j", center[0], shape[1]).alias("x"), F.col("re").alias("v"))


def seeds(peaks: DataFrame) -> DataFrame:
    """Rounded places of peaks with labels from 1, so that none is the background; a place's last peak wins."""
    at = peaks.select("image_id", F.round("y").cast("int").alias("y"), F.round("x").cast("int").alias("x"), (F.col("peak_id") + 1).alias("label"))
    return at.groupBy("image_id", "y", "x").agg(F.max("label").alias("label"))


#: Chemical symbols in the order of atomic numbers, X for 0.
SYMBOLS = (
    "X H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()


def column_elements(atoms: DataFrame, elements: list[str]) -> DataFrame:
    """Adds the symbol of each atomic number ``z`` and its place in ``elements`` (null where it isn't there)."""
    names = F.array(*map(F.lit, SYMBOLS))
    symbol = F.get(names, F.col("z"))
    at = F.array_position(F.array(*map(F.lit, elements)), symbol)
    return atoms.withColumns({"symbol": symbol, "atom_type": F.when(at > 0, at - 1)})
