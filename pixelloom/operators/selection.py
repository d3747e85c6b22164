"""How many peaks an image has: the posterior of candidate models by Laplace's approximation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fitting import _peaks_model, solve


def _log_evidence(px: pd.DataFrame, pk: pd.DataFrame, rounds: int) -> tuple[float, float, bool]:
    """Log evidence of peaks with a common width and a constant, its squared residual, and whether the fit has settled.

    Flat priors: places over the region, heights and the background over the range of its values, the width over its size;
    the order of the peaks is no matter. The noise is normal, its variance what the fit leaves.
    """
    x, y, v = (px[c].to_numpy(float) for c in ("x", "y", "v"))
    n, peaks = len(v), len(pk)
    full = _peaks_model(x, y, "gaussian")
    model = lambda p: full(np.concatenate((p[:-2], [p[-2], 1.0, 1.0, p[-1]])))  # noqa: E731  no Lorentzian part
    start = np.concatenate([pk.x, pk.y, pk.height, [pk.sigma.mean(), pk.background.mean()]])
    p, settled = solve(model, start, v, rounds)
    rss = float(((model(p) - v) ** 2).sum())
    k = len(p)
    if n <= k:
        return -math.inf, rss, settled
    spread, size = max(float(np.ptp(v)), 1e-9), max(float(np.ptp(x)), float(np.ptp(y)), 1.0)
    area = max(float(np.ptp(x)), 1.0) * max(float(np.ptp(y)), 1.0)
    variance = max(rss / (n - k), (1e-6 * spread) ** 2)
    steps = 1e-5 * np.maximum(1.0, np.abs(p))
    jac = np.stack([(model(p + h * e) - model(p - h * e)) / (2 * h) for h, e in zip(steps, np.eye(k), strict=True)], axis=1)
    # a direction that the data say nothing about isn't wider than its prior
    scale = np.concatenate([np.full(peaks, np.ptp(x) + 1), np.full(peaks, np.ptp(y) + 1), np.full(peaks, spread), [size, spread]])
    information = jac.T @ jac / variance + np.diag(1 / scale**2)
    prior = -peaks * (math.log(area) + math.log(spread)) - math.log(size) - math.log(spread) + math.lgamma(peaks + 1)
    likelihood = -n / 2 * math.log(2 * math.pi * variance) - rss / (2 * variance)
    return likelihood + prior + k / 2 * math.log(2 * math.pi) - np.linalg.slogdet(information)[1] / 2, rss, settled


def model_evidence(pixels: DataFrame, candidates: DataFrame, keys: tuple[str, ...] = ("image_id",), rounds: int = 100) -> DataFrame:
    """(keys, model, n_peaks, rss, log_evidence, converged) of each candidate: ``candidates`` has a row for each peak of each
    ``model`` of a region (x, y, height, sigma, background to start from).

    A region, by ``keys``, is a part of an image of bounded size; each model of each region is fitted by itself. A region
    without pixels gives no rows.
    """
    kinds = dict(candidates.dtypes)
    models = candidates.select(*keys, "model").distinct()
    own = pixels.select(*keys, "y", "x", "v").join(models, list(keys))

    def fit(key: tuple, px: pd.DataFrame, pk: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, "model", "n_peaks", "rss", "log_evidence", "converged"]
        if not len(px) or not len(pk):
            return pd.DataFrame({c: [] for c in columns})
        evidence, rss, settled = _log_evidence(px, pk, rounds)
        return pd.DataFrame([[*key, len(pk), rss, evidence, settled]], columns=columns)

    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "model")) + ", n_peaks long, rss double, log_evidence double, converged boolean"
    own = own.select(*(F.col(c).alias(c) for c in own.columns))  # columns of its own, as both sides come from the candidates
    return own.groupBy(*keys, "model").cogroup(candidates.groupBy(*keys, "model")).applyInPandas(fit, schema)


def most_probable(evidence: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """``evidence`` with ``posterior`` (the models of a region equally probable before) and ``chosen``: the most probable one, of
    equals that of the fewest peaks."""
    region = Window.partitionBy(*keys)
    weight = F.exp(F.col("log_evidence") - F.max("log_evidence").over(region))
    first = F.row_number().over(region.orderBy(F.desc("log_evidence"), "n_peaks", "model"))
    return evidence.withColumns({"posterior": weight / F.sum(weight).over(region), "chosen": first == 1})
