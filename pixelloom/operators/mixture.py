"""Gaussian mixtures with diagonal covariance, fitted by relational expectation and maximisation.

Data are rows (id, and one column for each dimension); a model is a handful of components. One round
is one grouped aggregate over the data with the components as literals; only their sums come back.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.loops import NotConverged


@dataclass(frozen=True)
class Component:
    """A weight, and a mean and variance for each dimension (plain numbers for one)."""

    weight: float
    mean: float | tuple[float, ...]
    var: float | tuple[float, ...]

    @property
    def means(self) -> tuple[float, ...]:
        return self.mean if isinstance(self.mean, tuple) else (self.mean,)

    @property
    def vars(self) -> tuple[float, ...]:
        return self.var if isinstance(self.var, tuple) else (self.var,)


def _component(weight: float, means: Sequence[float], variances: Sequence[float]) -> Component:
    return Component(weight, means[0], variances[0]) if len(means) == 1 else Component(weight, tuple(means), tuple(variances))


def initial(samples: DataFrame, n: int, dims: Sequence[str] = ("v",), means: Sequence[Sequence[float]] | None = None) -> list[Component]:
    """Equal weights, means in the middle of equal parts of the range (or as given), one shared width for each dimension."""
    ends = samples.agg(*(f(c) for c in dims for f in (F.min, F.max))).first()
    lows, widths = ends[::2], [(hi - lo) / (2 * n) for lo, hi in zip(ends[::2], ends[1::2], strict=True)]
    if means is None:
        means = [[lo + (2 * i + 1) * w for lo, w in zip(lows, widths, strict=True)] for i in range(n)]
    return [_component(1 / n, list(m), [w * w for w in widths]) for m in means]


def inserted(last: list[Component], samples: DataFrame, dims: Sequence[str] = ("v",)) -> list[list[Component]]:
    """Starts with one component more: a new mean between each two neighbours of the last model."""
    means = [list(c.means) for c in last]
    middles = [[(a + b) / 2 for a, b in zip(p, q, strict=True)] for p, q in zip(means, means[1:], strict=False)]
    return [initial(samples, len(last) + 1, dims, [*means[: i + 1], m, *means[i + 1 :]]) for i, m in enumerate(middles)]


def density(c: Component, dims: Sequence[str] = ("v",)) -> Column:
    scale = c.weight / math.sqrt(math.prod(2 * math.pi * v for v in c.vars))
    parts = ((F.col(d) - m) * (F.col(d) - m) / (2 * v) for d, m, v in zip(dims, c.means, c.vars, strict=True))
    return F.lit(scale) * F.exp(-reduce(lambda a, b: a + b, parts))


def densities(samples: DataFrame, model: list[Component], dims: Sequence[str] = ("v",)) -> DataFrame:
    """Adds ``p``, the array of weighted densities."""
    return samples.withColumn("p", F.array(*(density(c, dims) for c in model)))


def responsibilities(samples: DataFrame, model: list[Component], dims: Sequence[str] = ("v",)) -> DataFrame:
    """Adds ``tau``, each component's share of the density, and ``llh``, the log of the whole."""
    d = densities(samples, model, dims).withColumn("s", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
    return d.select(*samples.columns, F.transform("p", lambda x: x / F.col("s")).alias("tau"), F.log("s").alias("llh"))


def step(samples: DataFrame, model: list[Component], rate: float = 1.0, shared_width: bool = False, dims: Sequence[str] = ("v",)) -> tuple[list[Component], float]:
    """The model after one round with step size ``rate``, and the log-likelihood before it; variances lie about the new means."""
    r = responsibilities(samples, model, dims)
    sums = []
    for k, c in enumerate(model):
        t = F.get("tau", F.lit(k))
        sums.append(F.sum(t).alias(f"n{k}"))
        for j, (d, m) in enumerate(zip(dims, c.means, strict=True)):
            off = F.col(d) - m
            sums += [F.sum(t * off).alias(f"m{k}_{j}"), F.sum(t * off * off).alias(f"q{k}_{j}")]
    row = r.agg(F.count("*").alias("n"), F.sum("llh").alias("llh"), *sums).first()
    counts, means, variances = [row[f"n{k}"] for k in range(len(model))], [], []
    for k, c in enumerate(model):
        moves = [rate * row[f"m{k}_{j}"] / counts[k] for j in range(len(dims))]
        about = [row[f"q{k}_{j}"] / counts[k] - 2 * u * row[f"m{k}_{j}"] / counts[k] + u * u for j, u in enumerate(moves)]
        means.append([m + u for m, u in zip(c.means, moves, strict=True)])
        variances.append([v + rate * (a - v) for v, a in zip(c.vars, about, strict=True)])
    weights = [c.weight + rate * (n / row["n"] - c.weight) for c, n in zip(model[:-1], counts, strict=False)]
    weights.append(1 - sum(weights))
    if shared_width:
        pooled = [sum(n * v[j] for n, v in zip(counts, variances, strict=True)) / row["n"] for j in range(len(dims))]
        variances = [pooled] * len(model)
    new = [_component(w, m, [max(x, 1e-12) for x in v]) for w, m, v in zip(weights, means, variances, strict=True)]
    return sorted(new, key=lambda c: c.means), row["llh"]


def fit(samples: DataFrame, n: int, rounds: int = 200, tolerance: float = 1e-5, least_gap: float = 1e-3, dims: Sequence[str] = ("v",), start: list[Component] | None = None, **how) -> tuple[list[Component], float]:
    """Rounds until the relative change of the log-likelihood is small or two means coincide; it warns where they end before."""
    model, last = start or initial(samples, n, dims), -math.inf
    for _ in range(rounds):
        new, llh = step(samples, model, dims=dims, **how)
        if any(math.dist(a.means, b.means) < least_gap for a, b in zip(new, new[1:], strict=False)):
            return model, llh
        if abs(llh - last) <= tolerance * abs(llh):
            return model, llh
        model, last = new, llh
    warnings.warn(f"the likelihood still changes after {rounds} rounds", NotConverged, stacklevel=2)
    return model, last


def parameters(n: int, dims: int = 1, shared_width: bool = False) -> int:
    return n * dims + (n - 1) + (dims if shared_width else n * dims)


def scores(llh: float, tau_entropy: float, n_data: int, n: int, dims: int = 1, standard: bool = False, shared_width: bool = False) -> dict[str, float]:
    """Information criteria, smaller is better. ``standard`` takes ln(data) for BIC in place of ln(parameters)."""
    k, minus2 = parameters(n, dims, shared_width), -2 * llh / dims
    size = math.log(n_data if standard else k) if k > 0 else 0.0
    return {
        "nllh": -llh, "en": tau_entropy, "aic": minus2 + 2 * k, "gic": minus2 + 2 * k, "bic": minus2 + k * size,
        "clc": minus2 + 2 * tau_entropy, "icl": minus2 + 2 * tau_entropy + k * size, "awe": minus2 + 2 * tau_entropy + 2 * k * (1.5 + size),
    }


def entropy(samples: DataFrame, model: list[Component], dims: Sequence[str] = ("v",)) -> tuple[int, float, float]:
    """(rows, log-likelihood, entropy of the assignment)."""
    part = F.aggregate("tau", F.lit(0.0), lambda a, t: a - F.when(t > 0, t * F.log(t)).otherwise(F.lit(0.0)))
    return tuple(responsibilities(samples, model, dims).agg(F.count("*"), F.sum("llh"), F.sum(part)).first())


def best_size(samples: DataFrame, sizes: Sequence[int], metric: str = "icl", dims: Sequence[str] = ("v",), **how) -> tuple[int, dict[int, float]]:
    """The number of components with the least score, the first of equals, and all scores."""
    found = {}
    for n in sizes:
        model, _ = fit(samples, n, dims=dims, **how)
        rows, llh, en = entropy(samples, model, dims)
        found[n] = scores(llh, en, rows, n, len(dims))[metric]
    return min(found, key=lambda n: (found[n], n)), found


def assign(samples: DataFrame, model: list[Component], dims: Sequence[str] = ("v",)) -> DataFrame:
    """(id, component): the likeliest component of each row; the first of equals."""
    d = densities(samples, model, dims)
    return d.select("id", (F.array_position("p", F.array_max("p")) - 1).alias("component"))
