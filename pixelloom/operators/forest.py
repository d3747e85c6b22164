"""Outliers by an isolation forest: trees of random splits, grown on bounded subsamples and sent to all workers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Trees, and rows that each is grown on: the sample on the driver has at most TREES * ROWS rows, whatever the input.
TREES, ROWS = 100, 256


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    """Nodes by number: feature and threshold of the split, children, and the path length of a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    path: np.ndarray

    def paths(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(math.ceil(math.log2(ROWS)) + 1):
            right = x[np.arange(len(x)), self.feature[node]] >= self.threshold[node]
            node = self.children[node, right.astype(int)]
        return self.path[node]


def grow(x: np.ndarray, rng: np.random.Generator) -> Tree:
    """A tree of uniform splits on the rows ``x``, as deep as a balanced one of ROWS rows."""
    nodes: list[list] = []
    deepest = math.ceil(math.log2(ROWS))

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([0, -np.inf, at, at, depth + float(_mean_path(len(rows)))])
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth < deepest and len(spread):
            f = int(rng.choice(spread))
            t = rng.uniform(rows[:, f].min(), rows[:, f].max())
            left = rows[:, f] < t
            if left.any() and not left.all():
                nodes[at] = [f, t, add(rows[left], depth + 1), add(rows[~left], depth + 1), 0.0]
        return at

    add(x, 0)
    f, t, a, b, path = zip(*nodes, strict=True)
    return Tree(np.array(f), np.array(t), np.array([a, b]).T, np.array(path))


def forest(rows: DataFrame, features: list[str], seed: int = 0) -> list[Tree]:
    """Trees grown on the rows with the least hashes (of the seed and all columns): a sample of bounded size."""
    values = rows.select(F.xxhash64(F.lit(seed), *rows.columns).alias("h"), *(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features))).dropna()
    sample = values.orderBy(*values.columns).limit(TREES * ROWS).drop("h").toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    return [grow(sample[rng.choice(len(sample), min(ROWS, len(sample)), replace=False)], rng) for _ in range(TREES)] if len(sample) else []


def with_score(rows: DataFrame, trees: list[Tree], features: list[str], name: str = "score", sampled: int = ROWS) -> DataFrame:
    """Adds the anomaly score, from 0 to 1 and higher for rows that few splits set apart; null where a feature is."""
    sent = rows.sparkSession.sparkContext.broadcast(trees)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    unit = float(_mean_path(sampled)) or 1.0

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[features].to_numpy(float)
            mean = sum(t.paths(x) for t in sent.value) / max(1, len(sent.value))
            yield b.assign(**{name: np.where(np.isnan(x).any(axis=1), np.nan, 2.0 ** (-mean / unit))})

    return rows.mapInPandas(compute, schema)


def without_high_outliers(values: DataFrame, value: str = "v", share: float = 0.01, seed: int = 0) -> DataFrame:
    """Positive values less the ``share`` with the highest anomaly scores, as far as these lie above the mean."""
    score = "__score"
    n = values.filter(F.col(value).isNotNull()).count()
    scored = with_score(values, forest(values, [value], seed), [value], score, min(ROWS, n))
    cut_at = scored.agg(F.percentile(score, 1 - share).alias("__cut"), F.avg(value).alias("__mean"))
    out = scored.crossJoin(F.broadcast(cut_at))  # one row
    return out.filter(~((F.col(score) > F.col("__cut")) & (F.col(value) > F.col("__mean"))) & (F.col(value) > 0)).drop(score, "__cut", "__mean")
