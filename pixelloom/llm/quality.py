"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Every whole text becomes a vector of hashed byte trigrams, of hashed runs of character classes and
of word repetition, weighted by inverse document frequency and projected onto the leading singular vectors of labelled
texts. The labelled vectors are broadcast; exact cosine products with all of them are computed in
blocks, and the nearest vote by similarity. The labelled set is a sample of bounded size, the same
number of each label as far as there are so many, and each vote counts for as many labelled rows as
it stands for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, stored

HALF = 2048
#: The hashed features, and last the share of words that repeat the one before.
WIDTH = 2 * HALF + 1
#: Bound of the labelled sample, and so of the broadcast: SAMPLE x RANK and WIDTH x RANK floats, under 2 MB.
SAMPLE = 3000
RANK = 64
NEIGHBOURS = 25
#: Rows in a block of products.
BLOCK = 256


def _classes() -> np.ndarray:
    """Class of each byte: letters by case, digits, parts of other letters; all else stands for itself."""
    table = np.arange(256, dtype=np.uint32)
    for first, last, to in (("a", "z", "a"), ("A", "Z", "A"), ("0", "9", "0")):
        table[ord(first) : ord(last) + 1] = ord(to)
    table[128:] = ord("a")
    return table


_CLASS = _classes()
_MIX = np.uint32(2654435761)


def _hashed(parts: np.ndarray) -> np.ndarray:
    return np.bincount((parts * _MIX) >> np.uint32(32 - 11), minlength=HALF)


def features(text: str) -> np.ndarray:
    """Log counts of the hashed features and the share of repeated words, at their scale; WIDTH float32."""
    b = np.frombuffer(f" {text} ".encode(), np.uint8)
    raw, c = b.astype(np.uint32), _CLASS[b]
    three = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    four = (c[:-3] << np.uint32(24)) ^ (c[1:-2] << np.uint32(16)) ^ (c[2:-1] << np.uint32(8)) ^ c[3:] if len(b) > 3 else c[:0]
    counts = np.log1p(np.concatenate((_hashed(three), _hashed(four)))).astype(np.float32)
    words = text.split()
    share = sum(map(eq, words, words[1:])) / max(1, len(words) - 1)
    return np.append(counts, np.float32(1.5 * share) * np.linalg.norm(counts))


@dataclass
class Model:
    """idf (WIDTH), basis (WIDTH, RANK), neighbours (n, RANK) of unit length, labels and weights (n), prior."""

    idf: np.ndarray
    basis: np.ndarray
    neighbours: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = (counts * self.idf) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the votes of the k nearest; the prior where nothing is near."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosine = self.vectors(counts) @ self.neighbours.T
        k = min(k, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0) ** 8 * self.weights[near]
        total = votes.sum(axis=1)
        ayes = (votes * self.labels[near]).sum(axis=1)
        return np.clip(np.where(total > 1e-12, ayes / np.maximum(total, 1e-12), self.prior), 0.0, 1.0)


def _basis(x: np.ndarray, rank: int, rounds: int = 3) -> np.ndarray:
    """Leading right singular vectors by randomized subspace iteration with a fixed seed."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 8, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray(q @ vt[:rank].T, np.float32)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> Model:
    """Model from at most ``sample`` labelled rows that aren't held out.

    They are those with the least hash of the id within each label, half of either label where there
    are enough; then, as an id may have several rows, those with the least hash of id and text. Equal rows
    count once. Only their features, as half floats, come to the driver. Without labelled rows all scores are 0.5.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for q in (0, 1)]
    labelled = chosen[0].union(chosen[1]).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    distinct = stored(keyed.select("doc_id", "key").join(F.broadcast(labelled), F.col("doc_id") == F.col("id")).select("id", "label", "key").distinct(), "labelled-texts")
    rows_of = [distinct.filter(F.col("label") == q).orderBy("key", "id").limit(sample // 2) for q in (0, 1)]
    picked = F.broadcast(rows_of[0].union(rows_of[1]).select("id", "label", F.col("key").alias("id_key")))

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"quality": b.label, "key": b.key, "f": [features(t).astype(np.float16).tobytes() for t in b.text]})

    joined = keyed.join(picked, (F.col("doc_id") == F.col("id")) & (F.col("key") == F.col("id_key"))).groupBy("label", "key").agg(F.first("text").alias("text"))
    rows = joined.mapInPandas(compute, "quality int, key long, f binary").orderBy("key", "quality").toPandas()
    label = rows.quality.to_numpy(np.float32)
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if not len(rows):
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), label, label, prior)
    x = np.stack([np.frombuffer(f, np.float16) for f in rows.pop("f")]).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    scaled = x * idf
    scaled /= np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-12)
    model = Model(idf, _basis(scaled, rank), np.zeros((0, 1), np.float32), label, np.zeros(0, np.float32), prior)
    stands = {q: counts.get(q, 0) / max(1, int((label == q).sum())) for q in (0, 1)}
    model.neighbours = model.vectors(x).astype(np.float32)
    model.weights = np.where(label == 1, stands[1], stands[0]).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with a score from 0 to 1; null counts as the empty text.

    Equal texts have equal scores; a column of that name is replaced.
    """
    kept = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"]
            out = np.zeros(len(b))
            for at in range(0, len(b), BLOCK):
                block = texts.iloc[at : at + BLOCK]
                out[at : at + BLOCK] = shared.value.scores(np.stack([features(t or "") for t in block]))
            yield b.assign(**{name: out})

    return kept.mapInPandas(compute, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score ``threshold`` or more, all columns as they were."""
    name = free_name(docs, "score")
    return score(docs, fit(docs, labels), name).filter(F.col(name) >= threshold).drop(name)
