"""Periodic runs of words, found on a harmonic grid.

A run of period p that is at least four periods long holds a grid point g (a multiple of p) in its
first period, and the words of [g, g + 2p) come again p words later. All pairs of a period and a grid
point, n ln n in number for n words, of a portion of documents are looked at together: the words at the
point first, then prefix hashes, then the longest common extension to either side by binary search for
all remaining pairs at once. Runs that several points or multiples of the period give are deduplicated,
and what is left is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words and so many periods.
LEAST, PERIODS = 6, 4
#: Words of documents that are searched together (a longer document is searched alone), and pairs that are looked at together.
PORTION, PAIRS = 200_000, 1_000_000
#: Modulus (the largest prime below 2**32) and base of the prefix hashes.
MODULUS, BASE = np.uint64(4_294_967_291), 1_000_003

RUN = "struct<start:long,length:long,period:long>"


class _PrefixHashes:
    """Sums of codes times powers of the base, with which stretches that lie p words apart are compared."""

    def __init__(self, codes: np.ndarray):
        n = len(codes) + 1
        self.powers = np.ones(n, np.uint64)
        have, factor = 1, np.uint64(BASE)
        while have < n:
            more = min(have, n - have)
            self.powers[have : have + more] = self.powers[:more] * factor % MODULUS
            have, factor = have + more, factor * factor % MODULUS
        terms = (codes.astype(np.uint64) + np.uint64(1)) * self.powers[:-1] % MODULUS
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms) % MODULUS))  # below 2**64 for 2**32 words

    def same(self, at: np.ndarray, apart: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words at ``at`` hash like those ``apart`` words later."""
        s = self.sums
        here = (s[at + size] + MODULUS - s[at]) % MODULUS
        there = (s[at + apart + size] + MODULUS - s[at + apart]) % MODULUS
        return here * self.powers[apart] % MODULUS == there


def _extended(same, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each pair the largest size from ``least`` to ``most`` for which ``same`` holds: binary search for all at once."""
    low, high = least.copy(), most.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_] + 1) // 2
        fits = same(open_, middle)
        low[open_[fits]], high[open_[~fits]] = middle[fits], middle[~fits] - 1
    return low


def _plain_runs(codes: np.ndarray) -> np.ndarray:
    """(start, end, period) rows of one document by comparing words for each period: the exact way for hashes that collide."""
    found = {}
    for p in range(len(codes) // PERIODS, 0, -1):
        edges = np.diff(np.concatenate(([0], codes[:-p] == codes[p:], [0])).astype(np.int8))
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            if b + p - a >= max(LEAST, PERIODS * p):
                found[a, b + p] = p  # smaller periods come later
    return np.array([(a, b, p) for (a, b), p in found.items()], np.int64).reshape(-1, 3)


def _candidates(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) rows of all documents: the maximal stretches that have a period by their hashes, each with its least."""
    hashes, found = _PrefixHashes(codes), [np.zeros((0, 3), np.int64)]
    many = np.where(sizes >= LEAST, sizes // PERIODS, 0)  # periods of each document
    doc = np.repeat(np.arange(len(sizes)), many)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + 1
    points = sizes[doc] // period - 2  # grid points with three periods after them
    ends = np.cumsum(points)
    first = 0
    while first < len(doc):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        n, p, d = points[first:last], period[first:last], doc[first:last]
        first = last
        row = np.repeat(np.arange(len(n)), n)
        p, d = p[row], d[row]
        g = starts[d] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * p
        likely = np.flatnonzero(codes[g] == codes[g + p])
        likely = likely[codes[g[likely] + p[likely]] == codes[g[likely] + 2 * p[likely]]]
        likely = likely[hashes.same(g[likely], p[likely], 2 * p[likely])]
        if not likely.size:
            continue
        g, p, low, high = g[likely], p[likely], starts[d[likely]], starts[d[likely]] + sizes[d[likely]]
        after = _extended(lambda k, size: hashes.same(g[k], p[k], size), high - g - p, 2 * p)  # noqa: B023  (called at once)
        before = _extended(lambda k, size: hashes.same(g[k] - size, p[k], size), g - low, np.zeros_like(g))  # noqa: B023
        start, end = g - before, g + p + after
        long = end - start >= np.maximum(LEAST, PERIODS * p)
        found.append(_deduplicated(np.stack((start, end, p), axis=1)[long]))
    return _deduplicated(np.concatenate(found))


def _deduplicated(runs: np.ndarray) -> np.ndarray:
    """One row for each stretch, with its least period; by start, then period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _runs(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) rows of the runs of all documents; places are those in ``codes``."""
    runs = _candidates(codes, starts, sizes)
    wrong = [s for s, e, p in runs.tolist() if not np.array_equal(codes[s : e - p], codes[s + p : e])]
    if wrong:  # hashes of different words were equal: these documents are searched without
        docs = np.unique(np.searchsorted(starts + sizes, np.array(wrong), "right"))
        kept = [runs[~np.isin(np.searchsorted(starts + sizes, runs[:, 0], "right"), docs)]]
        runs = _deduplicated(np.concatenate(kept + [_plain_runs(codes[starts[d] : starts[d] + sizes[d]]) + [starts[d], starts[d], 0] for d in docs]))
    return runs


def _search(texts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, list[bytes]]:
    """Of each text: its number of words, the number of its runs, these as rows, and its words without the repetitions."""
    words = [t.split() for t in texts]  # bytes: only ASCII white space parts words
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for own in words for w in own]
    runs = _runs(pd.factorize(flat)[0], starts, sizes)
    doc = np.searchsorted(starts + sizes, runs[:, 0], "right")
    repeated = np.zeros(len(flat) + 1, np.int64)
    np.add.at(repeated, runs[:, 0] + runs[:, 2], 1)
    np.add.at(repeated, runs[:, 1], -1)
    kept = np.cumsum(repeated)[:-1] == 0
    touched = set(doc.tolist())
    collapsed = [b" ".join(flat[a : a + n][kept[a : a + n]].tolist() if d in touched else words[d]) for d, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True))]
    rows = np.stack((runs[:, 0] - starts[doc], runs[:, 1] - runs[:, 0], runs[:, 2]), axis=1)
    return sizes.tolist(), np.bincount(doc, minlength=len(texts)), rows, collapsed


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every whole text.

    ``runs`` has (start, length, period) of each maximal stretch of at least 6 words and 4 of its least
    periods, by start and period; ``collapsed`` the words that no run holds after its first period, joined
    by blanks. Null and empty texts have no words. Repeated rows each give a row; other columns aren't carried.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            edges, size = [0], 0
            for k, t in enumerate(texts):
                size += t.count(b" ") + 1
                if size >= PORTION or k == len(texts) - 1:
                    edges, size = [*edges, k + 1], 0
            for a, z in zip(edges, edges[1:], strict=False):
                sizes, n_runs, rows, collapsed = _search(texts[a:z])
                ends = pa.array(np.concatenate(([0], np.cumsum(n_runs))).astype(np.int32))
                run = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["start", "length", "period"])
                columns = [ids.slice(a, z - a), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, run), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.record_batch(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(search, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period (then the least start, then period); null without runs."""

    def order(a: Column, b: Column) -> Column:
        mine, other = a["length"] * b["period"], b["length"] * a["period"]
        first = (mine > other) | ((mine == other) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
        return F.when(first, -1).otherwise(1)

    return F.get(F.array_sort(runs, order), F.lit(0))
