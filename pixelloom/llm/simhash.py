"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within the radius agree on at least ``blocks - radius`` blocks of bits, so equal values
of any such choice of blocks bring every link together in some cell. Within a cell the fingerprints
are stored vertically, one plane for each bit; one query is held against all lanes of a word at once,
carry-save counters add up the differing bits, and a block of words is abandoned as soon as all its
lanes are beyond the radius. Cells hand on a least spanning forest of their links, and connected
components follow by large-star and small-star rounds.

Two uses: ``near_duplicates`` links by the fingerprints alone; ``similar_documents`` takes such links
of finer fingerprints as candidates, and those stand whose texts share enough word shingles. What lies
beyond the radius meets by the rarest shingles of each set (prefix filter), so that no similar pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Cells of more fingerprints are split, each part being held against each other one.
PART = 2048
#: Likewise for cells of the prefix filter.
PREFIX_PART = 8192
#: Planes between two looks at whether a block can be abandoned.
LOOK = 8
#: Documents of which frequent shingles are counted, and how many of these are sent to all workers.
SAMPLE, FREQUENT = 5000, 100_000
#: 64-bit words of a set's parity sketch.
SKETCH = 4
#: Most entries of a worker's table of word hashes.
CACHE = 250_000
#: Documents whose shingles a worker holds at a time.
HELD = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half the shingles' hashes; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and only ASCII white space parts words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    n = max(1, len(words) - shingle + 1)
    stops = (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return _majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)), np.uint64, n))


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have; 0 without hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every whole text; ``fp`` holds the 64 bits as a signed number."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.text], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b.doc_id, "fp": fps})

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(compute, "doc_id long, fp long")


def _masks(radius: int, blocks: int) -> list[int]:
    """The bits, as a signed number, of each choice of ``blocks - radius`` blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [sum((1 << edges[b + 1]) - (1 << edges[b]) for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - ((m >> 63) << 64) for m in masks]


def _cell_keys(fp: Column, radius: int, blocks: int) -> Column:
    """One key for each choice of blocks: the choice and the bits it keeps."""
    return F.array(*(F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("bits")) for n, m in enumerate(_masks(radius, blocks))))


class _Counters:
    """Carry-save counters of differing bits in each lane, one plane for each binary digit, with a mark for overflow."""

    def __init__(self, shape: tuple, dtype: type, radius: int):
        self.radius = radius
        self.digits = [np.zeros(shape, dtype) for _ in range(max(1, radius.bit_length()))]
        self.over = np.zeros(shape, dtype)

    def add(self, carry: np.ndarray) -> None:
        for i, digit in enumerate(self.digits):
            self.digits[i], carry = digit ^ carry, digit & carry
        self.over |= carry

    def take(self, rows: np.ndarray) -> None:
        self.digits, self.over = [d[rows] for d in self.digits], self.over[rows]

    def beyond(self) -> np.ndarray:
        """Lanes with more than ``radius`` bits."""
        more, equal = self.over.copy(), ~np.zeros((), self.over.dtype)
        for i in reversed(range(len(self.digits))):
            if self.radius >> i & 1:
                equal = equal & self.digits[i]
            else:
                more |= equal & self.digits[i]
        return more


def _planes(fps: np.ndarray, lanes: int, width: int) -> np.ndarray:
    """(64, rows) words of ``lanes`` bits from (rows, lanes) fingerprints: lane k is bit k."""
    rows = len(fps) // lanes
    bits = np.unpackbits(fps.view(np.uint8).reshape(rows, lanes, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(f"u{width}").reshape(BITS, rows)


def _small_cells(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links, as places in ``fps``, of cells that fit into one word each: many cells at once."""
    low = 1
    for width in (1, 2, 4, 8):
        lanes = 8 * width
        own = (sizes > low) & (sizes <= lanes)
        low = lanes
        for at in range(0, int(own.sum()), 4096):
            first, n = starts[own][at : at + 4096], sizes[own][at : at + 4096]
            place = np.minimum(np.arange(lanes), n[:, None] - 1) + first[:, None]
            planes = _planes(np.ascontiguousarray(fps[place]).reshape(-1), lanes, width)
            dtype = planes.dtype.type
            full = np.iinfo(dtype).max
            member = np.array([full >> (lanes - k) for k in n.tolist()], dtype)
            for q in range(int(n.max()) - 1):
                alive = np.flatnonzero(n > q + 1)
                lane_q = dtype(q)
                counters = _Counters((len(alive),), dtype, radius)
                for j in range(BITS):
                    mine = planes[j, alive]
                    query = (dtype(0) - ((mine >> lane_q) & dtype(1))).astype(dtype)
                    counters.add(mine ^ query)
                    if j % LOOK == LOOK - 1:
                        later = member[alive] & dtype((full << (q + 1)) & full)
                        near = (~counters.beyond() & later) != 0
                        if not near.all():
                            alive = alive[near]
                            counters.take(near)
                        if not len(alive):
                            break
                if len(alive):
                    near = ~counters.beyond() & member[alive] & dtype((full << (q + 1)) & full)
                    hits = np.unpackbits(near.view(np.uint8).reshape(len(alive), width), axis=1, bitorder="little")
                    row, lane = np.nonzero(hits)
                    yield first[alive[row]] + q, first[alive[row]] + lane


def _large_cell(fps: np.ndarray, radius: int, queries: int = 64, words: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one cell of many words: groups of queries against blocks of words."""
    n = len(fps)
    padded = np.concatenate((fps, np.zeros(-n % 64, fps.dtype)))
    planes = _planes(padded, 64, 8)
    for q in range(0, n, queries):
        bits = np.unpackbits(fps[q : q + queries].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.uint64)
        masks = np.uint64(0) - bits  # (queries, 64): all ones where the bit is set
        for w in range(q // 64, planes.shape[1], words):
            block = planes[:, w : w + words]
            counters = _Counters((len(bits), block.shape[1]), np.uint64, radius)
            for j in range(BITS):
                counters.add(block[j][None, :] ^ masks[:, j][:, None])
                if j % LOOK == LOOK - 1 and j < BITS - 1 and not (~counters.beyond()).any():
                    break
            else:
                near = ~counters.beyond()
                hits = np.unpackbits(near.view(np.uint8).reshape(len(bits), -1), axis=1, bitorder="little")
                a, b = np.nonzero(hits)
                a, b = a + q, b + 64 * w
                right = (a < b) & (b < n)
                yield a[right], b[right]


def _spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a-b that join sets with different labels (each the least place of its set, changed in place), none too many."""
    chosen = []
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        if not len(a):
            break
        order = np.lexsort((low, high))
        one = order[np.unique(high[order], return_index=True)[1]]  # each higher set joins its lowest partner
        chosen.append((a[one], b[one]))
        label[high[one]] = low[one]
        while (label[label] != label).any():
            label[:] = label[label]
    return chosen


def _forest(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in ``fps``) that connect all that is linked within the cells: the closest that do so."""
    found = list(_small_cells(fps, starts, sizes, radius))
    label, chosen = np.arange(len(fps)), []

    def settle(label: np.ndarray, found: list, first: int = 0) -> None:
        if not found:
            return
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        d = np.bitwise_count((fps[a + first] ^ fps[b + first]).view(np.uint64))
        for k in range(radius + 1):
            chosen.extend((x + first, y + first) for x, y in _spanning(label, a[d == k], b[d == k]))

    settle(label, found)
    for first, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        settle(np.arange(n), list(_large_cell(fps[first : first + n], radius)), first)
    if not chosen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in chosen]), np.concatenate([y for _, y in chosen])


def blocks_for(n: int, radius: int = RADIUS, part: int = PART) -> int:
    """The least number of blocks whose keys are so long that ``n`` evenly spread fingerprints leave ``part`` in a cell."""
    blocks = radius + 2
    while n > part << BITS * (blocks - radius) // blocks and blocks < 2 * radius + 4:
        blocks += 1
    return blocks


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None, part: int = PART) -> DataFrame:
    """(a, b): links between nodes (columns node, fp) that connect all those within the radius: in place of all links
    within a cell, its least spanning forest.

    A cell of more than ``part`` nodes is dealt into parts by hash, and each two parts meet in a cell of their
    own. ``blocks`` follows from the number of nodes unless it is given; the links connect the same nodes for any.
    """
    blocks = blocks or blocks_for(nodes.count(), radius, part)
    keyed = nodes.select("node", "fp", F.explode(_cell_keys(F.col("fp"), radius, blocks)).alias("k")).select("node", "fp", "k.choice", "k.bits")
    # stored, so that the join below has plain sides, of which Spark can split a skewed one
    large = stored(keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1"), "cells")
    parts = F.ceil(F.col("n") / part).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda p: F.struct(F.least(p, F.col("mine")).alias("low"), F.greatest(p, F.col("mine")).alias("high")),
    )
    sized = keyed.join(large, ["choice", "bits"]).withColumns({"parts": parts, "mine": mine})
    cells = sized.select("choice", "bits", "node", "fp", F.explode(pairs).alias("p")).select(F.xxhash64("choice", "bits", "p.low", "p.high").alias("cell"), "node", "fp")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _whole_cells(batches, ["cell", "node", "fp"]):
            starts = np.flatnonzero(np.concatenate(([True], x["cell"][1:] != x["cell"][:-1])))
            a, b = _forest(x["fp"], starts, np.diff(np.append(starts, len(x["cell"]))), radius)
            yield pd.DataFrame({"a": x["node"][a], "b": x["node"][b]}).drop_duplicates()

    return cells.repartition("cell").sortWithinPartitions("cell", "node").mapInPandas(compare, "a long, b long")


def _whole_cells(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of a partition, which are sorted by cell, in portions that end where a cell ends."""
    rest = {c: np.zeros(0, np.int64) for c in columns}
    for batch in batches:
        rest = {c: np.concatenate((r, batch[c].to_numpy())) for c, r in rest.items()}
        last = int(np.searchsorted(rest["cell"], rest["cell"][-1])) if len(rest["cell"]) else 0  # the last cell may go on
        if last:
            yield {c: r[:last] for c, r in rest.items()}
            rest = {c: r[last:] for c, r in rest.items()}
    if len(rest["cell"]):
        yield rest


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down to a node that has none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("n"), F.min("e.up").alias("low"))
    return nodes.filter((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("low") == 0))).isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each one with an edge reaches; roots aren't listed.

    Alternating large-star and small-star rounds, each stored, until all edges lead to roots; minima are
    combined before the shuffle, and no node's neighbours are gathered.
    """
    edges = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if _are_stars(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # large star: neighbours above a node are tied to the least of its neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its lower neighbours are tied to the least of these
        low = stored(large.distinct(), "large-star")
        least = stored(low.groupBy("a").agg(F.min("b").alias("m")), "minima")
        small = low.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").filter("a != b").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def joined_components(tree: DataFrame, more: DataFrame) -> DataFrame:
    """``tree`` (node, root) with further links (a, b): only the roots of their ends are joined anew."""
    ends = more
    for c in ("a", "b"):
        ends = ends.join(tree.select(F.col("node").alias(c), F.col("root").alias("r")), c, "left").withColumn(c, F.coalesce("r", c)).drop("r")
    new = components(ends.select("a", "b"))
    moved = tree.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return stored(moved.select("node", F.coalesce("to", "root").alias("root")).union(new), "tree")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every document row.

    Fingerprints that differ in at most ``radius`` bits are linked; component_id is the least doc_id
    that can be reached. Null and empty texts have fingerprint 0 and link like any other. A component
    of rows without ids has none.
    """
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    tree = components(links(distinct.select(F.col("fp").alias("node"), "fp"), radius, blocks))
    rooted = distinct.join(tree, distinct["fp"] == tree["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _portions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), HELD):
            yield b.iloc[at : at + HELD]


class _Words(dict):
    """Word -> 64-bit hash, kept for the next texts and emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the lower-cased (A-Z) words in order."""
        words = (text or "").encode().lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the shingles of n words, repeats included; fewer words are one shingle, none are none."""
    n = min(n, len(words))
    out = np.full(len(words) - n + 1 if n else 0, n, np.uint64)
    for k in range(n):
        out = _mixed(out ^ words[k : len(words) - n + 1 + k]) + np.uint64(k)
    return out


def _set(words: np.ndarray, n: int) -> np.ndarray:
    """Signed hashes of the distinct shingles, sorted."""
    return np.unique(_shingles(words, n).view(np.int64))


def _name(words: np.ndarray, seed: int) -> int:
    """Signed hash of the whole sequence."""
    return int(np.uint64(xxhash.xxh64_intdigest(words.tobytes(), seed)).view(np.int64))


def _prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest of a set's hashes: sets of at least the similarity have one in common (any one order of all hashes does)."""
    count = np.zeros(len(hashes), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        count = np.where(frequent[at] == hashes, counts[at], 0)
    ordered = hashes[np.lexsort((hashes, count))]
    return ordered[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1] if len(hashes) else ordered


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of hashes by their low bits, about as many as hashes (a power of two, 64 * SKETCH at least):
    two sets differ in at least as many hashes as bits."""
    bits = max(64 * SKETCH, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount(hashes & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(sketch: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """The sketch of fewer bits."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _difference(a: np.ndarray, b: np.ndarray) -> int:
    words = min(len(a), len(b))
    return int(np.bitwise_count((_folded(a, words) ^ _folded(b, words)).view(np.uint64)).sum())


def _may_be_alike(x: dict[str, np.ndarray], similarity: float, nearest: bool = False) -> pd.DataFrame:
    """(a, b, d): nodes of one cell and different labels that sizes, places in the order and sketches leave
    as pairs of at least the similarity; ``d`` is their sketches' difference. Rows are sorted by cell.

    ``side`` tells who meets in a cell: 0 meets all, of others only different ones meet. With ``nearest`` each
    row gives the pair with the least difference alone.
    """
    cell, size, rest, side = x["cell"], x["size"], x["size"] - x["place"], x["side"]
    i, found = np.arange(len(cell)), []
    best, partner = np.full(len(cell), 64 * SKETCH + 1), np.zeros(len(cell), np.int64)
    for step in range(1, len(cell)):
        i = i[i + step < len(cell)]
        i = i[cell[i] == cell[i + step]]  # a row without a follower so far has none farther on
        if not len(i):
            break
        j = i + step
        ok = (x["label"][i] != x["label"][j]) & ((side[i] != side[j]) | (side[i] == 0))
        a, b = i[ok], j[ok]
        both = size[a] + size[b]
        least = np.ceil(similarity / (1 + similarity) * both - 1e-9)
        ok = np.minimum(rest[a], rest[b]) >= least
        a, b, room = a[ok], b[ok], (both - 2 * least)[ok]
        if not len(a):
            continue
        d = sum(np.bitwise_count((x[f"k{n}"][a] ^ x[f"k{n}"][b]).view(np.uint64)).astype(np.int64) for n in range(SKETCH))
        near = d <= room
        a, b, d = a[near], b[near], d[near]
        if nearest:
            for one, two in ((a, b), (b, a)):  # within a step no row stands twice on one side
                less = d < best[one]
                best[one[less]], partner[one[less]] = d[less], two[less]
        else:
            found.append((a, b, d))
    if nearest:
        a = np.flatnonzero(best <= 64 * SKETCH)
        found.append((a, partner[a], best[a]))
    if not found:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in "abd"})
    a, b, d = (np.concatenate(c) for c in zip(*found, strict=True))
    one, two = x["node"][a], x["node"][b]
    return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two), "d": d}).drop_duplicates()


def prefix_cells(nodes: DataFrame) -> DataFrame:
    """(hash, node, place) of all hashes that prefixes of several labels hold (nodes: node, label, prefix)."""
    ends = nodes.select("label", F.explode("prefix").alias("hash")).groupBy("hash").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    shared = stored(ends.filter("low != high").select("hash"), "shared-shingles")
    keyed = nodes.select("node", F.posexplode("prefix").alias("place", "hash"))
    return stored(keyed.join(shared, "hash").select("hash", "node", F.col("place").cast("long").alias("place")), "prefix-cells")


def prefix_pairs(cells: DataFrame, nodes: DataFrame, similarity: float, nearest: bool = False, part: int = PREFIX_PART) -> DataFrame:
    """(a, b, d): all pairs of different labels that may have the similarity (``nodes``: node, label, size, short), or with
    ``nearest`` those that are nearest to one of their ends within a cell.

    A cell is a hash. Of more than ``part`` nodes, those of the label that most have need not meet each other: they
    and the others are dealt into parts by hash, and each part of them meets each of the others, which meet among
    themselves. So a large group of one label goes out once for each part of the others, not of its own.
    """
    sketches = (F.get("short", F.lit(n)).alias(f"k{n}") for n in range(SKETCH))
    own = ["node", "label", "size", "place", *(f"k{n}" for n in range(SKETCH))]
    labelled = cells.join(nodes.select("node", "label", "size", *sketches), "node").select("hash", *own)
    sizes = labelled.groupBy("hash").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    sizes = stored(sizes.select("hash", "n"), "cell-sizes")
    sized = stored(labelled.join(sizes, "hash"), "labelled-cells")
    small = sized.filter(F.col("n") <= part).select(F.col("hash").alias("cell"), *own, F.lit(0).cast("long").alias("side"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _whole_cells(batches, ["cell", *own, "side"]):
            yield _may_be_alike(x, similarity, nearest)

    def compared(dealt: DataFrame) -> DataFrame:
        return dealt.repartition("cell").sortWithinPartitions("cell", "node").mapInPandas(compare, "a long, b long, d long").distinct()

    if (sizes.agg(F.max("n")).first()[0] or 0) <= part:
        return compared(small)
    large = sized.filter(F.col("n") > part)
    most = large.groupBy("hash", "label").agg(F.count("*").alias("m")).groupBy("hash").agg(F.max(F.struct("m", "label")).alias("most"))
    split = large.join(stored(most, "large-cells"), "hash")
    split = split.withColumns({"p": F.ceil(F.col("most.m") / part).cast("int"), "q": F.ceil((F.col("n") - F.col("most.m")) / part).cast("int"), "top": F.col("label") == F.col("most.label")})
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("top"), F.col("p")).otherwise(F.col("q"))).cast("int")
    split = split.withColumn("mine", mine)
    spot = lambda kind, low, high, side: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), side.cast("long").alias("side"))
    tops = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda k: spot(0, F.col("mine"), k, F.lit(1)))
    # the others meet each other in the cells of the first part: 0 meets all
    others = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda k: spot(0, k, F.col("mine"), F.when(k == 0, 0).otherwise(2))),
        F.filter(
            F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda k: spot(1, F.least(k, F.col("mine")), F.greatest(k, F.col("mine")), F.col("mine") + 1)), lambda s: s["low"] < s["high"]
        ),
    )
    dealt = split.select("hash", *own, F.explode(F.when(F.col("top"), tops).otherwise(others)).alias("s"))
    dealt = dealt.select(F.xxhash64("hash", "s.kind", "s.low", "s.high").alias("cell"), *own, "s.side")
    return compared(small.union(dealt))


def _frequent(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of several texts of a sample, sorted, and their counts. They only order hashes, so no result hangs on them."""

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for b in batches:
            yield pd.DataFrame({"hash": np.concatenate([np.zeros(0, np.int64), *(_set(known.of(t), words) for t in b.text)])})

    share = max(1, rows.count() // SAMPLE)
    sample = rows.filter(F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(share)) == 0).select("text").mapInPandas(shingles, "hash long")
    top = sample.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "hash").limit(FREQUENT).toPandas().sort_values("hash")
    return top.hash.to_numpy(np.int64), top.n.to_numpy(np.int64)


def _similar(docs: DataFrame, similarity: float = 0.8, words: int = 5, shingle: int = 2, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(doc_id, h1, h2, component_id, chosen) of every document row, as ``similar_documents``; h1 and h2 are hashes of the
    text, ``chosen`` marks the class of equal texts and id that stands for the component."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    frequent, counts = _frequent(rows, words)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for b in _portions(batches):
            texts = [known.of(t) for t in b.text]
            sets = [_set(w, words) for w in texts]
            yield pd.DataFrame({
                "doc_id": b.doc_id.to_numpy(), "h1": b.h1.to_numpy(), "h2": b.h2.to_numpy(), "node": [_name(w, SEED) for w in texts], "twin": [_name(w, SEED + 1) for w in texts],
                "fp": np.array([_majority(_shingles(w, shingle)) for w in texts], np.uint64).view(np.int64),
                "size": [len(s) for s in sets], "sketch": (sketches := [_sketch(s) for s in sets]), "short": list(map(_folded, sketches)),
                "prefix": [_prefix(s, frequent, counts, similarity) for s in sets],
            })

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for b in _portions(batches):
            texts = zip(b.node, map(known.of, b.text), strict=True)
            own = [(n, _set(w, words)) for n, w in texts if n == _name(w, SEED)]
            yield pd.DataFrame({"node": [n for n, _ in own], "s": [s for _, s in own]})

    hashed = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("second"), "text")})
    placed = stored(hashed.mapInPandas(keys, "doc_id long, h1 long, h2 long, node long, twin long, fp long, size long, sketch array<long>, short array<long>, prefix array<long>"), "document-keys")
    # a row with an id, if there is one, stands for all of equal texts; another text of the same hash (its twin differs) stands alone
    row = F.min(F.struct("twin", F.col("doc_id").isNull().alias("none"), "doc_id", "h1")).alias("row")
    firsts = (F.min_by(c, "twin").alias(c) for c in ("fp", "size", "sketch", "short", "prefix"))
    nodes = stored(placed.groupBy("node").agg(row, *firsts), "nodes")

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            both = x.na + x.nb
            room = both - 2 * np.ceil(similarity / (1 + similarity) * both - 1e-9)
            near = [_difference(a, b) <= r for a, b, r in zip(x.ka, x.kb, room, strict=True)]
            yield x.loc[near, ["a", "b"]]

    def shingle_sets(ends: DataFrame) -> DataFrame:
        """(node, s) of the nodes."""
        wanted = ends.join(nodes, "node").select("node", F.col("row.doc_id").alias("id"), F.col("row.h1").alias("hash"))
        texts = hashed.join(wanted, (F.col("h1") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")))
        found = texts.select("node", "text").mapInPandas(shingles, "node long, s array<long>")
        return stored(found.groupBy("node").agg(F.first("s").alias("s")), "shingles")

    def alike(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) those of the similarity: their long sketches leave few others, and these are compared by their sets."""
        for c in ("a", "b"):
            pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("sketch").alias(f"k{c}")), c)
        pairs = stored(pairs.mapInPandas(likely, "a long, b long"), "likely")
        sets = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return stored(both.filter(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "alike")

    tree = components(alike(stored(links(nodes, radius, blocks).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")))

    def labelled() -> DataFrame:
        return nodes.join(tree, "node", "left").select("node", F.coalesce("root", "node").alias("label"), "size", "short", "prefix")

    cells = prefix_cells(labelled())
    # the nearest pairs first, as long as they join much; then all pairs that are still of different labels
    nearest = True
    while not cells.isEmpty():
        left = stored(prefix_pairs(cells, labelled(), similarity, nearest), "prefix-pairs")
        for c in ("a", "b"):
            left = left.join(tree.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
        if nearest:
            left = left.groupBy(F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("high")).agg(F.min(F.struct("d", "a", "b")).alias("m")).select("m.a", "m.b")
        pairs = stored(left.select("a", "b"), "pairs")
        more = alike(pairs)
        tried, good = pairs.count(), more.count()
        if good:
            tree = joined_components(tree, more)
        if not nearest or not tried:
            break
        nearest = good >= 0.1 * tried

    rooted = nodes.select("node", "row").join(tree, "node", "left").select("node", "row", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct("row.none", "row.doc_id", "node")).alias("first")
    lowest = stored(rooted.groupBy("root").agg(first), "components")
    named = rooted.join(lowest, "root").select("node", F.col("row.twin").alias("own"), "first")
    alone = F.col("twin") != F.col("own")
    chosen = alone | ((F.col("node") == F.col("first.node")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return placed.select("doc_id", "h1", "h2", "node", "twin").join(named, "node").select("doc_id", "h1", "h2", component.alias("component_id"), chosen.alias("chosen"))


def similar_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5, **how) -> DataFrame:
    """(doc_id, component_id) of every document row, by similar texts.

    Texts are compared as sequences of lower-cased (A-Z) words. Two texts are linked if their sets of shingles of
    ``words`` words (fewer words: the whole sequence) have a Jaccard similarity of ``similarity`` or more. Equal
    sequences, told by 128 bits of hashes, are one class, empty and null ones too. component_id is the least doc_id
    that links reach; rows without ids have none.

    Pairs whose fingerprints of ``shingle`` words are within ``radius`` come first: the sets are compared along a
    spanning forest of the fingerprints. All other pairs that are similar have one of their rarest shingles in common.
    """
    return _similar(docs, similarity, words, **how).select("doc_id", "component_id")


def remove_near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, **how) -> DataFrame:
    """One document of each component of similar texts, that of the least id, with all its columns.

    Rows are judged by id and text, so that rows of one id (or none) with other texts stay; rows of one id
    and equal texts stay or go together.
    """
    lost = _similar(docs, similarity, words, **how).filter("NOT chosen").select(F.col("doc_id").alias("__id"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct()
    text = F.coalesce(docs["text"], F.lit(""))
    lost = small_side(stored(lost, "lost"))
    same = docs["doc_id"].cast("long").eqNullSafe(lost["__id"]) & (F.xxhash64(text) == lost["__h1"]) & (F.xxhash64(F.lit("second"), text) == lost["__h2"])
    return docs.join(lost, same, "left_anti")
