"""Ranked lexical search with a hierarchical tree of maxima over ranges of documents.

Documents lie in shards of bounded size, within a shard by their ids. Each term has a tree over them:
the greatest value that it adds to a document's score, of the shard, of its ranges of 512 documents, of
those of 32, and the documents' own. A sum of such maxima over an item's terms bounds the scores of a
range. Shards are opened in rounds, for each item those of the highest bounds first; inside, the ranges
of the highest bounds are opened first. What is below the score of the last of the best found so far
stays closed; a range whose bound equals that score is opened, as one of its documents may have a
smaller id. All arithmetic is on 64-bit integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_side, stored

#: Bytes that are no part of a term become blanks, A-Z become a-z (fixed by the contract); all beyond ASCII is part of one.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Most documents of a shard, and most postings after which one ends; documents of a range at the lowest level, ranges of the next one.
SHARD, POSTINGS, RANGE, FAN = 8192, 4_000_000, 32, 16
#: Up to so many terms are sent to all workers, to index no others; beyond, all terms are indexed and joined.
SENT_TERMS = 500_000
#: Items, and terms of theirs, that are searched together (about); shards that an item opens in the first round, and how many times as
#: many in each further one.
ITEMS, TERMS, FIRST, MORE = 256, 20_000, 1, 8
#: Ranges that are opened together.
OPENED = 8


def terms(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, block, term): distinct terms of each item_id (the rows of an id are one item), dealt into blocks of about ``ITEMS`` of them or ``TERMS`` of their terms."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [[w.decode() for w in dict.fromkeys(terms(t))] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(own, pa.list_(pa.string()))], names=["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    texts = items.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    each = stored(texts.mapInArrow(split, f"item_id {kind}, terms array<string>").select("item_id", F.explode("terms").alias("term")).distinct(), "item-words")
    # stored, so that the numbers given here don't change
    named = stored(each.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-named.count() // ITEMS), -(-each.count() // TERMS))
    named = named.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    return stored(each.join(named, each["item_id"].eqNullSafe(named["item_id"])).select("item", named["item_id"], "block", "term"), "item-terms")


def index(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shards' postings and documents: (shard, term, place, tf, words, ids).

    A row with a term has the places of its documents in the shard, how often they hold it and their
    numbers of terms; the row of a shard without one has the ids and numbers of terms of its documents.
    ``wanted`` (column term, distinct) are the terms that are indexed.
    """
    context = docs.sparkSession.sparkContext
    few = wanted.count() <= SENT_TERMS
    sent = context.broadcast({r["term"].encode() for r in wanted.collect()}) if few else None
    kinds = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("place", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = sent.value if sent else None
        shard = TaskContext.get().partitionId() << 32
        ids, words, codes, term, doc, tf = [], [], {}, [], [], []

        def whole() -> pa.RecordBatch:
            order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0)), np.int64)
            place_of = np.empty(len(ids), np.int64)
            place_of[order] = np.arange(len(ids))
            n = np.array(words, np.int64)
            of, place, count = np.array(term, np.int64), place_of[np.array(doc, np.int64)], np.array(tf, np.int64)
            by = np.lexsort((place, of))
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(codes))))).astype(np.int32))
            last = len(codes)
            rows = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (place[by].astype(np.int32), count[by], n[order][place[by]])]
            none = [pa.array([None], x.type) for x in rows[:2]]
            columns = [
                pa.array([shard] * (last + 1), pa.int64()),
                pa.array([t.decode() for t in codes] + [None], pa.string()),
                *(pa.concat_arrays([a, b]) for a, b in zip(rows[:2], none, strict=True)),
                pa.concat_arrays([rows[2], pa.array([n[order]], rows[2].type)]),
                pa.array([None] * last + [[ids[k] for k in order]], kinds.field("ids").type),
            ]
            return pa.record_batch(columns, schema=kinds)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = terms(text)
                counts = Counter(own)
                held = counts.keys() & only if only is not None else counts.keys()
                term.extend([codes.setdefault(t, len(codes)) for t in held])
                tf.extend([counts[t] for t in held])
                doc.extend([len(ids)] * len(held))
                ids.append(doc_id)
                words.append(len(own))
                if len(ids) >= SHARD or len(term) >= POSTINGS:
                    yield whole()
                    shard += 1
                    ids, words, codes, term, doc, tf = [], [], {}, [], [], []
        if ids:
            yield whole()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    out = texts.mapInArrow(build, "shard long, term string, place array<int>, tf array<long>, words array<long>, ids array<long>")
    return stored(out, "postings")


class _Shard:
    """The trees of a shard's terms; all rows of the arrays are terms."""

    def __init__(self, places: list[np.ndarray], values: list[np.ndarray], weights: np.ndarray, documents: int):
        ranges = -(-documents // (RANGE * FAN)) * FAN
        sizes = [len(p) for p in places]
        self.place = np.concatenate(places)
        self.value = np.concatenate(values) * np.repeat(weights, sizes)
        key = np.repeat(np.arange(len(places)), sizes) * ranges + self.place // RANGE
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        low = np.zeros(len(places) * ranges, np.int64)
        low[key[first]] = np.maximum.reduceat(self.value, first)
        self.pointer = np.concatenate(([0], np.cumsum(np.bincount(key, minlength=len(low)))))
        self.ranges = ranges
        self.low = low.reshape(len(places), ranges)
        self.high = self.low.reshape(len(places), -1, FAN).max(axis=2)

    def scores(self, own: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """Scores of the documents of the ranges, a row for each."""
        at = (own[:, None] * self.ranges + ranges).ravel()
        start, size = self.pointer[at], self.pointer[at + 1] - self.pointer[at]
        ends = np.cumsum(size)
        posting = np.arange(ends[-1]) + np.repeat(start - ends + size, size)
        row = np.repeat(np.tile(np.arange(len(ranges)), len(own)), size)
        out = np.zeros((len(ranges), RANGE), np.int64)
        np.add.at(out, (row, self.place[posting] % RANGE), self.value[posting])
        return out

    def best(self, own: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents with a score of ``least`` or more, ties by place.

        The frontier holds ranges of both levels by their bounds; those of the highest are opened first.
        """
        bound = self.high[own].sum(axis=0)
        node = np.arange(len(bound)) + self.ranges  # numbers from self.ranges on are ranges of the upper level
        place, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            alive = bound >= least  # equal ones as well: their documents may come first among ties
            node, bound = node[alive], bound[alive]
            if not len(node):
                return place, score
            order = np.argsort(-bound, kind="stable")
            opened, node, bound = node[order[:OPENED]], node[order[OPENED:]], bound[order[OPENED:]]
            upper, leaves = opened[opened >= self.ranges] - self.ranges, opened[opened < self.ranges]
            if len(upper):
                below = (upper[:, None] * FAN + np.arange(FAN)).ravel()
                node, bound = np.concatenate((node, below)), np.concatenate((bound, self.low[np.ix_(own, below)].sum(axis=0)))
            if len(leaves):
                found = self.scores(own, leaves)
                row, column = np.nonzero(found >= least)
                place = np.concatenate((place, leaves[row] * RANGE + column))
                score = np.concatenate((score, found[row, column]))
                top = np.lexsort((place, -score))[:k]
                place, score = place[top], score[top]
                if len(score) == k:
                    least = max(least, int(score[-1]))


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each item.

    Ranks from 1, ties by ascending doc_id (null last). Rows of one item_id are one item; each document
    row is a document. Null and empty texts have no terms; items without terms, or whose terms no document
    holds, give no rows. Other columns aren't carried.
    """
    asked = item_terms(items)
    postings = index(docs, asked.select("term").distinct())
    documents = postings.filter("term IS NULL").select("shard", "ids", "words")
    sums = documents.select(F.explode("words").alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = sums[0], sums[1] or 0
    lists = asked.groupBy("block", "term").agg(F.collect_list("item").alias("items"))
    frequency = postings.filter("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("place")).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("long")
    sought = stored(lists.join(frequency, "term").select("block", "term", "items", weight.alias("w")).filter("w > 0"), "sought")
    trees = _trees(postings, documents, F.broadcast(sought) if asked.count() <= BROADCAST_ROWS else sought, n_docs, n_terms)
    found, pending, opened = None, _bounds(trees), FIRST
    while True:
        at = Window.partitionBy("item").orderBy(F.desc("bound"), "block", "shard")
        ranked = stored(pending.withColumn("nth", F.row_number().over(at)), "bounds")
        if ranked.isEmpty():
            break
        new = _opened(trees, ranked.filter(F.col("nth") <= opened), k)
        found = stored(_top(found.drop("rank").unionByName(new) if found else new, k), "found")
        last = found.filter(F.col("rank") == k).select("item", F.col("score").alias("last"))
        rest = ranked.filter(F.col("nth") > opened).join(last, "item", "left").withColumn("least", F.coalesce("last", "least"))
        pending = rest.filter(F.col("bound") >= F.col("least")).select("block", "shard", "item", "bound", "least")
        opened *= MORE
    named = asked.select("item", "item_id").distinct()
    if found is None:
        return named.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).filter("false")
    return found.join(named, "item").select("item_id", "rank", "doc_id", "score")


def _trees(postings: DataFrame, documents: DataFrame, sought: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(block, shard, items, w, place, value, top, ids): for each block of items the trees of its terms, and a row with the shard's ids."""
    blocks = [r["block"] for r in sought.select("block").distinct().collect()]
    value = F.expr(f"transform(arrays_zip(tf, words), p -> (1000000000L * p.tf) div (1000L * p.tf + 20L * (50L + (50L * p.words * {n_docs}L) div {max(1, n_terms)}L)))")
    trees = postings.filter("term IS NOT NULL").select("shard", "term", "place", value.alias("value")).join(sought, "term")
    trees = trees.select("block", "shard", "items", "w", "place", "value", F.array_max("value").alias("top"), F.lit(None).cast("array<long>").alias("ids"))
    empty = [F.lit(None).cast(kind).alias(c) for c, kind in trees.dtypes[2:-1]]
    own = documents.select(F.explode(F.array(*map(F.lit, blocks)).cast("array<int>")).alias("block"), "shard", *empty, "ids")
    return stored(trees.unionByName(own), "trees")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.select("item", "doc_id", "score", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= k)


def _bounds(trees: DataFrame) -> DataFrame:
    """(block, shard, item, bound, least): the roots' bounds, of all shards that hold a term of the item."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        items, counts = rows["items"].combine_chunks(), np.diff(rows["items"].combine_chunks().offsets.to_numpy())
        item, place = np.unique(items.flatten().to_numpy(), return_inverse=True)
        bound = np.zeros(len(item), np.int64)
        np.add.at(bound, place, np.repeat(rows["most"].to_numpy(), counts))
        n = len(item)
        return pa.table({"block": pa.array([key[0].as_py()] * n, pa.int32()), "shard": pa.array([key[1].as_py()] * n, pa.int64()), "item": item, "bound": bound, "least": np.ones(n, np.int64)})

    tops = trees.filter("ids IS NULL").select("block", "shard", "items", (F.col("w") * F.col("top")).alias("most"))
    return tops.groupBy("block", "shard").applyInArrow(add, "block int, shard long, item long, bound long, least long")


def _opened(trees: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score): the best documents of the chosen shards, those with the item's ``least`` or more."""

    def open_shard(rows: pa.Table, chosen: pa.Table) -> pa.Table:
        listed = rows["ids"].is_valid().to_numpy()
        ids = rows.filter(pa.array(listed))["ids"].to_pylist()[0]
        rows = rows.filter(pa.array(~listed))
        arrays = [[x.values.to_numpy() for x in rows[c]] for c in ("place", "value")]
        shard = _Shard(arrays[0], arrays[1], rows["w"].to_numpy(), len(ids))
        items = rows["items"].combine_chunks()
        item, row = items.flatten().to_numpy(), np.repeat(np.arange(len(rows)), np.diff(items.offsets.to_numpy()))
        order = np.argsort(item, kind="stable")
        item, row = item[order], row[order]
        out = []
        for i, least in zip(chosen["item"].to_pylist(), chosen["least"].to_pylist(), strict=True):
            own = row[np.searchsorted(item, i) : np.searchsorted(item, i, "right")]
            place, score = shard.best(own, k, least)
            out += [(i, ids[p], s) for p, s in zip(place.tolist(), score.tolist(), strict=True)]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({c: pa.array(list(v), pa.int64()) for c, v in zip(("item", "doc_id", "score"), columns, strict=True)})

    keys = ["block", "shard"]
    used = trees.join(small_side(stored(chosen.select(*keys).distinct(), "open")), keys, "left_semi")
    pairs = chosen.select(*keys, "item", "least")
    return used.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInArrow(open_shard, "item long, doc_id long, score long")
