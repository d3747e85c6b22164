"""Sequence packing: shortest pack first over the histogram of piece lengths.

Documents are cut into full sequences and one rest. The histogram of lengths (at most one entry for
each length up to the maximum, however large the corpus) is packed on the driver: lengths are taken
longest first, and each goes to the packs with the most room that hold it, all packs of one pattern
at a time. Pieces then get ranks within their length and find pattern, sequence and offset by rank.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Most entries of a worker's cache of encoded words.
CACHE = 300_000
END = np.zeros(1, "<u4").tobytes()
#: Texts of these characters, without runs of white space, are cut alike by both libraries at every blank.
_PLAIN = re.compile("[\n -~¡-ɏ]*")
_RUN = re.compile(r"\s\s")


class Encoder(dict):
    """Ids of a text as little-endian bytes, as the tokenizers library gives them.

    Plain texts go word by word through a cache (this dictionary); its misses are encoded with the
    same vocabulary read as ranks. Others go to the library whole. Pre-tokens never run across a
    blank or a line feed that stands alone, hence words can be encoded one by one.
    """

    def __init__(self, json_path: str, ranks_path: str, special: str = "<|endoftext|>"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = special

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.ranked.encode_ordinary(word), "<u4").tobytes()
        if len(self) < CACHE and len(word) <= 40:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.special in text or not _PLAIN.fullmatch(text) or _RUN.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
        return self[first] + b"".join(map(self.__getitem__, rest))


@lru_cache(maxsize=2)
def _encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def cut(docs: DataFrame, json_path: str, ranks_path: str, most: int = 1024) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full pieces of ``most`` ids, then the rest.

    Each document's ids end with id 0; null counts as empty, which is that id alone.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(json_path, ranks_path)
        for b in batches:
            ids, starts, crcs, totals, lengths = [], [], [], [], []
            for doc_id, text in zip(b.doc_id, b.text, strict=True):
                raw = encoder.encode(text) + END
                n = len(raw) // 4
                for s in range(0, n, most):
                    ids.append(doc_id)
                    starts.append(s)
                    lengths.append(min(most, n - s))
                    crcs.append(zlib.crc32(raw[4 * s : 4 * (s + most)]))
                    totals.append(n)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=b.doc_id.dtype), "start": starts, "length": lengths, "ids_crc32": crcs, "doc_tokens": totals}, dtype=None)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(counts: dict[int, int], most: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (number of packs, [(length, times), ...] longest first)."""
    room: dict[int, list] = {}  # space left -> [(packs, pattern)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            space = max((s for s in room if s >= length), default=None)
            if space is None:
                times = most // length
                full, rest = divmod(left, times)
                for packs, k in ((full, times), (1 if rest else 0, rest)):
                    if packs:
                        room.setdefault(most - k * length, []).append((packs, [(length, k)]))
                break
            packs, pattern = room[space].pop()
            if not room[space]:
                del room[space]
            took = min(packs, left)
            if packs > took:
                room.setdefault(space, []).append((packs - took, pattern))
            grown = [*pattern[:-1], (length, pattern[-1][1] + 1)] if pattern[-1][0] == length else [*pattern, (length, 1)]
            room.setdefault(space - length, []).append((took, grown))
            left -= took
    return [x for s in sorted(room) for x in room[s]]


def segments(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces in each sequence, first offset)."""
    out, ranks, sequence = [], {}, 0
    for packs, pattern in patterns:
        offset = 0
        for length, times in pattern:
            first = ranks.get(length, 0)
            out.append((length, first, packs * times, sequence, times, offset))
            ranks[length] = first + packs * times
            offset += length * times
        sequence += packs
    return out


def with_ranks(pieces: DataFrame, group: int = 50_000) -> DataFrame:
    """Adds ``rank``, from 0 within each length.

    A length may hold any share of all pieces, so each is dealt into buckets by hash; a rank is the
    sum of the buckets before and the place in its own.
    """
    buckets = pieces.count() // group + 16
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return keyed.withColumn("place", F.row_number().over(own)).join(ahead, ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.col("place") - 1).drop("bucket", "place", "ahead")


def pack(docs: DataFrame, json_path: str, ranks_path: str, most: int = 1024) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece.

    Repeated rows each give their pieces; an empty table gives none; other columns aren't carried.
    """
    spark = docs.sparkSession
    pieces = stored(cut(docs, json_path, ranks_path, most), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``most`` rows
    found = segments(pack_histogram(counts, most))
    seg = spark.createDataFrame(found, "s_length long, first long, ranks long, sequence long, times long, at long")
    if len(found) <= 100_000:
        seg = F.broadcast(seg)
    ranked = with_ranks(pieces)
    place = F.col("rank") - F.col("first")
    joined = ranked.join(seg, (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks")))
    return joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(place / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(place, F.col("times")) * F.col("length")).cast("long").alias("offset"),
    )
