"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary runs across a whitespace marker or a line feed (checked), so a text's ids
are those of its marked words, one after the other. Documents are dealt into blocks of bounded size
where each position holds the number of its word in the block's own list. The lists are what is
shuffled, packed: each distinct word goes to the one bucket of its hash, whose table segments it once,
its ids go back to the blocks that list it, and the positions take them from there.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir
from .token_count import MARK, check_vocabulary, library, marked_words

#: Characters after which a block of documents ends; a longer document is a block of its own.
BLOCK = 10_000_000
#: Documents in a row of the stored table.
ROW = 256
#: Most words of a bucket's table; a fuller one is emptied, and may segment a word anew.
TABLE = 500_000
#: Stands between packed words; no byte of UTF-8.
BETWEEN = b"\xff"


class _Numbers(dict):
    """Word -> its number, in the order of first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by their low bytes, then the next ones: the high ones are nearly all zero."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _rows(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _coded(numbers: np.ndarray, first: int) -> np.ndarray:
    """0 for a word's first use, which has the next number from ``first`` on, else its number and one."""
    before = np.maximum.accumulate(np.concatenate(([first], numbers + 1)))[:-1]
    return np.where(numbers >= before, 0, numbers + 1)


def _decoded_numbers(coded: np.ndarray, first: int) -> np.ndarray:
    new = coded == 0
    numbers = coded.astype(np.int64) - 1
    numbers[new] = first + np.arange(new.sum())
    return numbers


def numbered(docs: DataFrame, block: int = BLOCK, buckets: int = 64) -> DataFrame:
    """(block, bucket, first, ids, sizes, numbers, words) of two kinds of rows.

    Without a bucket: some documents, their numbers of words, and all these words as coded numbers in the block's
    list, of which ``first`` come from earlier rows. For each bucket that the list has words of: these words and their
    numbers, as differences.
    """
    kinds = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("first", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("numbers", pa.binary()), ("words", pa.binary())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, words = TaskContext.get().partitionId() << 32, 0, _Numbers()
        first, ids, own = 0, [], []

        def row() -> pa.RecordBatch:
            numbers = _packed(_coded(np.concatenate(own), first))
            return _rows([[name], [None], [first], [ids], [_packed(np.array([len(x) for x in own]))], [numbers], [None]], kinds)

        def lists() -> Iterator[pa.RecordBatch]:
            listed = np.array([w.encode() for w in words], object)
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in listed), np.int64, len(listed))
            order = np.argsort(bucket, kind="stable")
            used, at = np.unique(bucket[order], return_index=True)
            for b, part in zip(used.tolist(), np.split(order, at[1:]), strict=False):
                yield _rows([[name], [b], [None], [None], [None], [_packed(np.diff(part, prepend=0))], [zlib.compress(BETWEEN.join(listed[part]))]], kinds)

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                text = text.as_py()
                marked = marked_words(text)
                own.append(np.fromiter(map(words.__getitem__, marked), np.int64, len(marked)))
                ids.append(doc_id.as_py())
                size += len(text)
                if size >= block or len(ids) >= ROW or len(marked) > ROW * ROW:
                    yield row()
                    first, ids, own = len(words), [], []
                if size >= block:
                    yield from lists()
                    name, size, words, first = name + 1, 0, _Numbers(), 0
        if ids:
            yield row()
        if size or words:
            yield from lists()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(number, "block long, bucket int, first long, ids array<long>, sizes binary, numbers binary, words binary")


def segmented(lists: DataFrame, path: str, table: int = TABLE) -> DataFrame:
    """(of, numbers, counts, ids) for each row (of, numbers, words; ``of``: the block) of the buckets that a partition holds: the ids
    that the marked words have inside a text, each word segmented once."""
    check_vocabulary(path)
    kinds = pa.schema([("of", pa.int64()), ("numbers", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, known = library(path), {}
        alone = [lib.piece_to_id(MARK)]
        for b in batches:
            out = []
            for words in b.column(2):
                own = [w.decode() for w in zlib.decompress(words.as_py()).split(BETWEEN)]
                new = [w for w in own if w not in known]
                if len(known) + len(new) > table:
                    known, new = {}, own
                # the library marks what it is given; that mark isn't there before a line feed, and all there is of an empty word
                known.update((w, x[1:] if w[:1] == "\n" else x or alone) for w, x in zip(new, lib.encode(new, num_threads=1), strict=True))
                each = [known[w] for w in own]
                counts = np.fromiter(map(len, each), np.uint32, len(each))
                out.append((_packed(counts), _packed(np.fromiter((i for x in each for i in x), np.uint32, int(counts.sum())))))
            yield _rows([b.column(0).to_pylist(), b.column(1).to_pylist(), *map(list, zip(*out, strict=True))] if out else [[]] * 4, kinds)

    return lists.select("of", "numbers", "words").mapInArrow(segment, "of long, numbers binary, counts binary, ids binary")


def _taken(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` from ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def encode(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids) of every whole text: what the library's ``encode`` gives, without begin and end.

    Null counts as empty: no ids. Repeated rows each give a row; other columns aren't carried.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = _by_block(numbered(docs, block, buckets), buckets)
    lists = coded.filter("bucket IS NOT NULL").select("bucket", F.col("block").alias("of"), "numbers", "words").repartition(buckets, "bucket")
    entries = segmented(lists, path)

    def place(docs: pa.Table, entries: pa.Table) -> pa.Table:
        number, size, values = (np.concatenate([f(_unpacked(x.as_py())) for x in entries[c]] or [np.zeros(0, np.int64)]) for c, f in (("numbers", np.cumsum), ("counts", np.asarray), ("ids", np.asarray)))
        starts, sizes = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
        starts[number], sizes[number] = np.cumsum(size) - size, size
        del number, size
        doc_ids, each, ends = [], [], [np.zeros(1, np.int64)]
        for ids, first, words, data in zip(*(docs[c] for c in ("ids", "first", "sizes", "numbers")), strict=True):
            own = _decoded_numbers(_unpacked(data.as_py()), first.as_py())
            after = np.concatenate(([0], np.cumsum(sizes[own])))
            ends.append(ends[-1][-1] + after[np.cumsum(_unpacked(words.as_py()))])
            each.append(_taken(values, starts[own], sizes[own]).astype(np.int32))
            doc_ids += ids.as_py()
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(ends)), pa.array(np.concatenate(each)))
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": lists.cast(pa.list_(pa.int32()))})

    texts = coded.filter("bucket IS NULL").select("block", "ids", "first", "sizes", "numbers")
    return texts.groupBy("block").cogroup(entries.groupBy("of")).applyInArrow(place, "doc_id long, ids array<int>")


def _by_block(coded: DataFrame, buckets: int) -> DataFrame:
    """``coded`` stored in the shared folder in files by block, so that its rows needn't be shuffled to meet those of their block."""
    spark = coded.sparkSession
    name = f"numbered_{uuid.uuid4().hex}"
    coded.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "block").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are outside the warehouse
    return out


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[list[bytes], frozenset[int]]:
    """The bytes that each id stands for, and the ids that aren't text."""
    lib = library(path)
    every = range(lib.vocab_size())
    text = [bytes([int(lib.id_to_piece(i)[1:-1], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace(MARK, " ").encode() for i in every]
    return text, frozenset(i for i in every if lib.is_control(i) or lib.is_unknown(i))


def _decoded(ids: list[int], path: str) -> str:
    pieces, other = _pieces(path)
    if ids and (ids[0] in other or not other.isdisjoint(ids)):
        return library(path).decode(ids)
    try:
        text = b"".join([pieces[i] for i in ids]).decode()
    except UnicodeDecodeError:  # byte pieces that are no character
        return library(path).decode(ids)
    return text[1:] if ids and library(path).id_to_piece(ids[0])[0] == MARK else text


def decode(coded: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``coded`` with a column ``to`` (replaced if it is there): the text that the library's ``decode`` gives for ``ids``. Null ids give an empty text."""
    kept = [c for c in coded.columns if c != to]
    schema = T.StructType([coded.schema[c] for c in kept] + [T.StructField(to, T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([_decoded(x.values.to_numpy(zero_copy_only=False).tolist(), path) if x.is_valid else "" for x in b.column(ids)], pa.string())
            yield pa.record_batch([*(b.column(c) for c in kept), texts], names=[*kept, to])

    return coded.mapInArrow(read, schema)
