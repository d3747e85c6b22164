import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pixelloom.llm import queries
from pixelloom.llm.sentence_pieces import _coded, _decoded, _decoded_numbers, _packed, _unpacked, decode, encode, numbered, segmented

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "\n", " \n", "\n ", "\n\n a", "a", " a", "a ", "a\n", "a\nb c", "a \nb", "a\n b", "a  b", "a   \n  b", "x" * 5000, "a▁b", "▁", "▁ ▁\n▁", "<s>x</s> <unk>", "<0x41> <0x0A>",
    "é ñ ﬁ 漢字\t1234", "a\x00b \r\n", "日本 語", "🙂🙂 ok", "a b " * 3000, "　x \xa0y", "é ﻿z",
]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("block", [1, 40, 8_000_000])
def test_every_text_as_the_library_has_it(spark, lib, block):
    rows = [(i, t, "clash", [0]) for i, t in enumerate([*TEXTS, "a", "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, ids array<int>")
    got = decode(encode(docs, PATH, block), PATH, to="again").collect()
    assert sorted((r.doc_id, r.ids, r.again) for r in got) == [(i, lib.encode(t or ""), lib.decode(lib.encode(t or ""))) for i, t, *_ in rows]


def test_ids_of_any_kind_are_decoded_as_the_library_does(lib):
    rng = random.Random(1)
    some = [28705, 259, 260, 263, 264, 13, 198, 172, 231, 187, 131, 68, 35, 0, 1, 2]
    lists = [[], *([a] for a in some), *([a, b] for a in some for b in some)]
    lists += [[rng.choice(some) if rng.random() < 0.7 else rng.randrange(32000) for _ in range(rng.randint(1, 9))] for _ in range(3000)]
    lists += [[rng.randrange(3, 32000) for _ in range(rng.randint(1, 9))] for _ in range(3000)]
    assert [x for x in lists if _decoded(x, PATH) != lib.decode(x)] == []


def test_each_word_is_listed_once_in_a_block(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b  c"), (3, None)], "doc_id long, text string").coalesce(1)
    rows = numbered(docs, buckets=2).collect()
    (texts,) = [r for r in rows if r.bucket is None]
    assert texts.ids == [1, 2, 3] and _unpacked(bytes(texts.sizes)).tolist() == [3, 2, 0]
    assert _decoded_numbers(_unpacked(bytes(texts.numbers)), texts.first).tolist() == [0, 1, 0, 1, 2]
    listed = {}
    for r in rows:
        if r.bucket is not None:
            words = zlib.decompress(bytes(r.words)).split(b"\xff")
            assert all(zlib.crc32(w) % 2 == r.bucket for w in words)
            listed |= dict(zip(_unpacked(bytes(r.numbers)).cumsum().tolist(), words, strict=True))
    assert listed == {0: b"a", 1: b"b", 2: b" c"} and len({r.block for r in rows}) == 1
    assert len({r.block for r in numbered(docs, 1).collect()}) == 3


def test_coded_numbers():
    rng = random.Random(2)
    words, first = {}, 0
    for _ in range(50):
        own = [words.setdefault(rng.randrange(200), len(words)) for _ in range(rng.randint(0, 20))]
        coded = _coded(np.array(own, np.int64), first)
        assert _decoded_numbers(coded, first).tolist() == own and (coded == 0).sum() == len(words) - first
        first = len(words)


def test_a_full_table_is_emptied(spark, lib):
    words = [f"w{i}x{i % 7}" for i in range(50)]
    rows = [(k, _packed(np.arange(50)), zlib.compress(b"\xff".join(w.encode() for w in words))) for k in range(3)]
    got = segmented(spark.createDataFrame(rows, "of long, numbers binary, words binary").coalesce(1), PATH, table=60).collect()
    for r in got:
        ends = _unpacked(bytes(r.counts)).cumsum()[:-1]
        assert [x.tolist() for x in np.split(_unpacked(bytes(r.ids)), ends)] == [lib.encode(w) for w in words]
    assert [r.of for r in got] == [0, 1, 2]


def test_packing_of_numbers():
    for x in ([], [0], [1, 2**32 - 1, 65536, 7]):
        assert _unpacked(_packed(np.array(x, np.uint32))).tolist() == x


def test_null_ids_and_an_empty_table(spark, lib):
    kind = "doc_id long, text string"
    got = encode(spark.createDataFrame([(None, "a b"), (None, "a b"), (2**60 + 1, None)], kind), PATH).collect()
    assert sorted((repr(r.doc_id), r.ids) for r in got) == [(str(2**60 + 1), []), *[("None", lib.encode("a b"))] * 2]
    assert encode(spark.createDataFrame([], kind), PATH).count() == 0
    assert decode(spark.createDataFrame([(None, "x")], "ids array<int>, text string"), PATH).collect()[0].text == ""


def test_query_on_the_whole_table(spark, lib):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {tuple(r) for r in queries.op12_sentence_pieces(spark, "/root/testdata/sf0.01").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = {d.doc_id: lib.encode(d.text or "") for d in docs}
    assert got == {(k, len(x), sha(",".join(map(str, x))), sha(lib.decode(x))) for k, x in ids.items()}
