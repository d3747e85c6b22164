import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pixelloom.llm import packing as P
from tokenizers import Tokenizer

PATHS = [public_tokenizers.path(f"byte_bpe_50k.{k}") for k in ("json", "tiktoken")]
LIB = Tokenizer.from_file(PATHS[0])
TEXTS = [
    None, "", " ", "a", " a b\nc", "a\n\nb  c ", "it's we'll O'Neil's", "Größe ñandú çà ¼²³ ªº 12.5%", "<|endoftext|>a<|endoftext|>", "漢字 🙂  x", "x" * 3000, "a b c d " * 3000, "\ttab\x1fodd\x85", "a\n", "\na", "soft\xadhyphen\xa0nbsp", "a", "a",
]


def ids(text):
    return np.array([*LIB.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_is_the_library():
    encoder = P.Encoder(*PATHS)
    for t in TEXTS[1:]:
        assert encoder.encode(t) == ids(t)[:-1].tobytes(), t


def test_encoder_on_a_table(spark):
    encoder = P.Encoder(*PATHS)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert encoder.encode(r.text) == ids(r.text)[:-1].tobytes()


def check(got, texts, most):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, t in enumerate(texts):
        x, at = ids(t), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[at : at + r.length].tobytes())
            at += r.length
        assert at == len(x)
    assert set(by_sequence) == set(range(len(by_sequence)))
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most
        padding, total = padding + (0 if at & (at - 1) == 0 else most - at), total + at
    return padding / total


def test_every_id_lies_in_one_piece(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, length int")
    check(P.pack(docs, *PATHS).collect(), TEXTS, 1024)


def test_little_padding_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    share = check(P.pack(docs, *PATHS).collect(), texts, 1024)
    print("padding", share)
    assert share < 0.01


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_histogram_packing(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(v) for k, v in zip(rng.integers(1, 129, 40), rng.integers(1, 500, 40), strict=True)}
    patterns = P.pack_histogram(counts, 128)
    assert all(sum(a * b for a, b in p) <= 128 for _, p in patterns)
    total = defaultdict(int)
    for n, p in patterns:
        for length, times in p:
            total[length] += n * times
    assert total == counts
    seen = defaultdict(set)
    for length, first, ranks, *_ in P.segments(patterns):
        assert not seen[length] & set(range(first, first + ranks))
        seen[length] |= set(range(first, first + ranks))
    assert {k: len(v) for k, v in seen.items()} == counts
