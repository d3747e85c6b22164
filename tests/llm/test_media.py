import hashlib
import io
import zlib

import numpy as np
import pytest
from pixelloom.llm import media as M


@pytest.mark.parametrize("shape", [(1, 64), (5, 7), (3, 4, 3), (9, 1)])
def test_codecs_are_lossless(shape):
    a = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (M.decode(M.encode_pgm(a)) == a).all() and (M.decode(M.encode_bmp(a)) == a).all()


def test_ascii_netpbm_and_unknown_formats():
    assert M.decode(b"P2\n# note\n2 2\n255\n1 2 3 4\n").tolist() == [[1, 2], [3, 4]]
    for bad in (b"GIF89a", b"P5\n2 2\n0\n1234", b"P8\n1 1\n255\n1", b""):
        with pytest.raises(ValueError):
            M.decode(bad)


@pytest.mark.parametrize("media,want", [
    (b"P1\n# a comment\n3 2\n1 0 1\n0 1 # more\n0\n", [[0, 255, 0], [255, 0, 255]]), (b"P1 3 2 101010", [[0, 255, 0], [255, 0, 255]]),
    (b"P4\n10 2\n" + bytes([0b10000000, 0b01000000, 0xFF, 0xC0]), [[0] + [255] * 8 + [0], [0] * 10]),
    (b"P2 2 1 15 0 15", [[0, 255]]), (b"P2 3 1 1000 0 500 1000", [[0, 128, 255]]), (b"P3 1 2 255 1 2 3 4 5 6", [[[1, 2, 3]], [[4, 5, 6]]]),
    (b"P5\n#x\n2 1\n# y\n65535\n" + bytes([0, 0, 255, 255]), [[0, 255]]), (b"P5 2 1 100\n" + bytes([100, 50]), [[255, 128]]), (b"P6 1 1 255\n#\n ", [[[35, 10, 32]]]),
    (b"P7\nWIDTH 2\nHEIGHT 1\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" + bytes(range(8)), [[[0, 1, 2], [4, 5, 6]]]), (b"P7\nWIDTH 2\nHEIGHT 1\nDEPTH 2\nMAXVAL 1\nENDHDR\n\x01\x00\x00\x01", [[255, 0]]),
])
def test_netpbm_forms(media, want):
    assert M.decode(media).tolist() == want


def test_null_media_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, None, "x", 5), (2, bytearray(M.encode_pgm(np.zeros((2, 3), np.uint8))), "y", 6)], "doc_id long, media binary, feature string, tile int")
    got = {r.doc_id: r for r in M.features(rows, keep_media=True).collect()}
    assert got[1].media is None and list(got[1])[2:] == [None] * 7 and got[2].payload_bytes == 6 and got[2].feature == "0" * 16
    assert M.features(rows).columns[0] == "doc_id" and len(M.features(rows).columns) == 8
    assert M.features(rows.limit(0)).count() == 0


def test_features_against_plain_means(spark):
    """Tiles and hashes of a whole table by exact sums over a grid of which every cell's share is whole."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in M.features(M.text_media(docs)).collect():
        raw = texts[r.doc_id]
        a = np.frombuffer(raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), np.uint8).reshape(-1, 64)
        fine = np.repeat(np.repeat(a.astype(np.int64), 8, axis=0), 9, axis=1)
        sums = fine.reshape(8, len(a), 9, 64).sum(axis=(1, 3))
        tile = np.load(io.BytesIO(r.tile))
        assert np.allclose(tile, sums / (64 * len(a)), atol=1e-3)
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(r.feature), np.uint8)).reshape(8, 8).astype(bool)
        clear = abs(np.diff(sums, axis=1)) > 1e-3 * 64 * len(a)
        assert (bits == (np.diff(sums, axis=1) > 0))[clear].all()


def test_area_resize_against_direct_means():
    a = np.random.default_rng(2).integers(0, 256, (6, 10), dtype=np.uint8)
    assert np.allclose(M.area_resize(a, 3, 5), a.reshape(3, 2, 5, 2).mean(axis=(1, 3)))
    big = np.kron(a, np.ones((7, 3)))  # every fractional share then falls on whole pixels
    assert np.allclose(M.area_resize(a, 7, 3), big.reshape(7, 6, 3, 10).mean(axis=(1, 3)))


@pytest.mark.parametrize("fmt", ["pgm", "bmp"])
def test_text_media_round_trip(spark, fmt):
    texts = [None, "", "a", "x" * 64, "é" * 40, "y" * 100_000, "a"]
    docs = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in M.features(M.text_media(docs, fmt)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert np.load(io.BytesIO(r.tile)).shape == (8, 9) and len(r.feature) == 16
    assert got[2][1:] == got[6][1:] and got[0][1:] == got[1][1:]
