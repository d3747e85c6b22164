"""Media columns: bytes as Netpbm or BMP images, decoded to numpy arrays and area-resized.

Decoded images are grey with 8 bits a sample, or RGB; samples of another maximum are scaled, of bit
maps black is 0 and white 255, and opacity is left out. A thumbnail is made by integral images: every
target cell is the exact area mean of the source, fractions of pixels included. It is written as an
NPY tile, with a difference hash (each cell against its right neighbour).
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 64
_GAP = rb"(?:\s|#[^\n]*\n)+"
_COMMENT = re.compile(rb"#[^\n]*")


def encode_pgm(a: np.ndarray) -> bytes:
    """Binary PGM (2-D) or PPM (3-D) of 8-bit samples."""
    kind = b"P5" if a.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """Uncompressed BMP: 8-bit palette for 2-D, 24-bit for 3-D; rows run from the bottom."""
    h, w = a.shape[:2]
    grey = a.ndim == 2
    rows = a[::-1] if grey else a[::-1, :, ::-1]
    pad = -(w * (1 if grey else 3)) % 4
    body = b"".join(r.astype(np.uint8).tobytes() + b"\0" * pad for r in rows)
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    start = 54 + len(palette)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + len(body), 0, 0, start, 40, w, h, 1, 8 if grey else 24, 0, len(body), 2835, 2835, 256 if grey else 0, 0)
    return head + palette + body


def decode(media: bytes) -> np.ndarray:
    """Array of an image: (h, w) grey or (h, w, 3) RGB; ValueError for any other format."""
    if media[:2] == b"BM":
        start, _, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", media, 10)
        if packed or bits not in (8, 24):
            raise ValueError(f"BMP with {bits} bits, compression {packed}")
        n = 1 if bits == 8 else 3
        stride = (w * n + 3) // 4 * 4
        rows = np.frombuffer(media, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * n]
        rows = rows[::-1] if h > 0 else rows
        if bits == 24:
            return rows.reshape(abs(h), w, 3)[:, :, ::-1]
        size = struct.unpack_from("<I", media, 46)[0] or 256
        colours = np.frombuffer(media, np.uint8, 4 * size, 14 + struct.unpack_from("<I", media, 14)[0]).reshape(size, 4)
        if (colours[:, 0] == colours[:, 1]).all() and (colours[:, 1] == colours[:, 2]).all():
            return colours[:, 0][rows]
        return colours[:, 2::-1][rows]
    return _netpbm(media)


def _netpbm(media: bytes) -> np.ndarray:
    kind = media[:2]
    if kind == b"P7":
        head, end, _ = media.partition(b"ENDHDR\n")
        fields = dict(line.split(None, 1) for line in head.splitlines()[1:] if line.strip() and line[:1] != b"#")
        w, h, depth, top = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
        at, shape = len(head) + len(end), (h, w, depth)
    else:
        if not (m := re.match(rb"P[1-6]" + (_GAP + rb"(\d+)") * (2 if kind in (b"P1", b"P4") else 3), media)):
            raise ValueError("neither Netpbm nor BMP")
        w, h, top = int(m[1]), int(m[2]), int(m[3]) if m.lastindex == 3 else 1
        at, shape = m.end() + 1, (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    if not 0 < top < 65536:
        raise ValueError(f"a maximum of {top}")
    n = int(np.prod(shape))
    if kind == b"P4":
        stride = (w + 7) // 8
        a = 1 - np.unpackbits(np.frombuffer(media, np.uint8, h * stride, at).reshape(h, stride), axis=1)[:, :w]
    elif kind == b"P1":  # bits need no blanks between them
        bits = np.frombuffer(re.sub(rb"[^01]", b"", _COMMENT.sub(b"", media[at - 1 :])), np.uint8)
        a = 1 - (bits[:n].reshape(shape) - ord("0"))
    elif kind in (b"P2", b"P3"):
        a = np.array(_COMMENT.sub(b"", media[at - 1 :]).split()[:n], np.int64).reshape(shape)
    else:
        a = np.frombuffer(media, ">u2" if top > 255 else np.uint8, n, at).reshape(shape)
    if a.ndim == 3:
        a = a[:, :, 0] if shape[2] < 3 else a[:, :, :3]
    if top != 255:
        a = ((a.astype(np.int64) * 510 + top) // (2 * top)).clip(0, 255)
    return a.astype(np.uint8, copy=False)


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means as float64, from the integral image taken at fractional borders."""
    grey = a.astype(np.float64) if a.ndim == 2 else a.astype(np.float64).mean(axis=2)
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)

    def cut(t: np.ndarray, n: int, parts: int) -> np.ndarray:
        at = np.arange(parts + 1) * (n / parts)
        low = np.minimum(at.astype(np.int64), n - 1)
        return t[low] + (at - low)[:, None] * (t[low + 1] - t[low])

    cells = cut(cut(total, h, height).T, w, width).T
    return np.diff(np.diff(cells, axis=0), axis=1) / ((h / height) * (w / width))


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def difference_hash(tile: np.ndarray) -> str:
    """Hex of the bits "cell is less than its right neighbour", row by row."""
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def text_media(docs: DataFrame, fmt: str = "pgm") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as one grey image of 64 samples a row.

    The UTF-8 bytes are padded with 0 to a positive multiple of 64; null counts as empty; repeated
    rows each give a row. ``fmt``: pgm or bmp.
    """
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[fmt]

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [t.encode() for t in b.text]
            media = [encode(np.frombuffer(r + b"\0" * ((-len(r)) % ROW if r else ROW), np.uint8).reshape(-1, ROW)) for r in raw]
            yield pd.DataFrame({"doc_id": b.doc_id, "n_bytes": [len(r) for r in raw], "media": media})

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(store, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame, height: int = 8, width: int = 8, keep_media: bool = False) -> DataFrame:
    """Reads each stored image back and adds what is computed from its samples.

    payload_bytes, payload_sha256 and tail_crc32 (last 64 samples) tell that storing lost nothing;
    media_bytes and media_sha256 are those of the stored form; ``tile`` is the NPY form of the
    resized samples, ``feature`` their difference hash. Null media have nulls in all of these; an image
    that can't be decoded is an error. Columns of these names are replaced.
    """
    names = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "tile": "binary"}
    kept = media.drop(*names)
    fields = [f for f in kept.schema.fields if keep_media or f.name != "media"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{n} {t}" for n, t in names.items())])

    def one(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * len(names)
        a = decode(m)
        payload = a.tobytes()
        tile = area_resize(a, height, width + 1).astype(np.float32)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(m), hashlib.sha256(m).hexdigest(), difference_hash(tile), npy(tile)

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = pd.DataFrame([one(m) for m in b.media], columns=list(names), index=b.index, dtype=object)
            yield pd.concat([b[[f.name for f in fields]], made.astype({n: "Int64" for n, t in names.items() if t == "long"})], axis=1)

    return kept.mapInPandas(compute, schema)
