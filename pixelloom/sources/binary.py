"""Readers and a writer of binary array formats.

Files are read by Spark (``binaryFile``), so that any store it knows will do; a small decoder in the
task turns each file's bytes into rows. A file is the unit of work, as it is in these formats.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARRAYS = "path string, key string, shape array<int>, values array<double>, text string"

#: Fixed values of the DM format: tag value types, and image data types, as numpy codes.
DM_SCALARS = {2: "i2", 3: "i4", 4: "u2", 5: "u4", 6: "f4", 7: "f8", 8: "i1", 9: "i1", 10: "u1", 11: "i8", 12: "u8"}
DM_STRUCT, DM_STRING, DM_ARRAY = 15, 18, 20
DM_IMAGES = {1: "i2", 2: "f4", 3: "c8", 6: "u1", 7: "i4", 9: "i1", 10: "u2", 11: "u4", 12: "f8", 13: "c16", 14: "u1", 39: "i8", 40: "u8"}
DM_THUMBNAIL = 23
#: Fixed values of the MAT format, level 5: data types, and array classes of numbers.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MAT_MATRIX, MAT_PACKED, MAT_CELL, MAT_STRUCT, MAT_CHAR, MAT_DOUBLE = 14, 15, 1, 2, 4, 6


class _Dm:
    """Tags of a DM3 or DM4 file as {path: value}; arrays stay (offset, code, length) until they are asked for."""

    def __init__(self, raw: bytes):
        self.raw, self.tags = raw, {}
        self.version = struct.unpack_from(">i", raw)[0]
        if self.version not in (3, 4):
            raise ValueError(f"DM version {self.version}")
        self.long = ">q" if self.version == 4 else ">i"
        self.at = 4 + struct.calcsize(self.long)
        self.order = "<" if self._take(">i") else ">"
        self._group("")

    def _take(self, code: str) -> int:
        value = struct.unpack_from(code, self.raw, self.at)[0]
        self.at += struct.calcsize(code)
        return value

    def _group(self, path: str) -> None:
        self.at += 2  # sorted, open
        unnamed = 0
        for _ in range(self._take(self.long)):
            kind, n = self._take(">b"), self._take(">H")
            name = self.raw[self.at : self.at + n].decode("latin-1")
            self.at += n
            if not name:
                name, unnamed = str(unnamed), unnamed + 1
            if self.version == 4:
                self.at += 8
            own = f"{path}/{name}" if path else name
            if kind == 20:
                self._group(own)
            elif kind == 21:
                if self.raw[self.at : self.at + 4] != b"%%%%":
                    raise ValueError("DM tag without its delimiter")
                self.at += 4
                info = [self._take(self.long) for _ in range(self._take(self.long))]
                self.tags[own] = self._value(info)

    def _value(self, info: list[int]):
        if info[0] in DM_SCALARS:
            return np.frombuffer(self._bytes(np.dtype(DM_SCALARS[info[0]]).itemsize), self.order + DM_SCALARS[info[0]])[0].item()
        if info[0] == DM_STRUCT:
            return [self._value([t]) for t in info[4::2]]
        if info[0] == DM_STRING:
            return self._bytes(info[1]).decode("utf-16-le" if self.order == "<" else "utf-16-be", "replace")
        if info[1] == DM_STRUCT:
            fields = info[5:-1:2]
            return [[self._value([t]) for t in fields] for _ in range(info[-1])]
        code, n = DM_SCALARS[info[1]], info[-1]
        place = (self.at, code, n)
        self.at += np.dtype(code).itemsize * n
        return place

    def _bytes(self, n: int) -> bytes:
        self.at += n
        return self.raw[self.at - n : self.at]

    def text(self, value) -> str:
        """A tag's value as text; short arrays of 16-bit numbers are strings in this format."""
        if isinstance(value, tuple):
            offset, code, n = value
            if code == "u2" and n <= 4096:
                return self.raw[offset : offset + 2 * n].decode("utf-16-le" if self.order == "<" else "utf-16-be", "replace")
            return f"array of {n} {code}"
        return str(value)

    def images(self) -> Iterator[tuple[str, np.ndarray]]:
        for key in [k for k in self.tags if k.endswith("/ImageData/DataType")]:
            head = key.removesuffix("DataType")
            kind = self.tags[key]
            if kind == DM_THUMBNAIL or kind not in DM_IMAGES:
                continue
            shape = [self.tags[k] for k in sorted(k for k in self.tags if k.startswith(head + "Dimensions/"))]
            offset, *_ = self.tags[head + "Data"]
            data = np.frombuffer(self.raw, self.order + DM_IMAGES[kind], int(np.prod(shape)), offset)
            yield head.removesuffix("/ImageData/"), data.reshape(shape[::-1])


def encode_dm(image: np.ndarray, version: int = 3, scale: float = 1.0, units: str = "") -> bytes:
    """A DM file with one real image and its calibration."""
    kind = next(k for k, c in DM_IMAGES.items() if np.dtype(c) == image.dtype)
    element = next(k for k, c in DM_SCALARS.items() if np.dtype(c) == image.dtype)
    long = ">q" if version == 4 else ">i"

    def tag(kind: int, name: str, body: bytes) -> bytes:
        size = struct.pack(">q", len(body)) if version == 4 else b""
        return struct.pack(">bH", kind, len(name)) + name.encode("latin-1") + size + body

    def group(name: str | None, *tags: bytes) -> bytes:
        body = b"\x01\x00" + struct.pack(long, len(tags)) + b"".join(tags)
        return body if name is None else tag(20, name, body)

    def data(name: str, info: list[int], raw: bytes) -> bytes:
        return tag(21, name, b"%%%%" + struct.pack(long, len(info)) + b"".join(struct.pack(long, i) for i in info) + raw)

    def number(name: str, code: int, value: float) -> bytes:
        return data(name, [code], np.array(value, "<" + DM_SCALARS[code]).tobytes())

    text = units.encode("utf-16-le")
    axis = lambda: group("", number("Origin", 6, 0), number("Scale", 6, scale), data("Units", [DM_ARRAY, 4, len(text) // 2], text))
    block = image.astype(image.dtype.newbyteorder("<")).tobytes()
    content = group(
        "ImageData",
        group("Calibrations", group("Dimension", *(axis() for _ in image.shape))),
        data("Data", [DM_ARRAY, element, image.size], block),
        number("DataType", 5, kind),
        group("Dimensions", *(number("", 5, n) for n in image.shape[::-1])),
        number("PixelDepth", 5, image.dtype.itemsize),
    )
    body = group(None, group("ImageList", group("", content)))
    return struct.pack(">i", version) + struct.pack(long, len(body)) + struct.pack(">i", 1) + body + b"\0" * 8


def _mat_elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(raw):
        kind, n = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:  # short form: length and type in one word, data in the next
            kind, n = kind & 0xFFFF, kind >> 16
            yield kind, raw[at + 4 : at + 4 + n]
            at += 8
        else:
            yield kind, raw[at + 8 : at + 8 + n]
            at += 8 + n + (0 if kind == MAT_PACKED else -n % 8)


def _mat_arrays(raw: bytes, order: str, path: str = "") -> Iterator[tuple[str, np.ndarray | str]]:
    """(key, array or text) of all numeric and text leaves; fields are joined by dots."""
    parts = list(_mat_elements(raw, order))
    if len(parts) < 3:
        return
    kind = np.frombuffer(parts[0][1], order + "u4")[0] & 0xFF
    shape = np.frombuffer(parts[1][1], order + "i4")
    name = path or parts[2][1].decode("latin-1")
    if kind == MAT_STRUCT:
        width = int(np.frombuffer(parts[3][1], order + "i4")[0])
        names = [parts[4][1][i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(parts[4][1]), width)]
        for i, (_, body) in enumerate(parts[5:]):
            n = i // len(names)
            key = f"{name}.{names[i % len(names)]}" if len(parts) - 5 == len(names) else f"{name}[{n}].{names[i % len(names)]}"
            yield from _mat_arrays(body, order, key)
    elif kind == MAT_CELL:
        for i, (_, body) in enumerate(parts[3:]):
            yield from _mat_arrays(body, order, f"{name}{{{i}}}")
    elif len(parts) > 3:
        numbers = np.frombuffer(parts[3][1], order + MAT_TYPES[parts[3][0]])
        if kind == MAT_CHAR:
            yield name, "".join(map(chr, numbers.tolist()))
        elif len(numbers) == int(np.prod(shape)):
            yield name, numbers.reshape(shape, order="F").astype(float)


def decode_mat(raw: bytes) -> dict[str, np.ndarray | str]:
    """Variables of a level 5 MAT file; names that begin with an underscore are left out."""
    order = "<" if raw[126:128] == b"IM" else ">"
    out = {}
    for kind, body in _mat_elements(raw[128:], order):
        if kind == MAT_PACKED:
            kind, body = next(_mat_elements(zlib.decompress(body), order))
        if kind == MAT_MATRIX:
            out |= {k: v for k, v in _mat_arrays(body, order) if not k.startswith("_")}
    return out


def encode_mat(variables: dict[str, np.ndarray]) -> bytes:
    """A MAT file, level 5, of real matrices."""

    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, a in variables.items():
        numbers = np.asarray(a, "<f8").tobytes(order="F")
        body = element(6, struct.pack("<II", MAT_DOUBLE, 0)) + element(5, np.array(a.shape, "<i4").tobytes()) + element(1, name.encode("latin-1")) + element(9, numbers)
        out += element(MAT_MATRIX, body)
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _rows(files: DataFrame, decode) -> DataFrame:
    """(path, key, shape, values, text) of what ``decode`` finds in each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b.path, b.content, strict=True):
                found = [(path, k, None, None, v) if isinstance(v, str) else (path, k, list(v.shape), np.real(v).astype(float).ravel(), None) for k, v in decode(raw)]
                yield pd.DataFrame(found, columns=["path", "key", "shape", "values", "text"])

    return files.mapInPandas(run, ARRAYS)


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    return _rows(_files(spark, path), lambda raw: decode_mat(raw).items())


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    return _rows(_files(spark, path), lambda raw: [("array", np.load(io.BytesIO(raw), allow_pickle=False))])


def read_dm(spark: SparkSession, path: str) -> DataFrame:
    """Images of DM3 and DM4 files, without thumbnails; the real part of complex ones."""
    return _rows(_files(spark, path), lambda raw: _Dm(raw).images())


def dm_tags(files: DataFrame) -> DataFrame:
    """(path, key, text) of all tags of files (path, content); pixel blocks are only named."""

    def decode(raw: bytes):
        dm = _Dm(raw)
        return ((k, dm.text(v)) for k, v in dm.tags.items())

    return _rows(files, decode).select("path", "key", "text")


def read_dm_tags(spark: SparkSession, path: str) -> DataFrame:
    return dm_tags(_files(spark, path))


def to_pixels(arrays: DataFrame) -> DataFrame:
    """Long pixels (path, key, y, x, v) of all two-dimensional arrays."""
    width = F.element_at("shape", 2)
    flat = arrays.filter(F.size("shape") == 2).select("path", "key", width.alias("w"), F.posexplode("values").alias("i", "v"))
    return flat.select("path", "key", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), "v")


def _images(pixels: DataFrame, encode) -> DataFrame:
    """(image_id, content): each image's file. An image is a file, so it is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((pdf.y.max() + 1, pdf.x.max() + 1), np.float32)
        a[pdf.y, pdf.x] = pdf.v
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]], "content": [encode(a)]})

    kind = dict(pixels.dtypes)["image_id"]
    return pixels.select("image_id", "y", "x", "v").groupBy("image_id").applyInPandas(run, f"image_id {kind}, content binary")


def to_dm(pixels: DataFrame, version: int = 3, scale: float = 1.0, units: str = "") -> DataFrame:
    return _images(pixels, lambda a: encode_dm(a, version, scale, units))


def to_mat(pixels: DataFrame, name: str = "obs") -> DataFrame:
    return _images(pixels, lambda a: encode_mat({name: a}))


def to_npy(pixels: DataFrame) -> DataFrame:
    def encode(a: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.save(out, a)
        return out.getvalue()

    return _images(pixels, encode)
