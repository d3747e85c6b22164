"""Queries of the sources that can be shown on the tables: their parsers on lines and samples made from columns.

Binary formats are written from the image tables and read back; tests read files made by hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.filters import filter_bounds
from ..sources import binary, text
from .base import NX, NY, peaks, pixels, register, rounded, sql, table
from .loops import shared_dir


@register("scan_text_matrix", "SELECT p_partkey AS row, 0 AS col, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 1, p_retailprice FROM part")
def scan_text_matrix(spark, d):
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("row"), F.format_string("  %d \t%.2f # note", "p_size", "p_retailprice").alias("line"))
    return text.parse_matrix(lines)


@register("scan_image", sql("SELECT image_id, y, x, round((v + 2 * v + 255) / 3, 6) AS v FROM pixels", "pixels"))
def scan_image(spark, d):
    channels = pixels(spark, d).select("image_id", "y", "x", F.posexplode(F.array(F.col("v"), 2 * F.col("v"), F.lit(255.0))).alias("ch", "v"))
    return rounded(text.channel_mean(channels))


_CIF = """data_SrTiO3
_cell_length_a   3.905
_cell_length_b   3.905(2)
_cell_length_c   3.905
_cell_angle_alpha   90.0
_cell_angle_beta   90.0
_cell_angle_gamma   90.0
loop_
 _atom_site_type_symbol
 _atom_site_label
 _atom_site_fract_x
 _atom_site_fract_y
 _atom_site_fract_z
 _atom_site_occupancy
  Sr  Sr0  0.0  0.0  0.0  1
  Ti  Ti1  0.5  0.5  0.5  1
  O  O2  0.5  0.0  0.5  1
  O  O3  0.5  0.5  0.0  1
  O  O4  0.0  0.5  0.5  1
"""


@register("scan_cif", "SELECT s_suppkey AS lattice_id, idx, symbol, CAST(fx AS DOUBLE) AS fx, CAST(fy AS DOUBLE) AS fy, CAST(fz AS DOUBLE) AS fz, 3.905::DOUBLE AS a FROM supplier, (VALUES (1, 'Ti', 0.5, 0.5, 0.5), (2, 'O', 0.5, 0.0, 0.5), (3, 'O', 0.5, 0.5, 0.0), (4, 'O', 0.0, 0.5, 0.5)) v(idx, symbol, fx, fy, fz)")
def scan_cif(spark, d):
    """One file for each supplier, read at once."""
    lines = table(spark, d, "supplier").select(F.col("s_suppkey").alias("lattice_id"), F.posexplode(F.split(F.lit(_CIF), "\n")).alias("row", "line"))
    cells, atoms = text.parse_cif(lines)
    return atoms.filter(F.col("symbol").isin("Ti", "O")).join(cells, "lattice_id").select("lattice_id", "idx", "symbol", "fx", "fy", "fz", "a")


@register("register_coordinates", "SELECT l_orderkey * 10 + l_linenumber AS peak_id, CAST(l_partkey % 64 AS DOUBLE) AS x, CAST(l_suppkey % 48 AS DOUBLE) AS y, 0 AS atom_type FROM lineitem")
def register_coordinates(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("peak_id"), (F.col("l_partkey") % NX).alias("bx"), (F.col("l_suppkey") % NY).alias("by"))
    return filter_bounds(text.register_peaks(rows, "bx", "by"), NX, NY)


def _arrays(spark, d):
    """Arrays (path, key, shape, values) with names of an old vintage: files of the columns of a hundred customers of a nation at most."""
    c = table(spark, d, "customer").groupBy(F.concat_ws("/", "c_nationkey", F.floor(F.col("c_custkey") / 100)).alias("path"))
    files = c.agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_acctbal"))).alias("a")).withColumn("shape", F.array(F.size("a"), F.lit(1)))
    column = lambda k, f: F.struct(F.lit(k).alias("key"), F.transform("a", f).alias("values"))
    parts = F.array(
        column("input.obs", lambda x: x["c_acctbal"]), column("output.BetaX", lambda x: x["c_acctbal"]),
        column("output.BetaY", lambda x: x["c_custkey"].cast("double")), column("output.Volumes", lambda x: x["c_acctbal"] * 2),
    )
    return files.select("path", "shape", F.explode(parts).alias("p")).select("path", "p.key", "shape", "p.values")


_ROW = "c_nationkey || '/' || (c_custkey // 100) AS path, CAST(row_number() OVER (PARTITION BY c_nationkey, c_custkey // 100 ORDER BY c_custkey) - 1 AS INTEGER) AS peak_id"


@register("resolve_schema", f"SELECT {_ROW}, c_acctbal AS x, CAST(c_custkey AS DOUBLE) AS y FROM customer")
def resolve_schema(spark, d):
    return text.load_benchmark(_arrays(spark, d))["peaks"]


@register("load_benchmark", f"SELECT {_ROW}, round(c_acctbal * 2, 6) AS scs FROM customer")
def load_benchmark(spark, d):
    return rounded(text.load_benchmark(_arrays(spark, d))["scs"])


def _read_back(spark, d, files, decode, key=None):
    """Pixels of one file for each image, where the tables have some."""
    rows = binary._rows(files.select(F.col("image_id").cast("string").alias("path"), "content"), decode)
    back = binary.to_pixels(rows if key is None else rows.filter(F.col("key") == key))
    there = pixels(spark, d).select("image_id", "y", "x")
    return back.select(F.col("path").cast("int").alias("image_id"), "y", "x", "v").join(there, ["image_id", "y", "x"])


@register("scan_dm", sql("SELECT image_id, y, x, v FROM pixels", "pixels"))
def scan_dm(spark, d):
    """DM3 files; ``sink_dm`` has DM4."""
    return _read_back(spark, d, binary.to_dm(pixels(spark, d), 3), lambda raw: binary._Dm(raw).images())


@register("scan_mat", sql("SELECT image_id, y, x, v FROM pixels", "pixels"))
def scan_mat(spark, d):
    return _read_back(spark, d, binary.to_mat(pixels(spark, d)), lambda raw: binary.decode_mat(raw).items(), "obs")


_TAG = "ImageList/0/ImageData/"


@register(
    "dm_codecs",
    sql(
        f"""SELECT image_id, key, text FROM (SELECT image_id, max(x) + 1 AS nx, max(y) + 1 AS ny FROM pixels GROUP BY image_id) z,
          LATERAL (VALUES ('{_TAG}Dimensions/0', CAST(nx AS VARCHAR)), ('{_TAG}Dimensions/1', CAST(ny AS VARCHAR)), ('{_TAG}DataType', '2'), ('{_TAG}PixelDepth', '4'), ('{_TAG}Calibrations/Dimension/1/Scale', '0.25'),
            ('{_TAG}Calibrations/Dimension/0/Units', 'nm'), ('{_TAG}Calibrations/Dimension/0/Origin', '0.0'), ('{_TAG}Data', 'array of ' || (nx * ny) || ' f4')) t(key, text)""",
        "pixels",
    ),
)
def dm_codecs(spark, d):
    """Tags of numbers, strings and arrays, by their paths."""
    keys = [_TAG + k for k in ("Dimensions/0", "Dimensions/1", "DataType", "PixelDepth", "Calibrations/Dimension/1/Scale", "Calibrations/Dimension/0/Units", "Calibrations/Dimension/0/Origin", "Data")]
    files = binary.to_dm(pixels(spark, d), 4, 0.25, "nm").select(F.col("image_id").cast("string").alias("path"), "content")
    tags = binary.dm_tags(files)
    return tags.filter(F.col("key").isin(keys)).select(F.col("path").cast("int").alias("image_id"), "key", "text")


_LINE = "(SELECT row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) - 1 AS row, p_size, p_partkey FROM part) t"


@register("scan_dispatch", f"SELECT row, 0 AS col, CAST(p_size AS DOUBLE) AS value FROM {_LINE} UNION ALL SELECT row, 1, CAST(p_partkey AS DOUBLE) FROM {_LINE}")
def scan_dispatch(spark, d):
    """A .csv folder of files of five hundred parts at most, written by Spark and read by the reader that its name asks for."""
    path = f"{shared_dir(spark)}/dispatch-{uuid.uuid4().hex}.csv"
    files = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 500).alias("file")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))).alias("rows"))
    lines = F.array_join(F.transform("rows", lambda x: F.format_string("%d, %d", x["p_size"], x["p_partkey"])), "\n")
    files.select("file", lines.alias("value")).write.partitionBy("file").text(path)
    return text.read_any(spark, path).select(F.col("row").cast("long").alias("row"), "col", "value")


@register("export_params", sql("SELECT image_id, peak_id, x, y FROM peaks", "peaks"))
def export_params(spark, d):
    path = f"{shared_dir(spark)}/params-{uuid.uuid4().hex}"
    text.export_params(peaks(spark, d).select("image_id", "peak_id", "x", "y"), path)
    return spark.read.parquet(path)


@register("sink_dm", sql("SELECT image_id, y, x, v FROM pixels", "pixels"))
def sink_dm(spark, d):
    """Written as DM files, one for each image, and read back."""
    return _read_back(spark, d, binary.to_dm(pixels(spark, d), 4), lambda raw: binary._Dm(raw).images())


@register("npy_import_export", sql("SELECT image_id, y, x, v FROM pixels", "pixels"))
def npy_import_export(spark, d):
    import io

    import numpy as np

    return _read_back(spark, d, binary.to_npy(pixels(spark, d)), lambda raw: [("array", np.load(io.BytesIO(raw)))])
