"""Text and raster sources, schema resolution, and the choice of a reader by extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary


def parse_matrix(lines: DataFrame, delimiter: str | None = None) -> DataFrame:
    """(row, col, value) of lines (row, line); no delimiter: any white space. Blank and comment lines give nothing."""
    clean = F.trim(F.regexp_replace("line", "#.*$", ""))
    cells = F.split(clean, r"\s+" if delimiter is None else "\\Q" + delimiter + "\\E")
    full = lines.filter(clean != "").select("row", F.posexplode(cells).alias("col", "cell"))
    return full.select("row", "col", F.trim("cell").cast("double").alias("value"))


def read_matrix(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Text matrices, a row for each cell; rows are numbered within the file, which is read whole to keep its order."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("row", "line"))
    return parse_matrix(files, delimiter)


def channel_mean(channels: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, v) from samples (image_id, y, x, ch, v): the plain mean, alpha too."""
    return channels.groupBy("image_id", "y", "x").agg(F.avg("v").alias("v"))


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """Raster images through Spark's image source, as pixels of the mean over channels."""
    raw = spark.read.format("image").load(path).select(F.col("image.origin").alias("image_id"), "image.width", "image.nChannels", F.hex("image.data").alias("h"))
    n = F.length("h") / 2
    each = raw.select("image_id", "width", "nChannels", "h", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("i"))
    value = F.conv(F.substring("h", 2 * F.col("i") + 1, F.lit(2)), 16, 10).cast("double")
    at = F.floor(F.col("i") / F.col("nChannels"))
    return channel_mean(each.select("image_id", F.floor(at / F.col("width")).cast("int").alias("y"), (at % F.col("width")).cast("int").alias("x"), value.alias("v")))


def parse_cif(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, atoms) of CIF lines (lattice_id, row, line): cell constants, and the sites of the atom loop.

    A site row has the columns in the order of the loop's names; values with a standard error in brackets lose it.
    """
    number = lambda c: F.regexp_replace(c, r"\(.*\)", "").cast("double")
    clean = lines.select("lattice_id", "row", F.trim("line").alias("line"))
    names = {"length_a": "a", "length_b": "b", "length_c": "c", "angle_alpha": "alpha", "angle_beta": "beta", "angle_gamma": "gamma"}
    part = F.split("line", r"\s+")
    cells = clean.filter(F.col("line").startswith("_cell_")).groupBy("lattice_id").agg(
        *(F.max(F.when(F.get(part, F.lit(0)) == f"_cell_{k}", number(F.get(part, F.lit(1))))).alias(v) for k, v in names.items())
    )
    header = clean.filter(F.col("line").startswith("_atom_site_") & ~F.col("line").startswith("_atom_site_aniso"))
    order = header.groupBy("lattice_id").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("h"), F.max("row").alias("last"))
    body = clean.join(F.broadcast(order), "lattice_id").filter(F.col("row") > F.col("last"))
    stop = body.filter((F.col("line") == "") | F.col("line").rlike("^(loop_|_|#|data_)")).groupBy("lattice_id").agg(F.min("row").alias("stop"))
    body = body.join(F.broadcast(stop), "lattice_id", "left").filter(F.col("stop").isNull() | (F.col("row") < F.col("stop")))
    at = lambda name: F.get(part, (F.array_position(F.transform("h", lambda x: x["line"]), f"_atom_site_{name}") - 1).cast("int"))
    atoms = body.select(
        "lattice_id", (F.col("row") - F.col("last") - 1).alias("idx"), F.regexp_extract(F.coalesce(at("type_symbol"), at("label")), "^[A-Z][a-z]?", 0).alias("symbol"),
        *(number(at(f"fract_{c}")).alias(f"f{c}") for c in "xyz"), F.coalesce(number(at("occupancy")), F.lit(1.0)).alias("occupancy"),
    )
    return cells, atoms


def read_cif(spark: SparkSession, path: str, elements: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("lattice_id"), F.posexplode(F.split("value", "\r?\n")).alias("row", "line"))
    cells, atoms = parse_cif(lines)
    return cells, atoms.filter(F.col("symbol").isin(elements)) if elements else atoms


def register_peaks(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Peaks of any table with two coordinate columns; ids follow the coordinates' hash if there is none."""
    cols = {c.lower(): c for c in df.columns}
    pid = F.col(cols["peak_id"]) if "peak_id" in cols else F.xxhash64(x, y)
    kind = F.col(cols["atom_type"]) if "atom_type" in cols else F.lit(0)
    return df.select(pid.cast("long").alias("peak_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), kind.cast("int").alias("atom_type"))


#: Names under which files of several vintages keep the same thing; the first that is there counts.
COORDINATES = (("coordinates",), ("Coordinates",), ("BetaX", "BetaY"))
VOLUMES = (("volumes",), ("Volumes",))


def resolve(keys: set[str], choices: tuple[tuple[str, ...], ...], prefix: str = "") -> tuple[str, ...]:
    for names in choices:
        if all(prefix + n in keys for n in names):
            return tuple(prefix + n for n in names)
    raise ValueError(f"none of {choices} is there")


def load_benchmark(arrays: DataFrame) -> dict[str, DataFrame]:
    """Image, coordinates and cross-sections of benchmark files read as arrays, each row with its file's path.

    The files are of one vintage: flat, or with input and output parts.
    """
    keys = {r["key"] for r in arrays.select("key").distinct().collect()}  # names of variables, a handful
    i, o = ("input.", "output.") if any(k.startswith("input.") for k in keys) else ("", "")
    columns = resolve(keys, COORDINATES, o)
    flat = lambda k, v: arrays.filter(F.col("key") == k).select("path", "shape", F.posexplode("values").alias("peak_id", v))
    if len(columns) == 2:
        x, y = (flat(k, n).drop("shape") for k, n in zip(columns, "xy", strict=True))
        peaks = x.join(y, ["path", "peak_id"])
    else:
        w, at = F.element_at("shape", 2), F.col("peak_id")
        value = lambda n: F.max(F.when(at % w == n, F.col("v")))
        peaks = flat(columns[0], "v").groupBy("path", F.floor(at / w).cast("int").alias("peak_id")).agg(value(0).alias("x"), value(1).alias("y"))
    scs = flat(resolve(keys, VOLUMES, o)[0], "scs").drop("shape")
    return {"pixels": binary.to_pixels(arrays.filter(F.col("key") == i + "obs")), "peaks": peaks, "scs": scs}


def export_params(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


READERS = {
    "mat": binary.read_mat, "npy": binary.read_npy, "dm3": binary.read_dm, "dm4": binary.read_dm,
    "csv": lambda s, p: read_matrix(s, p, ","), "txt": read_matrix,
    "png": read_image, "jpg": read_image, "jpeg": read_image, "bmp": read_image, "gif": read_image,
}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Reader by extension; ValueError for one that isn't known."""
    extension = path.rpartition(".")[2].lower()
    if extension not in READERS:
        raise ValueError(f"no reader for .{extension}")
    return READERS[extension](spark, path)
