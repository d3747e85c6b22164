"""Atom counts of columns: by a library of simulated values, as a model in three dimensions, and over time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from ..plans.loops import cut

#: Most thicknesses of a library: its rows are ordered in one task.
THICKEST = 100_000
#: Rows of a series that are solved together at most.
PIECE = 512


def match_library(values: DataFrame, library: DataFrame, value: str = "v") -> DataFrame:
    """Adds ``count``, the thickness whose simulated value is nearest (of equals the lesser value's), and ``thickness``,
    interpolated between the simulated values on both sides.

    ``library`` (thickness, scs) has a row for each thickness; of equal values the least thickness counts. Beyond its ends
    the end's thickness holds; null without a value or a library. The library's intervals are dealt over equal parts
    of its range, so that a value meets the few of its own part.
    """
    steps = library.filter("scs IS NOT NULL").groupBy("scs").agg(F.min("thickness").cast("double").alias("t"))
    found = steps.agg(F.min("scs"), F.max("scs"), F.count("*")).first()
    low, high, n = found[0], found[1], found[2]
    if n > THICKEST:
        raise ValueError(f"a library of {n} values; {THICKEST} at most")
    if not n:
        return values.withColumns({"count": F.lit(None).cast("double"), "thickness": F.lit(None).cast("double")})
    width = (high - low) / n or 1.0
    part = lambda c: F.least(F.greatest(F.floor((c - low) / width), F.lit(0)), F.lit(n - 1)).cast("int")
    order = Window.orderBy("scs")
    ends = steps.select(F.col("scs").alias("__from"), F.col("t").alias("__t"), F.lead("scs").over(order).alias("__to"), F.lead("t").over(order).alias("__u"), F.row_number().over(order).alias("__n"))
    # the first interval holds what is below it as well
    ends = ends.withColumn("__part", F.explode(F.sequence(F.when(F.col("__n") == 1, 0).otherwise(part(F.col("__from"))), F.coalesce(part(F.col("__to")), F.lit(n - 1)))))
    v = F.col(value).cast("double")
    inside = ((v >= F.col("__from")) | (F.col("__n") == 1)) & (F.col("__to").isNull() | (v < F.col("__to")))
    met = values.withColumn("__own", part(v)).join(ends, (F.col("__own") == F.col("__part")) & inside, "left")
    share = F.greatest((v - F.col("__from")) / (F.col("__to") - F.col("__from")), F.lit(0.0))
    nearer = F.when((v - F.col("__from")) <= (F.col("__to") - v), F.col("__t")).otherwise(F.col("__u"))
    out = met.withColumns({"count": F.when(F.col("__to").isNull(), F.col("__t")).otherwise(nearer), "thickness": F.when(F.col("__to").isNull(), F.col("__t")).otherwise(F.col("__t") + share * (F.col("__u") - F.col("__t")))})
    return out.drop("__own", "__from", "__to", "__t", "__u", "__n", "__part")


def stacked(columns: DataFrame, spacing: float, offset: Column | None = None) -> DataFrame:
    """(image_id, peak_id, k, x, y, z, ...): ``count`` atoms for each column, ``spacing`` apart and symmetric about 0
    (or ``offset``, a column's height within the unit cell); columns without atoms give none."""
    each = columns.filter("count >= 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1)))
    return each.withColumn("z", (F.col("k") - (F.col("count") - 1) / 2) * F.lit(float(spacing)) + (F.lit(0.0) if offset is None else offset))


def coordination(atoms: DataFrame, radius: float, keys: tuple[str, ...] = ("image_id",), id_: tuple[str, ...] = ("peak_id", "k")) -> DataFrame:
    """``atoms`` (x, y, z) with ``neighbours``: how many others lie at most ``radius`` away.

    An equi-join on cubes whose edge is the radius: one side goes to the 27 cubes round its own.
    """
    cube = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(l).alias("l")) for i in (-1, 0, 1) for j in (-1, 0, 1) for l in (-1, 0, 1)))).alias("o")  # noqa: E741
    own = atoms.select(*keys, *id_, "x", "y", "z", cube("x").alias("cx"), cube("y").alias("cy"), cube("z").alias("cz"))
    other = atoms.select(*keys, *(F.col(c).alias(c + "_r") for c in (*id_, "x", "y", "z")), cube("x").alias("ox"), cube("y").alias("oy"), cube("z").alias("oz"), around)
    other = other.withColumns({"cx": F.col("ox") + F.col("o.i"), "cy": F.col("oy") + F.col("o.j"), "cz": F.col("oz") + F.col("o.l")}).drop("ox", "oy", "oz", "o")
    d2 = sum((F.col(c) - F.col(c + "_r")) * (F.col(c) - F.col(c + "_r")) for c in "xyz")
    same = F.lit(True)
    for c in id_:
        same = same & (F.col(c) == F.col(c + "_r"))
    near = own.join(other, [*keys, "cx", "cy", "cz"]).filter((d2 <= radius * radius) & ~same)
    counts = near.groupBy(*keys, *id_).agg(F.count("*").alias("neighbours"))
    return atoms.join(counts, [*keys, *id_], "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)).cast("long"))


def _step(states: int, change: float) -> np.ndarray:
    """Log probabilities of going from one count to another: to stay, or up or down by one with ``change`` together."""
    p = np.zeros((states, states))
    for i in range(states):
        near = [j for j in (i - 1, i + 1) if 0 <= j < states]
        p[i, near] = change / max(1, len(near))
        p[i, i] = 1 - change if near else 1.0
    with np.errstate(divide="ignore"):
        return np.log(p)


def _emission(v: np.ndarray, means: np.ndarray, spread: float) -> np.ndarray:
    """Log densities of each value in each state; a missing value says nothing."""
    return np.nan_to_num(-((v[:, None] - means) ** 2) / (2 * spread**2), nan=0.0)


def _whole(batches: Iterator[pa.RecordBatch], begins: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of the batches as tables of whole groups, with the groups' first rows: those where ``begins`` is true."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        at = np.flatnonzero(b.column(begins).to_numpy(zero_copy_only=False))
        if len(at) and held:
            held, b = [*held, b.slice(0, at[-1])], b.slice(at[-1])
            yield _grouped(held, begins)
            held = []
        elif len(at) > 1:
            yield _grouped([b.slice(0, at[-1])], begins)
            b = b.slice(at[-1])
        if b.num_rows:
            held.append(b)
    if held:
        yield _grouped(held, begins)


def _grouped(batches: list[pa.RecordBatch], begins: str) -> tuple[pa.Table, np.ndarray]:
    whole = pa.Table.from_batches(batches).combine_chunks()
    return whole, np.flatnonzero(whole.column(begins).to_numpy())


def _abreast(first: np.ndarray, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The groups, longest first, and for each place within a group the rows there of those that are long enough."""
    length = np.diff(first, append=rows)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    return order, [first[: np.searchsorted(-length, -t)] + t for t in range(length[0])]


def viterbi(series: DataFrame, means: list[float], spread: float, change: float, width: float, key: str = "user_id", at: str = "t", id_: str = "id", value: str = "v") -> DataFrame:
    """``series`` with ``state``, the most probable sequence of counts of each key in the order of ``at``, then ``id_``.

    A hidden Markov model: normal values about ``means`` (one for each count), counts that change by one with the
    probability ``change``. A series is dealt into chunks of ``width`` in ``at``, and these into pieces of ``PIECE`` rows. Each
    piece gives the best score from every state before its first value to every state at its last; these matrices, combined in
    order, tell the states at the pieces' ends; then every piece is solved by itself between them. So no series is in one
    task, and the many short pieces (or series) of a batch of rows go abreast, value by value.
    """
    states, logs, centre = len(means), _step(len(means), change), np.array(means, float)
    stay, up, down = (np.diag(logs, k) for k in (0, 1, -1))
    columns, schema, piece = series.columns, series.withColumn("state", F.lit(0)).schema, [key, "__chunk", "__piece"]
    ordered = lambda *names: [F.col(c).asc_nulls_last() for c in names]
    nth = F.row_number().over(Window.partitionBy(key, "__chunk").orderBy(*ordered(at, id_)))
    chunked = series.withColumn("__chunk", F.floor(F.col(at) / F.lit(float(width))).cast("long")).withColumn("__nth", nth)
    # stored, so that both passes see the same order
    chunked = cut(chunked.withColumn("__piece", F.floor((F.col("__nth") - 1) / PIECE).cast("long")))
    chunked = chunked.withColumns({"__value": F.col(value).cast("double"), "__begins": (F.col("__nth") - 1) % PIECE == 0})
    start = np.where(np.eye(states) > 0, 0.0, -np.inf)

    def moved(best: np.ndarray) -> np.ndarray:
        """Best scores (last axis: counts) before the next value's density; a count comes from itself or one beside it."""
        out = best + stay
        np.maximum(out[..., 1:], best[..., :-1] + up, out=out[..., 1:])
        np.maximum(out[..., :-1], best[..., 1:] + down, out=out[..., :-1])
        return out

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in _whole(batches, "__begins"):
            e = _emission(t.column("__value").to_numpy(), centre, spread)
            order, places = _abreast(first, len(e))
            best = np.repeat(start[None], len(first), axis=0)
            for rows in places:
                n = len(rows)
                best[:n] = moved(best[:n]) + e[rows][:, None]
            m = np.empty_like(best)
            m[order] = best
            m = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * states**2, m.ravel())
            yield from t.select(piece).take(first).append_column("m", m).to_batches()

    held = chunked.select(*piece, "__nth", "__begins", "__value").repartition(*piece).sortWithinPartitions(*ordered(*piece, "__nth"))
    spans = held.mapInArrow(span, held.select(*piece).schema.add("m", ArrayType(DoubleType())))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in _whole(batches, "__begins"):
            m = t.column("m").combine_chunks().flatten().to_numpy().reshape(-1, states, states)
            _, places = _abreast(first, len(m))
            scores, back = np.zeros((len(first), states)), np.empty((len(m), states), np.int32)
            for rows in places:
                n = len(rows)
                each = scores[:n, :, None] + m[rows]
                back[rows], scores[:n] = each.argmax(axis=1), each.max(axis=1)
            state, last, before = scores.argmax(axis=1).astype(np.int32), np.empty(len(m), np.int32), np.empty(len(m), np.int32)
            for rows in reversed(places):
                n = len(rows)
                last[rows] = state[:n]
                before[rows] = state[:n] = back[rows, state[:n]]
            yield from t.select(piece).append_column("__before", pa.array(before)).append_column("__last", pa.array(last)).to_batches()

    # one matrix for each piece of a series
    follow = Window.partitionBy(key).orderBy(*ordered("__chunk", "__piece"))
    lined = spans.withColumn("__begins", F.row_number().over(follow) == 1).sortWithinPartitions(*ordered(key, "__chunk", "__piece"))
    joints = cut(lined.mapInArrow(ends, lined.select(*piece).schema.add("__before", IntegerType()).add("__last", IntegerType())))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in _whole(batches, "__begins"):
            e = _emission(t.column("__value").to_numpy(), centre, spread)
            order, places = _abreast(first, len(e))
            before, state = (t.column(c).take(first[order]).to_numpy().astype(np.int32) for c in ("__before", "__last"))
            scores, path = np.empty_like(e), np.zeros(len(e), np.int32)
            scores[places[0]] = start[before]
            for rows in places[1:]:
                scores[rows] = moved(scores[rows - 1]) + e[rows]
            for k in range(len(places) - 1, 0, -1):
                rows = places[k]
                n = len(rows)
                path[rows] = state[:n]
                if k > 1:
                    state[:n] = (scores[rows - 1] + logs.T[state[:n]]).argmax(axis=1)
            values = ~t.column("__begins").to_numpy()
            out = [pa.array(path) if c == "state" else t.column(c) for c in schema.names]
            yield from pa.table(out, names=schema.names).filter(pa.array(values)).to_batches()

    # the row of its ends goes before a piece's own
    heads = joints.withColumns({"__begins": F.lit(True), "__nth": F.lit(0)})
    whole = chunked.withColumn("__begins", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    return whole.repartition(*piece).sortWithinPartitions(*ordered(*piece, "__nth")).mapInArrow(inside, schema)
