"""Watershed of markers as a minimum spanning forest, by rounds of Boruvka.

Neighbouring pixels are joined by an edge at the level at which water passes between them. In each
round every component that no marker has reached takes its lowest edge; chains of such choices are
shortened by pointer jumping, components become one, and the edges that are left lie between fewer
components. A flood of any length ends after about as many rounds as its pixels can be halved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import cut

KEYS = ["image_id", "y", "x"]


def _number():
    """A pixel's number within its image."""
    return F.col("y").cast("long") * F.lit(1 << 31) + F.col("x").cast("long")


def _edges(nodes: DataFrame) -> DataFrame:
    """(image_id, a, am, b, bm, w): neighbours of four, their components, whether these are marked, and the edge's place in the order."""
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (0, 1))))).alias("s")
    first = nodes.select("image_id", "y", "x", "v", F.col("c").alias("a"), F.col("m").alias("am"), steps)
    first = first.withColumns({"ny": F.col("y") + F.col("s.j"), "nx": F.col("x") + F.col("s.i")})
    second = nodes.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("v").alias("u"), F.col("c").alias("b"), F.col("m").alias("bm"))
    w = F.struct(F.greatest("v", "u").alias("level"), F.least("v", "u").alias("low"), "y", "x", F.col("s.i").alias("i"))
    return first.join(second, ["image_id", "ny", "nx"]).select("image_id", "a", "am", "b", "bm", w.alias("w"))


def _between(edges: DataFrame) -> DataFrame:
    """The lowest edge between each two components, if a marker hasn't reached both."""
    apart = edges.filter((F.col("a") != F.col("b")) & ~(F.col("am") & F.col("bm")))
    turned = F.col("a") > F.col("b")
    swap = lambda p, q: F.when(turned, F.col(q)).otherwise(F.col(p)).alias(p)
    ordered = apart.select("image_id", swap("a", "b"), swap("am", "bm"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), F.when(turned, F.col("am")).otherwise(F.col("bm")).alias("bm"), "w")
    return ordered.groupBy("image_id", "a", "am", "b", "bm").agg(F.min("w").alias("w"))


def _chosen(edges: DataFrame) -> DataFrame:
    """(image_id, c, p, pm): where the lowest edge of each unmarked component leads to, and whether that is marked; of two
    components that choose each other the lesser is its own."""
    sides = F.array(
        F.struct(F.col("a").alias("c"), F.col("am").alias("m"), F.col("b").alias("p"), F.col("bm").alias("pm")),
        F.struct(F.col("b").alias("c"), F.col("bm").alias("m"), F.col("a").alias("p"), F.col("am").alias("pm")),
    )
    each = edges.select("image_id", "w", F.explode(sides).alias("s")).filter("NOT s.m")
    lowest = F.min(F.struct("w", F.col("s.p").alias("p"), F.col("s.pm").alias("pm"))).alias("e")
    best = cut(each.groupBy("image_id", F.col("s.c").alias("c")).agg(lowest).select("image_id", "c", "e.p", "e.pm"))
    back = best.select("image_id", F.col("c").alias("p"), F.col("p").alias("back"), F.lit(False).alias("pm"))
    root = (F.col("back") == F.col("c")) & (F.col("c") < F.col("p"))
    return best.join(back, ["image_id", "p", "pm"], "left").select("image_id", "c", F.when(root, F.col("c")).otherwise(F.col("p")).alias("p"), "pm")


def _jumped(map_: DataFrame, further: DataFrame) -> DataFrame:
    """``map_`` where each unmarked target that ``further`` leads on from is that one's target."""
    on = further.select("image_id", F.col("c").alias("p"), F.col("p").alias("q"), F.col("pm").alias("qm"), F.lit(False).alias("pm"))
    out = map_.join(on, ["image_id", "p", "pm"], "left")
    return out.select("image_id", "c", F.coalesce("q", "p").alias("p"), F.coalesce("qm", "pm").alias("pm"))


def _rooted(map_: DataFrame) -> DataFrame:
    """``map_`` with every chain followed to its end, four times as far each round."""
    map_ = cut(map_)
    while True:
        twice = _jumped(map_, map_)
        new = cut(_jumped(twice, twice).withColumnsRenamed({"p": "q", "pm": "qm"}).join(map_, ["image_id", "c"]))
        settled = new.filter((F.col("p") != F.col("q")) | (F.col("pm") != F.col("qm"))).isEmpty()
        map_ = new.select("image_id", "c", F.col("q").alias("p"), F.col("qm").alias("pm"))
        if settled:
            return map_


def watershed(pixels: DataFrame, markers: DataFrame) -> DataFrame:
    """Adds ``label``: markers (image_id, y, x, label) flood the pixels between them, from low values to high ones.

    A pixel takes the label to which the spanning forest of least edges, rooted in the marked pixels, joins it. Edges
    are ordered by the level at which water passes (the greater value), then the lesser value, then the place of the
    upper left pixel, a step down before one to the right. Of several labels of a pixel the greatest counts; null where
    no flood comes and for pixels without a value.
    """
    spot = markers.groupBy(*KEYS).agg(F.max("label").alias("label")).filter("label IS NOT NULL")
    nodes = pixels.select(*KEYS, "v").filter("v IS NOT NULL").join(spot, KEYS, "left").withColumn("n", _number())
    nodes = cut(nodes)
    # all pixels of a marker are one component from the start
    marked = cut(nodes.filter("label IS NOT NULL").groupBy("image_id", "label").agg(F.min("n").alias("c")))
    nodes = nodes.join(marked, ["image_id", "label"], "left").select(*KEYS, "v", "n", F.col("c").isNotNull().alias("m"), F.coalesce("c", "n").alias("c"))
    nodes = cut(nodes)
    edges, maps = cut(_between(_edges(nodes))), []
    while not edges.isEmpty():
        map_ = _rooted(_chosen(edges))
        maps.append(map_)
        for c in ("a", "b"):
            to = map_.select("image_id", F.col("c").alias(c), F.lit(False).alias(f"{c}m"), "p", "pm")
            edges = edges.join(to, ["image_id", c, f"{c}m"], "left").withColumns({c: F.coalesce("p", c), f"{c}m": F.coalesce("pm", f"{c}m")}).drop("p", "pm")
        edges = cut(_between(edges))
    found = nodes.select(*KEYS, "c", F.col("m"))
    if maps:
        whole = maps.pop()
        while maps:
            whole = _jumped(maps.pop(), whole)
        to = whole.select("image_id", "c", F.lit(False).alias("m"), "p", "pm")
        found = found.join(to, ["image_id", "c", "m"], "left").select(*KEYS, F.coalesce("p", "c").alias("c"), F.coalesce("pm", "m").alias("m"))
    labels = found.filter("m").join(marked, ["image_id", "c"]).select(*KEYS, "label")
    return pixels.join(labels, KEYS, "left")
