"""Points in polygons, by tiles of longitude and latitude."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Degrees a tile is wide and high: a power of two, so that its borders are exact.
TILE = 1.0


def wrapped(x: Column) -> Column:
    """Longitudes from -180 up to, but not, 180."""
    return x - 360.0 * F.floor((x + 180) / 360)


def cut_at_date_line(edges: DataFrame) -> DataFrame:
    """Edges (x1, y1, x2, y2) of closed rings, in any frame of longitudes, as edges between -180 and 180, cut where they cross the date line.

    An edge of more than 180 and less than 360 degrees goes the short way round, as from 170 to -170; one of 360 goes round the
    earth. A cut ring is closed by edges along the date line, from each crossing down to the south pole, which cancel by pairs. A
    ring that crosses it an odd number of times holds the south pole. Edges with a null are left out.
    """
    far = F.col("x2") - F.col("x1")
    turn = F.when((far > 180) & (far < 360), -1).when((far < -180) & (far > -360), 1).otherwise(0)
    round_ = F.floor((F.col("x2") + 180) / 360) - F.floor((F.col("x1") + 180) / 360) + turn
    rows = edges.select("x1", "y1", "x2", "y2").dropna().select(wrapped(F.col("x1")).alias("a"), "y1", wrapped(F.col("x2")).alias("b"), "y2", round_.alias("k"), (far + 360.0 * turn).alias("far"))
    at = F.col("y1") + (F.col("y2") - F.col("y1")) * (180.0 * F.col("k") - F.col("a")) / F.col("far")
    at = F.when(F.col("k") != 0, F.greatest(F.least("y1", "y2"), F.least(F.greatest("y1", "y2"), at)))
    rows, side = rows.withColumn("at", at), 180.0 * F.col("k")
    edge = lambda *c: F.struct(*[e.cast("double").alias(n) for e, n in zip(c, ("x1", "y1", "x2", "y2"))])
    a, y1, b, y2 = (F.col(c) for c in ("a", "y1", "b", "y2"))
    # Nothing lies to the west of -180, so that side needs no closing edge.
    pieces = F.when(F.col("k") == 0, F.array(edge(a, y1, b, y2))).otherwise(F.array(edge(a, y1, side, F.col("at")), edge(-side, F.col("at"), b, y2), edge(F.lit(180.0), F.col("at"), F.lit(180.0), F.lit(-90.0))))
    return rows.select(F.explode(pieces).alias("e")).select("e.*")


def crosses(y: Column) -> Column:
    return (F.col("y1") > y) != (F.col("y2") > y)


def along(y: Column) -> Column:
    """Longitude of an edge at a latitude; never beyond its ends, whatever the rounding."""
    at = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return F.greatest(F.least("x1", "x2"), F.least(F.greatest("x1", "x2"), at))


def to_the_east(x: Column, y: Column) -> Column:
    """Whether an edge lies to the east of a point."""
    return F.when(crosses(y), x < along(y)).otherwise(F.lit(False))


def inside(points: DataFrame, edges: DataFrame, on: str = "point_id", tile: float = TILE) -> DataFrame:
    """Ids of the points (x, y) inside polygons: an odd number of their edges lies to the east. Holes and islands are rings of their own.

    `edges` (x1, y1, x2, y2) form closed rings, see `cut_at_date_line`; polygons do not overlap. Points and edges meet by tile
    alone, a long edge stands in the tiles that it runs through. What lies to the east of a tile's lower right corner is added up
    along a row of tiles, from the tiles' counts; edges of the tile settle the way from there up its border and west to the
    point. The result is that of counting all edges, also for points and corners on an edge. A point without coordinates is in none.
    """
    if math.frexp(tile)[0] != 0.5:
        raise ValueError("a tile must be a power of two wide")
    at = points.select(on, wrapped(F.col("x")).cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y"])
    at = at.withColumn("row", F.floor(F.col("y") / tile)).withColumn("col", F.floor(F.col("x") / tile))
    cut = cut_at_date_line(edges)
    south, north = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = cut.withColumn("row", F.explode(F.sequence(F.floor(south / tile), F.floor(north / tile))))
    base = F.col("row") * tile
    ends = [F.when(F.col("y1") != F.col("y2"), along(F.least(F.greatest(y, south), north))).otherwise(F.col(x)) for y, x in ((base, "x1"), (base + tile, "x2"))]
    columns = F.sequence(F.floor((F.least(*ends) - 1e-9) / tile), F.floor((F.greatest(*ends) + 1e-9) / tile))
    dealt = rows.withColumn("col", F.explode(columns))
    # The tiles whose lower right corner has the edge to the east: up to column `col`. A row has 360 / tile of them.
    counts = rows.filter(crosses(base)).groupBy("row", (F.ceil(along(base) / tile) - 2).alias("col")).agg(F.count("*").alias("n"))
    tiles = counts.unionByName(at.select("row", "col", F.lit(0).cast("long").alias("n")).distinct()).groupBy("row", "col").agg(F.sum("n").alias("n"))
    carried = tiles.select("row", "col", F.sum("n").over(Window.partitionBy("row").orderBy(F.desc("col")).rowsBetween(Window.unboundedPreceding, 0)).alias("carried"))
    x, y, border = F.col("x"), F.col("y"), (F.col("col") + 1) * tile
    right = F.when(F.col("x1") > F.col("x2"), F.col("y1")).otherwise(F.col("y2"))
    climbs = ((F.col("x1") > border) != (F.col("x2") > border)) & ((to_the_east(border, base) != to_the_east(border, y)) != ((base < right) & (right <= y)))
    passes = to_the_east(x, y) != to_the_east(border, y)
    own = at.join(dealt, ["row", "col"], "left").groupBy(on, "row", "col").agg(F.count_if(passes != climbs).alias("own"))
    return own.join(carried, ["row", "col"]).filter((F.col("own") + F.col("carried")) % 2 == 1).select(on)
