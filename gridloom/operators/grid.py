"""Grids: cells, masks, stacking, alignment, distances. Missing values are null."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import haversine_km
from ..sources.params import cut_lineage
from .order import numbered
from .polygons import inside

#: Grids of up to this many cells are searched as one cube.
FEW_CELLS = 2000


def mask_antarctica(df: DataFrame, value: str = "value") -> DataFrame:
    """Values south of 60 degrees south become null."""
    return df.withColumn(value, F.when(F.col("lat") >= -60, F.col(value)))


def land_fraction(cells: DataFrame, edges: DataFrame, size: float, k: int = 4) -> DataFrame:
    """(cell_id, fraction) of each cell of `size` degrees, from k x k points."""
    at = lambda i: (F.col(i) + 0.5) / k - 0.5
    points = cells.select("cell_id", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    points = points.select("cell_id", F.concat_ws(":", "cell_id", "i", "j").alias("point_id"), (F.col("lon") + at("j") * size).alias("x"), (F.col("lat") + at("i") * size).alias("y"))
    hit = inside(points, edges).withColumn("hit", F.lit(1))
    return points.join(hit, "point_id", "left").groupBy("cell_id").agg((F.count("hit") / (k * k)).alias("fraction"))


def mask_ocean(df: DataFrame, edges: DataFrame, value: str = "value") -> DataFrame:
    """Values of cells whose centre is not inside a land polygon become null."""
    land = inside(df.select("cell_id", F.col("lon").alias("x"), F.col("lat").alias("y")).distinct(), edges, "cell_id").withColumn("__land", F.lit(True))
    return df.join(land, "cell_id", "left").withColumn(value, F.when(F.col("__land"), F.col(value))).drop("__land")


def mask_ocean_fraction(df: DataFrame, edges: DataFrame, threshold: float, size: float, value: str = "value") -> DataFrame:
    """Values of cells with a land fraction not above the threshold (between 0 and 1) become null."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must be between 0 and 1")
    share = land_fraction(df.select("cell_id", "lat", "lon").distinct(), edges, size)
    return df.join(share, "cell_id").withColumn(value, F.when(F.col("fraction") > threshold, F.col(value))).drop("fraction")


def stack_cells(df: DataFrame, value: str = "value") -> DataFrame:
    """Number the cells by latitude and longitude from 0, without those that lack a value anywhere."""
    whole = df.groupBy("lat", "lon").agg(F.max(F.col(value).isNull().cast("int")).alias("gap")).filter("gap = 0")
    return df.join(numbered(whole.select("lat", "lon"), ["lat", "lon"], "gridcell"), ["lat", "lon"])


def unstack_cells(df: DataFrame, keys: list[str]) -> DataFrame:
    """All latitudes by all longitudes for each key; cells that are not there get null."""
    lat, lon = df.select("lat").distinct(), df.select("lon").distinct()
    # The grid: as many rows as it has cells.
    return df.select(*keys).distinct().join(lat).join(lon).join(df, [*keys, "lat", "lon"], "left")


def align_to_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every cell of the original grid, in all of them null where dropped."""
    return grid.select("lat", "lon").distinct().join(df, ["lat", "lon"], "left")


def nearest_in_cubes(asked: DataFrame, cells: DataFrame, n: int, edge: float) -> DataFrame:
    """(cell_i, cell_j, km, rank): the n nearest among the cells in the same cube and the 26 around it."""
    cube = [F.floor(F.col(c) / edge).alias(f"cube_{c}") for c in "xyz"]
    i = asked.select(F.col("cell_id").alias("cell_i"), F.col("lat").alias("lat_i"), F.col("lon").alias("lon_i"), *cube)
    for c in "xyz":
        i = i.withColumn(f"cube_{c}", F.explode(F.sequence(F.col(f"cube_{c}") - 1, F.col(f"cube_{c}") + 1)))
    j = cells.select(F.col("cell_id").alias("cell_j"), F.col("lat").alias("lat_j"), F.col("lon").alias("lon_j"), *cube)
    pairs = i.join(j, [f"cube_{c}" for c in "xyz"]).withColumn("km", F.when(F.col("cell_i") == F.col("cell_j"), 0.0).otherwise(F.round(haversine_km(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j")), 6)))
    rank = F.row_number().over(Window.partitionBy("cell_i").orderBy("km", "cell_j")) - 1
    return pairs.select("cell_i", "cell_j", "km", rank.alias("rank")).filter(F.col("rank") < n)


def closest_neighbors(cells: DataFrame, n: int, edge: float | None = None) -> DataFrame:
    """(cell_i, cell_j, rank) of the n nearest cells, the cell itself included, by great-circle distance and id.

    Cells are points on the unit sphere in cubes of `edge` (by default such that the cubes around a cell hold some n on
    an even grid). A cell is settled when its n nearest are closer than an edge, which no cell beyond the cubes around can be; the
    others ask again in cubes of twice the edge, until one edge spans the sphere. Cells without coordinates take no part.
    """
    lat, lon = F.radians("lat"), F.radians("lon")
    at = cells.select("cell_id", "lat", "lon", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z")).dropna()
    if edge is None:
        count = at.count()
        edge = 2.0 if count <= FEW_CELLS else min(2.0, 2 * math.sqrt(2 * n / count))
    at = at if edge >= 2 else cut_lineage(at, "points")
    asked, settled = at, None
    while True:
        found = nearest_in_cubes(asked, at, n, edge)
        if edge < 2:
            found = cut_lineage(found, "neighbors")
            # A margin for the rounded distances, which are a micrometre apart at least.
            near = found.filter((F.col("rank") == n - 1) & (F.col("km") < 2 * 6371.0 * math.asin(edge / 2) - 1e-5)).select("cell_i")
            asked = asked.join(near, F.col("cell_id") == F.col("cell_i"), "left_anti")
            found = found.join(near, "cell_i", "left_semi")
        found = found.select("cell_i", "cell_j", "rank")
        settled = found if settled is None else settled.unionByName(found)
        if edge >= 2 or not asked.limit(1).count():
            return settled
        edge = min(2.0, 2 * edge)


def upsample_yearly(df: DataFrame, n_months: int | None = None) -> DataFrame:
    """Each yearly row twelve times, with month 1 to 12. With `n_months`, the length of the monthly axis, the years must make up that many."""
    if n_months is not None and n_months != 12 * df.select("year").distinct().count():
        raise ValueError("the monthly axis must have twelve months for each year")
    return df.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))


def resample_annual(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys, "year").agg(F.avg(value).alias(value))
