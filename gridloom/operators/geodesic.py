"""Geodesic distances on the WGS84 ellipsoid, antipodes included."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalar import haversine_km

#: Fixed values of the ellipsoid: equatorial radius in km, flattening.
RADIUS, FLATTENING = 6378.137, 1 / 298.257223563
#: Nodes of the quadrature, halvings of the azimuth; least blocks, and cells of a block, in the join of all pairs.
NODES, HALVINGS, BLOCKS, BLOCK = 24, 60, 8, 1024


def geodesic_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Lengths of the shortest lines, for arrays of degrees.

    On the auxiliary sphere (Bessel 1825, Karney 2013) the longitude difference grows with the azimuth at the point
    of higher latitude, which is found by halving; longitude and length are integrals, by Gauss-Legendre.
    """
    f = FLATTENING
    swap = np.abs(lat1) < np.abs(lat2)
    first, second = np.where(swap, lat2, lat1), np.where(swap, lat1, lat2)
    sign = np.where(first > 0, -1.0, 1.0)
    turn = np.radians(np.abs((lon2 - lon1 + 180) % 360 - 180))
    beta1, beta2 = (np.arctan((1 - f) * np.tan(np.radians(x * sign))) for x in (first, second))
    sin1, cos1, sin2, cos2 = np.minimum(np.sin(beta1), -1e-200), np.maximum(np.cos(beta1), 1e-150), np.sin(beta2), np.maximum(np.cos(beta2), 1e-150)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)

    def line(azimuth):
        sin_a, cos_a = np.sin(azimuth), np.cos(azimuth)
        sin0 = sin_a * cos1
        k2 = (1 - sin0**2) * f * (2 - f) / (1 - f) ** 2
        end = np.sqrt(np.maximum(0, (cos_a * cos1) ** 2 + np.where(cos1 < -sin1, (cos2 - cos1) * (cos1 + cos2), (sin1 - sin2) * (sin1 + sin2))))
        s1, w1 = np.arctan2(sin1, cos_a * cos1), np.arctan2(sin0 * sin1, cos_a * cos1)
        s2, w2 = np.arctan2(sin2, end), np.arctan2(sin0 * sin2, end)
        arc = np.maximum(0, s2 - s1)
        at = s1[:, None] + arc[:, None] * (nodes + 1) / 2
        root = np.sqrt(1 + k2[:, None] * np.sin(at) ** 2)
        east = (w2 - w1) % (2 * np.pi) - f * sin0 * (arc / 2) * (((2 - f) / (1 + (1 - f) * root)) @ weights)
        return east, RADIUS * (1 - f) * (arc / 2) * (root @ weights)

    low, high = np.zeros_like(turn), np.full_like(turn, np.pi)
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        short = line(middle)[0] < turn
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    along = (first == 0) & (second == 0) & (turn <= (1 - f) * np.pi)
    same = (turn == 0) & (first == second)
    return np.where(same, 0.0, np.where(along, RADIUS * turn, line((low + high) / 2)[1]))


@F.pandas_udf(DoubleType())
def geodesic_column(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(geodesic_km(*(np.asarray(x, float) for x in (lat1, lon1, lat2, lon2))))


def both_ways(found: DataFrame) -> DataFrame:
    """(cell_i, cell_j, km) and the same pairs turned round."""
    turned = found.select("cell_i", "cell_j", "km", F.explode(F.array(F.lit(False), F.lit(True))).alias("turned"))
    swap = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(a)
    return turned.select(swap("cell_i", "cell_j"), swap("cell_j", "cell_i"), "km")


def placed_cells(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


def near_pairs(cells: DataFrame, reach: float, haversine: bool = False) -> DataFrame:
    """(cell_i, cell_j, km) for the cells (cell_id, lat, lon) at most `reach` km apart, symmetric, zero on the diagonal.

    Distances are geodesics of the ellipsoid or, with `haversine`, great circles. A straight line through the earth is no
    longer than the way over it, so cells are placed in space, in cubes of edge `reach`, and meet those in the cube and the
    26 around it: pairs grow with the neighbours, not with the square of the cells. Cells without coordinates take no part.
    """
    lat, lon = F.radians("lat"), F.radians("lon")
    flat = 0.0 if haversine else FLATTENING * (2 - FLATTENING)
    normal = F.lit(6371.0) if haversine else RADIUS / F.sqrt(1 - flat * F.sin(lat) ** 2)
    axes = {"x": normal * F.cos(lat) * F.cos(lon), "y": normal * F.cos(lat) * F.sin(lon), "z": normal * (1 - flat) * F.sin(lat)}
    at = placed_cells(cells).dropna().select("cell_id", "lat", "lon", *[c.alias(k) for k, c in axes.items()])
    side = lambda k: at.select(F.col("cell_id").alias(f"cell_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("lat", "lon", *axes)], *[F.floor(F.col(c) / reach).alias(f"cube_{c}") for c in axes])
    i = side("i")
    for c in axes:
        i = i.withColumn(f"cube_{c}", F.explode(F.sequence(F.col(f"cube_{c}") - 1, F.col(f"cube_{c}") + 1)))
    line = sum(((F.col(f"{c}_i") - F.col(f"{c}_j")) ** 2 for c in axes), F.lit(0.0))
    pairs = i.join(side("j"), [f"cube_{c}" for c in axes]).filter("cell_i < cell_j").filter(line <= (reach * (1 + 1e-9)) ** 2)
    way = haversine_km if haversine else geodesic_column
    found = pairs.select("cell_i", "cell_j", way(*[F.col(c) for c in ("lat_i", "lon_i", "lat_j", "lon_j")]).alias("km")).filter(F.col("km") <= reach)
    return both_ways(found).union(at.select("cell_id", "cell_id", F.lit(0.0)))


def geodist(cells: DataFrame) -> DataFrame:
    """(cell_i, cell_j, km) for all pairs of cells (cell_id, lat, lon), symmetric, zero on the diagonal.

    Pairs are made between blocks of about BLOCK cells by an equi-join, each distance is computed once. A null coordinate
    gives null distances. Where only near cells count, `near_pairs` makes far fewer.
    """
    ids = placed_cells(cells)
    blocks = max(BLOCKS, -(-ids.count() // BLOCK))
    placed = ids.withColumn("block", F.pmod(F.xxhash64("cell_id"), F.lit(blocks)).cast("int"))
    side = lambda k, low, high: placed.select(F.col("cell_id").alias(f"cell_{k}"), F.col("lat").alias(f"lat_{k}"), F.col("lon").alias(f"lon_{k}"), low, high)
    own, every = F.col("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    pairs = side("i", own.alias("block_i"), every.alias("block_j")).join(side("j", every.alias("block_i"), own.alias("block_j")), ["block_i", "block_j"]).filter("cell_i < cell_j")
    found = pairs.select("cell_i", "cell_j", geodesic_column("lat_i", "lon_i", "lat_j", "lon_j").alias("km"))
    return both_ways(found).union(ids.select("cell_id", "cell_id", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), 0.0)))
