"""Column functions: longitudes, Gaspari-Cohn correlation, Yeo-Johnson transforms, distributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_to_180(lon: Column) -> Column:
    """Longitudes in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def wrap_to_360(lon: Column) -> Column:
    """Longitudes in [0, 360)."""
    return F.pmod(lon, F.lit(360.0))


def gaspari_cohn(r: Column) -> Column:
    """The compact fifth-order correlation (Gaspari and Cohn 1999): 1 at 0, 0 from 2 on, even in r."""
    r = F.abs(r)
    near = 1 - 5 / 3 * r**2 + 5 / 8 * r**3 + 0.5 * r**4 - 0.25 * r**5
    far = 4 - 5 * r + 5 / 3 * r**2 + 5 / 8 * r**3 - 0.5 * r**4 + r**5 / 12 - 2 / (3 * r)
    return F.when(r < 1, near).when(r < 2, far).otherwise(0.0)


def logistic_lambda(xi0: Column, xi1: Column, t: Column) -> Column:
    """2 / (1 + xi0 exp(xi1 t)): the transform's parameter, between 0 and 2."""
    return 2.0 / (1.0 + xi0 * F.exp(xi1 * t))


EPS = 2.220446049250313e-16


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Yeo and Johnson (2000), with a parameter for each row."""
    positive = F.when(F.abs(lam) <= EPS, F.log1p(x)).otherwise(F.expm1(lam * F.log1p(x)) / lam)
    mirrored = 2.0 - lam
    negative = F.when(F.abs(mirrored) <= EPS, -F.log1p(-x)).otherwise(-F.expm1(mirrored * F.log1p(-x)) / mirrored)
    return F.when(x >= 0, positive).otherwise(negative)


def yeo_johnson_inverse(y: Column, lam: Column) -> Column:
    """The inverse; null where no value maps to y."""
    up = lam * y
    mirrored = 2.0 - lam
    down = -mirrored * y
    positive = F.when(F.abs(lam) <= EPS, F.expm1(y)).when(up > -1, F.expm1(F.log1p(up) / lam))
    negative = F.when(F.abs(mirrored) <= EPS, -F.expm1(-y)).when(down > -1, -F.expm1(F.log1p(down) / mirrored))
    return F.when(y >= 0, positive).otherwise(negative)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def norm_logpdf(x: Column, loc: Column, scale: Column) -> Column:
    return -0.5 * ((x - loc) / scale) ** 2 - F.log(scale) - 0.9189385332046727
