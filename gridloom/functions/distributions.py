"""Distribution functions as Columns: log density, distribution function, quantile function and support."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .scalar import norm_logpdf

TINY = 1e-12
#: Nodes of the quadrature of scores.
NODES = 32


@F.pandas_udf(DoubleType())
def standard_normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series([0.5 * math.erfc(-v / math.sqrt(2)) if v == v else None for v in z], dtype="float64")


@F.pandas_udf(DoubleType())
def standard_normal_ppf(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    ends = {0.0: -math.inf, 1.0: math.inf}
    return pd.Series([inverse(v) if 0 < v < 1 else ends.get(v, math.nan) for v in p], dtype="float64")


def log_from_zero(x: Column) -> Column:
    """The logarithm, minus infinity at zero, where Spark's is null. Quantiles at the probabilities 0 and 1 are then the ends of the support."""
    return F.when(x == 0, F.lit(-math.inf)).otherwise(F.log(x))


def log1p_from_zero(x: Column) -> Column:
    return F.when(x == -1, F.lit(-math.inf)).otherwise(F.log1p(x))


def norm_cdf(x: Column, loc: Column, scale: Column) -> Column:
    return standard_normal_cdf((x - loc) / scale)


def norm_ppf(p: Column, loc: Column, scale: Column) -> Column:
    return loc + scale * standard_normal_ppf(p)


def norm_crps(x: Column, loc: Column, scale: Column) -> Column:
    """The continuous ranked probability score, closed form (Gneiting and Raftery 2007)."""
    z = (x - loc) / scale
    return scale * (z * (2 * standard_normal_cdf(z) - 1) + 2 * F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))


def gumbel_logpdf(x: Column, loc: Column, scale: Column) -> Column:
    z = (x - loc) / scale
    return -z - F.exp(-z) - F.log(scale)


def gumbel_cdf(x: Column, loc: Column, scale: Column) -> Column:
    return F.exp(-F.exp(-(x - loc) / scale))


def gumbel_ppf(p: Column, loc: Column, scale: Column) -> Column:
    return loc - scale * log_from_zero(-log_from_zero(p))


def logistic_logpdf(x: Column, loc: Column, scale: Column) -> Column:
    z = F.abs((x - loc) / scale)
    return -z - 2 * F.log1p(F.exp(-z)) - F.log(scale)


def logistic_cdf(x: Column, loc: Column, scale: Column) -> Column:
    return 1 / (1 + F.exp(-(x - loc) / scale))


def logistic_ppf(p: Column, loc: Column, scale: Column) -> Column:
    return loc + scale * F.when(p == 1, F.lit(math.inf)).otherwise(log_from_zero(p / (1 - p)))


def laplace_logpdf(x: Column, loc: Column, scale: Column) -> Column:
    return -F.abs(x - loc) / scale - F.log(2 * scale)


def laplace_cdf(x: Column, loc: Column, scale: Column) -> Column:
    z = (x - loc) / scale
    return F.when(z < 0, 0.5 * F.exp(z)).otherwise(1 - 0.5 * F.exp(-z))


def laplace_ppf(p: Column, loc: Column, scale: Column) -> Column:
    return loc + scale * F.when(p < 0.5, log_from_zero(2 * p)).otherwise(-log_from_zero(2 * (1 - p)))


def expon_logpdf(x: Column, loc: Column, scale: Column) -> Column:
    return F.when(x >= loc, -(x - loc) / scale - F.log(scale)).otherwise(F.lit(-math.inf))


def expon_cdf(x: Column, loc: Column, scale: Column) -> Column:
    return F.when(x >= loc, -F.expm1(-(x - loc) / scale)).otherwise(0.0)


def expon_ppf(p: Column, loc: Column, scale: Column) -> Column:
    return loc - scale * log1p_from_zero(-p)


def weibull_min_logpdf(x: Column, loc: Column, scale: Column, c: Column) -> Column:
    z = (x - loc) / scale
    return F.when(z > 0, F.log(c) + (c - 1) * F.log(z) - F.pow(z, c) - F.log(scale)).otherwise(F.lit(-math.inf))


def weibull_min_cdf(x: Column, loc: Column, scale: Column, c: Column) -> Column:
    z = (x - loc) / scale
    return F.when(z > 0, -F.expm1(-F.pow(z, c))).otherwise(0.0)


def weibull_min_ppf(p: Column, loc: Column, scale: Column, c: Column) -> Column:
    return loc + scale * F.pow(-log1p_from_zero(-p), 1 / c)


def genextreme_logpdf(x: Column, loc: Column, scale: Column, c: Column) -> Column:
    """Positive shapes c have an upper end, negative ones a lower end; zero is Gumbel."""
    z = (x - loc) / scale
    left = F.log1p(-c * z) / c
    inside = F.when(c * z < 1, left - F.exp(left) - F.log1p(-c * z) - F.log(scale)).otherwise(F.lit(-math.inf))
    return F.when(F.abs(c) < TINY, gumbel_logpdf(x, loc, scale)).otherwise(inside)


def genextreme_cdf(x: Column, loc: Column, scale: Column, c: Column) -> Column:
    z = (x - loc) / scale
    inside = F.when(c * z < 1, F.exp(-F.exp(F.log1p(-c * z) / c))).when(c > 0, 1.0).otherwise(0.0)
    return F.when(F.abs(c) < TINY, gumbel_cdf(x, loc, scale)).otherwise(inside)


def genextreme_ppf(p: Column, loc: Column, scale: Column, c: Column) -> Column:
    return F.when(F.abs(c) < TINY, gumbel_ppf(p, loc, scale)).otherwise(loc + scale * -F.expm1(c * log_from_zero(-log_from_zero(p))) / c)


#: name: (log density, distribution function, quantile function), each of (x or p, loc, scale[, c]).
DISTRIBUTIONS = {
    "norm": (norm_logpdf, norm_cdf, norm_ppf),
    "gumbel_r": (gumbel_logpdf, gumbel_cdf, gumbel_ppf),
    "logistic": (logistic_logpdf, logistic_cdf, logistic_ppf),
    "laplace": (laplace_logpdf, laplace_cdf, laplace_ppf),
    "expon": (expon_logpdf, expon_cdf, expon_ppf),
    "weibull_min": (weibull_min_logpdf, weibull_min_cdf, weibull_min_ppf),
    "genextreme": (genextreme_logpdf, genextreme_cdf, genextreme_ppf),
}


def in_support(name: str, x: Column, loc: Column, scale: Column, c: Column | None = None) -> Column:
    """Whether x is where the density is positive, and the parameters are valid."""
    if name == "genextreme":
        return (scale > 0) & (c * (x - loc) / scale < 1)
    if name in ("expon", "weibull_min"):
        valid = (scale > 0) & (x >= loc)
        return valid & (c > 0) if name == "weibull_min" else valid
    return scale > 0


def crps(name: str, x: Column, loc: Column, scale: Column, c: Column | None = None) -> Column:
    """The continuous ranked probability score of one value: closed form for the normal distribution, else by quadrature.

    With the distribution's F and quantiles q it is twice the integral of p (x - q(p)) up to F(x) and of
    (1 - p) (q(p) - x) from there on. A polynomial that is flat at both ends takes the nodes there, where quantiles grow. Infinite where the mean is
    (genextreme with c <= -1).
    """
    if name == "norm":
        return norm_crps(x, loc, scale)
    params = [loc, scale] + ([c] if c is not None else [])
    cdf, ppf = DISTRIBUTIONS[name][1:]
    at = cdf(x, *params)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    s = (nodes + 1) / 2
    g, slope = s**3 * (10 - 15 * s + 6 * s * s), 30 * (s * (1 - s)) ** 2
    node = F.array(*[F.struct(F.lit(a).alias("g"), F.lit(b).alias("w")) for a, b in zip(g.tolist(), (weights * g * slope).tolist())])

    def part(n: Column) -> Column:
        # Probabilities stay off 0 and 1, where quantiles may be infinite.
        low = at * at * n["w"] * (x - ppf(F.greatest(at * n["g"], F.lit(1e-300)), *params))
        high = (1 - at) * (1 - at) * n["w"] * (ppf(F.least(1 - (1 - at) * n["g"], F.lit(1 - 2.0**-53)), *params) - x)
        return F.when(at > 0, low).otherwise(0.0) + F.when(at < 1, high).otherwise(0.0)

    score = F.aggregate(node, F.lit(0.0), lambda total, n: total + part(n))
    return F.when(c > -1, score).otherwise(F.lit(math.inf)) if name == "genextreme" else score
