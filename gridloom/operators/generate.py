"""Ensemble generation: a reproducible noise table and the recursions on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import yeo_johnson_inverse
from ..sources.params import cut_lineage
from .covariance import numbered_pairs
from .conditional import DistSpec, lambdas_from_covariates, probability_integral_transform
from .harmonic import harmonic_predict
from .tiles import SAMPLES, TILE, numbered_cells, products_with, sample_pieces, tiled


def uniform(key: Column, k: int) -> Column:
    """A number in [0, 1) from 48 bits of the key's digest: the same on any partitioning."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{k}"))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def noise_table(keys: DataFrame, seed: str) -> DataFrame:
    """Add `noise`: standard normal (Box-Muller), from the seed and the row's scenario, realisation, t and cell_id."""
    key = F.concat_ws(":", F.lit(seed), "scenario", "realisation", "t", "cell_id")
    return keys.withColumn("noise", F.sqrt(-2 * F.log(1 - uniform(key, 1))) * F.cos(2 * 3.141592653589793 * uniform(key, 2)))


def recursion(names: list[str], schema, start: int, drop: int, step):
    """Batches of whole series (keys, e: array of noise by t, parameters) to rows (keys, t, x), all series of a batch at once.

    `step(batch, x, t)` gives x at t less its noise, from the columns before; before `start` x is zero. Without a start x begins with its noise.
    """

    def run(batches):
        for rows in batches:
            if not len(rows):
                continue
            sizes = np.array([len(e) for e in rows["e"]])
            noise = np.full((len(rows), sizes.max()), np.nan)
            for k, e in enumerate(rows["e"]):
                noise[k, : len(e)] = e
            x = np.zeros_like(noise)
            if not start:
                x[:, 0] = noise[:, 0]
            for t in range(max(1, start), noise.shape[1]):
                x[:, t] = step(rows, x, t) + noise[:, t]
            left = np.maximum(sizes - drop, 0)
            at = np.repeat(np.arange(len(rows)), left)
            t = np.arange(len(at)) - np.repeat(np.cumsum(left) - left, left)
            out = rows[names].iloc[at].reset_index(drop=True)
            out["t"], out["x"] = t, pd.array(x[at, t + drop], "Float64")  # not a number is null
            yield out[[f.name for f in schema]]

    return run


def series_of(noise: DataFrame, keys: list[str], params: DataFrame) -> DataFrame:
    """One row a series: its noise in the order of t, and its cell's parameters."""
    sorted_ = F.array_sort(F.collect_list(F.struct("t", "noise")))
    return noise.groupBy(*keys).agg(F.transform(sorted_, lambda e: e["noise"]).alias("e")).join(params, "cell_id")


def ar_recursion(noise: DataFrame, params: DataFrame, keys: list[str], buffer: int = 0) -> DataFrame:
    """x_t = c + a_1 x_(t-1) + ... + a_p x_(t-p) + e_t from zeros, the first computed t being p + 1; the first `buffer` steps are dropped.

    `noise` has keys (cell_id among them), t (from 0) and noise, `params` cell_id, intercept and coeff (p = 1) or
    coeffs (an array of p). A series is one row; a batch of series is computed a step at a time. Null parameters
    give null from t = p + 1 on.
    """
    coeffs = F.col("coeffs") if "coeffs" in params.columns else F.array("coeff")
    given = params.select("cell_id", F.col("intercept").cast("double").alias("c"), F.transform(coeffs, lambda a: a.cast("double")).alias("a"), F.size(coeffs).alias("p"))
    orders = [r.p for r in given.select("p").distinct().limit(2).collect()]
    if len(orders) > 1:
        raise ValueError("all cells need the same order")
    p = max(1, orders[0]) if orders else 1
    schema = StructType([*[noise.schema[k] for k in keys], *StructType.fromDDL("t long, x double")])

    def step(rows, x, t):
        a = np.array([list(v) for v in rows["a"]], np.float64)
        return rows["c"].to_numpy(np.float64) + (a * x[:, t - p : t][:, ::-1]).sum(axis=1)

    return series_of(noise, keys, given).select(*keys, "e", "c", "a").mapInPandas(recursion(keys, schema, p + 1, buffer, step), schema)


def correlate_noise(noise: DataFrame, factor: DataFrame, size: int = TILE, samples: int = SAMPLES) -> DataFrame:
    """Colour noise (scenario, realisation, t, cell_id, noise) with a root (cell_i, cell_j, value) of its covariance, such as of `covariance_factor`.

    A sample (scenario, realisation, t) must have each cell of the root once; cells that the root lacks are left out. Blocks
    of `samples` samples are multiplied by tiles of `size` cells a side.
    """
    names = ["scenario", "realisation", "t"]
    cells = numbered_cells(factor.select(F.col("cell_i").alias("cell_id")).union(factor.select("cell_j")))
    n = cells.count()
    roots = numbered_pairs(factor.select("cell_i", "cell_j", F.col("value").cast("double").alias("value")), cells)
    full = roots.filter("i < j").limit(1).count()  # a root that is no lower triangle, as eigenvectors make one
    if full and n > size:
        raise ValueError("a root of several tiles must be lower triangular")
    tiles = cut_lineage(tiled(roots, [], "value", n, size, 0.0), "root")
    rows = noise.join(cells, "cell_id")
    chunks = max(1, -(-rows.select(*names).distinct().count() // samples))
    rows = rows.select(F.pmod(F.xxhash64(*names), F.lit(chunks)).alias("c"), *names, "i", F.col("noise").alias("value"), F.lit(1.0).alias("weight"))
    pieces = cut_lineage(sample_pieces(rows, [], n, size, names, True), "noise")
    found = products_with(pieces, tiles, names, chunks, n, size)
    return found.join(cells, "i").select(*names, "cell_id", F.col("value").alias("noise"))


def ar_recursion_monthly(noise: DataFrame, params: DataFrame, keys: list[str], buffer: int = 0) -> DataFrame:
    """x_t = c_m + s_m x_(t-1) + e_t with the parameters of t's calendar month, x_0 = e_0; `buffer` years are dropped.

    `noise` has keys, t (months from 0, a January) and noise, `params` cell_id, month (1 to 12), intercept, slope.
    """
    months = params.select("cell_id", F.col("month").cast("int").alias("month"), "intercept", "slope").groupBy("cell_id")
    slot = lambda c, m: F.max(F.when(F.col("month") == m, F.col(c))).cast("double")
    given = months.agg(*[F.array(*[slot(c, m) for m in range(1, 13)]).alias(name) for c, name in (("intercept", "c"), ("slope", "a"))])
    schema = StructType([*[noise.schema[k] for k in keys], *StructType.fromDDL("t long, x double")])

    def step(rows, x, t):
        of = lambda name: np.array([v[t % 12] for v in rows[name]], np.float64)
        return of("c") + of("a") * x[:, t - 1]

    return series_of(noise, keys, given).select(*keys, "e", "c", "a").mapInPandas(recursion(keys, schema, 0, 12 * buffer, step), schema)


def emulate_annual(forced: DataFrame, local: DataFrame, first: int) -> DataFrame:
    """Forced response (scenario, year, cell_id, forced) plus local variability (scenario, realisation, t, cell_id, x), t from year `first`."""
    rows = local.withColumn("year", F.col("t") + F.lit(first).cast("long")).join(forced, ["scenario", "year", "cell_id"])
    return rows.select("scenario", "realisation", "year", "cell_id", (F.col("forced") + F.col("x")).alias("value"))


def emulate_monthly(yearly: DataFrame, cycle: DataFrame, power: DataFrame, local: DataFrame, first: int) -> DataFrame:
    """Seasonal cycle of the yearly values plus the back-transformed local variability: (scenario, realisation, year, month, cell_id, value).

    `yearly` has scenario, year, cell_id, yearly; `cycle` is of `harmonic_fit`, `power` of `yeo_johnson_fit` by cell_id and
    month; `local` has scenario, realisation, t (months from January of year `first`), cell_id, x. A draw that no value
    maps to gives null.
    """
    dated = local.select("scenario", "realisation", "cell_id", "x", (F.floor(F.col("t") / 12) + first).alias("year"), (F.col("t") % 12 + 1).cast("long").alias("month"))
    rows = dated.join(yearly.select("scenario", "year", "cell_id", "yearly"), ["scenario", "year", "cell_id"])
    rows = lambdas_from_covariates(harmonic_predict(rows, cycle, "cycle"), power, ["cell_id", "month"])
    return rows.select("scenario", "realisation", "year", "month", "cell_id", (F.col("cycle") + yeo_johnson_inverse(F.col("x"), F.col("lambda"))).alias("value"))


def emulate_extremes(predictors: DataFrame, coefficients: DataFrame, spec: DistSpec, local: DataFrame, first: int, threshold: float = 1e-9) -> DataFrame:
    """Standard normal local variability (scenario, realisation, t, cell_id, x) as draws of each cell's conditional distribution.

    `predictors` has scenario, year and the columns that `spec` names; `coefficients` cell_id and the coefficients.
    """
    rows = local.withColumn("year", F.col("t") + F.lit(first).cast("long")).join(predictors, ["scenario", "year"]).join(coefficients, "cell_id")
    normal = DistSpec("norm", {"loc": "0", "scale": "1"}, ())
    drawn = probability_integral_transform(rows, normal, spec, "x", "value", threshold)
    return drawn.select("scenario", "realisation", "year", "cell_id", "value")
