"""Group-wise fits: every group in one job, from sums; no loop over groups on the driver."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.params import cut_lineage
from .ensemble import align_outer_fill, median_nearest
from .guards import aligned, check_annual
from .moments import fitted
from .order import numbered


def linreg_fit(df: DataFrame, keys: list[str], predictors: list[str], target: str, weight: str | None = None, intercept: bool = True) -> DataFrame:
    """Weighted least squares for each key: intercept (0 if off) and, as b_ and a predictor's name, its slope; any number of predictors.

    Rows in which a predictor, the target or the weight is null or not finite take no part. Moments are centred and
    scaled, so that predictors far from zero or of unlike size lose no digits. A key whose rows leave a slope open
    (too few of them, or dependent predictors) has nulls. An empty table gives no rows.
    """
    if {"weights", "intercept"} & set(predictors):
        raise ValueError("no predictor may be named weights or intercept")
    return fitted(df, keys, predictors, target, weight, intercept)


def linreg_fit_tables(target: DataFrame, predictors: dict[str, DataFrame], on: list[str], keys: list[str], value: str = "value", weights: DataFrame | None = None, intercept: bool = True) -> DataFrame:
    """`linreg_fit` of a target on tables of predictors (on, predictor) and weights (on, weight), which must hold the target's keys `on`, each once; else raise."""
    rows = aligned(target, predictors | ({"weight": weights} if weights is not None else {}), on)
    return linreg_fit(rows, keys, list(predictors), value, "weight" if weights is not None else None, intercept)


def linreg_predict(df: DataFrame, params: DataFrame, keys: list[str], predictors: list[str], out: str = "predicted", exclude: set[str] = frozenset(), only: set[str] | None = None) -> DataFrame:
    """intercept + sum of slopes times predictors; `exclude` or `only` choose parts, "intercept" among them."""
    names = ["intercept", *predictors]
    if unknown := [p for p in predictors if f"b_{p}" not in params.columns]:
        raise ValueError(f"no parameters for {unknown}")
    if missing := [c[2:] for c in params.columns if c.startswith("b_") and c[2:] not in predictors and c[2:] not in exclude and (only is None or c[2:] in only)]:
        raise ValueError(f"no predictors for {missing}; exclude them to leave them out")
    use = [p for p in names if p not in exclude and (only is None or p in only)]
    total = sum((F.col("intercept") if p == "intercept" else F.col(f"b_{p}") * F.col(p) for p in use), F.lit(0.0))
    columns = df.columns
    return df.join(params, keys).withColumn(out, total).select(*columns, out)


def linreg_residuals(df: DataFrame, params: DataFrame, keys: list[str], predictors: list[str], target: str) -> DataFrame:
    return linreg_predict(df, params, keys, predictors).withColumn("residual", F.col(target) - F.col("predicted")).drop("predicted")


def fit_volcanic(residuals: DataFrame, aod: str = "aod", residual: str = "residual") -> DataFrame:
    """One row: the slope, without intercept, of residuals on aerosol depth, all members pooled. Rows with a null or NaN take no part."""
    return residuals.dropna(subset=[aod, residual]).agg((F.sum(F.col(aod) * F.col(residual)) / F.sum(F.col(aod) * F.col(aod))).alias("slope"))


def warn_volcanic(slope: DataFrame) -> DataFrame:
    """Warn unless the slope of `fit_volcanic` is negative: aerosols should cool."""
    found = slope.first()["slope"]
    if found is not None and found >= 0:
        warnings.warn(f"the volcanic slope is not negative: {found}", stacklevel=2)
    return slope


def superimpose_volcanic(df: DataFrame, slope: DataFrame, series: DataFrame, keys: list[str], column: str = "aod", value: str = "value", period: tuple[int, int] | None = None) -> DataFrame:
    """Add slope times the aerosol series to the values of annual data; years beyond `period` get none. `slope` is of `fit_volcanic`."""
    rows = align_outer_fill(check_annual(df, keys), series, column, period)
    return rows.join(F.broadcast(slope)).withColumn(value, F.col(value) + F.col("slope") * F.col(column)).drop("slope", column)  # one row


def ar_fit(df: DataFrame, keys: list[str], order: str = "year", value: str = "value", lag: int = 1) -> DataFrame:
    """First-order autoregression on the value `lag` steps before, by conditional least squares: intercept, coeff, variance, nobs.

    Pairs in which either value is null or NaN take no part. Below two pairs, or where the earlier values do not vary,
    the fit is null; nobs is given all the same.
    """
    rows = df.withColumn("x", F.lag(value, lag).over(Window.partitionBy(*keys).orderBy(order))).dropna(subset=["x", value])
    fit = rows.groupBy(*keys).agg(F.regr_slope(value, "x").alias("coeff"), F.regr_intercept(value, "x").alias("intercept"), F.count("*").alias("nobs"), *[f(value, "x").alias(c) for c, f in (("sxx", F.regr_sxx), ("syy", F.regr_syy), ("sxy", F.regr_sxy))])
    defined = lambda c: F.when((F.col("nobs") > 1) & (F.col("sxx") > 0), c)
    variance = (F.col("syy") - F.col("coeff") * F.col("sxy")) / F.col("nobs")
    return fit.select(*keys, defined(F.col("intercept")).alias("intercept"), defined(F.col("coeff")).alias("coeff"), defined(variance).alias("variance"), "nobs")


def lag_products(df: DataFrame, keys: list[str], lags: list[int], order: str, value: str) -> DataFrame:
    """(keys, mean, nobs, products): for each key the sums of products of 1, the lagged values and the value itself.

    Values are taken less the key's mean, so that no digits cancel. Rows without all lags take no part, NaN counts as
    null. All sums are one partial aggregation, of (lags + 2) (lags + 1) / 2 numbers a key.
    """
    df = df.withColumn(value, F.when(~F.isnan(value), F.col(value)))
    window = Window.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, F.col(value).cast("double").alias("y"), F.avg(value).over(Window.partitionBy(*keys)).alias("mean"), *[F.lag(value, k).over(window).cast("double").alias(f"x{k}") for k in lags]).dropna()
    terms = [F.lit(1.0), *[F.col(f"x{k}") - F.col("mean") for k in lags], F.col("y") - F.col("mean")]
    sums = [F.sum(terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))]
    return rows.groupBy(*keys).agg(F.first("mean").alias("mean"), F.count("*").alias("nobs"), F.array(*sums).alias("products"))


def solved_lags(products: DataFrame, keys: list[str], orders: list[int]) -> DataFrame:
    """(keys, p, intercept, coeffs, variance, nobs) of each order p on the first p lags; none where p + 1 rows or fewer, or dependent lags, leave it open."""
    schema = StructType([*[products.schema[k] for k in keys], *StructType.fromDDL("p int, intercept double, coeffs array<double>, variance double, nobs long")])

    def run(batches):
        for rows in batches:
            out = []
            for key, mean, nobs, sums in zip(rows[keys].itertuples(index=False), rows["mean"], rows["nobs"], rows["products"]):
                n = int((8 * len(sums) + 1) ** 0.5 - 1) // 2
                gram = np.zeros((n, n))
                gram[np.triu_indices(n)] = sums
                gram = gram + np.triu(gram, 1).T
                for p in orders:
                    a, b = gram[: p + 1, : p + 1], gram[: p + 1, -1]
                    size = np.sqrt(np.diag(a))
                    if nobs <= p + 1 or not (size > 0).all() or np.linalg.matrix_rank(a / np.outer(size, size), tol=1e-12) <= p:
                        continue
                    c = np.linalg.solve(a / np.outer(size, size), b / size) / size
                    out.append((*key, p, c[0] + mean * (1 - c[1:].sum()), c[1:].tolist(), (gram[-1, -1] - c @ b) / nobs, nobs))
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return products.mapInPandas(run, schema)


def ar_fit_lags(df: DataFrame, keys: list[str], lags: list[int], order: str = "year", value: str = "value") -> DataFrame:
    """(keys, intercept, coeffs, variance, nobs): autoregression on any given lags; `coeffs` is in the order of `lags`.

    Rows without all lags take no part; a key whose system is singular gets nulls.
    """
    if not 1 <= len(set(lags)) == len(lags) or min(lags) < 1:
        raise ValueError("one or more different lags from 1")
    products = lag_products(df, keys, lags, order, value)
    fit = solved_lags(products, keys, [len(lags)]).select(*[F.col(k).alias(f"__{k}") for k in keys], "intercept", "coeffs", "variance")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    nulls = F.array(*[F.lit(None).cast("double")] * len(lags))
    return products.join(fit, on, "left").select(*keys, "intercept", F.coalesce("coeffs", nulls).alias("coeffs"), "variance", "nobs")


def mean_of_means(df: DataFrame, names: list[str], inner: list[str], outer: list[str]) -> DataFrame:
    """Means of `names` over the rows of each `inner` key, then over these means for each `outer` key. Nulls do not count."""
    return df.groupBy(*inner).agg(*[F.avg(c).alias(c) for c in names]).groupBy(*outer).agg(*[F.avg(c).alias(c) for c in names])


def ar_fit_scen_ens(df: DataFrame, order: str = "year", value: str = "value") -> DataFrame:
    """Fit each series, average over members, then over scenarios, each scenario counting once."""
    return mean_of_means(ar_fit(df, ["scenario", "member", "cell_id"], order, value), ["intercept", "coeff", "variance"], ["scenario", "cell_id"], ["cell_id"])


def ar_fit_scen_ens_lags(df: DataFrame, lags: list[int], order: str = "year", value: str = "value") -> DataFrame:
    """As `ar_fit_scen_ens` on any lags: (cell_id, intercept, coeffs, variance). Series without a fit do not count."""
    each = ar_fit_lags(df, ["scenario", "member", "cell_id"], lags, order, value)
    names = [f"c{i}" for i in range(len(lags))]
    each = each.select("scenario", "cell_id", "intercept", "variance", *[F.col("coeffs")[i].alias(c) for i, c in enumerate(names)])
    mean = mean_of_means(each, ["intercept", "variance", *names], ["scenario", "cell_id"], ["cell_id"])
    return mean.select("cell_id", "intercept", F.array(*names).alias("coeffs"), "variance")


def ar_order(df: DataFrame, keys: list[str], maxlag: int = 12, order: str = "year", value: str = "value", criterion: str = "bic") -> DataFrame:
    """(keys, order): the order up to `maxlag` with the least criterion; all orders are fitted on the same rows.

    An order of p + 1 rows or fewer, or of dependent lags, takes no part; keys without any are left out.
    """
    if maxlag < 1:
        raise ValueError("maxlag must be at least 1")
    penalty = {"aic": lambda n, k: 2.0 * k, "bic": lambda n, k: F.log(n) * k, "hqic": lambda n, k: 2 * F.log(F.log(n)) * k}[criterion]
    fits = solved_lags(lag_products(df, keys, list(range(1, maxlag + 1)), order, value), keys, list(range(1, maxlag + 1)))
    ic = F.col("nobs") * F.log("variance") + penalty(F.col("nobs").cast("double"), F.col("p") + 1)
    return fits.groupBy(*keys).agg(F.min_by("p", F.struct(F.coalesce(ic, F.lit(float("-inf"))), "p")).alias("order"))


def ar_order_scen_ens(df: DataFrame, maxlag: int = 12, order: str = "year", value: str = "value", criterion: str = "bic") -> DataFrame:
    """Each series' order, then the nearest median over members, then over scenarios: (cell_id, order)."""
    each = ar_order(df, ["scenario", "member", "cell_id"], maxlag, order, value, criterion)
    over = lambda rows, keys: median_nearest(rows, keys, "order").select(*keys, "order")
    return over(over(each, ["scenario", "cell_id"]), ["cell_id"])


def ar_fit_monthly(df: DataFrame, keys: list[str], cell: str = "cell_id", value: str = "value", pooled: bool = False) -> DataFrame:
    """For each cell and calendar month the regression on the month before: (cell, month, intercept, slope).

    `keys`, the cell among them, name the series. With `pooled` a cell's series stand one behind the other in the order of
    `keys`, and the first month of a series follows the last one of the series before; otherwise it has none. Pairs with a null take no part.
    """
    window = Window.partitionBy(*keys).orderBy("year", "month")
    rows = df.withColumn("x", F.lag(value).over(window))
    if pooled:
        ends = df.groupBy(*keys).agg(F.max_by(value, F.struct("year", "month")).alias("last"))
        before = F.lag("last").over(Window.partitionBy(cell).orderBy(*[k for k in keys if k != cell], F.lit(0)))  # a row a series
        ends = ends.select(*[F.col(k).alias(f"__{k}") for k in keys], before.alias("__before"))
        rows = rows.withColumn("__first", F.row_number().over(window) == 1).join(ends, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        rows = rows.withColumn("x", F.when(F.col("__first"), F.col("__before")).otherwise(F.col("x")))
    rows = rows.dropna(subset=["x", value])
    return rows.groupBy(cell, "month").agg(F.regr_intercept(value, "x").alias("intercept"), F.regr_slope(value, "x").alias("slope"))


def ar_monthly_residuals(df: DataFrame, params: DataFrame, keys: list[str], cell: str = "cell_id", value: str = "value") -> DataFrame:
    """Add `residual` of `ar_fit_monthly`'s parameters; each series' first month, and months without parameters, are left out."""
    rows = df.withColumn("__x", F.lag(value).over(Window.partitionBy(*keys).orderBy("year", "month"))).filter("__x IS NOT NULL")
    return rows.join(params, [cell, "month"]).withColumn("residual", F.col(value) - F.col("intercept") - F.col("slope") * F.col("__x")).drop("__x", "intercept", "slope")


def lowess(df: DataFrame, keys: list[str], x: str, y: str, n_steps: int | None = None, rounds: int = 0, frac: float | None = None, pooled: bool = False) -> DataFrame:
    """Locally weighted linear regression (Cleveland 1979): for each distinct x of a key the n nearest rows, tricube weights.

    n is `n_steps`, or the part `frac` of the key's rows, rounded down. With `pooled` a key holds several members with
    the same x: n is then `n_steps` times the rows for each x, so that as many x as without pooling count.

    A row's neighbours lie within n ranks of x, so ranks are joined by blocks of n: no more than 3 n rows meet one x, except at
    repeated x. `rounds` robust rounds weigh rows by the bisquare of their residual over six median absolute residuals;
    with all residuals zero they change nothing. Rows with a null take no part.
    """
    rows = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).alias("y")).dropna().withColumn("robust", F.lit(1.0))
    if (n_steps is None) == (frac is None):
        raise ValueError("exactly one of n_steps and frac must be given")
    if frac is None and not pooled:
        rows = rows.withColumn("n", F.lit(n_steps).cast("long"))
    else:
        count = F.count("*") * F.lit(float(frac)) if frac is not None else F.lit(float(n_steps)) * F.count("*") / F.countDistinct("x")
        sizes = rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(count + 1e-10)).cast("long").alias("n"))
        rows = rows.join(sizes, keys)
    rows = numbered(rows, ["x", "y"], "rank", keys).withColumn("rank", F.col("rank") + 1)
    rows = rows if not rounds else cut_lineage(rows, "lowess")
    smooth = lowess_once(rows, keys)
    for _ in range(rounds):
        gaps = rows.join(smooth.withColumnRenamed("x0", "x"), [*keys, "x"]).withColumn("gap", F.abs(F.col("y") - F.col("smooth")))
        scale = gaps.groupBy(*keys).agg((6 * F.median("gap")).alias("scale"))
        share = F.least(F.col("gap") / F.col("scale"), F.lit(1.0))
        rows = gaps.join(scale, keys).withColumn("robust", F.when(F.col("scale") > 0, (1 - share**2) ** 2).otherwise(1.0)).select(*keys, "x", "y", "robust", "n", "rank")
        rows = cut_lineage(rows, "lowess")
        smooth = lowess_once(rows, keys)
    return smooth.withColumnRenamed("x0", x)


def lowess_once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x0, smooth) from rows (keys, x, y, robust, n, rank); n is one number in a key."""
    at = rows.groupBy(*keys, "n", F.col("x").alias("x0")).agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    blocks = F.explode(F.sequence(F.floor((F.col("low") - F.col("n")) / F.col("n")), F.floor((F.col("high") + F.col("n")) / F.col("n"))))
    at, near = at.withColumn("block", blocks), rows.withColumn("block", F.floor(F.col("rank") / F.col("n")))
    window = Window.partitionBy(*keys, "x0").orderBy("d", "x", "rank")
    pairs = at.join(near, [*keys, "n", "block"]).withColumn("d", F.abs(F.col("x") - F.col("x0"))).withColumn("r", F.row_number().over(window)).filter(F.col("r") <= F.col("n"))
    pairs = pairs.withColumn("h", F.max("d").over(Window.partitionBy(*keys, "x0")))
    w = F.col("robust") * F.when(F.col("d") < F.col("h"), (1 - (F.col("d") / F.col("h")) ** 3) ** 3).otherwise(0.0)
    c = F.col("x") - F.col("x0")
    s = pairs.groupBy(*keys, "x0").agg(*[F.sum(w * e).alias(n) for n, e in (("s0", F.lit(1.0)), ("s1", c), ("s2", c * c), ("t0", F.col("y")), ("t1", c * F.col("y")))])
    return s.select(*keys, "x0", ((F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / (F.col("s0") * F.col("s2") - F.col("s1") ** 2)).alias("smooth"))


def adjust_covariance_ar1(cov: DataFrame, coeffs: DataFrame) -> DataFrame:
    """cov_ij times sqrt(1 - g_i^2) sqrt(1 - g_j^2); `coeffs` has cell_id, coeff."""
    g = lambda k: coeffs.select(F.col("cell_id").alias(f"cell_{k}"), F.sqrt(1 - F.col("coeff") ** 2).alias(f"g_{k}"))
    return cov.join(g("i"), "cell_i").join(g("j"), "cell_j").select("cell_i", "cell_j", (F.col("cov") * F.col("g_i") * F.col("g_j")).alias("cov"))


def first_local_minimum(scored: DataFrame, at: str = "radius", score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """(keys, at, score), a row a key: going up in `at`, the last before the first higher score. Ties go on, infinity is higher than any number.

    `scored` has one row for each key and candidate. Raises if a key's scores are all infinite or null, or one is minus
    infinity; warns if a key's scores begin with the minimum, fall to the end, or hold infinity.
    """
    keys, high = keys or [], F.lit(float("inf"))
    rows = scored.select(*keys, at, F.coalesce(F.nanvl(F.col(score).cast("double"), high), high).alias(score))
    rows = rows.withColumn("next", F.lead(score).over(Window.partitionBy(*keys).orderBy(at)))
    found = rows.groupBy(*keys).agg(F.min(F.when(F.col("next") > F.col(score), F.col(at))).alias("stop"), F.max(at).alias("last"), F.min(at).alias("first"), F.min(score).alias("low"), F.max(score).alias("high"))
    checks = found.agg(F.count("*"), *[F.count_if(c) for c in (~(F.abs("low") < high), F.col("stop") == F.col("first"), F.col("stop").isNull(), F.col("high") == high)]).first()
    if not checks[0] or checks[1]:
        raise ValueError("no finite score, or one without bound")
    for n, what in zip(checks[2:], ("begin with the minimum", "have no local minimum, so the last is taken", "hold infinity")):
        if n:
            warnings.warn(f"the scores of {n} of {checks[0]} keys {what}", stacklevel=2)
    best = found.select(*[F.col(k).alias(f"__{k}") for k in keys], F.coalesce("stop", "last").alias("__at"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(at) == F.col("__at")]
    return rows.join(best, on).select(*keys, at, score)
