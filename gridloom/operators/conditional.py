"""Distributions whose parameters are expressions of coefficients and predictors, and variable-lambda power transforms."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import DISTRIBUTIONS, crps, in_support
from ..functions.scalar import yeo_johnson
from ..sources.params import cut_lineage
from .ensemble import smooth_coefficients
from .geodesic import near_pairs
from .guards import aligned, check_finite
from .population import evolve
from .search import minimise

#: Rows on either side in the moving average of the first guess.
SMOOTH = 5
#: Bounds and start of the logistic lambda's coefficients.
LOGISTIC_BOUNDS, LOGISTIC_START = [(0.0, 1e10), (-0.1, 0.1)], [1.0, 0.0]


@dataclass(frozen=True)
class DistSpec:
    """A distribution by name, its parameters as SQL expressions, and the names of the coefficients in them, in order."""

    name: str
    params: dict[str, str]
    coefficients: tuple[str, ...]

    def __post_init__(self):
        if self.name not in DISTRIBUTIONS:
            raise ValueError(f"unknown distribution {self.name}")
        text = " ".join(self.params.values())
        if unused := [c for c in self.coefficients if not re.search(rf"\b{c}\b", text)]:
            raise ValueError(f"coefficients {unused} are in no parameter")

    def evaluate(self, values: list[str] | None = None) -> dict[str, Column]:
        """The parameters as Columns. Coefficients are columns by their names, or the SQL texts in `values`."""
        put = dict(zip(self.coefficients, values)) if values else {}
        words = re.compile(r"\b[A-Za-z_]\w*\b")
        return {p: F.expr(f"CAST({words.sub(lambda m: put.get(m.group(), m.group()), text)} AS DOUBLE)") for p, text in self.params.items()}

    def logpdf(self, x: Column, values: list[str] | None = None) -> Column:
        """The log density; minus infinity outside of the support or at parameters that are not valid."""
        params = self.evaluate(values)
        return F.when(in_support(self.name, x, **params), DISTRIBUTIONS[self.name][0](x, **params)).otherwise(F.lit(-math.inf))

    def cdf(self, x: Column, values: list[str] | None = None) -> Column:
        return DISTRIBUTIONS[self.name][1](x, **self.evaluate(values))

    def ppf(self, p: Column, values: list[str] | None = None) -> Column:
        return DISTRIBUTIONS[self.name][2](p, **self.evaluate(values))


def evaluate_params(df: DataFrame, coefficients: DataFrame, spec: DistSpec, keys: list[str]) -> DataFrame:
    """Add a column for each parameter of the distribution, from the rows' predictors and the keys' coefficients."""
    joined = df.join(coefficients.select(*keys, *spec.coefficients), keys)
    return joined.select(*df.columns, *[v.alias(p) for p, v in spec.evaluate().items()])


def starts(coefficients: DataFrame, spec: DistSpec, keys: list[str]) -> DataFrame:
    x = F.array(*[F.col(c).cast("double") for c in spec.coefficients])
    return coefficients.select(*keys, x.alias("x"), F.transform(x, lambda v: F.greatest(F.abs(v) * 0.1, F.lit(0.05))).alias("h"))


def named(found: DataFrame, spec: DistSpec, keys: list[str]) -> DataFrame:
    return found.select(*keys, *[F.col("x")[i].alias(c) for i, c in enumerate(spec.coefficients)], "score")


WIDE = (-math.inf, math.inf)


def own_coefficients(spec: DistSpec, param: str) -> list[bool]:
    """Which of the coefficients stand in a parameter's expression."""
    return [bool(re.search(rf"\b{c}\b", spec.params.get(param, ""))) for c in spec.coefficients]


def in_bounds(params: dict[str, Column], bounds: dict[str, tuple[float, float]] | None) -> Column:
    """Whether a row's parameters lie within their bounds."""
    tests = [params[k].between(*b) for k, b in (bounds or {}).items() if k in params]
    return tests[0] if len(tests) == 1 else F.array_min(F.array(*tests)) if tests else F.lit(True)


def outline(df: DataFrame, keys: list[str], predictors: list[str]) -> DataFrame:
    """One row a key: means of the target and the predictors where the smoothed target is high and low, by more than its deviation."""
    spread = df.groupBy(*keys).agg(F.avg("__smooth").alias("__mean"), F.stddev_pop("__smooth").alias("__std"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    rows = df.join(spread.withColumnsRenamed({k: f"__{k}" for k in keys}), on)
    part = {"high": F.col("__smooth") > F.col("__mean") + F.col("__std"), "low": F.col("__smooth") < F.col("__mean") - F.col("__std")}
    means = [F.avg(F.when(cond, F.col(c))).alias(f"__{side}_{name}") for side, cond in part.items() for name, c in [("target", "__smooth"), *[(p, p) for p in predictors]]]
    return rows.groupBy(*keys).agg(F.first("__mean").alias("__mean"), *means).dropna()


def location_search(df: DataFrame, begin: DataFrame, spec: DistSpec, keys: list[str], generations: int) -> DataFrame:
    """The location's coefficients by a population search: a location that changes with the predictors as the target does, about its mean."""
    own = own_coefficients(spec, "loc")
    predictors = [c for c in df.columns if c not in keys and re.search(rf"\b{re.escape(c)}\b", spec.params["loc"])]
    if not any(own) or not predictors:
        return begin.select(*keys, "x", F.lit(math.inf).alias("score"))
    rows = cut_lineage(outline(df, keys, predictors), "outline")

    def loc(side, values):
        put = dict(zip(spec.coefficients, values)) | {p: f"`__{side}_{p}`" for p in predictors}
        return F.expr(f"CAST({re.sub(r'[A-Za-z_][A-Za-z_0-9]*', lambda m: put.get(m.group(), m.group()), spec.params['loc'])} AS DOUBLE)")

    def gap(values):
        high, low = loc("high", values), loc("low", values)
        along = lambda up, p: up / F.nullif(F.col(f"__high_{p}") - F.col(f"__low_{p}"), F.lit(0.0))
        slopes = [F.coalesce(along(high - low, p) - along(F.col("__high_target") - F.col("__low_target"), p), F.lit(0.0)) ** 2 for p in predictors]
        return F.sum(sum(slopes, ((high + low) / 2 - F.col("__mean")) ** 2))

    free = F.array(*[F.lit(1.0 if o else 0.0) for o in own])
    begin = begin.select(*keys, "x", F.zip_with("h", free, lambda h, f: h * f).alias("h"))
    found = evolve(rows, begin, keys, gap, [WIDE] * len(own), generations)
    kept = begin.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("x").alias("__x"))  # a key without high and low rows keeps its start
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return kept.join(found, on, "left").select(*[F.col(f"__{k}").alias(k) for k in keys], F.coalesce("x", "__x").alias("x"), F.coalesce("score", F.lit(math.inf)).alias("score"))


def first_guess(df: DataFrame, start: DataFrame, spec: DistSpec, keys: list[str], order: list[str], value: str = "value", weight: str | None = None, rounds: int = 12, generations: int = 24, param_bounds: dict[str, tuple[float, float]] | None = None, threshold: float = 0.0) -> DataFrame:
    """Start values (keys, coefficients, score) of `conditional_fit`, step by step from `start`:

    1. the location, by a global search for one that changes with the predictors as the target's moving average (11 rows of
    a key in `order`) does; 2. the location by least squares on that average; 3. the scale, by the mean squared deviation
    from the location; 4. all coefficients by the likelihood; 5. where a check of `validate_coefficients` then fails, by the cube
    of the negative log-likelihoods, which weighs unlikely values most. Steps whose parameter the distribution lacks, or
    whose expression holds no coefficient, are left out. `generations` 0 leaves out the global search.
    """
    w, wide = F.col(weight) if weight else F.lit(1.0), [WIDE] * len(spec.coefficients)
    begin = starts(start, spec, keys)
    if any(own_coefficients(spec, "loc")):
        smooth = df.withColumn("__smooth", F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-SMOOTH, SMOOTH)))
        if generations:
            smooth = cut_lineage(smooth, "smooth")
            begin = starts(named(location_search(smooth, begin, spec, keys, generations), spec, keys), spec, keys)

        def gap(values):
            loc = spec.evaluate(values)["loc"]
            return F.when(F.bool_and(in_bounds({"loc": loc}, param_bounds)), F.sum(w * (F.col("__smooth") - loc) ** 2))

        begin = starts(named(minimise(smooth, begin, keys, gap, wide, rounds), spec, keys), spec, keys)
    if any(own_coefficients(spec, "scale")):
        located = evaluate_params(df, named(begin.withColumn("score", F.lit(0.0)), spec, keys), spec, keys)
        center = F.col("loc") if "loc" in spec.params else F.lit(0.0)
        apart = located.withColumn("__apart", (F.col(value) - center) ** 2)

        def spread(values):
            scale = spec.evaluate(values)["scale"]
            return F.when(F.bool_and((scale > 0) & in_bounds({"scale": scale}, param_bounds)), F.abs(F.avg(F.col("__apart") - scale**2)))

        begin = starts(named(minimise(apart.drop(*spec.params), begin, keys, spread, wide, rounds), spec, keys), spec, keys)
    guess = named(minimise(df, begin, keys, lambda values: -F.sum(w * spec.logpdf(F.col(value), values)), wide, rounds), spec, keys)
    if not param_bounds and threshold <= 0:
        return guess
    bad = validate_coefficients(df, guess, spec, keys, value, None, param_bounds, threshold).filter("NOT valid").select(*keys)
    bad = cut_lineage(bad, "bad")
    if not bad.limit(1).count():
        return guess
    cubed = named(minimise(df, starts(guess.join(bad, keys, "left_semi"), spec, keys), keys, lambda values: F.sum(w * (-spec.logpdf(F.col(value), values)) ** 3), wide, rounds), spec, keys)
    return guess.join(bad, keys, "left_anti").unionByName(cubed)


def smoothed_guess(coefficients: DataFrame, cells: DataFrame, spec: DistSpec, radius: float, keys: list[str]) -> DataFrame:
    """(keys, coefficients): each coefficient as the median of the cells around, weighted by the Gaspari-Cohn correlation of `radius` km.

    `keys` hold cell_id, `cells` cell_id, lat and lon; other keys are smoothed each by themselves.
    """
    others = [k for k in keys if k != "cell_id"]
    long = coefficients.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("coeff"), F.col(c).cast("double").alias("value")) for c in spec.coefficients])).alias("c")).select(*keys, "c.*")
    smooth = smooth_coefficients(long, near_pairs(cells, 2 * radius), radius, (*others, "coeff"))
    return smooth.groupBy(*keys).agg(*[F.max(F.when(F.col("coeff") == c, F.col("value"))).alias(c) for c in spec.coefficients])


def conditional_fit(df: DataFrame, guess: DataFrame, spec: DistSpec, keys: list[str], value: str = "value", weight: str | None = None, bounds: dict[str, tuple[float, float]] | None = None, threshold: float = 0.0, rounds: int = 24, starts_by: tuple[float, ...] = (1.0,), on_failed_fit: str = "error", param_bounds: dict[str, tuple[float, float]] | None = None, generations: int = 0, fallback: DataFrame | None = None) -> DataFrame:
    """(keys, coefficients, score): for each key the coefficients with the least weighted negative log-likelihood.

    Coefficients outside of `bounds`, or with a row's parameter outside of `param_bounds` or its value outside of the support,
    count as infinite, as do, if `threshold` is given, those at which a value's probability on either side falls below it.
    The guess stays where nothing better is found. `starts_by` are factors of the first steps: with several the search
    starts once with each, and a key's best end counts. With `generations` a population search starts from the guess, too,
    and the better end of both counts; it finds minima at corners, such as the end of a support. `fallback` is another
    guess for keys whose fit from the first one fails, such as the one before it was smoothed by `smoothed_guess`. If a
    key's score stays infinite, the fit raises, or, with `on_failed_fit` "ignore", keeps the guess. Rows with a null
    value or predictor take no part.
    """
    if on_failed_fit not in ("error", "ignore"):
        raise ValueError("on_failed_fit is 'error' or 'ignore'")
    w = F.col(weight) if weight else F.lit(1.0)
    limits = [(bounds or {}).get(c, WIDE) for c in spec.coefficients]
    target = lambda values: optimised(spec, value, w, threshold, values, param_bounds)

    def searched(guess: DataFrame) -> DataFrame:
        begin = starts(guess, spec, keys).withColumn("__by", F.explode(F.array(*[F.lit(float(s)) for s in starts_by])))
        ends = minimise(df, begin.withColumn("h", F.transform("h", lambda h: h * F.col("__by"))), [*keys, "__by"], target, limits, rounds)
        if generations:
            other = evolve(df, starts(guess, spec, keys), keys, target, limits, generations)
            ends = ends.unionByName(other.withColumn("__by", F.lit(math.inf)))
        best = ends.groupBy(*keys).agg(F.min_by(F.struct("x", "score"), F.struct("score", "__by")).alias("best"))
        return named(best.select(*keys, "best.*"), spec, keys)

    found = searched(guess)
    failed = F.col("score") == math.inf
    if fallback is not None:
        found = cut_lineage(found, "fits")
        again = cut_lineage(found.filter(failed).select(*keys), "failed")
        if again.limit(1).count():
            found = found.filter(~failed).unionByName(searched(fallback.join(again, keys, "left_semi")))
    if on_failed_fit == "error" and found.filter(failed).limit(1).count():
        raise ValueError("a fit failed: no coefficients with a finite score")
    return found


def conditional_fit_tables(target: DataFrame, predictors: dict[str, DataFrame], on: list[str], guess: DataFrame, spec: DistSpec, keys: list[str], value: str = "value", weights: DataFrame | None = None, **options) -> DataFrame:
    """`conditional_fit` of a target on tables of predictors (on, predictor) and weights (on, weight). Raises unless these hold
    the target's keys `on`, each once, and all values are finite. `options` are those of `conditional_fit`."""
    tables = predictors | ({"weight": weights} if weights is not None else {})
    rows = cut_lineage(check_finite(aligned(target, tables, on), value, *tables), "rows")
    return conditional_fit(rows, guess, spec, keys, value, "weight" if weights is not None else None, **options)


def optimised(spec: DistSpec, value: str, w: Column, threshold: float, values: list[str] | None = None, param_bounds: dict[str, tuple[float, float]] | None = None) -> Column:
    """What the fit minimises, as an aggregate: the weighted negative log-likelihood, null where a parameter is out of bounds or a probability below the threshold."""
    total = -F.sum(w * spec.logpdf(F.col(value), values))
    if param_bounds:
        total = F.when(F.bool_and(in_bounds(spec.evaluate(values), param_bounds)), total)
    if threshold <= 0:
        return total
    p = spec.cdf(F.col(value), values)
    return F.when(F.min(F.least(p, 1 - p)) >= threshold, total)


def validate_coefficients(df: DataFrame, coefficients: DataFrame, spec: DistSpec, keys: list[str], value: str = "value", bounds: dict[str, tuple[float, float]] | None = None, param_bounds: dict[str, tuple[float, float]] | None = None, threshold: float = 0.0) -> DataFrame:
    """(keys, coeffs_ok, params_ok, support_ok, probability_ok, valid): four checks, each true only if those before are."""
    every = lambda tests: F.expr("true") if not tests else tests[0] if len(tests) == 1 else tests[0] & every(tests[1:])
    joined = df.join(coefficients.select(*keys, *spec.coefficients), keys)
    params = spec.evaluate()
    p = spec.cdf(F.col(value))
    checked = joined.select(
        *keys,
        every([F.col(c).between(*b) for c, b in (bounds or {}).items()]).alias("a"),
        every([params[k].between(*b) for k, b in (param_bounds or {}).items()]).alias("b"),
        in_support(spec.name, F.col(value), **params).alias("c"),
        (F.least(p, 1 - p) >= threshold).alias("d"),
    )
    ok = checked.groupBy(*keys).agg(*[F.bool_and(c).alias(c) for c in "abcd"])
    so_far = {"coeffs_ok": "a", "params_ok": "a and b", "support_ok": "a and b and c", "probability_ok": "a and b and c and d", "valid": "a and b and c and d"}
    return ok.select(*keys, *[F.expr(e).alias(n) for n, e in so_far.items()])


def quality_scores(df: DataFrame, coefficients: DataFrame, spec: DistSpec, keys: list[str], value: str = "value", weight: str | None = None, threshold: float = 0.0, scores: tuple[str, ...] = ("func_optim", "nll", "bic", "crps")) -> DataFrame:
    """(keys, scores): func_optim, what `conditional_fit` minimises with `threshold` (infinite where it rejects), nll, bic and crps.

    crps is the weighted sum over rows, in closed form for the normal distribution and by quadrature for all others.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    joined = df.join(coefficients.select(*keys, *spec.coefficients), keys)
    ll = F.sum(w * spec.logpdf(F.col(value)))
    found = {"func_optim": lambda: F.coalesce(optimised(spec, value, w, threshold), F.lit(math.inf)), "nll": lambda: -ll, "bic": lambda: len(spec.coefficients) * F.log(F.count(value)) - 2 * ll, "crps": lambda: F.sum(w * F.col("__crps"))}
    if "crps" in scores:
        joined = joined.withColumn("__crps", crps(spec.name, F.col(value), **spec.evaluate()))
    return joined.groupBy(*keys).agg(*[found[s]().alias(s) for s in scores])


def probability_integral_transform(df: DataFrame, source: DistSpec, target: DistSpec, value: str = "value", out: str = "transformed", threshold: float = 1e-9) -> DataFrame:
    """Add `out`: the value's probability under `source`, kept off 0 and 1 by `threshold`, as `target`'s quantile.

    Coefficients and predictors of both are columns of `df`.
    """
    if not 0 < threshold < 0.5:
        raise ValueError("the threshold lies between 0 and 0.5")
    p = F.greatest(F.lit(threshold), F.least(F.lit(1 - threshold), source.cdf(F.col(value))))
    return df.withColumn("__p", p).withColumn(out, target.ppf(F.col("__p"))).drop("__p")


def yeo_johnson_fit(df: DataFrame, keys: list[str], value: str = "value", yearly: str = "yearly", kind: str = "logistic", rounds: int = 24) -> DataFrame:
    """(keys, xi0, xi1): maximum likelihood of lambda = 2 / (1 + xi0 exp(xi1 T)), or, for `constant`, of lambda = xi0 (xi1 null).

    Rows with a null take no part. A key with fewer than two values, or with equal ones, keeps the start (1, 0), at which nothing changes.
    """
    rows = df.select(*keys, F.col(value).alias("__x"), F.col(yearly).alias("__t")).dropna()
    logistic = kind == "logistic"
    bounds, start = (LOGISTIC_BOUNDS, LOGISTIC_START) if logistic else ([(-math.inf, math.inf)], [1.0])

    def nll(values):
        lam = F.expr(f"2D / (1D + {values[0]} * exp({values[1]} * __t))") if logistic else F.expr(values[0])
        x = F.col("__x")
        spread = F.var_pop(yeo_johnson(x, lam))
        return F.when(spread > 0, F.count("*") / 2 * F.log(spread) - F.sum((lam - 1) * F.signum(x) * F.log1p(F.abs(x))))

    begin = rows.select(*keys).distinct().select("*", F.array(*[F.lit(v) for v in start]).alias("x"), F.array(*[F.lit(h) for h in ([0.2, 0.02] if logistic else [0.2])]).alias("h"))
    found = minimise(rows, begin, keys, nll, bounds, rounds)
    return found.select(*keys, F.col("x")[0].alias("xi0"), (F.col("x")[1] if logistic else F.lit(None).cast("double")).alias("xi1"))


def lambdas_from_covariates(df: DataFrame, params: DataFrame, keys: list[str], yearly: str = "yearly") -> DataFrame:
    """Add `lambda` to the rows, by the keys' parameters; those without xi1 are constant."""
    lam = F.expr(f"CASE WHEN __xi1 IS NULL THEN __xi0 ELSE 2D / (1D + __xi0 * exp(__xi1 * `{yearly}`)) END")
    joined = df.join(params.select(*keys, F.col("xi0").alias("__xi0"), F.col("xi1").alias("__xi1")), keys)
    return joined.withColumn("lambda", lam).select(*df.columns, "lambda")
