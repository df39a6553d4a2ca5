"""Iterative fits, covariances, distances, sources and streams: golden numbers, closed forms, and DuckDB."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import SF, duck, same  # noqa: F401

from gridloom.functions import distributions as D
from gridloom.operators import conditional as C
from gridloom.operators import covariance as K
from gridloom.operators import ensemble as E
from gridloom.operators import fits as M
from gridloom.operators import generate as G
from gridloom.operators import geodesic as J
from gridloom.plans.registry import ORACLES, QUERIES
from gridloom.sources import members, params

ONE = ["cell_id"]
NORMAL = C.DistSpec("norm", {"loc": "c1 * tas", "scale": "c2"}, ("c1", "c2"))


@pytest.mark.parametrize("name", ["distribution_cdf", "distribution_ppf", "evaluate_params", "ar_fit_lags", "validate_coefficients", "lambdas_from_covariates", "geodist", "quality_scores_logistic", "lowess_robust", "emulate_extremes", "scenario_trends", "probability_transform", "write_read_params", "read_members", "read_aerosol_series", "score_stream", "windowed_means_stream"])
def test_query(spark, duck, name):  # noqa: F811
    same(spark, duck, name, SF)


def test_geodist(spark):
    cells = spark.createDataFrame([(0, 0.0, -180.0), (1, 0.0, 0.0), (2, 5.0, 3.0), (3, None, 3.0)], "cell_id int, lat double, lon double")
    km = {(r.cell_i, r.cell_j): r.km for r in J.geodist(cells).collect()}
    assert [km[0, 1], km[0, 2], km[1, 2]] == pytest.approx([20003.93145863, 19366.51816487, 645.70051988], abs=1e-7)
    assert all(km[i, j] == km[j, i] for i in range(3) for j in range(3)) and km[0, 0] == 0 and len(km) == 16
    assert km[0, 3] is None and km[3, 3] is None
    quarter = J.geodesic_km(*(np.array([x]) for x in (0.0, 7.0, 90.0, 0.0)))[0]
    assert quarter == pytest.approx(20003.93145863 / 2, abs=1e-7)
    assert J.geodist(cells.filter("false")).count() == 0


ENDS = {"norm": (-math.inf, math.inf), "gumbel_r": (-math.inf, math.inf), "logistic": (-math.inf, math.inf), "laplace": (-math.inf, math.inf), "expon": (2.0, math.inf), "weibull_min": (2.0, math.inf)}


@pytest.mark.parametrize("name, shape, ends", [*[(n, [1.5] if n == "weibull_min" else [], e) for n, e in ENDS.items()], ("genextreme", [0.2], (-math.inf, 9.5)), ("genextreme", [-0.2], (-5.5, math.inf)), ("genextreme", [0.0], (-math.inf, math.inf))])
def test_quantiles_at_the_ends(spark, name, shape, ends):
    """Quantiles of 0 and 1 are the ends of the support, of null null; loc 2, scale 1.5."""
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, None)], "i int, p double")
    q = D.DISTRIBUTIONS[name][2](F.col("p"), F.lit(2.0), F.lit(1.5), *map(F.lit, shape))
    assert [r.q for r in df.select("i", q.alias("q")).orderBy("i").collect()] == [*map(pytest.approx, ends), None]


def test_distribution_ppf_of_large_values(spark, tmp_path):
    """Values so far out that their probability is 1, or 0, in doubles."""
    c = duckdb.connect()
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01', 'view', CAST({v} AS DOUBLE))" for i, v in enumerate([0.0, 20.0, 500.0, 600.0, 1e5, -700.0, -1e5, "NULL"]))
    c.execute(f"create view events as from (values {rows}) t(user_id, ts, event_type, value)")
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = {r.user_id: [r[n] for n in ("logistic", "gumbel_r", "laplace", "expon", "weibull_min", "genextreme")] for r in QUERIES["distribution_ppf"](spark, str(tmp_path)).collect()}
    other = {r[0]: list(r[3:]) for r in c.execute(ORACLES["distribution_ppf"]).fetchall()}
    assert found.keys() == other.keys() and found[7] == other[7] == [None] * 6
    for i in range(7):
        assert found[i] == pytest.approx(other[i], abs=1e-5)


def test_distribution_ppf_at_ties(spark, tmp_path):
    """Values of seven decimals, whose logistic quantile lies halfway between two roundings."""
    c = duckdb.connect()
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01', 'view', CAST({v} AS DOUBLE))" for i, v in enumerate([0.5001125, 0.5005175, 0.5046875, 0.5100725, 0.5142425]))
    c.execute(f"create view events as from (values {rows}) t(user_id, ts, event_type, value)")
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = {r.user_id: r.logistic for r in QUERIES["distribution_ppf"](spark, str(tmp_path)).collect()}
    assert found == {r[0]: r[3] for r in c.execute(ORACLES["distribution_ppf"]).fetchall()}


def far_apart(spark, n):
    return spark.createDataFrame([(i, j, 0.0 if i == j else 1e6) for i in range(n) for j in range(n)], "cell_i long, cell_j long, km double")


def test_localized_covariance(spark):
    x = np.random.RandomState(0).rand(5, 3)
    rows = lambda w: spark.createDataFrame([(i, j, float(x[i, j]), float(w[i])) for i in range(5) for j in range(3)], "sample_id long, cell_id long, value double, weight double")
    far, w = far_apart(spark, 3), [0.5, 0.5, 0.5, 1.0, 1.0]
    for folds, expected in ((2, 204.5516663), (3, 183.3229446), (5, 133.975629)):
        assert K.radius_scores(rows([1.0] * 5), far, [1.0], folds).first().score == pytest.approx(expected)
    assert K.radius_scores(rows(w), far, [1.0], 2).first().score == pytest.approx(187.682058)
    found = K.localized_covariance(rows(w), far, [1.0, 2.0], 2).orderBy("cell_i", "cell_j").collect()
    assert [r.cov for r in found] == pytest.approx(np.cov(x, rowvar=False, aweights=w).ravel())
    assert [r.localized for r in found] == pytest.approx(np.diag(np.diag(np.cov(x, rowvar=False, aweights=w))).ravel())
    twice = rows(w).withColumn("month", F.lit(1)).union(rows([1.0] * 5).withColumn("month", F.lit(2)))
    by_month = K.localized_covariance(twice, far, [1.0], 2, ["month"]).filter("month = 2").orderBy("cell_i", "cell_j").collect()
    assert [r.cov for r in by_month] == pytest.approx(np.cov(x, rowvar=False).ravel())


@pytest.mark.parametrize("m", [[[4.0, 1.0], [1.0, 3.0]], [[1.0, 2.0], [2.0, 1.0]]])
def test_covariance_factor(spark, m):
    cov = spark.createDataFrame([(i, j, m[i][j]) for i in range(2) for j in range(2)], "cell_i long, cell_j long, cov double")
    root = np.zeros((2, 2))
    for r in K.covariance_factor(cov).collect():
        root[r.cell_i, r.cell_j] = r.value
    values, vectors = np.linalg.eigh(np.array(m))
    assert root @ root.T == pytest.approx(vectors * np.maximum(values, 0) @ vectors.T)
    noise = spark.createDataFrame([("s", 0, 1, 0, 1.0), ("s", 0, 1, 1, -2.0)], "scenario string, realisation int, t int, cell_id long, noise double")
    coloured = G.correlate_noise(noise, K.covariance_factor(cov)).orderBy("cell_id").collect()
    assert [r.noise for r in coloured] == pytest.approx(root @ np.array([1.0, -2.0]))


def test_conditional_fit(spark):
    tas = np.arange(1, 252.0)
    y = np.random.default_rng(0).normal(2 * tas, 0.1)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(tas, y))], "cell_id int, t int, tas double, value double")
    known = spark.createDataFrame([(1, 2.0, 0.1)], "cell_id int, c1 double, c2 double")
    scores = C.quality_scores(df, known, NORMAL, ONE).first()
    assert (scores.nll, scores.bic, scores.crps) == pytest.approx((-217.9307, -424.8105, 14.418), abs=1e-3)
    guess = C.first_guess(df, spark.createDataFrame([(1, 1.0, 1.0)], "cell_id int, c1 double, c2 double"), NORMAL, ONE, ["t"], rounds=10)
    fit = C.conditional_fit(df, guess, NORMAL, ONE).first()
    slope = (tas * y).sum() / (tas * tas).sum()
    assert fit.c1 == pytest.approx(slope, abs=1e-5) and fit.c2 == pytest.approx(math.sqrt(np.mean((y - slope * tas) ** 2)), abs=1e-4)
    ok = C.validate_coefficients(df, known, NORMAL, ONE, bounds={"c2": (0.5, 1)}).first()
    assert not ok.coeffs_ok and not ok.valid
    narrow = C.conditional_fit(df, known, NORMAL, ONE, bounds={"c2": (0.2, 1.0)}, rounds=6).first()
    assert narrow.c2 == pytest.approx(0.2)
    with pytest.raises(ValueError, match="no parameter"):
        C.DistSpec("norm", {"loc": "c1", "scale": "1"}, ("c1", "c2"))


def test_fit_policies(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1.0, 2.0, 4.0)], "cell_id int, value double")
    expon = C.DistSpec("expon", {"loc": "a", "scale": "b"}, ("a", "b"))
    guess = spark.createDataFrame([(1, 50.0, 1.0)], "cell_id int, a double, b double")
    with pytest.raises(ValueError, match="fit failed"):
        C.conditional_fit(df, guess, expon, ONE, rounds=2)
    kept = C.conditional_fit(df, guess, expon, ONE, rounds=2, on_failed_fit="ignore").first()
    assert (kept.a, kept.b, kept.score) == (50.0, 1.0, math.inf)
    # The wider first steps reach the support; at its end, a corner of the likelihood, the search goes on slowly.
    found = C.conditional_fit(df, guess, expon, ONE, rounds=60, starts_by=(1.0, 10.0)).first()
    assert found.score == pytest.approx(3 * math.log(4 / 3) + 3, abs=0.05) and found.a == pytest.approx(1.0, abs=0.05)
    with pytest.raises(ValueError, match="on_failed_fit"):
        C.conditional_fit(df, guess, expon, ONE, on_failed_fit="warn")


@pytest.mark.parametrize("name, shape", [("gumbel_r", ()), ("logistic", ()), ("laplace", ()), ("expon", ()), ("weibull_min", (1.5,)), ("genextreme", (0.2,)), ("genextreme", (-0.2,))])
def test_crps(spark, name, shape):
    """The integral of (F(y) - [y >= x])^2, by a fine sum over y."""
    y = spark.range(1_200_001).select((F.col("id") * 1e-3 - 200).alias("y"))
    at = D.DISTRIBUTIONS[name][1](F.col("y"), F.lit(2.0), F.lit(1.5), *map(F.lit, shape))
    for x in (-1.0, 2.3, 6.0):
        slow = y.agg((F.sum((at - F.when(F.col("y") >= x, 1.0).otherwise(0.0)) ** 2) * 1e-3).alias("s")).first().s
        fast = spark.range(1).select(D.crps(name, F.lit(x), F.lit(2.0), F.lit(1.5), *map(F.lit, shape))).first()[0]
        assert fast == pytest.approx(slow, abs=2e-3)


def test_yeo_johnson_fit(spark):
    rng = np.random.default_rng(1)
    x, t = rng.gamma(2, 1, 400) - 2, rng.normal(0, 1, 400)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, x)] + [(2, 0.0, 3.0), (1, None, 1.0), (1, 1.0, None)], "cell_id int, yearly double, value double")

    def nll(lam):
        base = 1 + np.abs(x)
        y = np.where(x >= 0, (base**lam - 1) / lam, -(base ** (2 - lam) - 1) / (2 - lam))
        return len(x) / 2 * np.log(y.var()) - np.sum((lam - 1) * np.sign(x) * np.log(base))

    found = {r.cell_id: r for r in C.yeo_johnson_fit(df, ONE, kind="constant", rounds=14).collect()}
    assert found[1].xi0 == pytest.approx(min(np.linspace(0.0005, 1.9995, 4000), key=nll), abs=1e-3)
    assert found[2].xi0 == 1.0 and found[2].xi1 is None
    both = C.yeo_johnson_fit(df.filter("cell_id = 1"), ONE, rounds=14).first()
    at = lambda a, b: nll(2 / (1 + a * np.exp(b * t)))
    assert at(both.xi0, both.xi1) <= min(at(a, b) for a in np.linspace(0.5, 8, 60) for b in np.linspace(-0.1, 0.1, 21)) + 1e-6
    assert C.yeo_johnson_fit(df.filter("false"), ONE, rounds=1).count() == 0


def test_distributions_invert(spark):
    df = spark.createDataFrame([(p,) for p in (0.001, 0.2, 0.5, 0.9, 0.999)], "p double")
    args = {n: [F.lit(1.5), F.lit(2.0)] + [F.lit(s) for s in shapes] for n, shapes in {"norm": [], "gumbel_r": [], "logistic": [], "laplace": [], "expon": [], "weibull_min": [1.3], "genextreme": [-0.2]}.items()}
    h = 1e-5
    for name, a in args.items():
        logpdf, cdf, ppf = D.DISTRIBUTIONS[name]
        rows = df.withColumn("x", ppf(F.col("p"), *a))
        rows = rows.select("p", cdf(F.col("x"), *a).alias("q"), F.exp(logpdf(F.col("x"), *a)).alias("f"), ((cdf(F.col("x") + h, *a) - cdf(F.col("x") - h, *a)) / (2 * h)).alias("g"), D.in_support(name, F.col("x"), *a).alias("inside"))
        for r in rows.collect():
            assert r.q == pytest.approx(r.p, abs=1e-9) and r.f == pytest.approx(r.g, rel=1e-4) and r.inside, name


def test_probability_integral_transform(spark):
    df = spark.createDataFrame([(3.0, 1.0, 2.0), (-1.0, 1.0, 0.5), (1e9, 0.0, 1.0)], "value double, a double, b double")
    source, target = C.DistSpec("norm", {"loc": "a", "scale": "b"}, ("a", "b")), C.DistSpec("norm", {"loc": "0", "scale": "1"}, ())
    got = [r.transformed for r in C.probability_integral_transform(df, source, target).collect()]
    assert got == pytest.approx([1.0, -4.0, 5.99780702], abs=1e-6)
    with pytest.raises(ValueError):
        C.probability_integral_transform(df, source, target, threshold=0.5)


def test_lowess(spark):
    """Against a direct evaluation, with robust rounds, an outlier and a null."""
    rng = np.random.default_rng(2)
    x = np.arange(40.0)
    y = np.sin(x / 6) + rng.normal(0, 0.1, 40)
    y[17] += 5

    def once(delta):
        out = []
        for at in x:
            d = np.abs(x - at)
            near = np.lexsort((x, d))[:12]
            w = delta[near] * np.where(d[near] < d[near].max(), (1 - (d[near] / d[near].max()) ** 3) ** 3, 0)
            a = np.stack([np.ones(12), x[near] - at])
            out.append(np.linalg.solve(a * w @ a.T, a * w @ y[near])[0])
        return np.array(out)

    delta = np.ones(40)
    plain = once(delta)
    for _ in range(2):
        gap = np.abs(y - once(delta))
        delta = (1 - np.minimum(gap / (6 * np.median(gap)), 1) ** 2) ** 2
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)] + [(1, 3.0, None), (1, None, 1.0)], "k int, x double, y double")
    for rounds, expected in ((0, plain), (2, once(delta))):
        got = sorted((r.x, r.smooth) for r in M.lowess(df, ["k"], "x", "y", 12, rounds).collect())
        assert [s for _, s in got] == pytest.approx(list(expected))


def test_params_and_members(spark, tmp_path):
    root = f"file://{tmp_path}"
    params.write_params(spark.createDataFrame([(1, 2.0)], "cell_id int, b double"), root, "ar", "m1", "s")
    with pytest.raises(ValueError):
        params.read_params(spark, root, "ar", "missing")
    with pytest.raises(ValueError):
        params.write_params(spark.createDataFrame([("x",)], "model string"), root, "ar", "m1")
    assert params.read_params(spark, root, "ar", "b", model="m2").count() == 0
    with pytest.raises(ValueError):
        members.read_members(spark, root, colour="red")


def test_emulate_extremes(spark):
    """A normal draw of 0 is the median of the cell's distribution."""
    spec = C.DistSpec("gumbel_r", {"loc": "c0 + p", "scale": "2"}, ("c0",))
    local = spark.createDataFrame([("s", 0, 1, 7, 0.0)], "scenario string, realisation int, t int, cell_id int, x double")
    got = G.emulate_extremes(spark.createDataFrame([("s", 2001, 3.0)], "scenario string, year long, p double"), spark.createDataFrame([(7, 1.0)], "cell_id int, c0 double"), spec, local, 2000).first()
    assert (got.year, got.value) == (2001, pytest.approx(4 - 2 * math.log(math.log(2))))


def test_emulate_monthly(spark):
    """Without a cycle and with lambda 1 the draws are added to the yearly values."""
    yearly = spark.createDataFrame([("s", 2000, 7, 10.0), ("s", 2001, 7, 20.0)], "scenario string, year long, cell_id long, yearly double")
    cycle = spark.createDataFrame([(7, [0.0] * 4)], "cell_id long, coeffs array<double>")
    power = spark.createDataFrame([(7, m, 1.0, None) for m in range(1, 13)], "cell_id long, month long, xi0 double, xi1 double")
    local = spark.createDataFrame([("s", 0, t, 7, t / 10) for t in range(24)], "scenario string, realisation int, t int, cell_id long, x double")
    got = sorted((r.year, r.month, r.value) for r in G.emulate_monthly(yearly, cycle, power, local, 2000).collect())
    assert [v for _, _, v in got] == pytest.approx([10 * (1 + t // 12) + t / 10 for t in range(24)])


def test_emulate_monthly_restated(spark):
    """Cycles of two and one orders, lambdas of both kinds and draws of both signs, by a plain restatement."""
    rng = np.random.default_rng(4)
    coeffs = {7: rng.normal(0, 1, 8), 8: rng.normal(0, 1, 4)}
    xi = {(c, m): (float(rng.uniform(0.5, 3)), float(rng.uniform(-0.1, 0.1)) if m % 2 else None) for c in coeffs for m in range(1, 13)}
    xi = {k: (a if b is not None else min(a, 1.9), b) for k, (a, b) in xi.items()}
    year = {(c, y): float(rng.normal(10, 2)) for c in coeffs for y in (2000, 2001)}
    x = {(c, r, t): float(rng.normal(0, 0.4)) for c in coeffs for r in (0, 1) for t in range(24)}

    def value(c, r, t):
        y, m, total = year[c, 2000 + t // 12], t % 12 + 1, 0.0
        for k in range(len(coeffs[c]) // 4):
            a, b, d, e = coeffs[c][4 * k : 4 * k + 4]
            angle = 2 * math.pi * (k + 1) * (m - 1) / 12
            total += (a * y + b) * math.cos(angle) + (d * y + e) * math.sin(angle)
        xi0, xi1 = xi[c, m]
        lam, draw = xi0 if xi1 is None else 2 / (1 + xi0 * math.exp(xi1 * y)), x[c, r, t]
        back = (draw * lam + 1) ** (1 / lam) - 1 if draw >= 0 else 1 - (1 - (2 - lam) * draw) ** (1 / (2 - lam))
        return y + total + back

    yearly = spark.createDataFrame([("s", y, c, v) for (c, y), v in year.items()], "scenario string, year long, cell_id long, yearly double")
    cycle = spark.createDataFrame([(c, v.tolist()) for c, v in coeffs.items()], "cell_id long, coeffs array<double>")
    power = spark.createDataFrame([(*k, *v) for k, v in xi.items()], "cell_id long, month long, xi0 double, xi1 double")
    local = spark.createDataFrame([("s", r, t, c, v) for (c, r, t), v in x.items()] + [("s", 0, 24, 7, 0.0)], "scenario string, realisation int, t int, cell_id long, x double")
    got = {(r.cell_id, r.realisation, 12 * (r.year - 2000) + r.month - 1): r.value for r in G.emulate_monthly(yearly, cycle, power, local, 2000).collect()}
    assert got == {k: pytest.approx(value(*k), abs=1e-9) for k in x}  # the 25th month has no yearly value


def test_map_scenarios(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0)], "scenario string, value double")
    shift = lambda part, by, scale=1: part.agg((F.avg("value") * scale + by).alias("v"))
    assert {(r.scenario, r.v) for r in E.map_scenarios(df, shift, 1, scale=2).collect()} == {("a", 5.0), ("b", 11.0), (None, 15.0)}
    some = E.map_scenarios(df.dropna(), lambda part: part.withColumn("x", F.lit(1)) if part.count() > 1 else part)
    assert {tuple(r) for r in some.collect()} == {("a", 1.0, 1), ("a", 3.0, 1), ("b", 5.0, None)}
    assert [tuple(r) for r in E.map_scenarios(df, lambda part: part if part.count() > 1 else None).collect()] == [("a", 1.0), ("a", 3.0)]
    assert E.map_scenarios(df.filter("false"), lambda part: part).columns == ["scenario", "value"]
    with pytest.raises(ValueError):
        E.map_scenarios(df, lambda part: None)
    with pytest.raises(ValueError):
        E.map_scenarios(spark.range(201).selectExpr("id AS scenario"), lambda part: part)


def test_ar_fit_lags(spark):
    y = np.arange(30) + np.random.default_rng(0).normal(0, 1, 30)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)] + [(2, 0, 1.0), (2, 1, 2.0)], "k int, t int, value double")
    for lags, expected in (([1], (1.04728995, 0.99682459, 1.05381192, 29)), ([2], (2.08295035, 0.99318256, 1.18712735, 28))):
        r = M.ar_fit_lags(df, ["k"], lags, "t").filter("k = 1").first()
        assert (r.intercept, r.coeffs[0], r.variance, r.nobs) == pytest.approx(expected)
    x = np.stack([np.ones(27), y[2:-1], y[:-3]], axis=1)
    r = M.ar_fit_lags(df, ["k"], [1, 3], "t").first()
    assert [r.intercept, *r.coeffs] == pytest.approx(list(np.linalg.lstsq(x, y[3:], rcond=None)[0]))
    assert M.ar_fit_lags(df, ["k"], [1], "t").filter("k = 2").first().coeffs == [None]


def test_recursion_of_higher_order(spark):
    noise = spark.createDataFrame([(c, t, 0.0) for c in (0, 1, 2) for t in range(5)], "cell_id int, t int, noise double")
    params = spark.createDataFrame([(0, 1.0, 0.5), (1, None, None), (2, 0.0, 1.0)], "cell_id int, intercept double, coeff double")
    for buffer, expected in ((1, [0, 1, 1.5, 1.75]), (2, [1, 1.5, 1.75])):
        got = G.ar_recursion(noise, params, ["cell_id"], buffer).orderBy("cell_id", "t").collect()
        assert [r.x for r in got if r.cell_id == 0] == expected and [r.t for r in got if r.cell_id == 0] == list(range(5 - buffer))
        assert {r.x for r in got if r.cell_id == 1 and r.t + buffer >= 2} == {None}
    rng = np.random.default_rng(0)
    e = rng.normal(size=(2, 40))
    coeffs = spark.createDataFrame([(0, 0.3, [0.5, -0.2, 0.1, 0.05]), (1, -0.1, [0.1, 0.2, 0.3, -0.4])], "cell_id int, intercept double, coeffs array<double>")
    rows = spark.createDataFrame([(c, t, float(e[c, t])) for c in (0, 1) for t in range(40)], "cell_id int, t int, noise double")
    got = G.ar_recursion(rows, coeffs, ["cell_id"]).orderBy("cell_id", "t").collect()
    for c, (_, a, b) in enumerate([(0, 0.3, [0.5, -0.2, 0.1, 0.05]), (1, -0.1, [0.1, 0.2, 0.3, -0.4])]):
        x = [0.0] * 5
        for t in range(5, 40):
            x.append(a + sum(b[k] * x[t - 1 - k] for k in range(4)) + e[c, t])
        assert [r.x for r in got if r.cell_id == c] == pytest.approx(x)


def test_autoregression_of_any_order(spark):
    rng = np.random.default_rng(1)
    x = np.zeros((3, 400))
    for t in range(4, 400):
        x[:, t] = 2 + 0.3 * x[:, t - 1] + 0.2 * x[:, t - 2] - 0.3 * x[:, t - 4] + rng.normal(size=3)
    x[2] = 7.0
    rows = spark.createDataFrame([(c, t, 1e6 * (c == 1) + float(x[c, t])) for c in range(3) for t in range(400)] + [(9, 0, 1.0)], "cell_id int, year int, value double")
    fit = {r.cell_id: r for r in M.ar_fit_lags(rows, ["cell_id"], [1, 2, 3, 4]).collect()}
    for c in (0, 1):
        design = np.column_stack([np.ones(396), *[x[c, 4 - k : 400 - k] for k in range(1, 5)]])
        best = np.linalg.lstsq(design, x[c, 4:], rcond=None)[0]
        assert fit[c].coeffs == pytest.approx(best[1:], abs=1e-6) and fit[c].nobs == 396
    assert fit[2].coeffs == [None] * 4 and 9 not in fit
    orders = {r.cell_id: r.order for r in M.ar_order(rows, ["cell_id"], 8).collect()}
    assert orders[0] == orders[1] == 4 and 2 not in orders
    single = {r.cell_id: r for r in M.ar_fit(rows.filter("year < 2 OR cell_id = 9"), ["cell_id"]).collect()}
    assert all(r.coeff is None and r.nobs == 1 for r in single.values())
    mean = M.ar_fit_scen_ens_lags(rows.filter("cell_id < 1").withColumn("scenario", F.lit("a")).withColumn("member", F.lit("m")), [1, 2, 3, 4]).first()
    assert mean.coeffs == pytest.approx(fit[0].coeffs)


def test_guards_of_series(spark):
    rows = spark.createDataFrame([("a", "m", y, 1.0) for y in (1999, 2000, 2001)], "scenario string, member string, year long, value double")
    series = spark.createDataFrame([(1999, 0.5), (2000, 0.25)], "year long, aod double")
    with pytest.raises(ValueError):
        E.align_outer_fill(rows, series, "aod")
    filled = M.superimpose_volcanic(rows, spark.createDataFrame([(-2.0,)], "slope double"), series, ["scenario", "member"], period=(1999, 1999)).orderBy("year").collect()
    assert [r.value for r in filled] == [0.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        M.superimpose_volcanic(rows.filter("year <> 2000"), spark.createDataFrame([(-2.0,)], "slope double"), series, ["scenario", "member"], period=(1999, 2001))
    with pytest.warns(UserWarning):
        M.warn_volcanic(spark.createDataFrame([(2.0,)], "slope double"))
    with pytest.raises(Exception, match="latitudes"):
        spark.createDataFrame([(91.0,)], "lat double").select(E.lat_weights(F.col("lat"))).collect()
    params = spark.createDataFrame([(1, 0.0, 1.0, 2.0)], "cell_id int, intercept double, b_x double, b_z double")
    one = spark.createDataFrame([(1, 3.0)], "cell_id int, x double")
    with pytest.raises(ValueError):
        M.linreg_predict(one, params, ["cell_id"], ["x"])
    assert M.linreg_predict(one, params, ["cell_id"], ["x"], exclude={"z"}).first().predicted == 3.0
