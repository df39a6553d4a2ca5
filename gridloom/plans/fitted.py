"""Queries of the iterative fits, distributions, sources and streams; those of SQL's reach have their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..operators import conditional as C
from ..operators import covariance as K
from ..operators import ensemble as E
from ..operators import fits as M
from ..operators import generate as G
from ..operators import geodesic as J
from ..operators import harmonic as H
from ..sources import members, params
from ..streaming import scoring
from . import views as V
from .registry import NOISE, TWO, global_means, harmonic_rows, query, rounded, with_predictor

NORMAL = C.DistSpec("norm", {"loc": "c0 + c1 * p", "scale": "exp(c2)"}, ("c0", "c1", "c2"))
GUMBEL = C.DistSpec("gumbel_r", {"loc": "c0 + c1 * p", "scale": "c2"}, ("c0", "c1", "c2"))
FIT = f"SELECT cell_id, regr_intercept(value, p) AS c0, regr_slope(value, p) AS c1, CAST(4 AS DOUBLE) AS c2 FROM ({TWO}) GROUP BY 1"


def coefficients(s, d, scale: float = 4.0):
    """Location by least squares, a fixed scale: (cell_id, c0, c1, c2)."""
    fit = M.linreg_fit(with_predictor(s, d), ["cell_id"], ["p"], "value")
    return fit.select("cell_id", F.col("intercept").alias("c0"), F.col("b_p").alias("c1"), F.lit(scale).alias("c2"))


def phi(z: str) -> str:
    """The standard normal distribution function in DuckDB's SQL: 1/2 + density * sum of z^(2k+1) / (2k+1)!!."""
    terms = f"list_sum([exp(2 * k * ln(greatest(abs({z}), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()) - 0.5 * {z} * {z}) for k in range(150)])"
    return f"CASE WHEN abs({z}) > 9 THEN ({z} > 0)::DOUBLE ELSE 0.5 + {z} * {terms} / sqrt(2 * pi()) END"


def distances(s, d):
    return J.geodist(V.cells(s, d))


F84 = "(1 / 298.257223563)"


# Vincenty's iteration; rounded to metres.
@query(f"""SELECT * FROM (WITH RECURSIVE pr AS MATERIALIZED (SELECT a.cell_id AS i, b.cell_id AS j, atan((1 - {F84}) * tan(radians(a.lat))) AS u, atan((1 - {F84}) * tan(radians(b.lat))) AS v,
radians((b.lon - a.lon + 540) % 360 - 180) AS l FROM cell a, cell b WHERE a.cell_id <> b.cell_id),
it AS (SELECT i, j, 0 AS n, l AS lam, CAST(0 AS DOUBLE) AS km FROM pr UNION ALL
SELECT i, j, n + 1, l + (1 - c) * {F84} * sa * (sig + c * ss * (m + c * cs * (2 * m * m - 1))), 6356.752314245179 * big * (sig - small * ss * (m + small / 4 * (cs * (2 * m * m - 1) - small / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))) FROM (
SELECT *, 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))) AS big, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS small, {F84} / 16 * q * (4 + {F84} * (4 - 3 * q)) AS c FROM (
SELECT *, q * (pow(6378.137 / 6356.752314245179, 2) - 1) AS w, CASE WHEN q < 1e-15 THEN 0 ELSE cs - 2 * sin(u) * sin(v) / q END AS m FROM (
SELECT *, atan2(ss, cs) AS sig, cos(u) * cos(v) * sin(lam) / ss AS sa, 1 - pow(cos(u) * cos(v) * sin(lam) / ss, 2) AS q FROM (
SELECT it.i, it.j, n, u, v, l, lam, sqrt(pow(cos(v) * sin(lam), 2) + pow(cos(u) * sin(v) - sin(u) * cos(v) * cos(lam), 2)) AS ss, sin(u) * sin(v) + cos(u) * cos(v) * cos(lam) AS cs
FROM it JOIN pr ON it.i = pr.i AND it.j = pr.j WHERE n < 60)))))
SELECT i AS cell_i, j AS cell_j, round(km, 3) AS km FROM it WHERE n = 60 UNION ALL SELECT cell_id, cell_id, 0.0 FROM cell)""")
def geodist(s, d):
    return rounded(distances(s, d), 3)


# Distributions


@query("""SELECT user_id, ts, event_type, round(1 / (1 + exp(-z)), 6) AS logistic, round(exp(-exp(-z)), 6) AS gumbel_r,
round(CASE WHEN z < 0 THEN 0.5 * exp(z) ELSE 1 - 0.5 * exp(-z) END, 6) AS laplace, round(CASE WHEN z >= 0 THEN 1 - exp(-z) ELSE 0 END, 6) AS expon,
round(CASE WHEN z > 0 THEN 1 - exp(-pow(z, 1.5)) ELSE 0 END, 6) AS weibull_min, round(CASE WHEN 0.2 * z < 1 THEN exp(-pow(1 - 0.2 * z, 5)) ELSE 1 END, 6) AS genextreme
FROM (SELECT *, (value - 20) / 15 AS z FROM events)""")
def distribution_cdf(s, d):
    x, loc, scale = F.col("value"), F.lit(20.0), F.lit(15.0)
    shapes = {"weibull_min": [F.lit(1.5)], "genextreme": [F.lit(0.2)]}
    names = ("logistic", "gumbel_r", "laplace", "expon", "weibull_min", "genextreme")
    return rounded(s.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_type", *[D.DISTRIBUTIONS[n][1](x, loc, scale, *shapes.get(n, [])).alias(n) for n in names]))


@query("""SELECT user_id, ts, event_type, round(ln(p / (1 - p)), 6) AS logistic, round(-ln(-ln(p)), 6) AS gumbel_r, round(CASE WHEN p < 0.5 THEN ln(2 * p) ELSE -ln(2 * (1 - p)) END, 6) AS laplace,
round(-ln(1 - p), 6) AS expon, round(pow(-ln(1 - p), 1 / 1.5), 6) AS weibull_min, round((1 - pow(-ln(p), 0.2)) / 0.2, 6) AS genextreme FROM (SELECT *, 1 / (1 + exp(-(value - 20) / 15)) AS p FROM events)""")
def distribution_ppf(s, d):
    p, loc, scale = D.logistic_cdf(F.col("value"), F.lit(20.0), F.lit(15.0)), F.lit(0.0), F.lit(1.0)
    shapes = {"weibull_min": [F.lit(1.5)], "genextreme": [F.lit(0.2)]}
    names = ("logistic", "gumbel_r", "laplace", "expon", "weibull_min", "genextreme")
    return rounded(s.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_type", *[D.DISTRIBUTIONS[n][2](p, loc, scale, *shapes.get(n, [])).alias(n) for n in names]))


@query(f"SELECT scenario, member, year, cell_id, round(c0 + c1 * p, 6) AS loc, round(c2, 6) AS scale FROM ({TWO}) JOIN ({FIT}) USING (cell_id)")
def evaluate_params(s, d):
    rows = C.evaluate_params(with_predictor(s, d), coefficients(s, d), GUMBEL, ["cell_id"])
    return rounded(rows.select("scenario", "member", "year", "cell_id", "loc", "scale"))


@query(f"""SELECT cell_id, bool_and(a) AS coeffs_ok, bool_and(a) AND bool_and(b) AS params_ok, bool_and(a) AND bool_and(b) AS support_ok, bool_and(a) AND bool_and(b) AND bool_and(q) AS probability_ok, bool_and(a) AND bool_and(b) AND bool_and(q) AS valid
FROM (SELECT cell_id, c1 BETWEEN -5 AND 5 AS a, c0 + c1 * p BETWEEN 5 AND 25 AS b, least(r, 1 - r) >= 0.02 AS q FROM (SELECT *, exp(-exp(-(value - c0 - c1 * p) / c2)) AS r FROM ({TWO}) JOIN ({FIT}) USING (cell_id))) GROUP BY 1""")
def validate_coefficients(s, d):
    return C.validate_coefficients(with_predictor(s, d), coefficients(s, d), GUMBEL, ["cell_id"], bounds={"c1": (-5, 5)}, param_bounds={"loc": (5, 25)}, threshold=0.02)


# The normal distribution's maximum likelihood has a closed form: least squares, and the logarithm of the residuals' spread.
@query(f"""SELECT cell_id, round(c0, 4) AS c0, round(c1, 4) AS c1, round(c2, 4) AS c2, round(n * (c2 + 0.5 * ln(2 * pi()) + 0.5), 4) AS score FROM (SELECT cell_id, regr_intercept(value, p) AS c0, regr_slope(value, p) AS c1, count(*) AS n,
0.5 * ln((regr_syy(value, p) - pow(regr_sxy(value, p), 2) / regr_sxx(value, p)) / count(*)) AS c2 FROM ({TWO}) GROUP BY 1)""")
def conditional_fit(s, d):
    rows = params.cut_lineage(with_predictor(s, d), "rows")
    guess = C.first_guess(rows, coefficients(s, d, 0.0), NORMAL, ["cell_id"], ["scenario", "member", "year"], rounds=8, generations=0)
    return rounded(C.conditional_fit(rows, guess, NORMAL, ["cell_id"], rounds=16), 4)


EXPON = C.DistSpec("expon", {"loc": "a", "scale": "b"}, ("a", "b"))


# The likelihood of the exponential distribution has its maximum at a corner: the support begins at the least value.
@query("SELECT cell_id, round(min(value), 2) AS a, round(avg(value) - min(value), 2) AS b, round(count(*) * (ln(avg(value) - min(value)) + 1), 2) AS score FROM ens GROUP BY 1")
def conditional_fit_support_end(s, d):
    """From one guess for all cells, whose support holds no cell's values as a whole at first."""
    rows = params.cut_lineage(V.ensemble(s, d), "rows")
    guess = rows.select("cell_id", F.lit(15.0).alias("a"), F.lit(2.0).alias("b")).distinct()
    return rounded(C.conditional_fit(rows, guess, EXPON, ["cell_id"], rounds=4, generations=80), 2)


@query(f"""SELECT cell_id, round(regr_intercept(value, p), 2) AS c0, round(regr_slope(value, p), 2) AS c1, round(0.5 * ln((regr_syy(value, p) - pow(regr_sxy(value, p), 2) / regr_sxx(value, p)) / count(*)), 2) AS c2 FROM ({TWO}) GROUP BY 1""")
def first_guess(s, d):
    """All steps, from a start that is far off and the same for all cells; the last one ends near the closed form."""
    rows = params.cut_lineage(with_predictor(s, d), "rows")
    start = rows.select("cell_id", F.lit(50.0).alias("c0"), F.lit(-20.0).alias("c1"), F.lit(3.0).alias("c2")).distinct()
    return rounded(C.first_guess(rows, start, NORMAL, ["cell_id"], ["scenario", "member", "year"], rounds=16, generations=40).drop("score"), 2)


@query(f"""SELECT cell_id, round(sum(nll), 5) AS func_optim, round(sum(nll), 5) AS nll, round(3 * ln(count(*)) + 2 * sum(nll), 5) AS bic, round(sum(z * (2 * ({phi('z')}) - 1) + 2 * exp(-0.5 * z * z) / sqrt(2 * pi()) - 1 / sqrt(pi())), 5) AS crps
FROM (SELECT *, 0.5 * z * z + 0.5 * ln(2 * pi()) AS nll FROM (SELECT cell_id, value - c0 - c1 * p AS z FROM ({TWO}) JOIN ({FIT}) USING (cell_id))) GROUP BY 1""")
def quality_scores_crps(s, d):
    return rounded(C.quality_scores(with_predictor(s, d), coefficients(s, d, 0.0), NORMAL, ["cell_id"]), 5)


@query(f"""SELECT cell_id, round(sum(4 * (z - 2 * ln(1 / (1 + exp(-z))) - 1)), 5) AS crps, round(CASE WHEN min(1 / (1 + exp(abs(z)))) >= 0.1 THEN sum(z + 2 * ln(1 + exp(-z)) + ln(4)) ELSE CAST('inf' AS DOUBLE) END, 5) AS func_optim
FROM (SELECT cell_id, (value - c0 - c1 * p) / 4 AS z FROM ({TWO}) JOIN ({FIT}) USING (cell_id)) GROUP BY 1""")
def quality_scores_logistic(s, d):
    """The score by quadrature, and an optimised function that rejects improbable values."""
    spec = C.DistSpec("logistic", GUMBEL.params, GUMBEL.coefficients)
    return rounded(C.quality_scores(with_predictor(s, d), coefficients(s, d), spec, ["cell_id"], threshold=0.1, scores=("crps", "func_optim")), 5)


@query("""SELECT member, cell_id, round(my - c1 * m1 - c2 * m2, 5) AS intercept, round(c1, 5) AS coeff_1, round(c2, 5) AS coeff_2, round(w - c1 * u - c2 * v, 5) AS variance, nobs
FROM (SELECT *, (c * u - b * v) / (a * c - b * b) AS c1, (a * v - b * u) / (a * c - b * b) AS c2 FROM (SELECT member, cell_id, count(*) AS nobs, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS a, var_pop(x2) AS c,
covar_pop(x1, x2) AS b, covar_pop(y, x1) AS u, covar_pop(y, x2) AS v, var_pop(y) AS w FROM (SELECT member, cell_id, value AS y, lag(value, 1) OVER o AS x1, lag(value, 2) OVER o AS x2 FROM mon WINDOW o AS (PARTITION BY member, cell_id ORDER BY year, month))
WHERE x2 IS NOT NULL GROUP BY ALL))""")
def ar_fit_lags(s, d):
    series = V.monthly(s, d).withColumn("t", F.col("year") * 12 + F.col("month"))
    fit = M.ar_fit_lags(series, ["member", "cell_id"], [1, 2], "t")
    return rounded(fit.select("member", "cell_id", "intercept", F.col("coeffs")[0].alias("coeff_1"), F.col("coeffs")[1].alias("coeff_2"), "variance", "nobs"), 5)


# Power transforms


def cycle_residuals(s, d):
    rows = harmonic_rows(s, d)
    return H.harmonic_predict(rows, H.harmonic_fit(rows)).withColumn("value", F.col("value") - F.col("predicted")).drop("predicted")


def power_params(s, d):
    return C.yeo_johnson_fit(params.cut_lineage(cycle_residuals(s, d), "residuals"), ["cell_id", "month"], rounds=16)


@query()
def yeo_johnson_fit(s, d):
    return power_params(s, d)


@query("SELECT member, year, cell_id, month, round(2 / (1 + 0.8 * exp(0.05 * month * y)), 6) AS lambda FROM whole JOIN (SELECT member, year, cell_id, avg(value) AS y FROM whole GROUP BY ALL) USING (member, year, cell_id)")
def lambdas_from_covariates(s, d):
    rows = harmonic_rows(s, d)
    given = rows.select("cell_id", "month", F.lit(0.8).alias("xi0"), (0.05 * F.col("month")).alias("xi1")).distinct()
    return rounded(C.lambdas_from_covariates(rows, given, ["cell_id", "month"]).select("member", "year", "cell_id", "month", "lambda"))


# Covariances and generation


def numbered(df, keys, sample):
    """Anomaly rows of the complete samples: sample_id from 0 in each key."""
    whole = df.groupBy(*keys, *sample).agg(F.count("value").alias("n")).filter(F.col("n") == df.select("cell_id").distinct().count()).drop("n")
    ids = whole.withColumn("sample_id", F.row_number().over(Window.partitionBy(*keys).orderBy(*sample)).cast("long") - 1)
    means = F.avg("value").over(Window.partitionBy(*keys, "cell_id"))
    return df.join(ids, [*keys, *sample]).withColumn("value", F.col("value") - means).withColumn("weight", F.lit(1.0))


def regional(s, d):
    """Monthly samples of the regions, as cells at their first nations' places."""
    km = distances(s, d).filter("cell_i < 5 AND cell_j < 5")
    return V.monthly(s, d), km


@query()
def localized_covariance(s, d):
    rows, km = regional(s, d)
    rows = params.cut_lineage(numbered(rows.withColumn("one", F.lit(1)), ["one"], ["member", "year", "month"]), "samples")
    return rounded(K.localized_covariance(rows, km, [1000.0, 2000.0, 4000.0, 6000.0, 8000.0], 5))


@query()
def localized_covariance_monthly(s, d):
    rows, km = regional(s, d)
    rows = params.cut_lineage(numbered(rows, ["month"], ["member", "year"]), "samples")
    return rounded(K.localized_covariance(rows, km, [1000.0, 2000.0, 4000.0, 6000.0, 8000.0], 4, ["month"]))


@query()
def correlate_noise(s, d):
    rows, km = regional(s, d)
    cov = K.localized_covariance(params.cut_lineage(numbered(rows.withColumn("one", F.lit(1)), ["one"], ["member", "year", "month"]), "samples"), km, [2000.0, 4000.0, 8000.0], 5)
    factor = K.covariance_factor(cov.select("cell_i", "cell_j", F.col("localized").alias("cov")))
    keys = rows.select(F.lit("m").alias("scenario"), F.col("member").alias("realisation"), (F.col("year") * 12 + F.col("month")).alias("t"), "cell_id").distinct()
    return rounded(G.correlate_noise(G.noise_table(keys, "7"), factor))


def lowess_round(k: int) -> str:
    """The CTE s<k>: the fit with the robust weights of b<k>; nb holds each week's neighbours."""
    return f"""s{k} AS MATERIALIZED (SELECT week, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS smooth FROM (SELECT week, sum(w) AS s0, sum(w * c) AS s1, sum(w * c * c) AS s2, sum(w * y) AS t0, sum(w * c * y) AS t1
FROM (SELECT week, c, y, w * b AS w FROM nb JOIN b{k} USING (x)) GROUP BY 1)), b{k + 1} AS MATERIALIZED (SELECT week AS x, CASE WHEN s > 0 THEN pow(1 - pow(least(g / s, 1), 2), 2) ELSE 1 END AS b
FROM (SELECT week, g, 6 * median(g) OVER () AS s FROM (SELECT week, abs(value - smooth) AS g FROM wk JOIN s{k} USING (week))))"""


@query(f""", nb AS MATERIALIZED (SELECT week, x, c, y, CASE WHEN d < h THEN pow(1 - pow(d / h, 3), 3) ELSE 0 END AS w FROM (SELECT *, max(d) OVER (PARTITION BY week) AS h FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY d, x) AS r FROM (
SELECT a.week, b.week AS x, CAST(b.week - a.week AS DOUBLE) AS c, abs(CAST(b.week - a.week AS DOUBLE)) AS d, b.value AS y FROM wk a, wk b)) WHERE r <= 50)), b0 AS (SELECT week AS x, CAST(1 AS DOUBLE) AS b FROM wk), {", ".join(map(lowess_round, range(3)))}
SELECT CAST(week AS DOUBLE) AS week, round(smooth, 5) AS smooth FROM s2""")
def lowess_robust(s, d):
    return rounded(M.lowess(V.weekly(s, d).withColumn("all", F.lit(0)), ["all"], "week", "value", 50, rounds=2).drop("all"), 5)


@query()
def emulate_monthly(s, d):
    rows = params.cut_lineage(harmonic_rows(s, d), "monthly")
    mon = rows.select("member", "cell_id", "year", "month", "value")
    keys = mon.select(F.lit("m").alias("scenario"), "cell_id").distinct().withColumn("realisation", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    keys = keys.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(35))))
    fit = params.cut_lineage(H.harmonic_fit(rows), "harmonics")
    residual = H.harmonic_predict(rows, fit).withColumn("value", F.col("value") - F.col("predicted")).drop("predicted")
    local = G.ar_recursion_monthly(G.noise_table(keys, "7"), M.ar_fit_monthly(residual, ["member", "cell_id"]), ["scenario", "realisation", "cell_id"], buffer=1)
    yearly = rows.groupBy(F.lit("m").alias("scenario"), "year", "cell_id").agg(F.avg("yearly").alias("yearly"))
    power = C.yeo_johnson_fit(params.cut_lineage(residual, "residuals"), ["cell_id", "month"], rounds=8)
    return rounded(G.emulate_monthly(yearly, fit, power, local, 1995))


@query(f"""SELECT nz.scenario, realisation, em.year, nz.cell_id, round(c0 + c1 * em.value - c2 * ln(-ln(greatest(1e-9, least(1 - 1e-9, {phi('noise')})))), 5) AS value
FROM ({NOISE}) nz JOIN em ON em.scenario = nz.scenario AND em.year = nz.t + 1992 JOIN ({FIT}) f ON f.cell_id = nz.cell_id""")
def emulate_extremes(s, d):
    em = E.ens_mean(global_means(s, d)).withColumnRenamed("value", "p")
    keys = V.ensemble(s, d).select("scenario", "cell_id").distinct().withColumn("realisation", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    keys = keys.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(7))))
    drawn = G.noise_table(keys, "7").withColumnRenamed("noise", "x")
    return rounded(G.emulate_extremes(em, coefficients(s, d), GUMBEL, drawn, 1992), 5)


@query("SELECT scenario, cell_id, round(regr_intercept(value, year - 1990), 5) AS intercept, round(regr_slope(value, year - 1990), 5) AS b_years FROM ens GROUP BY 1, 2")
def scenario_trends(s, d):
    rows = params.cut_lineage(V.ensemble(s, d).select("scenario", "cell_id", (F.col("year") - 1990).cast("double").alias("years"), "value"), "ensemble")
    return rounded(E.map_scenarios(rows, M.linreg_fit, ["cell_id"], predictors=["years"], target="value"), 5)


# Sources and streams


@query(f"SELECT cell_id, round(c0, 6) AS intercept, round(c1, 6) AS b_p, 'linreg' AS module, 'm' AS model, 'all' AS scenario FROM ({FIT})")
def write_read_params(s, d):
    root = params.shared_path(s, "params")
    params.write_params(M.linreg_fit(with_predictor(s, d), ["cell_id"], ["p"], "value"), root, "linreg", "m")
    return rounded(params.read_params(s, root, "linreg", "cell_id", "intercept", "b_p", model="m"))


@query("SELECT variable, scenario, member, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT 'tas' AS variable, scenario, member, value FROM ens WHERE member = 'r1') GROUP BY ALL")
def read_members(s, d):
    root = params.shared_path(s, "members")
    rows = params.cut_lineage(V.ensemble(s, d), "ensemble")
    for part in rows.select("scenario", "member").distinct().collect():  # a row for each file that is written
        name = f"tas_ann_model_{part.scenario.replace('_', '-')}_{part.member}_g025.parquet"
        rows.filter((F.col("scenario") == part.scenario) & (F.col("member") == part.member)).select("year", "cell_id", "value").write.parquet(f"{root}/{name}")
    found = members.read_members(s, root, variable="tas", member="r1").withColumn("scenario", F.regexp_replace("scenario", "-", "_"))
    return rounded(found.groupBy("variable", "scenario", "member").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("""SELECT CAST(y AS BIGINT) AS year, round(coalesce(total, 0) / 12, 5) AS aod FROM range(1850, 2023) g(y) LEFT JOIN (SELECT 1850 + (r - 1) // 12 AS y, sum(v) AS total
FROM (SELECT round(avg(l_quantity), 4) AS v, row_number() OVER (ORDER BY date_trunc('month', l_shipdate)) AS r FROM lineitem GROUP BY date_trunc('month', l_shipdate)) GROUP BY 1) USING (y)""")
def read_aerosol_series(s, d):
    path = params.shared_path(s, "aerosol")
    lines = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.date_trunc("month", "l_shipdate").alias("month")).agg(F.round(F.avg("l_quantity"), 4).alias("v"))
    text = lines.select("month", F.concat_ws("  ", F.lit(""), F.date_format("month", "yyyy.MM"), "v", F.lit(0)).alias("line"))
    head = F.array(F.lit("optical depth"), F.lit("monthly"), F.lit("  year/month  global  other"))
    whole = text.agg(F.concat_ws("\n", head, F.transform(F.array_sort(F.collect_list(F.struct("month", "line"))), lambda x: x["line"])).alias("value"))
    whole.coalesce(1).write.text(path)
    return rounded(members.read_aerosol_series(s, path), 5)


@query(f"SELECT scenario, member, year, cell_id, round(value - c0 - c1 * p, 6) AS residual FROM ({TWO}) JOIN ({FIT}) USING (cell_id)")
def score_stream(s, d):
    arrived, out, state = (params.shared_path(s, x) for x in ("arrived", "scored", "scored-state"))
    rows = with_predictor(s, d)
    rows.select("scenario", "member", "year", "cell_id", "value", "p").write.parquet(arrived)
    arriving = scoring.read_rows(s, arrived, s.read.parquet(arrived).schema)
    fit = params.cut_lineage(M.linreg_fit(rows, ["cell_id"], ["p"], "value"), "params")
    scored = rounded(scoring.score_stream(arriving, fit, ["cell_id"], ["p"], "value").select("scenario", "member", "year", "cell_id", "residual"))
    scoring.write_rows(scored, out, state).awaitTermination()
    return s.read.schema(scored.schema).parquet(out)


@query("""SELECT window_start, event_type, round(avg(value), 6) AS mean, count(value) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, value FROM events)
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""")
def windowed_means_stream(s, d):
    """The events arrive in parts by time; the stream reads each part as a batch and goes on from its checkpoint."""
    staged, arrived, out, state = (params.shared_path(s, x) for x in ("staged", "arrived", "means", "means-state"))
    events = s.read.parquet(f"{d}/events.parquet").select("ts", "event_type", "value")
    for _ in scoring.arrivals(events, "ts", staged, arrived, 4):
        arriving = scoring.read_rows(s, arrived, events.schema, None).withColumn("ts", F.col("ts").cast("timestamp"))
        means = rounded(scoring.windowed_means(arriving, ["event_type"], "ts", "value", "1 hour", "2 hours")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
        scoring.write_rows(means, out, state).awaitTermination()
    return s.read.schema(means.schema).parquet(out)
