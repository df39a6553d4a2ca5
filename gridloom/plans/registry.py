"""All queries of the library on the given tables, and their SQL. Values are rounded, so that sums in any order agree."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import conditional as C
from ..operators import ensemble as E
from ..operators import fits as M
from ..operators import generate as G
from ..operators import geodesic as J
from ..operators import grid as P
from ..operators import guards as Q
from ..operators import harmonic as H
from . import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = V.CTE + sql
        return f

    return add


def as_sql_rounds(x: Column, digits: int) -> Column:
    """Scaled in doubles, then halves away from zero, as DuckDB rounds; F.round goes by the decimal digits, which at a tie may end otherwise."""
    scale = 10.0**digits
    return F.when(F.abs(x) <= sys.float_info.max / scale, F.round(x * scale) / scale + 0.0).otherwise(x)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[as_sql_rounds(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def anomalies(s, d):
    return E.calc_anomaly(V.ensemble(s, d), 1995, 1996)


def global_means(s, d):
    return E.global_mean(anomalies(s, d))


# Projections and reshaping


@query("SELECT cell_id, (lon + 180) % 360 - 180 AS lon FROM cell ORDER BY lon")
def wrap_to_180(s, d):
    return V.cells(s, d).select("cell_id", S.wrap_to_180(F.col("lon")).alias("lon")).orderBy("lon")


@query("SELECT cell_id, (((lon - 180) % 360) + 360) % 360 AS lon FROM cell")
def wrap_to_360(s, d):
    return V.cells(s, d).select("cell_id", S.wrap_to_360(F.col("lon") - 180).alias("lon"))


INSIDE = "(SELECT count(*) % 2 = 1 FROM edges WHERE (y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / (y2 - y1) + x1)"


@query("SELECT scenario, member, year, e.cell_id, CASE WHEN i THEN round(value, 6) END AS value FROM ens e JOIN (SELECT cell_id, " + INSIDE.format(x="lon", y="lat") + " AS i FROM cell) USING (cell_id)")
def mask_ocean(s, d):
    return rounded(P.mask_ocean(V.ensemble(s, d), V.land(s)).select("scenario", "member", "year", "cell_id", "value"))


FRACTION = "SELECT cell_id, avg(CAST(i AS INT)) AS fraction FROM (SELECT cell_id, " + INSIDE.format(x="px", y="py") + " AS i FROM (SELECT cell_id, lon + ((j + 0.5) / 4 - 0.5) * 20 AS px, lat + ((k + 0.5) / 4 - 0.5) * 20 AS py FROM cell, range(4) a(j), range(4) b(k))) GROUP BY 1"


@query(f"SELECT scenario, member, year, cell_id, CASE WHEN fraction > 0.3 THEN round(value, 6) END AS value FROM ens JOIN ({FRACTION}) USING (cell_id)")
def mask_ocean_fraction(s, d):
    return rounded(P.mask_ocean_fraction(V.ensemble(s, d), V.land(s), 0.3, 20.0).select("scenario", "member", "year", "cell_id", "value"))


#: The edges of `V.ISLANDS` with each ring in one plane.
ISLANDS = "(150.0, -40.0, 210.0, -40.0), (210.0, -40.0, 220.0, 30.0), (220.0, 30.0, 160.0, 40.0), (160.0, 40.0, 150.0, -40.0), (170.0, -20.0, 190.0, -20.0), (190.0, -20.0, 185.0, 10.0), (185.0, 10.0, 170.0, -20.0), (-20.0, -10.0, 30.0, -10.0), (30.0, -10.0, 10.0, 40.0), (10.0, 40.0, -20.0, -10.0)"


# Whole rings, also a turn to either side.
@query(f"""SELECT cell_id, round(avg(CAST(i AS INT)), 6) AS fraction FROM (SELECT cell_id, (SELECT count(*) % 2 = 1 FROM (
SELECT x1 + t.turn AS x1, y1, x2 + t.turn AS x2, y2 FROM (VALUES {ISLANDS}) e(x1, y1, x2, y2), (VALUES (-360), (0), (360)) t(turn)) WHERE (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1) AS i
FROM (SELECT cell_id, (lon + ((j + 0.5) / 8 - 0.5) * 36 + 540) % 360 - 180 AS px, lat + ((k + 0.5) / 8 - 0.5) * 36 AS py FROM cell, range(8) a(j), range(8) b(k))) GROUP BY 1""")
def land_fraction_date_line(s, d):
    """Islands with a lake over the date line and over the zero meridian."""
    return rounded(P.land_fraction(V.cells(s, d), V.islands(s), 36.0, 8))


@query("SELECT scenario, member, year, cell_id, CASE WHEN lat >= -60 THEN round(value, 6) END AS value FROM ens")
def mask_antarctica(s, d):
    return rounded(P.mask_antarctica(V.ensemble(s, d)).select("scenario", "member", "year", "cell_id", "value"))


STACK = "SELECT scenario, member, year, lat, lon, gridcell, round(value, 6) AS value FROM ({0}) JOIN (SELECT lat, lon, row_number() OVER (ORDER BY lat, lon) - 1 AS gridcell FROM ({0}) GROUP BY lat, lon HAVING count(*) = count(value)) USING (lat, lon)"


@query(STACK.format("SELECT * REPLACE (CASE WHEN lat >= -60 THEN value END AS value) FROM ens"))
def stack_cells(s, d):
    return rounded(P.stack_cells(P.mask_antarctica(V.ensemble(s, d))).select("scenario", "member", "year", "lat", "lon", "gridcell", "value"))


@query(STACK.format(f"SELECT * REPLACE (CASE WHEN lat >= -60 AND fraction > 0.3 THEN value END AS value) FROM ens JOIN ({FRACTION}) USING (cell_id)"))
def mask_and_stack(s, d):
    masked = P.mask_antarctica(P.mask_ocean_fraction(V.ensemble(s, d), V.land(s), 0.3, 20.0))
    return rounded(P.stack_cells(masked).select("scenario", "member", "year", "lat", "lon", "gridcell", "value"))


@query("""SELECT lat, lon, year, round(value, 6) AS value FROM (SELECT a.lat, b.lon, y.year FROM (SELECT DISTINCT lat FROM cell) a, (SELECT DISTINCT lon FROM cell) b, (SELECT DISTINCT year FROM ens) y)
LEFT JOIN (SELECT lat, lon, year, avg(value) AS value FROM ens GROUP BY ALL) USING (lat, lon, year)""")
def unstack_cells(s, d):
    mean = V.ensemble(s, d).groupBy("lat", "lon", "year").agg(F.avg("value").alias("value"))
    return rounded(P.unstack_cells(mean, ["year"]))


@query("SELECT lat, lon, round(m, 6) AS value FROM cell LEFT JOIN (SELECT lat, lon, avg(value) AS m FROM ens WHERE lat >= -60 GROUP BY ALL) USING (lat, lon)")
def align_to_grid(s, d):
    kept = V.ensemble(s, d).filter("lat >= -60").groupBy("lat", "lon").agg(F.avg("value").alias("value"))
    return rounded(P.align_to_grid(kept, V.cells(s, d)))


@query("SELECT scenario, member, year, cell_id, round(value, 6) AS value FROM anom")
def calc_anomaly(s, d):
    return rounded(anomalies(s, d).select("scenario", "member", "year", "cell_id", "value"))


@query("SELECT scenario, member, year, cell_id, round(value - avg(CASE WHEN year BETWEEN 1995 AND 1996 THEN value END) OVER (PARTITION BY scenario, member, cell_id), 6) AS value FROM sp")
def anomaly_own_ref(s, d):
    spliced = E.splice_hist_scen(V.ensemble(s, d))
    return rounded(E.anomaly_own_ref(spliced, 1995, 1996).select("scenario", "member", "year", "cell_id", "value"))


@query("SELECT scenario, year, CAST(m AS INTEGER) AS month, round(value, 6) AS value FROM em, range(1, 13) t(m)")
def upsample_yearly(s, d):
    return rounded(P.upsample_yearly(E.ens_mean(global_means(s, d))).select("scenario", "year", "month", "value"))


@query("SELECT cell_id, member, year, round(avg(value), 6) AS value FROM whole GROUP BY ALL")
def resample_annual(s, d):
    return rounded(P.resample_annual(V.monthly(s, d, "year"), ["cell_id", "member"]))


@query("SELECT scenario, year, round(value, 6) AS value, round(value * value, 6) AS value2 FROM em")
def add_power_predictor(s, d):
    return rounded(E.ens_mean(global_means(s, d)).withColumn("value2", F.col("value") * F.col("value")))


# Joins and sources


@query("SELECT scenario, member, year, cell_id, round(value, 6) AS value FROM ens WHERE scenario = 'historical' AND member IN (SELECT member FROM ens WHERE scenario <> 'historical')")
def matching_historical(s, d):
    return rounded(E.matching_historical(V.ensemble(s, d)).select("scenario", "member", "year", "cell_id", "value"))


@query("SELECT scenario, member, year, cell_id, round(value, 6) AS value FROM sp")
def splice_hist_scen(s, d):
    return rounded(E.splice_hist_scen(V.ensemble(s, d)).select("scenario", "member", "year", "cell_id", "value"))


@query("SELECT scenario, member, year, cell_id, round(anom.value, 6) AS value, round(em.value, 6) AS predictor FROM anom JOIN em USING (scenario, year)")
def broadcast_predictors(s, d):
    pred = E.ens_mean(global_means(s, d)).withColumnRenamed("value", "predictor")
    return rounded(E.broadcast_predictors(anomalies(s, d), pred).select("scenario", "member", "year", "cell_id", "value", "predictor"))


@query("SELECT scenario, member, year, round(gm.value, 6) AS value, round(em.value, 6) AS mean, round(gm.value - em.value, 6) AS residual FROM gm JOIN em USING (scenario, year)")
def merge_predictor_tables(s, d):
    gm = global_means(s, d)
    mean = E.ens_mean(gm).withColumnRenamed("value", "mean")
    return rounded(E.exact_align(gm, mean, ["scenario", "year"]).select("scenario", "member", "year", "value", "mean", (F.col("value") - F.col("mean")).alias("residual")))


def aerosol(s, d):
    """A yearly series from the events: the day of the month stands for the year."""
    return s.read.parquet(f"{d}/events.parquet").groupBy((F.dayofmonth("ts") + 1994).cast("long").alias("year")).agg((F.avg("value") / 100).alias("aod"))


AEROSOL = "(SELECT CAST(day(ts) + 1994 AS BIGINT) AS year, avg(value) / 100 AS aod FROM events GROUP BY 1)"


@query(f"SELECT scenario, member, year, round(value, 6) AS value, round(coalesce(aod, 0.0), 6) AS aod FROM gm LEFT JOIN {AEROSOL} USING (year)")
def align_outer_fill(s, d):
    return rounded(E.align_outer_fill(global_means(s, d), aerosol(s, d), "aod").select("scenario", "member", "year", "value", "aod"))


HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"SELECT cell_i, cell_j, CAST(rank AS INTEGER) AS rank FROM (SELECT a.cell_id AS cell_i, b.cell_id AS cell_j, row_number() OVER (PARTITION BY a.cell_id ORDER BY CASE WHEN a.cell_id = b.cell_id THEN 0 ELSE round({HAV}, 6) END, b.cell_id) - 1 AS rank FROM cell a, cell b) WHERE rank < 4")
def closest_neighbors(s, d):
    return P.closest_neighbors(V.cells(s, d), 4)


# Weights and aggregates


@query("SELECT cell_id, round(cos(radians(lat)), 6) AS weight FROM cell")
def lat_weights(s, d):
    return rounded(V.cells(s, d).select("cell_id", E.lat_weights(F.col("lat")).alias("weight")))


@query("SELECT scenario, year, round(sum(cell_id * value) / sum(CASE WHEN value IS NOT NULL THEN cell_id END), 6) AS value FROM ens GROUP BY ALL")
def weighted_mean(s, d):
    return rounded(E.weighted_mean(V.ensemble(s, d), ["scenario", "year"], "value", F.col("cell_id")))


@query("SELECT scenario, member, year, round(value, 6) AS value FROM gm")
def global_mean(s, d):
    return rounded(global_means(s, d))


@query("SELECT scenario, year, round(value, 6) AS value FROM em")
def global_mean_anomaly(s, d):
    return rounded(E.ens_mean(global_means(s, d)))


@query("SELECT DISTINCT scenario, member, year, 1.0 / n AS weight FROM ens JOIN (SELECT scenario, CAST(count(DISTINCT member) AS DOUBLE) AS n FROM ens GROUP BY 1) USING (scenario)")
def scenario_weights(s, d):
    return E.scenario_weights(V.ensemble(s, d))


@query("SELECT week AS sample_id, round(1000 * (1 / p) / sum(1 / p) OVER (), 6) AS weight FROM (SELECT a.week, sum(exp(-0.5 * pow(a.value - b.value, 2) / (v * pow(n, -0.4)))) AS p FROM wk a, wk b, (SELECT var_samp(value) AS v, CAST(count(*) AS DOUBLE) AS n FROM wk) GROUP BY 1)")
def density_weights(s, d):
    return rounded(E.density_weights(V.weekly(s, d).select(F.col("week").alias("sample_id"), "value"), ["value"]).withColumn("weight", F.col("weight") * 1000))


@query("""SELECT scenario, cell_id, round(coalesce(max(CASE WHEN w > h THEN value END), min(CASE WHEN abs(c - h) < 1e-12 THEN (value + nx) / 2 END), min(CASE WHEN c > h THEN value END)), 6) AS value
FROM (SELECT scenario, cell_id, value, w, sum(w) OVER (o ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY scenario, cell_id) / 2 AS h, lead(value) OVER o AS nx
  FROM (SELECT *, CAST(year - 1990 AS DOUBLE) AS w FROM ens) WINDOW o AS (PARTITION BY scenario, cell_id ORDER BY value, w)) GROUP BY ALL""")
def weighted_median(s, d):
    return rounded(E.weighted_median(V.ensemble(s, d).withColumn("weight", (F.col("year") - 1990).cast("double")), ["scenario", "cell_id"]))


@query("""SELECT a.cell_id AS cell_i, b.cell_id AS cell_j, round((sum(w * a.value * b.value) - sum(w * a.value) * sum(w * b.value) / sum(w)) / (sum(w) - sum(w * w) / sum(w)), 6) AS cov
FROM (SELECT *, CAST(1 + sample_id % 3 AS DOUBLE) AS w FROM pooled) a JOIN pooled b USING (sample_id) GROUP BY ALL""")
def weighted_covariance(s, d):
    pooled = E.pool_samples(V.ensemble(s, d)).withColumn("weight", (1 + F.col("sample_id") % 3).cast("double"))
    return rounded(E.weighted_covariance(pooled))


@query("SELECT scenario, cell_id, round(l[CAST(round_even((len(l) - 1) * 0.5, 0) AS BIGINT) + 1], 6) AS value FROM (SELECT scenario, cell_id, list_sort(list(value)) AS l FROM ens GROUP BY ALL)")
def median_nearest(s, d):
    return rounded(E.median_nearest(V.ensemble(s, d), ["scenario", "cell_id"], "value"))


@query("SELECT scenario, member, year, cell_id, sample_id, round(value, 6) AS value FROM pooled")
def pool_samples(s, d):
    return rounded(E.pool_samples(V.ensemble(s, d)).select("scenario", "member", "year", "cell_id", "sample_id", "value"))


@query("SELECT scenario, member, year, cell_id, round(value, 6) AS value FROM ens")
def unpool_samples(s, d):
    pooled = E.pool_samples(V.ensemble(s, d))
    return rounded(E.unpool_samples(pooled.select("sample_id", "cell_id", "value"), pooled).select("scenario", "member", "year", "cell_id", "value"))


@query("SELECT scenario, member, year, cell_id, round(value, 6) AS value, CASE WHEN scenario <> 'historical' THEN lat END AS lat FROM ens")
def collapse_scenarios(s, d):
    ens = V.ensemble(s, d)
    tables = {n: ens.filter(F.col("scenario") == n).select("member", "year", "cell_id", "value", *(["lat"] if n != "historical" else [])) for n in ("historical", "scen_a", "scen_b")}
    return rounded(E.collapse_scenarios(tables).select("scenario", "member", "year", "cell_id", "value", "lat"))


# Fits

TWO = "SELECT a.*, e.value AS p FROM anom a JOIN em e USING (scenario, year)"


def with_predictor(s, d):
    return E.broadcast_predictors(anomalies(s, d), E.ens_mean(global_means(s, d)).withColumnRenamed("value", "p"))


@query(f"SELECT cell_id, round(regr_intercept(value, p), 6) AS intercept, round(regr_slope(value, p), 6) AS b_p FROM ({TWO}) GROUP BY 1")
def linreg_fit(s, d):
    return rounded(M.linreg_fit(with_predictor(s, d), ["cell_id"], ["p"], "value"))


@query(f"""SELECT cell_id, round((t0 * (s22 * s11 - s12 * s12) - s1 * (t1 * s22 - s12 * t2) + s2 * (t1 * s12 - s11 * t2)) / det, 5) AS intercept,
 round((s0 * (t1 * s22 - s12 * t2) - t0 * (s1 * s22 - s12 * s2) + s2 * (s1 * t2 - t1 * s2)) / det, 5) AS b_p, round((s0 * (s11 * t2 - t1 * s12) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s12 - s11 * s2)) / det, 5) AS b_k
FROM (SELECT *, s0 * (s11 * s22 - s12 * s12) - s1 * (s1 * s22 - s12 * s2) + s2 * (s1 * s12 - s11 * s2) AS det FROM (
 SELECT cell_id, sum(w) AS s0, sum(w * p) AS s1, sum(w * k) AS s2, sum(w * p * p) AS s11, sum(w * p * k) AS s12, sum(w * k * k) AS s22, sum(w * value) AS t0, sum(w * p * value) AS t1, sum(w * k * value) AS t2
 FROM (SELECT *, CAST(year - 1995 AS DOUBLE) AS k, CASE WHEN scenario = 'historical' THEN 1.0 ELSE 0.5 END AS w FROM ({TWO})) GROUP BY 1))""")
def linreg_fit_weighted(s, d):
    rows = with_predictor(s, d).withColumn("k", (F.col("year") - 1995).cast("double")).withColumn("w", F.when(F.col("scenario") == "historical", 1.0).otherwise(0.5))
    return rounded(M.linreg_fit(rows, ["cell_id"], ["p", "k"], "value", "w"), 5)


@query(ORACLES["linreg_fit_weighted"][len(V.CTE):])
def linreg_fit_tables(s, d):
    """As `linreg_fit_weighted`, from tables of predictors and weights whose keys must be those of the target."""
    target = anomalies(s, d).select("scenario", "member", "year", "cell_id", "value")
    p = E.ens_mean(global_means(s, d)).withColumnRenamed("value", "p")
    years = p.select("scenario", "year", (F.col("year") - 1995).cast("double").alias("k"), F.when(F.col("scenario") == "historical", 1.0).otherwise(0.5).alias("weight"))
    return rounded(M.linreg_fit_tables(target, {"p": p, "k": years}, ["scenario", "year"], ["cell_id"], weights=years), 5)


@query(f"SELECT scenario, member, year, cell_id, round(a + b * p, 6) AS predicted, round(b * p, 6) AS forced FROM ({TWO}) JOIN (SELECT cell_id, regr_intercept(value, p) AS a, regr_slope(value, p) AS b FROM ({TWO}) GROUP BY 1) USING (cell_id)")
def linreg_predict(s, d):
    rows = with_predictor(s, d)
    params = M.linreg_fit(rows, ["cell_id"], ["p"], "value")
    both = M.linreg_predict(M.linreg_predict(rows, params, ["cell_id"], ["p"]), params, ["cell_id"], ["p"], "forced", exclude={"intercept"})
    return rounded(both.select("scenario", "member", "year", "cell_id", "predicted", "forced"))


@query(f"SELECT scenario, member, year, cell_id, round(value - a - b * p, 6) AS residual FROM ({TWO}) JOIN (SELECT cell_id, regr_intercept(value, p) AS a, regr_slope(value, p) AS b FROM ({TWO}) GROUP BY 1) USING (cell_id)")
def linreg_residuals(s, d):
    rows = with_predictor(s, d)
    return rounded(M.linreg_residuals(rows, M.linreg_fit(rows, ["cell_id"], ["p"], "value"), ["cell_id"], ["p"], "value").select("scenario", "member", "year", "cell_id", "residual"))


VOLCANIC = "SELECT gm.scenario, gm.member, year, gm.value - em.value AS residual, gm.value, coalesce(aod, 0.0) AS aod FROM gm JOIN em USING (scenario, year) LEFT JOIN " + AEROSOL + " USING (year)"


#: Values and predictors beyond a range count as missing.
GAPS = "SELECT scenario, member, year, cell_id, CASE WHEN value < 2 THEN value END AS value, CASE WHEN p > -0.5 THEN p END AS p, CASE WHEN value > -3 THEN 1.0 + year % 2 END AS w FROM ({rows})"


def with_gaps(s, d):
    seen = lambda c, when: F.when(when, F.col(c)).alias(c)
    return with_predictor(s, d).select("scenario", "member", "year", "cell_id", seen("value", F.col("value") < 2), seen("p", F.col("p") > -0.5), F.when(F.col("value") > -3, 1.0 + F.col("year") % 2).alias("w"))


@query(f"""SELECT cell_id, round((t - b * sp) / sw, 6) AS intercept, round(b, 6) AS b_p FROM (
 SELECT cell_id, sum(w) AS sw, sum(w * p) AS sp, sum(w * value) AS t, (sum(w * p * value) - sum(w * p) * sum(w * value) / sum(w)) / (sum(w * p * p) - sum(w * p) * sum(w * p) / sum(w)) AS b
 FROM ({GAPS.format(rows=TWO)}) WHERE value IS NOT NULL AND p IS NOT NULL AND w IS NOT NULL GROUP BY 1)""")
def linreg_fit_incomplete(s, d):
    """Rows that miss the value, the predictor or the weight."""
    return rounded(M.linreg_fit(with_gaps(s, d), ["cell_id"], ["p"], "value", "w"))


@query(f"""SELECT scenario, member, cell_id, CASE WHEN nobs > 1 AND sxx > 0 THEN round(a, 6) END AS intercept, CASE WHEN nobs > 1 AND sxx > 0 THEN round(b, 6) END AS coeff, CASE WHEN nobs > 1 AND sxx > 0 THEN round((syy - b * sxy) / nobs, 6) END AS variance, nobs
 FROM (SELECT scenario, member, cell_id, regr_intercept(value, x) AS a, regr_slope(value, x) AS b, regr_syy(value, x) AS syy, regr_sxy(value, x) AS sxy, regr_sxx(value, x) AS sxx, CAST(regr_count(value, x) AS BIGINT) AS nobs
 FROM (SELECT *, lag(value) OVER (PARTITION BY scenario, member, cell_id ORDER BY year) AS x FROM ({GAPS.format(rows=TWO)})) WHERE x IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2, 3)""")
def ar_fit_incomplete(s, d):
    """Series with missing years."""
    return rounded(M.ar_fit(with_gaps(s, d), ["scenario", "member", "cell_id"]))


def volcanic_rows(s, d):
    gm = global_means(s, d)
    rows = gm.join(E.ens_mean(gm).withColumnRenamed("value", "mean"), ["scenario", "year"]).withColumn("residual", F.col("value") - F.col("mean"))
    return E.align_outer_fill(rows, aerosol(s, d), "aod")


@query(f"SELECT round(sum(aod * value) / sum(aod * aod), 6) AS slope FROM ({VOLCANIC}) WHERE scenario = 'historical'")
def fit_volcanic(s, d):
    return rounded(M.fit_volcanic(volcanic_rows(s, d).filter("scenario = 'historical'"), residual="value"))


@query(f"SELECT scenario, member, year, round(value + slope * aod, 6) AS value FROM ({VOLCANIC}), (SELECT sum(aod * value) / sum(aod * aod) AS slope FROM ({VOLCANIC}) WHERE scenario = 'historical')")
def superimpose_volcanic(s, d):
    slope = M.fit_volcanic(volcanic_rows(s, d).filter("scenario = 'historical'"), residual="value")
    return rounded(M.superimpose_volcanic(global_means(s, d), slope, aerosol(s, d), ["scenario", "member"]).select("scenario", "member", "year", "value"))


#: Below two pairs, or where the earlier values do not vary, the fit is null.
AR = "SELECT scenario, member, cell_id, nobs, CASE WHEN nobs > 1 AND v > 0 THEN coeff END AS coeff, CASE WHEN nobs > 1 AND v > 0 THEN intercept END AS intercept, CASE WHEN nobs > 1 AND v > 0 THEN variance END AS variance FROM (SELECT scenario, member, cell_id, regr_slope(value, x) AS coeff, regr_intercept(value, x) AS intercept, count(*) AS nobs, var_pop(x) AS v, (regr_syy(value, x) - regr_slope(value, x) * regr_sxy(value, x)) / count(*) AS variance FROM (SELECT *, lag(value) OVER (PARTITION BY scenario, member, cell_id ORDER BY year) AS x FROM sp) WHERE x IS NOT NULL GROUP BY ALL)"


@query(f"SELECT scenario, member, cell_id, round(intercept, 6) AS intercept, round(coeff, 6) AS coeff, round(variance, 6) AS variance, nobs FROM ({AR})")
def ar_fit(s, d):
    return rounded(M.ar_fit(E.splice_hist_scen(V.ensemble(s, d)), ["scenario", "member", "cell_id"]))


@query(f"SELECT cell_id, round(avg(i), 6) AS intercept, round(avg(c), 6) AS coeff, round(avg(v), 6) AS variance FROM (SELECT scenario, cell_id, avg(intercept) AS i, avg(coeff) AS c, avg(variance) AS v FROM ({AR}) GROUP BY ALL) GROUP BY 1")
def ar_fit_scen_ens(s, d):
    return rounded(M.ar_fit_scen_ens(E.splice_hist_scen(V.ensemble(s, d))))


def swept_sql(lags: int) -> str:
    """CTEs e0 to e<lags> over `mon`: by (member, cell_id) the covariances of the lagged values and the value, swept by one lag after the other.

    After k steps the last element is the residual variance of order k, the last column the coefficients.
    """
    names = [*[f"x{k}" for k in range(1, lags + 1)], "y"]
    rows = ", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in names) + "]" for a in names)
    lagged = f"SELECT member, cell_id, value AS y, {', '.join(f'lag(value, {k}) OVER o AS x{k}' for k in range(1, lags + 1))} FROM mon WINDOW o AS (PARTITION BY member, cell_id ORDER BY year, month)"
    out = [f"e0 AS (SELECT member, cell_id, count(*) AS n, [{', '.join(f'avg({c})' for c in names)}] AS means, [{rows}] AS m FROM ({lagged}) WHERE x{lags} IS NOT NULL GROUP BY ALL)"]
    for k in range(1, lags + 1):
        out.append(f"e{k} AS (SELECT member, cell_id, n, means, list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / m[{k}][{k}]) ELSE list_transform(r, lambda v, j: v - r[{k}] * m[{k}][j] / m[{k}][{k}]) END) AS m FROM e{k - 1})")
    return ", ".join(out)


ORDERS = 12


@query(f"""SELECT member, cell_id, CAST(arg_min(p, (ic, p)) AS INTEGER) AS "order" FROM (WITH {swept_sql(ORDERS)} {" UNION ALL ".join(f"SELECT member, cell_id, {k} AS p, n * ln(m[{ORDERS + 1}][{ORDERS + 1}]) + ln(n) * {k + 1} AS ic FROM e{k} WHERE n > {k + 1}" for k in range(1, ORDERS + 1))}) GROUP BY ALL""")
def ar_order(s, d):
    return M.ar_order(V.monthly(s, d).withColumn("t", F.col("year") * 12 + F.col("month")), ["member", "cell_id"], ORDERS, "t")


@query(f"""SELECT member, cell_id, n AS nobs, round(CASE WHEN n > 6 THEN m[6][6] END, 5) AS variance, round(CASE WHEN n > 6 THEN means[6] - list_dot_product(list_transform(m[1:5], lambda r: r[6]), means[1:5]) END, 5) AS intercept,
{", ".join(f"round(CASE WHEN n > 6 THEN m[{k}][6] END, 5) AS coeff_{k}" for k in range(1, 6))} FROM (WITH {swept_sql(5)} SELECT * FROM e5)""")
def ar_fit_order_5(s, d):
    fit = M.ar_fit_lags(V.monthly(s, d).withColumn("t", F.col("year") * 12 + F.col("month")), ["member", "cell_id"], [1, 2, 3, 4, 5], "t")
    return rounded(fit.select("member", "cell_id", "nobs", "variance", "intercept", *[F.col("coeffs")[k - 1].alias(f"coeff_{k}") for k in range(1, 6)]), 5)


@query(f"""SELECT cell_id, round(avg(m[4][4]), 5) AS variance, round(avg(means[4] - list_dot_product(list_transform(m[1:3], lambda r: r[4]), means[1:3])), 5) AS intercept,
{", ".join(f"round(avg(m[{k}][4]), 5) AS coeff_{k}" for k in range(1, 4))} FROM (WITH {swept_sql(3)} SELECT * FROM e3 WHERE n > 4) GROUP BY 1""")
def ar_fit_scen_ens_order_3(s, d):
    rows = V.monthly(s, d).withColumn("t", F.col("year") * 12 + F.col("month")).withColumn("scenario", F.lit("all"))
    fit = M.ar_fit_scen_ens_lags(rows, [1, 2, 3], "t")
    return rounded(fit.filter("variance IS NOT NULL").select("cell_id", "variance", "intercept", *[F.col("coeffs")[k - 1].alias(f"coeff_{k}") for k in range(1, 4)]), 5)


@query("SELECT cell_id, month, round(regr_intercept(value, x), 6) AS intercept, round(regr_slope(value, x), 6) AS slope FROM (SELECT *, lag(value) OVER (PARTITION BY member, cell_id ORDER BY year, month) AS x FROM mon) WHERE x IS NOT NULL GROUP BY ALL")
def ar_fit_monthly(s, d):
    return rounded(M.ar_fit_monthly(V.monthly(s, d), ["member", "cell_id"]))


@query("SELECT cell_id, month, round(regr_intercept(value, x), 6) AS intercept, round(regr_slope(value, x), 6) AS slope FROM (SELECT *, lag(value) OVER (PARTITION BY cell_id ORDER BY member, year, month) AS x FROM mon) WHERE x IS NOT NULL GROUP BY ALL")
def ar_fit_monthly_pooled(s, d):
    """The second member's first month follows the last one of the first."""
    return rounded(M.ar_fit_monthly(V.monthly(s, d), ["member", "cell_id"], pooled=True))


@query("""SELECT member, year, month, m.cell_id, round(value - intercept - slope * x, 6) AS residual FROM (SELECT *, lag(value) OVER (PARTITION BY member, cell_id ORDER BY year, month) AS x FROM mon) m
JOIN (SELECT cell_id, month, regr_intercept(value, x) AS intercept, regr_slope(value, x) AS slope FROM (SELECT *, lag(value) OVER (PARTITION BY member, cell_id ORDER BY year, month) AS x FROM mon) WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) > 1) USING (cell_id, month) WHERE x IS NOT NULL""")
def ar_monthly_residuals(s, d):
    mon = V.monthly(s, d)
    fit = M.ar_fit_monthly(mon, ["member", "cell_id"]).filter("slope IS NOT NULL")
    return rounded(M.ar_monthly_residuals(mon, fit, ["member", "cell_id"]).select("member", "year", "month", "cell_id", "residual"))


MONTHLY_SCENARIOS = "SELECT *, CASE WHEN year <= 1997 THEN 'historical' ELSE 'scen' END AS scenario FROM mon"


@query(f"""SELECT cell_id, CAST(l[CAST(round_even((len(l) - 1) * 0.5, 0) AS BIGINT) + 1] AS INTEGER) AS "order" FROM (SELECT cell_id, list_sort(list(o)) AS l FROM (
SELECT scenario, cell_id, l[CAST(round_even((len(l) - 1) * 0.5, 0) AS BIGINT) + 1] AS o FROM (SELECT scenario, cell_id, list_sort(list(o)) AS l FROM (
SELECT scenario, member, cell_id, arg_min(p, (ic, p)) AS o FROM (
WITH lagged AS (SELECT scenario, member, cell_id, value AS y, lag(value, 1) OVER o AS x1, lag(value, 2) OVER o AS x2 FROM ({MONTHLY_SCENARIOS}) WINDOW o AS (PARTITION BY scenario, member, cell_id ORDER BY year, month)),
m AS (SELECT scenario, member, cell_id, CAST(count(*) AS DOUBLE) AS n, var_pop(x1) AS a, var_pop(x2) AS c, covar_pop(x1, x2) AS b, covar_pop(y, x1) AS u, covar_pop(y, x2) AS v, var_pop(y) AS w FROM lagged WHERE x2 IS NOT NULL GROUP BY ALL)
SELECT scenario, member, cell_id, 1 AS p, n * ln(w - u * u / a) + ln(n) * 2 AS ic FROM m UNION ALL SELECT scenario, member, cell_id, 2, n * ln(w - (c * u * u - 2 * b * u * v + a * v * v) / (a * c - b * b)) + ln(n) * 3 FROM m) GROUP BY ALL) GROUP BY ALL)) GROUP BY 1)""")
def ar_order_scen_ens(s, d):
    mon = V.monthly(s, d).withColumn("scenario", F.when(F.col("year") <= 1997, "historical").otherwise("scen"))
    return M.ar_order_scen_ens(mon.withColumn("t", F.col("year") * 12 + F.col("month")), 2, "t")


def harmonic_rows(s, d):
    mon = V.monthly(s, d, "year")
    return mon.join(P.resample_annual(mon, ["cell_id", "member"]).withColumnRenamed("value", "yearly"), ["cell_id", "member", "year"])


# In whole years (sf0.01 and up) the harmonics are orthogonal: each year has its own two sums for a harmonic, and these are regressed on the yearly means.
HARMONICS = """, hr AS (SELECT *, avg(value) OVER (PARTITION BY cell_id, member, year) AS yearly FROM whole), hs AS (
SELECT cell_id, member, year, k, any_value(yearly) AS yearly, sum((value - yearly) * cos(pi() * k * (month - 1) / 6)) / CASE WHEN k = 6 THEN 12 ELSE 6 END AS a, CASE WHEN k = 6 THEN 0 ELSE sum((value - yearly) * sin(pi() * k * (month - 1) / 6)) / 6 END AS b
FROM hr, (SELECT CAST(unnest(range(1, 7)) AS BIGINT) AS k) GROUP BY cell_id, member, year, k),
hc AS (SELECT cell_id, k, regr_slope(a, yearly) AS ca, regr_intercept(a, yearly) AS ia, regr_slope(b, yearly) AS cb, regr_intercept(b, yearly) AS ib FROM hs GROUP BY ALL),
he AS (SELECT cell_id, k, sum(CASE WHEN k = 6 THEN 12 ELSE 6 END * (pow(ca * yearly + ia, 2) + pow(cb * yearly + ib, 2))) AS gain FROM hs JOIN hc USING (cell_id, k) GROUP BY ALL),
hb AS (SELECT cell_id, k, n, n * ln((total - sum(gain) OVER (PARTITION BY cell_id ORDER BY k)) / n) + 4 * k * ln(n) AS bic FROM he JOIN (SELECT cell_id, count(*) AS n, sum(pow(value - yearly, 2)) AS total FROM hr GROUP BY 1) USING (cell_id)),
ho AS (SELECT cell_id, any_value(n) AS n, coalesce(min(CASE WHEN rises THEN k END) - 1, 6) AS o FROM (SELECT *, bic >= lag(bic, 1, CAST('inf' AS DOUBLE)) OVER (PARTITION BY cell_id ORDER BY k) AS rises FROM hb) GROUP BY 1)
"""


@query(HARMONICS + """SELECT cell_id, CAST(o AS INTEGER) AS "order", CAST(place AS INTEGER) AS place, round(coeff, 5) AS coeff, n AS nobs FROM (
SELECT cell_id, o, n, 4 * (k - 1) + j AS place, [ca, ia, cb, ib][j] AS coeff FROM hc JOIN ho USING (cell_id), (SELECT unnest(range(1, 5)) AS j) WHERE k <= o)""")
def harmonic_fit(s, d):
    """One row a coefficient."""
    fit = H.harmonic_fit(harmonic_rows(s, d)).select("cell_id", "order", F.posexplode("coeffs").alias("place", "coeff"), "nobs")
    return rounded(fit.withColumn("place", F.col("place") + 1), 5)


@query(HARMONICS + """SELECT hr.cell_id, member, year, month, round(value, 5) AS value, round(yearly + coalesce(sum((ca * yearly + ia) * cos(pi() * k * (month - 1) / 6) + (cb * yearly + ib) * sin(pi() * k * (month - 1) / 6)), 0), 5) AS predicted
FROM hr LEFT JOIN (SELECT hc.* FROM hc JOIN ho USING (cell_id) WHERE k <= o) c ON c.cell_id = hr.cell_id GROUP BY hr.cell_id, member, year, month, value, yearly""")
def harmonic_predict(s, d):
    rows = harmonic_rows(s, d)
    return rounded(H.harmonic_predict(rows, H.harmonic_fit(rows)).select("cell_id", "member", "year", "month", "value", "predicted"), 5)


@query("""SELECT week, round((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), 5) AS smooth FROM (SELECT week, sum(w) AS s0, sum(w * c) AS s1, sum(w * c * c) AS s2, sum(w * y) AS t0, sum(w * c * y) AS t1 FROM (
SELECT week, c, y, CASE WHEN d < h THEN pow(1 - pow(d / h, 3), 3) ELSE 0 END AS w FROM (SELECT *, max(d) OVER (PARTITION BY week) AS h FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY d, x) AS r FROM (
SELECT CAST(a.week AS DOUBLE) AS week, CAST(b.week AS DOUBLE) AS x, CAST(b.week - a.week AS DOUBLE) AS c, abs(CAST(b.week - a.week AS DOUBLE)) AS d, b.value AS y FROM wk a, wk b)) WHERE r <= 50)) GROUP BY 1)""")
def lowess(s, d):
    return rounded(M.lowess(V.weekly(s, d).withColumn("all", F.lit(0)), ["all"], "week", "value", 50).drop("all"), 5)


@query(""", mm AS (SELECT cell_id, CAST(12 * year + month AS DOUBLE) AS x, value AS y FROM mon), k AS (SELECT cell_id, floor(12.0 * count(*) / count(DISTINCT x) + 1e-10) AS n FROM mm GROUP BY 1)
SELECT cell_id, x0 AS step, round((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), 5) AS smooth FROM (SELECT cell_id, x0, sum(w) AS s0, sum(w * c) AS s1, sum(w * c * c) AS s2, sum(w * y) AS t0, sum(w * c * y) AS t1 FROM (
SELECT cell_id, x0, c, y, CASE WHEN abs(c) < h THEN pow(1 - pow(abs(c) / h, 3), 3) ELSE 0 END AS w FROM (SELECT *, max(abs(c)) OVER (PARTITION BY cell_id, x0) AS h FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, x0 ORDER BY abs(c), x, y) AS r FROM (
SELECT a.cell_id, a.x AS x0, b.x, b.x - a.x AS c, b.y FROM (SELECT DISTINCT cell_id, x FROM mm) a JOIN mm b USING (cell_id))) JOIN k USING (cell_id) WHERE r <= n)) GROUP BY ALL)""")
def lowess_pooled(s, d):
    """Both members of a region in one fit, over 12 months."""
    rows = V.monthly(s, d).withColumn("step", (12 * F.col("year") + F.col("month")).cast("double"))
    return rounded(M.lowess(rows, ["cell_id"], "step", "value", 12, pooled=True), 5)


GC = "CASE WHEN {r} < 1 THEN 1 - 5.0 / 3 * pow({r}, 2) + 5.0 / 8 * pow({r}, 3) + 0.5 * pow({r}, 4) - 0.25 * pow({r}, 5) WHEN {r} < 2 THEN 4 - 5 * {r} + 5.0 / 3 * pow({r}, 2) + 5.0 / 8 * pow({r}, 3) - 0.5 * pow({r}, 4) + pow({r}, 5) / 12 - 2 / (3 * {r}) ELSE 0 END"


@query("SELECT cell_i, cell_j, radius, round(" + GC.format(r="(km / radius)") + f", 6) AS correlation FROM (SELECT a.cell_id AS cell_i, b.cell_id AS cell_j, {HAV} AS km FROM cell a, cell b), (VALUES (CAST(1500 AS DOUBLE)), (CAST(5000 AS DOUBLE))) t(radius)")
def gaspari_cohn_correlation(s, d):
    c = V.cells(s, d)
    pairs = c.select(F.col("cell_id").alias("cell_i"), F.col("lat").alias("a"), F.col("lon").alias("b")).join(c.select(F.col("cell_id").alias("cell_j"), F.col("lat").alias("c"), F.col("lon").alias("d")))
    km = S.haversine_km(*[F.col(x) for x in "abcd"])
    rows = pairs.withColumn("radius", F.explode(F.array(F.lit(1500.0), F.lit(5000.0))))
    return rounded(rows.select("cell_i", "cell_j", "radius", S.gaspari_cohn(km / F.col("radius")).alias("correlation")))


@query(f"""SELECT 'b_p' AS coeff, cell_id, round(coalesce(max(CASE WHEN w > h THEN value END), min(CASE WHEN abs(c - h) < 1e-12 THEN (value + nx) / 2 END), min(CASE WHEN c > h THEN value END)), 6) AS value
FROM (SELECT cell_id, value, w, sum(w) OVER (o ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY cell_id) / 2 AS h, lead(value) OVER o AS nx
  FROM (SELECT cell_i AS cell_id, slope AS value, {GC.format(r="(km / 5000)")} AS w FROM (SELECT a.cell_id AS cell_i, b.cell_id AS cell_j, {HAV} AS km FROM cell a, cell b)
    JOIN (SELECT cell_id AS cell_j, regr_slope(value, p) AS slope FROM ({TWO}) GROUP BY 1) USING (cell_j)) WINDOW o AS (PARTITION BY cell_id ORDER BY value, w)) GROUP BY 2""")
def smooth_coefficients(s, d):
    slopes = M.linreg_fit(with_predictor(s, d), ["cell_id"], ["p"], "value").select(F.lit("b_p").alias("coeff"), "cell_id", F.col("b_p").alias("value"))
    return rounded(E.smooth_coefficients(slopes, J.near_pairs(V.cells(s, d), 10000.0, haversine=True), 5000.0))


@query("SELECT * FROM (SELECT cell_i, cell_j, round(km, 6) AS km, round(" + GC.format(r="(km / 2500)") + f", 6) AS correlation FROM (SELECT a.cell_id AS cell_i, b.cell_id AS cell_j, CASE WHEN a.cell_id = b.cell_id THEN 0 ELSE {HAV} END AS km FROM cell a, cell b) WHERE km <= 5000)")
def localisation_pairs(s, d):
    """The pairs that a localisation of 2500 km reaches, by cubes; no other pair is made."""
    near = J.near_pairs(V.cells(s, d), 5000.0, haversine=True)
    return rounded(near.withColumn("correlation", S.gaspari_cohn(F.col("km") / 2500.0)))


LAM = "2.0 / (1.0 + 0.8 * exp(0.5 * p))"
YJ = "CASE WHEN x >= 0 THEN (pow(1 + x, l) - 1) / l ELSE -(pow(1 - x, 2 - l) - 1) / (2 - l) END"


@query(f"SELECT scenario, member, year, cell_id, round(l, 6) AS lambda, round({YJ}, 6) AS transformed, round(x, 6) AS back FROM (SELECT *, value AS x, {LAM} AS l FROM ({TWO}))")
def yeo_johnson(s, d):
    rows = with_predictor(s, d).withColumn("lambda", S.logistic_lambda(F.lit(0.8), F.lit(0.5), F.col("p"))).withColumn("transformed", S.yeo_johnson(F.col("value"), F.col("lambda")))
    return rounded(rows.withColumn("back", S.yeo_johnson_inverse(F.col("transformed"), F.col("lambda"))).select("scenario", "member", "year", "cell_id", "lambda", "transformed", "back"))


@query("SELECT user_id, event_type, round(ln(p / (1 - p)), 5) AS z FROM (SELECT user_id, event_type, greatest(1e-9, least(1 - 1e-9, exp(-exp(-(value - 20) / 15)))) AS p FROM events)")
def probability_transform(s, d):
    source, target = C.DistSpec("gumbel_r", {"loc": "20", "scale": "15"}, ()), C.DistSpec("logistic", {"loc": "0", "scale": "1"}, ())
    return rounded(C.probability_integral_transform(s.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "value"), source, target, out="z").drop("value"), 5)


@query(f"SELECT cell_id, round(-sum(lp), 5) AS nll, round(2 * ln(count(*)) - 2 * sum(lp), 5) AS bic FROM (SELECT cell_id, -0.5 * pow(value - p, 2) - 0.9189385332046727 AS lp FROM ({TWO})) GROUP BY 1")
def quality_scores(s, d):
    spec = C.DistSpec("norm", {"loc": "c0 + c1 * p", "scale": "1"}, ("c0", "c1"))
    rows = with_predictor(s, d)
    given = rows.select("cell_id", F.lit(0.0).alias("c0"), F.lit(1.0).alias("c1")).distinct()
    return rounded(C.quality_scores(rows, given, spec, ["cell_id"], scores=("nll", "bic")), 5)


@query(f"""SELECT a.cell_id AS cell_i, b.cell_id AS cell_j, round(covar_samp(a.value, b.value) * sqrt(1 - ga.c * ga.c) * sqrt(1 - gb.c * gb.c), 6) AS cov
FROM pooled a JOIN pooled b USING (sample_id) JOIN (SELECT cell_id, tanh(avg(coeff)) AS c FROM ({AR}) GROUP BY 1) ga ON ga.cell_id = a.cell_id JOIN (SELECT cell_id, tanh(avg(coeff)) AS c FROM ({AR}) GROUP BY 1) gb ON gb.cell_id = b.cell_id GROUP BY a.cell_id, b.cell_id, ga.c, gb.c""")
def adjust_covariance_ar1(s, d):
    ens = V.ensemble(s, d)
    cov = E.weighted_covariance(E.pool_samples(ens).withColumn("weight", F.lit(1.0)))
    coeffs = M.ar_fit(E.splice_hist_scen(ens), ["scenario", "member", "cell_id"]).groupBy("cell_id").agg(F.tanh(F.avg("coeff")).alias("coeff"))
    return rounded(M.adjust_covariance_ar1(cov, coeffs))


# Generation

UNIFORM = "CAST('0x' || substr(md5('7:' || scenario || ':' || realisation || ':' || t || ':' || cell_id || ':{k}'), 1, 12) AS BIGINT) / 281474976710656.0"
NOISE = "SELECT scenario, realisation, t, cell_id, sqrt(-2 * ln(1 - " + UNIFORM.format(k=1) + ")) * cos(2 * 3.141592653589793 * " + UNIFORM.format(k=2) + ") AS noise FROM (SELECT DISTINCT scenario, cell_id FROM ens), (SELECT CAST(range AS BIGINT) AS realisation FROM range(2)), (SELECT CAST(range AS INTEGER) AS t FROM range(8))"


def noise(s, d):
    keys = V.ensemble(s, d).select("scenario", "cell_id").distinct()
    keys = keys.select("scenario", "cell_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("realisation")).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t"))
    return G.noise_table(keys, "7")


@query(f"SELECT scenario, realisation, t, cell_id, round(noise, 6) AS noise FROM ({NOISE})")
def noise_table(s, d):
    return rounded(noise(s, d).select("scenario", "realisation", "t", "cell_id", "noise"))


RECURSION = f"""SELECT scenario, realisation, cell_id, t - 1 AS t, x FROM (
WITH RECURSIVE nz AS MATERIALIZED ({NOISE}), par AS MATERIALIZED (SELECT cell_id, avg(i) AS a, avg(c) AS b FROM (SELECT scenario, cell_id, avg(intercept) AS i, avg(coeff) AS c FROM ({AR}) GROUP BY ALL) GROUP BY 1),
rec AS (SELECT scenario, realisation, cell_id, 1 AS t, CAST(0 AS DOUBLE) AS x FROM nz WHERE t = 1 UNION ALL SELECT rec.scenario, rec.realisation, rec.cell_id, nz.t, a + b * x + noise FROM rec JOIN nz ON nz.scenario = rec.scenario AND nz.realisation = rec.realisation AND nz.cell_id = rec.cell_id AND nz.t = rec.t + 1 JOIN par ON par.cell_id = rec.cell_id)
SELECT * FROM rec)"""


@query(f"""SELECT scenario, realisation, cell_id, CAST(t - 1 AS BIGINT) AS t, round(h[1], 5) AS x FROM (
WITH RECURSIVE nz AS MATERIALIZED ({NOISE}), par AS MATERIALIZED (SELECT CAST(range AS BIGINT) AS cell_id, 0.1 * range AS a, [0.4, -0.2, 0.01 * range] AS c FROM range(25)),
rec AS (SELECT scenario, realisation, cell_id, 3 AS t, [CAST(0 AS DOUBLE), 0, 0] AS h FROM nz WHERE t = 3 UNION ALL
SELECT rec.scenario, rec.realisation, rec.cell_id, nz.t, list_prepend(a + list_dot_product(CAST(c AS DOUBLE[]), h) + noise, h[1:2]) FROM rec JOIN nz ON nz.scenario = rec.scenario AND nz.realisation = rec.realisation AND nz.cell_id = rec.cell_id AND nz.t = rec.t + 1 JOIN par ON par.cell_id = rec.cell_id)
SELECT scenario, realisation, cell_id, t, h FROM rec UNION ALL SELECT scenario, realisation, cell_id, t, [CAST(0 AS DOUBLE)] FROM nz WHERE t IN (1, 2))""")
def ar_recursion_order_3(s, d):
    rows = noise(s, d)
    params = rows.select("cell_id").distinct().select("cell_id", (0.1 * F.col("cell_id")).alias("intercept"), F.array(F.lit(0.4), F.lit(-0.2), 0.01 * F.col("cell_id")).alias("coeffs"))
    return rounded(G.ar_recursion(rows, params, ["scenario", "realisation", "cell_id"], buffer=1), 5)


@query(f"SELECT * REPLACE (round(x, 6) AS x) FROM ({RECURSION})")
def ar_recursion(s, d):
    params = M.ar_fit_scen_ens(E.splice_hist_scen(V.ensemble(s, d)))
    return rounded(G.ar_recursion(noise(s, d), params, ["scenario", "realisation", "cell_id"], buffer=1))


@query(f"""SELECT f.scenario, realisation, f.year, f.cell_id, round(forced + x, 6) AS value FROM ({RECURSION}) r JOIN (
 SELECT em.scenario, em.year, cell_id, a + b * em.value AS forced FROM em, (SELECT cell_id, regr_intercept(value, p) AS a, regr_slope(value, p) AS b FROM ({TWO}) GROUP BY 1)) f
ON r.scenario = f.scenario AND r.cell_id = f.cell_id AND r.t = f.year - 1995""")
def emulate_annual(s, d):
    em = E.ens_mean(global_means(s, d)).withColumnRenamed("value", "p")
    params = M.linreg_fit(with_predictor(s, d), ["cell_id"], ["p"], "value")
    forced = M.linreg_predict(em.join(F.broadcast(V.cells(s, d).select("cell_id"))), params, ["cell_id"], ["p"], "forced")  # a nation a cell: 25
    local = G.ar_recursion(noise(s, d), M.ar_fit_scen_ens(E.splice_hist_scen(V.ensemble(s, d))), ["scenario", "realisation", "cell_id"], buffer=1)
    return rounded(G.emulate_annual(forced, local, 1995))


MONTHLY_NOISE = "SELECT scenario, realisation, t, cell_id, sqrt(-2 * ln(1 - " + UNIFORM.format(k=1) + ")) * cos(2 * 3.141592653589793 * " + UNIFORM.format(k=2) + ") AS noise FROM (SELECT DISTINCT 'm' AS scenario, cell_id FROM mon), (SELECT unnest(range(2)) AS realisation), (SELECT CAST(unnest(range(36)) AS INTEGER) AS t)"


@query(f"""SELECT scenario, realisation, cell_id, t - 12 AS t, round(x, 6) AS x FROM (
WITH RECURSIVE nz AS MATERIALIZED ({MONTHLY_NOISE}), par AS MATERIALIZED (SELECT cell_id, month, regr_intercept(value, x) AS a, regr_slope(value, x) AS b
 FROM (SELECT *, lag(value) OVER (PARTITION BY member, cell_id ORDER BY year, month) AS x FROM mon) WHERE x IS NOT NULL GROUP BY ALL),
rec AS (SELECT scenario, realisation, cell_id, t, noise AS x FROM nz WHERE t = 0 UNION ALL SELECT rec.scenario, rec.realisation, rec.cell_id, nz.t, a + b * x + noise
 FROM rec JOIN nz ON nz.scenario = rec.scenario AND nz.realisation = rec.realisation AND nz.cell_id = rec.cell_id AND nz.t = rec.t + 1 JOIN par ON par.cell_id = rec.cell_id AND par.month = nz.t % 12 + 1)
SELECT * FROM rec) WHERE t >= 12""")
def ar_recursion_monthly(s, d):
    mon = V.monthly(s, d)
    keys = mon.select(F.lit("m").alias("scenario"), "cell_id").distinct().withColumn("realisation", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    keys = keys.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(35))))
    return rounded(G.ar_recursion_monthly(G.noise_table(keys, "7"), M.ar_fit_monthly(mon, ["member", "cell_id"]), ["scenario", "realisation", "cell_id"], buffer=1))


# Guards


@query("SELECT count(*) FILTER (value IS NULL) AS value FROM ens")
def count_not_finite(s, d):
    return Q.count_not_finite(V.ensemble(s, d), "value")


@query("SELECT o_custkey, year, gap FROM (SELECT *, year - lag(year) OVER (PARTITION BY o_custkey ORDER BY year) AS gap FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders)) WHERE gap <> 1")
def year_gaps(s, d):
    years = s.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.year("o_orderdate").cast("long").alias("year")).distinct()
    return Q.year_gaps(years, ["o_custkey"])


@query("SELECT count(*) FILTER (abs(r0 - r1) > 0.1 * abs(r1) OR (r0 IS NULL) <> (r1 IS NULL)) AS beyond FROM (SELECT scenario, year, max(CASE WHEN member = 'r0' THEN value END) AS r0, max(CASE WHEN member = 'r1' THEN value END) AS r1 FROM gm GROUP BY ALL)")
def count_beyond(s, d):
    gm = global_means(s, d)
    return Q.count_beyond(gm.filter("member = 'r0'"), gm.filter("member = 'r1'"), ["scenario", "year"], "value", 0.1)


from . import fitted  # noqa: E402, F401  (registers more queries)
