"""Tables that a fit takes apart must hold the same keys; pooled months; arrivals by time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import conditional as C
from gridloom.operators import covariance as K
from gridloom.operators import ensemble as E
from gridloom.operators import fits as M
from gridloom.operators.guards import check_aligned
from gridloom.sources import params
from gridloom.streaming import scoring

ON = ["scenario", "year"]


@pytest.fixture(scope="module")
def tables(spark):
    """A target of three cells for each of ten samples, a predictor and weights, a row a sample."""
    rng = np.random.default_rng(3)
    p, w = rng.normal(size=10), rng.uniform(1, 2, 10)
    samples = [("a" if k < 6 else "b", k) for k in range(10)]
    target = spark.createDataFrame([(*s, c, float(2 * p[k] * c + 1 + rng.normal())) for k, s in enumerate(samples) for c in range(3)], "scenario string, year int, cell_id long, value double")
    return target, spark.createDataFrame([(*s, float(v)) for s, v in zip(samples, p)], "scenario string, year long, p double"), spark.createDataFrame([(*s, float(v)) for s, v in zip(samples, w)], "scenario string, year long, weight double")


def broken(table):
    """Without a row, with another one's key, with a row twice, with a null key, empty."""
    yield table.filter("year <> 3")
    yield table.withColumn("year", F.when(F.col("year") == 3, 33).otherwise(F.col("year")).cast("long"))
    yield table.union(table.filter("year = 3"))
    yield table.withColumn("scenario", F.when(F.col("year") != 3, F.col("scenario")))
    yield table.limit(0)


def test_linreg(spark, tables):
    target, p, w = tables
    joined = target.join(p, ON).join(w, ON)
    known = {r.cell_id: (r.intercept, r.b_p) for r in M.linreg_fit(joined, ["cell_id"], ["p"], "value", "weight").collect()}
    got = M.linreg_fit_tables(target, {"p": p}, ON, ["cell_id"], weights=w).collect()
    assert {r.cell_id: (r.intercept, r.b_p) for r in got} == {k: pytest.approx(v) for k, v in known.items()} and len(got) == 3
    for bad in broken(p):
        with pytest.raises(ValueError):
            M.linreg_fit_tables(target, {"p": bad}, ON, ["cell_id"])
    with pytest.raises(ValueError):
        M.linreg_fit_tables(target, {"p": p}, ON, ["cell_id"], weights=w.filter("year <> 9"))
    with pytest.raises(ValueError):
        M.linreg_fit_tables(target.withColumn("p", F.lit(1.0)), {"p": p}, ON, ["cell_id"])


def test_conditional(spark, tables):
    target, p, w = tables
    spec = C.DistSpec("norm", {"loc": "c0 + c1 * p", "scale": "exp(c2)"}, ("c0", "c1", "c2"))
    guess = target.select("cell_id", F.lit(0.5).alias("c0"), F.lit(0.5).alias("c1"), F.lit(0.1).alias("c2")).distinct()
    fit = C.conditional_fit_tables(target, {"p": p}, ON, guess, spec, ["cell_id"], weights=w, rounds=8).collect()
    known = {r.cell_id: (r.c0, r.c1, r.c2, r.score) for r in C.conditional_fit(target.join(p, ON).join(w, ON), guess, spec, ["cell_id"], weight="weight", rounds=8).collect()}
    assert {r.cell_id: (r.c0, r.c1, r.c2, r.score) for r in fit} == {k: pytest.approx(v, abs=1e-6) for k, v in known.items()} and len(fit) == 3
    with pytest.raises(ValueError, match="aligned"):
        C.conditional_fit_tables(target, {"p": p.filter("year <> 3")}, ON, guess, spec, ["cell_id"])
    with pytest.raises(ValueError, match="finite"):
        C.conditional_fit_tables(target, {"p": p.withColumn("p", F.when(F.col("year") != 3, F.col("p")))}, ON, guess, spec, ["cell_id"])


def test_covariance(spark, tables):
    target, _, w = tables
    samples = target.withColumn("sample_id", F.col("year").cast("long"))
    km = spark.createDataFrame([(i, j, 900.0 * abs(i - j)) for i in range(3) for j in range(3)], "cell_i long, cell_j long, km double")
    got = K.localized_covariance_tables(samples, w, km, ON, [500.0, 1000.0], 2).collect()
    known = K.localized_covariance(samples.join(w, ON), km, [500.0, 1000.0], 2).collect()
    assert sorted(got) == sorted(known) and len(got) == 9
    with pytest.raises(ValueError, match="aligned"):
        K.localized_covariance_tables(samples, w.filter("year > 0"), km, ON, [500.0, 1000.0], 2)


def test_exact_align(spark, tables):
    target, p, _ = tables
    assert E.exact_align(target, p, ON).count() == 30
    with pytest.raises(ValueError):
        E.exact_align(target, p.filter("year <> 0"), ON)
    check_aligned(ON, {"a": p.limit(0), "b": target.limit(0)})


def test_pooled_months(spark):
    """A cell's series stand one behind the other; only the very first month has none before it."""
    rng = np.random.default_rng(8)
    rows = [(m, c, y, k, float(rng.normal())) for m in ("r0", "r1", None) for c in (0, 1) for y in (1, 2, 3) for k in range(1, 13)]
    df = spark.createDataFrame(rows, "member string, cell_id long, year int, month int, value double").repartition(3)
    fit = {(r.cell_id, r.month): (r.intercept, r.slope) for r in M.ar_fit_monthly(df, ["member", "cell_id"], pooled=True).collect()}
    for c in (0, 1):
        x = np.array([r[-1] for r in sorted((r for r in rows if r[1] == c), key=lambda r: (r[0] or "", *r[2:4]))])
        for month in range(1, 13):
            at = np.arange(month - 1, len(x), 12)
            at = at[at > 0]
            slope, intercept = np.polyfit(x[at - 1], x[at], 1)
            assert fit[c, month] == pytest.approx((intercept, slope))
    assert len(fit) == 24
    one = df.filter("member = 'r0'")
    plain, pooled = (sorted(M.ar_fit_monthly(one, ["member", "cell_id"], pooled=b).collect()) for b in (False, True))
    assert plain == pooled


def test_arrivals(spark):
    """Parts by time, each row once; means by window lose no row although each part has several files."""
    rows = [(f"2024-01-{1 + k // 24:02d} {k % 24:02d}:{(7 * k) % 60:02d}:00", float(k)) for k in range(240)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz")).repartition(6)
    staged, arrived, out, state = (params.shared_path(spark, x) for x in ("staged", "arrived", "out", "state"))
    seen, last = 0, None
    for _ in scoring.arrivals(df, "t", staged, arrived, 5):
        now = spark.read.parquet(arrived)
        new = now.filter(F.col("t") > F.lit(last).cast("timestamp_ntz")) if last else now.filter("t IS NOT NULL")
        assert now.filter("t IS NOT NULL").count() - seen == new.count() > 30
        seen, last = now.filter("t IS NOT NULL").count(), str(now.agg(F.max("t")).first()[0])
        live = scoring.read_rows(spark, arrived, df.schema, None).withColumn("t", F.col("t").cast("timestamp"))
        means = scoring.windowed_means(live, [], "t", "v", "1 day", "1 hour")
        scoring.write_rows(means, out, state).awaitTermination()
    got = {r.window_start.day: (r.n, r.mean) for r in spark.read.schema(means.schema).parquet(out).collect()}
    assert seen == 240 and got == {d + 1: (24, pytest.approx(24 * d + 11.5)) for d in range(9)}
    assert spark.read.parquet(arrived).filter("t IS NULL").count() == 1
