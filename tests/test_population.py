"""The population search, bounds within fits, the steps of the first guess, and smoothed second fits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import conditional as C
from gridloom.operators.population import evolve
from gridloom.operators.search import minimise

EXPON = C.DistSpec("expon", {"loc": "a", "scale": "b"}, ("a", "b"))
NORMAL = C.DistSpec("norm", {"loc": "c1 * tas + c3", "scale": "c2"}, ("c1", "c2", "c3"))


def test_evolve(spark):
    """Two keys with minima far from the start, one of them at a bound, one key without rows."""
    rows = spark.createDataFrame([("a", 3.0), ("a", 5.0), ("b", -2.0)], "k string, v double")
    start = spark.createDataFrame([("a", [0.0, 0.0], [1.0, 1.0]), ("b", [0.0, 0.0], [1.0, 0.0]), ("c", [0.0, 0.0], [1.0, 1.0])], "k string, x array<double>, h array<double>")
    goal = lambda v: F.sum((F.expr(v[0]) - F.col("v")) ** 2 + F.abs(F.expr(v[1]) - 7))
    got = {r.k: r for r in evolve(rows, start, ["k"], goal, [(-math.inf, math.inf), (-5.0, 6.5)], 48).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].x == pytest.approx([4, 6.5], abs=1e-2) and got["b"].x == pytest.approx([-2, 0], abs=1e-2)
    none = evolve(rows, start, ["k"], lambda v: F.sum(F.lit(None).cast("double")), [(-9.0, 9.0)] * 2, 2).collect()
    assert all(r.score == math.inf and r.x == [0.0, 0.0] for r in none)


def test_fit_at_the_end_of_a_support(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1.0, 2.0, 4.0)], "cell_id int, value double")
    guess = spark.createDataFrame([(1, 0.0, 1.0)], "cell_id int, a double, b double")
    fit = C.conditional_fit(df, guess, EXPON, ["cell_id"], rounds=4, generations=80).first()
    assert (fit.a, fit.b) == pytest.approx((1, 4 / 3), abs=1e-4) and fit.score == pytest.approx(3 * math.log(4 / 3) + 3, abs=1e-4)


def test_parameter_bounds(spark):
    """The scale must not fall below 2 for any row; the guess violates nothing."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(1, float(t), float(3 * t + rng.normal())) for t in np.linspace(0, 5, 60)], "cell_id int, tas double, value double")
    spec = C.DistSpec("norm", {"loc": "c1 * tas", "scale": "c2 + 0.1 * tas"}, ("c1", "c2"))
    guess = spark.createDataFrame([(1, 2.0, 4.0)], "cell_id int, c1 double, c2 double")
    free = C.conditional_fit(df, guess, spec, ["cell_id"]).first()
    assert free.c2 < 1.5
    for generations in (0, 40):
        bound = C.conditional_fit(df, guess, spec, ["cell_id"], param_bounds={"scale": (2.0, 10.0)}, rounds=16, generations=generations).first()
        assert 2 - 1e-9 <= bound.c2 <= 2 + (0.3 if not generations else 1e-2)
        ok = C.validate_coefficients(df, spark.createDataFrame([(1, bound.c1, bound.c2)], "cell_id int, c1 double, c2 double"), spec, ["cell_id"], param_bounds={"scale": (2.0, 10.0)}).first()
        assert ok.params_ok


def test_first_guess_from_a_bad_start(spark):
    rng = np.random.default_rng(2)
    rows, wanted = [], {}
    for k, (slope, scale, base) in enumerate([(2.0, 0.5, -300.0), (-0.3, 2.0, 40.0)]):
        tas = np.linspace(0, 50, 120) + rng.normal(0, 0.1, 120)
        y = rng.normal(slope * tas + base, scale)
        rows += [(k, t, float(a), float(b)) for t, (a, b) in enumerate(zip(tas, y))]
        fit = np.polyfit(tas, y, 1)
        wanted[k] = (fit[0], math.sqrt(np.mean((y - np.polyval(fit, tas)) ** 2)), fit[1])
    df = spark.createDataFrame(rows, "cell_id int, t int, tas double, value double")
    start = spark.createDataFrame([(k, 25.0, 80.0, 900.0) for k in range(2)], "cell_id int, c1 double, c2 double, c3 double")
    guess = C.first_guess(df, start, NORMAL, ["cell_id"], ["t"], rounds=12, generations=32)
    for r in guess.collect():
        assert (r.c1, r.c2, r.c3) == pytest.approx(wanted[r.cell_id], rel=1e-2, abs=0.05)


def test_first_guess_without_location(spark):
    """Models without a loc, and the last step where the guess is not valid."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(rng.exponential(3.0, 200))], "cell_id int, t int, value double")
    spec = C.DistSpec("expon", {"loc": "0", "scale": "b"}, ("b",))
    start = spark.createDataFrame([(1, 40.0)], "cell_id int, b double")
    mean = df.agg(F.avg("value")).first()[0]
    assert C.first_guess(df, start, spec, ["cell_id"], ["t"]).first().b == pytest.approx(mean, rel=1e-3)
    wider = C.first_guess(df, start, spec, ["cell_id"], ["t"], threshold=1e-2).first().b
    assert wider != pytest.approx(mean, rel=1e-2)


def test_smoothed_second_fit(spark):
    """A cell with a stray coefficient takes its neighbours' median; where that fails the unsmoothed guess counts."""
    cells = spark.createDataFrame([(k, 0.0, float(k)) for k in range(5)] + [(9, 60.0, 120.0)], "cell_id int, lat double, lon double")
    guess = spark.createDataFrame([(k, 100.0 if k == 2 else 1.0 + 0.01 * k, 1.0) for k in (0, 1, 2, 3, 4, 9)], "cell_id int, a double, b double")
    smooth = {r.cell_id: r for r in C.smoothed_guess(guess, cells, EXPON, 300.0, ["cell_id"]).collect()}
    assert smooth[2].a < 1.1 and smooth[9].a == pytest.approx(1.09) and smooth[2].b == 1.0
    df = spark.createDataFrame([(k, 1.5 + v) for k in (0, 2) for v in (0.0, 1.0, 3.0)], "cell_id int, value double")
    bad = guess.withColumn("a", F.when(F.col("cell_id") == 0, 60.0).otherwise(1.0))
    fit = {r.cell_id: r for r in C.conditional_fit(df, bad, EXPON, ["cell_id"], rounds=4, fallback=guess).collect()}
    assert fit[0].score < math.inf and fit[0].a <= 1.5 and fit[2].score < math.inf


def test_tasks_follow_the_state(spark):
    """A round's last stage has as many tasks as the keys' state needs, whatever the number of shuffle partitions."""
    rows = spark.range(160).select((F.col("id") % 16).alias("k"), (F.col("id") % 7).cast("double").alias("value"))
    begin = rows.select("k").distinct().select("k", F.array(F.lit(1.0)).alias("x"), F.array(F.lit(0.5)).alias("h"))
    given = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {c: spark.conf.get(c) for c in given}
    try:
        for c, v in given.items():
            spark.conf.set(c, v)
        for search in (minimise, evolve):
            found = search(rows, begin, ["k"], lambda v: F.sum((F.col("value") - F.expr(v[0])) ** 2), [(-10.0, 10.0)], 2)
            assert len(found.inputFiles()) == 1 and found.count() == 16
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
