"""Fits of incomplete and far-off data, against numpy, exact fractions and the library's other fits."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import fits as M
from gridloom.operators import moments as A


def table(spark, rows, columns="p double, y double, w double"):
    return spark.createDataFrame(rows, columns)


def test_a_null_leaves_its_row_out(spark):
    rows = [(float(p), 2.0 * p + 1, 1.0) for p in range(10)]
    for k, gap in ((0, None), (1, None), (2, None), (1, float("nan")), (0, float("inf"))):
        with_gap = [tuple(gap if j == k and r[0] == 3 else v for j, v in enumerate(r)) for r in rows]
        fit = M.linreg_fit(table(spark, with_gap).withColumn("cell_id", F.lit(1)), ["cell_id"], ["p"], "y", "w").first()
        assert (fit.intercept, fit.b_p) == pytest.approx((1, 2), abs=1e-12)
    through = M.linreg_fit(table(spark, [(1.0, 2.0, 1.0), (3.0, 6.0, 1.0), (5.0, None, 1.0)]), [], ["p"], "y", intercept=False).first()
    assert tuple(through) == pytest.approx((0, 2))
    slope = M.fit_volcanic(spark.createDataFrame([(0.1 * k, None if k == 4 else -0.2 * k) for k in range(8)], "aod double, residual double")).first().slope
    assert slope == pytest.approx(-2)


def test_far_off_predictor(spark):
    """Against exact fractions; the intercept is 100,000 times as sensitive as the slope."""
    p = [1e5 + 0.001 * k for k in range(5000)]
    y = [3 * x + 1 for x in p]
    fit = M.linreg_fit(table(spark, [(a, b, 1.0) for a, b in zip(p, y)]).repartition(7), [], ["p"], "y").first()
    x, t, n = [Fraction(v) for v in p], [Fraction(v) for v in y], len(p)
    slope = (sum(a * b for a, b in zip(x, t)) - sum(x) * sum(t) / n) / (sum(a * a for a in x) - sum(x) ** 2 / n)
    assert fit.b_p == pytest.approx(float(slope), rel=1e-13)
    assert fit.intercept == pytest.approx(float((sum(t) - slope * sum(x)) / n), abs=1e-6) == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("gathered,most_keys", [(100_000, 200_000), (1, 1)])
def test_ten_predictors_by_two_keys(spark, gathered, most_keys, monkeypatch):
    """Predictors of unlike size and offset, weights, null keys; also with accumulators sent on after each batch."""
    monkeypatch.setattr(A, "GATHERED", gathered)
    monkeypatch.setattr(A, "MOST_KEYS", most_keys)
    rng = np.random.default_rng(1)
    names = [f"p{k}" for k in range(10)]
    x = rng.standard_normal((1200, 10)) * 10.0 ** np.arange(-5, 5) + 1000 * np.arange(10)
    y, w = x @ rng.standard_normal(10) + rng.standard_normal(1200) + 7, rng.uniform(0.1, 2, 1200)
    key = [("a", None, "b")[k % 3] for k in range(1200)]
    rows = [(key[i], 1 << 60 | (i % 2), *x[i].tolist(), float(y[i]), float(w[i])) for i in range(1200)]
    df = spark.createDataFrame(rows, "scenario string, cell_id long, " + ", ".join(f"{n} double" for n in names) + ", y double, w double")
    got = {(r.scenario, r.cell_id): r for r in M.linreg_fit(df.repartition(5), ["scenario", "cell_id"], names, "y", "w").collect()}
    assert len(got) == 6
    for at, r in got.items():
        own = np.array([(k, c) == at for k, c in zip(key, (q[1] for q in rows))])
        a, root = np.column_stack([np.ones(own.sum()), (x[own] - x[own].mean(axis=0)) / 10.0 ** np.arange(-5, 5)]), np.sqrt(w[own])
        expected = np.linalg.lstsq(a * root[:, None], y[own] * root, rcond=None)[0] / np.append(1, 10.0 ** np.arange(-5, 5))
        assert [r[f"b_{n}"] for n in names] == pytest.approx(expected[1:], rel=1e-8)
        assert r.intercept == pytest.approx(expected[0] - expected[1:] @ x[own].mean(axis=0), rel=1e-6)


def test_open_fits_are_null(spark):
    rows = [(1, 1.0, 2.0, 5.0), (1, 2.0, 4.0, 6.0), (1, 3.0, 6.0, 9.0), (2, 1.0, 1.0, 1.0), (3, 1.0, 0.0, 1.0), (3, 1.0, 1.0, 2.0), (3, 1.0, 5.0, 2.0), (4, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "cell_id int, p double, q double, y double")
    assert sorted(map(tuple, M.linreg_fit(df, ["cell_id"], ["p", "q"], "y").collect())) == [(k, None, None, None) for k in (1, 2, 3, 4)]
    assert M.linreg_fit(df.limit(0), ["cell_id"], ["p"], "y").count() == 0


def test_autoregression_with_gaps(spark):
    """Both fits count the pairs of which both values are there; NaN is missing, too."""
    rng = np.random.default_rng(2)
    values = [float(v) for v in rng.standard_normal(12)]
    for gap in (None, float("nan")):
        df = spark.createDataFrame([(0, t, gap if t in (5, 9) else v) for t, v in enumerate(values)], "cell_id int, year int, value double")
        pairs = [(values[t - 1], values[t]) for t in range(1, 12) if not {t - 1, t} & {5, 9}]
        slope, intercept = np.polyfit(*zip(*pairs), 1)
        variance = np.mean([(b - intercept - slope * a) ** 2 for a, b in pairs])
        one, lags = M.ar_fit(df, ["cell_id"]).first(), M.ar_fit_lags(df, ["cell_id"], [1]).first()
        assert (one.intercept, one.coeff, one.variance, one.nobs) == pytest.approx((intercept, slope, variance, 7))
        assert (lags.intercept, lags.coeffs[0], lags.variance, lags.nobs) == pytest.approx((intercept, slope, variance, 7))
