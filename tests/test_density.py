"""Sums of kernels by expansions and by slabs against direct sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import ensemble as E
from gridloom.operators.density import kernel_sums_in_boxes


def direct(z):
    return np.exp(-0.5 * ((z[:, None] - z[None]) ** 2).sum(axis=2)).sum(axis=1)


@pytest.mark.parametrize("d", [1, 2])
def test_boxes(spark, d):
    """Dense and empty boxes, samples on borders, repeats, one far away: all sums to 1e-13 of the samples' number."""
    rng = np.random.default_rng(d)
    z = np.concatenate([rng.normal(0, 2, (900, d)), rng.uniform(-9, 9, (300, d)), np.full((200, d), 0.5), np.floor(rng.uniform(-4, 4, (50, d))), np.full((1, d), 1e6)])
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(z)], "sample_id long, z array<double>").repartition(5)
    reach = float(np.sqrt(2 * np.log(1e17 * len(z))))
    sums = kernel_sums_in_boxes(df, d, reach, 64).select(F.explode(F.arrays_zip("ids", "p")).alias("s")).select("s.*").toPandas().set_index("ids")["p"].sort_index()
    assert len(sums) == len(z) and np.abs(sums.to_numpy() - direct(z)).max() < 1e-13 * len(z)
    assert sums.iloc[-1] == pytest.approx(1, abs=1e-13)


@pytest.mark.parametrize("d", [1, 2, 3])
def test_density_weights(spark, d):
    """Any number of predictors, one with a null row: the inverse density under Scott's bandwidth, summing to 1."""
    rng = np.random.default_rng(7 + d)
    x = rng.normal(size=(240, d)) @ rng.normal(size=(d, d)) + 5
    names = [f"p{k}" for k in range(d)]
    rows = [(f"s{k}", *map(float, row)) for k, row in enumerate(x)] + [("gone", None, *[0.0] * (d - 1))]
    df = spark.createDataFrame(rows, "sample_id string, " + ", ".join(f"{n} double" for n in names))
    got = {r.sample_id: r.weight for r in E.density_weights(df, names, block=16).collect()}
    cov = np.atleast_2d(np.cov(x, rowvar=False)) * len(x) ** (-2 / (d + 4))
    w = 1 / direct(x @ np.linalg.inv(np.linalg.cholesky(cov)).T)
    assert got == {f"s{k}": pytest.approx(v, rel=1e-10) for k, v in enumerate(w / w.sum())}


def test_few_samples(spark):
    one = spark.createDataFrame([(1, 2.0)], "sample_id long, p double")
    assert [r.weight for r in E.density_weights(one, ["p"]).collect()] == [1.0]
    assert E.density_weights(one.limit(0), ["p"]).count() == 0
