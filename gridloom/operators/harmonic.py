"""Seasonal cycles as Fourier series whose coefficients are linear in the yearly value."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A mean squared error below this counts as a perfect fit.
PERFECT = 10 * np.finfo(float).eps


def design(yearly: np.ndarray, month: np.ndarray, order: int) -> np.ndarray:
    """Four columns for each harmonic: y cos, cos, y sin, sin, at the months 0 to 11."""
    angle = 2 * np.pi * np.outer(month - 1, np.arange(1, order + 1)) / 12
    cos, sin = np.cos(angle), np.sin(angle)
    return np.stack([yearly[:, None] * cos, cos, yearly[:, None] * sin, sin], axis=2).reshape(len(yearly), -1)


def partial_grams(max_order: int):
    def run(batches):
        """One Gram matrix of (design, residual) for each cell and batch."""
        for rows in batches:
            for cell, g in rows.groupby("cell_id", sort=False):
                yearly = g["yearly"].to_numpy(float)
                x = np.column_stack([design(yearly, g["month"].to_numpy(), max_order), g["value"].to_numpy(float) - yearly])
                yield pd.DataFrame({"cell_id": [cell], "n": [len(g)], "gram": [(x.T @ x).ravel()]})

    return run


def choose_order(max_order: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n, width = int(rows["n"].sum()), 4 * max_order + 1
        gram = np.sum(np.stack(rows["gram"].to_list()), axis=0).reshape(width, width)
        best, order, coeffs = math.inf, 0, np.empty(0)
        for k in range(1, max_order + 1):
            a, b = gram[: 4 * k, : 4 * k], gram[: 4 * k, -1]
            c = np.linalg.lstsq(a, b, rcond=None)[0]
            mse = max(0.0, float(gram[-1, -1] - 2 * c @ b + c @ a @ c)) / n
            bic = -math.inf if mse < PERFECT else n * math.log(mse) + 4 * k * math.log(n)
            if bic >= best:
                break
            best, order, coeffs = bic, k, c
        return pd.DataFrame({"cell_id": [rows["cell_id"].iloc[0]], "order": [order], "coeffs": [coeffs], "nobs": [n]})

    return run


def harmonic_fit(df: DataFrame, max_order: int = 6) -> DataFrame:
    """(cell_id, order, coeffs, nobs) from rows (cell_id, month 1 to 12, yearly, value).

    The order grows while the Bayesian criterion falls. The problem is linear: tasks send one Gram matrix of
    4 * max_order + 1 columns for each cell and batch, and a cell's sum is solved for every order. Rows with a
    null in these columns take no part; an empty table gives no rows.
    """
    rows = df.select(F.col("cell_id").cast("long").alias("cell_id"), "month", "yearly", "value").dropna()
    parts = rows.mapInPandas(partial_grams(max_order), "cell_id long, n long, gram array<double>")
    return parts.groupBy("cell_id").applyInPandas(choose_order(max_order), "cell_id long, order int, coeffs array<double>, nobs long")


def harmonic(yearly: Column, month: Column, coeffs: Column, max_order: int = 6) -> Column:
    """The monthly value: the yearly one plus the harmonics that `coeffs` has."""
    total = yearly
    for k in range(1, max_order + 1):
        angle = (month - 1) * (2 * math.pi * k / 12)
        at = lambda i: F.element_at(coeffs, 4 * (k - 1) + i)  # noqa: B023, E731
        term = (at(1) * yearly + at(2)) * F.cos(angle) + (at(3) * yearly + at(4)) * F.sin(angle)
        total = total + F.when(F.size(coeffs) >= 4 * k, term).otherwise(0.0)
    return total


def harmonic_predict(df: DataFrame, params: DataFrame, out: str = "predicted", max_order: int = 6) -> DataFrame:
    """Add `out` to rows (cell_id, month, yearly), by the cell's parameters."""
    joined = df.join(params.select("cell_id", F.col("coeffs").alias("__coeffs")), "cell_id")
    return joined.withColumn(out, harmonic(F.col("yearly"), F.col("month"), F.col("__coeffs"), max_order)).select(*df.columns, out)
