"""Centred moments by key: an accumulator that merges over rows, batches and tasks, and least squares from it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Accumulators that a task gathers before it merges them, and keys that it holds before it sends them on.
GATHERED, MOST_KEYS = 100_000, 200_000
#: A key whose scaled products are singular to this degree has no fit.
SINGULAR = 1e-12
STATE = "n long, w double, mean array<double>, products array<double>"


@dataclass
class Moments:
    """Of each row a key's number of values n, weight w, weighted means, and weighted products of deviations from these."""

    keys: list[pa.Array]
    n: np.ndarray
    w: np.ndarray
    mean: np.ndarray
    products: np.ndarray

    def part(self, a: int, b: int) -> Moments:
        return Moments([k.slice(a, b - a) for k in self.keys], self.n[a:b], self.w[a:b], self.mean[a:b], self.products[a:b])

    def batch(self, names: list[str]) -> pa.RecordBatch:
        lists = [pa.array(list(v.reshape(len(self.n), -1)), pa.list_(pa.float64())) for v in (self.mean, self.products)]
        return pa.RecordBatch.from_arrays([*self.keys, pa.array(self.n, pa.int64()), pa.array(self.w, pa.float64()), *lists], names)


def of_rows(keys: list[pa.Array], x: np.ndarray, w: np.ndarray) -> Moments:
    """One accumulator for each row; one that misses a value or its weight is empty, but keeps its key."""
    whole = np.isfinite(x).all(axis=1) & np.isfinite(w)
    return Moments(keys, whole.astype(np.int64), np.where(whole, w, 0.0), np.where(whole[:, None], x, 0.0), np.zeros((len(x), x.shape[1], x.shape[1])))


def numbered(keys: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its key, and the first row of each key. Null is a key, too."""
    codes = np.zeros(rows, np.int64)
    for column in keys:
        coded = column.dictionary_encode(null_encoding="encode")
        codes = np.unique(codes * max(1, len(coded.dictionary)) + np.asarray(coded.indices, np.int64), return_inverse=True)[1]
    return codes, np.unique(codes, return_index=True)[1]


def merged(parts: list[Moments], centred: bool) -> Moments:
    """One accumulator for each key. Means are corrected once by what deviations are left (Chan, Golub and LeVeque 1983)."""
    keys = [pa.concat_arrays(list(k)) for k in zip(*(p.keys for p in parts))]
    n, w, mean, products = (np.concatenate([getattr(p, a) for p in parts]) for a in ("n", "w", "mean", "products"))
    of, first = numbered(keys, len(n))
    total = lambda v: np.bincount(of, v, len(first))
    mass = total(w)
    columns = range(mean.shape[1])
    center = np.zeros((len(first), mean.shape[1]))
    if centred:
        for _ in range(2):
            off = mean - center[of]
            center += np.stack([total(w * off[:, j]) for j in columns], axis=1) / np.where(mass == 0, 1, mass)[:, None]
    off = mean - center[of]
    out = np.empty((len(first), len(columns), len(columns)))
    for i in columns:
        for j in range(i + 1):
            out[:, i, j] = out[:, j, i] = total(w * off[:, i] * off[:, j] + products[:, i, j])
    return Moments([k.take(pa.array(first)) for k in keys], total(n).astype(np.int64), mass, center, out)


def gathered(n_keys: int, n_columns: int, weighted: bool, centred: bool, names: list[str]):
    """Rows (keys, columns, weight) to a task's accumulators of each key."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [np.asarray(batch.column(k).fill_null(float("nan")), np.float64) for k in range(n_keys, batch.num_columns)]
            own = of_rows([batch.column(k) for k in range(n_keys)], np.stack(values[:n_columns], axis=1), values[-1] if weighted else np.ones(batch.num_rows))
            held.append(merged([own], centred))
            size += len(held[-1].n)
            if size > max(GATHERED, 2 * len(held[0].n)):
                held = [merged(held, centred)]
                size = len(held[0].n)
                if size > MOST_KEYS:
                    yield held.pop().batch(names)
                    size = 0
        if held:
            yield merged(held, centred).batch(names)

    return run


def whole_keys(n_keys: int, n_columns: int, centred: bool):
    """Accumulators in the order of their keys, all of a key in one partition, to one for each key."""

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k) for k in range(n_keys)]
            n, w = (np.asarray(batch.column(n_keys + k)) for k in range(2))
            mean, products = (np.asarray(batch.column(n_keys + k).flatten()).reshape(len(n), n_columns, -1) for k in (2, 3))
            own = merged([m for m in (rest, Moments(keys, n, w, mean[:, :, 0], products)) if m], centred)
            last = numbered([pa.concat_arrays([k, b.slice(len(b) - 1)]) for k, b in zip(own.keys, keys)], len(own.n) + 1)[0]
            open_ = int(np.flatnonzero(last[:-1] == last[-1])[0])  # the next batch may go on with the last row's key
            rest = own.part(open_, open_ + 1)
            for a, b in ((0, open_), (open_ + 1, len(own.n))):
                if a < b:
                    yield own.part(a, b)
        if rest:
            yield rest

    return run


def solved(m: Moments, intercept: bool) -> np.ndarray:
    """(intercept, slopes) of the last column on the others, NaN where these leave it open."""
    p = m.mean.shape[1] - 1
    out = np.full((len(m.n), p + 1), np.nan)
    size = np.sqrt(np.maximum(np.einsum("kii->ki", m.products), 0))
    able = np.flatnonzero((m.n >= p + intercept) & (m.w > 0) & (size[:, :p] > 0).all(axis=1))
    scaled = m.products[able] / np.where(size[able] > 0, size[able], 1)[:, :, None] / np.where(size[able] > 0, size[able], 1)[:, None, :]
    if p:
        sound = np.linalg.eigvalsh(scaled[:, :p, :p])[:, 0] > SINGULAR
        able, scaled = able[sound], scaled[sound]
        slopes = np.linalg.solve(scaled[:, :p, :p], scaled[:, :p, p:])[:, :, 0] * size[able, p:] / size[able, :p]
    else:
        slopes = np.zeros((len(able), 0))
    out[able, 1:] = slopes
    out[able, 0] = m.mean[able, p] - (slopes * m.mean[able, :p]).sum(axis=1) if intercept else 0.0
    return out


def fitted(df: DataFrame, keys: list[str], predictors: list[str], target: str, weight: str | None, intercept: bool) -> DataFrame:
    """(keys, intercept, b_ and each predictor's name) by weighted least squares over the complete rows of each key.

    Each task sends one accumulator of centred moments for each of its keys, whatever the rows; these are merged by key.
    """
    rows = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate([*predictors, target, *([weight] if weight else [])])])
    own, n_columns = StructType([rows.schema[f"__k{i}"] for i in range(len(keys))]), len(predictors) + 1
    state = StructType([*own, *StructType.fromDDL(STATE)])
    parts = rows.mapInArrow(gathered(len(keys), n_columns, weight is not None, intercept, state.names), state)
    by = own.names
    together = parts.repartition(*by).sortWithinPartitions(*by) if by else parts.coalesce(1)  # without keys: a row a task
    slopes = [f"__b{i}" for i in range(len(predictors))]
    schema = StructType([*own, *StructType.fromDDL(", ".join(f"{c} double" for c in ("__a", *slopes)))])

    def run(batches):
        for m in whole_keys(len(keys), n_columns, intercept)(batches):
            found = solved(m, intercept)
            yield pa.RecordBatch.from_arrays([*m.keys, *[pa.array(c, mask=np.isnan(c)) for c in found.T]], schema.names)

    out = together.mapInArrow(run, schema)
    return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], F.col("__a").alias("intercept"), *[F.col(b).alias(f"b_{p}") for b, p in zip(slopes, predictors)])
