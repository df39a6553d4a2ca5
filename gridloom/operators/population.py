"""A population search for every key at once: differential evolution (Storn and Price 1997), a generation an aggregation of the rows.

It needs no slopes and no finite start, so it finds minima at corners, such as the end of a support, and across valleys.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.params import cut_lineage
from .search import BROADCAST_KEYS, next_state

#: Members for each coefficient, least members; share of a step's components that is taken over; equal scores, as a share.
MEMBERS, LEAST_MEMBERS, CROSSED, EQUAL = 6, 20, 0.9, 1e-12
#: Generations between tests of the population, which is stored after each.
GENERATIONS_A_TEST = 8


def begun(x: np.ndarray, h: np.ndarray, members: int, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Of each key the start, and members around it at distances from a hundredth of a step to a hundred steps."""
    rng = np.random.default_rng(0)
    away = rng.standard_normal((members, x.shape[1])) * 10 ** rng.uniform(-2, 2, (members, x.shape[1]))
    away[0] = 0
    return np.clip(x[:, None, :] + away * h[:, None, :], lower, upper)


def bred(pop: np.ndarray, f: np.ndarray, generation: int, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Trials for each member: towards the best, plus a difference of two others. The same draws for all keys, so reruns agree."""
    rng = np.random.default_rng(generation + 1)
    n, d = pop.shape[1:]
    others = np.array([rng.permutation(np.delete(np.arange(n), i))[:2] for i in range(n)])
    best = pop[np.arange(len(pop)), np.argmin(f, axis=1)][:, None, :]
    reach, pull = rng.uniform(0.3, 0.9, (n, 1)), rng.uniform(0.0, 1.0, (n, 1))
    trial = pop + pull * (best - pop) + reach * (pop[:, others[:, 0]] - pop[:, others[:, 1]])
    kept = rng.random((n, d)) > CROSSED
    kept[np.arange(n), rng.integers(d, size=n)] = False
    return np.clip(np.where(kept, pop, trial), lower, upper)


def evolve(rows: DataFrame, start: DataFrame, keys: list[str], objective: Callable[[list[str]], Column], bounds: list[tuple[float, float]], generations: int = 60, members: int | None = None) -> DataFrame:
    """(keys, x array<double>, score): for each key the coefficients x with the least `objective` that a population found.

    Takes what `minimise` takes; a coefficient whose step in `h` is zero stays. Each generation aggregates the rows once, at
    all members' trials; only sums are shuffled. Null or NaN scores count as infinite; a key without a finite score keeps its
    start and an infinite score. A key without rows gives no row. The end is never worse than the start.
    """
    d, on = len(bounds), [k for k in keys if k in rows.columns]
    n = members or max(LEAST_MEMBERS, MEMBERS * d)
    lower, upper = (np.array(b, float) for b in zip(*bounds))
    arrays = ["__pop", "__f", "__t"]
    first = start.select(*keys, F.transform("x", lambda v: v.cast("double")).alias("x"), F.transform("h", lambda v: v.cast("double")).alias("h"))
    schema = StructType([*first.select(*keys).schema, *StructType.fromDDL(", ".join(f"{c} array<double>" for c in arrays))])
    lists = lambda v: list(v.reshape(len(v), -1))

    def open_(batches):
        for given in batches:
            pop = begun(np.array(given["x"].to_list(), float).reshape(-1, d), np.array(given["h"].to_list(), float).reshape(-1, d), n, lower, upper)
            yield given[keys].assign(__pop=lists(pop), __f=lists(np.full(pop.shape[:2], math.inf)), __t=lists(pop))

    def step(generation: int):
        def run(batches):
            for given in batches:
                pop, trial = (np.array(given[c].to_list(), float).reshape(-1, n, d) for c in ("__pop", "__t"))
                f, new = np.array(given["__f"].to_list(), float).reshape(-1, n), given.filter(regex="^__s").to_numpy(float)
                new = np.where(np.isnan(new), math.inf, new)
                better = new <= f
                better[:, 0] = new[:, 0] < f[:, 0]  # without a finite score the start stays where it is
                if generation == 0:
                    better[:] = True
                pop, f = np.where(better[:, :, None], trial, pop), np.where(better, new, f)
                trial = bred(pop, f, generation, lower, upper)
                yield given[keys].assign(__pop=lists(pop), __f=lists(f), __t=lists(trial))

        return run

    state = cut_lineage(first.mapInPandas(open_, schema), "population")
    size = state.count() * n
    points = [[f"__t[{i * d + j}]" for j in range(d)] for i in range(n)]
    found = [*[F.first(c).alias(c) for c in arrays], *[objective(p).cast("double").alias(f"__s{i}") for i, p in enumerate(points)]]
    low = F.array_min("__f")
    for k in range(generations):
        scored = rows.join(F.broadcast(state) if size <= BROADCAST_KEYS else state, on).groupBy(*keys).agg(*found)
        state = next_state(state, scored, size, step(k), "population")
        if (k + 1) % GENERATIONS_A_TEST == 0 and k + 1 < generations and not state.filter(~(F.array_max("__f") - low <= EQUAL * (F.abs(low) + 1))).limit(1).count():
            break
    at = F.array_position("__f", low).cast("int") - 1
    members_ = [F.col("__pop")[at * d + j] for j in range(d)]
    return state.select(*keys, F.when(low < math.inf, F.array(*members_)).otherwise(F.slice("__pop", 1, d)).alias("x"), low.alias("score"))
