"""Minimise a sum over rows for every key at once: each round is one aggregation, so no key's rows meet in one task."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.params import cut_lineage, forget

#: Factors by which a step shrinks or grows, and the share of |x| + 1 under which a step has converged.
SHRINK, GROW, CLOSE = 0.25, 2.0, 1e-6
#: Rounds between tests of the state. It is stored after each round: plans of several rounds take longer to make than their jobs to run.
ROUNDS_A_TEST = 4
#: The state (three numbers a coefficient) of up to this many keys is broadcast to the rows; beyond it the join shuffles.
BROADCAST_KEYS = 100_000
#: Rows of points of the state in one task, so that a round's tasks follow the state, whatever the number of shuffle partitions.
POINTS_A_TASK = 20_000


def next_state(old: DataFrame, scored: DataFrame, points: int, step: Callable, label: str = "state") -> DataFrame:
    """The state after `step`, stored, from the scores of its `points` (of all keys together); the files of the `old` one go."""
    new = cut_lineage(scored.coalesce(max(1, -(-points // POINTS_A_TASK))).mapInPandas(step, old.schema), label)
    forget(old)
    return new


def stencil_signs(d: int) -> list[dict[int, int]]:
    """Steps along the axes, by axis: none, + and - along each, and + along each two; enough for a quadratic model."""
    return [{}, *({i: s} for i in range(d) for s in (1, -1)), *({i: 1, j: 1} for i in range(d) for j in range(i + 1, d))]


def stencil(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.array([x + np.array([signs.get(i, 0) for i in range(len(x))]) * h for signs in stencil_signs(len(x))])


def newton_point(x: np.ndarray, h: np.ndarray, f: np.ndarray) -> np.ndarray | None:
    """The minimum of the quadratic model through the stencil's values; none if it has no minimum."""
    d = len(x)
    if not np.isfinite(f).all():
        return None
    up, down = f[1 : 2 * d + 1 : 2], f[2 : 2 * d + 1 : 2]
    slope, curve = (up - down) / 2, np.diag(up + down - 2 * f[0])
    k = 2 * d + 1
    for i in range(d):
        for j in range(i + 1, d):
            curve[i, j] = curve[j, i] = f[k] - up[i] - up[j] + f[0]
            k += 1
    try:
        np.linalg.cholesky(curve)
    except np.linalg.LinAlgError:
        return None
    step = -np.linalg.solve(curve, slope)
    return x + h * np.clip(step, -100, 100)


def advance(d: int, lower: np.ndarray, upper: np.ndarray):
    """From the scores at a key's points to its next x, steps h, proposal g and score."""

    def one(x: np.ndarray, h: np.ndarray, g: np.ndarray, f: np.ndarray) -> np.ndarray:
        points, f = np.vstack([np.clip(stencil(x, h), lower, upper), g[None]]), np.where(np.isnan(f), math.inf, f)
        best = int(np.argmin(f))
        if math.isfinite(f[best]):
            guess = newton_point(x, h, f[:-1])
            if best == len(points) - 1:  # the proposal of the round before
                h = np.maximum(h * SHRINK, np.minimum(h, np.abs(points[best] - x)))
            else:
                h = h * (GROW if best else SHRINK)
            x = points[best]
            g = np.clip(guess if guess is not None else x, lower, upper)
        else:
            h, g = h * SHRINK, x
        return np.concatenate([x, np.maximum(h, CLOSE * (np.abs(x) + 1)), g, f[best : best + 1]])

    def run(batches):
        names = [f"__{p}{i}" for p in "xhg" for i in range(d)]
        for rows in batches:
            state, f = rows[names].to_numpy(float), rows.filter(regex="^__f").to_numpy(float)
            new = np.array([one(s[:d], s[d : 2 * d], s[2 * d :], v) for s, v in zip(state, f)]).reshape(-1, 3 * d + 1)
            yield rows.drop(columns=[c for c in rows if c.startswith("__f")]).assign(**dict(zip([*names, "__score"], new.T)))

    return run


def minimise(rows: DataFrame, start: DataFrame, keys: list[str], objective: Callable[[list[str]], Column], bounds: list[tuple[float, float]], rounds: int = 24) -> DataFrame:
    """(keys, x array<double>, score): for each key the coefficients x with the least `objective`.

    `start` has keys, x and h (first steps), one row for each key; `objective` makes an aggregate Column from
    the SQL texts of the coefficients. `keys` may hold columns that `rows` lacks, such as the number of one of several
    starts: then all rows of the other keys count for each of them. Each round aggregates the rows once, at all points
    of a stencil around x and at the minimum of the last round's quadratic model; the best point goes on. Only sums are
    shuffled, so a key may hold any share of the rows. Null or NaN scores count as infinite; a key without a finite
    score keeps its start and an infinite score. A key without rows gives no row.
    """
    d, on = len(bounds), [k for k in keys if k in rows.columns]
    lower, upper = (np.array(b, float) for b in zip(*bounds))
    clip = lambda c, i: F.greatest(F.lit(float(lower[i])), F.least(F.lit(float(upper[i])), c))
    x0 = [clip(F.col("x")[i].cast("double"), i) for i in range(d)]
    h0 = [F.col("h")[i].cast("double") for i in range(d)]
    names = [f"__{p}{i}" for p in "xhg" for i in range(d)]
    state = cut_lineage(start.select(*keys, *[c.alias(n) for c, n in zip(x0 + h0 + x0, names)], F.lit(math.inf).alias("__score")))
    size = state.count()

    def at(i: int, sign: int) -> str:
        text = f"(__x{i} {'+' if sign > 0 else '-'} __h{i})" if sign else f"__x{i}"
        text = f"greatest({float(lower[i])}D, {text})" if math.isfinite(lower[i]) else text
        return f"least({float(upper[i])}D, {text})" if math.isfinite(upper[i]) else text

    points = [[at(i, signs.get(i, 0)) for i in range(d)] for signs in stencil_signs(d)] + [[f"__g{i}" for i in range(d)]]
    found = [*[F.first(n).alias(n) for n in names], *[objective(p).alias(f"__f{i}") for i, p in enumerate(points)]]
    step = advance(d, lower, upper)
    open_ = " OR ".join(f"__h{i} > {2 * CLOSE} * (abs(__x{i}) + 1)" for i in range(d))
    for k in range(rounds):
        scored = rows.join(F.broadcast(state) if size <= BROADCAST_KEYS else state, on).groupBy(*keys).agg(*found)
        state = next_state(state, scored, size * len(points), step)
        if (k + 1) % ROUNDS_A_TEST == 0 and k + 1 < rounds and not state.filter(open_).limit(1).count():
            break
    return state.select(*keys, F.array(*[f"__x{i}" for i in range(d)]).alias("x"), F.col("__score").alias("score"))
