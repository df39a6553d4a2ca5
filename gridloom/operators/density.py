"""Sums of Gaussian kernels by expansions in boxes: work grows with the samples, not with their square."""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.params import cut_lineage

#: Terms of the expansions for each dimension, in boxes one bandwidth wide: the terms left out are below 1e-15 of a kernel's peak.
TERMS = 24
#: More dimensions than these take too many terms.
MOST_DIMENSIONS = 2
INVERSE = 1 / np.array([float(factorial(k)) for k in range(TERMS)])


def hermite(t: float) -> np.ndarray:
    """He_n(t) exp(-t^2 / 2) for n below twice TERMS: up to sign the derivatives of the kernel."""
    out = np.empty(2 * TERMS)
    out[0], out[1] = np.exp(-0.5 * t * t), t * np.exp(-0.5 * t * t)
    for n in range(1, 2 * TERMS - 1):
        out[n + 1] = t * out[n] - n * out[n - 1]
    return out


def moved(offset: int) -> np.ndarray:
    """From a box's moments to the Taylor coefficients at the middle of the box `offset` further on."""
    m, n = np.ogrid[:TERMS, :TERMS]
    return (-1.0) ** m * hermite(float(offset))[m + n]


def powers(z: np.ndarray, box: np.ndarray) -> list[np.ndarray]:
    """For each dimension (z - middle)^k / k!, a row a sample."""
    off = z - (np.asarray(box, float) + 0.5)
    return [np.power(off[:, k, None], np.arange(TERMS)) * INVERSE for k in range(z.shape[1])]


def chunks(d: int, size: int):
    def run(batches):
        """Rows (sample_id, z) into rows (box, ids, z) of up to `size` samples of one box."""
        for rows in batches:
            z = np.reshape(np.concatenate([[], *rows["z"]]), (-1, d))
            box = np.floor(z).astype(np.int64)
            order = np.lexsort(box.T)
            ends = np.flatnonzero((np.diff(box[order], axis=0) != 0).any(axis=1)) + 1
            out = [part[lo : lo + size] for part in np.split(order, ends) for lo in range(0, len(part), size)]
            ids = rows["sample_id"].to_numpy()
            yield pd.DataFrame({f"b{k}": [box[part[0], k] for part in out] for k in range(d)} | {"ids": [list(ids[part]) for part in out], "z": [z[part].ravel() for part in out]})

    return run


def moments(d: int):
    def run(batches):
        """The moments of each chunk, added up by box within a batch."""
        for rows in batches:
            sums: dict[tuple, np.ndarray] = {}
            for *box, z in rows[[*(f"b{k}" for k in range(d)), "z"]].itertuples(index=False):
                p = powers(np.reshape(z, (-1, d)), box)
                own = p[0].sum(axis=0) if d == 1 else p[0].T @ p[1]
                sums[tuple(box)] = sums.get(tuple(box), 0.0) + own
            yield pd.DataFrame({f"b{k}": [b[k] for b in sums] for k in range(d)} | {"m": [v.ravel() for v in sums.values()]})

    return run


def gathered_along(axis: int, d: int):
    """One target's tensor from those of the sources along an axis: as many as boxes lie within reach."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        total = 0.0
        for source, target, m in rows[["source", f"b{axis}", "m"]].itertuples(index=False):
            tensor = np.reshape(m, (TERMS,) * d)
            step = moved(target - source)
            total = total + (step @ tensor if axis == 0 else tensor @ step.T)
        return pd.DataFrame({f"b{k}": [rows[f"b{k}"].iloc[0]] for k in range(d)} | {"m": [total.ravel()]})

    return run


def evaluated(d: int):
    def run(batches):
        for rows in batches:
            out = []
            for *box, ids, z, m in rows[[*(f"b{k}" for k in range(d)), "ids", "z", "m"]].itertuples(index=False):
                p = powers(np.reshape(z, (-1, d)), box)
                out.append((ids, p[0] @ m if d == 1 else ((p[0] @ np.reshape(m, (TERMS, TERMS))) * p[1]).sum(axis=1)))
            yield pd.DataFrame(out, columns=["ids", "p"])

    return run


def kernel_sums_in_boxes(samples: DataFrame, d: int, reach: float, size: int) -> DataFrame:
    """(ids, p): for the samples (sample_id, z of d numbers) the sums over all samples of exp(-|z_i - z_j|^2 / 2).

    Greengard and Strain's transform: each box keeps the moments of its samples; along one dimension after the other these become
    Taylor coefficients in the boxes up to `reach` away; a sample evaluates those of its own box. Every step is keyed by
    box, a target gathers a row for each box within reach, and boxes without samples are left out. Each term is cut at TERMS, which leaves
    an error below 1e-14 of the number of samples within reach; a sum is at least 1, the sample's own kernel.
    """
    kind, keys = samples.schema["sample_id"].dataType.simpleString(), [f"b{k}" for k in range(d)]
    named = ", ".join(f"{k} long" for k in keys)
    parts = cut_lineage(samples.select("sample_id", "z").mapInPandas(chunks(d, size), f"{named}, ids array<{kind}>, z array<double>"), "chunks")
    each = parts.mapInPandas(moments(d), f"{named}, m array<double>").select(*keys, F.posexplode("m").alias("at", "x"))
    sums = each.groupBy(*keys, "at").agg(F.sum("x").alias("x")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda t: t["x"]).alias("m"))  # TERMS^d
    occupied, far = parts.select(*keys).distinct(), int(reach) + 1
    for axis, key in enumerate(keys):
        steps = F.explode(F.sequence(F.col(key) - far, F.col(key) + far))
        sent = sums.select(*[k for k in keys if k != key], F.col(key).alias("source"), steps.alias(key), "m")
        sent = sent.join(occupied.select(*keys[: axis + 1]).distinct(), keys[: axis + 1], "left_semi")
        sums = sent.groupBy(*keys).applyInPandas(gathered_along(axis, d), f"{named}, m array<double>")
    return parts.join(sums, keys).select(*keys, "ids", "z", "m").mapInPandas(evaluated(d), f"ids array<{kind}>, p array<double>")
