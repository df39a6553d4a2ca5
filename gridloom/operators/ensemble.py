"""Ensembles: anomalies, weights, means, pooling and alignment of long tables (scenario, member, year, cell_id, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import gaspari_cohn
from ..sources.params import cut_lineage
from .density import MOST_DIMENSIONS, kernel_sums_in_boxes
from .guards import check_aligned
from .order import median_nearest, numbered, weighted_median  # noqa: F401

#: Samples in a block of kernel densities, and cells whose products are made at a time.
BLOCK = 1024


def calc_anomaly(df: DataFrame, first: int, last: int, ref_scenario: str = "historical", value: str = "value") -> DataFrame:
    """Subtract each member's and cell's mean over a reference period of one scenario from all scenarios.

    Raises if the reference has no rows, or if some scenario has a member that the reference lacks.
    """
    inside = (F.col("scenario") == ref_scenario) & F.col("year").between(first, last)
    ref = df.filter(inside).groupBy("member", "cell_id").agg(F.avg(value).alias("__ref"))
    known = df.groupBy("member").agg(F.max(F.coalesce(inside, F.lit(False))).alias("has")).agg(F.max("has"), F.min("has")).first()
    if not known[0]:
        raise ValueError("the reference period is empty")
    if not known[1]:
        raise ValueError("a member is missing in the reference scenario")
    return df.join(ref, ["member", "cell_id"]).withColumn(value, F.col(value) - F.col("__ref")).drop("__ref")


def anomaly_own_ref(df: DataFrame, first: int, last: int, value: str = "value") -> DataFrame:
    """The same on spliced series: each subtracts its own mean over the period."""
    own = F.avg(F.when(F.col("year").between(first, last), F.col(value))).over(Window.partitionBy("scenario", "member", "cell_id"))
    return df.withColumn(value, F.col(value) - own)


def lat_weights(lat):
    """Cosine of the latitude in degrees; a latitude beyond a pole fails the query."""
    return F.when(F.abs(lat) > 90, F.raise_error(F.lit("latitudes must lie within -90 and 90")).cast("double")).otherwise(F.cos(F.radians(lat)))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight) -> DataFrame:
    """Sum of w x over sum of w, both over the rows with a value."""
    return df.groupBy(*keys).agg((F.sum(weight * F.col(value)) / F.sum(F.when(F.col(value).isNotNull(), weight))).alias(value))


def global_mean(df: DataFrame, keys=("scenario", "member", "year"), value: str = "value") -> DataFrame:
    return weighted_mean(df, list(keys), value, lat_weights(F.col("lat")))


def ens_mean(df: DataFrame, keys=("scenario", "year"), value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def scenario_weights(df: DataFrame) -> DataFrame:
    """One over a scenario's number of members, for each scenario, member and year."""
    n = df.groupBy("scenario").agg((1.0 / F.countDistinct("member")).alias("weight"))
    return df.select("scenario", "member", "year").distinct().join(F.broadcast(n), "scenario")


def density_weights(samples: DataFrame, predictors: list[str], block: int = BLOCK) -> DataFrame:
    """Inverse Gaussian kernel density of each sample (sample_id and any number of predictors), normalised to a sum of 1.

    Scott's bandwidth; the kernel's constant cancels. With one or two predictors densities are expanded in boxes a bandwidth
    wide (`density.kernel_sums_in_boxes`), so work grows with the samples. With more, samples are sorted by the first
    whitened predictor into blocks of `block` and blocks meet those in slabs within reach; what lies beyond is below a
    double's precision of the sample's own kernel. Samples with a null take no part.
    """
    d, samples = len(predictors), samples.select("sample_id", *predictors).dropna(subset=predictors)
    stats = samples.agg(F.count("*").alias("n"), *[F.covar_samp(p, q) for p in predictors for q in predictors]).first()
    if stats["n"] < 2:
        return samples.select("sample_id", F.lit(1.0).alias("weight"))
    white = np.linalg.inv(np.linalg.cholesky(np.reshape(stats[1:], (d, d)) * stats["n"] ** (-2.0 / (d + 4)))).tolist()
    reach = float(np.sqrt(2 * np.log(1e17 * stats["n"])))
    z = F.array(*[sum(F.col(p) * w for p, w in zip(predictors, row)) for row in white])
    placed = samples.select("sample_id", z.alias("z"))
    sums = kernel_sums_in_boxes(placed, d, reach, block) if d <= MOST_DIMENSIONS else kernel_sums_in_slabs(placed, d, reach, block)
    each = cut_lineage(sums.select(F.explode(F.arrays_zip("ids", "p")).alias("s")).groupBy(F.col("s.ids").alias("sample_id")).agg((1.0 / F.sum("s.p")).alias("w")), "densities")
    return each.join(F.broadcast(each.agg(F.sum("w").alias("total")))).select("sample_id", (F.col("w") / F.col("total")).alias("weight"))  # one row


def kernel_sums_in_slabs(samples: DataFrame, d: int, reach: float, block: int) -> DataFrame:
    """(ids, p): parts of the sums of kernels at the samples, by pairs of blocks that share a slab of the first component, `reach` wide."""
    kind = samples.schema["sample_id"].dataType.simpleString()
    blocks = samples.repartitionByRange(F.col("z")[0]).sortWithinPartitions(F.col("z")[0])
    blocks = cut_lineage(blocks.mapInPandas(sample_blocks(block, reach), f"block long, slab long, ids array<{kind}>, z array<double>"), "blocks")
    i = blocks.select("slab", "ids", F.col("z").alias("z_i")).withColumn("slab", F.explode(F.sequence(F.col("slab") - 1, F.col("slab") + 1)))
    pairs = i.join(blocks.select("slab", F.col("z").alias("z_j")), "slab")
    return pairs.select("ids", "z_i", "z_j").mapInPandas(kernel_sums(d), f"ids array<{kind}>, p array<double>")


def sample_blocks(size: int, width: float):
    def run(batches):
        """Rows (sample_id, z), sorted, into blocks of one slab of the first component each."""
        part, k = TaskContext.get().partitionId(), 0
        for rows in batches:
            z = np.stack(rows["z"].to_list()) if len(rows) else np.zeros((0, 1))
            slab = np.floor(z[:, 0] / width).astype(np.int64)
            for own in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(slab)) + 1):
                for lo in range(0, len(own), size):
                    at = own[lo : lo + size]
                    yield pd.DataFrame({"block": [(part << 32) + k], "slab": slab[at[0]], "ids": [rows["sample_id"].iloc[at].to_list()], "z": [z[at].ravel()]})
                    k += 1

    return run


def kernel_sums(d: int):
    def run(batches):
        """For each pair of blocks, what the second adds to the density at the first one's samples."""
        for rows in batches:
            out = []
            for ids, a, b in rows.itertuples(index=False):
                gap = np.reshape(a, (-1, 1, d)) - np.reshape(b, (1, -1, d))
                out.append((ids, np.exp(-0.5 * (gap * gap).sum(axis=2)).sum(axis=1)))
            yield pd.DataFrame(out, columns=["ids", "p"])

    return run


def weighted_covariance(df: DataFrame, sample: str = "sample_id", cell: str = "cell_id", value: str = "value", weight: str = "weight", block: int = BLOCK) -> DataFrame:
    """(cell_i, cell_j, cov) from sums that add up over samples: (P - s s / W) / (W - sum of w^2 / W).

    A sample's cells form one vector; each Arrow batch of samples is summed by matrix products before the shuffle, so
    that moves the squared cells once a batch, not once a sample. Rows with a null value or weight take no part; a pair
    counts the samples that hold both cells. A repeated cell of a sample counts once, with its largest value.
    """
    kind = df.schema[cell].dataType.simpleString()
    rows = df.select(F.col(sample).alias("s"), F.struct(F.col(cell).alias("c"), F.col(value).cast("double").alias("x"), F.col(weight).cast("double").alias("w")).alias("v")).dropna(subset=["s"])
    vectors = rows.filter("v.c IS NOT NULL AND v.x IS NOT NULL AND v.w IS NOT NULL").groupBy("s").agg(F.array_sort(F.collect_list("v")).alias("v"))
    names = ["W", "w2", "sx", "sy", "p"]
    schema = f"cell_i {kind}, cells array<{kind}>, " + ", ".join(f"{n} array<double>" for n in names)
    parts = vectors.select("v.c", "v.x", "v.w").mapInPandas(cell_products(block), schema).select("cell_i", F.explode(F.arrays_zip("cells", *names)).alias("t"))
    sums = parts.groupBy("cell_i", F.col("t.cells").alias("cell_j")).agg(*[F.sum(f"t.{n}").alias(n) for n in names])
    return sums.select("cell_i", "cell_j", ((F.col("p") - F.col("sx") * F.col("sy") / F.col("W")) / (F.col("W") - F.col("w2") / F.col("W"))).alias("cov"))


def cell_products(size: int):
    def run(batches):
        """For each batch of samples and each of its cells: the sums over samples of w, w^2, w x, w y and w x y with every cell; `size` cells at a time."""
        for rows in batches:
            cells, at = np.unique(np.concatenate(rows["c"].to_list()), return_inverse=True)
            sample = np.repeat(np.arange(len(rows)), rows["c"].str.len())
            here, x, w = np.zeros((3, len(rows), len(cells)))
            here[sample, at], x[sample, at], w[sample, at] = 1, np.concatenate(rows["x"].to_list()), np.concatenate(rows["w"].to_list())
            for lo in range(0, len(cells), size):
                own, wx = w[:, lo : lo + size].T, (w * x)[:, lo : lo + size].T
                sums = [own @ here, (own * own) @ here, wx @ here, own @ x, wx @ x]
                which = [np.flatnonzero(row) for row in here[:, lo : lo + size].T @ here]
                yield pd.DataFrame({"cell_i": cells[lo : lo + size], "cells": [cells[k] for k in which]} | {n: [row[k] for row, k in zip(m, which)] for n, m in zip(["W", "w2", "sx", "sy", "p"], sums)})

    return run


def pool_samples(df: DataFrame) -> DataFrame:
    """Add sample_id: scenario, member and year in order, year fastest. Only the keys are sorted, not the cells."""
    names = ["scenario", "member", "year"]
    return df.join(numbered(df.select(*names).distinct(), names, "sample_id"), names)


def unpool_samples(df: DataFrame, pooled: DataFrame) -> DataFrame:
    return df.join(pooled.select("sample_id", "scenario", "member", "year").distinct(), "sample_id").drop("sample_id")


def collapse_scenarios(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of all scenarios; columns that some lack are null there."""
    out = None
    for name, df in tables.items():
        df = df.withColumn("scenario", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


#: Scenarios are few and each is a part of the plan; more than this raise.
MOST_SCENARIOS = 200


def map_scenarios(df: DataFrame, function, *args, **kwargs) -> DataFrame:
    """`function(part, *args, **kwargs)` of each scenario's rows, without the column scenario; the results in one table, with it.

    The function takes and returns DataFrames, so a scenario's rows stay spread over the cluster; each part reads only its
    rows of `df`, which should be stored where it is costly. Columns that some results lack are null there. A null scenario
    is one of its own. Scenarios for which the function returns None are left out; it raises where none is left. Of an empty table the
    function sees the empty table.
    """
    names = [r[0] for r in df.select("scenario").distinct().limit(MOST_SCENARIOS + 1).collect()]
    if len(names) > MOST_SCENARIOS:
        raise ValueError(f"more than {MOST_SCENARIOS} scenarios")
    kind, out = df.schema["scenario"].dataType, None
    for name in sorted(names, key=lambda n: (n is None, n if n is not None else "")) or [None]:
        label = F.lit(name).cast(kind)
        part = function(df.filter(F.col("scenario").eqNullSafe(label)).drop("scenario"), *args, **kwargs)
        if part is not None:
            part = part.select(label.alias("scenario"), *[F.col(f"`{c}`") for c in part.columns if c != "scenario"])
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("the function returned None for every scenario")
    return out


def broadcast_predictors(target: DataFrame, predictors: DataFrame) -> DataFrame:
    """Predictors of (scenario, year[, member]) beside every row of the target."""
    return target.join(predictors, [c for c in ("scenario", "year", "member") if c in predictors.columns])


def exact_align(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that raises unless both sides have the same keys."""
    check_aligned(on, {"first": a, "second": b})
    return a.join(b, on)


def align_outer_fill(df: DataFrame, series: DataFrame, column: str, period: tuple[int, int] | None = None) -> DataFrame:
    """A yearly series beside the table's years, 0 where it has none. With a `period` only its years count; without one
    the table must not go beyond the series' years."""
    if period:
        series = series.filter(F.col("year").between(*period))
    else:
        have, known = (t.agg(F.min("year"), F.max("year")).first() for t in (df, series))
        if have[0] is not None and (known[0] is None or have[0] < known[0] or have[1] > known[1]):
            raise ValueError("the data exceed the series; name a period")
    return df.join(series, "year", "left").withColumn(column, F.coalesce(column, F.lit(0.0)))


def matching_historical(df: DataFrame) -> DataFrame:
    """Historical rows of the members that also occur in a later scenario."""
    future = df.filter("scenario <> 'historical'").select("member").distinct()
    return df.filter("scenario = 'historical'").join(future, "member", "left_semi")


def splice_hist_scen(df: DataFrame) -> DataFrame:
    """Continuous series: for each scenario and member the historical rows and its own; members without history go."""
    hist, scen = df.filter("scenario = 'historical'").drop("scenario"), df.filter("scenario <> 'historical'")
    past = scen.select("scenario", "member").distinct().join(hist, "member")
    return past.unionByName(scen.join(hist.select("member").distinct(), "member", "left_semi"))


def smooth_coefficients(coeffs: DataFrame, pairs: DataFrame, radius: float, keys: tuple[str, ...] = ("coeff",), value: str = "value") -> DataFrame:
    """Each cell's coefficient as the median over all cells, weighted by the Gaspari-Cohn correlation at their distance.

    `coeffs` has keys, cell_id and value, `pairs` cell_i, cell_j, km, such as of `near_pairs`: cells at twice the radius
    or more weigh nothing and take no part, so the table need not hold them.
    """
    pairs = pairs.filter(F.col("km") < 2 * radius)
    rows = coeffs.withColumnRenamed("cell_id", "cell_j").join(pairs, "cell_j")
    rows = rows.select(*keys, F.col("cell_i").alias("cell_id"), value, gaspari_cohn(F.col("km") / radius).alias("__weight"))
    return weighted_median(rows, [*keys, "cell_id"], value, "__weight")
