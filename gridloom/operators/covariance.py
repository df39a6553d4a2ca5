"""Localised covariances: radius by cross-validation, and Cholesky factors, on tiles of the matrices.

No task holds more of a matrix than a few tiles, so a grid may have any number of cells. A matrix that fits one tile
takes one step; then all radii, folds and keys are factorised in one job. Larger ones try one radius after the other, until
the score rises.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.params import cut_lineage
from .fits import first_local_minimum
from .guards import aligned
from .tiles import SAMPLES, TILE, ddl, gram_tiles, mapped, numbered_cells, sample_pieces, square, tiled, tiled_cholesky

#: Of a matrix beyond one tile that is not positive definite: pivots up to this part of the largest variance count as zero.
SEMIDEFINITE = 1e-10


def correlations(r: np.ndarray) -> np.ndarray:
    """`gaspari_cohn` of an array."""
    r = np.abs(r)
    near = 1 - 5 / 3 * r**2 + 5 / 8 * r**3 + 0.5 * r**4 - 0.25 * r**5
    with np.errstate(divide="ignore", invalid="ignore"):
        far = 4 - 5 * r + 5 / 3 * r**2 + 5 / 8 * r**3 - 0.5 * r**4 + r**5 / 12 - 2 / (3 * r)
    return np.where(r < 1, near, np.where(r < 2, far, 0.0))


def numbered_pairs(distances: DataFrame, cells: DataFrame) -> DataFrame:
    """(i, j, and the other columns) of the pairs whose cells both have a number."""
    i, j = (cells.select(F.col("cell_id").alias(f"cell_{k}"), F.col("i").alias(k)) for k in "ij")
    return distances.join(i, "cell_i").join(j, "cell_j")


class Prepared:
    """The tiles that every radius needs: covariances of all samples (fold -1) and of all but a fold, distances, and samples by fold."""

    def __init__(self, df: DataFrame, distances: DataFrame, folds: int, keys: list[str], size: int):
        self.keys, self.size, self.cells = keys, size, numbered_cells(df)
        self.n = self.cells.count()
        self.blocks = -(-self.n // size)
        rows = df.join(self.cells, "cell_id").withColumn("fold", F.pmod("sample_id", F.lit(folds)).cast("int")).withColumn("c", F.floor(F.col("sample_id") / (folds * SAMPLES)))
        self.ids = [*keys, "fold"]
        self.pieces = cut_lineage(sample_pieces(rows.select(*self.ids, "c", "sample_id", "i", F.col("value").cast("double").alias("value"), F.col("weight").cast("double").alias("weight")), self.ids, self.n, size, ["sample_id"], False), "pieces")
        self.grams = cut_lineage(gram_tiles(self.pieces, self.ids, self.n, size), "folds")
        self.covariances = cut_lineage(self.covariance_tiles(), "covariances")
        pairs = numbered_pairs(distances.select("cell_i", "cell_j", F.col("km").cast("double").alias("km")).filter("km IS NOT NULL"), self.cells)
        self.km = cut_lineage(tiled(pairs, [], "km", self.n, size, math.inf), "distances")

    def covariance_tiles(self) -> DataFrame:
        names, n, size = self.keys, self.n, self.size

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            parts = [(r.mass, r.squares, np.frombuffer(r.sums, np.float64), np.frombuffer(r.other, np.float64), square(r.tile, r.bj, n, size)) for r in rows.itertuples()]
            total, out = [sum(v) for v in zip(*parts)], []
            for fold, part in [(-1, [0.0] * 5), *zip(rows["fold"], parts)]:
                mass, squares, s, o, p = (a - b for a, b in zip(total, part))
                with np.errstate(all="ignore"):
                    out.append((fold, ((p - np.outer(s, o) / mass) / (mass - squares / mass)).tobytes()))
            first = rows.iloc[[0] * len(out)][[*names, "bi", "bj"]].copy()
            first["fold"], first["tile"] = [f for f, _ in out], [t for _, t in out]
            return first

        return self.grams.groupBy(*names, "bi", "bj").applyInPandas(build, f"{ddl(self.grams, names)}bi long, bj long, fold int, tile binary")

    def scores(self, radii: list[float]) -> DataFrame:
        """(keys, radius, score): a fold's samples under a zero-mean normal with the other folds' localised covariance, summed over folds."""
        n, size, blocks, ids = self.n, self.size, self.blocks, [*self.ids, "radius"]
        at = F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("radius")
        own = self.covariances.filter("fold >= 0").join(self.km.withColumnRenamed("tile", "km"), ["bi", "bj"]).select(*self.ids, at, "bi", "bj", "tile", "km")
        local = lambda radius, bi, bj, tile, km: (radius, bi, bj, (square(tile, bj, n, size) * correlations(square(km, bj, n, size) / radius)).tobytes())
        matrix = mapped(own, self.ids, local, "radius double, bi long, bj long, tile binary")
        rooted = lambda radius, bi, bj, x, w: (radius, bi, bj, (square(x, bj, n, size) * np.sqrt(np.frombuffer(w, np.float64))[:, None]).tobytes())
        samples = self.pieces.select(*self.ids, at, (F.col("c") + blocks).alias("bi"), F.col("b").alias("bj"), "x", "w")
        samples = mapped(samples, self.ids, rooted, "radius double, bi long, bj long, tile binary")
        factor = tiled_cholesky(cut_lineage(matrix.union(samples), "localised"), ids, n, size)

        def sums(bi, bj, tile):
            x = square(tile, bj, n, size)
            with np.errstate(all="ignore"):
                return float(2 * np.log(np.diag(x)).sum()) if bi == bj else 0.0, float((x * x).sum()) if bi >= blocks else 0.0

        parts = mapped(factor.select(*ids, "bi", "bj", "tile"), ids, sums, "det double, trace double").groupBy(*ids).agg(F.sum("det").alias("det"), F.sum("trace").alias("trace"))
        fold = self.grams.filter("bi = 0 AND bj = 0").select(*self.ids, "n", "mass")
        nll = 0.5 * (n * math.log(2 * math.pi) + F.col("det") + F.col("trace") / F.col("mass")) * F.col("n")
        each = parts.join(fold, self.ids).select(*self.keys, "radius", F.nanvl(nll, F.lit(math.inf)).alias("nll"))
        return cut_lineage(each.groupBy(*self.keys, "radius").agg(F.sum("nll").alias("score")), "scores")

    def searched(self, radii: list[float]) -> DataFrame:
        """Scores of the radii, going up, until they rise for all keys."""
        radii, out = sorted(set(radii)), None
        for part in [radii] if self.blocks == 1 else [[r] for r in radii]:
            new = self.scores(part)
            if out is not None:
                last = out.groupBy(*self.keys).agg(F.max_by("score", "radius").alias("last"))
                rising = new.join(last, self.keys) if self.keys else new.crossJoin(last)  # a row a key
                out = out.union(new)
                if not rising.filter("score <= last").limit(1).count():
                    return out
            out = new if out is None else out
        return out


def radius_scores(df: DataFrame, distances: DataFrame, radii: list[float], k_folds: int, keys: list[str] | None = None, size: int = TILE) -> DataFrame:
    """(keys, radius, score): the cross-validated negative log-likelihood of each localisation radius; see `localized_covariance`."""
    return Prepared(df, distances, k_folds, keys or [], size).scores(radii)


def localized_covariance(df: DataFrame, distances: DataFrame, radii: list[float], k_folds: int, keys: list[str] | None = None, size: int = TILE) -> DataFrame:
    """(keys, radius, cell_i, cell_j, cov, localized): the covariance of cells over samples and, times the Gaspari-Cohn
    correlation at the chosen radius, localised.

    `df` has (keys, sample_id, cell_id, value, weight), samples of a key numbered from 0 without
    gaps, every sample with every cell; `distances` (cell_i, cell_j, km), where pairs that lie beyond every radius' reach may be left out.
    The radius is the first local minimum, going up, of the negative log-likelihood (mean zero) of each k-th sample under the
    others' localised covariance. Matrices that cannot be factorised count as infinite, and a key with no finite score
    raises. Folds are summed once, by tiles of `size` cells a side. Keys make separate fits, such as `["month"]`. An
    empty table gives no rows.
    """
    keys = keys or []
    if not df.limit(1).count():
        kinds = ddl(df, keys)
        return df.sparkSession.createDataFrame([], f"{kinds}radius double, cell_i long, cell_j long, cov double, localized double")
    at = Prepared(df, distances, k_folds, keys, size)
    best = first_local_minimum(at.searched(radii), keys=keys).drop("score")
    total = at.covariances.filter("fold = -1").join(at.km.withColumnRenamed("tile", "km"), ["bi", "bj"])
    rows, n = total.join(best, keys) if keys else total.crossJoin(F.broadcast(best)), at.n  # one row
    return unrolled(rows, [*keys, "radius"], ["cov", "localized"], at.cells, n, size, lambda r, bj: (x := square(r["tile"], bj, n, size), x * correlations(square(r["km"], bj, n, size) / r["radius"])))


def localized_covariance_tables(samples: DataFrame, weights: DataFrame, distances: DataFrame, on: list[str], radii: list[float], k_folds: int, keys: list[str] | None = None, size: int = TILE) -> DataFrame:
    """`localized_covariance` of samples without weights and a table of weights (on, weight), which must hold the samples' keys `on`, each once; else raise."""
    return localized_covariance(aligned(samples, {"weight": weights}, on), distances, radii, k_folds, keys, size)


def unrolled(tiles: DataFrame, ids: list[str], names: list[str], cells: DataFrame, n: int, size: int, values, mirrored: bool = True) -> DataFrame:
    """Tiles to rows (ids, cell_i, cell_j, names); those below the diagonal also the other way round."""
    schema = f"{ddl(tiles, ids)}i long, j long, {', '.join(f'{c} double' for c in names)}"

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = batch.iloc[k]
                found = values(row, row["bj"])
                i, j = (v.ravel() for v in np.indices(found[0].shape))
                i, j = i + row["bi"] * size, j + row["bj"] * size
                for a, b in ((i, j), (j, i)) if mirrored and row["bi"] != row["bj"] else ((i, j),):
                    out = pd.DataFrame({"i": a, "j": b} | {c: v.ravel() for c, v in zip(names, found)})
                    for c in ids:
                        out[c] = row[c]
                    yield out[[*ids, "i", "j", *names]]

    i, j = (cells.select(F.col("cell_id").alias(f"cell_{k}"), F.col("i").alias(k)) for k in "ij")
    return tiles.mapInPandas(run, schema).join(i, "i").join(j, "j").select(*ids, "cell_i", "cell_j", *names)


def covariance_factor(cov: DataFrame, keys: list[str] | None = None, size: int = TILE) -> DataFrame:
    """(keys, cell_i, cell_j, value): a root L of each covariance, L L' = cov, for `correlate_noise`; rows of zeros are left out.

    The Cholesky factor. Where there is none, a matrix of up to `size` cells takes the eigenvectors times the roots of the
    eigenvalues (negative ones as zero); a larger one counts pivots of nearly zero as zero, and raises at negative ones.
    """
    keys, cells = keys or [], numbered_cells(cov.select(F.col("cell_i").alias("cell_id")))
    n = cells.count()
    tiles = cut_lineage(tiled(numbered_pairs(cov.select(*keys, "cell_i", "cell_j", F.col("cov").cast("double").alias("cov")), cells), keys, "cov", n, size, 0.0), "tiles")
    if n <= size:

        def root(bi, bj, tile):
            m = square(tile, 0, n, size)
            try:
                return bi, bj, np.linalg.cholesky(m).tobytes()
            except np.linalg.LinAlgError:
                vectors = np.linalg.eigh(m)
                return bi, bj, (vectors[1] * np.sqrt(np.maximum(vectors[0], 0))).tobytes()

        factor = mapped(tiles.select(*keys, "bi", "bj", "tile"), keys, root, "bi long, bj long, tile binary")
    else:
        most = cov.filter("cell_i = cell_j").agg(F.max("cov")).first()[0] or 0.0
        factor = tiled_cholesky(tiles, keys, n, size, SEMIDEFINITE * most)
    return unrolled(factor, keys, ["value"], cells, n, size, lambda r, bj: (square(r["tile"], bj, n, size),), mirrored=False).filter("value <> 0")
