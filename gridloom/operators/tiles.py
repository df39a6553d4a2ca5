"""Matrices over cells as tiles: products, Cholesky factors and triangular solves by joins, so that no task holds a whole matrix.

A tile is a row (ids, bi, bj, tile): block row, block column, and its doubles row by row. Of a symmetric matrix only the
tiles of the lower triangle are kept. Cells are numbered from 0 without gaps; block b holds `size` of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.params import cut_lineage, forget

#: Cells of a tile's side (a tile has 2 MB), and samples that are multiplied at a time.
TILE, SAMPLES = 512, 1024


def ddl(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*names).schema) if names else ""


def numbered_cells(cells: DataFrame) -> DataFrame:
    """(cell_id, i): the cells in order, from 0. A table of cells is as long as one side of their matrix."""
    return cut_lineage(cells.select("cell_id").distinct().withColumn("i", (F.row_number().over(Window.orderBy("cell_id")) - 1).cast("long")), "cells")


def tiled(df: DataFrame, ids: list[str], value: str, n: int, size: int, missing: float) -> DataFrame:
    """Tiles of the lower triangle from rows (ids, i, j, value); what no row names is `missing`."""
    blocks = df.select(*ids, F.floor(F.col("i") / size).alias("bi"), F.floor(F.col("j") / size).alias("bj"), (F.col("i") % size).alias("r"), (F.col("j") % size).alias("c"), F.col(value).alias("v")).filter("bi >= bj")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[[0]][[*ids, "bi", "bj"]].copy()
        shape = tuple(min(size, n - int(first[b].iloc[0]) * size) for b in ("bi", "bj"))
        tile = np.full(shape, missing)
        tile[rows["r"], rows["c"]] = rows["v"]
        first["tile"] = [tile.tobytes()]
        return first

    return blocks.groupBy(*ids, "bi", "bj").applyInPandas(build, f"{ddl(df, ids)}bi long, bj long, tile binary")


def square(tile: bytes, b: int, n: int, size: int) -> np.ndarray:
    """A tile of any number of rows whose columns are block b."""
    return np.frombuffer(tile, np.float64).reshape(-1, min(size, n - b * size))


def by_rows(function, ids: int, kind: StructType):
    """A task over batches that replaces each row's last columns by what `function` makes of the row after its ids."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                found = function(*[row.column(c)[0].as_py() for c in range(ids, batch.num_columns)])
                yield pa.RecordBatch.from_arrays([*row.columns[:ids], *[pa.array([v], f.type) for v, f in zip(found, pa_schema(kind, ids))]], kind.names)

    return run


def pa_schema(kind: StructType, begin: int) -> list[pa.Field]:
    names = {"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32()}
    return [pa.field(f.name, names[f.dataType.simpleString()]) for f in kind.fields[begin:]]


def mapped(df: DataFrame, ids: list[str], function, outputs: str) -> DataFrame:
    """`function` of the columns of each row behind `ids`, to the columns `outputs`."""
    kind = StructType([*df.select(*ids).schema, *StructType.fromDDL(outputs)]) if ids else StructType.fromDDL(outputs)
    return df.mapInArrow(by_rows(function, len(ids), kind), kind)


def inverse_lower(l: np.ndarray) -> np.ndarray:
    """Of a lower triangular matrix, by halves."""
    n = len(l)
    if n <= 32:
        return np.linalg.solve(l, np.eye(n)) if n else l
    h = n // 2
    a, c = inverse_lower(l[:h, :h]), inverse_lower(l[h:, h:])
    out = np.zeros_like(l)
    out[:h, :h], out[h:, h:], out[h:, :h] = a, c, -c @ (l[h:, :h] @ a)
    return out


def root_of(tile: np.ndarray, semidefinite: float | None) -> tuple[np.ndarray, np.ndarray]:
    """A tile's Cholesky factor and the inverse of it; not numbers where there is none.

    With `semidefinite`, pivots below that size count as zero, and so do their columns of the factor and rows of the inverse.
    """
    lower = np.tril(tile)
    whole = lower + np.tril(lower, -1).T
    try:
        l = np.linalg.cholesky(whole)
        return l, inverse_lower(l)
    except np.linalg.LinAlgError:
        if semidefinite is None:
            return np.full_like(tile, np.nan), np.full_like(tile, np.nan)
    l, rest = np.zeros_like(whole), whole.copy()
    live = np.ones(len(l), bool)
    for k in range(len(l)):
        if rest[k, k] < -semidefinite:
            raise ValueError("the matrix has negative eigenvalues")
        live[k] = rest[k, k] > semidefinite
        if live[k]:
            l[k:, k] = rest[k:, k] / np.sqrt(rest[k, k])
            rest[k:, k:] -= np.outer(l[k:, k], l[k:, k])
    inverse = np.zeros_like(l)
    inverse[np.ix_(live, live)] = inverse_lower(l[np.ix_(live, live)])
    return l, inverse


def tiled_cholesky(tiles: DataFrame, ids: list[str], n: int, size: int, semidefinite: float | None = None) -> DataFrame:
    """The factor's tiles, of all matrices (ids) at once; block rows beyond the matrix become their solves X L'^-1.

    Block column after block column: the diagonal tile is factorised, the tiles below are solved with it, and the tiles
    to the right lose the products of that column. Each column and each rest is stored, so a lost task repeats one step; a
    rest goes when the next one is stored.
    """
    blocks, done, kind = -(-n // size), None, "bi long, bj long, tile binary"
    for k in range(blocks):
        here = tiles.filter(F.col("bj") == k)

        def factorise(bi, bj, tile, k=k):
            l, inverse = root_of(square(tile, k, n, size), semidefinite)
            return bi, bj, l.tobytes(), inverse.tobytes()

        def solve(bi, bj, tile, inverse, k=k):
            return bi, bj, (square(tile, k, n, size) @ square(inverse, k, n, size).T).tobytes()

        root = cut_lineage(mapped(here.filter(F.col("bi") == k).select(*ids, "bi", "bj", "tile"), ids, factorise, f"{kind}, inverse binary"), "root")
        below = here.filter(F.col("bi") > k).select(*ids, "bi", "bj", "tile")
        inverse = root.select(*ids, "inverse")
        below = mapped(below.join(inverse, ids) if ids else below.crossJoin(inverse), ids, solve, kind)  # one row a matrix
        column = cut_lineage(root.drop("inverse").union(below), "column")
        forget(root)
        done = column if done is None else done.union(column)
        if k + 1 == blocks:
            return done

        def update(bi, bj, tile, left, right, k=k):
            out = square(tile, bj, n, size) - square(left, k, n, size) @ square(right, k, n, size).T
            return bi, bj, out.tobytes()

        left = column.filter(F.col("bi") > k).select(*ids, "bi", F.col("tile").alias("left"))
        right = left.filter(F.col("bi") < blocks).select(*ids, F.col("bi").alias("bj"), F.col("left").alias("right"))
        rest = tiles.filter(F.col("bj") > k).join(left, [*ids, "bi"]).join(right, [*ids, "bj"])
        before, tiles = tiles, cut_lineage(mapped(rest.select(*ids, "bi", "bj", "tile", "left", "right"), ids, update, kind), "rest")
        if k:  # the first rest is the caller's
            forget(before)
    return tiles


def sample_pieces(df: DataFrame, ids: list[str], n: int, size: int, samples: list[str], label: bool) -> DataFrame:
    """(ids, c, b, x, w[, names]): values of the samples of chunk c in block b, a row each, from rows (ids, c, samples, i, value, weight).

    Raises unless each sample has each cell of a block once. With `label` the samples' names come along, as arrays.
    """
    rows = df.withColumn("b", F.floor(F.col("i") / size)).select(*ids, "c", "b", *samples, "i", "value", "weight")
    names = "".join(f", `{s}` array<{df.schema[s].dataType.simpleString()}>" for s in samples) if label else ""

    def build(g: pd.DataFrame) -> pd.DataFrame:
        width = min(size, n - int(g["b"].iloc[0]) * size)
        g = g.sort_values([*samples, "i"], kind="stable")
        if len(g) % width or (g["i"].to_numpy().reshape(-1, width) != np.sort(g["i"].unique())).any() or g["i"].nunique() != width:
            raise ValueError("a sample misses a cell or has one twice")
        out = g.iloc[[0]][[*ids, "c", "b"]].copy()
        out["x"], out["w"] = [g["value"].to_numpy(float).tobytes()], [g["weight"].to_numpy(float)[::width].tobytes()]
        for s in samples if label else []:
            out[s] = [g[s].to_list()[::width]]
        return out

    return rows.groupBy(*ids, "c", "b").applyInPandas(build, f"{ddl(df, ids)}c long, b long, x binary, w binary{names}")


def paired(pieces: DataFrame, blocks: int) -> DataFrame:
    """Each piece as the first (role 0), the second (role 1) or both factors of the tiles that it belongs to."""
    other = pieces.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return other.withColumns({"bi": F.greatest("b", "o"), "bj": F.least("b", "o"), "role": (F.col("b") < F.col("o")).cast("int")}).drop("b", "o")


GRAM = "bi long, bj long, n long, mass double, squares double, sums binary, other binary, tile binary"


def gram_tiles(pieces: DataFrame, ids: list[str], n: int, size: int) -> DataFrame:
    """Tiles of the sums over samples of w x x', with the samples' number, the sums of w and w^2, and of w x for rows and columns.

    The pieces of a tile meet in the order of their chunks, so a task holds two pieces and one tile.
    """
    kind = StructType([*(pieces.select(*ids).schema if ids else []), *StructType.fromDDL(GRAM)])
    order = [*ids, "bi", "bj", "c", "role"]
    dealt = paired(pieces, -(-n // size)).select(*order, "x", "w").repartition(*order[:-2]).sortWithinPartitions(*order)

    def run(batches):
        key, first, total, held = None, None, None, None

        def done():
            return pa.RecordBatch.from_arrays([*held, *[pa.array([v], f.type) for v, f in zip((key[-2], key[-1], total[0], total[1], total[2], total[3].tobytes(), total[4].tobytes(), total[5].tobytes()), pa_schema(kind, len(ids)))]], kind.names)

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                own = [row.column(c)[0].as_py() for c in range(batch.num_columns)]
                at, (role, x, w) = tuple(own[: len(ids) + 2]), own[-3:]
                if at != key:
                    if key is not None:
                        yield done()
                    key, total, held = at, None, row.columns[: len(ids)]
                x = square(x, at[-2] if role == 0 else at[-1], n, size)
                if at[-2] != at[-1] and role == 0:
                    first = x
                    continue
                w, x0 = np.frombuffer(w, np.float64), x if at[-2] == at[-1] else first
                part = [len(w), w.sum(), w @ w, w @ x0, w @ x, (x0 * w[:, None]).T @ x]
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if key is not None:
            yield done()

    return dealt.mapInArrow(run, kind)


def products_with(pieces: DataFrame, factor: DataFrame, samples: list[str], chunks: int, n: int, size: int) -> DataFrame:
    """(samples, i, value): each sample's values times L', from the pieces (c, b, x, samples), c below `chunks`, and the tiles of L (bi, bj, tile).

    The factors of an output piece meet in the order of their blocks, so a task holds two pieces and one tile.
    """
    blocks, kinds = -(-n // size), [pieces.schema[s].dataType for s in samples]
    schema = StructType([*[StructField(s, k.elementType) for s, k in zip(samples, kinds)], *StructType.fromDDL("i long, value double")])
    upto = lambda low, most: F.explode(F.sequence(low, F.lit(most - 1).cast("long")))
    right = pieces.select("c", upto(F.col("b"), blocks).alias("bi"), F.col("b").alias("bj"), F.lit(0).alias("role"), F.col("x").alias("data"), *samples)
    left = factor.select(upto(F.lit(0).cast("long"), chunks).alias("c"), "bi", "bj", F.lit(1).alias("role"), F.col("tile").alias("data"), *[F.lit(None).cast(k).alias(s) for s, k in zip(samples, kinds)])
    order = ["c", "bi", "bj", "role"]
    dealt = right.union(left).repartition("c", "bi").sortWithinPartitions(*order)

    def run(batches):
        key, total, x, names = None, None, None, None

        def done():
            i = key[1] * size + np.arange(total.shape[1])
            return pa.RecordBatch.from_arrays([*[v.take(pa.array(np.repeat(np.arange(len(total)), len(i)))) for v in names], pa.array(np.tile(i, len(total))), pa.array(total.ravel())], schema.names)

        for batch in batches:
            for k in range(batch.num_rows):
                c, bi, bj, role, data = (batch.column(j)[k].as_py() for j in range(5))
                if (c, bi) != key:
                    if total is not None:
                        yield done()
                    key, total, x = (c, bi), None, None
                if role == 0:
                    x, own = (bj, square(data, bj, n, size)), [batch.column(5 + j)[k].values for j in range(len(samples))]
                    if total is not None and any(not a.equals(b) for a, b in zip(own, names)):
                        raise ValueError("a sample misses a cell")
                    names = own
                elif x and x[0] == bj:
                    part = x[1] @ square(data, bj, n, size).T
                    total = part if total is None else total + part
        if total is not None:
            yield done()

    return dealt.mapInArrow(run, schema)
