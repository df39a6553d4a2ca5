"""Exact top-k inner products with block-at-a-time pruning.

Vectors are laid out in blocks of a document range, each with a forward index (its rows) and the largest and
smallest value of each term (component). For a query the sum of its terms' best products bounds a block. The
blocks of a shard are visited in the order of their bounds, until these fall below the query's k-th score.

1. Rows are range-sorted by a cell, so that blocks are tight, and cut into shards of blocks. Cells come from a few
   levels of residual centres, whose number grows with the rows to about one cell a block.
2. Queries are scored within their own shard, which gives each a first k-th score. They are cut into blocks in the
   order of their shards, so that a block's queries are alike.
3. Query blocks meet the term maxima of groups of shards, many groups a row, then the blocks' maxima of the shards
   in the groups that are left; only pairs in which some query's bound reaches its k-th score go on.
4. These meet the forward indexes and are scored by block, and the results of all shards are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK_ROWS = 128
SHARD_ROWS = 4096
SHARD_BYTES = 64 << 20
#: Shards and query blocks that one task is to score, about.
TASK_BYTES = 32 << 20
QUERY_ROWS = 512
#: Partitions of about four shards in a group, and groups in a page.
GROUP_PARTS = 16
PAGE_GROUPS = 256
#: Rows from which the centres are found, and centres of a level; they only set the order of rows.
SAMPLE_ROWS = 4096
CENTRES = 256
#: Below every score; its negative is an integer, too.
LOWEST = -np.iinfo(np.int64).max


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x): floor(scale * component). Vectors that are null or hold null or non-finite components are dropped."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(whole & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("x"))


def exact(x: np.ndarray, y: np.ndarray) -> bool:
    return float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1]) < 2.0**53


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer products over the components that both have; floats carry them while they stay below 2**53."""
    width = min(x.shape[1], y.shape[1])
    x, y = x[:, :width], y[:, :width]
    return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64) if exact(x, y) else x @ y.T


def cells_of(y: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The cell of each vector: at each level the nearest centre to what the levels before have left over."""
    cell, y = np.zeros(len(y), np.int64), y.astype(np.float64)
    for centres in levels:
        near = np.concatenate([nearest(y[k : k + 1024], centres) for k in range(0, len(y), 1024)])
        cell, y = cell * len(centres) + near, y - centres[near]
    return cell


def place_rows(levels: list[np.ndarray]):
    def run(batches):
        """The place in the order of rows: the cell, for vectors of the centres' width; 0 for others."""
        for batch in batches:
            rows = [np.asarray(r, np.int64) for r in batch.column(1).to_pylist()]
            cell = np.zeros(len(rows), np.int64)
            at = np.flatnonzero([len(r) == levels[0].shape[1] for r in rows])
            if len(at):
                cell[at] = cells_of(np.stack([rows[k] for k in at]), levels)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array(cell), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "width", "cell", "x"])

    return run


SHARDS = "shard long, part long, width long, ids binary, x binary, high binary, low binary"


def cut_shards(block_rows: int, shard_rows: int):
    def run(batches):
        """Rows in order to shards of packed rows of one width; block summaries lie beside them."""
        held: list = []
        part, k = _part(), 0

        def flush():
            ids = np.array([i for i, _ in held], np.int64)
            x = np.stack([np.frombuffer(b, np.int64) for _, b in held])
            starts = np.arange(0, len(ids), block_rows)
            high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
            numbers = [pa.array([v], pa.int64()) for v in ((part << 24) + k, part, x.shape[1])]
            return pa.RecordBatch.from_arrays([*numbers, *(pa.array([v.tobytes()], pa.binary()) for v in (ids, x, high, low))], [c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (len(held) * len(row[1]) >= SHARD_BYTES or len(held) == shard_rows or len(held[0][1]) != len(row[1])):
                    yield flush()
                    held, k = [], k + 1
                held.append(row)
        if held:
            yield flush()

    return run


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Summed term maxima: the most that each query can score in each block."""
    return products(np.maximum(q, 0), high) + products(np.minimum(q, 0), low)


class Best:
    """The k best (score, vec_id) of each query, equal scores by smaller id, kept as sorted rows."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor, self.visited = k, floor, 0
        self.score, self.ids = np.full((n, k), LOWEST), np.full((n, k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        score = np.concatenate([self.score[rows], score], axis=1)
        ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(rows), ids.shape[-1]))], axis=1)
        order = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.score[rows], self.ids[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def search(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, block_rows: int = BLOCK_ROWS) -> Best:
    """Visit each query's blocks in the order of their bounds, all queries of a block at a time."""
    best = Best(len(q_ids), k, floor)
    bound = bounds(q, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    active = np.arange(len(q_ids))
    for turn in range(order.shape[1]):
        active = active[bound[active, order[active, turn]] >= best.kth()[active]]
        if not len(active):
            break
        now = order[active, turn]
        for block in np.unique(now):
            rows = active[now == block]
            part = slice(block * block_rows, (block + 1) * block_rows)
            score = products(q[rows], x[part])
            score[ids[part][None, :] == q_ids[rows][:, None]] = LOWEST  # not the query itself
            best.add(rows, score, ids[part])
            best.visited += len(rows)
    return best


def found_rows(q_ids: np.ndarray, best: Best) -> pd.DataFrame:
    k = best.score.shape[1]
    out = pd.DataFrame({"query_id": np.repeat(q_ids, k), "vec_id": best.ids.ravel(), "score": best.score.ravel()})
    return out[out.score > LOWEST]


def unpacked(row) -> tuple[np.ndarray, ...]:
    ids = np.frombuffer(row.ids, np.int64)
    shape = lambda b: np.frombuffer(b, np.int64).reshape(-1, len(row.x) // 8 // len(ids))
    return ids, shape(row.x), shape(row.high), shape(row.low)


def first_scores(every: int, k: int, block_rows: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                ids, x, high, low = unpacked(row)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    best = search(ids[at], x[at], np.full(len(at), LOWEST), ids, x, high, low, k, block_rows)
                    own = [found_rows(ids[at[i : i + 1]], _one(best, i)) for i in range(len(at))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at]), pa.array(np.full(len(at), row.shard)), pa.array([v.tobytes() for v in x[at]], pa.binary()), pa.array(best.kth()), pa.array([[{"vec_id": v, "score": s} for v, s in zip(f.vec_id.tolist(), f.score.tolist())] for f in own], pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())])))],
                        ["query_id", "shard", "x", "floor", "found"],
                    )

    return run


def _one(best: Best, i: int) -> Best:
    out = Best(1, best.k, best.floor[i : i + 1])
    out.score, out.ids = best.score[i : i + 1], best.ids[i : i + 1]
    return out


def cut_queries(query_rows: int):
    def run(batches):
        """Rows (query_id, shard, x, floor) in order to blocks of queries of one width."""
        held: list = []
        part, k = _part(), 0

        def flush():
            ids, own, x, floor = zip(*held)
            packed = [*(np.array(c, np.int64).tobytes() for c in (ids, own, floor)), b"".join(x)]
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + k]), *(pa.array([c], pa.binary()) for c in packed)], ["chunk", "q_ids", "own", "floor", "q"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) == query_rows or len(held) * len(row[2]) >= SHARD_BYTES or len(held[0][2]) != len(row[2])):
                    yield flush()
                    held, k = [], k + 1
                held.append(row)
        if held:
            yield flush()

    return run


def unpack_queries(row) -> tuple[np.ndarray, ...]:
    ids, own, floor = (np.frombuffer(x, np.int64) for x in (row.q_ids, row.own, row.floor))
    return ids, own, floor, np.frombuffer(row.q, np.int64).reshape(len(ids), -1)


def box_groups(rows: pd.DataFrame) -> pd.DataFrame:
    """The shards of a page and width to the term maxima and minima of each group."""
    rows, width = rows.sort_values("group"), int(rows["width"].iloc[0])
    groups, first = np.unique(rows["group"].to_numpy(np.int64), return_index=True)
    ends = {c: np.stack([f(np.frombuffer(b, np.int64).reshape(-1, width), axis=0) for b in rows[c]]) for c, f in (("high", np.max), ("low", np.min))}
    packed = [groups, np.maximum.reduceat(ends["high"], first), np.minimum.reduceat(ends["low"], first)]
    return pd.DataFrame([[rows["page"].iloc[0], width, *(x.tobytes() for x in packed)]], columns=["page", "width", "groups", "high", "low"])


def reached(q: np.ndarray, floor: np.ndarray, row, width: int) -> np.ndarray:
    """For each query and box of a row whether the bound reaches the query's k-th score."""
    high, low = (np.frombuffer(b, np.int64).reshape(-1, width) for b in (row.high, row.low))
    return bounds(q, high, low) >= floor[:, None]


def promising_groups(batches):
    """Of (page of groups, query block) the groups that some query's bound reaches."""
    for batch in batches:
        for row in batch.to_pandas().itertuples():
            _, _, floor, q = unpack_queries(row)
            groups = np.frombuffer(row.groups, np.int64)[reached(q, floor, row, row.width).any(axis=0)]
            same = lambda v: pa.array(np.full(len(groups), v, np.int64))
            yield pa.RecordBatch.from_arrays([same(row.chunk), pa.array(groups), same(row.width)], ["chunk", "group", "width"])


def promising_shards(batches):
    """Of (shard summary, query block) keep the pairs in which a bound reaches a query's k-th score."""
    for batch in batches:
        keep = []
        for row in batch.to_pandas().itertuples():
            _, own, floor, q = unpack_queries(row)
            keep.append(bool((reached(q, floor, row, row.width).any(axis=1) & (own != row.shard)).any()))
        yield batch.select(["shard", "chunk", "bytes"]).filter(pa.array(keep, pa.bool_()))


def score_pairs(k: int, block_rows: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                q_ids, own, floor, q = unpack_queries(row)
                at = own != row.shard
                out = found_rows(q_ids[at], search(q_ids[at], q[at], floor[at], *unpacked(row), k, block_rows))
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return run


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each row whose vec_id is divisible by `every`, the k other rows with the highest integer inner product.

    `vectors` has vec_id and embedding (floats); components become floor(scale * x). Returns query_id, rank
    (from 1), vec_id, score; equal scores by smaller vec_id; fewer rows where there are fewer candidates.
    Vectors that are null, or hold null or non-finite components, take no part, nor do null ids and empty
    vectors. Every other row is a candidate, repeated vec_ids each by itself; a query's own rows are those of its
    vec_id, and its rows share one result. Vectors of different lengths are multiplied over the components that
    both have. Products must stay within 64 bits. Other columns are ignored. An empty table gives no rows.
    `block_rows`, `shard_rows` and `query_rows` set the sizes of blocks, shards and query blocks, never the result.
    """
    x = quantised(vectors, scale).filter(F.size("x") > 0)
    width = x.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score long"
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    n = x.count()
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    # The sample only sets the order of rows: about SAMPLE_ROWS of the commonest length.
    sample = x.filter((F.size("x") == width[0]["w"]) & (place < int(min(1.0, SAMPLE_ROWS / max(1, n)) * (1 << 30)))).select("x").limit(4 * SAMPLE_ROWS).collect()
    levels = cell_levels(np.array([r.x for r in sample], np.float64).reshape(len(sample), width[0]["w"]), -(-n // block_rows))
    placed = x.mapInArrow(place_rows(levels), "vec_id long, width long, cell long, x binary")
    order = ["width", "cell", "vec_id", "x"]
    parts = max(1, -(-n // (4 * shard_rows)))
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shards = stored(ordered.select("vec_id", "x").mapInArrow(cut_shards(block_rows, shard_rows), SHARDS), "shards")
    first = stored(shards.select("shard", "ids", "x", "high", "low").mapInArrow(first_scores(every, k, block_rows), "query_id long, shard long, x binary, floor long, found array<struct<vec_id:long,score:long>>"), "first")
    by = [F.length("x"), "shard", "query_id"]
    sorted_queries = first.select("query_id", "shard", "x", "floor").repartitionByRange(max(1, -(-first.count() // (4 * query_rows))), *by).sortWithinPartitions(*by)
    queries = stored(sorted_queries.mapInArrow(cut_queries(query_rows), "chunk long, q_ids binary, own binary, floor binary, q binary"), "queries")
    # The stated query set, in blocks, against the groups' maxima, then against the shards' of those that are left.
    grouped = shards.withColumn("group", F.floor(F.col("part") / GROUP_PARTS)).withColumn("page", F.floor(F.col("group") / PAGE_GROUPS))
    boxes = grouped.select("page", "group", "width", "high", "low").groupBy("page", "width").applyInPandas(box_groups, "page long, width long, groups binary, high binary, low binary")
    pages = F.sequence(F.lit(0).cast("long"), F.lit((parts - 1) // (GROUP_PARTS * PAGE_GROUPS)).cast("long"))
    near = stored(queries.withColumn("page", F.explode(pages)).join(boxes, "page").mapInArrow(promising_groups, "chunk long, group long, width long"), "groups")
    summaries = grouped.select("group", "width", "shard", F.length("x").alias("shard_bytes"), "high", "low")
    asked = near.join(summaries, ["group", "width"]).join(queries, "chunk").withColumn("bytes", (F.col("shard_bytes") + F.length("q")).cast("long"))
    pairs = stored(asked.mapInArrow(promising_shards, "shard long, chunk long, bytes long"), "pairs")
    tasks = max(8, (pairs.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES)
    scored = pairs.drop("bytes").join(shards, "shard").join(queries, "chunk").repartition(tasks, "shard", "chunk").select("ids", "x", "high", "low", "q_ids", "own", "floor", "q", "shard")
    scored = scored.mapInArrow(score_pairs(k, block_rows), "query_id long, vec_id long, score long")
    found = first.select("query_id", F.explode("found").alias("f")).select("query_id", "f.vec_id", "f.score").union(scored)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cell_levels(sample: np.ndarray, cells: int) -> list[np.ndarray]:
    """Levels of at most CENTRES centres each, about `cells` cells in all; each level is found on what the ones before leave."""
    levels: list[np.ndarray] = []
    while not levels or cells > 1:
        levels.append(cluster_centres(sample, min(CENTRES, cells, max(1, len(sample) // 8))))
        sample = sample - levels[-1][nearest(sample, levels[-1])]
        cells = -(-cells // CENTRES)
    return levels


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def cluster_centres(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """A few rounds of k-means from evenly taken rows; it only sets the order of rows, never the result."""
    if n <= 1:
        return np.zeros((1, sample.shape[1]))
    centres = sample[:: len(sample) // n][:n].copy()
    for _ in range(rounds):
        of = nearest(sample, centres)
        for c in range(len(centres)):
            if (of == c).any():
                centres[c] = sample[of == c].mean(axis=0)
    return centres


def op2_block_max_topk(spark, sf_dir: str) -> DataFrame:
    """The five best of every row of embeddings for every query."""
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
