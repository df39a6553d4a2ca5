"""Approximate nearest neighbours by a forest of random-projection trees, searched through one shared priority queue.

1. Equal vectors become one class, which keeps its smallest ids: no result needs more of them.
2. A tree parts the rows level by level at a threshold of their projection on a random direction of that level. The upper
   thresholds are medians of a bounded sample, below that the projection of the mean of the node's sample; so a forest of
   any depth fits a broadcast, and every row is routed to its leaf. Leaves that lie together are packed to groves.
3. A query pops the nodes of all trees from one priority queue, in the order of the largest margin by which it missed a
   turn on the way. The number of leaves that it visits is calibrated on a sample of queries with exact answers.
4. Visited leaves meet the queries by grove. The first few give a k-th score, the others send only what reaches it; what
   is sent has its exact score, and the best of all leaves are ranked.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import stored

TREES = 4
#: Rows of a leaf, leaves of a grove (a power of two), most rows of a pack of a grove.
LEAF_ROWS, GROVE_LEAVES, PACK_ROWS = 128, 32, 4096
#: Rows and bytes of the sample of which the forest is fitted, and rows of it for each node of the upper levels.
SAMPLE_ROWS, SAMPLE_BYTES, NODE_ROWS = 65_536, 64 << 20, 16
#: Queries with exact answers, and the share of these that the visited leaves must hold.
CALIBRATION_QUERIES, RECALL = 64, 0.95
#: Leaves visited in the first round; queries that travel together.
FIRST_LEAVES, QUERY_ROWS = 8, 512
SEED = 13


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) without null ids and vectors that are null, zero or hold null or non-finite components."""
    x = F.col("embedding")
    whole = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.filter(whole & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(c, x, ids): each distinct vector once, with its k + 1 smallest ids, each as often as it occurs, at most k times."""
    each = rows.groupBy("x", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    place = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    few = each.withColumn("place", place).filter(F.col("place") <= k + 1)
    members = F.array_sort(F.collect_list(F.struct("vec_id", "copies")))
    ids = F.flatten(F.transform(members, lambda m: F.array_repeat(m["vec_id"], m["copies"])))
    return few.groupBy("x").agg(ids.alias("ids")).select(F.monotonically_increasing_id().alias("c"), "x", "ids")


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of doubles; shorter vectors end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


@dataclass
class Forest:
    """Directions by tree and level, thresholds by tree, upper level and node, and the mean of each upper leaf's sample."""

    radius: float
    depth: int
    directions: np.ndarray
    thresholds: list[list[np.ndarray]]
    means: list[np.ndarray]

    def points(self, x: np.ndarray) -> np.ndarray:
        """On a sphere: one more component makes all rows as long as the longest, so that near and large inner product agree."""
        return np.column_stack((x, np.sqrt(np.maximum(self.radius**2 - (x**2).sum(axis=1), 0))))

    def places(self, q: np.ndarray) -> np.ndarray:
        """Queries, stretched to the sphere's radius."""
        return np.column_stack((q * (self.radius / np.sqrt((q**2).sum(axis=1)))[:, None], np.zeros(len(q))))

    def threshold(self, tree: int, level: int, node):
        top = len(self.thresholds[tree])
        if level < top:
            return self.thresholds[tree][level][node]
        return self.means[tree][node >> (level - top)] @ self.directions[tree, level]

    def leaves(self, points: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for level in range(self.depth):
            node = 2 * node + (points @ self.directions[tree, level] >= self.threshold(tree, level, node))
        return node

    def visits(self, place: np.ndarray, most: int):
        """Up to `most` leaves (tree, leaf) in the order of the shared queue."""
        margin = self.directions @ place
        queue = [(0.0, t, 0, 0) for t in range(len(self.thresholds))]
        while queue and most:
            missed, tree, level, node = heappop(queue)
            while level < self.depth:  # the near side has the same priority, so it comes next
                m = float(margin[tree, level] - self.threshold(tree, level, node))
                heappush(queue, (max(missed, abs(m)), tree, level + 1, 2 * node + (m < 0)))
                node, level = 2 * node + (m >= 0), level + 1
            yield tree, node
            most -= 1


def random_directions(rng: np.random.Generator, depth: int, width: int) -> np.ndarray:
    """Unit vectors, at right angles within each run of `width` levels."""
    parts = [np.linalg.qr(rng.standard_normal((width, min(width, depth - k))))[0].T for k in range(0, depth, width)]
    return np.concatenate(parts) if parts else np.empty((0, width))


def fit_forest(sample: np.ndarray, n: int, radius: float, trees: int, leaf_rows: int) -> Forest:
    """A forest for n rows from a sample of them."""
    depth = max(0, ceil(log2(max(1, n) / leaf_rows)))
    top = min(depth, int(log2(max(1, len(sample) / NODE_ROWS))))
    rng = np.random.default_rng(SEED)
    forest = Forest(radius, depth, np.stack([random_directions(rng, depth, sample.shape[1] + 1) for _ in range(trees)]), [], [])
    points = forest.points(sample)
    for tree in range(trees):
        node, levels = np.zeros(len(points), np.int64), []
        for level in range(top):
            p = points @ forest.directions[tree, level]
            order, size = np.lexsort((p, node)), np.bincount(node, minlength=1 << level)
            middle = np.minimum(np.cumsum(size) - size + size // 2, len(p) - 1)
            levels.append(np.where(size > 0, p[order[middle]], 0.0))
            node = 2 * node + (p >= levels[-1][node])
        forest.thresholds.append(levels)
        size = np.bincount(node, minlength=1 << top)
        sums = np.stack([np.bincount(node, points[:, j], 1 << top) for j in range(points.shape[1])], axis=1)
        forest.means.append(sums / np.maximum(size, 1)[:, None])
    return forest


def grove_of(tree, leaf):
    return (tree << 48) | (leaf // GROVE_LEAVES)


def routed(shared, width: int, kind):
    """Classes (c, x, ids) to one row for each tree."""

    def run(batches):
        forest = shared.value
        for batch in batches:
            x = padded(batch.column(1), width)
            points = forest.points(x)
            packed = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
            for tree in range(len(forest.thresholds)):
                leaf = forest.leaves(points, tree)
                yield pa.RecordBatch.from_arrays([pa.array(grove_of(tree, leaf)), pa.array(leaf), batch.column(0), packed, batch.column(2)], ["grove", "leaf", "c", "x", "ids"])

    return run


def cut_packs(batches):
    """Rows in the order of grove and leaf to packs of one grove."""
    for batch in batches:
        grove = batch.column(0).to_numpy()
        edges = np.append(np.flatnonzero(np.concatenate(([True], grove[1:] != grove[:-1]))) if len(grove) else [], len(grove)).astype(int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            for i in range(a, b, PACK_ROWS):
                part = batch.slice(i, min(PACK_ROWS, b - i))
                ids = pa.array([part.column(4)], pa.list_(part.column(4).type))
                arrays = [pa.array([part.column(k).to_numpy().tobytes()], pa.binary()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([int(grove[i])]), *arrays, pa.array([b"".join(part.column(3).to_pylist())], pa.binary()), ids], ["grove", "leaves", "cs", "x", "ids"])


VISIT = "grove long, queries binary, x binary, kth binary, visitor binary, leaf binary"


def visiting(shared, width: int, begin: int, end: int):
    """Queries (query_id, x, kth), in an order in which neighbours visit like leaves, to VISIT: who comes to which leaves of a grove."""

    def chunk(forest, ids, q, kth):
        who, tree, leaf = [], [], []
        for i, place in enumerate(forest.places(q)):
            for turn, (t, node) in enumerate(forest.visits(place, end)):
                if turn >= begin:
                    who.append(i)
                    tree.append(t)
                    leaf.append(node)
        who, leaf = np.array(who, np.int64), np.array(leaf, np.int64)
        grove = grove_of(np.array(tree, np.int64), leaf)
        order = np.lexsort((leaf, grove))
        who, leaf, grove = who[order], leaf[order], grove[order]
        edges = np.append(np.flatnonzero(np.concatenate(([True], grove[1:] != grove[:-1]))), len(grove)) if len(grove) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            rows, visitor = np.unique(who[a:b], return_inverse=True)
            arrays = (ids[rows], q[rows], kth[rows], visitor.astype(np.int32), leaf[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([int(grove[a])]), *(pa.array([v.tobytes()], pa.binary()) for v in arrays)], ["grove", "queries", "x", "kth", "visitor", "leaf"])

    def run(batches):
        for batch in batches:
            ids, kth, q = batch.column(0).to_numpy(), batch.column(2).to_numpy(), padded(batch.column(1), width)
            for i in range(0, len(ids), QUERY_ROWS):
                j = i + QUERY_ROWS
                yield from chunk(shared.value, ids[i:j], q[i:j], kth[i:j])

    return run


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, components summed in their order: the same wherever a pair meets."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


FOUND = "query_id long, c long, score double, ids array<long>"


def best_pairs(who, row, score, first, q, x, k: int, slack: float):
    """Of pairs with roundly known scores the k best of each query by their exact ones, equals by smaller first id."""
    order = np.lexsort((-score, who))
    who, row, score = who[order], row[order], score[order]
    begin = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
    size = np.diff(np.append(begin, len(who)))
    kth = np.repeat(score[begin + np.minimum(size, k) - 1], size)
    near = score >= kth - slack
    who, row = who[near], row[near]
    score = exact_products(q[who], x[row])
    order = np.lexsort((first[row], -score, who))
    who, row, score = who[order], row[order], score[order]
    begin = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
    keep = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who)))) < k
    return who[keep], row[keep], score[keep]


def scored_leaves(width: int, kind, k: int):
    """Packs joined with their visits to FOUND: up to k classes for each query."""

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            for at, row in enumerate(batch.drop_columns(["ids"]).to_pandas().itertuples()):
                leaves, cs = np.frombuffer(row.leaves, np.int64), np.frombuffer(row.cs, np.int64)
                x = np.frombuffer(row.x, kind).reshape(-1, width).astype(np.float64)
                queries, q = np.frombuffer(row.queries, np.int64), np.frombuffer(row.q, np.float64).reshape(-1, width)
                kth, visitor, leaf = np.frombuffer(row.kth, np.float64), np.frombuffer(row.visitor, np.int32), np.frombuffer(row.leaf, np.int64)
                slack = 1e-9 * float(np.abs(q).max() * np.abs(x).max()) * width
                found = []
                edges = np.append(np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1]))), len(leaf))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    i, j = np.searchsorted(leaves, leaf[a], "left"), np.searchsorted(leaves, leaf[a], "right")
                    if i < j:
                        score = q[visitor[a:b]] @ x[i:j].T
                        who, which = np.nonzero(score >= kth[visitor[a:b], None] - slack)
                        found.append((visitor[a:b][who], which + i, score[who, which]))
                if not sum(len(f[0]) for f in found):
                    continue
                members = lists[at].values
                first = members.flatten().to_numpy()[np.concatenate(([0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))))[:-1].astype(np.int64)]
                who, which, score = best_pairs(*(np.concatenate([f[c] for f in found]) for c in range(3)), first, q, x, k, slack)
                yield pa.RecordBatch.from_arrays([pa.array(queries[who]), pa.array(cs[which]), pa.array(score), members.take(pa.array(which))], ["query_id", "c", "score", "ids"])

    return run


def best_classes(found: DataFrame, k: int) -> DataFrame:
    """FOUND with each class once for a query (it lies in a leaf of each tree), the k best by score and smallest id."""
    once = found.groupBy("query_id", "c").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("ids")[0], "c")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def exact_answers(classes: DataFrame, queries: np.ndarray, width: int, k: int) -> list[np.ndarray]:
    """For each of a few queries the vectors of its k best classes, by scoring all of them; a task sends k a query."""
    shared = classes.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        best, held = [np.empty(0) for _ in queries], [np.empty((0, width)) for _ in queries]
        for batch in batches:
            x = padded(batch.column(0), width)
            score = shared.value @ x.T
            for i in range(len(score)):
                at = np.argpartition(-score[i], k)[:k] if len(x) > k else np.arange(len(x))
                every, rows = np.append(best[i], score[i, at]), np.concatenate((held[i], x[at]))
                order = np.argsort(-every, kind="stable")[:k]
                best[i], held[i] = every[order], rows[order]
        for i in range(len(best)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best[i]), i)), pa.array(best[i]), pa.array(list(held[i]), pa.list_(pa.float64()))], ["q", "score", "x"])

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "x"))
    top = classes.select("x").mapInArrow(run, "q long, score double, x array<double>").withColumn("place", place).filter(F.col("place") <= k).collect()
    return [np.array([r.x for r in top if r.q == i]).reshape(-1, width) for i in range(len(queries))]


def leaves_needed(forest: Forest, queries: np.ndarray, answers: list[np.ndarray], recall: float) -> int:
    """The number of leaves in queue order after which a query has met the share `recall` of its answers, over all queries."""
    turns, total = [], sum(map(len, answers))
    every = len(forest.thresholds) << forest.depth
    for place, found in zip(forest.places(queries), answers):
        codes = [forest.leaves(forest.points(found), t) for t in range(len(forest.thresholds))]
        left = set(range(len(found)))
        for turn, (t, node) in enumerate(forest.visits(place, every), 1):
            met = [i for i in left if codes[t][i] == node]
            turns += [turn] * len(met)
            left.difference_update(met)
            if not left:
                break
    return sorted(turns)[max(0, ceil(recall * total) - 1)] if turns else 1


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """For each row whose vec_id is divisible by `every`, about the k other rows of the largest inner product.

    `vectors` has vec_id and embedding (floats or doubles). Returns query_id, rank (from 1), vec_id and score, the exact
    inner product in doubles; equal scores by smaller vec_id; fewer rows where there are fewer candidates. Vectors that
    are null, empty or zero, or hold null or non-finite components take no part, nor do null ids. Shorter vectors count as
    ended by zeros. Every other row is a candidate, repeated rows as often as they occur; a query's own rows are those
    of its vec_id, which are one query and share one result, a candidate with its best score. Other columns are ignored.
    An empty table gives no rows. Every row is indexed; the forest is fitted on at most `sample_rows` of them, and
    the visited leaves hold the share `recall` of the neighbours of CALIBRATION_QUERIES queries.
    """
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    wide = isinstance(vectors.schema["embedding"].dataType.elementType, DoubleType)
    kind = np.float64 if wide else np.float32
    rows = usable(vectors)
    classes = stored(classes_of(rows, k), "classes")
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    n, width, radius = classes.agg(F.count("*"), F.max(F.size("x")), F.max(length)).first()
    if not n:
        return spark.createDataFrame([], schema)
    most = max(1, min(sample_rows, SAMPLE_BYTES // (8 * width)))
    share = int(min(1.0, most / n) * (1 << 30))
    sample = classes.filter(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < max(1, share)).select("x").limit(2 * most).toArrow()["x"].combine_chunks()
    forest = fit_forest(padded(sample, width), n, radius, trees, leaf_rows)
    shared = spark.sparkContext.broadcast(forest)
    own = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "x").distinct()
    own = stored(own, "queries")
    tried = own.orderBy(F.xxhash64("query_id", "x")).limit(CALIBRATION_QUERIES).select("x").toArrow()["x"].combine_chunks()
    tried = padded(tried, width)
    end = leaves_needed(forest, tried, exact_answers(classes, tried, width, k + 1), recall)
    order = ["grove", "leaf", "c"]
    leafs = classes.mapInArrow(routed(shared, width, kind), "grove long, leaf long, c long, x binary, ids array<long>")
    packs = stored(leafs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut_packs, "grove long, leaves binary, cs binary, x binary, ids array<array<long>>"), "packs")

    def round_of(queries: DataFrame, begin: int, end: int) -> DataFrame:
        order = ["x", "query_id"]
        visits = queries.select("query_id", "x", "kth").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(visiting(shared, width, begin, end), VISIT)
        return packs.join(visits.withColumnRenamed("x", "q"), "grove").mapInArrow(scored_leaves(width, kind, k + 1), FOUND)

    first = min(end, FIRST_LEAVES * trees)
    found = round_of(own.withColumn("kth", F.lit(float("-inf"))), 0, first)
    best = stored(best_classes(found, k + 1), "first")
    if end > first:
        kth = best.filter(F.col("place") == k + 1).select("query_id", F.col("score").alias("kth"))
        rest = round_of(own.join(kth, "query_id", "left").fillna(float("-inf"), ["kth"]), first, end)
        best = best_classes(best.drop("place").union(rest), k + 1)
    each = best.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_projection_forest(spark, sf_dir: str) -> DataFrame:
    """The twenty nearest found of every row of embeddings for every query."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
