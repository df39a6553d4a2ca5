"""Helpers shared by the corpus operators: storage, byte views, prefix sums, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType, IntegralType, LongType, StructField, StructType

#: Ids up to this count are broadcast (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 500_000


#: Paths and tables made by this process, in order; `swept` removes them when nothing reads them any more.
MADE: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master, whose tasks share the driver's disk, may do without."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        where = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    MADE.append(("path", path))
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int, label: str) -> DataFrame:
    """A table that is bucketed by `key`, so that joins on it do not move it again. Its files lie in the shared folder."""
    name = f"{label}_{uuid.uuid4().hex}"
    MADE.append(("table", name))
    df.write.bucketBy(n, key).sortBy(key).option("compression", "uncompressed").option("path", new_path(df.sparkSession, label)).saveAsTable(name)
    return df.sparkSession.table(name)


def swept(df: DataFrame, label: str, since: int) -> DataFrame:
    """Store `df`, then remove what was made from the place `since` in MADE on, all but that result."""
    spark, gone = df.sparkSession, MADE[since:]
    del MADE[since:]
    out = stored(df, label)
    for kind, name in gone:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def toxic_free_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; 1 marks the held-out fold. Null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string or binary column as one byte array, and their n + 1 offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Consecutive document ranges (i, j) of about `most` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def each_text(column: pa.Array, most: int = 4 << 20):
    """The texts of an Arrow column one after the other, as bytes; only about `most` bytes are copied at a time."""
    data, offsets = byte_view(column)
    for i, j in slices(offsets, most):
        base = int(offsets[i])
        part = data[base : offsets[j]].tobytes()
        for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist()):
            yield part[a - base : b - base]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); bijective."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A random 64-bit number for each byte value, the same in every process.
BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


ODD = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    """1, base, ..., base ** n, modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


#: For hashes of byte ranges from running sums: powers of an odd number and of its inverse.
MOST_POWER = 1 << 20
POWERS, INVERSES = powers(ODD, MOST_POWER), powers(pow(ODD, -1, 1 << 64), MOST_POWER)


def range_hashes(keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [begin, end) of at most MOST_POWER keys; equal bytes and lengths give equal hashes."""
    sums = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(keys * POWERS[: len(keys)], out=sums[1:])
    return mix64((sums[end] - sums[begin]) * INVERSES[begin] + (end - begin).astype(np.uint64))


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as the struct `row`; it carries them past added columns of the same names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def local_sums(n_keys: int, value: int):
    """Add to sorted batches the sum of column `value` over the partition's rows before, as long as the first `n_keys` columns stay the same."""

    def run(batches):
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in range(n_keys):
                code = np.asarray(batch.column(k).dictionary_encode(null_encoding="encode").indices)
                new[1:] |= code[1:] != code[:-1]
            first = [batch.column(k)[0].as_py() for k in range(n_keys)]
            new[0] = first != last
            last = [batch.column(k)[-1].as_py() for k in range(n_keys)]
            values = np.asarray(batch.column(value).fill_null(0))
            values = values.astype(np.int64 if values.dtype.kind == "i" else np.float64)
            start = np.flatnonzero(new)
            before = np.cumsum(values) - values + np.where(new.any() and new[0], 0, carried)
            if len(start):
                base = before[start].copy()
                base[start == 0] = 0
                which = np.searchsorted(start, np.arange(batch.num_rows), "right") - 1
                before = before - np.where(which >= 0, base[which], 0)
            carried = before[-1] + values[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "__local"])

    return run


def with_prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, label: str) -> DataFrame:
    """Add `out`: the sum of `value` (long or double) over the rows before, within `keys` (nulls form one key), ordered by `order`.

    Rows are range-sorted by (keys, order) over all partitions; each partition sums its slice of a key as it is
    written, the slices' totals (one row for each key and partition) are prefix-summed and added.
    So a key with a third of all rows is spread over a third of the partitions. `order` should be unique
    within a key, else the order among equals is arbitrary. The ranged table is stored, so that a rerun of a
    lost task finds the same slices.
    """
    by = [F.col(c).asc_nulls_last() for c in keys + order]
    rest = [c for c in df.columns if c not in keys]
    ranged = df.select(*keys, *rest).repartitionByRange(*by).sortWithinPartitions(*by)
    kind = LongType() if isinstance(ranged.schema[value].dataType, IntegralType) else DoubleType()
    schema = StructType([*ranged.schema, StructField("__local", kind)])
    ranged = stored(ranged.mapInArrow(local_sums(len(keys), ranged.columns.index(value)), schema).withColumn("__slice", F.spark_partition_id()), label)
    slots = [*keys, "__slice"]
    totals = ranged.groupBy(*slots).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(slots)], F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__slices_before"))
    totals = stored(totals, f"{label}-slices")
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_IDS else totals  # else the rows, with all that they carry, are shuffled again
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(slots)]
    return ranged.join(totals, on).withColumn(out, F.col("__slices_before") + F.col("__local")).drop("__slice", "__slices_before", "__local", *[f"__k{i}" for i in range(len(slots))])


def only_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of `df` whose `column` occurs in `ids`. A counted small id list is broadcast, a larger one shuffled."""
    ids = ids.select(column).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return df.join(ids, column, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of `df` whose `column` is not in `ids`; null ids stay. A counted small id list is broadcast, a larger one shuffled."""
    ids = stored(ids.select(column).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return df.join(ids, column, "left_anti").select(*df.columns)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component): the smallest node that is reachable over the undirected `edges` (a, b).

    Minimum labels spread along the edges, and each round then also jumps to the label's label, so chains
    shrink by halves. Each round is stored in the shared folder; only a count goes to the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{label}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), f"{label}-0")
    changed, k = 1, 0
    while changed:
        k += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("far"))
        new = step.join(jump, "now", "left").select("node", "was", F.least("now", F.coalesce("far", "now")).alias("component"))
        new = stored(new, f"{label}-{k}")
        changed = new.filter("was <> component").limit(1).count()
        labels = new.drop("was")
    return labels
