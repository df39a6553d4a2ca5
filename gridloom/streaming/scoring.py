"""Streams: new rows predicted by fitted parameters, and their running means by window of event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.fits import linreg_predict


def read_rows(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = 64) -> DataFrame:
    """A stream of the Parquet files that arrive in `folder`; with None all that are there make one batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(folder)


def arrivals(rows: DataFrame, time: str, staged: str, folder: str, slices: int) -> Iterator[int]:
    """Write `rows` to `folder` in `slices` parts of about equal size, one after the other in the order of `time`, each in as many files as it needs.

    The generator stops after each part, so that a stream may read it: rows of a later part are never older than those of an
    earlier one, and within a part, read as one batch, order does not matter. The rows are sliced once, in `staged`.
    Rows without a time come with the first part.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(micros, [k / slices for k in range(1, slices)], 10_000)).first()[0] or []
    slice_ = sum((F.coalesce((micros >= c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    rows.withColumn("__slice", slice_).write.partitionBy("__slice").parquet(staged)
    sliced = rows.sparkSession.read.schema(StructType([*rows.schema, StructField("__slice", IntegerType())])).parquet(staged)
    for k in range(slices):
        sliced.filter(F.col("__slice") == k).drop("__slice").write.mode("append").parquet(folder)
        yield k


def score_stream(rows: DataFrame, params: DataFrame, keys: list[str], predictors: list[str], target: str) -> DataFrame:
    """Add `predicted` and `residual`. The parameters are a table joined with each batch; rows of unknown keys go."""
    return linreg_predict(rows, params, keys, predictors).withColumn("residual", F.col(target) - F.col("predicted"))


def windowed_means(rows: DataFrame, keys: list[str], time: str, value: str, length: str, lateness: str) -> DataFrame:
    """(window_start, keys, mean, n) by windows of event time; rows later than `lateness` go, and windows end when no more can come."""
    late = rows.withWatermark(time, lateness)
    means = late.groupBy(F.window(time, length), *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return means.select(F.col("window.start").alias("window_start"), *keys, "mean", "n")


def write_rows(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Start a job that writes what has arrived as Parquet, then ends; started again with the same folders it goes on there."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
