"""Ranks and weighted selection over many partitions: a range sort parts every key, only slices' totals are ordered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.params import cut_lineage

#: Sums of weights that differ by less count as equal.
EQUAL = 1e-12


def sliced(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """`df` sorted by range and stored, with each row's slice (its partition) and place in it. A key may fill many slices."""
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return cut_lineage(ranged.select("*", F.spark_partition_id().alias("__slice"), place.alias("__place")), label)


def with_slices(ranged: DataFrame, slices: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside what is known of their key's slice."""
    named = slices.withColumnsRenamed({c: f"__of_{c}" for c in [*keys, "__slice"]})
    on = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in [*keys, "__slice"]]
    return ranged.join(named, on).drop(*[f"__of_{c}" for c in [*keys, "__slice"]])


def numbered(df: DataFrame, order: list[str], name: str, keys: list[str] | None = None) -> DataFrame:
    """Add `name`: the row's number, from 0, in the order of `order` (nulls first) within its key, or in all."""
    keys = keys or []
    ranged = sliced(df, keys, order, "numbered")
    counts = ranged.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))  # a row a slice
    slices = counts.withColumn("__before", F.coalesce(before, F.lit(0)) - F.col("__first")).drop("__n", "__first")
    return with_slices(ranged, slices, keys).withColumn(name, (F.col("__before") + F.col("__place")).cast("long")).select(*df.columns, name)


def weighed_slices(df: DataFrame, keys: list[str], value: str, weight) -> tuple[DataFrame, DataFrame]:
    """Distinct values (keys, value, __w) in slices, and of each key's slices the weight in them, before them and in all, and the next slice's first value."""
    each = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.coalesce(F.sum(weight), F.lit(0)).alias("__w"))
    ranged = sliced(each, keys, [value], "values")
    order = Window.partitionBy(*keys).orderBy("__slice")
    slices = ranged.groupBy(*keys, "__slice").agg(F.sum("__w").alias("__own"), F.min(value).alias("__low"))
    before = F.coalesce(F.sum("__own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged, slices.select(*keys, "__slice", "__own", before.alias("__before"), F.sum("__own").over(Window.partitionBy(*keys)).alias("__all"), F.lead("__low").over(order).alias("__after"))


def running(ranged: DataFrame, slices: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of the given slices with __c, the weight up to them, and __next, the value behind them. A task orders one slice of a key."""
    order = Window.partitionBy(*keys, "__slice").orderBy(value)
    sums = F.sum("__w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = with_slices(ranged, slices, keys)
    return rows.withColumn("__c", F.col("__before") + sums).withColumn("__next", F.coalesce(F.lead(value).over(order), F.col("__after")))


def weighted_median(df: DataFrame, keys: list[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """(keys, value): a value above half of all weight wins; else the value after the half, or the mean of both at exactly a half.

    Only the slices around a key's half are looked at closely. Rows with a null value take no part, a null weight is zero.
    """
    ranged, slices = weighed_slices(df, keys, value, F.col(weight).cast("double"))
    half = F.col("__all") / 2
    rows = running(ranged, slices.filter((F.col("__before") - EQUAL <= half) & (F.col("__before") + F.col("__own") >= half - EQUAL)), keys, value)
    found = rows.groupBy(*keys).agg(
        F.max_by(value, F.when(F.col("__w") > half, F.col("__w"))).alias("heavy"),
        F.min(F.when(F.abs(F.col("__c") - half) < EQUAL, (F.col(value) + F.col("__next")) / 2)).alias("middle"),
        F.min(F.when(F.col("__c") > half, F.col(value))).alias("above"),
    )
    return found.select(*keys, F.coalesce("heavy", "middle", "above").alias(value))


def median_nearest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): the element at place (n - 1) / 2, rounded half to even, of a key's values in order; nulls are skipped, a key of nulls is left out."""
    ranged, slices = weighed_slices(df, keys, value, F.lit(1))
    place = F.bround((F.col("__all") - 1) * F.lit(0.5)).cast("long")
    rows = running(ranged, slices.filter((F.col("__before") <= place) & (F.col("__before") + F.col("__own") > place)), keys, value)
    return rows.filter((F.col("__c") > place) & (F.col("__c") - F.col("__w") <= place)).select(*keys, value)
