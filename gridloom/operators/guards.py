"""Table checks that raise before a fit goes wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def count_not_finite(df: DataFrame, *columns: str) -> DataFrame:
    """One row: how many values of each column are null, NaN or infinite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf"))
    return df.agg(*[F.count_if(bad(c)).alias(c) for c in columns])


def check_finite(df: DataFrame, *columns: str) -> DataFrame:
    found = count_not_finite(df, *columns).first().asDict()
    if any(found.values()):
        raise ValueError(f"not finite: {found}")
    return df


def year_gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose year does not follow the year before in their series; none for annual data."""
    before = F.lag("year").over(Window.partitionBy(*keys).orderBy("year"))
    return df.withColumn("gap", F.col("year") - before).filter("gap <> 1")


def check_annual(df: DataFrame, keys: list[str]) -> DataFrame:
    if year_gaps(df, keys).limit(1).count():
        raise ValueError("the data are not annual")
    return df


def count_beyond(actual: DataFrame, desired: DataFrame, on: list[str], column: str, rtol: float = 1e-7, atol: float = 0.0) -> DataFrame:
    """One row: in how many rows `column` differs by more than atol + rtol * |desired|; rows on one side count."""
    both = actual.select(*on, F.col(column).alias("__a")).join(desired.select(*on, F.col(column).alias("__b")), on, "full")
    far = F.coalesce(F.abs(F.col("__a") - F.col("__b")) > atol + rtol * F.abs("__b"), F.col("__a").isNull() != F.col("__b").isNull(), F.lit(False))
    return both.agg(F.count_if(far).alias("beyond"))


def assert_close(actual, desired, on, column, rtol=1e-7, atol=0.0, allowed_failures: int = 0) -> None:
    n = count_beyond(actual, desired, on, column, rtol, atol).first()[0]
    if n > allowed_failures:
        raise AssertionError(f"{n} values differ, {allowed_failures} may")


def check_aligned(on: list[str], tables: dict[str, DataFrame], unique: set[str] = frozenset()) -> None:
    """Raise unless all tables hold the same keys `on`, none of them null; those in `unique` hold each key once.

    The keys of each table are counted once, and compared by number, sum and exclusive or of their 64-bit hashes: no table is joined
    with another, and a row a table reaches the driver. Tables may repeat keys, such as for each cell.
    """
    keys = None
    for name, table in tables.items():
        own = table.select(F.lit(name).alias("__table"), *on)
        keys = own if keys is None else keys.unionByName(own)
    each = keys.groupBy("__table", *on).agg(F.count("*").alias("__n"))
    missing, code = [F.col(c).isNull() for c in on], F.xxhash64(*on)
    prints = each.groupBy("__table").agg(F.count("*").alias("n"), F.sum(code.cast("decimal(38,0)")).alias("sum"), F.bit_xor(code).alias("xor"), F.max("__n").alias("most"), F.count_if(F.greatest(F.lit(False), *missing)).alias("nulls"))
    found = {r["__table"]: r for r in prints.collect()}
    if nulls := [name for name, r in found.items() if r.nulls]:
        raise ValueError(f"null keys in {nulls}")
    if again := [name for name in unique if name in found and found[name].most > 1]:
        raise ValueError(f"repeated keys in {again}")
    if len({(found[name].n, found[name].sum, found[name].xor) if name in found else None for name in tables}) > 1:
        raise ValueError(f"the tables are not aligned: numbers of keys {({name: found[name].n if name in found else 0 for name in tables})}")


def aligned(target: DataFrame, tables: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """`target` with the column that names each table, from tables (on, column) with each of the target's keys once; else raise."""
    if "target" in tables or (clash := set(tables) & set(target.columns)):
        raise ValueError(f"columns that the target has, or that are named target: {clash if 'target' not in tables else 'target'}")
    check_aligned(on, {"target": target, **tables}, set(tables))
    for name, table in tables.items():
        target = target.join(table.select(*on, name), on)
    return target
