"""Files of ensemble members, found by their names, and the aerosol series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The parts of a file's name, separated by underscores.
NAME = ("variable", "time_res", "model", "scenario", "member", "resolution")
#: Months that the aerosol series has, from which on it is extended by zeros, up to when.
AEROSOL_FIRST, AEROSOL_LAST = 1850 * 12, 2022 * 12 + 11
AEROSOL_HEADER = 3


def read_members(spark: SparkSession, root: str, extension: str = "parquet", **only: str) -> DataFrame:
    """All files, or folders of part files, {variable}_{time_res}_{model}_{scenario}_{member}_{resolution}.<extension> in `root`, as one table.

    The name's parts become columns. Parts given in `only` are matched on the names, so other files are not
    read. Spark raises if none matches.
    """
    if unknown := set(only) - set(NAME):
        raise ValueError(f"no such parts of a name: {sorted(unknown)}")
    df = spark.read.format(extension).load(f"{root}/" + "_".join(only.get(part, "*") for part in NAME) + f".{extension}")
    stem = F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)\.{extension}(?:/[^/]+)?$", 1)
    parts = F.split(stem, "_")
    return df.select("*", *[parts[i].alias(part) for i, part in enumerate(NAME)])


def read_aerosol_series(spark: SparkSession, path: str, annual: bool = True) -> DataFrame:
    """(year, aod), or (year, month, aod): the `global` column of a text table of months from January 1850 on.

    Columns are separated by blanks and named on the third line; the rows' order is that of the months, and months
    after the last row, up to December 2022, are zero.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    lines = lines.select("line", F.split(F.trim("text"), r"\s+").alias("fields"))
    names = lines.filter(F.col("line") == AEROSOL_HEADER - 1).select("fields").first()
    if names is None or "global" not in names["fields"]:
        raise ValueError("no column named global on the third line")
    at = names["fields"].index("global")
    found = lines.filter((F.col("line") >= AEROSOL_HEADER) & (F.size("fields") > at)).select((F.col("line") - AEROSOL_HEADER + AEROSOL_FIRST).alias("id"), F.col("fields")[at].cast("double").alias("found"))
    months = spark.range(AEROSOL_FIRST, AEROSOL_LAST + 1).join(found, "id", "left")
    months = months.select(F.floor(F.col("id") / 12).alias("year"), (F.col("id") % 12 + 1).alias("month"), F.coalesce("found", F.lit(0.0)).alias("aod"))
    return months.groupBy("year").agg(F.avg("aod").alias("aod")) if annual else months
