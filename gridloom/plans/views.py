"""The given tables as ensemble data, for Spark and, as the same CTEs, for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAT, LON = "CAST(-72 + 6 * cell_id AS DOUBLE)", "CAST((37 * cell_id) % 360 AS DOUBLE)"

#: A land polygon as edges (x1, y1, x2, y2).
LAND = [(20.0, -65.0, 200.0, -65.0), (200.0, -65.0, 200.0, 50.0), (200.0, 50.0, 110.0, 10.0), (110.0, 10.0, 20.0, 50.0), (20.0, 50.0, 20.0, -65.0)]

#: An island over the date line with a lake over it, and one over the zero meridian; longitudes in the frames that maps use.
ISLANDS = [(150.0, -40.0, -150.0, -40.0), (-150.0, -40.0, -140.0, 30.0), (-140.0, 30.0, 160.0, 40.0), (160.0, 40.0, 150.0, -40.0), (170.0, -20.0, -170.0, -20.0), (-170.0, -20.0, 185.0, 10.0), (185.0, 10.0, 170.0, -20.0)]
ISLANDS += [(-20.0, -10.0, 30.0, -10.0), (30.0, -10.0, 10.0, 40.0), (10.0, 40.0, -20.0, -10.0)]


def whole_orders(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """The orders up to the end of the last whole "year" or "month": the one that the last order's next day begins or lies in, and what follows, is left out."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    after = orders.agg(F.date_add(F.max(F.col("o_orderdate").cast("date")), 1)).scalar()
    return orders.filter(F.col("o_orderdate").cast("date") < F.trunc(after, unit))


def mean_price() -> Column:
    """In units of 10,000. Prices are added up in cents, so that the order of the rows does not matter."""
    return F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / (F.count("o_totalprice") * 1e6)


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual means: scenario, member, year, cell_id, lat, lon, value. Cells are nations, members halves of customers. A last year that is not whole has no annual mean and is left out."""
    orders = whole_orders(spark, sf_dir, "year")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("cell_id"))
    rows = orders.join(customer, "o_custkey").select(
        F.when(F.year("o_orderdate") <= 1997, "historical").when(F.col("o_orderkey") % 2 == 0, "scen_a").otherwise("scen_b").alias("scenario"),
        F.concat(F.lit("r"), F.col("o_custkey") % 2).alias("member"), F.year("o_orderdate").cast("long").alias("year"), "cell_id", "o_totalprice",
    )
    mean = rows.groupBy("scenario", "member", "year", "cell_id").agg(mean_price().alias("value"))
    return mean.select("scenario", "member", "year", "cell_id", F.expr(LAT).alias("lat"), F.expr(LON).alias("lon"), "value")


def monthly(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """Monthly means of the regions: member, year, month, cell_id, value; all whole months, or those of whole years."""
    orders = whole_orders(spark, sf_dir, unit)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("cell_id"))
    rows = orders.join(customer, "o_custkey").join(F.broadcast(nation), "c_nationkey")  # a nation a row: 25
    return rows.groupBy(F.concat(F.lit("r"), F.col("o_custkey") % 2).alias("member"), F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month"), "cell_id").agg(mean_price().alias("value"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long series: week (from 0), value; the mean price of the lines shipped."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) / 7).alias("week"), "l_extendedprice")
    return lines.groupBy("week").agg((F.avg("l_extendedprice") / 1e4).alias("value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("cell_id"))
    return nation.select("cell_id", F.expr(LAT).alias("lat"), F.expr(LON).alias("lon"))


def land(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAND, "x1 double, y1 double, x2 double, y2 double")


def islands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ISLANDS, "x1 double, y1 double, x2 double, y2 double")


MEAN = "CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(o_totalprice) * 1e6::DOUBLE)"
CTE = f"""
WITH RECURSIVE behind AS (SELECT CAST(max(o_orderdate) AS DATE) + 1 AS day FROM orders
), raw AS (
  SELECT o_totalprice, o_orderkey, 'r' || (o_custkey % 2) AS member, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
         CAST(c_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region,
         year(o_orderdate) < (SELECT year(day) FROM behind) AS in_whole_year
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE CAST(o_orderdate AS DATE) < (SELECT date_trunc('month', day) FROM behind)
), ens AS (
  SELECT scenario, member, year, cell_id, {LAT} AS lat, {LON} AS lon, {MEAN} AS value
  FROM (SELECT *, nation AS cell_id, CASE WHEN year <= 1997 THEN 'historical' WHEN o_orderkey % 2 = 0 THEN 'scen_a' ELSE 'scen_b' END AS scenario FROM raw WHERE in_whole_year) GROUP BY ALL
), mon AS (SELECT member, year, month, region AS cell_id, {MEAN} AS value FROM raw GROUP BY ALL
), whole AS (SELECT * FROM mon WHERE year < (SELECT year(day) FROM behind)
), wk AS (SELECT CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7.0) AS BIGINT) AS week, avg(l_extendedprice) / 1e4 AS value FROM lineitem GROUP BY 1
), cell AS (SELECT cell_id, {LAT} AS lat, {LON} AS lon FROM (SELECT CAST(n_nationkey AS BIGINT) AS cell_id FROM nation)
), edges(x1, y1, x2, y2) AS (VALUES {", ".join(map(str, LAND))}
), ref AS (SELECT member, cell_id, avg(value) AS r FROM ens WHERE scenario = 'historical' AND year BETWEEN 1995 AND 1996 GROUP BY ALL
), anom AS (SELECT e.* REPLACE (value - r AS value) FROM ens e JOIN ref USING (member, cell_id)
), gm AS (SELECT scenario, member, year, sum(cos(radians(lat)) * value) / sum(cos(radians(lat))) AS value FROM anom GROUP BY ALL
), em AS (SELECT scenario, year, avg(value) AS value FROM gm GROUP BY ALL
), sp AS (
  SELECT s.scenario, e.member, e.year, e.cell_id, e.value FROM ens e JOIN (SELECT DISTINCT scenario, member FROM ens WHERE scenario <> 'historical') s ON e.member = s.member AND e.scenario = 'historical'
  UNION ALL SELECT scenario, member, year, cell_id, value FROM ens WHERE scenario <> 'historical'
), smp AS (SELECT *, row_number() OVER (ORDER BY scenario, member, year) - 1 AS sample_id FROM (SELECT DISTINCT scenario, member, year FROM ens)
), pooled AS (SELECT * FROM ens JOIN smp USING (scenario, member, year))
"""
