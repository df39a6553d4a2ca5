"""Parameter tables: written by module, model and scenario, read with a check of their columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.guards import require_columns

PARTS = ("module", "model", "scenario")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; only a local master (tests) may do without, and gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        where = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "state") -> DataFrame:
    """`df` written to the shared folder and read again: no later job repeats it, and lost executors do not matter."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the files of a result of `cut_lineage` that nothing reads any more."""
    spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_params(df: DataFrame, root: str, module: str, model: str, scenario: str = "all") -> None:
    """Write a parameter table under `root`, in folders module=, model= and scenario=; a table there is replaced."""
    if clash := set(PARTS) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are named by the folders")
    df.write.mode("overwrite").parquet(f"{root}/module={module}/model={model}/scenario={scenario}")


def read_params(spark: SparkSession, root: str, module: str, *columns: str, model: str | None = None) -> DataFrame:
    """The parameters of one module, for one model or all, which must have `columns`; module, model and scenario are columns."""
    df = spark.read.option("basePath", root).option("mergeSchema", True).parquet(f"{root}/module={module}")
    df = df.filter(F.col("model") == model) if model is not None else df
    return require_columns(df, *columns)
