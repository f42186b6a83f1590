"""Tables written once in the shared folder, to cut lineage and to be read many times.

A written table survives the loss of executors. The folder is the one that
``spark.checkpoint.dir`` names; only a plain local session without that setting
gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local: dict[str, str] = {}  # application id to its own folder


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables; a local session without the setting gets its own."""
    base = spark.conf.get(_SETTING, None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="holdfast-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for table in tables:
        delete(table.sparkSession, table.scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see unused shuffles now, so that their files go before the next step."""
    spark.sparkContext._jvm.System.gc()
