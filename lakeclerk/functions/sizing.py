"""The shared folder for written intermediate tables, and small local frames."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir``, else the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_folder(spark: SparkSession, purpose: str, work: str | None = None) -> str:
    """A path below ``work`` that no other call uses, by default the shared folder.

    All paths of an application are below one folder, to be removed when it
    has ended.
    """
    application = spark.sparkContext.applicationId
    base = work or f"{shared_folder(spark)}/lakeclerk"
    return f"{base}/{application}/{purpose}-{uuid.uuid4().hex}"


def paths_like(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern of few, from the listing of whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [status.getPath().toString() for status in store.globStatus(path) or []]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store it is; one that is absent is no error."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, purpose: str, work: str | None = None) -> DataFrame:
    """Write ``df`` below the work folder and read it back.

    For a result that several frames go on from: it is computed once, and lost
    executors do not bring its computation back.
    """
    path = new_folder(df.sparkSession, purpose, work)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, columns: dict[str, pa.Array], schema: str) -> DataFrame:
    """A few rows known to the driver, such as a schema or one log entry.

    An Arrow table becomes a local relation: no Python worker starts.
    """
    return spark.createDataFrame(pa.table(columns), schema)
