"""Intermediate tables in the shared folder, and Python code on executors."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 2_048  # rows that a task hands to Python together: they are whole texts

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per application.

    Only the driver reads the archive that is made for it; Spark hands it out.
    A session with Spark's own size of batches, 10,000 rows, gets smaller ones:
    a batch is held by the JVM and by Python at a time, in several copies.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(ROWS))
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lakeclerk-code-")) / "lakeclerk_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


def given_back(parts: Iterator) -> Iterator:
    """What a task makes; at its end memory that is free goes back to the system.

    Workers live on between tasks, each beside the JVM's memory and the other
    workers'; the allocators would keep the most that any task of theirs has had.
    """
    try:
        yield from parts
    finally:
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and hasattr(trim := ctypes.CDLL(None), "malloc_trim"):
            trim.malloc_trim(0)


def map_frames(
    df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType
) -> DataFrame:
    """``mapInPandas`` with the package's modules at hand on the executors.

    A pandas column of whole numbers with a null among them is one of floats:
    keys that may be null go through as text.
    """
    ship(df.sparkSession)
    return df.mapInPandas(lambda frames: given_back(run(frames)), schema)


def new_path(spark: SparkSession, purpose: str) -> str:
    """A path of its own below ``spark.checkpoint.dir``, else below the warehouse.

    Both are folders that the driver and all executors see. A run leaves what
    it wrote below one folder per application, to be removed when it has ended.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.sql.warehouse.dir"
    )
    application = spark.sparkContext.applicationId
    return f"{shared.rstrip('/')}/lakeclerk-llm/{application}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once and go on from the files, which cuts its lineage."""
    path = new_path(df.sparkSession, purpose)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def consumed(df: DataFrame) -> None:
    """Remove the folder of a frame made by ``written`` that nothing reads any more.

    Files of shuffles that no frame refers to go as well: Spark removes them
    when the driver's JVM collects garbage, which it does seldom on its own
    while tasks write a lot.
    """
    spark, files = df.sparkSession, df.inputFiles()
    jvm = spark.sparkContext._jvm
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    jvm.System.gc()


def row_name(df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    name = "_row"
    while name in df.columns:
        name += "_"
    return name


def numbered(df: DataFrame, purpose: str, row: str) -> DataFrame:
    """``df`` with a number of its own for every row as ``row``, the same at every reading.

    Rows of stored files are numbered by a hash of their file and their place
    in it, and nothing is written. Where rows have no place, or two numbers are
    equal, the rows are written once with consecutive numbers.
    """
    try:
        place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
        rows = df.withColumn(row, place)
        if rows.groupBy(row).count().where("count > 1").isEmpty():
            return rows
    except AnalysisException:
        pass
    return written(df.withColumn(row, F.monotonically_increasing_id()), purpose)


def map_batches(
    df: DataFrame,
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
) -> DataFrame:
    """``mapInArrow`` likewise: columns that pass through keep every value as it is."""
    ship(df.sparkSession)
    return df.mapInArrow(lambda batches: given_back(run(batches)), schema)


def in_chunks(frame: pd.DataFrame, text: str, size: int) -> Iterator[pd.DataFrame]:
    """Consecutive rows of a batch with about ``size`` characters together.

    A text beyond that size is a chunk of its own, whole.
    """
    begin = total = 0
    for end, length in enumerate(frame[text].str.len().fillna(0).astype(int).tolist()):
        if end > begin and total + length > size:
            yield frame.iloc[begin:end]
            begin, total = end, 0
        total += length
    if begin < len(frame):
        yield frame.iloc[begin:]
