"""Copy a Parquet folder to quoted delimited text."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakeclerk.catalog import Catalog, Job
from lakeclerk.functions.casting import convert
from lakeclerk.sinks.files import merge_files
from lakeclerk.sources.files import check_schema, read_parquet


@dataclass(frozen=True)
class CopyLineage:
    """Where a copy is recorded, and the names of its process, input and output."""

    catalog: Catalog
    process: str
    input_name: str
    output_name: str


def copy_table(
    spark: SparkSession,
    source: str,
    path: str,
    conversions: Mapping[str, str] | None = None,
    allow_truncation: bool = True,
    boolean_as_number: bool = False,
    schema: T.StructType | None = None,
    null_value: str | None = None,
    glob: str | None = None,
    recursive: bool = False,
    n_files: int | None = None,
    extension: str | None = None,
    on_misfit: str = "fail",
    lineage: CopyLineage | None = None,
) -> str:
    """Copy ``source`` with type conversions, partition columns included.

    ``recursive`` copies files at any depth instead, without those columns.

    With a declared ``schema`` a source of other columns or types is an error.

    The output is ``n_files`` text files, or one for each reading task; see
    ``merge_files``. With ``lineage`` both tables are registered and the copy is
    recorded between them. Returns the path.
    """

    def prepare(df: DataFrame) -> DataFrame:
        if schema is not None:
            check_schema(df, schema)
        return convert(df, conversions or {}, allow_truncation, boolean_as_number, on_misfit)

    merge_files(
        spark,
        source,
        path,
        prepare,
        text=True,
        null_value=null_value,
        glob=glob,
        recursive=recursive,
        n_files=n_files,
        extension=extension,
    )
    if lineage is not None:
        read = read_parquet(spark, source, glob=glob, recursive=recursive)
        job = Job(lineage.process, [lineage.input_name], [lineage.output_name])
        frames = {lineage.input_name: read, lineage.output_name: prepare(read)}
        lineage.catalog.record_run(frames, [job])
    return path
