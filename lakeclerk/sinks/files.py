"""Writers: replace a table, replace some partitions, quoted text, merged files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from lakeclerk.functions.columns import named
from lakeclerk.functions.sizing import paths_like, remove_folder
from lakeclerk.sources.files import DELIMITER, ESCAPE, QUOTE, read_parquet

# Fixed value: the folder name of a null in a partition column.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def even_files(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Bring rows of one partition together in files of about equal size.

    Without this every task writes a file into every partition it has rows
    for. The hint lets adaptive execution merge small shuffle partitions and
    split large ones, so a value that holds much of the table is written by
    many tasks, and a small table by one.
    """
    return df.hint("rebalance", *partition_by)


def overwrite(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    even: bool = True,
) -> str:
    """Replace the table at ``path`` together with its schema.

    A partitioned table is shuffled for files of about equal size; give
    ``even=False`` when the rows are in order already or the values are few.
    """
    if partition_by and even:
        df = even_files(df, partition_by)
    writer = df.write.format(fmt).mode("overwrite")
    # Whole-table replacement, whatever the session's overwrite mode is.
    writer = writer.option("partitionOverwriteMode", "static")
    if fmt == "delta":
        writer = writer.option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def overwrite_partitions(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    fmt: str = "parquet",
    even: bool = True,
) -> str:
    """Replace only the partitions that occur in ``df``; the others stay."""
    if not partition_by:
        raise ValueError("name the partition columns")
    (
        (even_files(df, partition_by) if even else df)
        .write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .save(path)
    )
    return path


def _is_within(partitions: Sequence[str]) -> Column:
    kept = F.lit(False)
    for partition in partitions:
        same = F.lit(True)
        for part in partition.split("/"):
            name, _, value = part.partition("=")
            if value == NO_VALUE:
                same = same & named(name).isNull()
            else:
                same = same & named(name).cast("string").eqNullSafe(F.lit(unquote(value)))
        kept = kept | same
    return kept


def within(df: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """The rows of some partitions, written ``column=value`` and joined by ``/``."""
    return df.filter(_is_within(partitions))


def replace_partitions(
    df: DataFrame, path: str, partition_by: Sequence[str], partitions: Sequence[str]
) -> str:
    """Replace the named partitions of a stored table by the rows of ``df``.

    A row of another partition fails the job. Spark's dynamic overwrite
    replaces what has rows, when all of them are written; a named partition
    that has no row left goes after that.
    """
    spark = df.sparkSession
    stray = F.raise_error(F.lit(f"rows outside of the partitions {list(partitions)}"))
    kept = {
        name: F.when(_is_within(partitions), named(name)).otherwise(
            stray.cast(df.schema[name].dataType)
        )
        for name in partition_by
    }

    def files(partition: str) -> list[str]:
        folder = f"{path}/{partition}"
        if not paths_like(spark, folder):
            return []
        return sorted(spark.read.schema(df.schema).parquet(folder).inputFiles())

    before = {partition: files(partition) for partition in partitions}
    overwrite_partitions(df.withColumns(kept), path, partition_by)
    for partition, old in before.items():
        if old and files(partition) == old:
            remove_folder(spark, f"{path}/{partition}")
    return path


def _quoted_text(
    writer: DataFrameWriter, quote_all: bool, null_value: str | None
) -> DataFrameWriter:
    writer = (
        writer.mode("overwrite")
        .option("header", True)
        .option("sep", DELIMITER)
        .option("quote", QUOTE)
        .option("escape", ESCAPE)
        .option("quoteAll", quote_all)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if null_value is not None:
        writer = writer.option("nullValue", null_value)
    return writer


def write_csv(
    df: DataFrame,
    path: str,
    quote_all: bool = True,
    null_value: str | None = None,
    file_rows: int | None = None,
) -> str:
    """Write delimited text with a header in every file, one file per task.

    Null and the empty string read back alike unless a ``null_value`` token
    tells them apart on both sides. ``file_rows`` cuts a task's output into
    more files: text with line breaks is read back one file per task.
    """
    writer = _quoted_text(df.write, quote_all, null_value)
    if file_rows:
        writer = writer.option("maxRecordsPerFile", file_rows)
    writer.csv(path)
    return path


def merge_files(
    spark: SparkSession,
    source: str,
    path: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    text: bool = False,
    null_value: str | None = None,
    glob: str | None = None,
    recursive: bool = False,
    n_files: int | None = None,
    extension: str | None = None,
) -> str:
    """Write the stored Parquet table ``source`` anew, to ``n_files`` files if given.

    Rows are dealt evenly over that number of files, whatever the size of the
    table; one file means that one task writes the whole table, which is the
    caller's decision. Without a number every reading task writes its file.
    ``recursive`` takes the files of any folder below ``source``, without
    partition columns. ``extension`` is that of text files.
    """
    df = prepare(read_parquet(spark, source, glob=glob, recursive=recursive))
    if n_files is not None:
        df = df.repartition(n_files)
    if text:
        writer = _quoted_text(df.write, True, null_value)
        if extension:
            writer = writer.option("extension", extension)
        writer.csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path
