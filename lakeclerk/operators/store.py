"""Tables that are replaced as a whole: written in full, then switched by one row.

A Parquet folder cannot be replaced while it is being read, and a job that dies
halfway must leave the old content readable. So new content has a folder of its
own, and one row names the folder of every table. The last KEPT rows and their
folders stay, for readers that began before a switch. One writer per base
at a time. Single partitions are replaced by Spark's own dynamic overwrite.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakeclerk.functions.sizing import local_rows, paths_like, remove_folder
from lakeclerk.sinks.files import even_files, overwrite

KEPT = 10  # versions
SNAPSHOT_DDL = "version bigint, folders map<string,string>"


class Change(NamedTuple):
    """All rows of a table; ``even`` shuffles once more for files of about equal size."""

    df: DataFrame
    partition_by: Sequence[str] = ()
    even: bool = False


def current_folders(spark: SparkSession, base: str) -> tuple[int, dict[str, str]]:
    """The last version and the folder of every table; ``(0, {})`` if there is none."""
    done = paths_like(spark, f"{base}/versions/entry=*/_SUCCESS")
    if not done:
        return 0, {}
    last = max(int(path.split("entry=")[1].split("/")[0]) for path in done)
    row = spark.read.schema(SNAPSHOT_DDL).json(f"{base}/versions/entry={last}").first()
    return last, dict(row["folders"])


def read_table(
    spark: SparkSession, base: str, table: str, schema: str | None = None
) -> DataFrame | None:
    """The current rows of a table, or None before the first version."""
    folder = current_folders(spark, base)[1].get(table)
    if folder is None:
        return None
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(folder)


def publish_tables(
    spark: SparkSession,
    base: str,
    changes: Mapping[str, Change],
    known: tuple[int, dict[str, str]] | None = None,
) -> dict[str, str]:
    """Write all changes, then make them current together; returns all folders.

    The rows may read current tables. A failed run leaves folders no row names;
    the next run takes the same number and replaces them. ``known`` is an
    earlier result of ``current_folders``.
    """
    version, before = known if known is not None else current_folders(spark, base)
    version, folders = version + 1, dict(before)
    for table, change in changes.items():
        folders[table] = f"{base}/{table}/version={version}"
        df = even_files(change.df) if change.even and not change.partition_by else change.df
        overwrite(df, folders[table], partition_by=change.partition_by)
    row = {
        "version": pa.array([version], pa.int64()),
        "folders": pa.array([list(folders.items())], pa.map_(pa.string(), pa.string())),
    }
    log = local_rows(spark, row, SNAPSHOT_DDL)
    log.write.mode("overwrite").json(f"{base}/versions/entry={version}")
    older = [f"{base}/versions/entry={version - KEPT + n}" for n in (0, 1)]
    if paths_like(spark, older[0]):
        # What the next row names no more, no later one does.
        named, still = (
            set(spark.read.schema(SNAPSHOT_DDL).json(entry).first()["folders"].values())
            for entry in older
        )
        for folder in named - still:
            remove_folder(spark, folder)
        remove_folder(spark, older[0])
    return folders


def publish_table(
    df: DataFrame, base: str, table: str, partition_by: Sequence[str] = (), even: bool = False
) -> DataFrame:
    """Replace one table and read it back."""
    publish_tables(df.sparkSession, base, {table: Change(df, partition_by, even)})
    return stored_frame(df, current_folders(df.sparkSession, base)[1][table])


def stored_frame(df: DataFrame, folder: str) -> DataFrame:
    """What was written of ``df``, with its columns in their order."""
    return df.sparkSession.read.schema(df.schema).parquet(folder).select(*df.columns)
