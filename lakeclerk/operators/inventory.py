"""Inventory of stored files: snapshots, what changed, files grouped to sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeclerk.sources.listing import listing_options, register_listing

INVENTORY_COLUMNS = ("path", "modified_at", "n_bytes")


def file_inventory(
    spark: SparkSession, path: str | list[str], glob: str | None = None, tasks: int | None = None
) -> DataFrame:
    """All files below ``path``; their content is never read.

    Executors list the folders, see ``sources.listing``: the driver holds the
    names of the first levels of folders and the status of no file. ``tasks``
    is the number of listing tasks, about.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.format(register_listing(spark))
    return reader.options(**listing_options(paths, glob, tasks)).load()


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files ``added``, ``changed`` or ``removed`` between two inventories.

    One full join by path finds all three; paths are unique on each side.
    """
    old = before.select(
        "path", F.col("modified_at").alias("_old_time"), F.col("n_bytes").alias("_old_bytes")
    )
    moved = F.col("modified_at") != F.col("_old_time")
    resized = F.col("n_bytes") != F.col("_old_bytes")
    change = (
        F.when(F.col("_old_bytes").isNull(), F.lit("added"))
        .when(F.col("n_bytes").isNull(), F.lit("removed"))
        .when(moved | resized, F.lit("changed"))
    )
    return (
        old.join(after.select(*INVENTORY_COLUMNS), "path", "full")
        .select("path", change.alias("change"), "modified_at", "n_bytes")
        .filter(F.col("change").isNotNull())
    )


def resource_sets(inventory: DataFrame) -> DataFrame:
    """Part files shown as one asset per table folder.

    ``k=v`` directories at the end of a path belong to the table above them.
    Counts and bytes are summed within each task first, so a set that holds
    most files does not gather them in one task.
    """
    directory = F.regexp_replace("path", r"/[^/]*$", "")
    return (
        inventory.select(
            F.regexp_replace(directory, r"(/[^/=]+=[^/]*)+$", "").alias("resource_set"),
            directory.alias("directory"),
            "modified_at",
            "n_bytes",
        )
        .groupBy("resource_set", "directory")
        .agg(
            F.count("*").alias("n_files"),
            F.sum("n_bytes").alias("n_bytes"),
            F.max("modified_at").alias("modified_at"),
        )
        .groupBy("resource_set")
        .agg(
            F.count("*").alias("n_directories"),
            F.sum("n_files").alias("n_files"),
            F.sum("n_bytes").alias("n_bytes"),
            F.max("modified_at").alias("modified_at"),
        )
    )


# What varies among the files of one asset, the most specific first: the value of
# a k=v folder, a UUID, a hash (which may hold a day), a day, a number.
VARYING = (
    (r"(^|/)([^/=]+)=[^/]*(?=/)", "$1$2={value}"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "{uuid}"),
    (r"(?<![0-9a-zA-Z])[0-9a-f]{16,}(?![0-9a-zA-Z])", "{id}"),
    (
        r"(?<![0-9])(19|20)[0-9]{2}([-_.]?)(0[1-9]|1[0-2])\2(0[1-9]|[12][0-9]|3[01])(?![0-9])",
        "{date}",
    ),
    (r"[0-9]+", "{n}"),
)


def path_pattern(path: Column) -> Column:
    """A path with placeholders for days, identifiers and numbers in any folder or file name."""
    for pattern, placeholder in VARYING:
        path = F.regexp_replace(path, pattern, placeholder.replace("{", r"\{"))
    return path


def pattern_sets(inventory: DataFrame) -> DataFrame:
    """Files whose paths differ only in what varies, shown as one asset.

    For layouts without ``k=v`` folders too: daily folders, numbered part files,
    names with hashes. ``pattern, n_directories, n_files, n_bytes, modified_at``.
    Files are summed by directory and then by pattern, each time within a task
    first, so a set that holds most files does not gather them in one task.
    """
    directory = F.regexp_replace("path", r"/[^/]*$", "")
    return (
        inventory.select(
            path_pattern(F.col("path")).alias("pattern"),
            directory.alias("directory"),
            "modified_at",
            "n_bytes",
        )
        .groupBy("pattern", "directory")
        .agg(
            F.count("*").alias("n_files"),
            F.sum("n_bytes").alias("n_bytes"),
            F.max("modified_at").alias("modified_at"),
        )
        .groupBy("pattern")
        .agg(
            F.count("*").alias("n_directories"),
            F.sum("n_files").alias("n_files"),
            F.sum("n_bytes").alias("n_bytes"),
            F.max("modified_at").alias("modified_at"),
        )
    )
