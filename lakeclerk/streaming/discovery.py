"""Scans of stored files as streams, each under its own name."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeclerk.functions.sizing import local_rows, paths_like, remove_folder
from lakeclerk.operators.inventory import compare_snapshots
from lakeclerk.sources.listing import listing_options, register_listing

# The two scan levels.
FULL = "Full"
INCREMENTAL = "Incremental"

INVENTORY_DDL = "path string, modified_at timestamp, n_bytes bigint"
CHANGES_DDL = "path string, change string, modified_at timestamp, n_bytes bigint"
SCANS_DDL = "paths array<string>, glob string"


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the micro-batches that are written in full."""
    done = paths_like(spark, f"{folder}/batch=*/_SUCCESS")
    return sorted(int(path.split("batch=")[-1].split("/")[0]) for path in done)


def read_inventory(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The files that the last scan of this name found; empty before the first."""
    folder = f"{base}/{name}/inventory"
    batches = _batches(spark, folder)
    if not batches:
        return spark.createDataFrame([], INVENTORY_DDL)
    return spark.read.schema(INVENTORY_DDL).parquet(f"{folder}/batch={batches[-1]}")


def _declare(spark: SparkSession, folder: str, paths: list[str], glob: str | None) -> None:
    if not paths_like(spark, f"{folder}/scan/_SUCCESS"):
        declaration = {
            "paths": pa.array([paths], pa.list_(pa.string())),
            "glob": pa.array([glob], pa.string()),
        }
        rows = local_rows(spark, declaration, SCANS_DDL)
        rows.write.mode("overwrite").parquet(f"{folder}/scan")
        return
    row = spark.read.schema(SCANS_DDL).parquet(f"{folder}/scan").first()
    if (list(row.paths), row.glob) != (paths, glob):
        raise ValueError(f"scan {folder!r} is of {row.paths} with glob {row.glob!r}")


def publish_listing(files: DataFrame, batch: int, folder: str) -> None:
    """Keep a whole listing as the inventory of a micro-batch, and what it changed.

    Both are folders named after the batch and written anew when a batch is run
    again, so a restart leaves nothing twice. The listing before is compared by
    one join on executors; the one before that goes.
    """
    spark = files.sparkSession
    inventory = f"{folder}/inventory/batch={batch}"
    files.write.mode("overwrite").parquet(inventory)
    after = spark.read.schema(INVENTORY_DDL).parquet(inventory)
    earlier = [number for number in _batches(spark, f"{folder}/inventory") if number < batch]
    before = spark.createDataFrame([], INVENTORY_DDL)
    if earlier:
        before = spark.read.schema(INVENTORY_DDL).parquet(f"{folder}/inventory/batch={earlier[-1]}")
    changes = compare_snapshots(before, after)
    changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")
    for number in earlier[:-1]:
        remove_folder(spark, f"{folder}/inventory/batch={number}")


def scan(
    spark: SparkSession,
    path: str | Sequence[str],
    base: str,
    level: str = INCREMENTAL,
    glob: str | None = None,
    name: str = "default",
    tasks: int | None = None,
) -> DataFrame:
    """Scan ``path`` and keep the inventory of the scan ``name`` below ``base``.

    A full scan returns every file. An incremental one returns what was added,
    changed or removed since the last scan of the same name, of either level;
    the first one has nothing to compare with and reports every file as added.
    Scans of other names do not disturb it. A name stays with its paths and its
    glob: scanning others under it is an error, as all files would seem new.

    A scan is a stream that takes what there is and ends: executors list the
    folders, the checkpoint tells where it was, and the inventory of the last
    micro-batch is in the store. The driver remembers nothing, so a scan that
    died is taken up by the next one, which then returns the changes of both.
    ``tasks`` is the number of listing tasks, about.
    """
    if level not in (FULL, INCREMENTAL):
        raise ValueError(f"level should be {FULL!r} or {INCREMENTAL!r}")
    paths = [path] if isinstance(path, str) else list(path)
    folder = f"{base}/{name}"
    _declare(spark, folder, paths, glob)
    ran: list[int] = []

    def publish(files: DataFrame, batch: int) -> None:
        publish_listing(files, batch, folder)
        ran.append(batch)

    listing = spark.readStream.format(register_listing(spark))
    stream = (
        listing.options(**listing_options(paths, glob, tasks))
        .load()
        .writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(publish)
        .start()
    )
    stream.awaitTermination()
    if level == FULL:
        return read_inventory(spark, base, name)
    found = [f"{folder}/changes/batch={batch}" for batch in ran]
    return spark.read.schema(CHANGES_DDL).parquet(*found).select("path", "change", "modified_at", "n_bytes")
