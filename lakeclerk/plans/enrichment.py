"""Two raw tables to clean tables, their join, and the metadata about them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lakeclerk.catalog import Catalog, Job
from lakeclerk.operators.clean import ColumnRule, clean
from lakeclerk.operators.enrich import enrich, unmatched_keys
from lakeclerk.operators.catalog import replace_by_key
from lakeclerk.operators.store import Change, current_folders, publish_tables, stored_frame
from lakeclerk.sinks.files import overwrite, replace_partitions, within


@dataclass(frozen=True)
class EnrichmentResult:
    """The stored tables of one run.

    ``unmatched`` counts the rows of both clean tables that the join left out;
    it is computed when read. ``scanned`` is None without a scan.
    """

    extended: DataFrame
    left: DataFrame
    right: DataFrame
    master: DataFrame
    unmatched: DataFrame
    scanned: DataFrame | None


@dataclass(frozen=True)
class Enrichment:
    """What to keep of two tables, the key that joins them, and their names."""

    name: str
    left_name: str
    left_rules: Sequence[ColumnRule]
    right_name: str
    right_rules: Sequence[ColumnRule]
    on: str
    extended_name: str

    def transform(
        self, left: DataFrame, right: DataFrame
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The joined table and the two clean tables, all lazy."""
        clean_left = clean(left, self.left_rules)
        clean_right = clean(right, self.right_rules)
        return enrich(clean_left, clean_right, self.on), clean_left, clean_right

    def jobs(self) -> list[Job]:
        """The processes of a run: raw to clean twice, the join, the master copy."""
        raw_left, raw_right = f"raw_{self.left_name}", f"raw_{self.right_name}"
        return [
            Job(f"{self.name}_{self.left_name}", [raw_left], [self.left_name]),
            Job(f"{self.name}_{self.right_name}", [raw_right], [self.right_name]),
            Job(self.name, [self.right_name, self.left_name], [self.extended_name]),
            Job(f"{self.name}_master", [self.extended_name], [self.master_name]),
        ]

    @property
    def master_name(self) -> str:
        return f"master_{self.extended_name}"

    def run(
        self,
        left: DataFrame,
        right: DataFrame,
        base: str,
        fmt: str = "parquet",
        scan_level: str | None = None,
        partition_by: Sequence[str] = (),
        partitions: Sequence[str] | None = None,
        n_files: int | None = None,
    ) -> EnrichmentResult:
        """Write the clean and master zones, register them and their lineage.

        Each raw table is read once: the join reads the stored clean tables,
        and the master copy reads the stored join. Every zone switches to its
        new tables at once, so a run that fails leaves the old ones.

        ``partition_by`` are columns of the join that the extended and master
        tables are partitioned by, and a clean table too that has them all. A
        rerun of some ``partitions``, written ``column=value``, replaces these
        in the tables that are partitioned and leaves the others and their
        files as they are; the raw tables then hold what belongs to them. A
        clean table that lacks the columns keeps its rows but for those whose
        key comes again. So after a rerun the clean zone stands for all
        partitions, and so do the keys that the join leaves out. ``n_files`` is
        the number of files of an unpartitioned master table. ``scan_level``
        adds a scan of both zones at the end, under the name of the plan.

        Another ``fmt`` than Parquet overwrites its tables in place and has no
        partitions; the format keeps the old versions itself.
        """
        spark, key = left.sparkSession, self.on
        clean_zone, master_zone = f"{base}/clean", f"{base}/master"
        extended_data = f"{self.extended_name}_data"

        def stored(zone: str, frames: dict[str, DataFrame]) -> list[DataFrame]:
            if fmt != "parquet":
                paths = [overwrite(df, f"{zone}/{name}", fmt) for name, df in frames.items()]
                return [spark.read.format(fmt).load(path) for path in paths]
            known = current_folders(spark, zone)
            keys = {
                name: partition_by if set(partition_by) <= set(df.columns) else ()
                for name, df in frames.items()
            }
            whole, parts = dict(frames), {}
            if partitions is not None:
                parts = {name: df for name, df in frames.items() if keys[name] and name in known[1]}
                whole = {name: df for name, df in frames.items() if name not in parts}
            for name, df in parts.items():
                replace_partitions(df, known[1][name], partition_by, partitions)
            folders = known[1]
            if whole:
                changes = {}
                for name, df in whole.items():
                    if partitions is not None and name in folders:
                        df = replace_by_key(stored_frame(df, folders[name]), df, [key])
                    changes[name] = Change(df, keys[name])
                folders = publish_tables(spark, zone, changes, known)
            return [stored_frame(df, folders[name]) for name, df in frames.items()]

        new_left, new_right = clean(left, self.left_rules), clean(right, self.right_rules)
        clean_left, clean_right = stored(
            clean_zone, {f"{self.left_name}_data": new_left, f"{self.right_name}_data": new_right}
        )
        # A rerun joins what it was given; otherwise the stored tables are that.
        joined = enrich(
            *((clean_left, clean_right) if partitions is None else (new_left, new_right)), key
        )
        (extended,) = stored(clean_zone, {extended_data: joined})
        copied = extended if n_files is None or partition_by else extended.repartition(n_files)
        if partitions is not None:
            copied = within(extended, partitions)
        (master,) = stored(master_zone, {extended_data: copied})
        catalog = Catalog(spark, f"{base}/catalog")
        catalog.define_types()
        catalog.record_run(
            {
                f"raw_{self.left_name}": left,
                f"raw_{self.right_name}": right,
                self.left_name: clean_left,
                self.right_name: clean_right,
                self.extended_name: extended,
                self.master_name: master,
            },
            self.jobs(),
        )
        scanned = None
        if scan_level:
            scanned = catalog.scan([clean_zone, master_zone], scan_level, "*.parquet", self.name)
        unmatched = unmatched_keys(clean_left, clean_right, key)
        return EnrichmentResult(extended, clean_left, clean_right, master, unmatched, scanned)
