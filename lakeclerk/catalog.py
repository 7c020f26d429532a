"""A stored catalogue: the catalogue operators over tables below one path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeclerk.functions import identity as ids
from lakeclerk.functions.sizing import local_rows, written
from lakeclerk.operators import catalog as ops
from lakeclerk.operators import lineage as lineage_ops
from lakeclerk.operators import profile as profile_ops
from lakeclerk.operators.inventory import resource_sets
from lakeclerk.operators.store import Change, current_folders, publish_tables
from lakeclerk.sinks.files import within
from lakeclerk.streaming.discovery import INCREMENTAL, read_inventory, scan

TABLE_SCHEMAS = {
    "entities": ops.ENTITIES_DDL,
    "columns": ops.COLUMNS_DDL,
    "relationships": ops.RELATIONSHIPS_DDL,
    "lineage_edges": lineage_ops.EDGES_DDL,
    "type_defs": ops.TYPE_DEFS_DDL,
    # The definitions with what they inherit, as entities are checked against them.
    "type_rules": ops.TYPE_DEFS_DDL,
    "column_sketches": f"guid string, table_guid string, {profile_ops.SKETCHES_DDL}",
}
# The last version, and the folders of its tables.
Known = tuple[int, dict[str, str]]


class Recorded(NamedTuple):
    """References that were not found, and processes that break a rule of their type.

    Neither kind of process was stored, nor any edge of one.
    """

    unresolved: DataFrame
    rejected: DataFrame


class Job(NamedTuple):
    """What one process reads and writes, by table name."""

    name: str
    inputs: Sequence[str]
    outputs: Sequence[str]


class Catalog:
    """Entities, columns, relationships, lineage edges and type definitions.

    A change writes the tables it touches anew, and all of them become current
    together; readers keep the version they started with, until two changes
    later. One writer at a time.
    """

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        table_scheme: str = ids.TABLE_SCHEME,
        process_scheme: str = ids.PROCESS_SCHEME,
    ):
        self.spark = spark
        self.base = base
        self.work = f"{base}/work"
        self.table_scheme = table_scheme
        self.process_scheme = process_scheme

    # ------------------------------------------------------------- tables

    def _read(self, known: Known, table: str) -> DataFrame:
        ddl, folder = TABLE_SCHEMAS[table], known[1].get(table)
        if folder is None:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(folder)

    def read(self, table: str) -> DataFrame:
        """The current version of a table, empty before the first one."""
        return self._read(current_folders(self.spark, self.base), table)

    def _replaced(
        self,
        known: Known,
        table: str,
        incoming: DataFrame,
        keys: Sequence[str],
        gone: DataFrame | None = None,
    ) -> DataFrame:
        """A forced update of the rows' keys, without the rows in ``gone`` (by ``guid``)."""
        if table not in known[1]:
            return incoming
        current = self._read(known, table)
        if gone is not None:
            current = current.join(gone, "guid", "left_anti").select(*current.columns)
        return ops.replace_by_key(current, incoming, keys)

    def _publish(self, tables: Mapping[str, DataFrame], known: Known) -> None:
        changes = {name: Change(df) for name, df in tables.items()}
        publish_tables(self.spark, self.base, changes, known)

    # ------------------------------------------------------ types, entities

    def define_types(self, type_defs: DataFrame | None = None) -> None:
        """Create or force-update type definitions, the initial ones by default.

        Definitions that are stored as they are cause no write; one name with
        two different definitions is an error, and so is a type that would be
        its own super type. Entities are held to the rules of all super types.
        """
        known = current_folders(self.spark, self.base)
        if type_defs is None:
            type_defs = ops.type_definitions(self.spark)
        incoming = ops.single_by_key(type_defs, ["name"])
        if "type_defs" in known[1]:
            incoming = ops.changed_rows(self._read(known, "type_defs"), incoming)
            if incoming.isEmpty():
                return
        defined = written(
            self._replaced(known, "type_defs", incoming, ["name"]), "types", self.work
        )
        rules = ops.inherited_type_defs(defined, self.work)
        self._publish({"type_defs": defined, "type_rules": rules}, known)

    def type_defs(self) -> DataFrame:
        return self.read("type_defs")

    def _entities(
        self,
        known: Known,
        entities: DataFrame,
        gone: DataFrame | None = None,
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The entities afterwards, those accepted, and those rejected."""
        checked = ops.apply_attribute_rules(entities, self._read(known, "type_rules"))
        without_key = F.col("type_name").isNull() | F.col("qualified_name").isNull()
        is_accepted = (F.size("missing") == 0) & ~without_key
        accepted = checked.filter(is_accepted).drop("missing")
        current = self._read(known, "entities") if "entities" in known[1] else None
        if gone is not None and current is not None:
            current = current.join(gone, "guid", "left_anti")
        return ops.upsert(current, accepted).merged, accepted, checked.filter(~is_accepted)

    def put_entities(self, entities: DataFrame) -> DataFrame:
        """Upsert the entities that satisfy their type; returns the others.

        Attribute defaults are filled in. A rejected row comes with the names
        of the required attributes it lacks; one without a type or a qualified
        name is rejected too.
        """
        known = current_folders(self.spark, self.base)
        change, _, rejected = self._entities(known, entities)
        self._publish({"entities": change}, known)
        return rejected

    def put(self, registration: ops.Registration, jobs: Sequence[Job] = ()) -> Recorded:
        """Store what a registration adds, and processes over its tables, at once.

        The columns of a registered table replace those it had: a column that
        is gone goes with its entity and its links. Returns what was refused.
        """
        known = current_folders(self.spark, self.base)
        stale = stale_links = None
        if "columns" in known[1]:
            owners = registration.columns.select("table_guid")
            listed = registration.columns.select("guid")
            stale = (
                self._read(known, "columns")
                .join(owners, "table_guid", "left_semi")
                .join(listed, "guid", "left_anti")
                .select("guid")
            )
            links = self._read(known, "relationships")
            stale_links = links.join(
                stale, links["end2_guid"] == stale["guid"], "left_semi"
            ).select("guid")
            if stale.isEmpty():
                stale = stale_links = None
        entities, edges = registration.entities, None
        unresolved = self.spark.createDataFrame(
            [], "process_name string, direction string, type_name string, qualified_name string"
        )
        if jobs:
            lineage = lineage_ops.record_lineage(
                self._references(jobs),
                registration.entities,
                scheme=self.process_scheme,
                work=self.work,
            )
            entities = entities.unionByName(lineage.processes)
            edges, unresolved = lineage.edges, lineage.unresolved
        change, accepted, rejected = self._entities(known, entities, stale)
        changes = {
            "entities": change,
            "columns": self._replaced(known, "columns", registration.columns, ["guid"], stale),
            "relationships": self._replaced(
                known, "relationships", registration.relationships, ["guid"], stale_links
            ),
        }
        if edges is not None:
            changes["lineage_edges"] = self._edges(known, edges, accepted)
        self._publish(changes, known)
        return Recorded(unresolved, rejected)

    def put_relationships(self, links: DataFrame) -> DataFrame:
        """Add relationships that keep the cardinality of their type; returns the others."""
        known = current_folders(self.spark, self.base)
        stored = self._read(known, "relationships")
        checked = ops.check_links(links, stored, self._read(known, "type_defs"))
        added = self._replaced(known, "relationships", checked.accepted, ["guid"])
        refused = written(checked.refused, "refused-links", self.work)
        self._publish({"relationships": added}, known)
        return refused

    def _edges(
        self,
        known: Known,
        edges: DataFrame,
        accepted: DataFrame,
    ) -> DataFrame:
        """Edges of accepted processes replace those the processes had."""
        stored = accepted.select(F.col("guid").alias("process_guid"))
        edges = edges.join(stored, "process_guid", "left_semi")
        return self._replaced(known, "lineage_edges", edges, ["process_guid"])

    def register_tables(
        self,
        frames: Mapping[str, DataFrame],
        updated_at: Column | None = None,
        with_statistics: bool = False,
    ) -> DataFrame:
        """Register frames as tables: each table and, linked to it, its columns.

        ``with_statistics`` reads every frame once and adds what it finds to
        the attributes of the columns. Returns the rejected entities.
        """
        schemas = ops.schema_rows(self.spark, frames)
        statistics = ops.statistics_rows(frames, ranges=True) if with_statistics else None
        registration = ops.register_tables(schemas, self.table_scheme, updated_at, statistics)
        return self.put(registration).rejected

    def register_resource_sets(
        self,
        frames: Mapping[str, DataFrame],
        qualified_names: Mapping[str, str],
        updated_at: Column | None = None,
    ) -> DataFrame:
        """Register frames as resource sets with a schema entity in between.

        Returns the rejected entities.
        """
        unnamed = [name for name in frames if name not in qualified_names]
        if unnamed:
            raise ValueError(f"no qualified name for tables {unnamed}")
        schemas = ops.schema_rows(self.spark, frames)
        return self.put(ops.register_resource_sets(schemas, qualified_names, updated_at)).rejected

    # ----------------------------------------------------------- statistics

    def update_statistics(
        self,
        name: str,
        df: DataFrame,
        partition_by: Sequence[str] = (),
        partitions: Sequence[str] | None = None,
    ) -> DataFrame:
        """Statistics of the columns of table ``name``, of all or some partitions of ``df``.

        The sketches of each partition are kept, and merged they become
        attributes of the column entities, which are created where they are
        missing. After a rerun of some ``partitions``, written
        ``column=value``, only these are read: the others' sketches are there.
        Returns the merged statistics, one row per column.
        """
        known = current_folders(self.spark, self.base)
        owner = ids.table_name_of(F.lit(name), self.table_scheme)
        owner_guid = ids.entity_guid(F.lit(ids.TABLE_TYPE), owner)
        part = df if partitions is None else within(df, partitions)
        qualified_name = ids.column_name_of(owner, F.col("column_name"))
        sketches = profile_ops.column_sketches(part, partition_by).select(
            ids.entity_guid(F.lit(ids.COLUMN_TYPE), qualified_name).alias("guid"),
            owner_guid.alias("table_guid"),
            "*",
        )
        table_guid = self.spark.range(1).select(owner_guid.alias("guid")).first().guid
        kept = sketches
        if "column_sketches" in known[1]:
            current = self._read(known, "column_sketches")
            kept = profile_ops.replaced_sketches(current, sketches, table_guid, partitions)
        self._publish({"column_sketches": kept}, known)
        merged = profile_ops.merged_statistics(
            self.read("column_sketches").filter(F.col("table_guid") == table_guid),
            ["guid", "ordinal", "column_name"],
        )
        stored = self.read("entities").select("guid", F.col("attributes").alias("_attributes"))
        with_old = merged.join(stored, "guid", "left")
        new = profile_ops.statistics_attributes(with_old)
        given = F.coalesce(
            "_attributes",
            F.create_map(F.lit("type"), F.col("data_type")),
        )
        others = F.map_filter(given, lambda key, _: ~F.map_contains_key(new, key))
        # Old statistics that a column has no more go as well.
        statistics = [F.lit(n) for n in ("least", "greatest", "n_distinct", "quantiles")]
        others = F.map_filter(others, lambda key, _: ~key.isin(*statistics))
        self.put_entities(
            ops.entity_rows(
                with_old,
                ids.COLUMN_TYPE,
                qualified_name,
                F.col("column_name"),
                F.map_concat(others, new),
            )
        )
        return merged

    # -------------------------------------------------------------- lineage

    def record_lineage(
        self,
        name: str,
        inputs: Sequence[str],
        outputs: Sequence[str],
        job_type: str = "batch",
    ) -> Recorded:
        """Record that job ``name`` read and wrote registered tables.

        Returns the references that were not found and the process, if it broke
        a rule; with any, nothing is recorded.
        """
        return self.record_references(self._references([Job(name, inputs, outputs)]), job_type)

    def record_references(self, references: DataFrame, job_type: str = "batch") -> Recorded:
        """Record any number of processes, given as one row per reference."""
        known = current_folders(self.spark, self.base)
        lineage = lineage_ops.record_lineage(
            references,
            self._read(known, "entities"),
            job_type,
            scheme=self.process_scheme,
            work=self.work,
        )
        change, accepted, rejected = self._entities(known, lineage.processes)
        edges = self._edges(known, lineage.edges, accepted)
        self._publish({"entities": change, "lineage_edges": edges}, known)
        return Recorded(lineage.unresolved, rejected)

    def record_run(self, frames: Mapping[str, DataFrame], jobs: Sequence[Job]) -> Recorded:
        """Register the tables some jobs read and wrote together with their lineage.

        The same as registering the tables and recording the lineage, but with
        one new version of all tables.
        """
        schemas = ops.schema_rows(self.spark, frames)
        return self.put(ops.register_tables(schemas, self.table_scheme), jobs)

    def _references(self, jobs: Sequence[Job]) -> DataFrame:
        request = {
            "name": pa.array([job.name for job in jobs], pa.string()),
            "inputs": pa.array([list(job.inputs) for job in jobs], pa.list_(pa.string())),
            "outputs": pa.array([list(job.outputs) for job in jobs], pa.list_(pa.string())),
        }
        requests = local_rows(self.spark, request, lineage_ops.REQUESTS_DDL)
        return lineage_ops.lineage_references(requests, self.table_scheme)

    def origins(self, targets: DataFrame) -> DataFrame:
        """Direct and indirect origins of ``targets`` (column ``node``)."""
        hops = lineage_ops.lineage_hops(self.read("lineage_edges"))
        return lineage_ops.trace_origins(hops, targets, self.work)

    # ------------------------------------------------------ lookup, removal

    def resolve(
        self, requests: DataFrame, type_name: str = ids.RESOURCE_SET_TYPE
    ) -> DataFrame:
        return ops.resolve(requests, self.read("entities"), type_name)

    def relationships(self, guids: DataFrame) -> DataFrame:
        return ops.relationships_by_guid(guids, self.read("relationships"))

    def delete(self, guids: DataFrame) -> None:
        """Delete entities with all they contain, and what touches any of them.

        That is relationships, lineage edges and the columns of a table.
        """
        known = current_folders(self.spark, self.base)
        tables = {name: self._read(known, name) for name in TABLE_SCHEMAS}
        gone = ops.with_members(guids, tables["relationships"], tables["type_defs"])

        def without(table: str, *columns: str) -> DataFrame:
            named, kept = gone.select(F.col("guid").alias("_gone")), tables[table]
            for column in columns:
                kept = kept.join(named, F.col(column) == F.col("_gone"), "left_anti")
            return kept

        self._publish(
            {
                "entities": without("entities", "guid"),
                "columns": without("columns", "guid", "table_guid"),
                "relationships": without("relationships", "end1_guid", "end2_guid"),
                "lineage_edges": without("lineage_edges", "process_guid", "entity_guid"),
            },
            known,
        )

    def cardinality_violations(self) -> DataFrame:
        return ops.cardinality_violations(self.read("relationships"), self.type_defs())

    # ----------------------------------------------------------------- scans

    def scan(
        self,
        path: str | list[str],
        level: str = INCREMENTAL,
        glob: str | None = None,
        name: str = "default",
        register: bool = True,
    ) -> DataFrame:
        """Scan ``path`` under a scan name; see ``scan``.

        With ``register`` the resource sets found become entities of the
        catalogue, named after their folder and qualified by its path, and the
        entities of sets that the scan had found before and that are gone go.
        """
        scans = f"{self.base}/scans"
        before = read_inventory(self.spark, scans, name) if register else None
        found = scan(self.spark, path, scans, level, glob, name)
        if register:
            sets = resource_sets(read_inventory(self.spark, scans, name))
            attributes = F.create_map(
                F.lit("n_files"),
                F.col("n_files").cast("string"),
                F.lit("n_bytes"),
                F.col("n_bytes").cast("string"),
            )
            folder = F.col("resource_set")
            label = F.regexp_extract(folder, r"([^/]+)$", 1)
            self.put_entities(
                ops.entity_rows(
                    sets, ids.RESOURCE_SET_TYPE, folder, label, attributes, F.col("modified_at")
                )
            )
            vanished = resource_sets(before).join(sets, "resource_set", "left_anti")
            guid = ids.entity_guid(F.lit(ids.RESOURCE_SET_TYPE), folder)
            vanished = vanished.select(guid.alias("guid"))
            if not vanished.isEmpty():
                self.delete(vanished)
        return found
