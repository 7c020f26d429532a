"""The data catalogue: entities, relationships and type definitions as tables.

Every operation takes and returns frames and works on any number of entries at
once. An entity is identified by its type name and qualified name.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeclerk.functions import identity as ids
from lakeclerk.functions.sizing import local_rows
from lakeclerk.operators.profile import column_profile, profile_attributes

ENTITY_KEY = ("type_name", "qualified_name")

ENTITIES_DDL = (
    "guid string, type_name string, qualified_name string, name string, "
    "attributes map<string,string>, updated_at timestamp"
)
COLUMNS_DDL = (
    "guid string, table_guid string, ordinal int, name string, data_type string, "
    "description string"
)
RELATIONSHIPS_DDL = "guid string, type_name string, end1_guid string, end2_guid string"
SCHEMA_ROWS_DDL = "table_name string, ordinal int, column_name string, data_type string"
RELATIONSHIP_END_DDL = "struct<type:string,name:string,is_container:boolean,cardinality:string>"
TYPE_DEFS_DDL = (
    "name string, category string, super_types array<string>, "
    "attribute_defs array<struct<name:string,is_optional:boolean,default_value:string>>, "
    "relationship_attribute_defs array<struct<name:string,relationship_type:string,is_legacy:boolean>>, "
    "options map<string,string>, "
    f"end1 {RELATIONSHIP_END_DDL}, end2 {RELATIONSHIP_END_DDL}"
)


@dataclass(frozen=True)
class Registration:
    """What one registration adds to the catalogue."""

    entities: DataFrame
    columns: DataFrame
    relationships: DataFrame


def entity_rows(
    df: DataFrame,
    type_name: Column | str,
    qualified_name: Column,
    name: Column,
    attributes: Column | None = None,
    updated_at: Column | None = None,
) -> DataFrame:
    """One entity per row of ``df``."""
    kind = F.lit(type_name) if isinstance(type_name, str) else type_name
    empty = F.create_map().cast("map<string,string>")
    return df.select(
        ids.entity_guid(kind, qualified_name).alias("guid"),
        kind.alias("type_name"),
        qualified_name.alias("qualified_name"),
        name.alias("name"),
        (empty if attributes is None else attributes).alias("attributes"),
        (F.current_timestamp() if updated_at is None else updated_at).alias("updated_at"),
    )


def relationship_rows(
    df: DataFrame, type_name: str, end1_guid: Column, end2_guid: Column
) -> DataFrame:
    """One relationship per row of ``df``."""
    kind = F.lit(type_name)
    return df.select(
        ids.relationship_guid(kind, end1_guid, end2_guid).alias("guid"),
        kind.alias("type_name"),
        end1_guid.alias("end1_guid"),
        end2_guid.alias("end2_guid"),
    )


def schema_rows(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    """Columns of the named frames, from their schemas; runs no job."""
    rows = [
        (table, ordinal, column, data_type)
        for table, df in frames.items()
        for ordinal, (column, data_type) in enumerate(df.dtypes, start=1)
    ]
    tables, ordinals, names, types = zip(*rows) if rows else ((), (), (), ())
    columns = {
        "table_name": pa.array(tables, pa.string()),
        "ordinal": pa.array(ordinals, pa.int32()),
        "column_name": pa.array(names, pa.string()),
        "data_type": pa.array(types, pa.string()),
    }
    return local_rows(spark, columns, SCHEMA_ROWS_DDL)


def statistics_rows(
    frames: Mapping[str, DataFrame],
    distinct_rsd: float | None = None,
    ranges: bool | Mapping[str, Collection[str]] = False,
) -> DataFrame:
    """Statistics of all columns of the named frames, one pass over each.

    Columns ``table_name, column_name, attributes``; the attributes are those
    of ``profile_attributes``: rows and nulls, and least and greatest of the
    columns that ``ranges`` names by table, or with ``True`` of all numbers and
    times.
    """
    if not frames:
        raise ValueError("name the frames")
    profiles = []
    for table, df in frames.items():
        wanted = ranges if isinstance(ranges, bool) else ranges.get(table, False)
        profiles.append(
            profile_attributes(column_profile(df, distinct_rsd, wanted)).select(
                F.lit(table).alias("table_name"), "column_name", "attributes"
            )
        )
    return reduce(DataFrame.union, profiles)


def register_tables(
    schemas: DataFrame,
    scheme: str = ids.TABLE_SCHEME,
    updated_at: Column | None = None,
    statistics: DataFrame | None = None,
) -> Registration:
    """Catalogue entries of tables: the table and, linked to it, its columns.

    ``schemas`` holds one row per column as made by ``schema_rows``, for one
    table or for many. ``statistics``, as made by ``statistics_rows``, become
    attributes of the columns.
    """
    owner = ids.table_name_of(F.col("table_name"), scheme)
    owner_guid = ids.entity_guid(F.lit(ids.TABLE_TYPE), owner)
    tables = entity_rows(
        schemas.select("table_name").distinct(),
        ids.TABLE_TYPE,
        owner,
        F.col("table_name"),
        updated_at=updated_at,
    )
    members, columns, member_guid = _column_entries(
        schemas, owner, owner_guid, updated_at, statistics
    )
    links = relationship_rows(
        schemas, ids.TABLE_COLUMNS_RELATIONSHIP, owner_guid, member_guid
    )
    return Registration(tables.unionByName(members), columns, links)


def register_resource_sets(
    schemas: DataFrame,
    qualified_names: Mapping[str, str] | None = None,
    updated_at: Column | None = None,
) -> Registration:
    """Catalogue entries on three levels: resource set, its schema, columns.

    ``qualified_names`` maps table names to qualified names, and a table it
    lacks fails the job; without it ``schemas`` has a ``qualified_name`` column.
    """
    if qualified_names is not None:
        names = {
            "table_name": pa.array(list(qualified_names), pa.string()),
            "qualified_name": pa.array(list(qualified_names.values()), pa.string()),
        }
        known = local_rows(
            schemas.sparkSession, names, "table_name string, qualified_name string"
        )
        unnamed = F.concat(F.lit("no qualified name for table "), F.col("table_name"))
        schemas = schemas.join(known, "table_name", "left").withColumn(
            "qualified_name", F.coalesce("qualified_name", F.raise_error(unnamed))
        )
    owner = F.col("qualified_name")
    owner_guid = ids.entity_guid(F.lit(ids.RESOURCE_SET_TYPE), owner)
    schema_name = ids.schema_name_of(owner)
    schema_guid = ids.entity_guid(F.lit(ids.SCHEMA_TYPE), schema_name)

    owners = schemas.select("table_name", "qualified_name").distinct()
    sets = entity_rows(
        owners, ids.RESOURCE_SET_TYPE, owner, F.col("table_name"), updated_at=updated_at
    )
    schema_entities = entity_rows(
        owners,
        ids.SCHEMA_TYPE,
        schema_name,
        ids.schema_name_of(F.col("table_name")),
        updated_at=updated_at,
    )
    members, columns, member_guid = _column_entries(schemas, owner, owner_guid, updated_at)
    links = relationship_rows(
        schemas, ids.SCHEMA_COLUMNS_RELATIONSHIP, schema_guid, member_guid
    ).unionByName(
        relationship_rows(owners, ids.DATASET_SCHEMA_RELATIONSHIP, owner_guid, schema_guid)
    )
    return Registration(sets.unionByName(schema_entities).unionByName(members), columns, links)


def _column_entries(
    schemas: DataFrame,
    owner: Column,
    owner_guid: Column,
    updated_at: Column | None,
    statistics: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, Column]:
    name, data_type = F.col("column_name"), F.col("data_type")
    qualified_name = ids.column_name_of(owner, name)
    guid = ids.entity_guid(F.lit(ids.COLUMN_TYPE), qualified_name)
    description = ids.column_description(name, data_type)
    attributes = F.create_map(F.lit("type"), data_type, F.lit("description"), description)
    described = schemas
    if statistics is not None:
        # Joined for the entities alone: the other two frames need no scan.
        described = schemas.join(
            statistics.withColumnRenamed("attributes", "statistics"),
            ["table_name", "column_name"],
            "left",
        )
        no_statistics = F.create_map().cast("map<string,string>")
        attributes = F.map_concat(attributes, F.coalesce("statistics", no_statistics))
    entities = entity_rows(
        described, ids.COLUMN_TYPE, qualified_name, name, attributes, updated_at
    )
    columns = schemas.select(
        guid.alias("guid"),
        owner_guid.alias("table_guid"),
        F.col("ordinal"),
        name.alias("name"),
        data_type,
        description.alias("description"),
    )
    return entities, columns, guid


def latest_by_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str]
) -> DataFrame:
    """The last row per key by ``order_by``; columns keep their order.

    An aggregate, not a window: each task keeps one row per key before the
    shuffle, so a key with very many versions is never sorted in one task.
    ``order_by`` must decide ties for the result to be the same on every run.
    """
    others = [name for name in df.columns if name not in keys]
    latest = df.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct(*order_by)).alias("latest")
    )
    return latest.select(*keys, "latest.*").select(*df.columns)


class Upserted(NamedTuple):
    """The merged table, and the incoming rows that lack a key."""

    merged: DataFrame
    rejected: DataFrame


def upsert(
    current: DataFrame | None,
    incoming: DataFrame,
    keys: Sequence[str] = ENTITY_KEY,
    updated_at: str = "updated_at",
) -> Upserted:
    """Create or update: per key the latest of both, the incoming one on a tie.

    ``current`` has each key once, as an earlier result of this function has.
    Ties within ``incoming`` are decided by a hash of the content, so that a
    repeated run gives the same table. A row with a null in its key identifies
    nothing: it is handed back. Both sides meet in one full join by key. Publish
    the result as a new version, see ``store``.
    """
    keys = list(keys)
    lacking = reduce(lambda a, b: a | b, [F.col(key).isNull() for key in keys])
    content = F.xxhash64(_sorted_maps(incoming))
    latest = latest_by_key(incoming.filter(~lacking), keys, [F.col(updated_at), content])
    rejected = incoming.filter(lacking)
    if current is None:
        return Upserted(latest, rejected)
    others = [name for name in current.columns if name not in keys]
    new = latest.select(*keys, F.struct(*others).alias("_new"))
    old = current.select(*keys, *others, F.lit(True).alias("_known"))
    # Compared as structs, since a null time is older than any other.
    newer = F.struct(F.col(f"_new.{updated_at}")) >= F.struct(F.col(updated_at))
    wins = F.col("_new").isNotNull() & (F.col("_known").isNull() | newer)
    values = [
        F.when(wins, F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name) for name in others
    ]
    merged = old.join(new, keys, "full").select(*keys, *values).select(*current.columns)
    return Upserted(merged, rejected)


def replace_by_key(
    current: DataFrame | None, incoming: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Forced update: incoming rows replace all current rows with their keys.

    A key may have several rows; where it may not, ``single_by_key`` comes
    first. Null is a key like any other here.
    """
    if current is None:
        return incoming
    new = incoming.select(*[F.col(key).alias(f"_new_{key}") for key in keys]).distinct()
    same = reduce(
        lambda a, b: a & b, [current[key].eqNullSafe(F.col(f"_new_{key}")) for key in keys]
    )
    kept = current.join(new, same, "left_anti")
    return kept.select(*incoming.columns).unionByName(incoming)


def single_by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key; a key with rows that differ fails the job."""
    others = [name for name in df.columns if name not in keys]
    ambiguous = F.raise_error(F.concat_ws(" ", F.lit("ambiguous key"), *[F.col(k) for k in keys]))
    found = df.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.xxhash64(_sorted_maps(df))).alias("_one"),
        F.min(F.xxhash64(_sorted_maps(df))).alias("_least"),
        F.max(F.xxhash64(_sorted_maps(df))).alias("_greatest"),
    )
    one = F.when(F.col("_least") == F.col("_greatest"), F.col("_one")).otherwise(
        ambiguous.cast(found.schema["_one"].dataType)
    )
    return found.select(*keys, one.alias("_one")).select(*keys, "_one.*").select(*df.columns)


def changed_rows(current: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """The incoming rows that ``current`` does not hold as they are."""
    if current is None:
        return incoming
    known = current.select(F.xxhash64(_sorted_maps(current)).alias("_content"))
    content = incoming.withColumn("_content", F.xxhash64(_sorted_maps(incoming)))
    return content.join(known, "_content", "left_anti").drop("_content")


def _sorted_maps(df: DataFrame) -> Column:
    """All columns as one struct, with maps in key order."""
    return F.struct(
        *[
            F.array_sort(F.map_entries(name)).alias(name) if data_type.startswith("map") else name
            for name, data_type in df.dtypes
        ]
    )


def resolve(
    requests: DataFrame, entities: DataFrame, type_name: str = ids.RESOURCE_SET_TYPE
) -> DataFrame:
    """Look up entities by key: ``type_name, qualified_name, guid, name``.

    Requests without a ``type_name`` column take the given one. Repeated
    requests are looked up once. An unresolved key comes back with a null
    guid.
    """
    if "type_name" not in requests.columns:
        requests = requests.withColumn("type_name", F.lit(type_name))
    wanted = requests.select(*ENTITY_KEY).distinct()
    found = entities.select(*ENTITY_KEY, "guid", "name")
    return wanted.join(found, on=list(ENTITY_KEY), how="left")


def relationships_by_guid(guids: DataFrame, relationships: DataFrame) -> DataFrame:
    """Read the relationships with the requested identifiers, in one join."""
    return relationships.join(guids.select("guid"), "guid", "left_semi")


def with_members(guids: DataFrame, relationships: DataFrame, type_defs: DataFrame) -> DataFrame:
    """``guid`` of the entities and of all that they contain, at any depth.

    Members are the second ends of composition links whose first end is the
    container. Each round joins only the members found last; rounds are as many
    as containers are nested, and one more.
    """
    containing = type_defs.filter(
        (F.col("category") == "COMPOSITION") & F.col("end1.is_container")
    ).select(F.col("name").alias("type_name"))
    links = relationships.join(containing, "type_name", "left_semi").select(
        F.col("end1_guid").alias("guid"), F.col("end2_guid").alias("member")
    )
    found = latest = guids.select("guid").distinct()
    while True:
        members = links.join(latest, "guid", "left_semi").select(F.col("member").alias("guid"))
        latest = members.distinct().join(found, "guid", "left_anti")
        if latest.isEmpty():
            return found
        found = found.unionByName(latest)


def delete_entities(
    guids: DataFrame,
    entities: DataFrame,
    relationships: DataFrame,
    edges: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop entities with the relationships and lineage edges that touch them."""
    gone = guids.select(F.col("guid").alias("_gone"))

    def without(df: DataFrame, column: str) -> DataFrame:
        return df.join(gone, F.col(column) == F.col("_gone"), "left_anti")

    return (
        without(entities, "guid"),
        without(without(relationships, "end1_guid"), "end2_guid"),
        without(without(edges, "process_guid"), "entity_guid"),
    )


def type_definitions(spark: SparkSession) -> DataFrame:
    """The type definitions every catalogue starts with."""
    # Type names, attributes, defaults, supertypes, cardinalities.
    definitions = [
        {
            "name": ids.TABLE_TYPE,
            "category": "ENTITY",
            "super_types": ["DataSet"],
            "attribute_defs": [{"name": "format", "is_optional": True}],
            "relationship_attribute_defs": [
                {
                    "name": "columns",
                    "relationship_type": ids.TABLE_COLUMNS_RELATIONSHIP,
                    "is_legacy": False,
                }
            ],
            "options": {"schemaElementsAttribute": "tabular_schema"},
        },
        {
            "name": ids.TABLE_COLUMN_TYPE,
            "category": "ENTITY",
            "super_types": ["DataSet"],
            "attribute_defs": [{"name": "data_type", "is_optional": True}],
            "options": {},
        },
        {
            "name": ids.PROCESS_TYPE,
            "category": "ENTITY",
            "super_types": ["Process"],
            "attribute_defs": [
                {"name": "job_type", "is_optional": False},
                {"name": "schedule", "is_optional": True, "default_value": "adHoc"},
            ],
            "options": {},
        },
        {
            "name": ids.TABLE_COLUMNS_RELATIONSHIP,
            "category": "COMPOSITION",
            "super_types": [],
            "attribute_defs": [],
            "options": {},
            "end1": {
                "type": ids.TABLE_TYPE,
                "name": "columns",
                "is_container": True,
                "cardinality": "SET",
            },
            "end2": {
                "type": ids.COLUMN_TYPE,
                "name": "delta_table",
                "is_container": False,
                "cardinality": "SINGLE",
            },
        },
    ]
    lines = {"line": pa.array([json.dumps(row) for row in definitions], pa.string())}
    return local_rows(spark, lines, "line string").select(
        F.inline(F.array(F.from_json("line", TYPE_DEFS_DDL)))
    )


def apply_attribute_rules(entities: DataFrame, type_defs: DataFrame) -> DataFrame:
    """Fill attribute defaults and name the required attributes that lack.

    Adds ``missing`` (array of names) to the entities; a row with an empty
    array is accepted. Types without a definition have no rules. Most entities
    share few types, so the join key is skewed by nature: definitions below
    Spark's broadcast threshold are broadcast, and beyond it adaptive execution
    splits the hot types.
    """
    rules = type_defs.filter(F.col("category") == "ENTITY").select(
        F.col("name").alias("type_name"),
        F.map_from_entries(
            F.transform(
                F.filter("attribute_defs", lambda rule: rule["default_value"].isNotNull()),
                lambda rule: F.struct(rule["name"], rule["default_value"]),
            )
        ).alias("_defaults"),
        F.transform(
            F.filter("attribute_defs", lambda rule: ~rule["is_optional"]),
            lambda rule: rule["name"],
        ).alias("_required"),
    )
    # One projection per step: each map is built once per row.
    given = F.map_filter("attributes", lambda _, value: value.isNotNull())
    lacking = F.map_filter(
        "_defaults", lambda name, _: ~F.map_contains_key(F.col("_given"), name)
    )
    missing = F.filter(
        F.coalesce(F.col("_required"), F.array().cast("array<string>")),
        lambda name: F.element_at(F.col("attributes"), name).isNull(),
    )
    return (
        entities.join(rules, "type_name", "left")
        .withColumn("_given", F.when(F.col("_defaults").isNotNull(), given))
        .withColumn(
            "attributes", F.coalesce(F.map_concat(lacking, F.col("_given")), F.col("attributes"))
        )
        .withColumn("missing", missing)
        .select(*entities.columns, "missing")
    )


def cardinality_violations(relationships: DataFrame, type_defs: DataFrame) -> DataFrame:
    """Members of more containers than their relationship type allows.

    Looks at types whose member end is SINGLE and returns ``type_name,
    end2_guid, n_containers``. Pairs are made distinct before they are counted
    per member, so a member with very many links is spread over all tasks.
    """
    single = type_defs.filter(F.col("end2.cardinality") == "SINGLE").select(
        F.col("name").alias("type_name")
    )
    return (
        relationships.join(single, "type_name", "left_semi")
        .groupBy("type_name", "end2_guid")
        .agg(F.countDistinct("end1_guid").alias("n_containers"))
        .filter(F.col("n_containers") > 1)
    )


class CheckedLinks(NamedTuple):
    """Links that may be stored, and those that would break their type's cardinality."""

    accepted: DataFrame
    refused: DataFrame


def check_links(incoming: DataFrame, stored: DataFrame, type_defs: DataFrame) -> CheckedLinks:
    """Hold new relationships against the stored ones, before they are written.

    At an end that is SINGLE an entity has one partner: a column belongs to one
    table. A new link is refused if its entity would have several among the
    stored and the new ones; a link that is stored already stays accepted. Of
    new links that contradict each other all are refused. Only stored links of
    entities that come again are looked at, and partners are reduced to the
    least and greatest in each task, so an entity of very many links is no
    single task's. Types without a definition have no rule.
    """
    columns = ["type_name", "end1_guid", "end2_guid"]
    new = incoming.select("guid", *columns).distinct()
    bad = None
    for one, other in (("end2", "end1"), ("end1", "end2")):
        single = type_defs.filter(F.col(f"{one}.cardinality") == "SINGLE").select(
            F.col("name").alias("type_name")
        )
        ends = ["type_name", f"{one}_guid"]
        touched = new.join(single, "type_name", "left_semi")
        known = stored.join(touched.select(*ends).distinct(), ends, "left_semi")
        partners = (
            touched.select(*columns)
            .unionByName(known.select(*columns))
            .groupBy(*ends)
            .agg(F.min(f"{other}_guid").alias("least"), F.max(f"{other}_guid").alias("most"))
            .filter(F.col("least") != F.col("most"))
        )
        some = touched.join(partners, ends, "left_semi").select("guid")
        bad = some if bad is None else bad.unionByName(some)
    refused = bad.distinct().join(stored.select("guid"), "guid", "left_anti")
    return CheckedLinks(
        new.join(refused, "guid", "left_anti").select(*incoming.columns),
        new.join(refused, "guid", "left_semi").select(*incoming.columns),
    )


def inherited_type_defs(type_defs: DataFrame, work: str | None = None) -> DataFrame:
    """Type definitions whose attributes include those of all their super types.

    An attribute that several of them define is taken from the nearest, the
    type itself first, and of two as near from the one whose name comes first.
    Super types without a definition have no attributes. A type that is its own
    super type, at any distance, is an error. The hierarchy is traced in rounds
    that follow new pairs only.
    """
    from lakeclerk.operators.lineage import trace_origins  # which builds on this module

    kinds = type_defs.filter(F.col("category") == "ENTITY")
    hops = kinds.select(F.col("name").alias("node"), F.explode("super_types").alias("origin"))
    above = trace_origins(hops, hops.select("node"), work)
    circular = above.filter(F.col("node") == F.col("origin")).select("node").limit(10).collect()
    if circular:
        raise ValueError(f"types above themselves: {sorted(row.node for row in circular)}")
    own = kinds.select(F.col("name").alias("node"), F.col("name").alias("origin"), F.lit(0).alias("n_hops"))
    rules = kinds.select(F.col("name").alias("origin"), F.explode("attribute_defs").alias("rule"))
    nearest = (
        above.unionByName(own)
        .join(rules, "origin")
        .groupBy("node", F.col("rule.name").alias("attribute"))
        .agg(F.min_by("rule", F.struct("n_hops", "origin")).alias("rule"))
    )
    whole = nearest.groupBy(F.col("node").alias("name")).agg(
        F.sort_array(F.collect_list("rule")).alias("_rules")
    )
    return (
        type_defs.join(whole, "name", "left")
        .withColumn("attribute_defs", F.coalesce("_rules", "attribute_defs"))
        .select(*type_defs.columns)
    )
