from lakeclerk.operators.catalog import (
    Registration,
    Upserted,
    apply_attribute_rules,
    cardinality_violations,
    changed_rows,
    check_links,
    delete_entities,
    entity_rows,
    inherited_type_defs,
    latest_by_key,
    register_resource_sets,
    register_tables,
    relationship_rows,
    relationships_by_guid,
    replace_by_key,
    resolve,
    schema_rows,
    single_by_key,
    statistics_rows,
    type_definitions,
    upsert,
    with_members,
)
from lakeclerk.operators.clean import ColumnRule, clean, rename_columns
from lakeclerk.operators.enrich import enrich, likely_partners, unmatched_keys
from lakeclerk.operators.infer import (
    as_inferred,
    inferred_types,
    merged_type_counts,
    type_counts,
)
from lakeclerk.operators.inventory import (
    compare_snapshots,
    file_inventory,
    path_pattern,
    pattern_sets,
    resource_sets,
)
from lakeclerk.operators.lineage import (
    Lineage,
    lineage_references,
    lineage_hops,
    record_lineage,
    shallow_origins,
    trace_origins,
)
from lakeclerk.operators.profile import (
    column_profile,
    column_sketches,
    merged_statistics,
    profile_attributes,
)
from lakeclerk.operators.store import (
    Change,
    publish_table,
    publish_tables,
    read_table,
)

__all__ = [
    "Change",
    "ColumnRule",
    "Lineage",
    "Registration",
    "Upserted",
    "apply_attribute_rules",
    "as_inferred",
    "cardinality_violations",
    "changed_rows",
    "check_links",
    "clean",
    "column_profile",
    "column_sketches",
    "compare_snapshots",
    "delete_entities",
    "enrich",
    "entity_rows",
    "file_inventory",
    "inferred_types",
    "inherited_type_defs",
    "latest_by_key",
    "likely_partners",
    "lineage_hops",
    "lineage_references",
    "merged_statistics",
    "merged_type_counts",
    "path_pattern",
    "pattern_sets",
    "profile_attributes",
    "publish_table",
    "publish_tables",
    "read_table",
    "record_lineage",
    "register_resource_sets",
    "register_tables",
    "relationship_rows",
    "relationships_by_guid",
    "rename_columns",
    "replace_by_key",
    "resolve",
    "resource_sets",
    "schema_rows",
    "shallow_origins",
    "single_by_key",
    "statistics_rows",
    "trace_origins",
    "type_counts",
    "type_definitions",
    "unmatched_keys",
    "upsert",
    "with_members",
]
