from lakeclerk.functions.columns import named, select_strict
from lakeclerk.functions.casting import convert, conversion_losses, tolerant_cast
from lakeclerk.functions.identity import (
    column_description,
    column_name_of,
    entity_guid,
    process_name_of,
    relationship_guid,
    schema_name_of,
    table_name_of,
)
from lakeclerk.functions.sizing import local_rows, new_folder, paths_like, remove_folder, written

__all__ = [
    "column_description",
    "column_name_of",
    "conversion_losses",
    "convert",
    "entity_guid",
    "local_rows",
    "named",
    "new_folder",
    "paths_like",
    "process_name_of",
    "remove_folder",
    "relationship_guid",
    "schema_name_of",
    "select_strict",
    "table_name_of",
    "tolerant_cast",
    "written",
]
