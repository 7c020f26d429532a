"""Names and identifiers of catalogue entries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name formats and type names of the catalogue entries.
TABLE_SCHEME = "pyapache"
PROCESS_SCHEME = "pyapacheatlas"
TABLE_SUFFIX = "_delta_table"
COLUMN_INFIX = "_column_"
SCHEMA_SUFFIX = "_tabular_schema"
TABLE_TYPE = "custom_delta_table"
TABLE_COLUMN_TYPE = "custom_delta_table_column"
COLUMN_TYPE = "column"
SCHEMA_TYPE = "tabular_schema"
RESOURCE_SET_TYPE = "azure_datalake_gen2_resource_set"
PROCESS_TYPE = "custom_spark_job_process"
TABLE_COLUMNS_RELATIONSHIP = "custom_delta_table_columns"
SCHEMA_COLUMNS_RELATIONSHIP = "composeSchema"
DATASET_SCHEMA_RELATIONSHIP = "tabular_schema"
COLUMN_DESCRIPTION = "Column %s has type %s"


def table_name_of(name: Column, scheme: str = TABLE_SCHEME) -> Column:
    return F.concat(F.lit(f"{scheme}://"), name, F.lit(TABLE_SUFFIX))


def process_name_of(name: Column, scheme: str = PROCESS_SCHEME) -> Column:
    return F.concat(F.lit(f"{scheme}://"), name)


def column_name_of(owner: Column, column: Column) -> Column:
    return F.concat(owner, F.lit(COLUMN_INFIX), column)


def schema_name_of(owner: Column) -> Column:
    return F.concat(owner, F.lit(SCHEMA_SUFFIX))


def column_description(column: Column, data_type: Column) -> Column:
    return F.format_string(COLUMN_DESCRIPTION, column, data_type)


def entity_guid(type_name: Column, qualified_name: Column) -> Column:
    """Identifier from the primary key alone.

    Needs no counter and no coordination between tasks, and running a
    registration again gives the same identifiers.
    """
    return F.md5(F.concat(type_name, F.lit("|"), qualified_name))


def relationship_guid(type_name: Column, end1_guid: Column, end2_guid: Column) -> Column:
    return F.md5(F.concat_ws("|", type_name, end1_guid, end2_guid))
