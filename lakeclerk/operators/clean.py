"""Cleaning a table: keep, rename, cast and fill, as one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeclerk.functions.casting import tolerant_cast
from lakeclerk.functions.columns import named, require_columns


@dataclass(frozen=True)
class ColumnRule:
    """Keep ``source``, optionally under a new name, type or null default."""

    source: str
    name: str | None = None
    cast: str | None = None
    default: Any = None


def clean(df: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """Keep the columns the rules name, in their order.

    The result is one projection, so only the named columns are read. A value
    that does not parse as the rule's type becomes null; a column the table
    lacks is an error.
    """
    require_columns(df, [rule.source for rule in rules])
    types = {field.name: field.dataType for field in df.schema.fields}
    kept = []
    for rule in rules:
        column = named(rule.source)
        if rule.cast:
            column = tolerant_cast(column, rule.cast, types[rule.source])
        if rule.default is not None:
            column = F.coalesce(column, F.lit(rule.default))
        kept.append(column.alias(rule.name or rule.source))
    return df.select(kept)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename in place; unlike Spark's own rename an absent name is an error."""
    require_columns(df, names)
    return df.withColumnsRenamed(dict(names))
