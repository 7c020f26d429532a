"""Column references that survive awkward header names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """Reference a top-level column by its literal name.

    Headers may hold dots, spaces, commas or percent signs; an unquoted dot
    would be read as a struct access.
    """
    return F.col(quoted(name))


def quoted(name: str) -> str:
    """A literal column name as it is written in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise for names the frame lacks, listing all of them at once."""
    known = set(df.columns)
    missing = [name for name in names if name not in known]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def select_strict(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Project to ``names`` in the given order."""
    names = list(names)
    require_columns(df, names)
    return df.select([named(name) for name in names])
