"""Readers for delimited and Parquet datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The delimited text dialect.
DELIMITER = ","
QUOTE = '"'
ESCAPE = "\\"


def text_schema(names: Sequence[str]) -> T.StructType:
    """All-string schema for columns whose types are decided later."""
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    infer: bool = False,
    null_value: str | None = None,
    multi_line: bool = False,
    keep_blanks: bool = True,
) -> DataFrame:
    """Read delimited text with a header row.

    With neither ``schema`` nor ``infer`` every column is a string and the
    data is read only once. ``infer`` costs a full extra pass. ``multi_line``
    admits line breaks inside quotes; a file is then read by one task, so such
    a table should come as many files, as ``write_csv`` leaves it.
    """
    if schema is not None and infer:
        raise ValueError("give a schema or ask for inference, not both")
    reader = (
        spark.read.option("header", True)
        .option("sep", DELIMITER)
        .option("quote", QUOTE)
        .option("escape", ESCAPE)
        .option("multiLine", multi_line)
        .option("ignoreLeadingWhiteSpace", not keep_blanks)
        .option("ignoreTrailingWhiteSpace", not keep_blanks)
    )
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    if schema is not None:
        # The header must name the declared columns, not just as many of them.
        reader = reader.schema(schema).option("enforceSchema", False)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_parquet(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    glob: str | None = None,
    recursive: bool = False,
    base_path: str | None = None,
) -> DataFrame:
    """Read a Parquet folder.

    By default ``k=v`` directories become columns; ``base_path`` keeps them
    when ``path`` itself points below such a directory. ``recursive`` reads
    every file at any depth instead, and then directory names are ignored.
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if base_path:
        reader = reader.option("basePath", base_path)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Pass ``df`` on if its column names, order and types are as declared."""
    found = [(field.name, field.dataType.simpleString()) for field in df.schema.fields]
    wanted = [(field.name, field.dataType.simpleString()) for field in expected.fields]
    if wanted and found != wanted:
        raise ValueError(f"schema mismatch: expected {wanted}, found {found}")
    return df
