"""Types of text columns from counts that merge, found in the pass that reads them.

Spark's own inference reads delimited text twice and tells a type only. Here
every value is put among the types it fits, and a column's type is the
narrowest one that all its values fit, so counts of files, partitions or days
add up, and what keeps a column from a narrower type is known as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeclerk.functions.casting import tolerant_cast
from lakeclerk.functions.columns import named, require_columns

# From the narrowest on; of a branch each type holds those before it:
# int, bigint, decimal, double, then date, timestamp, then boolean.
BRANCHES = (("int", "bigint", "decimal", "double"), ("date", "timestamp"), ("boolean",))
TYPES = tuple(name for branch in BRANCHES for name in branch)

_FLOAT = (
    r"^[\x00-\x20]*[+-]?(NaN|Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?"
    r"|0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]+[pP][+-]?[0-9]+[fFdD]?)[\x00-\x20]*$|^-?Inf$"
)


def whole_digits(value: Column) -> Column:
    """Digits of a whole number without leading zeros, at least one; null for other text."""
    digits = F.length(F.regexp_extract(value, r"^[+-]?0*([0-9]*)\.?$", 1))
    return F.when(value.rlike(r"^[+-]?[0-9]+\.?$"), F.greatest(digits, F.lit(1)))


def fitting_types(value: Column) -> dict[str, Column]:
    """For every type whether a text fits it; false for null.

    The tests are patterns and ranges, and casts only where a pattern holds.
    """
    digits = whole_digits(value)
    whole = digits.isNotNull() & ~value.endswith(".")
    number = F.when(whole & (digits <= 18), value.cast("bigint")).when(
        whole & (digits == 19), value.try_cast("bigint")
    )
    # Cheap tests first: a whole number needs no more, a time has a minus or a colon.
    floating = digits.isNotNull() | value.rlike(_FLOAT)
    marked = value.contains("-") | value.contains(":")
    day = (F.length(value) == 10) & marked & value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    fits = {
        "int": number.between(-(2**31), 2**31 - 1),
        "bigint": number.isNotNull(),
        "decimal": digits <= 38,
        "double": floating,
        "date": F.when(day, value.try_cast("date")).isNotNull(),
        "timestamp": F.when(marked & ~floating, value.try_cast("timestamp")).isNotNull(),
        "boolean": F.length(value).between(4, 5) & F.lower(value).isin("true", "false"),
    }
    return {name: F.coalesce(fit, F.lit(False)) for name, fit in fits.items()}


def type_counts(df: DataFrame, part: Column | None = None) -> DataFrame:
    """How many values of every text column fit each type, in one pass with partial sums.

    With ``part`` there are rows for each of its values, such as a file or a day.
    ``ordinal, column_name, n_rows, n_values`` (not null), ``n_<type>`` for each
    of TYPES, and ``digits``, the most of a whole number.
    """
    # A row per value, so that one small aggregate serves all columns.
    values = F.array(
        *[F.struct(F.lit(i).alias("ordinal"), named(c).alias("value")) for i, c in enumerate(df.columns, 1)]
    )
    value, names = F.col("value"), F.array(*[F.lit(name) for name in df.columns])
    keys = ["ordinal"] if part is None else ["part", "ordinal"]
    rows = df.select(*([] if part is None else [part.alias("part")]), F.inline(values))
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count("value").alias("n_values"),
        *[F.count_if(fit).alias(f"n_{kind}") for kind, fit in fitting_types(value).items()],
        F.max(whole_digits(value)).alias("digits"),
    )
    numbers = [name for name in counts.columns if name.startswith("n_")]
    if part is None:
        # Columns of an empty table are told too.
        every = df.sparkSession.range(1, len(df.columns) + 1)
        every = every.select(F.col("id").cast("int").alias("ordinal"))
        counts = every.join(counts, "ordinal", "left").fillna(0, numbers)
    name = F.element_at(names, F.col("ordinal")).alias("column_name")
    return counts.select(*keys, name, *numbers, "digits")


def merged_type_counts(counts: DataFrame, keys: Sequence[str] = ("ordinal", "column_name")) -> DataFrame:
    """The counts of parts of a table as those of the whole."""
    sums = ["n_rows", "n_values", *[f"n_{kind}" for kind in TYPES]]
    return counts.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in sums], F.max("digits").alias("digits")
    )


def inferred_types(counts: DataFrame) -> DataFrame:
    """Adds ``data_type`` to counts, and ``misfits``: by type, the values that do not fit it.

    A column without a value is text, and so is one whose values need two
    branches of types. A decimal has as many digits as its longest number.
    """
    data_type = F.lit("string")
    for kind in reversed(TYPES):
        name = F.lit(kind)
        if kind == "decimal":
            name = F.format_string("decimal(%d,0)", F.col("digits"))
        fits = (F.col("n_values") > 0) & (F.col(f"n_{kind}") == F.col("n_values"))
        data_type = F.when(fits, name).otherwise(data_type)
    pairs = [
        part
        for kind in TYPES
        for part in (F.lit(kind), F.col("n_values") - F.col(f"n_{kind}"))
    ]
    return counts.withColumns({"data_type": data_type, "misfits": F.create_map(*pairs)})


def as_inferred(df: DataFrame, types: DataFrame) -> DataFrame:
    """Text columns cast to the types found; one row per column reaches the driver."""
    found = {row.column_name: row.data_type for row in types.select("column_name", "data_type").collect()}
    require_columns(df, found)
    return df.select(
        [
            tolerant_cast(named(name), found[name], T.StringType()).alias(name)
            if found.get(name, "string") != "string"
            else named(name)
            for name in df.columns
        ]
    )
