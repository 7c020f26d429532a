"""Column statistics, and their form as catalogue attributes."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeclerk.functions.columns import named, quoted, require_columns

ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def column_profile(
    df: DataFrame,
    distinct_rsd: float | None = None,
    ranges: bool | Collection[str] = True,
) -> DataFrame:
    """One row per column, from a single pass over the table.

    ``n_rows, n_nulls`` for every column. ``least, greatest`` are the text of
    the column's own type, so no digit is lost: with ``ranges=True`` for numbers
    and times, with names for those columns only, which may then be free text,
    with ``False`` for none. With ``distinct_rsd`` also ``n_distinct``, estimated
    within that relative standard deviation: an exact count would shuffle every
    value of every column. All statistics are partial aggregates, so one row
    per task is shuffled.
    """
    if not isinstance(ranges, bool):
        require_columns(df, ranges)
    estimate = f"approx_count_distinct(%s, {distinct_rsd}D)" if distinct_rsd is not None else None
    statistics, rows = ["count(*) AS n_rows"], []
    for index, field in enumerate(df.schema.fields):
        column = quoted(field.name)
        statistics.append(f"count({column}) AS n_{index}")
        row = {
            "ordinal": str(index + 1),
            "column_name": _text_literal(field.name),
            "n_rows": "n_rows",
            "n_nulls": f"n_rows - n_{index}",
            "least": "CAST(NULL AS string)",
            "greatest": "CAST(NULL AS string)",
        }
        wanted = isinstance(field.dataType, ORDERED) if ranges is True else (
            ranges is not False and field.name in ranges
        )
        if wanted:
            for name, function in (("least", "min"), ("greatest", "max")):
                statistics.append(f"{function}({column}) AS {name}_{index}")
                row[name] = f"CAST({name}_{index} AS string)"
        if estimate:
            statistics.append(f"{estimate % column} AS distinct_{index}")
            row["n_distinct"] = f"distinct_{index}"
        members = ", ".join(f"'{name}', {value}" for name, value in row.items())
        rows.append(f"named_struct({members})")
    measured = df.agg(*[F.expr(text) for text in statistics])
    return measured.selectExpr(f"inline(array({', '.join(rows)}))")


def _text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def profile_attributes(profile: DataFrame) -> DataFrame:
    """``column_name`` and a text map of its statistics, for column entities."""
    names = [name for name in profile.columns if name not in ("ordinal", "column_name")]
    pairs = [part for name in names for part in (F.lit(name), F.col(name).cast("string"))]
    return profile.select(
        "column_name",
        F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull()).alias("attributes"),
    )


# Sketches of a partition's columns. Relative standard deviation of the distinct
# counts and rank error of the quantiles, as the sketches' authors state them.
DISTINCT_LOG_SIZE, QUANTILE_SIZE = 12, 200
DISTINCT_RSD, QUANTILE_ERROR = 1.04 / 2 ** (DISTINCT_LOG_SIZE / 2), 0.0165

SKETCHES_DDL = (
    "partition string, ordinal int, column_name string, data_type string, n_rows bigint, "
    "n_nulls bigint, least string, greatest string, distinct_sketch binary, quantile_sketch binary"
)


def partition_name(partition_by: Sequence[str]) -> Column:
    """``column=value`` of a row's partition, joined by ``/``; empty without columns."""

    def escaped(name: str) -> Column:
        value = F.coalesce(named(name).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
        for character, code in (("%", "%25"), ("/", "%2F"), ("=", "%3D")):
            value = F.replace(value, F.lit(character), F.lit(code))
        return F.concat(F.lit(f"{name}="), value)

    return F.concat_ws("/", *[escaped(name) for name in partition_by])


def column_sketches(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Statistics that merge, a row per partition and column, from one pass: SKETCHES_DDL.

    Counts of rows and nulls, the range of numbers and times as text of their
    own type, a HyperLogLog sketch of the distinct values, and for numbers a
    KLL sketch of their quantiles. Each task reduces its rows to one row per
    partition before the shuffle. Partition columns count like others.
    """
    statistics, rows = ["count(*) AS n_rows"], []
    for index, field in enumerate(df.schema.fields):
        column, kind = quoted(field.name), field.dataType
        statistics.append(f"count({column}) AS n_{index}")
        statistics.append(
            f"hll_sketch_agg(CASE WHEN {column} IS NOT NULL THEN xxhash64({column}) END, "
            f"{DISTINCT_LOG_SIZE}) AS distinct_{index}"
        )
        row = {
            "ordinal": str(index + 1),
            "column_name": _text_literal(field.name),
            "data_type": _text_literal(kind.simpleString()),
            "n_rows": "n_rows",
            "n_nulls": f"n_rows - n_{index}",
            "least": "CAST(NULL AS string)",
            "greatest": "CAST(NULL AS string)",
            "distinct_sketch": f"distinct_{index}",
            "quantile_sketch": "CAST(NULL AS binary)",
        }
        if isinstance(kind, ORDERED):
            for name, function in (("least", "min"), ("greatest", "max")):
                statistics.append(f"{function}({column}) AS {name}_{index}")
                row[name] = f"CAST({name}_{index} AS string)"
        if isinstance(kind, T.NumericType):
            statistics.append(
                f"kll_sketch_agg_double(CAST({column} AS double), {QUANTILE_SIZE}) AS quantile_{index}"
            )
            row["quantile_sketch"] = f"quantile_{index}"
        rows.append(f"named_struct({', '.join(f"'{n}', {v}" for n, v in row.items())})")
    measures = [F.expr(text) for text in statistics]
    where = partition_name(partition_by).alias("partition")
    measured = df.groupBy(where).agg(*measures)
    return measured.selectExpr("partition", f"inline(array({', '.join(rows)}))")


def merged_statistics(
    sketches: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """One row per column from those of its partitions; no data is read.

    ``keys`` name the column. ``n_rows, n_nulls, least, greatest`` are exact;
    ``n_distinct`` and ``quantiles`` (an array in the order asked for) come
    from the merged sketches, within DISTINCT_RSD and QUANTILE_ERROR.
    """
    # Texts of numbers are compared as numbers, whole ones and decimals with all digits.
    exact = F.col("data_type").rlike("int|decimal")
    floating = F.col("data_type").isin("double", "float")

    def order(column: str) -> Column:
        return F.struct(
            F.when(exact, F.col(column).try_cast("decimal(38,18)")),
            F.when(floating | exact, F.col(column).try_cast("double")),
            F.col(column),
        )

    merged = sketches.groupBy(*keys, "data_type").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_nulls").alias("n_nulls"),
        F.min_by("least", F.when(F.col("least").isNotNull(), order("least"))).alias("least"),
        F.max_by("greatest", F.when(F.col("greatest").isNotNull(), order("greatest"))).alias(
            "greatest"
        ),
        F.expr("hll_sketch_estimate(hll_union_agg(distinct_sketch))").alias("n_distinct"),
        F.expr(f"kll_merge_agg_double(quantile_sketch, {QUANTILE_SIZE})").alias("_quantiles"),
    )
    ranks = ", ".join(f"{rank}D" for rank in quantiles)
    some = "_quantiles IS NOT NULL AND kll_sketch_get_n_double(_quantiles) > 0"
    found = f"CASE WHEN {some} THEN kll_sketch_get_quantile_double(_quantiles, array({ranks})) END"
    return merged.withColumn("quantiles", F.expr(found)).drop("_quantiles")


def statistics_attributes(merged: DataFrame) -> Column:
    """Merged statistics as a text map, without those a column has not."""
    names = ("n_rows", "n_nulls", "least", "greatest", "n_distinct", "quantiles")
    pairs = [part for name in names for part in (F.lit(name), merged[name].cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())


def replaced_sketches(
    current: DataFrame, incoming: DataFrame, owner: str, partitions: Sequence[str] | None
) -> DataFrame:
    """``current`` with the rows of some partitions of one owner replaced, or with all of its rows.

    A named partition for which nothing comes goes.
    """
    stale = F.col("table_guid") == F.lit(owner)
    if partitions is not None:
        stale = stale & F.col("partition").isin(list(partitions))
    return current.filter(~stale).select(*incoming.columns).unionByName(incoming)
