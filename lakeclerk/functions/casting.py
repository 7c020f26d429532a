"""Type conversions that never stop a job over one bad value, unless asked to."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeclerk.functions.columns import named, require_columns

WHOLE_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


# What a number may look like. Casts accept more than ASCII digits, so text with
# other characters is left to them.
_BLANK, _OTHER = r"[\x00-\x20]*", r"|[^\x00-\x7F]"
_DIGITS = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
DECIMAL_TEXT = rf"^{_BLANK}{_DIGITS}{_BLANK}$" + _OTHER
FLOAT_TEXT = rf"^{_BLANK}({_DIGITS}[dDfF]?|[+-]?0[xX].*|[+-]?(?i:inf|infinity|nan)){_BLANK}$" + _OTHER
WHOLE_TEXT = rf"^{_BLANK}[+-]?[0-9]+{_BLANK}$" + _OTHER
SHORT_WHOLE_TEXT = rf"^{_BLANK}[+-]?[0-9]{{1,18}}{_BLANK}$"


def whole_range(data_type: T.DataType) -> tuple[int, int]:
    bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(data_type)]
    return -(2**bits), 2**bits - 1


def guarded_cast(column: Column, source: T.DataType, target: T.DataType) -> Column:
    """As ``try_cast``, but a misfit is seen before the cast where that is cheap.

    ``try_cast`` throws and catches an exception for each value that does not
    fit, which costs many times the cast. So numbers are compared with the
    range of the new type, and text with the pattern of a number.
    """
    if isinstance(target, WHOLE_NUMBERS):
        low, high = whole_range(target)
        if isinstance(source, WHOLE_NUMBERS):
            if whole_range(source)[1] <= high:
                return column.cast(target)
            return F.when(column.between(low, high), column.cast(target))
        if isinstance(source, (T.FloatType, T.DoubleType)):
            # Bounds are powers of two, exact in floating point; NaN is above all.
            least = column >= float(low) if high == 2**63 - 1 else column > float(low - 1)
            return F.when(least & (column < float(high + 1)), column.cast(target))
        if isinstance(source, T.DecimalType):
            whole = _whole_part(column)
            return F.when(whole.between(low, high), whole.cast(target))
        if isinstance(source, T.StringType):
            number = column.cast("bigint")
            return F.when(
                column.rlike(SHORT_WHOLE_TEXT),
                F.when(number.between(low, high), number.cast(target)),
            ).when(column.rlike(WHOLE_TEXT), column.try_cast(target))
    if isinstance(source, T.StringType):
        if isinstance(target, T.DecimalType):
            return F.when(column.rlike(DECIMAL_TEXT), column.try_cast(target))
        if isinstance(target, (T.FloatType, T.DoubleType)):
            return F.when(column.rlike(FLOAT_TEXT), column.try_cast(target))
    return column.try_cast(target)


def _whole_part(column: Column) -> Column:
    return F.when(column >= 0, F.floor(column)).otherwise(F.ceil(column))


def tolerant_cast(
    column: Column, data_type: str, source: T.DataType | None = None
) -> Column:
    """Cast; a value that does not parse becomes null, also under ANSI mode.

    With the ``source`` type known, values that do not fit cost no exception.
    """
    if source is None:
        return column.try_cast(data_type)
    return guarded_cast(column, source, T.DataType.fromDDL(data_type))


def convert(
    df: DataFrame,
    targets: Mapping[str, str],
    allow_truncation: bool = True,
    boolean_as_number: bool = False,
    on_misfit: str = "fail",
) -> DataFrame:
    """Convert the columns in ``targets`` to the given types, others stay.

    Truncation means that a number, or a text that is one, loses its fraction,
    or a fraction its last digits, and a time its part of the day; with
    ``allow_truncation=False`` a value that does not come back unchanged from
    its new type is a misfit too, for every pair of types. Any other value that
    the new type cannot hold, such as one beyond its range or a text that does
    not parse, is a misfit always: it fails the job, or with
    ``on_misfit="null"`` becomes null; ``conversion_losses`` counts those.

    Booleans turn into ``true``/``false`` text; only with ``boolean_as_number``
    may they become 1/0, otherwise a numeric target is refused.
    """
    if on_misfit not in ("fail", "null"):
        raise ValueError("on_misfit should be 'fail' or 'null'")
    require_columns(df, targets)
    converted = []
    for field in df.schema.fields:
        column = named(field.name)
        if field.name in targets:
            target = targets[field.name]
            value, misfit = _converted(column, field, target, allow_truncation, boolean_as_number)
            instead = F.lit(None)
            if on_misfit == "fail":
                instead = F.raise_error(
                    F.concat(
                        F.lit(f"column {field.name}: "),
                        column.cast("string"),
                        F.lit(f" does not fit {target}"),
                    )
                )
            column = F.when(misfit, instead.cast(target)).otherwise(value).alias(field.name)
        converted.append(column)
    return df.select(converted)


def conversion_losses(
    df: DataFrame,
    targets: Mapping[str, str],
    allow_truncation: bool = True,
    boolean_as_number: bool = False,
) -> DataFrame:
    """How many values of each column do not fit: ``column_name, n_misfits``.

    One pass with partial sums; ``convert`` with ``on_misfit="null"`` makes
    these values null.
    """
    require_columns(df, targets)
    fields = {field.name: field for field in df.schema.fields}
    counts, rows = [], []
    for index, (name, target) in enumerate(targets.items()):
        _, misfit = _converted(
            named(name), fields[name], target, allow_truncation, boolean_as_number
        )
        counts.append(F.count_if(misfit).alias(f"n_{index}"))
        rows.append(
            F.struct(F.lit(name).alias("column_name"), F.col(f"n_{index}").alias("n_misfits"))
        )
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def _converted(
    column: Column,
    field: T.StructField,
    target: str,
    allow_truncation: bool,
    boolean_as_number: bool,
) -> tuple[Column, Column]:
    """The converted value, and whether it does not stand for the old one."""
    source_type, target_type = field.dataType, T.DataType.fromDDL(target)
    if isinstance(source_type, T.BooleanType):
        if boolean_as_number:
            return column.cast("int").cast(target_type), F.lit(False)
        if isinstance(target_type, T.NumericType):
            raise ValueError(f"column {field.name} is boolean, {target} is a number")
    if (
        isinstance(target_type, WHOLE_NUMBERS)
        and isinstance(source_type, T.StringType)
        and allow_truncation
    ):
        # A text with a fraction is a number whose fraction is lost.
        digits = T.DecimalType(38, 18)
        result = guarded_cast(guarded_cast(column, source_type, digits), digits, target_type)
    else:
        result = guarded_cast(column, source_type, target_type)
    misfit = column.isNotNull() & result.isNull()
    if not allow_truncation:
        if isinstance(target_type, T.StringType):
            return result, misfit
        back = guarded_cast(result, target_type, source_type)
        # A double holds more digits than a bigint's neighbours tell apart.
        changed = ~back.eqNullSafe(column)
        if isinstance(source_type, T.StringType):
            changed = result.isNull()
        misfit = misfit | (column.isNotNull() & changed)
    return result, misfit
