"""Column helpers shared by the operators. Everything here is a plain expression."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def require_numeric(df: DataFrame, *names: str) -> None:
    require_columns(df, *names)
    wrong = [n for n in names if not is_numeric(df, n)]
    if wrong:
        raise ValueError(f"not a numeric column: {', '.join(wrong)}")


def quoted(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing_as_null(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL; other types unchanged."""
    column = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    return column


def number(df: DataFrame, name: str) -> Column:
    """The column as double, NaN turned into NULL."""
    require_numeric(df, name)
    return missing_as_null(df, name).cast("double")


def order_number(df: DataFrame, name: str) -> Column:
    """A number that sorts like the column, for number, date and time columns."""
    kind = df.schema[name].dataType
    column = quoted(name)
    if isinstance(kind, T.NumericType):
        return missing_as_null(df, name).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return micros(column).cast("double")
    raise ValueError(f"'{name}' cannot be an order column: use a number, date or timestamp")


def micros(column: Column) -> Column:
    """Microseconds since 1970-01-01 of a time-zone-free timestamp, whatever the session zone."""
    days = F.unix_date(column.cast("date")).cast("bigint")
    seconds = F.extract(F.lit("SECOND"), column)
    clock = F.hour(column) * 3600 + F.minute(column) * 60
    return (days * 86400 + clock) * 1000000 + (seconds * 1000000).cast("bigint")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL instead of an ANSI error on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def constant_array(values: Sequence[float]) -> Column:
    """An array of doubles as one folded constant, far quicker to plan than one literal each."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def bucket_of(value: Column, thresholds: Sequence[float]) -> Column:
    """How many of the sorted ``thresholds`` lie below ``value``.

    The thresholds are searched in two levels, so a row costs about twice the
    square root of their number.
    """
    if not thresholds:
        return F.lit(0)
    width = math.ceil(math.sqrt(len(thresholds)))
    below = lambda t: t < value
    chunk = F.size(F.filter(constant_array(thresholds[width - 1 :: width]), below))
    inside = F.filter(F.slice(constant_array(thresholds), chunk * width + 1, F.lit(width)), below)
    return chunk * width + F.size(inside)


def rounded(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits)
