"""Duplicates and column type conversion."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import missing_as_null, quoted, require_columns
from millrace.operators.profile import missing_summary
from millrace.session import materialise

# Target types, and the words read as true.
TARGET_TYPES = ["INT", "FLOAT", "DATETIME", "BOOLEAN", "STRING"]
TRUE_WORDS = ["true", "1", "yes", "y"]

#: How a date may be written, the time behind it optional. Of equally fitting formats the earlier one is taken, so the month leads.
DATE_FORMATS = [
    "yyyy/M/d[ H:m[:s]]",
    "M/d/yyyy[ H:m[:s]]",
    "d/M/yyyy[ H:m[:s]]",
    "M-d-yyyy[ H:m[:s]]",
    "d-M-yyyy[ H:m[:s]]",
    "M.d.yyyy[ H:m[:s]]",
    "d.M.yyyy[ H:m[:s]]",
    "d MMM yyyy[ H:m[:s]]",
    "MMM d, yyyy[ H:m[:s]]",
    "yyyyMMdd",
]

#: Whole days on either side of 1970-01-01 that the microseconds of a timestamp reach.
MAX_DAYS = 106_751_991


def duplicate_count(df: DataFrame) -> DataFrame:
    """How many rows have at least one equal row; every member of such a group counts."""
    repeated = _repeated_digests(df)
    if repeated is not None:
        df = _digested(df).join(F.broadcast(repeated), DIGEST, "left_semi").drop(*DIGEST)
    groups = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("_copies"))
    total = F.sum(F.when(F.col("_copies") > 1, F.col("_copies")).otherwise(0))
    return groups.agg(F.coalesce(total, F.lit(0)).alias("duplicate_count"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One of each group of equal rows."""
    repeated = _repeated_digests(df)
    if repeated is None:
        return df.dropDuplicates()
    marked = _digested(df)
    single = marked.join(F.broadcast(repeated), DIGEST, "left_anti").drop(*DIGEST)
    return single.union(marked.join(F.broadcast(repeated), DIGEST, "left_semi").drop(*DIGEST).dropDuplicates())


DIGEST = ["_digest0", "_digest1"]
#: Digests that are broadcast at most: 16 bytes each.
MAX_DIGESTS = 500_000


def _digested(df: DataFrame) -> DataFrame:
    """The rows with 128 bits of hash."""
    every = [quoted(c) for c in df.columns]
    return df.withColumns({"_digest0": F.xxhash64(*every), "_digest1": F.xxhash64(F.lit(1), *every)})


def _repeated_digests(df: DataFrame) -> DataFrame | None:
    """The digests that more than one row has, or None where rows are better shuffled whole: narrow ones, or with too many such digests.

    Only digests are shuffled to count them. Rows with one of their own have no equal row; the others must be
    compared whole, since different rows may share a digest.
    """
    if all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) for f in df.schema.fields):
        return None
    counts = _digested(df).groupBy(*DIGEST).agg(F.count("*").alias("_n"))
    repeated = materialise(counts.where("_n > 1").select(*DIGEST))
    return repeated if repeated.count() <= MAX_DIGESTS else None


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the rows where all of ``columns`` are known."""
    require_columns(df, *columns)
    for c in columns:
        df = df.where(missing_as_null(df, c).isNotNull())
    return df


def convert(df: DataFrame, column: str, target: str, formats: Sequence[str] | None = None) -> DataFrame:
    """Change the type of one column; values that cannot be read become missing.

    Dates in text: a value that fits several formats (03/04/2021) is read by the one that reads most
    values of the column, and what that one does not read falls to the next. ``formats`` are tried in the order given, without a vote.
    """
    require_columns(df, column)
    if target not in TARGET_TYPES:
        raise ValueError(f"unknown target type: {target}")
    return df.withColumn(column, converted(df, column, target, formats))


def date_formats(df: DataFrame, column: str, formats: Sequence[str] = DATE_FORMATS) -> list[str]:
    """``formats`` by the number of values that each of them reads, most first; one aggregate over the whole column."""
    text = F.trim(missing_as_null(df, column).cast("string"))
    odd = F.when(text.try_cast("timestamp_ntz").isNull(), text).alias("odd")
    read = [F.count(F.try_to_timestamp("odd", F.lit(f))).alias(str(i)) for i, f in enumerate(formats)]
    votes = df.select(odd).where("odd is not null").agg(*read).first()
    return sorted(formats, key=lambda f: -votes[list(formats).index(f)])


def converted(df: DataFrame, column: str, target: str, formats: Sequence[str] | None = None) -> Column:
    """The converted column. A date column of text is voted on first, but for a stream, which has no end to vote at."""
    value = missing_as_null(df, column)
    kind = df.schema[column].dataType
    numeric = isinstance(kind, T.NumericType)
    boolean = isinstance(kind, T.BooleanType)
    if target == "STRING":
        return value.cast("string")
    if target == "BOOLEAN":
        if boolean:
            return value
        if numeric:
            return value != 0
        return F.coalesce(F.lower(value.cast("string")).isin(TRUE_WORDS), F.lit(False))
    if target == "DATETIME":
        text = not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
        if formats is None and text and not df.isStreaming:
            formats = date_formats(df, column)
        return _to_datetime(value, kind, formats or DATE_FORMATS)
    if numeric or boolean:
        return value.cast("double") if target == "FLOAT" else value.try_cast("bigint")
    digits = F.regexp_replace(value.cast("string"), r"[^0-9.\-]", "").try_cast("double")
    return digits if target == "FLOAT" else digits.try_cast("bigint")


def _to_datetime(value: Column, kind: T.DataType, formats: Sequence[str]) -> Column:
    if isinstance(kind, T.NumericType):
        # nanoseconds since 1970-01-01
        whole = _whole_nanoseconds(value) if isinstance(kind, T.DecimalType) else value.try_cast("bigint")
        day = F.pmod(whole, F.lit(86_400_000_000_000)).cast("bigint")
        days = F.call_function("div", whole - day, F.lit(86_400_000_000_000)).cast("int")
        seconds = (F.floor(day / 1000) / 1e6).cast("decimal(18,6)")
        nothing = F.lit(0)
        return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(days, nothing, nothing, seconds)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("timestamp_ntz")
    text = F.trim(value.cast("string"))
    return F.coalesce(
        text.try_cast("timestamp_ntz"),
        *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats],
    )


def _whole_nanoseconds(value: Column) -> Column:
    """A decimal truncated toward zero, exact beyond the range of bigint; missing where no timestamp can be."""
    limit = F.lit(Decimal(MAX_DAYS * 86_400_000_000_000))
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    return F.when((whole > -limit) & (whole < limit), whole).cast("decimal(22,0)")


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old and new type of every column of either table, in the order they appear."""
    old = {f.name: f.dataType.simpleString() for f in before.schema.fields}
    new = {f.name: f.dataType.simpleString() for f in after.schema.fields}
    names = list(old) + [c for c in new if c not in old]
    rows = [(i, c, old.get(c), new.get(c), old.get(c) != new.get(c)) for i, c in enumerate(names)]
    return before.sparkSession.createDataFrame(
        rows, "position int, column string, before string, after string, changed boolean"
    )


def downcast(df: DataFrame) -> DataFrame:
    """Smaller types: boolean for at most two distinct numbers, float for double, int for bigint.

    A bigint column that does not fit into int keeps its type. Other columns become text.
    """
    numbers = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    bounds = []
    for i, f in enumerate(numbers):
        v = missing_as_null(df, f.name)
        bounds += [F.min(v).alias(f"low{i}"), F.max(v).alias(f"high{i}")]
    ends = df.agg(*bounds).first() if bounds else None
    # at most two distinct values means that nothing lies strictly between the smallest and the largest
    between = [
        F.count_if((quoted(f.name) > F.lit(ends[f"low{i}"])) & (quoted(f.name) < F.lit(ends[f"high{i}"]))).alias(f"n{i}")
        for i, f in enumerate(numbers)
    ]
    more = df.agg(*between).first() if numbers else None
    changes = {f.name: quoted(f.name).cast("string") for f in df.schema.fields if f not in numbers}
    for i, f in enumerate(numbers):
        if not more[f"n{i}"]:
            changes[f.name] = missing_as_null(df, f.name) != 0
        elif isinstance(f.dataType, T.DoubleType):
            changes[f.name] = quoted(f.name).cast("float")
        elif isinstance(f.dataType, T.LongType) and ends[f"low{i}"] >= -(2**31) and ends[f"high{i}"] < 2**31:
            changes[f.name] = quoted(f.name).cast("int")
    return df.withColumns(changes)


def conversion_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Type and number of missing values of every column before and after a conversion."""
    types = schema_changes(before, after)
    old = missing_summary(before).select("column", F.col("missing").alias("missing_before"))
    new = missing_summary(after).select("column", F.col("missing").alias("missing_after"))
    return types.join(F.broadcast(old), "column", "left").join(F.broadcast(new), "column", "left")
