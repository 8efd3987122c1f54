"""Profiles of a table: summaries, missing values, duplicates, correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import missing_as_null, number, numeric_columns, quoted, require_columns
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.shape import records

#: What a block keeps of a pair of columns: rows where both are known, means, centred squares and products.
GRAM = ["n", "mx", "my", "xx", "yy", "xy"]
#: Rows of a batch that are multiplied at a time, and groups that the tasks' blocks are merged in first.
GRAM_ROWS, MERGED = 8192, 256


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and columns."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def dtypes(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def head(df: DataFrame, n: int = 10, order_by: Sequence[str] | None = None) -> DataFrame:
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (n - 1), min, exact quartiles and max; one row per numeric column."""
    columns = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggregates, rows = [], []
    for i, c in enumerate(columns):
        v = number(df, c)
        aggregates += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
        ]
        q = quartiles[c]
        rows.append(
            {
                "column": F.lit(c),
                "count": F.col(f"n{i}"),
                "mean": F.col(f"mean{i}"),
                "std": F.col(f"std{i}"),
                "min": F.col(f"min{i}"),
                "q25": F.lit(q[0.25]).cast("double"),
                "q50": F.lit(q[0.5]).cast("double"),
                "q75": F.lit(q[0.75]).cast("double"),
                "max": F.col(f"max{i}"),
            }
        )
    return records(df.agg(*aggregates), rows)


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, number of distinct values, most frequent value and its count per column.

    Among equally frequent values the smallest is named.
    """
    counts = _category_counts(df, columns)
    stats = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("cnt"))), F.lit(0)).alias("count"),
        F.count("value").alias("unique"),
        F.max(F.when(F.col("value").isNotNull(), F.col("cnt"))).alias("freq"),
    )
    best = counts.join(F.broadcast(stats.select("column", "freq")), "column").where("value is not null and cnt = freq")
    top = best.groupBy("column").agg(F.min("value").alias("top"))
    return stats.join(F.broadcast(top), "column", "left").select("column", "count", "unique", "top", "freq")


def _category_counts(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Rows per (column, value as text) of many columns from one scan."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]
    require_columns(df, *columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), missing_as_null(df, c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("cnt"))


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, as a count and as a percentage with one decimal."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count("*").alias("rows"), *[F.count(missing_as_null(df, c)).alias(f"known{i}") for i, c in enumerate(columns)]
    )
    rows = []
    for i, c in enumerate(columns):
        gap = F.col("rows") - F.col(f"known{i}")
        percent = F.round(100.0 * gap / F.nullif(F.col("rows"), F.lit(0)), 1)
        rows.append({"column": F.lit(c), "missing": gap, "percent": percent})
    return records(counts, rows)


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The tables a user sees right after loading."""
    result = {"shape": shape(df), "dtypes": dtypes(df), "missing": missing_summary(df), "head": head(df, n, order_by)}
    if numeric_columns(df):
        result["numeric"] = describe_numeric(df)
    if len(numeric_columns(df)) < len(df.columns):
        result["categorical"] = describe_categorical(df)
    return result


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair over the rows where both are known, in long form.

    A constant column gives NULL. All pairs come from one scan: a task keeps one block of counts, means and centred squares and products
    per pair, which later blocks merge into, and only blocks are shuffled.
    """
    columns = list(columns or numeric_columns(df))
    values = [number(df, c).alias(f"v{i}") for i, c in enumerate(columns)]
    schema = f"part long, {', '.join(f'{f} double' for f in GRAM)}, x int, y int"
    k = len(columns)
    blocks = df.select(*values).mapInArrow(lambda batches: _gram_rows(batches, k), schema)
    # Blocks of a pair meet in two steps, so that no group holds one of every task.
    near = blocks.groupBy("x", "y", F.pmod("part", F.lit(MERGED)).alias("part")).agg(F.collect_list(F.struct(*GRAM)).alias("blocks"))
    near = near.select("x", "y", _merge(F.col("blocks")).alias("b"))
    found = near.groupBy("x", "y").agg(F.collect_list("b").alias("blocks")).select("x", "y", _merge(F.col("blocks")).alias("b"))
    r = F.col("b.xy") / F.nullif(F.sqrt(F.col("b.xx")) * F.sqrt(F.col("b.yy")), F.lit(0.0))
    r = F.when(F.col("b.n") > 0, F.when(F.abs(r) <= 1, r).otherwise(F.signum(r)))
    name = lambda i: F.get(F.array(*[F.lit(c) for c in columns]), F.col(i))
    line = F.struct(name("x").alias("x"), name("y").alias("y"), r.alias("r"))
    back = F.struct(name("y").alias("x"), name("x").alias("y"), r.alias("r"))
    return found.select(F.inline(F.when(F.col("x") == F.col("y"), F.array(line)).otherwise(F.array(line, back))))


def _gram(values: np.ndarray) -> np.ndarray:
    """A block of one batch (rows, columns; NaN is unknown): per ordered pair n, means, centred squares and the centred product."""
    known = ~np.isnan(values)
    m = known.astype(float)
    counts = np.maximum(m.sum(axis=0), 1.0)
    filled = np.where(known, values, 0.0)
    centre = filled.sum(axis=0) / counts
    off = np.where(known, values - centre, 0.0)
    n = m.T @ m
    some = np.maximum(n, 1.0)
    # Of x over the rows where y is known too, around the mean of all known x of the batch.
    sums, squares = off.T @ m, (off * off).T @ m
    mean = sums / some
    around = squares - sums * mean
    product = off.T @ off - sums * mean.T
    return np.stack([n, centre[:, None] + mean, centre[None, :] + mean.T, np.maximum(around, 0.0), np.maximum(around.T, 0.0), product])


def _gram_merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1.0)
    dx, dy, weight = b[1] - a[1], b[2] - a[2], a[0] * share
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight])


def _gram_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """One row per pair of the block of all ``batches``."""
    from pyspark import TaskContext

    block = np.zeros((len(GRAM), k, k))
    with np.errstate(invalid="ignore", over="ignore"):
        for batch in batches:
            for start in range(0, batch.num_rows, GRAM_ROWS):
                part = batch.slice(start, GRAM_ROWS)
                block = _gram_merged(block, _gram(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns], axis=1)))
    x, y = np.triu_indices(k)
    arrays = [np.full(len(x), TaskContext.get().partitionId(), np.int64), *block[:, x, y], x.astype(np.int32), y.astype(np.int32)]
    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["part", *GRAM, "x", "y"])


def _merge(blocks: Column) -> Column:
    """An array of blocks of one pair as one block, merged in the same way as in a task."""

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        share = b["n"] / F.greatest(n, F.lit(1.0))
        dx, dy, weight = b["mx"] - a["mx"], b["my"] - a["my"], a["n"] * share
        return F.struct(
            n.alias("n"), (a["mx"] + dx * share).alias("mx"), (a["my"] + dy * share).alias("my"),
            (a["xx"] + b["xx"] + dx * dx * weight).alias("xx"), (a["yy"] + b["yy"] + dy * dy * weight).alias("yy"), (a["xy"] + b["xy"] + dx * dy * weight).alias("xy"),
        )

    return F.aggregate(blocks, F.struct(*[F.lit(0.0).alias(f) for f in GRAM]), add)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per known value, most frequent first."""
    require_columns(df, column)
    return (
        df.select(missing_as_null(df, column).alias("value"))
        .where("value is not null")
        .groupBy("value")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "value")
    )


def sum_by(df: DataFrame, column: str, value: str) -> DataFrame:
    """Sum of ``value`` per known value of ``column``."""
    require_columns(df, column)
    return (
        df.select(missing_as_null(df, column).alias("value"), number(df, value).alias("v"))
        .where("value is not null")
        .groupBy("value")
        .agg(F.sum("v").alias("total"))
        .orderBy("value")
    )


def value_range(df: DataFrame, column: str) -> DataFrame:
    v = number(df, column)
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"))


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 11) -> DataFrame:
    """Distinct known values per text column and whether they count as few.

    One pass: rows are reduced to distinct (column, value) pairs before the shuffle.
    """
    unique = F.count("value").alias("unique")
    counts = _category_counts(df, columns).groupBy("column").agg(unique)
    return counts.withColumn("low", F.col("unique") <= limit)


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The most frequent known value; the smallest one among equals."""
    counts = (
        df.select(missing_as_null(df, column).alias("value"))
        .where("value is not null")
        .groupBy("value")
        .agg(F.count("*").alias("cnt"))
    )
    best = F.min(F.struct((-F.col("cnt")).alias("minus"), "value"))
    return counts.agg(best.alias("b")).select("b.value", (-F.col("b.minus")).alias("count"))


def skew_kurtosis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Population skewness and excess kurtosis with a shape label; empty columns are left out."""
    columns = list(columns or numeric_columns(df))
    aggregates, rows = [], []
    for i, c in enumerate(columns):
        v = number(df, c)
        aggregates += [F.count(v).alias(f"n{i}"), F.skewness(v).alias(f"s{i}"), F.kurtosis(v).alias(f"k{i}")]
        rows.append({"column": F.lit(c), "n": F.col(f"n{i}"), "skewness": F.col(f"s{i}"), "kurtosis": F.col(f"k{i}")})
    table = records(df.agg(*aggregates), rows).where("n > 0")
    return table.select(
        "column",
        "skewness",
        "kurtosis",
        _sign_label("skewness", "right-skewed", "left-skewed", "symmetric").alias("skew_label"),
        _sign_label("kurtosis", "leptokurtic", "platykurtic", "mesokurtic").alias("kurtosis_label"),
    )


def _sign_label(name: str, positive: str, negative: str, zero: str) -> Column:
    c = F.col(name)
    return F.when(c > 0, positive).when(c < 0, negative).when(c == 0, zero)
