"""Filling of missing values in one column.

``fit`` learns one constant and gives a step that is a plain projection, so it
also runs on a stream. Order-dependent methods need ``order_by``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import is_numeric, missing_as_null, number, order_number, require_columns
from millrace.operators.clean import drop_missing
from millrace.operators.profile import most_frequent
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.rank import ordering, with_order_bucket
from millrace.operators.sample import uniform

METHODS = {
    "drop": "leave out the rows without a value",
    "specific_value": "a given value",
    "ffill": "the last value before, in row order",
    "bfill": "the next value after, in row order",
    "distribution": "draws from a normal distribution with the column's mean and spread, never below 0",
    "mean": "the mean",
    "median": "the median",
    "nearest_neighbor": "the known value closest in row order",
    "interpolate": "the straight line between the known neighbours",
}
CONSTANT_METHODS = ("specific_value", "mean", "median")
ORDERED_METHODS = ("ffill", "bfill", "nearest_neighbor", "interpolate")


@dataclass(frozen=True)
class ConstantFill:
    column: str
    value: object

    def transform(self, df: DataFrame) -> DataFrame:
        if self.value is None:
            return df
        filled = F.coalesce(missing_as_null(df, self.column), F.lit(self.value))
        return df.withColumn(self.column, filled)


def fit(df: DataFrame, column: str, method: str, value: object = None) -> ConstantFill:
    require_columns(df, column)
    if method == "specific_value":
        if value is None:
            raise ValueError("a replacement value is needed for this method")
        return ConstantFill(column, value)
    if method == "mean":
        return ConstantFill(column, df.agg(F.avg(number(df, column))).first()[0])
    if method == "median":
        return ConstantFill(column, exact_quantiles(df, [column], [0.5])[column][0.5])
    raise ValueError(f"not a constant method: {method}")


def impute(
    df: DataFrame,
    column: str,
    method: str,
    value: object = None,
    order_by: Sequence[str] | None = None,
    nearest: str = "order",
    key: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Fill the missing values of one column.

    ``nearest="order"`` takes the known value closest along the first order
    column, the earlier one among equals; ``nearest="first"`` takes the first
    known value for every gap. ``key`` names columns that identify a row, which
    makes the draws of ``distribution`` independent of the partitioning.
    """
    require_columns(df, column)
    if method not in METHODS:
        raise ValueError(f"unknown imputation method: {method}")
    if method in CONSTANT_METHODS:
        return fit(df, column, method, value).transform(df)
    if method == "drop":
        return drop_missing(df, [column])
    if method == "distribution":
        return _draw(df, column, key, seed) if is_numeric(df, column) else df
    if not order_by:
        raise ValueError(f"'{method}' depends on the row order: give order_by")
    require_columns(df, *order_by)
    if method in ("ffill", "bfill"):
        return _neighbours(df, column, order_by, backward=method == "ffill", forward=method == "bfill")
    if not is_numeric(df, column):
        if method == "interpolate":
            raise ValueError(f"'{column}' is not numeric")
        return df
    if method == "nearest_neighbor" and nearest == "first":
        first = _first_known(df, column, order_by)
        return ConstantFill(column, first).transform(df)
    return _between(df, column, order_by, linear=method == "interpolate")


def _first_known(df: DataFrame, column: str, order_by: Sequence[str]) -> object:
    known = missing_as_null(df, column)
    keys = [missing_as_null(df, c) for c in order_by]
    return df.agg(F.min_by(known, F.when(known.isNotNull(), F.struct(*keys)))).first()[0]


def _with_neighbours(
    df: DataFrame, column: str, order_by: Sequence[str], backward: bool, forward: bool
) -> DataFrame:
    """Add the nearest known (value, place) before and after every row.

    Inside a bucket a running window finds it; across buckets a table with the
    place of the outermost known value of every bucket does.
    """
    place = order_number(df, order_by[0])
    known = missing_as_null(df, column)
    entry = F.when(known.isNotNull(), F.struct(known.alias("v"), place.alias("o")))
    bucketed = with_order_bucket(df, order_by)
    data = bucketed.withColumns({"_known": entry, "_place": place})
    running = (Window.unboundedPreceding, Window.currentRow)
    inside = Window.partitionBy("_bucket")
    sides = []
    if backward:
        up = inside.orderBy(*ordering(df, order_by)).rowsBetween(*running)
        data, sides = data.withColumn("_before", F.last("_known", ignorenulls=True).over(up)), [*sides, "_before"]
    if forward:
        down = inside.orderBy(*[missing_as_null(df, c).desc_nulls_last() for c in order_by], F.desc("_tie")).rowsBetween(*running)
        data, sides = data.withColumn("_after", F.last("_known", ignorenulls=True).over(down)), [*sides, "_after"]
    carried = _carried(df, bucketed, known, place, order_by).withColumnRenamed("_bucket", "_b")
    # The values may be long texts: they are never broadcast, and only rows that found none in their bucket fetch one.
    needs = F.lit(False)
    for side in sides:
        needs = needs | F.col(side).isNull()
    data = data.join(carried.hint("merge"), (F.col("_bucket") == F.col("_b")) & needs, "left")
    return data.withColumns({side: F.coalesce(side, f"_carry{side}") for side in sides})


def _carried(df: DataFrame, bucketed: DataFrame, known: Column, place: Column, order_by: Sequence[str]) -> DataFrame:
    """Per bucket the nearest known entries in the buckets before and behind it: _bucket, _carry_before, _carry_after.

    What is looked for across the buckets, and broadcast, is where the entries stand: order keys and a hash of the row, one
    row a bucket. The entries themselves are fetched by joins with one row a bucket on either side.
    """
    line = F.struct(*[missing_as_null(df, c).alias(f"k{i}") for i, c in enumerate(order_by)], "_tie")
    lines = bucketed.select("_bucket", F.when(known.isNotNull(), line).alias("line"), F.struct(known.alias("v"), place.alias("o")).alias("entry"))
    every = lines.groupBy("_bucket").agg(F.max("line").alias("last"), F.min("line").alias("first"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    some = F.when(F.col("last").isNotNull(), F.col("_bucket"))
    source = every.select("_bucket", F.last(some, ignorenulls=True).over(earlier).alias("_left"), F.last(some, ignorenulls=True).over(later).alias("_right"))
    # Only rows that repeat whole share a line, and these say the same.
    found = lines.join(F.broadcast(every), "_bucket").where("line = last or line = first").groupBy("_bucket")
    found = found.agg(F.max(F.when(F.col("line") == F.col("last"), F.col("entry"))).alias("at_last"), F.max(F.when(F.col("line") == F.col("first"), F.col("entry"))).alias("at_first"))
    before = found.select(F.col("_bucket").alias("_left"), F.col("at_last").alias("_carry_before"))
    after = found.select(F.col("_bucket").alias("_right"), F.col("at_first").alias("_carry_after"))
    carried = source.join(before.hint("merge"), "_left", "left").join(after.hint("merge"), "_right", "left")
    return carried.select("_bucket", "_carry_before", "_carry_after")


def _neighbours(df: DataFrame, column: str, order_by: Sequence[str], backward: bool, forward: bool) -> DataFrame:
    data = _with_neighbours(df, column, order_by, backward, forward)
    return data.withColumn(column, F.col("_before.v" if backward else "_after.v")).select(*df.columns)


def _between(df: DataFrame, column: str, order_by: Sequence[str], linear: bool) -> DataFrame:
    data = _with_neighbours(df, column, order_by, backward=True, forward=True)
    back, ahead = F.col("_place") - F.col("_before.o"), F.col("_after.o") - F.col("_place")
    if linear:
        share = back / F.nullif(back + ahead, F.lit(0.0))
        line = F.col("_before.v") + (F.col("_after.v") - F.col("_before.v")) * F.coalesce(share, F.lit(0.0))
        filled = F.coalesce(F.col("_known.v").cast("double"), line)
    else:
        closer = F.when(ahead < back, F.col("_after.v")).otherwise(F.coalesce("_before.v", "_after.v"))
        filled = F.coalesce("_known.v", closer)
    return data.withColumn(column, filled).select(*df.columns)


def _draw(df: DataFrame, column: str, key: Sequence[str] | None, seed: int) -> DataFrame:
    v = number(df, column)
    row = df.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")).first()
    if row["mean"] is None:
        return df
    drawn = F.greatest(F.lit(0.0), F.lit(row["mean"]) + F.lit(row["std"] or 0.0) * standard_normal(key, seed))
    return df.withColumn(column, F.coalesce(v, drawn))


def standard_normal(key: Sequence[str] | None, seed: int) -> Column:
    """A normal draw per row: from a hash of ``key`` (Box and Muller) or, without one, ``randn``."""
    if not key:
        return F.randn(seed)
    half = 0.5 / float(2**52)
    return F.sqrt(-2 * F.log(uniform(key, 2 * seed) + half)) * F.cos(2 * math.pi * (uniform(key, 2 * seed + 1) + half))


def impute_target(df: DataFrame, target: str, task: str) -> tuple[DataFrame, str]:
    """Fill a model target: the mean for regression, else the most frequent number or 'missing'."""
    require_columns(df, target)
    if task not in ("regression", "classification"):
        raise ValueError(f"unknown task: {task}")
    missing = df.agg(F.count_if(missing_as_null(df, target).isNull())).first()[0]
    if not missing:
        return df, "the target has no missing values"
    if task == "regression":
        step, how = fit(df, target, "mean"), "the mean"
    elif is_numeric(df, target):
        best = most_frequent(df, target).first()
        step, how = ConstantFill(target, best["value"] if best else None), "the most frequent value"
    else:
        step, how = ConstantFill(target, "missing"), "'missing'"
    return step.transform(df), f"filled {missing} missing target values with {how} ({step.value})"
