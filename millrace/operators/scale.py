"""Scaling and transformation of numeric columns.

``fit`` learns a few numbers per column with aggregates over all rows;
``transform`` is a projection. Missing values stay missing, the output is double.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import bucket_of, constant_array, number, quoted, require_numeric
from millrace.operators.power import boxcox_lambda, boxcox_value, yeojohnson_lambda, yeojohnson_value
from millrace.operators.profile import describe_numeric
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.rank import quantile_grid

METHODS = {
    "minmax": "to the range 0 to 1",
    "standard": "mean 0, population standard deviation 1",
    "robust": "median 0, divided by the interquartile range",
    "maxabs": "divided by the largest absolute value",
    "quantile": "to a uniform distribution over 0 to 1",
    "log": "log(1 + x)",
    "boxcox": "Box-Cox power, then standard; positive values only",
    "yeojohnson": "Yeo-Johnson power, then standard",
}
MAX_QUANTILES = 1000


@dataclass(frozen=True)
class Linear:
    """(f(x) - shift) / width, where f is the identity, log1p or a power transformation."""

    column: str
    shift: float = 0.0
    width: float = 1.0
    kind: str = "identity"
    power: float = 1.0

    def transform(self, df: DataFrame) -> DataFrame:
        x = number(df, self.column)
        value = {"identity": lambda: x, "log": lambda: F.log1p(x)}.get(self.kind)
        if value is None:
            curve = boxcox_value if self.kind == "boxcox" else yeojohnson_value
            scaled = curve(x, self.power)
        else:
            scaled = value()
        if self.shift or self.width != 1.0:
            scaled = (scaled - self.shift) / self.width
        return df.withColumn(self.column, scaled)


@dataclass(frozen=True)
class Uniform:
    column: str
    quantiles: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        grid = np.array(self.quantiles)
        place = np.linspace(0.0, 1.0, len(grid))
        # a value that fills several places of the grid has a first and a last one, and stands between them itself
        spots, first = np.unique(grid, return_index=True)
        last = np.append(first[1:], len(grid)) - 1
        value = F.col("_v")
        k = bucket_of(value, spots.tolist())
        at = lambda xs, i: F.get(constant_array(xs.tolist()), i)
        start, end = at(place[last], F.col("_k") - 1), at(place[first], F.col("_k"))
        low, high = at(spots, F.col("_k") - 1), at(spots, F.col("_k"))
        on = (at(place[first], F.col("_k")) + at(place[last], F.col("_k"))) / 2
        share = (value - low) / F.nullif(high - low, F.lit(0.0))
        scaled = (
            F.when(value <= float(grid[0]), 0.0).when(value >= float(grid[-1]), 1.0).when(high == value, on).otherwise(start + (end - start) * share)
        )
        placed = df.withColumn("_v", number(df, self.column)).withColumn("_k", k)
        return placed.withColumn(self.column, F.when(value.isNotNull(), scaled)).select(*[quoted(c) for c in df.columns])


@dataclass(frozen=True)
class Scaler:
    steps: list

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df


def fit(df: DataFrame, columns: Sequence[str], method: str) -> Scaler:
    if not columns:
        raise ValueError("name at least one numeric column to scale")
    if method not in METHODS:
        raise ValueError(f"unknown scaling method: {method}")
    require_numeric(df, *columns)
    if method == "log":
        return Scaler([Linear(c, kind="log") for c in columns])
    if method in ("boxcox", "yeojohnson"):
        return Scaler([_fit_power(df, c, method) for c in columns])
    if method == "quantile":
        return Scaler([_fit_uniform(df, c) for c in columns])
    if method == "robust":
        found = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        return Scaler([_linear(c, q[0.5], _gap(q[0.25], q[0.75])) for c, q in found.items()])
    aggregates = []
    for i, c in enumerate(columns):
        x = number(df, c)
        aggregates += {
            "minmax": [F.min(x).alias(f"shift{i}"), (F.max(x) - F.min(x)).alias(f"width{i}")],
            "standard": [F.avg(x).alias(f"shift{i}"), F.stddev_pop(x).alias(f"width{i}")],
            "maxabs": [F.lit(0.0).alias(f"shift{i}"), F.max(F.abs(x)).alias(f"width{i}")],
        }[method]
    row = df.agg(*aggregates).first()
    return Scaler([_linear(c, row[f"shift{i}"], row[f"width{i}"]) for i, c in enumerate(columns)])


def scale(df: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    return fit(df, columns, method).transform(df)


def _gap(low: float | None, high: float | None) -> float | None:
    return None if low is None else high - low


def _linear(column: str, shift: float | None, width: float | None, **more) -> Linear:
    return Linear(column, shift or 0.0, width or 1.0, **more)


def _fit_uniform(df: DataFrame, column: str) -> Uniform | Linear:
    x = number(df, column)
    n = df.agg(F.count(x)).first()[0]
    if not n:
        return Linear(column)
    grid = quantile_grid(df, x, max(2, min(MAX_QUANTILES, n)))
    return Uniform(column, tuple(np.maximum.accumulate(grid)))


def _fit_power(df: DataFrame, column: str, method: str) -> Linear:
    x = number(df, column)
    if method == "boxcox":
        power, curve = boxcox_lambda(df, column), boxcox_value
    else:
        power, curve = yeojohnson_lambda(df, column), yeojohnson_value
    y: Column = curve(x, power)
    row = df.agg(F.avg(y).alias("shift"), F.stddev_pop(y).alias("width")).first()
    return _linear(column, row["shift"], row["width"], kind=method, power=power)


def comparison(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The numbers beside the histograms of a transformation: a row per column and stage with its profile."""
    old = describe_numeric(before, columns).withColumn("stage", F.lit("before"))
    return old.unionByName(describe_numeric(after, columns).withColumn("stage", F.lit("after")))
