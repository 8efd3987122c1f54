"""Power transformations and the search for their parameter by maximum likelihood.

Every round scores a grid of parameters by plain aggregates in one pass over the column
and shrinks the bracket to the neighbours of the best one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import number

GRID = 33
START = (-2.0, 2.0)
PARABOLA_STEP = 2e-3
MAX_ROUNDS = 12


def boxcox_value(x: Column, power: Column | float) -> Column:
    return _expm1_over(F.log(x), power)


def yeojohnson_value(x: Column, power: Column | float) -> Column:
    logs = F.log1p(F.abs(x))
    return F.when(x >= 0, _expm1_over(logs, power)).otherwise(-_expm1_over(logs, 2.0 - power))


def _expm1_over(logs: Column, power: Column | float) -> Column:
    """(exp(power * logs) - 1) / power, and its limit at 0."""
    if isinstance(power, float):
        return logs if abs(power) < 1e-12 else F.expm1(power * logs) / power
    return F.when(F.abs(power) < 1e-12, logs).otherwise(F.expm1(power * logs) / F.nullif(power, F.lit(0.0)))


def boxcox_lambda(df: DataFrame, column: str) -> float:
    x = number(df, column)
    row = df.agg(
        F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(F.log(x)).alias("mean")
    ).first()
    if row["n"] and row["low"] <= 0:
        raise ValueError(f"Box-Cox needs positive values: '{column}' has {row['low']}")
    if not row["n"] or row["low"] == row["high"]:
        return 1.0
    # centred logarithms keep the variance within range for any power
    centred = df.select((F.log(x) - row["mean"]).alias("x"))

    def likelihood(power: float, spread: float) -> float:
        return -row["n"] / 2 * math.log(spread) - row["n"] * row["mean"]

    return _search(centred, lambda power: _expm1_over(F.col("x"), power), likelihood)


def yeojohnson_lambda(df: DataFrame, column: str) -> float:
    x = number(df, column)
    logs = F.signum(x) * F.log1p(F.abs(x))
    row = df.agg(
        F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.sum(logs).alias("logs")
    ).first()
    if not row["n"] or row["low"] == row["high"]:
        return 1.0

    def likelihood(power: float, spread: float) -> float:
        return -row["n"] / 2 * math.log(spread) + (power - 1) * row["logs"]

    return _search(df.select(x.alias("x")), lambda power: yeojohnson_value(F.col("x"), power), likelihood)


def _search(
    values: DataFrame, curve: Callable[[float], Column], likelihood: Callable[[float, float], float]
) -> float:
    values = values.where("x is not null")
    low, high = START
    for _ in range(MAX_ROUNDS):
        step = (high - low) / (GRID - 1)
        powers = [low + i * step for i in range(GRID)]
        found = values.agg(*[F.var_pop(curve(power)).alias(f"s{i}") for i, power in enumerate(powers)]).first()
        spreads = [found[f"s{i}"] for i in range(GRID)]
        scores = [likelihood(p, s) if s and math.isfinite(s) else -math.inf for p, s in zip(powers, spreads, strict=True)]
        best = max(range(GRID), key=scores.__getitem__)
        best_power = powers[best]
        if best in (0, GRID - 1):
            # the maximum lies outside: move the bracket, twice as wide
            width = high - low
            low, high = best_power - width, best_power + width
            continue
        if step <= PARABOLA_STEP:
            return _vertex(best_power, step, *scores[best - 1 : best + 2])
        low, high = powers[best - 1], powers[best + 1]
    raise RuntimeError(f"the search for the power did not settle in {MAX_ROUNDS} rounds")


def _vertex(centre: float, step: float, left: float, middle: float, right: float) -> float:
    """Top of the parabola through three neighbouring scores."""
    bend = left - 2 * middle + right
    return centre if bend >= 0 else centre + 0.5 * step * (left - right) / bend
