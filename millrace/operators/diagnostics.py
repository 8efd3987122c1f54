"""Distribution diagnostics of numeric columns: Q-Q points, normality tests, outliers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from millrace.functions.columns import number, numeric_columns, ratio
from millrace.functions.normal import normal_cdf, normal_ppf
from millrace.functions.tails import STANDARD_NORMAL, kolmogorov_two_sided, normal_tail
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.rank import ranked, ranked_columns
from millrace.operators.sample import SEED, share_for, uniform
from millrace.operators.shape import records
from millrace.session import materialise

#: The approximation of Royston holds up to this many values.
MAX_SHAPIRO = 5000
FIRST_OUTLIERS = 50
#: A run of more equal values than this adds up its normal quantiles in closed form, but for so many positions at either end.
RUN, EDGE = 16, 1024
MOMENTS = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "skewness": F.skewness, "kurtosis": F.kurtosis}

# Anderson-Darling critical values for the normal law and their levels in percent.
ANDERSON_CRITICAL = [0.576, 0.656, 0.787, 0.918, 1.092]
ANDERSON_LEVELS = [15.0, 10.0, 5.0, 2.5, 1.0]

# Polynomials of Royston's AS R94, constant term first.
SHAPIRO_LAST = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
SHAPIRO_SECOND_LAST = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SHAPIRO_LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
SHAPIRO_LARGE_SPREAD = [-0.4803, -0.082676, 0.0030302]
SHAPIRO_SMALL_SHIFT = [-2.273, 0.459]
SHAPIRO_SMALL_MEAN = [0.544, -0.39978, 0.025054, -6.714e-4]
SHAPIRO_SMALL_SPREAD = [1.3822, -0.77857, 0.062767, -0.0020322]


def _no_values(column: str) -> ValueError:
    return ValueError(f"'{column}' holds no number, so there is no distribution to describe")


def moments(df: DataFrame, column: str) -> Row:
    x = number(df, column)
    row = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).first()
    if not row["n"]:
        raise _no_values(column)
    return row


def theoretical(position: Column, n: Column) -> Column:
    """Normal quantile of the Filliben median rank of the position-th of n values."""
    last = F.pow(F.lit(0.5), 1.0 / n)
    middle = (position - 0.3175) / (n + 0.365)
    return normal_ppf(F.when(position == n, last).when(position == 1, 1 - last).otherwise(middle))


def qq_points(df: DataFrame, column: str, max_points: int | None = None) -> DataFrame:
    """Sorted values against normal quantiles; ``max_points`` thins them to evenly spaced positions."""
    n = moments(df, column)["n"]
    return _points(ranked(df, number(df, column)), n, max_points)


def _points(table: DataFrame, n: int, max_points: int | None) -> DataFrame:
    points = min(n, max_points or n)
    if points == n:
        each = table.withColumn("position", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("ties"))))
    else:
        # point k sits at position 1 + floor(k * (n - 1) / (points - 1)); find the k inside this run of ties
        gap = (n - 1) / (points - 1)
        first = F.greatest(F.lit(0), F.floor(F.col("before") / gap) - 1)
        last = F.least(F.lit(points - 1), F.ceil((F.col("before") + F.col("ties")) / gap) + 1)
        place = 1 + F.floor(F.col("k") * F.lit(n - 1) / F.lit(points - 1))
        each = (
            table.withColumn("k", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
            .withColumn("position", place)
            .where("position > before and position <= before + ties")
        )
    return each.select(
        "position", theoretical(F.col("position"), F.col("n")).alias("theoretical"), F.col("value").alias("sample")
    )


def qq_fit(df: DataFrame, column: str) -> DataFrame:
    """Least-squares line and correlation of all Q-Q points."""
    x = number(df, column)
    mean = df.agg(F.avg(x)).first()[0]
    return _lines(ranked(df, x).withColumn("column", F.lit(column)), F.lit(mean).cast("double")).drop("column")


def _sums_upto(place: Column, q: Column, n: Column) -> tuple[Column, Column]:
    """Two terms whose differences between half positions are the sums of q and of q * q over the positions between; q is the normal quantile.

    Euler and Maclaurin's midpoint rule: the integral, less a 24th of the first derivative, plus 7 / 5760 of the third. From the
    EDGE-th position on, the term after these is below the rounding of a double.
    """
    f = (n + 0.365) * F.exp(-q * q / 2) / math.sqrt(2 * math.pi)
    once = -f - 1 / (24 * f) + 7 * (1 + 2 * q * q) / (5760 * f * f * f)
    squared = place - 0.3175 - q * f - q / (12 * f) + 7 * (8 * q + 4 * q * q * q) / (5760 * f * f * f)
    return once, squared


def _lines(table: DataFrame, centre: Column) -> DataFrame:
    """Line and correlation of the Q-Q points of each column of a ranking; ``centre`` is a number near the column's mean.

    A long run of equal values is two rows, the sums of normal quantiles up to its ends, so the rows grow with the distinct values.
    """
    n, before, end, low, high, place, q = (F.col(c) for c in ("n", "before", "end", "low", "high", "place", "q"))
    inner = F.least(F.greatest(before, F.lit(EDGE)), end)
    runs = table.select("column", "value", "n", "before", (before + F.col("ties")).alias("end")).withColumn("low", inner)
    runs = runs.withColumn("high", F.greatest(low, F.least(end, n - EDGE)))
    span = lambda a, b: F.when(b > a, F.sequence(a + 1, b)).otherwise(F.array().cast("array<bigint>"))
    long = high - low > RUN
    single = F.when(long, F.concat(span(before, low), span(high, end))).otherwise(span(before, end)).cast("array<double>")
    # half positions: after the low one, up to the high one
    places = F.when(long, F.concat(single, F.array(low + 0.5, high + 0.5))).otherwise(single)
    each = runs.select("column", (F.col("value") - centre).alias("d"), "n", F.when(long, low).alias("low"), F.explode(places).alias("place"))
    half = place != F.floor(place)
    sign = F.when(~half, 1).when(place > low + 1, 1).otherwise(-1)
    each = each.select("column", "d", "n", "place", half.alias("half"), sign.alias("sign"), theoretical(place, n).alias("q"))
    once, squared = _sums_upto(place, q, n)
    points = each.select(
        "column", "d", F.when(F.col("half"), F.col("sign") * F.floor(place)).otherwise(1).alias("k"),
        F.when(F.col("half"), F.col("sign") * once).otherwise(q).alias("s"), F.when(F.col("half"), F.col("sign") * squared).otherwise(q * q).alias("s2"),
    )
    k, d, s = F.col("k"), F.col("d"), F.col("s")
    sums = points.groupBy("column").agg(
        F.sum("k").alias("n"), (F.sum(k * d) / F.sum("k")).alias("d1"), (F.sum(k * d * d) / F.sum("k")).alias("d2"), (F.sum(d * s) / F.sum("k")).alias("ds"),
        (F.sum("s") / F.sum("k")).alias("q1"), (F.sum("s2") / F.sum("k")).alias("q2"), (F.min("d") == F.max("d")).alias("flat"),
    )
    spread = lambda square, mean: F.when(F.col("flat") & ~F.isnan("d2"), 0.0).otherwise(square - mean)
    found = sums.withColumns({
        "together": spread(F.col("ds"), F.col("d1") * F.col("q1")),
        "wide": F.sqrt(spread(F.col("d2"), F.col("d1") * F.col("d1"))),
        "high": F.col("q2") - F.col("q1") * F.col("q1"),
    }).withColumn("slope", ratio(F.col("together"), F.col("high")))
    return found.select(
        "column", "n", "slope", (centre + F.col("d1") - F.col("slope") * F.col("q1")).alias("intercept"),
        ratio(F.col("together"), F.sqrt("high") * F.col("wide")).alias("r"),
    )


def _law_terms(table: DataFrame) -> DataFrame:
    """Per column of a ranking with ``z``: the largest distance to the normal law, and the sum of the Anderson-Darling terms."""
    up, down = F.col("up"), F.col("down")
    above = (F.col("before") + F.col("ties")) / F.col("n") - up
    before, upto, n = F.col("before").cast("double"), (F.col("before") + F.col("ties")).cast("double"), F.col("n")
    # a run of equal values adds up its odd weights in closed form
    left = (upto - before) * (upto + before) * F.log(up)
    right = (upto - before) * (2 * n - upto - before) * F.log(down)
    return table.withColumns({"up": normal_cdf(F.col("z")), "down": normal_cdf(-F.col("z"))}).withColumns(
        {"_far": F.greatest(above, up - F.col("before") / F.col("n")), "_terms": (left + right) / n}
    )


def _standardised(df: DataFrame, column: str) -> tuple[DataFrame, Row]:
    row = moments(df, column)
    width = row["std"] or 1.0
    table = ranked(df, number(df, column))
    return table.withColumn("z", (F.col("value") - F.lit(row["mean"])) / F.lit(width)), row


KS_SCHEMA = "column string, n bigint, mean double, std double, statistic double, p_value double"
ANDERSON_SCHEMA = "column string, n bigint, statistic double, level double, critical double, rejected boolean"


def _anderson_rows(column: str, size: int, statistic: float) -> list[tuple]:
    shrink = 1 + 4 / size - 25 / size**2
    return [
        (column, size, statistic, level, round(critical / shrink, 3), statistic > round(critical / shrink, 3))
        for critical, level in zip(ANDERSON_CRITICAL, ANDERSON_LEVELS, strict=True)
    ]


def kolmogorov_smirnov(df: DataFrame, column: str) -> DataFrame:
    """Distance of the data to the normal law with the data's own mean and deviation."""
    table, row = _standardised(df, column)
    d = _law_terms(table).agg(F.max("_far")).first()[0]
    result = [(column, row["n"], row["mean"], row["std"], d, kolmogorov_two_sided(d, row["n"]))]
    return df.sparkSession.createDataFrame(result, KS_SCHEMA)


def anderson_darling(df: DataFrame, column: str) -> DataFrame:
    """A-squared against the fitted normal law, one row per significance level."""
    table, row = _standardised(df, column)
    total = _law_terms(table).agg(F.sum("_terms")).first()[0]
    return df.sparkSession.createDataFrame(_anderson_rows(column, row["n"], -row["n"] - total), ANDERSON_SCHEMA)


def shapiro(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    seed: int = SEED,
    key: Sequence[str] | None = None,
    sample_size: int = MAX_SHAPIRO,
) -> DataFrame:
    """Shapiro-Wilk per column, on all values or on ``sample_size`` random ones; n of n_total values were used."""
    if not 3 <= sample_size <= MAX_SHAPIRO:
        raise ValueError(f"sample_size must lie between 3 and {MAX_SHAPIRO}")
    columns = list(columns or numeric_columns(df))
    sizes = df.agg(*[F.count(number(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    share = {c: share_for(sample_size, sizes[f"n{i}"]) for i, c in enumerate(columns)}
    entries = [F.struct(F.lit(c).alias("column"), number(df, c).alias("value"), F.lit(share[c]).alias("share")) for c in columns]
    drawn = df.select(F.array(*entries).alias("entries"), uniform(key, seed).alias("u"))
    each = drawn.select("u", F.inline("entries")).where("value is not null and u < share")
    place = F.row_number().over(Window.partitionBy("column").orderBy("u"))
    few = each.withColumn("place", place).where(F.col("place") <= sample_size).select("column", "value")
    found = few.groupBy("column").applyInPandas(_shapiro_group, "column string, n bigint, statistic double, p_value double")
    totals = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, sizes[f"n{i}"])])
    return found.select("column", "n", F.element_at(totals, F.col("column")).alias("n_total"), "statistic", "p_value")


def _shapiro_group(pdf: pd.DataFrame) -> pd.DataFrame:
    w, p = shapiro_wilk(pdf["value"].to_numpy())
    return pd.DataFrame({"column": [pdf["column"].iloc[0]], "n": [len(pdf)], "statistic": [w], "p_value": [p]})


def shapiro_wilk(values: np.ndarray) -> tuple[float | None, float | None]:
    """Royston's AS R94 for 3 to 5,000 values."""
    x = np.sort(values)
    n = len(x)
    if n < 3:
        return None, None
    if x[0] == x[-1]:
        return 1.0, 1.0
    poly = lambda c, t: float(np.polynomial.polynomial.polyval(t, c))
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        m = np.array([STANDARD_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        norm = float(m @ m)
        c, u = m / math.sqrt(norm), 1 / math.sqrt(n)
        edge = [c[-1] + poly(SHAPIRO_LAST, u)]
        if n > 5:
            edge.append(c[-2] + poly(SHAPIRO_SECOND_LAST, u))
        k = len(edge)
        phi = (norm - 2 * float((m[-k:] ** 2).sum())) / (1 - 2 * sum(e * e for e in edge))
        a = m / math.sqrt(phi)
        for i, e in enumerate(edge):
            a[-1 - i], a[i] = e, -e
    centred = x - x.mean()
    w = min(1.0, float(a @ x) ** 2 / float(centred @ centred))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1.0:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        shift = poly(SHAPIRO_SMALL_SHIFT, n)
        if y >= shift:
            return w, 1e-99
        y = -math.log(shift - y)
        mean, spread = poly(SHAPIRO_SMALL_MEAN, n), math.exp(poly(SHAPIRO_SMALL_SPREAD, n))
    else:
        size = math.log(n)
        mean, spread = poly(SHAPIRO_LARGE_MEAN, size), math.exp(poly(SHAPIRO_LARGE_SPREAD, size))
    return w, normal_tail((y - mean) / spread)


def iqr_outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles, fences and the number and share of values outside them; one row per column."""
    found = exact_quantiles(df, columns, [0.25, 0.75])
    aggregates, rows = [], []
    for i, c in enumerate(columns):
        q1, q3 = found[c][0.25], found[c][0.75]
        if q1 is None:
            raise _no_values(c)
        x = number(df, c)
        low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        aggregates += [F.count(x).alias(f"n{i}"), F.count_if((x < low) | (x > high)).alias(f"out{i}")]
        rows.append(
            {
                "column": F.lit(c),
                "k": F.lit(float(k)),
                "q1": F.lit(q1),
                "q3": F.lit(q3),
                "iqr": F.lit(q3 - q1),
                "lower_bound": F.lit(low),
                "upper_bound": F.lit(high),
                "outlier_count": F.col(f"out{i}"),
                "total_count": F.col(f"n{i}"),
                "outlier_percent": 100.0 * F.col(f"out{i}") / F.col(f"n{i}"),
            }
        )
    return records(df.agg(*aggregates), rows)


def outlier_rows(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """All rows whose value lies outside the fences."""
    q = exact_quantiles(df, [column], [0.25, 0.75])[column]
    if q[0.25] is None:
        raise _no_values(column)
    gap = k * (q[0.75] - q[0.25])
    x = number(df, column)
    return df.where((x < q[0.25] - gap) | (x > q[0.75] + gap))


def first_outliers(
    df: DataFrame, column: str, order_by: Sequence[str], k: float = 1.5, n: int = FIRST_OUTLIERS
) -> DataFrame:
    """The first outliers in row order."""
    if not order_by:
        raise ValueError("the first rows depend on the row order: give order_by")
    return outlier_rows(df, column, k).orderBy(*order_by).limit(n)


@dataclass(frozen=True)
class Diagnosis:
    """What one ranking of all columns tells: the ranking itself, and a row of numbers per column."""

    ranking: DataFrame
    rows: dict[str, dict]


def diagnose(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> Diagnosis:
    """Moments, quartiles, fences, outliers, distance to the normal law, Anderson-Darling and the Q-Q line of many columns.

    The columns are scanned once for their moments and once for the counts of their distinct values, which are ranked and stored;
    everything else is read off the ranking by aggregates per column.
    """
    values = {c: number(df, c) for c in columns}
    about = [f(v).alias(f"{c}#{name}") for c, v in values.items() for name, f in MOMENTS.items()]
    seen = df.agg(*about).first()
    for c in columns:
        if not seen[f"{c}#n"]:
            raise _no_values(c)
    ranking = materialise(ranked_columns(df, values))
    pick = lambda name: F.element_at(F.create_map(*[F.lit(x) for c in columns for x in (c, seen[f"{c}#{name}"])]), F.col("column"))
    z = (F.col("value") - pick("mean")) / F.coalesce(F.nullif(pick("std"), F.lit(0.0)), F.lit(1.0))
    at = lambda rank: F.max(F.when((rank >= F.col("before")) & (rank < F.col("before") + F.col("ties")), F.col("value")))
    quartiles = []
    for q in (1, 3):
        place = (F.col("n") - 1) * (q / 4)
        first, second = at(F.floor(place)), at(F.ceil(place))
        quartiles.append((first + (second - first) * F.max(place - F.floor(place))).alias(f"q{q}"))
    told = _law_terms(ranking.withColumn("z", z)).groupBy("column").agg(F.max("_far").alias("ks"), F.sum("_terms").alias("terms"), *quartiles)
    rows: dict[str, dict] = {c: {name: seen[f"{c}#{name}"] for name in MOMENTS} for c in columns}
    for r in told.collect():
        row, gap = rows[r["column"]], k * (r["q3"] - r["q1"])
        row |= {"ks": r["ks"], "anderson": -row["n"] - r["terms"], "q1": r["q1"], "q3": r["q3"], "lower_bound": r["q1"] - gap, "upper_bound": r["q3"] + gap}
    bound = lambda name: F.element_at(F.create_map(*[F.lit(x) for c in columns for x in (c, rows[c][name])]), F.col("column"))
    outside = (F.col("value") < bound("lower_bound")) | (F.col("value") > bound("upper_bound"))
    beyond = ranking.groupBy("column").agg(F.sum(F.when(outside, F.col("ties")).otherwise(0)).alias("outliers"))
    for r in beyond.join(_lines(ranking, pick("mean")), "column").collect():
        rows[r["column"]] |= {name: r[name] for name in ("outliers", "slope", "intercept", "r")}
    return Diagnosis(ranking, rows)


def diagnostics_all(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """One row per column with all its diagnostics."""
    columns = list(columns or numeric_columns(df))
    found = diagnose(df, columns, k).rows
    names = ["n", "mean", "std", "skewness", "kurtosis", "slope", "intercept", "r", "ks", "anderson", "q1", "q3", "lower_bound", "upper_bound", "outliers"]
    kinds = {"n": "bigint", "outliers": "bigint"}
    schema = "column string, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in names)
    return df.sparkSession.createDataFrame([(c, *(found[c][name] for name in names)) for c in columns], schema)


def column_report(df: DataFrame, column: str, key: Sequence[str] | None = None, k: float = 1.5) -> dict[str, DataFrame]:
    """Everything known about one column's distribution, as a set of small tables; the Q-Q points are read off the stored ranking."""
    found = diagnose(df, [column], k)
    row, make = found.rows[column], df.sparkSession.createDataFrame
    n, share = row["n"], 100.0 * row["outliers"] / row["n"]
    labels = [_label(row["skewness"], "right-skewed", "left-skewed", "symmetric"), _label(row["kurtosis"], "leptokurtic", "platykurtic", "mesokurtic")]
    return {
        "moments": make(
            [(column, n, row["mean"], row["std"], row["skewness"], row["kurtosis"], *labels)],
            "column string, n bigint, mean double, std double, skewness double, kurtosis double, skew_label string, kurtosis_label string",
        ),
        "qq_points": _points(found.ranking, n, None),
        "qq_fit": make([(n, row["slope"], row["intercept"], row["r"])], "n bigint, slope double, intercept double, r double"),
        "shapiro": shapiro(df, [column], key=key),
        "kolmogorov_smirnov": make([(column, n, row["mean"], row["std"], row["ks"], kolmogorov_two_sided(row["ks"], n))], KS_SCHEMA),
        "anderson_darling": make(_anderson_rows(column, n, row["anderson"]), ANDERSON_SCHEMA),
        "outliers": make(
            [(column, float(k), row["q1"], row["q3"], row["q3"] - row["q1"], row["lower_bound"], row["upper_bound"], row["outliers"], n, share)],
            "column string, k double, q1 double, q3 double, iqr double, lower_bound double, upper_bound double, outlier_count bigint, total_count bigint, outlier_percent double",
        ),
    }


def _label(value: float | None, positive: str, negative: str, zero: str) -> str | None:
    return None if value is None or value != value else positive if value > 0 else negative if value < 0 else zero
