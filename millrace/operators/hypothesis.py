"""Hypothesis tests. Spark reduces the data to one row; the p-value follows from that row."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import missing_as_null, number, quoted, require_columns
from millrace.functions.tails import (
    chi2_tail,
    f_tail,
    normal_tail,
    rank_sum_exact,
    signed_rank_exact,
    t_two_sided,
)
from millrace.operators.rank import grouped_quantiles, ranked
from millrace.operators.shape import with_group_numbers
from millrace.session import materialise

ALPHA = 0.05
#: Where the method is left open: the group size up to which the exact law is used, the size of its table, and pairs.
EXACT_SMALL_GROUP = 8
EXACT_MAX_PRODUCT = 1_000_000
EXACT_MAX_PAIRS = 50
METHODS = ("auto", "exact", "normal")


@dataclass(frozen=True)
class Spec:
    label: str
    kind: str
    min_groups: int | None = None
    max_groups: int | None = None


SPECS = {
    "ttest": Spec("the t test", "group", 2, 2),
    "anova": Spec("the analysis of variance", "group", 3),
    "mannwhitney": Spec("the rank-sum test", "group", 2, 2),
    "kruskal": Spec("the Kruskal-Wallis test", "group", 3),
    "chisquare": Spec("the chi-square test", "two_columns"),
    "wilcoxon": Spec("the signed-rank test", "two_columns"),
}


def run(df: DataFrame, test: str, first: str, second: str) -> dict[str, DataFrame]:
    """Run a test on (group column, value column) or on two columns.

    Gives ``result`` and, for group tests, ``groups``; for chi-square, ``table``.
    """
    if test not in SPECS:
        raise ValueError(f"unknown test: {test}")
    require_columns(df, first, second)
    result = {
        "ttest": ttest,
        "anova": anova,
        "mannwhitney": mann_whitney,
        "kruskal": kruskal,
        "chisquare": chi_square,
        "wilcoxon": wilcoxon,
    }[test](df, first, second)
    tables = {"result": result}
    if SPECS[test].kind == "group":
        tables["groups"] = group_summary(df, first, second)
    elif test == "chisquare":
        tables["table"] = contingency(df, first, second)
    return tables


def _known(df: DataFrame, group: str, value: str) -> DataFrame:
    rows = df.select(missing_as_null(df, group).alias("g"), number(df, value).alias("v"))
    return rows.where("g is not null and v is not null")


def group_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean and deviation (n - 1) per group with any value, in key order."""
    stats = _known(df, group, value).groupBy("g").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")
    )
    return stats.orderBy("g").select(F.col("g").cast("string").alias("group"), "n", "mean", "std")


def _check_groups(test: str, group: str, found: int) -> None:
    spec = SPECS[test]
    most = spec.max_groups or found
    if not spec.min_groups <= found <= most:
        need = str(spec.min_groups) if spec.max_groups else f"{spec.min_groups} or more"
        raise ValueError(f"column '{group}' splits the rows into {found} groups; {spec.label} works on {need}")


def _one_way(stats: DataFrame) -> tuple[float | None, int, int, int]:
    """F, its two degrees of freedom and the number of groups, from rows (n, mean, ss)."""
    grand = stats.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    row = (
        stats.crossJoin(F.broadcast(grand))
        .agg(
            F.count("*").alias("k"),
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2.0))).alias("between"),
            F.sum("ss").alias("within"),
        )
        .first()
    )
    k, n = row["k"], row["n"] or 0
    if k < 2 or n <= k:
        return None, k - 1, n - k, k
    between, within = row["between"] / (k - 1), row["within"] / (n - k)
    if within == 0:
        return (math.inf if between else None), k - 1, n - k, k
    return between / within, k - 1, n - k, k


def _one_way_result(df: DataFrame, statistic: float | None, top: int, bottom: int, k: int) -> DataFrame:
    p = None if statistic is None else f_tail(statistic, top, bottom)
    return df.sparkSession.createDataFrame(
        [(statistic, p, top, bottom, k)],
        "statistic double, p_value double, df_between bigint, df_within bigint, n_groups bigint",
    )


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    stats = _known(df, group, value).groupBy("g").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("*")).alias("ss")
    )
    statistic, top, bottom, k = _one_way(stats)
    _check_groups("anova", group, k)
    return _one_way_result(df, statistic, top, bottom, k)


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """Equality of variances: one-way analysis of the distances to the group medians."""
    rows = _known(df, group, value)
    medians = grouped_quantiles(rows, ["g"], "v", [0.5]).select("g", F.col("q0").alias("median"))
    distance = F.abs(F.col("v") - F.col("median"))
    near = with_group_numbers(rows, medians, ["g"]).groupBy("g", "median")
    means = near.agg((F.sum(F.col("cnt") * distance) / F.sum("cnt")).alias("mean"))
    # the squares are summed around the mean found first: nothing cancels, however far the groups lie from 0
    around = with_group_numbers(rows, means, ["g"])
    stats = around.groupBy("g", "mean").agg(
        F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.pow(distance - F.col("mean"), F.lit(2.0))).alias("ss")
    )
    return _one_way_result(df, *_one_way(stats))


def ttest(df: DataFrame, group: str, value: str) -> DataFrame:
    """Student's t test, or Welch's when Levene's test rejects equal variances."""
    rows = _known(df, group, value)
    stats = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    found = stats.limit(3).collect()
    _check_groups("ttest", group, len(found) if len(found) < 3 else stats.count())
    a, b = sorted(found, key=lambda r: r["g"])
    equality = levene(df, group, value).first()["p_value"]
    welch = equality is not None and equality < ALPHA
    va, vb = (a["s"] or 0.0) / a["n"], (b["s"] or 0.0) / b["n"]
    dof = a["n"] + b["n"] - 2
    if welch:
        error = math.sqrt(va + vb)
        dof = (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    elif dof > 0:
        pooled = ((a["n"] - 1) * (a["s"] or 0.0) + (b["n"] - 1) * (b["s"] or 0.0)) / dof
        error = math.sqrt(pooled * (1 / a["n"] + 1 / b["n"]))
    else:
        error = 0.0
    gap = a["m"] - b["m"]
    statistic = gap / error if error else (math.copysign(math.inf, gap) if gap and dof > 0 else None)
    p = None if statistic is None else t_two_sided(statistic, dof)
    return df.sparkSession.createDataFrame(
        [(statistic, p, float(dof), welch, equality)],
        "statistic double, p_value double, dof double, used_welch boolean, levene_p double",
    )


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: n, sum of mid-ranks over the whole table, and its share of the tie term."""
    rows = _known(df, group, value)
    ties = F.col("ties").cast("double")
    return ranked(rows, F.col("v"), by=F.col("g")).groupBy("grp").agg(
        F.sum("cnt").alias("n"),
        F.sum(F.col("cnt") * F.col("midrank")).alias("rank_sum"),
        F.sum(F.col("cnt") * (ties * ties - 1)).alias("tie_term"),
    )


def mann_whitney(
    df: DataFrame, group: str, value: str, method: str = "auto", small_group: int = EXACT_SMALL_GROUP, max_product: int = EXACT_MAX_PRODUCT
) -> DataFrame:
    """Mann-Whitney U; the column ``exact`` says which law gave the p-value.

    ``auto`` takes the exact law without ties where the smaller group has at most ``small_group``
    rows and the table of the law, n1 * n2 numbers, at most ``max_product``.
    """
    _check_method(method)
    sums = rank_sums(df, group, value)
    found = sums.limit(3).collect()
    _check_groups("mannwhitney", group, len(found) if len(found) < 3 else sums.count())
    a, b = sorted(found, key=lambda r: r["grp"])
    n1, n2 = a["n"], b["n"]
    n, ties = n1 + n2, a["tie_term"] + b["tie_term"]
    u = a["rank_sum"] - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    fits = min(n1, n2) <= small_group and ties == 0 and n1 * n2 <= max_product
    exact = method == "exact" or method == "auto" and fits
    if exact:
        p = rank_sum_exact(u, n1, n2)
    elif variance <= 0:
        p = 1.0
    else:
        z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / math.sqrt(variance)
        p = min(1.0, 2 * normal_tail(z))
    return df.sparkSession.createDataFrame(
        [(float(u), p, n1, n2, exact)], "statistic double, p_value double, n1 bigint, n2 bigint, exact boolean"
    )


def _check_method(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    sums = rank_sums(df, group, value)
    total = sums.agg(F.sum("n").cast("double").alias("all"))
    centred = F.col("rank_sum") / F.col("n") - (F.col("all") + 1) / 2
    row = (
        sums.crossJoin(F.broadcast(total))
        .agg(
            F.count("*").alias("k"),
            F.sum("n").alias("n"),
            F.sum("tie_term").alias("ties"),
            F.sum(F.col("n") * centred * centred).alias("spread"),
        )
        .first()
    )
    k, n = row["k"], row["n"] or 0
    _check_groups("kruskal", group, k)
    correction = 1 - row["ties"] / (float(n) ** 3 - n)
    statistic = 12 / (n * (n + 1)) * row["spread"] / correction if correction > 0 else None
    p = None if statistic is None else chi2_tail(statistic, k - 1)
    return df.sparkSession.createDataFrame(
        [(statistic, p, k - 1, n)], "statistic double, p_value double, dof bigint, n bigint"
    )


def contingency_cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of the value pairs that occur, rows with a missing value left out."""
    rows = df.select(missing_as_null(df, a).alias("a"), missing_as_null(df, b).alias("b"))
    return rows.where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("observed"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Count table with one row per value of ``a`` and one column per value of ``b``."""
    cells = contingency_cells(df, a, b).withColumn("b", F.col("b").cast("string"))
    wide = cells.groupBy("a").pivot("b").agg(F.sum("observed"))
    names = [c for c in wide.columns if c != "a"]
    return wide.select(F.col("a").alias(a), *[F.coalesce(quoted(c), F.lit(0)).alias(c) for c in names]).orderBy(a)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    cells = materialise(contingency_cells(df, a, b))
    rows = cells.groupBy("a").agg(F.sum("observed").alias("row_total"))
    columns = cells.groupBy("b").agg(F.sum("observed").alias("column_total"))
    total = cells.agg(F.sum("observed").alias("n"))
    sizes = (
        rows.agg(F.count("*").alias("r"))
        .crossJoin(columns.agg(F.count("*").alias("c")))
        .crossJoin(total)
        .first()
    )
    dof, n = (sizes["r"] - 1) * (sizes["c"] - 1), sizes["n"]
    if not n:
        raise ValueError(f"no rows with both '{a}' and '{b}'")
    expected = F.col("row_total").cast("double") * F.col("column_total") / F.lit(float(n))
    full = cells.join(rows, "a").join(columns, "b").withColumn("expected", expected)
    if dof == 1:
        statistic = _yates(full, rows, columns, n)
    else:
        # pairs that never occur add their expected count; together they make up what the others leave of n
        term = F.pow(F.col("observed") - F.col("expected"), F.lit(2.0)) / F.col("expected")
        row = full.agg(F.sum(term).alias("seen"), F.sum("expected").alias("expected")).first()
        statistic = max(0.0, row["seen"] + (n - row["expected"])) if dof else 0.0
    p = chi2_tail(statistic, dof) if dof else 1.0
    return df.sparkSession.createDataFrame(
        [(statistic, p, dof, n)], "statistic double, p_value double, dof bigint, n bigint"
    )


def _yates(full: DataFrame, rows: DataFrame, columns: DataFrame, n: int) -> float:
    """Statistic of a 2 x 2 table with continuity correction."""
    seen = {(r["a"], r["b"]): r["observed"] for r in full.collect()}
    row_totals, column_totals = rows.collect(), columns.collect()
    total = 0.0
    for i in row_totals:
        for j in column_totals:
            expected = i["row_total"] * j["column_total"] / n
            gap = abs(seen.get((i["a"], j["b"]), 0) - expected)
            total += (gap - min(0.5, gap)) ** 2 / expected
    return total


def wilcoxon(df: DataFrame, a: str, b: str, method: str = "auto", max_pairs: int = EXACT_MAX_PAIRS) -> DataFrame:
    """Wilcoxon signed ranks; ``auto`` takes the exact law up to ``max_pairs`` pairs without ties and zeros."""
    _check_method(method)
    pairs = df.select((number(df, a) - number(df, b)).alias("d")).where("d is not null")
    moved = pairs.where("d <> 0")
    ties = F.col("ties").cast("double")
    table = ranked(moved, F.abs("d"), by=F.signum("d"))
    row = table.agg(
        F.sum(F.when(F.col("grp") > 0, F.col("cnt") * F.col("midrank"))).alias("plus"),
        F.sum(F.when(F.col("grp") < 0, F.col("cnt") * F.col("midrank"))).alias("minus"),
        F.sum("cnt").alias("n"),
        F.sum(F.col("cnt") * (ties * ties - 1)).alias("ties"),
    ).first()
    n_pairs = pairs.count()
    if not n_pairs:
        raise ValueError(f"no rows with both '{a}' and '{b}'")
    n = row["n"] or 0
    plus, minus = row["plus"] or 0.0, row["minus"] or 0.0
    w = min(plus, minus)
    z = None
    if not n:
        p = 1.0
    elif method == "exact" or method == "auto" and n <= max_pairs and not row["ties"] and n == n_pairs:
        p = signed_rank_exact(w, n)
    else:
        variance = (n * (n + 1) * (2 * n + 1) - row["ties"] / 2) / 24
        z = (w - n * (n + 1) / 4) / math.sqrt(variance)
        p = min(1.0, 2 * normal_tail(abs(z)))
    return df.sparkSession.createDataFrame(
        [(w, p, n_pairs, n, plus, minus, z)],
        "statistic double, p_value double, n_pairs bigint, n_moved bigint, plus double, minus double, z double",
    )
