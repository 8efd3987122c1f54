"""Registered queries: distribution diagnostics and hypothesis tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import diagnostics, hypothesis
from millrace.plans import sqltext
from millrace.plans.tables import GAPPY_EVENTS, Query, gappy_events, rounded, table


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders")


# ---------------------------------------------------------------- outliers


def iqr_outliers(spark: SparkSession, folder: str) -> DataFrame:
    result = diagnostics.iqr_outliers(gappy_events(spark, folder), ["value", "user_id"])
    return rounded(result, 4, "q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_percent")


def _outlier_sql(columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS "column", 1.5::DOUBLE AS k, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
            round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound,
            count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outlier_count, count(x) AS total_count,
            round(100.0::DOUBLE * count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) / count(x), 4) AS outlier_percent
            FROM (SELECT {c} AS x FROM {GAPPY_EVENTS}),
            (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {GAPPY_EVENTS}) GROUP BY q1, q3"""
        )
    return " UNION ALL ".join(parts)


OUTLIER_ROWS = """SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS q1,
    quantile_cont(value, 0.75) AS q3 FROM events) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""


# ---------------------------------------------------------------- normality

SORTED_EVENTS = f"""SELECT value AS x, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n
    FROM {GAPPY_EVENTS} WHERE value IS NOT NULL"""
FILLIBEN = "CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END"
QQ_ROWS = f"SELECT x, i, n, {sqltext.normal_ppf('p')} AS q FROM (SELECT x, i, n, {FILLIBEN} AS p FROM ({SORTED_EVENTS}))"
PLACES = f"""SELECT x, n, rank() OVER (ORDER BY x) - 1 AS b, count(*) OVER (PARTITION BY x) AS t,
    (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS z FROM ({SORTED_EVENTS})"""


def qq_points(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(diagnostics.qq_points(gappy_events(spark, folder), "value", max_points=5000), 6, "theoretical", "sample")


def qq_fit(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(diagnostics.qq_fit(gappy_events(spark, folder), "value"), 6, "slope", "intercept", "r")


def ks_statistic(spark: SparkSession, folder: str) -> DataFrame:
    result = diagnostics.kolmogorov_smirnov(gappy_events(spark, folder), "value")
    return rounded(result.drop("p_value"), 6, "mean", "std", "statistic")


def anderson_statistic(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(diagnostics.anderson_darling(gappy_events(spark, folder), "value"), 5, "statistic", "critical")


ANDERSON_SQL = f"""SELECT 'value' AS "column", n, round(statistic, 5) AS statistic, level::DOUBLE AS level,
    round(round(critical / (1 + 4.0 / n - 25.0 / (n * n)), 3), 5) AS critical,
    statistic > round(critical / (1 + 4.0 / n - 25.0 / (n * n)), 3) AS rejected
    FROM (SELECT any_value(n) AS n, -any_value(n) - sum((2 * i - 1) * ln({sqltext.normal_cdf('z')})
      + (2 * (n - i) + 1) * ln({sqltext.normal_cdf('(-z)')})) / any_value(n) AS statistic
      FROM (SELECT *, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS z FROM ({SORTED_EVENTS}))),
    (VALUES {', '.join(f'({c}::DOUBLE, {level})' for c, level in zip(diagnostics.ANDERSON_CRITICAL, diagnostics.ANDERSON_LEVELS))}) AS t(critical, level)"""


def shapiro(spark: SparkSession, folder: str) -> DataFrame:
    found = diagnostics.shapiro(gappy_events(spark, folder), ["value", "user_id"], key=["event_id"])
    return rounded(found, 6, "statistic", "p_value")


def _shapiro_sql(columns: list[str]) -> str:
    """W and p of 12 to 5,000 values per column, drawn by the same hash; the weights are summed in closed form."""
    poly = lambda c, x: sqltext.polynomial(c[::-1], x)
    values = " UNION ALL ".join(f"SELECT '{c}' AS c, {c}::DOUBLE AS x, event_id FROM {GAPPY_EVENTS} WHERE {c} IS NOT NULL" for c in columns)
    return f"""WITH t AS (SELECT *, count(*) OVER (PARTITION BY c) AS n_total,
        row_number() OVER (PARTITION BY c ORDER BY ('0x' || substr(md5(event_id || ':42'), 1, 13))::BIGINT) AS k FROM ({values})),
      s AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY x) AS i, count(*) OVER (PARTITION BY c) AS n FROM t WHERE k <= 5000),
      m AS (SELECT *, {sqltext.normal_ppf('p')} AS m FROM (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM s)),
      g AS (SELECT c, any_value(n) AS n, any_value(n_total) AS n_total, sum(m * m) AS norm, sum(m * x) AS mx, var_pop(x) * count(*) AS ss,
        max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2, max(x) FILTER (i = n) AS b1, max(x) FILTER (i = n - 1) AS b2,
        max(x) FILTER (i = 1) AS a1, max(x) FILTER (i = 2) AS a2 FROM m GROUP BY c),
      e AS (SELECT *, m1 / sqrt(norm) + {poly(diagnostics.SHAPIRO_LAST, '(1 / sqrt(n))')} AS e1,
        m2 / sqrt(norm) + {poly(diagnostics.SHAPIRO_SECOND_LAST, '(1 / sqrt(n))')} AS e2 FROM g),
      w AS (SELECT *, least(1.0, pow((mx - m1 * (b1 - a1) - m2 * (b2 - a2))
        / sqrt((norm - 2 * (m1 * m1 + m2 * m2)) / (1 - 2 * (e1 * e1 + e2 * e2))) + e1 * (b1 - a1) + e2 * (b2 - a2), 2) / ss) AS w FROM e),
      z AS (SELECT *, (ln(1 - w) - {poly(diagnostics.SHAPIRO_LARGE_MEAN, 'ln(n)')}) / exp({poly(diagnostics.SHAPIRO_LARGE_SPREAD, 'ln(n)')}) AS z FROM w)
      SELECT c AS "column", n, n_total, round(w, 6) AS statistic, round({sqltext.normal_cdf('(-z)')}, 6) + 0.0 AS p_value FROM z"""


# ---------------------------------------------------------------- tests


def _one_way_sql(rows: str, digits: int = 5) -> str:
    """F statistic from rows (g, v)."""
    return f"""SELECT round((b / (k - 1)) / (w / (n - k)), {digits}) AS statistic, CAST(k - 1 AS BIGINT) AS df_between,
      CAST(n - k AS BIGINT) AS df_within, k AS n_groups FROM (
      SELECT count(*) AS k, sum(c) AS n, sum(c * pow(m - gm, 2)) AS b, sum(s) AS w FROM (
        SELECT count(*) AS c, avg(v) AS m, var_pop(v) * count(*) AS s FROM ({rows}) GROUP BY g),
        (SELECT avg(v) AS gm FROM ({rows})))"""


def _levene_rows(rows: str) -> str:
    return f"SELECT g, abs(v - median(v) OVER (PARTITION BY g)) AS v FROM ({rows})"


STATUS_PRICE = "SELECT l_linestatus AS g, l_extendedprice AS v FROM lineitem"
SEGMENT_BALANCE = "SELECT c_mktsegment AS g, c_acctbal AS v FROM customer"
PRIORITY_PRICE = "SELECT o_orderpriority AS g, o_totalprice AS v FROM orders"
FLAG_QUANTITY = "SELECT l_returnflag AS g, l_quantity AS v FROM lineitem"


def _ttest_sql(rows: str, digits: int = 5) -> str:
    # 3.8415 is the 95 % point of F with 1 and very many degrees of freedom
    return f"""SELECT round((m1 - m2) / CASE WHEN f > 3.8415 THEN sqrt(a + b) ELSE
        sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) END, {digits}) AS statistic,
      round(CASE WHEN f > 3.8415 THEN pow(a + b, 2) / (a * a / (n1 - 1) + b * b / (n2 - 1)) ELSE n1 + n2 - 2 END, {digits - 2}) AS dof,
      f > 3.8415 AS used_welch FROM (
      SELECT n1, n2, m1, m2, s1, s2, s1 / n1 AS a, s2 / n2 AS b FROM
        (SELECT count(*) AS n1, avg(v) AS m1, var_samp(v) AS s1 FROM ({rows}) WHERE g = (SELECT min(g) FROM ({rows}))),
        (SELECT count(*) AS n2, avg(v) AS m2, var_samp(v) AS s2 FROM ({rows}) WHERE g = (SELECT max(g) FROM ({rows})))),
      (SELECT statistic AS f FROM ({_one_way_sql(_levene_rows(rows))}))"""


def _ranked_sql(rows: str) -> str:
    return f"""SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r,
      count(*) OVER (PARTITION BY v)::DOUBLE AS t, count(*) OVER ()::DOUBLE AS n FROM ({rows})"""


MANN_WHITNEY_SQL = f"""SELECT u AS statistic, round(least(1.0, 2 * {sqltext.normal_cdf('(-z)')}), 6) AS p_value, n1, n2, false AS exact FROM (
    SELECT u, n1, n2, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM (
    SELECT sum(r) FILTER (g = 'F') - count(*) FILTER (g = 'F') * (count(*) FILTER (g = 'F') + 1) / 2.0 AS u,
      count(*) FILTER (g = 'F') AS n1, count(*) FILTER (g = 'O') AS n2, any_value(n) AS n, sum(t * t - 1) AS ties
    FROM ({_ranked_sql(STATUS_PRICE)})))"""

def _kruskal_sql(digits: int = 5, rows: str | None = None) -> str:
    return f"""SELECT round(12 / (n * (n + 1)) * s / (1 - ties / (n * n * n - n)), {digits}) AS statistic, k - 1 AS dof, CAST(n AS BIGINT) AS n FROM (
    SELECT count(*) AS k, any_value(n) AS n, sum(c * pow(mr - (n + 1) / 2, 2)) AS s, sum(ties) AS ties FROM (
    SELECT any_value(n) AS n, count(*) AS c, avg(r) AS mr, sum(t * t - 1) AS ties FROM ({_ranked_sql(rows or PRIORITY_PRICE)}) GROUP BY g))"""

def _quarters(spark: SparkSession, folder: str) -> DataFrame:
    """Very many groups that share few values."""
    return table(spark, folder, "events").select("user_id", F.floor(F.col("value") / 25).alias("quarter"))


USER_QUARTERS = "SELECT user_id AS g, floor(value / 25)::DOUBLE AS v FROM events"


def _wilcoxon_sql(digits: int = 5) -> str:
    return f"""SELECT least(plus, minus) AS statistic, n_pairs, CAST(n AS BIGINT) AS n_moved, plus, minus,
    round((least(plus, minus) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24), {digits}) AS z FROM (
    SELECT sum(r) FILTER (g > 0) AS plus, sum(r) FILTER (g < 0) AS minus, any_value(n) AS n, sum(t * t - 1) AS ties FROM (
      {_ranked_sql('SELECT sign(l_discount - l_tax) AS g, abs(l_discount - l_tax) AS v FROM lineitem WHERE l_discount - l_tax <> 0')})),
    (SELECT count(*) AS n_pairs FROM lineitem)"""


GAPPY_LINES = "(SELECT l_discount, CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS l_tax FROM lineitem) gaps"


def _chi_sql(source: str, a: str, b: str, digits: int = 5) -> str:
    return f"""WITH cells AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {source} GROUP BY 1, 2),
      r AS (SELECT a, sum(o) AS rt FROM cells GROUP BY 1), c AS (SELECT b, sum(o) AS ct FROM cells GROUP BY 1),
      n AS (SELECT sum(o)::DOUBLE AS n FROM cells),
      f AS (SELECT coalesce(o, 0) AS o, rt * ct / n AS e FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN cells ON cells.a = r.a AND cells.b = c.b),
      d AS (SELECT (SELECT count(*) - 1 FROM r) * (SELECT count(*) - 1 FROM c) AS dof)
      SELECT round(sum(pow(CASE WHEN dof = 1 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE o - e END, 2) / e), {digits}) AS statistic,
        CAST(any_value(dof) AS BIGINT) AS dof, CAST(any_value(n) AS BIGINT) AS n FROM f, d, n"""


def _chi(name: str, a: str, b: str):
    return lambda s, d: rounded(hypothesis.chi_square(table(s, d, name), a, b).drop("p_value"), 5, "statistic")


def group_summary(spark: SparkSession, folder: str) -> DataFrame:
    result = hypothesis.group_summary(gappy_events(spark, folder), "event_type", "value")
    return rounded(result, 5, "mean", "std")


def test_tables(spark: SparkSession, folder: str) -> DataFrame:
    """p-values of all six tests on the whole tables."""
    lines, orders = _lines(spark, folder), _orders(spark, folder)
    runs = {
        "ttest": (lines, "l_linestatus", "l_extendedprice"),
        "anova": (orders, "o_orderpriority", "o_totalprice"),
        "mannwhitney": (lines, "l_linestatus", "l_extendedprice"),
        "kruskal": (orders, "o_orderpriority", "o_totalprice"),
        "chisquare": (orders, "o_orderpriority", "o_orderstatus"),
        "wilcoxon": (lines, "l_discount", "l_tax"),
    }
    result = None
    for test, (df, first, second) in runs.items():
        row = hypothesis.run(df, test, first, second)["result"].select(
            F.lit(test).alias("test"), "statistic", "p_value", (F.col("p_value") < hypothesis.ALPHA).alias("significant")
        )
        result = row if result is None else result.unionByName(row)
    return result


def _chi_tail_sql(x: str, dof: str, terms: int) -> str:
    """The upper tail of chi-square with an even number of degrees of freedom, at most 2 * ``terms``, as its finite sum."""
    term = lambda k: f"CASE WHEN {k} < {dof} / 2 THEN pow({x} / 2, {k}) / {math.factorial(k)} ELSE 0 END"
    return f"exp(-{x} / 2) * ({' + '.join(term(k) for k in range(terms))})"


def _t_tail_sql(t: str, dof: str) -> str:
    """Both tails of Student's t by Simpson's rule over 2,000 steps of the density from 0 to the size of t."""
    density = f"pow(1 + pow(i * abs({t}) / 2000, 2) / {dof}, -({dof} + 1) / 2)"
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    scale = f"exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt({dof} * pi())"
    return f"1 - 2 * {scale} * abs({t}) / 6000 * (SELECT sum({weight} * {density}) FROM range(2001) r(i))"


def _p_values_sql() -> str:
    """All six p-values by other means than the tests use: closed forms and numeric integration."""
    f_tail = "pow(x, w / 2) * (1 + w / 2 * (1 - x))"  # I_x(w / 2, 2): four degrees of freedom between groups
    parts = {
        "ttest": f"SELECT statistic, {_t_tail_sql('statistic', 'dof')} AS p FROM ({_ttest_sql(STATUS_PRICE, 12)})",
        "anova": f"""SELECT statistic, {f_tail} AS p FROM (SELECT statistic, df_within AS w, df_within / (df_within + 4 * statistic) AS x
            FROM ({_one_way_sql(PRIORITY_PRICE, 12)}))""",
        "mannwhitney": f"SELECT statistic, p_value AS p FROM ({MANN_WHITNEY_SQL})",
        "kruskal": f"SELECT statistic, {_chi_tail_sql('statistic', 'dof', 8)} AS p FROM ({_kruskal_sql(12)})",
        "chisquare": f"""SELECT statistic, {_chi_tail_sql('statistic', 'dof', 8)} AS p
            FROM ({_chi_sql('orders', 'o_orderpriority', 'o_orderstatus', 12)})""",
        "wilcoxon": f"SELECT statistic, least(1.0, 2 * {sqltext.normal_cdf('(-abs(z))')}) AS p FROM ({_wilcoxon_sql(12)})",
    }
    rows = [f"SELECT '{t}' AS test, round(statistic, 5) AS statistic, round(p, 5) + 0.0 AS p_value, p < 0.05 AS significant FROM ({q})" for t, q in parts.items()]
    return " UNION ALL ".join(rows)


def column_report(spark: SparkSession, folder: str) -> DataFrame:
    """Everything about one column as one table: part, measure, value."""
    report = diagnostics.column_report(gappy_events(spark, folder), "value", key=["event_id"])
    wanted = {
        "moments": ["n", "mean", "std", "skewness", "kurtosis"],
        "qq_fit": ["slope", "intercept", "r"],
        "kolmogorov_smirnov": ["statistic"],
        "outliers": ["q1", "q3", "lower_bound", "upper_bound", "outlier_count", "total_count"],
    }
    result = None
    for part, measures in wanted.items():
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m).cast("double"), 5).alias("value")) for m in measures])
        rows = report[part].select(F.lit(part).alias("part"), F.inline(pairs))
        result = rows if result is None else result.unionByName(rows)
    return result


def _long_sql(part: str, measures: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{part}' AS part, '{m}' AS measure, round({m}::DOUBLE, 5) AS value FROM ({source})" for m in measures)


QQ_FIT_SQL = f"""SELECT count(*) AS n, regr_slope(x, q) AS slope, regr_intercept(x, q) AS intercept, corr(x, q) AS r FROM ({QQ_ROWS})"""
KS_SQL = f"""SELECT any_value(n) AS n, avg(x) AS mean, stddev_samp(x) AS std,
    max(greatest((b + t) / n - {sqltext.normal_cdf('z')}, {sqltext.normal_cdf('z')} - b / n)) AS statistic FROM ({PLACES})"""
MOMENTS_SQL = f"""SELECT n, mean, std, m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis FROM (
    SELECT count(*) AS n, any_value(m) AS mean, stddev_samp(x) AS std, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4
    FROM (SELECT value AS x, avg(value) OVER () AS m FROM {GAPPY_EVENTS} WHERE value IS NOT NULL))"""
FENCES_SQL = f"""SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound,
    count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outlier_count, count(x) AS total_count
    FROM (SELECT value AS x FROM {GAPPY_EVENTS}), (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {GAPPY_EVENTS})
    GROUP BY q1, q3"""
REPORT_SQL = " UNION ALL ".join(
    [
        _long_sql("moments", ["n", "mean", "std", "skewness", "kurtosis"], MOMENTS_SQL),
        _long_sql("qq_fit", ["slope", "intercept", "r"], QQ_FIT_SQL),
        _long_sql("kolmogorov_smirnov", ["statistic"], KS_SQL),
        _long_sql("outliers", ["q1", "q3", "lower_bound", "upper_bound", "outlier_count", "total_count"], FENCES_SQL),
    ]
)


ALL_COLUMNS = ["l_quantity", "l_extendedprice", "l_tax"]
ALL_MEASURES = ["mean", "std", "skewness", "kurtosis", "slope", "intercept", "r", "ks", "anderson", "q1", "q3", "lower_bound", "upper_bound"]


def diagnostics_all(spark: SparkSession, folder: str) -> DataFrame:
    """All diagnostics of several columns from one ranking."""
    lines = _lines(spark, folder).withColumn("l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")))
    return rounded(diagnostics.diagnostics_all(lines, ALL_COLUMNS), 4, *ALL_MEASURES)


def _all_sql(c: str) -> str:
    source = f"(SELECT (CASE WHEN '{c}' <> 'l_tax' OR l_orderkey % 7 <> 0 THEN {c} END)::DOUBLE AS x FROM lineitem) WHERE x IS NOT NULL"
    up, down = sqltext.normal_cdf("z"), sqltext.normal_cdf("(-z)")
    return f"""SELECT '{c}' AS "column", m.n, mean, std, s AS skewness, ku AS kurtosis, slope, intercept, r, ks, -m.n - a AS anderson, q1, q3,
        q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound,
        (SELECT count(*) FROM {source} AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))) AS outliers
        FROM (SELECT count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM {source}) m,
        (SELECT m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) - 3 AS ku FROM (SELECT avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4
            FROM (SELECT x - avg(x) OVER () AS d FROM {source}))),
        (SELECT regr_slope(x, q) AS slope, regr_intercept(x, q) AS intercept, corr(x, q) AS r FROM (SELECT x, {sqltext.normal_ppf('p')} AS q FROM (
            SELECT x, {FILLIBEN} AS p FROM (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM {source})))),
        (SELECT max(greatest((b + t) / n - {up}, {up} - b / n)) AS ks, sum((t * (2 * b + t) * ln({up}) + t * (2 * n - 2 * b - t) * ln({down})) / n) AS a FROM (
            SELECT DISTINCT x, n::DOUBLE AS n, b::DOUBLE AS b, t::DOUBLE AS t, z FROM (SELECT x, count(*) OVER () AS n, rank() OVER (ORDER BY x) - 1 AS b,
            count(*) OVER (PARTITION BY x) AS t, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS z FROM {source})))"""


ALL_SQL = f"""SELECT "column", n, outliers, {', '.join(f'round({m}, 4) + 0.0 AS {m}' for m in ALL_MEASURES)} FROM ({' UNION ALL '.join(map(_all_sql, ALL_COLUMNS))})"""


QUERIES = {
    "diagnostics_all_columns": Query(diagnostics_all, ALL_SQL),
    "diagnostics_column": Query(column_report, REPORT_SQL),
    "iqr_outliers": Query(iqr_outliers, _outlier_sql(["value", "user_id"])),
    "outlier_rows": Query(
        lambda s, d: diagnostics.outlier_rows(table(s, d, "events"), "value").select("event_id", "value"), OUTLIER_ROWS
    ),
    "first_outliers": Query(
        lambda s, d: diagnostics.first_outliers(table(s, d, "events"), "value", ["event_id"]).select("event_id", "value"),
        f"SELECT * FROM ({OUTLIER_ROWS}) ORDER BY event_id LIMIT 50",
    ),
    "qq_points": Query(
        qq_points,
        f"""SELECT i AS position, round(q, 6) + 0.0 AS theoretical, round(x, 6) + 0.0 AS sample FROM ({QQ_ROWS})
        WHERE i IN (SELECT 1 + (k * (m - 1)) // 4999 FROM range(5000) t(k), (SELECT count(value) AS m FROM {GAPPY_EVENTS}))""",
    ),
    "qq_points_all": Query(
        lambda s, d: rounded(diagnostics.qq_points(gappy_events(s, d), "value"), 6, "theoretical", "sample"),
        f"SELECT i AS position, round(q, 6) + 0.0 AS theoretical, round(x, 6) + 0.0 AS sample FROM ({QQ_ROWS})",
    ),
    "qq_fit": Query(
        qq_fit,
        f"""SELECT count(*) AS n, round(regr_slope(x, q), 6) AS slope, round(regr_intercept(x, q), 6) AS intercept,
        round(corr(x, q), 6) AS r FROM ({QQ_ROWS})""",
    ),
    "ks_statistic": Query(
        ks_statistic,
        f"""SELECT 'value' AS "column", any_value(n) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
        round(max(greatest((b + t) / n - {sqltext.normal_cdf('z')}, {sqltext.normal_cdf('z')} - b / n)), 6) AS statistic FROM ({PLACES})""",
    ),
    "anderson_statistic": Query(anderson_statistic, ANDERSON_SQL),
    "shapiro": Query(shapiro, _shapiro_sql(["value", "user_id"])),
    "levene": Query(
        lambda s, d: rounded(hypothesis.levene(_lines(s, d), "l_returnflag", "l_quantity").drop("p_value"), 5, "statistic"),
        _one_way_sql(_levene_rows(FLAG_QUANTITY)),
    ),
    "ttest": Query(
        lambda s, d: rounded(
            hypothesis.ttest(_lines(s, d), "l_linestatus", "l_extendedprice").select("statistic", "dof", "used_welch"), 5, "statistic"
        ).withColumn("dof", F.round("dof", 3)),
        _ttest_sql(STATUS_PRICE),
    ),
    "anova": Query(
        lambda s, d: rounded(
            hypothesis.anova(table(s, d, "customer"), "c_mktsegment", "c_acctbal").drop("p_value"), 5, "statistic"
        ),
        _one_way_sql(SEGMENT_BALANCE),
    ),
    "mannwhitney": Query(
        lambda s, d: rounded(hypothesis.mann_whitney(_lines(s, d), "l_linestatus", "l_extendedprice"), 6, "p_value"),
        MANN_WHITNEY_SQL,
    ),
    "kruskal": Query(
        lambda s, d: rounded(hypothesis.kruskal(_orders(s, d), "o_orderpriority", "o_totalprice").drop("p_value"), 5, "statistic"),
        _kruskal_sql(),
    ),
    "kruskal_by_user": Query(
        lambda s, d: rounded(hypothesis.kruskal(_quarters(s, d), "user_id", "quarter").drop("p_value"), 5, "statistic"),
        _kruskal_sql(rows=USER_QUARTERS),
    ),
    "wilcoxon": Query(
        lambda s, d: rounded(hypothesis.wilcoxon(_lines(s, d), "l_discount", "l_tax").drop("p_value"), 5, "z"), _wilcoxon_sql()
    ),
    "wilcoxon_gaps": Query(
        lambda s, d: rounded(
            hypothesis.wilcoxon(_lines(s, d).withColumn("l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax"))), "l_discount", "l_tax").drop("p_value"),
            5, "z",
        ),
        _wilcoxon_sql().replace("count(*) AS n_pairs", "count(l_tax) AS n_pairs").replace("FROM lineitem", f"FROM {GAPPY_LINES}"),
    ),
    "chi_square": Query(_chi("orders", "o_orderpriority", "o_orderstatus"), _chi_sql("orders", "o_orderpriority", "o_orderstatus")),
    "chi_square_sparse": Query(_chi("part", "p_brand", "p_size"), _chi_sql("part", "p_brand", "p_size")),
    "chi_square_2x2": Query(_chi("labels", "quality", "toxic"), _chi_sql("labels", "quality", "toxic")),
    "contingency": Query(
        lambda s, d: hypothesis.contingency(_orders(s, d), "o_orderpriority", "o_orderstatus"),
        """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
        count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
    ),
    "group_summary": Query(
        group_summary,
        f"""SELECT event_type AS "group", count(*) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std
        FROM {GAPPY_EVENTS} WHERE value IS NOT NULL GROUP BY 1""",
    ),
    "test_p_values": Query(lambda s, d: rounded(test_tables(s, d), 5, "statistic", "p_value"), _p_values_sql()),
}
