"""Registered queries: time series, models and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import models, timeseries
from millrace.plans.tables import Query, rounded, table
from millrace.session import materialise

LAST_ORDER = "(SELECT o_orderdate AS ds, arg_max(o_totalprice, o_orderkey) AS y FROM orders GROUP BY 1)"
LAST_EVENT = "(SELECT ts AS ds, arg_max(value, event_id) AS y FROM events GROUP BY 1)"

START = {
    "D": "date_trunc('day', {0})",
    "W": "date_trunc('week', {0})",
    "M": "date_trunc('month', {0})",
    "Q": "date_trunc('quarter', {0})",
    "Y": "date_trunc('year', {0})",
}
LENGTH = {"D": "1 day", "W": "7 days", "M": "1 month", "Q": "3 months", "Y": "1 year"}
SQL_AGG = {
    "mean": "avg(y)", "sum": "sum(y)", "max": "max(y)", "min": "min(y)", "first": "arg_min(y, ds)", "last": "arg_max(y, ds)",
}


def _series_sql(source: str, freq: str | None, agg: str) -> str:
    """The prepared series (ds, y, position, is_train) as a query without its WITH list."""
    if freq is None:
        filled = f"SELECT ds, y FROM {source}"
    else:
        start = START[freq]
        value = "coalesce(p.y, 0)" if agg == "sum" else "p.y"
        filled = f"""SELECT c.s + INTERVAL '{LENGTH[freq]}' - INTERVAL 1 DAY AS ds, {value} AS y FROM
          (SELECT unnest(generate_series({start.format('min(ds)')}::TIMESTAMP, {start.format('max(ds)')}::TIMESTAMP, INTERVAL '{LENGTH[freq]}')) AS s
            FROM {source}) c LEFT JOIN
          (SELECT {start.format('ds')}::TIMESTAMP AS s, {SQL_AGG[agg]} AS y FROM {source} GROUP BY 1) p USING (s)"""
    return f"""SELECT ds, y, row_number() OVER (ORDER BY ds) - 1 AS position,
      row_number() OVER (ORDER BY ds) - 1 < floor(count(*) OVER () * 0.8) AS is_train FROM
      (SELECT ds, last_value(y IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS y FROM ({filled}))
      WHERE y IS NOT NULL"""


def _orders_series(freq: str | None, agg: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        orders = table(spark, folder, "orders")
        return rounded(timeseries.prepare(orders, "o_orderdate", "o_totalprice", freq, agg, ["o_orderkey"]), 6, "y")

    return run


def _rounded_series_sql(source: str, freq: str | None, agg: str) -> str:
    return f"SELECT ds, round(y, 6) + 0.0 AS y, position, is_train FROM ({_series_sql(source, freq, agg)})"


def orders_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without a price on the 3rd to the 7th of each month: five days in a row have no value."""
    orders = table(spark, folder, "orders")
    return orders.withColumn("o_totalprice", F.when(~F.dayofmonth("o_orderdate").between(3, 7), F.col("o_totalprice")))


LAST_GAPPY = """(SELECT o_orderdate AS ds, arg_max(CASE WHEN day(o_orderdate) BETWEEN 3 AND 7 THEN -1 ELSE o_totalprice END, o_orderkey) AS raw,
    nullif(raw, -1) AS y FROM orders GROUP BY 1)"""


def ts_lags(spark: SparkSession, folder: str) -> DataFrame:
    series = timeseries.prepare(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", "D", "max", ["o_orderkey"])
    return timeseries.lag_features(series)


LAGS_SQL = f"""SELECT ds, position, is_train, lag5, lag4, lag3, lag2, lag1, y FROM (SELECT *,
    {', '.join(f'lag(y, {k}) OVER (PARTITION BY is_train ORDER BY position) AS lag{k}' for k in (5, 4, 3, 2, 1))}
    FROM ({_series_sql(LAST_ORDER, 'D', 'max')})) WHERE lag5 IS NOT NULL"""


def ts_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of the simplest prediction, the value before, on the daily mean of all events."""
    series = timeseries.prepare(table(spark, folder, "events"), "ts", "value", "D", "mean", ["event_id"])
    naive = timeseries.lag_features(series).select("ds", F.col("lag1").alias("yhat"))
    return timeseries.metrics(series, naive)


METRICS_SQL = f"""SELECT count(*) AS n, round(avg(pow(y - p, 2)), 4) AS mse, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse,
    round(avg(abs(y - p)), 4) AS mae, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 4) AS r2 FROM (
    SELECT y, lag(y) OVER (PARTITION BY is_train ORDER BY position) AS p, lag(y, 5) OVER (PARTITION BY is_train ORDER BY position) AS l
    FROM ({_series_sql(LAST_EVENT, 'D', 'mean')})) WHERE l IS NOT NULL"""


def _gaps_sql(source: str, ds: str) -> str:
    return f"SELECT epoch_us({ds}) - lag(epoch_us({ds})) OVER (ORDER BY {ds}) AS us FROM {source}"


def _pattern_sql(source: str, ds: str) -> str:
    return f"""SELECT CASE WHEN m < 60 THEN 'seconds' WHEN m < 3600 THEN 'minutes' WHEN m < 86400 THEN 'hours' WHEN m < 604800 THEN 'days'
        WHEN m < 2678400 THEN 'weeks' WHEN m < 31536000 THEN 'months' ELSE 'years' END AS frequency,
      CASE WHEN m < 60 THEN 'S' WHEN m < 3600 THEN 'T' WHEN m < 86400 THEN 'H' WHEN m < 604800 THEN 'D'
        WHEN m < 2678400 THEN 'W' WHEN m < 31536000 THEN 'M' ELSE 'Y' END AS freq_code,
      round(low, 6) AS min_interval, round(m, 6) AS median_interval, n <> d AS has_duplicates, d AS unique_dates, n AS total_records,
      coalesce(s / nullif(m, 0) < 0.1, false) AS regular_intervals
      FROM (SELECT median(us / 1e6) AS m, min(us / 1e6) AS low, stddev_samp(us / 1e6) AS s FROM ({_gaps_sql(source, ds)})),
      (SELECT count(*) AS n, count(DISTINCT {ds}) AS d FROM {source})"""


def _validate_sql(source: str, ds: str) -> str:
    gaps = f"(SELECT us FROM ({_gaps_sql(source, ds)}) WHERE us IS NOT NULL)"
    return f"""SELECT 'duplicate dates' AS "check", 'error' AS level, sum(c)::DOUBLE AS value FROM
        (SELECT count(*) AS c FROM {source} GROUP BY {ds}) WHERE c > 1 HAVING sum(c) IS NOT NULL
      UNION ALL SELECT 'irregular intervals in percent', CASE WHEN p > 20 THEN 'error' ELSE 'warning' END, round(p, 6) FROM
        (SELECT 100.0::DOUBLE * count(*) FILTER (us <> (SELECT us FROM {gaps} GROUP BY us ORDER BY count(*) DESC, us LIMIT 1)) / count(*) AS p
         FROM {gaps}) WHERE p > 5"""


def _forecast(spark: SparkSession, folder: str) -> timeseries.Forecast:
    orders = table(spark, folder, "orders")
    return timeseries.forecast(orders, "o_orderdate", "o_totalprice", 30, "D", "mean", ["o_orderkey"])


def ts_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return timeseries.plot_rows(_forecast(spark, folder))


def ts_forecast_metrics(spark: SparkSession, folder: str) -> DataFrame:
    result = _forecast(spark, folder)
    return timeseries.metrics(result.history, result.predictions)


#: Given trees over the lags 5 to 1, features 0 to 4: tree, weight, node, left, right, feature, threshold, value.
GIVEN_TREES = [
    (0, 1.0, 0, 1, 4, 4, 150_000.0, None), (0, 1.0, 1, 2, 3, 0, 140_000.0, None), (0, 1.0, 2, -1, -1, None, None, 141_000.0),
    (0, 1.0, 3, -1, -1, None, None, 152_500.0), (0, 1.0, 4, -1, -1, None, None, 148_000.0),
    (1, 0.5, 0, 1, 2, 2, 147_000.0, None), (1, 0.5, 1, -1, -1, None, None, 9_000.0), (1, 0.5, 2, -1, -1, None, None, -6_000.0),
    (2, 0.25, 0, -1, -1, None, None, 1_000.0),
]


def ts_forecast_given(spark: SparkSession, folder: str) -> DataFrame:
    """A forecast by given trees: fitted and future days, each future value an input of the next."""
    trees = spark.createDataFrame(GIVEN_TREES, timeseries.NODES)
    found = timeseries.forecast(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", 60, "D", "mean", ["o_orderkey"], trees)
    return rounded(found.predictions, 6, "yhat", "yhat_lower", "yhat_upper")


GIVEN_VALUE = """CASE WHEN l1 <= 150000 THEN CASE WHEN l5 <= 140000 THEN 141000.0 ELSE 152500.0 END ELSE 148000.0 END
    + 0.5 * CASE WHEN l3 <= 147000 THEN 9000.0 ELSE -6000.0 END + 0.25 * 1000.0"""
GIVEN_SQL = f"""WITH RECURSIVE s AS (SELECT y, position, ds, row_number() OVER (ORDER BY position DESC) AS back,
    {', '.join(f'lag(y, {k}) OVER (ORDER BY position) AS l{k}' for k in (5, 4, 3, 2, 1))} FROM ({_series_sql(LAST_ORDER, 'D', 'mean')}) WHERE NOT is_train),
  t AS (SELECT min(ds) AS start, min(position) AS base, count(*) AS n FROM s WHERE l5 IS NOT NULL),
  w AS (SELECT {', '.join(f'max(y) FILTER (back = {k}) AS l{k}' for k in (5, 4, 3, 2, 1))} FROM s),
  r AS (SELECT 0 AS i, l5::DOUBLE AS l5, l4::DOUBLE AS l4, l3::DOUBLE AS l3, l2::DOUBLE AS l2, l1::DOUBLE AS l1 FROM w
    UNION ALL SELECT i + 1, l4, l3, l2, l1, ({GIVEN_VALUE})::DOUBLE FROM r WHERE i < 60),
  p AS (SELECT position - base AS k, ({GIVEN_VALUE})::DOUBLE AS yhat, false AS is_future FROM s, t WHERE l5 IS NOT NULL
    UNION ALL SELECT n + i - 1, l1, true FROM r, t WHERE i > 0)
SELECT start + k * INTERVAL 1 DAY AS ds, round(yhat, 6) + 0.0 AS yhat, round(yhat * 0.9, 6) + 0.0 AS yhat_lower, round(yhat * 1.1, 6) + 0.0 AS yhat_upper, is_future FROM p, t"""


# ---------------------------------------------------------------- models


def letters(chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return F.length("text") - F.length(F.translate("text", chars, ""))


def document_facts(spark: SparkSession, folder: str, *more: Column) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        F.size(F.split("text", r"\s+")).alias("words"),
        F.size(F.split("text", "\n")).alias("lines"),
        letters("0123456789").alias("digits"),
        *more,
    )


def automl_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Models of the quality label, on the documents that have one."""
    facts = table(spark, folder, "labels").join(document_facts(spark, folder), "doc_id").drop("toxic")
    train, test = models.split(facts, key=["doc_id"])
    return models.compare(train.drop("doc_id"), test.drop("doc_id"), "quality", "classification").leaderboard.drop("seconds")


def automl_regress(spark: SparkSession, folder: str) -> DataFrame:
    """Models of the length of every document."""
    train, test = models.split(document_facts(spark, folder), key=["doc_id"])
    return models.compare(train, test, "n_chars", "regression", ["lang", "source", "words", "lines"]).leaderboard.drop("seconds")


def linear_fit(spark: SparkSession, folder: str) -> DataFrame:
    """The linear model's scores with one feature, which SQL can fit as well."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    train, test = models.split(lines, key=["l_orderkey", "l_linenumber"])
    pool = {"LinearRegression": models.model_pool("regression", 0, 1)["LinearRegression"]}
    board = models.compare(train, test, "l_extendedprice", "regression", ["l_quantity"], pool).leaderboard
    return rounded(board.drop("seconds"), 6, "r2", "adj_r2", "rmse")


LINEAR_SQL = """WITH d AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y,
    ('0x' || substr(md5(l_orderkey || ':' || l_linenumber || ':42'), 1, 13))::BIGINT / pow(2, 52) < 0.8 AS train FROM lineitem),
  f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM d WHERE train),
  s AS (SELECT count(*) AS n, sum(pow(y - a * x - b, 2)) AS e, var_pop(y) * count(*) AS t FROM d, f WHERE NOT train)
SELECT 'LinearRegression' AS model, round(1 - e / t, 6) AS r2, round(1 - (e / t) * (n - 1) / (n - 2), 6) AS adj_r2, round(sqrt(e / n), 6) AS rmse FROM s"""


def automl_features(spark: SparkSession, folder: str) -> DataFrame:
    """The feature vector of every customer: balance and gaps standardised, segments as indicators."""
    customer = table(spark, folder, "customer")
    gaps = customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    steps = models.fit_features(gaps, ["c_acctbal", "c_mktsegment"])
    made = steps.transform(gaps.select("c_custkey", "c_acctbal", "c_mktsegment"))
    array = models.vector_to_array("features")
    return made.select("c_custkey", *[(F.round(array[i], 6) + 0.0).alias(f"f{i}") for i in range(6)])


FEATURES_SQL = f"""WITH f AS (SELECT c_custkey, c_mktsegment, coalesce(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END,
    (SELECT avg(c_acctbal) FROM customer WHERE c_custkey % 7 <> 0)) AS x FROM customer)
  SELECT c_custkey, round((x - (SELECT avg(x) FROM f)) / (SELECT stddev_pop(x) FROM f), 6) + 0.0 AS f0, {', '.join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1.0 ELSE 0.0 END AS f{i + 1}"
    for i, s in enumerate(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']))} FROM f"""


def cluster_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return models.cluster(table(spark, folder, "embeddings"), vector="embedding", k=10, components=2).labelled


def cluster_summary(spark: SparkSession, folder: str) -> DataFrame:
    return models.cluster(table(spark, folder, "part"), ["p_size", "p_retailprice", "p_type"], k=4, components=3).summary


def cluster_elbow(spark: SparkSession, folder: str) -> DataFrame:
    return models.elbow(table(spark, folder, "embeddings"), [2, 4, 8], vector="embedding")


CENTRES = [(10.0, 1000.0), (25.0, 1500.0), (40.0, 1200.0)]


def cluster_given(spark: SparkSession, folder: str) -> DataFrame:
    """Parts by the nearest of given centres, with the inertia of each cluster."""
    found = models.nearest_centres(table(spark, folder, "part"), ["p_size", "p_retailprice"], CENTRES)
    return rounded(found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("inertia")), 3, "inertia")


CLUSTER_SQL = f"""WITH d AS (SELECT p_partkey, i, pow(p_size - x, 2) + pow(p_retailprice - y, 2) AS d FROM part,
    (VALUES {', '.join(f'({i}, {x}, {y})' for i, (x, y) in enumerate(CENTRES))}) AS c(i, x, y))
SELECT cluster, count(*) AS n, round(sum(d), 3) + 0.0 AS inertia FROM (SELECT arg_min(i, (d, i)) AS cluster, min(d) AS d FROM d GROUP BY p_partkey) GROUP BY cluster"""


def component_shares(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(models.component_shares(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"]), 6, "share")


#: Two standardised columns with the correlation r have the variances 1 + |r| and 1 - |r| along their components.
SHARES_SQL = """SELECT component, round((1 + s * abs((SELECT corr(l_quantity, l_extendedprice) FROM lineitem))) / 2, 6) AS share
    FROM (VALUES (1, 1), (2, -1)) AS t(component, s)"""


def class_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How well the share of distinct letters tells the quality of a document: metrics of a fixed score."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    score = 1 / (1 + F.length(F.regexp_replace("text", "[a-z ]", "")) / 200)
    return rounded(models.class_scores(docs.withColumn("score", score), "quality", "score"), 6, "accuracy", "balanced_accuracy", "f1", "roc_auc")


SCORES_SQL = """WITH d AS (SELECT quality AS y, 1 / (1 + length(regexp_replace(text, '[a-z ]', '', 'g')) / 200.0::DOUBLE) AS p FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL),
  g AS (SELECT y, p >= 0.5 AS q FROM d),
  c AS (SELECT count(*) AS n, count(*) FILTER (y = 1 AND q) AS tp, count(*) FILTER (y = 0 AND NOT q) AS tn, count(*) FILTER (y = 1) AS p1, count(*) FILTER (y = 0) AS p0,
    count(*) FILTER (q) AS q1, count(*) FILTER (NOT q) AS q0 FROM g),
  r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM d)
SELECT n, round((tp + tn)::DOUBLE / n, 6) AS accuracy, round((tp::DOUBLE / p1 + tn::DOUBLE / p0) / 2, 6) AS balanced_accuracy,
  round((2.0::DOUBLE * tp / (p1 + q1) * p1 + 2.0::DOUBLE * tn / (p0 + q0) * p0) / n, 6) AS f1,
  round(((SELECT sum(r) FROM r WHERE y = 1) - p1 * (p1 + 1) / 2.0) / (p1 * p0), 6) AS roc_auc FROM c"""


def automl_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Models of a target of several classes: the language of every document that names one, from counts of its characters."""
    facts = document_facts(spark, folder, *[letters(c).alias(f"n{i}") for i, c in enumerate(["éèê", "äöü", "ñó", "th", "e"])])
    counts = [f"n{i}" for i in range(5)]
    columns = ["n_chars", "words", *counts]
    facts = materialise(facts.select("doc_id", "lang", *columns))  # the texts are read once
    facts = facts.drop(*counts).join(facts.select("doc_id", *counts), "doc_id").where("lang is not null")
    train, test = models.split(facts, key=["doc_id"])
    return models.compare(train, test, "lang", "classification", columns).leaderboard.drop("seconds")


QUERIES = {
    "ts_pattern": Query(
        lambda s, d: rounded(timeseries.pattern(table(s, d, "events"), "ts"), 6, "min_interval", "median_interval"),
        _pattern_sql("events", "ts"),
    ),
    "ts_pattern_orders": Query(
        lambda s, d: rounded(timeseries.pattern(table(s, d, "orders"), "o_orderdate"), 6, "min_interval", "median_interval"),
        _pattern_sql("orders", "o_orderdate"),
    ),
    "ts_validate": Query(
        lambda s, d: rounded(timeseries.validate(table(s, d, "orders"), "o_orderdate", "o_totalprice"), 6, "value"),
        _validate_sql("orders", "o_orderdate"),
    ),
    "ts_validate_events": Query(
        lambda s, d: rounded(timeseries.validate(table(s, d, "events"), "ts", "value"), 6, "value"), _validate_sql("events", "ts")
    ),
    "ts_prepare": Query(_orders_series(None, "mean"), _rounded_series_sql(LAST_ORDER, None, "mean")),
    **{
        f"ts_resample_{freq.lower()}_{agg}": Query(_orders_series(freq, agg), _rounded_series_sql(LAST_ORDER, freq, agg))
        for freq, agg in (("D", "mean"), ("W", "sum"), ("M", "first"), ("M", "last"), ("Q", "max"), ("Y", "min"))
    },
    "ts_resample_events": Query(
        lambda s, d: rounded(timeseries.prepare(table(s, d, "events"), "ts", "value", "D", "mean", ["event_id"]), 6, "y"),
        _rounded_series_sql(LAST_EVENT, "D", "mean"),
    ),
    "ts_resample_gaps": Query(
        lambda s, d: rounded(timeseries.prepare(orders_with_gaps(s, d), "o_orderdate", "o_totalprice", "D", "max", ["o_orderkey"]), 6, "y"),
        _rounded_series_sql(LAST_GAPPY, "D", "max"),
    ),
    "ts_lags": Query(ts_lags, LAGS_SQL),
    "ts_metrics": Query(ts_metrics, METRICS_SQL),
    "ts_forecast": Query(ts_forecast),
    "ts_forecast_given": Query(ts_forecast_given, GIVEN_SQL),
    "ts_forecast_metrics": Query(ts_forecast_metrics),
    "automl_features": Query(automl_features, FEATURES_SQL),
    "automl_classify": Query(automl_classify),
    "automl_regress": Query(automl_regress),
    "automl_linear": Query(linear_fit, LINEAR_SQL),
    "automl_languages": Query(automl_languages),
    "class_scores": Query(class_scores, SCORES_SQL),
    "cluster_given": Query(cluster_given, CLUSTER_SQL),
    "component_shares": Query(component_shares, SHARES_SQL),
    "cluster_embeddings": Query(cluster_embeddings),
    "cluster_summary": Query(cluster_summary),
    "cluster_elbow": Query(cluster_elbow),
}
