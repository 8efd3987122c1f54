import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import models, timeseries


def daily(spark, n, skip=(), start=dt.datetime(2024, 1, 1)):
    rows = [(start + dt.timedelta(days=k), float(k)) for k in range(n) if k not in skip]
    return spark.createDataFrame(rows, "ds timestamp_ntz, y double")


def checks(df):
    return {r["check"]: (r["level"], r["value"]) for r in timeseries.validate(df, "ds", "y").collect()}


def test_too_short(spark):
    assert checks(daily(spark, 29)) == {"fewer than 30 rows": ("error", 29.0)}


def test_good_series(spark):
    assert checks(daily(spark, 60)) == {}


def test_irregular_warning_and_error(spark):
    assert checks(daily(spark, 60, skip=(10, 20, 30, 40)))["irregular intervals in percent"][0] == "warning"
    skipped = tuple(range(5, 60, 3))
    assert checks(daily(spark, 60, skip=skipped))["irregular intervals in percent"][0] == "error"


def test_missing_columns_and_values(spark):
    df = daily(spark, 40)
    assert timeseries.validate(df, "when", "y").first()["check"] == "date column not found"
    assert timeseries.validate(df, "ds", "z").first()["check"] == "target column not found"
    gaps = df.withColumn("y", F.when(F.col("y") > 3, F.col("y")))
    assert checks(gaps)["missing target values"] == ("error", 4.0)
    doubled = df.union(df.limit(5))
    assert checks(doubled)["duplicate dates"] == ("error", 10.0)


def test_pattern(spark):
    row = timeseries.pattern(daily(spark, 50), "ds").first()
    assert (row["frequency"], row["freq_code"], row["regular_intervals"], row["has_duplicates"]) == ("days", "D", True, False)
    weekly = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=7 * k),) for k in range(9)], "ds timestamp_ntz")
    assert timeseries.pattern(weekly, "ds").first()["frequency"] == "weeks"


def test_week_ends_on_sunday(spark):
    # 2024-01-01 is a Monday
    week = timeseries.prepare(daily(spark, 7), "ds", "y", "W", "mean").collect()
    assert [(r["ds"], r["y"]) for r in week] == [(dt.datetime(2024, 1, 7), 3.0)]


@pytest.mark.parametrize("block", [100_000, 7])
def test_short_gaps_are_filled(spark, monkeypatch, block):
    monkeypatch.setattr(timeseries, "BLOCK", block)
    series = timeseries.prepare(daily(spark, 40, skip=(5, 6, 7, 8, 20)), "ds", "y", "D", "mean").orderBy("ds").toPandas()
    expected = pd.Series([float(k) if k not in (5, 6, 7, 8, 20) else np.nan for k in range(40)]).ffill(limit=2).dropna()
    assert list(series.y) == list(expected)
    assert list(series.position) == list(range(len(expected)))
    assert series.is_train.sum() == int(len(expected) * 0.8)


@pytest.mark.parametrize("block", [100_000, 9])
def test_lag_features(spark, monkeypatch, block):
    monkeypatch.setattr(timeseries, "BLOCK", block)
    series = timeseries.prepare(daily(spark, 50), "ds", "y")
    rows = timeseries.lag_features(series).orderBy("ds").toPandas()
    assert len(rows) == 35 + 5
    for k in range(1, 6):
        assert (rows.y - rows[f"lag{k}"] == k).all()


def test_last_row_per_date(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(day, 1.0, 2), (day, 9.0, 1), (day, 4.0, 3)], "ds timestamp_ntz, y double, o int")
    assert timeseries.last_per_date(df, "ds", "y", ["o"]).first()["y"] == 4.0


def test_sum_of_empty_periods_is_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 5), 2.0), (dt.datetime(2024, 3, 9), 5.0)], "ds timestamp_ntz, y double")
    rows = timeseries.prepare(df, "ds", "y", "M", "sum").orderBy("ds").collect()
    assert [(r["ds"].strftime("%m-%d"), r["y"]) for r in rows] == [("01-31", 2.0), ("02-29", 0.0), ("03-31", 5.0)]


def test_forecast_dates_and_band(spark):
    df = daily(spark, 80).withColumn("y", 100 + F.col("y") % 7)
    result = timeseries.forecast(df, "ds", "y", periods=4, maxIter=3)
    rows = result.predictions.orderBy("ds").toPandas()
    assert len(rows) == 16 - 5 + 4
    assert list(rows.is_future) == [False] * 11 + [True] * 4
    assert rows.ds.iloc[0] == pd.Timestamp(2024, 1, 1) + pd.Timedelta(days=64 + 5)
    assert (rows.ds.diff().dropna() == pd.Timedelta(days=1)).all()
    assert np.allclose(rows.yhat_lower, rows.yhat * 0.9) and np.allclose(rows.yhat_upper, rows.yhat * 1.1)
    assert timeseries.common_dates(result.history, result.predictions).count() == 11
    row = timeseries.metrics(result.history, result.predictions).first()
    assert row["n"] == 11 and row["rmse"] == pytest.approx(row["mse"] ** 0.5, abs=1e-3)
    with pytest.raises(ValueError, match="periods"):
        timeseries.forecast(df, "ds", "y", periods=0)


def test_every_future_row_is_what_the_model_says(spark, monkeypatch):
    """The model asked in turn, each answer being an input of the next."""
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import GBTRegressor

    fitted = []
    fit = GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, *a: fitted.append(fit(self, *a)) or fitted[-1])
    df = daily(spark, 120).withColumn("y", 50 + 20 * F.sin(F.col("y") / 3) + F.col("y") % 5)
    result = timeseries.forecast(df, "ds", "y", periods=40, maxIter=12, maxDepth=4)
    window = [r["y"] for r in result.history.orderBy("ds").collect()][-5:]
    future = result.predictions.where("is_future").orderBy("ds").collect()
    assert len(future) == 40
    for r in future:
        value = fitted[0].predict(Vectors.dense(window))
        assert r["yhat"] == pytest.approx(value, rel=1e-12)
        window = [*window[1:], value]
    nodes = timeseries.tree_nodes(fitted[0])
    assert nodes.select("tree").distinct().count() == 12
    lags = [f"lag{k}" for k in (5, 4, 3, 2, 1)]
    test = timeseries.lag_features(result.history).where("not is_train").crossJoin(timeseries.forest(nodes))
    said = {r["position"]: r["p"] for r in test.select("position", timeseries._grown(F.col("trees"), F.array(*lags)).alias("p")).collect()}
    own = sorted(r["yhat"] for r in result.predictions.where("not is_future").collect())
    assert sorted(said.values()) == pytest.approx(own, rel=1e-12)


@pytest.fixture(scope="module")
def flowers(spark):
    rng = np.random.default_rng(3)
    kind = rng.integers(0, 3, 300)
    pdf = pd.DataFrame(
        {
            "a": kind * 2.0 + rng.normal(0, 0.3, 300),
            "b": rng.normal(0, 1, 300),
            "c": [["red", "green", "blue"][k] for k in kind],
            "d": [f"name{k}" for k in rng.integers(0, 40, 300)],
            "kind": [["x", "y", "z"][k] for k in kind],
        }
    )
    pdf.loc[::17, "a"] = np.nan
    pdf.loc[::19, "c"] = None
    return spark.createDataFrame(pdf).cache()


def test_classification(flowers):
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier

    train, test = models.split(flowers)
    pool = {"tree": DecisionTreeClassifier(), "broken": GBTClassifier()}
    result = models.compare(train, test, "kind", "classification", estimators=pool, keep_predictions=True)
    row = result.leaderboard.first()
    assert row["model"] == "tree" and row["balanced_accuracy"] > 0.9 and row["roc_auc"] > 0.9
    assert list(result.skipped) == ["broken"]
    assert result.predictions.columns == ["label", "tree"]
    assert set(r["label"] for r in result.predictions.collect()) == {"x", "y", "z"}


def test_pool_of_three_classes(flowers):
    train, test = models.split(flowers)
    pool = models.model_pool("classification", 3, 8, depth=3, trees=5, rounds=2)
    assert len(pool) == 8
    width = len(models.fit_features(train, ["a", "b", "c", "d"]).transform(train.select("a", "b", "c", "d")).first()["features"])
    result = models.compare(train, test, "kind", "classification", estimators=models.model_pool("classification", 3, width, depth=3, trees=5, rounds=2))
    rows = {r["model"]: r for r in result.leaderboard.collect()}
    assert len(rows) == 8 and {"GBTClassifier", "FMClassifier", "LinearSVC"} <= set(rows)
    for name, r in rows.items():
        assert name in result.skipped or (r["balanced_accuracy"] > 0.3 and 0 <= r["roc_auc"] <= 1)
    assert rows["GBTClassifier"]["roc_auc"] > 0.9


def test_models_read_their_rows_once(spark):
    from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes

    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    rows = spark.range(0, 600, 1, 2).selectExpr("cast(id % 3 as string) AS kind", "cast(id % 3 + id % 2 as double) AS a", "cast(id % 5 as string) AS b")
    train, test = (rows.mapInPandas(count, rows.schema) for _ in range(2))
    pool = {"tree": DecisionTreeClassifier(maxDepth=2), "bayes": NaiveBayes(modelType="gaussian")}
    board = models.compare(train, test, "kind", "classification", ["a", "b"], pool).leaderboard
    assert board.where("accuracy is not null").count() == 2
    assert seen.value == 1200


def test_letters_of_a_text(spark):
    from millrace.plans.series import letters

    texts = ["été où \U0001f600 the HÊTRE", "", None, "thththe\n ñó äöü", "e\u0301e"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for chars in ("éèê", "äöü", "ñó", "th", "e", "0123456789"):
        found = [r[0] for r in df.select(letters(chars)).collect()]
        assert found == [None if t is None else sum(c in chars for c in t) for t in texts]
        assert found == [r[0] for r in df.select(F.length(F.regexp_replace("text", f"[^{chars}]", ""))).collect()]


def test_auc_of_several_classes(spark):
    random = np.random.default_rng(4)
    p, label = np.round(random.random((400, 3)), 2), random.integers(0, 3, 400)
    made = spark.createDataFrame([(float(k), [float(x) for x in row]) for k, row in zip(label, p, strict=True)], "label double, p array<double>")
    made = made.withColumn("probability", models.array_to_vector("p")).drop("p").repartition(5)
    total = 0.0
    for k in range(3):
        yes, no = p[label == k, k], p[label != k, k]
        total += ((yes[:, None] > no).mean() + 0.5 * (yes[:, None] == no).mean()) * len(yes)
    assert models._roc_auc(made, 3) == pytest.approx(total / 400, rel=1e-12)


def test_regression(flowers):
    from pyspark.ml.regression import LinearRegression

    train, test = models.split(flowers.dropna(subset=["a"]))
    result = models.compare(train, test, "a", "regression", ["kind", "b"], {"line": LinearRegression()})
    row = result.leaderboard.first()
    assert 0.9 < row["adj_r2"] < row["r2"] < 1


def test_auc_by_hand(spark):
    df = spark.createDataFrame([(1.0, 0.9), (1.0, 0.4), (0.0, 0.4), (0.0, 0.1)], "label double, p double")
    assert models._auc(df, F.col("p"), 1.0)[0] == pytest.approx(0.875)


def test_features(flowers):
    steps = models.fit_features(flowers, ["a", "c", "d"])
    made = steps.transform(flowers.select("a", "c", "d", "kind"))
    # one number, one code, four indicators (three colours and 'missing')
    assert len(made.first()["features"]) == 6
    unseen = flowers.limit(1).withColumns({"c": F.lit("pink"), "d": F.lit("nobody")})
    assert list(steps.transform(unseen.select("a", "c", "d")).first()["features"])[1:] == [-1.0] + [0.0] * 4


def test_clusters(flowers):
    result = models.cluster(flowers, ["a", "b"], k=3, components=2)
    row = result.summary.first()
    assert row["inertia"] > 0 and -1 <= row["silhouette"] <= 1 and sum(row["explained_variance"]) == pytest.approx(1)
    assert result.labelled.count() == 300 and {"pc1", "pc2", "cluster"} <= set(result.labelled.columns)
    inertia = [r["inertia"] for r in models.elbow(flowers, [2, 3, 5], ["a", "b"]).orderBy("k").collect()]
    assert inertia == sorted(inertia, reverse=True)
