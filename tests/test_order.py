"""Ranks, positions, quantiles and fills against brute force, also under skew and small limits."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import diagnostics, impute, quantiles, rank
from millrace.operators.sample import sample_rows

SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; the rest spread over very different sizes."""
    rng = np.random.default_rng(5)
    rest = np.round(np.exp(rng.normal(0, 3, 4000)), 3)
    values = np.concatenate([np.full(2000, 7.0), rest])
    pdf = pd.DataFrame({"i": np.arange(6000), "g": np.where(np.arange(6000) % 3 == 0, "b", "a"), "v": values})
    pdf.loc[pdf.i % 11 == 0, "v"] = np.nan
    return spark.createDataFrame(pdf).repartition(7).cache(), pdf


@pytest.mark.parametrize(("between", "few"), [(200_000, 20_000), (200_000, 0), (40, 0), (3, 0)])
def test_exact_quantiles(skewed, monkeypatch, between, few):
    monkeypatch.setattr(quantiles, "MAX_BETWEEN", between)
    monkeypatch.setattr(quantiles, "FEW_ROWS", few)
    df, pdf = skewed
    found = quantiles.exact_quantiles(df, ["v", "i"], SHARES)
    for c in ("v", "i"):
        for p in SHARES:
            assert found[c][p] == pytest.approx(pdf[c].quantile(p), rel=1e-12)


def test_quantiles_of_empty_column(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles.exact_quantiles(df, ["v"], [0.5]) == {"v": {0.5: None}}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30), st.sampled_from(SHARES))
def test_quantile_property(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    expected = float(np.quantile(np.array(values), p))
    assert quantiles.exact_quantiles(df, ["v"], [p])["v"][p] == pytest.approx(expected, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("few", [rank.FEW_ROWS, 10])
@pytest.mark.parametrize("most", [rank.MAX_HELD, 0])
def test_grouped_quantiles(skewed, monkeypatch, few, most):
    monkeypatch.setattr(rank, "FEW_ROWS", few)
    monkeypatch.setattr(rank, "MAX_HELD", most)
    df, pdf = skewed
    expected = pdf.groupby("g").v.quantile([0.1, 0.5, 0.9]).unstack()
    for r in rank.grouped_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9]).collect():
        assert [r["q0"], r["q1"], r["q2"]] == pytest.approx(list(expected.loc[r["g"]]), rel=1e-12)


@pytest.mark.parametrize("partitions", [1, 8])
def test_mid_ranks(skewed, partitions):
    df, pdf = skewed
    table = rank.ranked(df.repartition(partitions), F.col("v"), by=F.col("g")).toPandas()
    expected = pdf.v.rank().groupby(pdf.v).first()
    assert np.allclose(table.midrank, expected.loc[table.value].to_numpy())
    n = int(pdf.v.notna().sum())
    assert (table.cnt * table.midrank).sum() == n * (n + 1) / 2


@pytest.mark.parametrize("between", [rank.MAX_BETWEEN, 20, 3])
@pytest.mark.parametrize("accuracy", [rank.SKETCH_ACCURACY, 100])
def test_quantile_grid(skewed, monkeypatch, between, accuracy):
    monkeypatch.setattr(rank, "MAX_BETWEEN", between)
    monkeypatch.setattr(rank, "SKETCH_ACCURACY", accuracy)
    df, pdf = skewed
    grid = rank.quantile_grid(df, F.col("v"), 101)
    assert np.allclose(grid, np.nanquantile(pdf.v, np.linspace(0, 1, 101)))


def test_position_along_two_columns(skewed):
    df, pdf = skewed
    found = rank.with_position(df, ["v", "i"]).toPandas().sort_values("position")
    expected = pdf.sort_values(["v", "i"], na_position="first")
    assert list(found.position) == list(range(6000))
    assert list(found.i) == list(expected.i)


def test_heavy_first_column_is_split(skewed):
    df, pdf = skewed
    sizes = rank.with_order_bucket(df, ["v", "i"]).groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert sizes < 1500


@pytest.mark.parametrize("case", ["one value", "no keys", "many values", "two columns"])
def test_ties_and_missing_keys_are_split(spark, case):
    key = {
        "one value": "if(id % 10 = 0, id, 7)",
        "no keys": "if(id % 10 = 0, id, null)",
        "many values": "id % 100",
        "two columns": "if(id % 10 = 0, id, 7)",
    }[case]
    df = spark.range(40_000).selectExpr("id", f"cast({key} as double) AS k", "cast(id % 2 as int) AS second")
    order = ["k", "second"] if case == "two columns" else ["k"]
    data = rank.with_order_bucket(df, order).cache()
    sizes = [r["count"] for r in data.groupBy("_bucket").count().collect()]
    assert max(sizes) <= 3 * 40_000 / 8
    if case != "many values":
        assert max(sizes) <= 2.5 * 40_000 / 8
    rows = data.toPandas().sort_values(["k", *order[1:], "_tie"], na_position="first")
    assert rows._bucket.is_monotonic_increasing
    found = rank.with_position(df, order).toPandas()
    assert sorted(found.position) == list(range(40_000))


def test_equal_rows_are_split(spark):
    df = spark.range(200_000).selectExpr("if(id % 10 = 0, id, 7) AS k", "if(id % 10 = 0, cast(id as double), 1.5) AS x")
    data = rank.with_order_bucket(df, ["k"]).cache()
    sizes = [r["count"] for r in data.groupBy("_bucket").count().collect()]
    assert max(sizes) <= 2.5 * 200_000 / 8 and sum(sizes) == 200_000
    rows = data.toPandas().sort_values(["k", "_tie"])
    assert rows.k.groupby(rows._bucket).min().is_monotonic_increasing
    found = rank.with_position(df, ["k"]).toPandas()
    assert sorted(found.position) == list(range(200_000)) and found.sort_values("position").k.is_monotonic_increasing


@pytest.mark.parametrize("method", ["ffill", "bfill", "nearest_neighbor", "interpolate"])
def test_fill_between_equal_rows(spark, method):
    """Rows that repeat whole, with and without a value, fill most buckets."""
    df = spark.range(60_000).selectExpr("if(id % 10 = 0, id, 7) AS k", "if(id % 10 = 0 and (id + 1) % 3 > 0, cast(id as double), null) AS x").where("k <> 7 or x is null")
    found = impute.impute(df, "x", method, order_by=["k"]).toPandas().sort_values("k")
    assert len(found) == 60_000 and (found.x[found.k == 7].notna().all())
    known = df.where("x is not null").toPandas().sort_values("k")
    sample = found.iloc[::997]
    left = np.searchsorted(known.k.to_numpy(), sample.k.to_numpy(), "right") - 1
    right = np.searchsorted(known.k.to_numpy(), sample.k.to_numpy(), "left")
    for (k, x), i, j in zip(sample[["k", "x"]].to_numpy(), left, right, strict=True):
        before, after = (known.iloc[i] if i >= 0 else None), (known.iloc[j] if j < len(known) else None)
        if method == "ffill":
            assert np.isnan(x) if before is None else x == before.x
        elif method == "bfill":
            assert np.isnan(x) if after is None else x == after.x
        elif before is not None and after is not None:
            share = 0 if before.k == after.k else (k - before.k) / (after.k - before.k)
            nearest = after.x if after.k - k < k - before.k else before.x
            assert x == pytest.approx(nearest if method == "nearest_neighbor" else before.x + (after.x - before.x) * share)


def test_a_value_of_many_groups_is_ranked_once(spark):
    df = spark.range(400_000).selectExpr("id AS g", "cast(id % 3 as double) AS v")
    table = rank.ranked(df, F.col("v"), by=F.col("g"))
    row = table.agg(F.count("*").alias("rows"), F.min("ties").alias("ties"), F.sum("midrank").alias("sum")).first()
    assert row["rows"] == 400_000 and row["ties"] == 133_333 and row["sum"] == 400_000 * 400_001 / 2
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("grp" in line for line in windows)


def test_ranked_columns(skewed):
    df, pdf = skewed
    table = rank.ranked_columns(df, {"v": F.col("v"), "i": F.col("i")}).toPandas()
    for c in ("v", "i"):
        own = table[table.column == c]
        clean = pdf[c].dropna()
        assert np.allclose(own.midrank, clean.rank().groupby(clean).first().loc[own.value].to_numpy())
        assert (own.n == len(clean)).all() and own.ties.sum() == len(clean)


def test_carried_texts_are_not_broadcast(spark):
    rows = [(i, "x" * 1000 + str(i) if i % 50 == 0 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(6)
    filled = impute.impute(df, "t", "ffill", order_by=["i"])
    found = filled.orderBy("i").collect()
    assert [r["t"] for r in found] == ["x" * 1000 + str(i // 50 * 50) for i in range(2000)]
    plan = filled._jdf.queryExecution().executedPlan().toString()
    start = [line for line in plan.splitlines() if "BroadcastExchange" in line]
    assert start and "SortMergeJoin" in plan
    tree = filled._jdf.queryExecution().optimizedPlan().toString()
    assert "leftHint=(strategy=broadcast" in tree or "rightHint=(strategy=broadcast" in tree


@pytest.mark.parametrize("order", [["k"], ["k", "i"]])
def test_fill_from_a_row_without_key(spark, order):
    rows = [(None, 0, 5.0), (1, 1, None), (2, 2, None), (3, 3, 8.0), (4, 4, None)]
    df = spark.createDataFrame(rows, "k int, i int, x double")
    found = impute.impute(df, "x", "ffill", order_by=order).orderBy("i").collect()
    assert [r["x"] for r in found] == [5.0, 5.0, 5.0, 8.0, 8.0]
    back = impute.impute(df, "x", "bfill", order_by=order).orderBy("i").collect()
    assert [r["x"] for r in back] == [5.0, 8.0, 8.0, 8.0, None]


def test_distinct_positions(skewed):
    df, pdf = skewed
    found = rank.distinct_positions(df.select("i").distinct(), "i").toPandas().sort_values("i")
    assert list(found.code) == list(range(6000))


@pytest.mark.parametrize("method", ["ffill", "bfill"])
def test_fill_over_long_gap(spark, method):
    pdf = pd.DataFrame({"i": np.arange(5000), "x": np.where(np.arange(5000) % 1700 == 1600, np.arange(5000), np.nan)})
    df = spark.createDataFrame(pdf).repartition(5)
    found = impute.impute(df, "x", method, order_by=["i"]).toPandas().sort_values("i").x
    expected = pdf.x.ffill() if method == "ffill" else pdf.x.bfill()
    assert np.array_equal(found.to_numpy(), expected.to_numpy(), equal_nan=True)


def test_fill_along_skewed_order(skewed):
    df, pdf = skewed
    data = df.withColumn("x", F.when(F.col("i") % 5 == 0, F.col("i")))
    found = impute.impute(data, "x", "ffill", order_by=["v", "i"]).toPandas().set_index("i").x
    expected = pdf.assign(x=pdf.i.where(pdf.i % 5 == 0)).sort_values(["v", "i"], na_position="first").set_index("i").x.ffill()
    assert np.array_equal(found.sort_index().to_numpy(), expected.sort_index().to_numpy(), equal_nan=True)


def test_sample_size(spark, skewed):
    df, _ = skewed
    assert sample_rows(df, 500).count() == 500
    assert sample_rows(df, 10_000).count() == 6000
    assert sample_rows(df, 500, key=["g"]).count() == 500
    one = sample_rows(df, 300, key=["i"]).select("i").collect()
    two = sample_rows(df.repartition(3), 300, key=["i"]).select("i").collect()
    assert set(one) == set(two)


def test_qq_fit_with_long_runs(skewed, monkeypatch):
    df, pdf = skewed
    expected = diagnostics.qq_fit(df, "v").first()
    monkeypatch.setattr(diagnostics, "RUN", 4)
    assert diagnostics.qq_fit(df, "v").first() == pytest.approx(expected, rel=1e-9)
    assert expected["n"] == pdf.v.notna().sum()


def test_sums_of_normal_quantiles_in_closed_form(spark):
    from statistics import NormalDist

    ties = [1, 700, 3, 5000, 20, 90_000, 1, 60_000, 40, 2, 1500, 1]
    n, start, rows, q = sum(ties), 0, [], []
    for value, t in enumerate(ties):
        rows.append(("v", float(value**2), start, t, n))
        start += t
    for i in range(1, n + 1):
        q.append(NormalDist().inv_cdf(0.5 ** (1 / n) if i == n else 1 - 0.5 ** (1 / n) if i == 1 else (i - 0.3175) / (n + 0.365)))
    q, v = np.array(q), np.repeat(np.arange(len(ties)) ** 2.0, ties)
    table = spark.createDataFrame(rows, "column string, value double, before bigint, ties bigint, n bigint")
    found = diagnostics._lines(table, F.lit(30.0)).first()
    slope = np.cov(q, v, bias=True)[0, 1] / q.var()
    assert found["n"] == n
    assert (found["slope"], found["intercept"], found["r"]) == pytest.approx((slope, v.mean() - slope * q.mean(), np.corrcoef(q, v)[0, 1]), rel=1e-11)


def test_line_of_one_value_and_of_equal_values(spark):
    one = diagnostics.qq_fit(spark.createDataFrame([(5.0,), (None,)], "v double"), "v").first()
    assert (one["n"], one["slope"], one["intercept"], one["r"]) == (1, None, None, None)
    same = diagnostics.qq_fit(spark.createDataFrame([(0.1,)] * 5000, "v double"), "v").first()
    assert (same["n"], same["slope"], same["r"]) == (5000, 0.0, None) and same["intercept"] == pytest.approx(0.1, rel=1e-12)
    assert diagnostics.qq_fit(spark.createDataFrame([(None,)], "v double"), "v").count() == 0


def test_line_work_grows_with_distinct_values(spark):
    """Twenty million equal values are a few thousand rows, not one per position."""
    table = spark.createDataFrame([("v", 1.0, 0, 20_000_000, 40_000_000), ("v", 2.0, 20_000_000, 20_000_000, 40_000_000)], "column string, value double, before bigint, ties bigint, n bigint")
    row = diagnostics._lines(table, F.lit(1.5)).first()
    assert row["n"] == 40_000_000 and row["r"] == pytest.approx((2 / np.pi) ** 0.5, rel=1e-6)
    assert row["slope"] == pytest.approx((2 / np.pi) ** 0.5 / 2, rel=1e-6)


def test_ranked_columns_read_their_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    df = spark.range(0, 5000, 1, 4).selectExpr("cast(id % 900 as double) AS v", "cast(id as double) AS w").mapInPandas(count, "v double, w double")
    table = rank.ranked_columns(df, {"v": F.col("v"), "w": F.col("w")}, {"v": F.col("w") < 100, "w": F.lit(False)})
    assert {r["column"]: (r["n"], r["hits"]) for r in table.groupBy("column").agg(F.max("n").alias("n"), F.sum("hits").alias("hits")).collect()}["v"] == (5000, 100)
    assert seen.value == 5000


def test_qq_points_cover_both_ends(skewed):
    df, pdf = skewed
    points = diagnostics.qq_points(df, "v", max_points=50).toPandas().sort_values("position")
    assert len(points) == 50
    assert points["sample"].iloc[0] == pdf.v.min() and points["sample"].iloc[-1] == pdf.v.max()
