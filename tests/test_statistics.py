import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import tails
from millrace.operators import chartdata, diagnostics, hypothesis


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (tails.chi2_tail(3.841458820694124, 1), 0.05),
        (tails.chi2_tail(16.918977604620448, 9), 0.05),
        (tails.chi2_tail(0.0, 3), 1.0),
        (tails.t_two_sided(2.2281388519649385, 10), 0.05),
        (tails.t_two_sided(-1.959963984540054, 1e9), 0.05),
        (tails.f_tail(4.102821015130398, 2, 10), 0.05),
        (tails.kolmogorov_two_sided(0.274, 10), 0.3715203845434982),
        (tails.normal_tail(1.959963984540054), 0.025),
    ],
)
def test_tails(value, expected):
    assert value == pytest.approx(expected, rel=1e-6)


@pytest.mark.parametrize(("n1", "n2"), [(3, 4), (5, 2), (4, 4)])
def test_exact_rank_sum(n1, n2):
    ranks = range(1, n1 + n2 + 1)
    us = [sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(ranks, n1)]
    for u in set(us):
        high = max(u, n1 * n2 - u)
        expected = min(1.0, 2 * sum(x >= high for x in us) / len(us))
        assert tails.rank_sum_exact(u, n1, n2) == pytest.approx(expected)


def test_exact_signed_rank():
    n = 7
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
    for w in range(0, 15):
        expected = min(1.0, 2 * sum(s <= w for s in sums) / len(sums))
        assert tails.signed_rank_exact(w, n) == pytest.approx(expected)


def test_shapiro_published_example():
    w, p = diagnostics.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=5e-3)
    assert p == pytest.approx(0.0067, abs=5e-4)


def groups(spark, table):
    rows = [(g, v) for g, values in table.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double")


def test_group_counts(spark):
    three = groups(spark, {"a": [1.0, 2.0], "b": [3.0, 4.0], "c": [5.0]})
    with pytest.raises(ValueError, match="'g' splits the rows into 3 groups; the t test works on 2"):
        hypothesis.run(three, "ttest", "g", "v")
    two = groups(spark, {"a": [1.0, 2.0], "b": [3.0, 4.0]})
    with pytest.raises(ValueError, match="'g' splits the rows into 2 groups; the analysis of variance works on 3 or more"):
        hypothesis.run(two, "anova", "g", "v")
    with pytest.raises(ValueError, match="unknown test"):
        hypothesis.run(two, "sign", "g", "v")


def test_levene_far_from_zero(spark):
    near = [0.001, -0.0004, 0.0007, -0.0011, 0.0002, 0.0013]
    wide = [2 * x + 0.0003 for x in near]

    def levene(shift):
        return hypothesis.levene(groups(spark, {"a": [shift + x for x in near], "b": [x - shift for x in wide]}), "g", "v").first()

    assert levene(1e6)["statistic"] == pytest.approx(levene(0.0)["statistic"], rel=1e-5)


def test_method_of_the_rank_tests(spark):
    two = groups(spark, {"a": [1.0, 2.0, 3.5], "b": [3.0, 4.0, 5.0]})
    law = {m: hypothesis.mann_whitney(two, "g", "v", method=m).first() for m in hypothesis.METHODS}
    assert law["auto"] == law["exact"] and law["auto"]["exact"] and not law["normal"]["exact"]
    with pytest.raises(ValueError, match="unknown method"):
        hypothesis.mann_whitney(two, "g", "v", method="guess")


def test_group_without_values_is_dropped(spark):
    df = groups(spark, {"a": [1.0, 2.0], "b": [3.0, 4.5], "c": [None]})
    tables = hypothesis.run(df, "ttest", "g", "v")
    assert [r["group"] for r in tables["groups"].collect()] == ["a", "b"]
    # pooled t by hand: means 1.5 and 3.75, variances 0.5 and 1.125
    assert tables["result"].first()["statistic"] == pytest.approx(-2.25 / math.sqrt(0.8125))


def test_mann_whitney_exact(spark):
    df = groups(spark, {"a": [1.0, 2.0, 3.0], "b": [4.0, 5.0, 6.0, 7.0]})
    row = hypothesis.mann_whitney(df, "g", "v").first()
    assert row["statistic"] == 0 and row["exact"] and row["p_value"] == pytest.approx(2 / 35)


def test_large_group_table_takes_the_salted_path(spark, monkeypatch):
    df = groups(spark, {f"g{k:02d}": [float(k * j % 13) for j in range(20)] for k in range(1, 30)})
    expected = hypothesis.levene(df, "g", "v").first()
    boxes = sorted(chartdata.box(df, "v", "g").collect())
    monkeypatch.setattr("millrace.operators.shape.MAX_BROADCAST_ROWS", 3)
    assert hypothesis.levene(df, "g", "v").first() == pytest.approx(expected)
    again = sorted(chartdata.box(df, "v", "g").collect())
    assert [r["group"] for r in again] == [r["group"] for r in boxes]
    for a, b in zip(again, boxes):
        assert tuple(a)[1:] == pytest.approx(tuple(b)[1:])


def test_yates_two_by_two(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "y")], "p string, q string")
    row = hypothesis.chi_square(df, "p", "q").first()
    assert row["dof"] == 1 and row["statistic"] == pytest.approx(0.0)


def test_wilcoxon_needs_pairs(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    with pytest.raises(ValueError, match="no rows with both"):
        hypothesis.wilcoxon(df, "a", "b")


def test_wilcoxon_exact(spark):
    df = spark.createDataFrame([(float(k * k), 0.0) for k in range(1, 6)], "a double, b double")
    row = hypothesis.wilcoxon(df, "a", "b").first()
    assert row["statistic"] == 0 and row["p_value"] == pytest.approx(2 / 32)


def test_outliers(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 100.0])], "i int, x double")
    row = diagnostics.iqr_outliers(df, ["x"]).first()
    assert (row["q1"], row["q3"], row["lower_bound"], row["upper_bound"], row["outlier_count"]) == (2, 4, -1, 7, 1)
    assert [r["x"] for r in diagnostics.first_outliers(df, "x", ["i"]).collect()] == [100.0]


def test_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    with pytest.raises(ValueError, match="no distribution to describe"):
        diagnostics.kolmogorov_smirnov(df, "x")
    with pytest.raises(ValueError, match="no distribution to describe"):
        diagnostics.iqr_outliers(df, ["x"])


def test_column_report(spark, events):
    report = diagnostics.column_report(events, "value", key=["event_id"])
    assert report["moments"].first()["n"] == events.count()
    assert report["shapiro"].first()["n"] == 5000
    assert report["anderson_darling"].count() == 5


def test_shapiro_sample_is_exact_in_size(spark):
    df = spark.range(40_000).select(F.col("id"), F.sin("id").alias("x"))
    rows = {r["column"]: r for r in diagnostics.shapiro(df, ["x", "id"]).collect()}
    assert rows["x"]["n"] == 5000 and rows["id"]["n"] == 5000
    assert 0 < rows["x"]["statistic"] < 1


def test_histogram_counts_everything(spark, events):
    table = chartdata.histogram(events, "value", bins=10).toPandas()
    assert table["count"].sum() == events.count()
    assert (table.density * (table.right - table.left)).sum() == pytest.approx(1)
    one = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert chartdata.histogram(one, "x", bins=5).agg(F.sum("count")).first()[0] == 2


def test_kde_against_brute_force(spark, events):
    values = events.select("value").toPandas().value.to_numpy()
    table = chartdata.violin(events, "value").toPandas()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    h = 1.059 * min(values.std(ddof=1), (q3 - q1) / 1.349) * len(values) ** -0.2
    for point, density in table[["value", "density"]].sample(10, random_state=1).to_numpy():
        exact = np.exp(-0.5 * ((point - values) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
        assert density == pytest.approx(exact, rel=1e-3, abs=1e-8)


def brute_densities(values, table):
    """The exact density at the points of one group's table, and its bandwidth."""
    values = np.asarray(values, float)
    std = values.std(ddof=1) if len(values) > 1 else 0.0
    q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    scale = min((x for x in (std, (q3 - q1) / 1.349) if x > 0), default=0.0)
    h = 1.059 * scale * len(values) ** -0.2 or max(abs(median) * 1e-3, 1e-3)
    at = table.sort_values("value").value.to_numpy()
    assert at[0] == pytest.approx(values.min() - 2 * h) and at[-1] == pytest.approx(values.max() + 2 * h)
    return np.exp(-0.5 * ((at[:, None] - values[None]) / h) ** 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))


def test_densities_do_not_suffer_from_far_values(spark):
    random = np.random.default_rng(3)
    groups = {
        "plain": np.arange(100.0), "far beside": np.append(np.arange(100.0), 1e9), "far": [1e9], "same": [5.0] * 40, "mostly same": [5.0] * 40 + [6.0, -3.0],
        "two": [0.0, 1e6], "tails": random.standard_cauchy(3000), "large": 1e12 + random.normal(0, 1, 2000), "zero": [0.0],
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("plain", math.inf), ("plain", math.nan), (None, 1.0)]
    got = chartdata.violin(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", "g").toPandas()
    assert sorted(got.group.unique()) == sorted(groups) and (got.groupby("group").size() == 100).all()
    for name, values in groups.items():
        table = got[got.group == name]
        exact = brute_densities(values, table)
        assert table.sort_values("value").density.to_numpy() == pytest.approx(exact, rel=1e-3, abs=1e-9 * exact.max()), name


def test_densities_of_many_groups(spark):
    rows = [(g, float((g * 7 + k * k) % 23)) for g in range(3000) for k in range(g % 5 + 1)]
    got = chartdata.violin(spark.createDataFrame(rows, "g int, v double"), "v", "g").toPandas()
    assert len(got) == 300_000
    for g in (0, 1, 4, 2999):
        table = got[got.group == g]
        exact = brute_densities([v for k, v in rows if k == g], table)
        assert table.sort_values("value").density.to_numpy() == pytest.approx(exact, rel=1e-3, abs=1e-9 * exact.max())


def test_chart_arguments(spark, events):
    with pytest.raises(ValueError, match="unknown chart kind"):
        chartdata.build("radar", events)
    with pytest.raises(ValueError, match="needs y"):
        chartdata.build("box", events, x="event_type")
    with pytest.raises(ValueError, match="has no field"):
        chartdata.build("polarbar", events, theta="event_type", r="value", size="value")
    with pytest.raises(ValueError, match="unknown location type"):
        chartdata.build("choropleth", events, locations="event_type", values="value", locationmode="ZIP")
    with pytest.raises(ValueError, match="bins"):
        chartdata.histogram(events, "value", bins=1000)


def test_points_are_sampled_on_request(spark, events):
    assert chartdata.build("scatter", events, x="event_id", y="value").count() == events.count()
    few = chartdata.build("scatter", events, x="event_id", y="value", key=["event_id"], max_points=300)
    assert few.count() == 300 and few.first()["of_rows"] == events.count()
    total = chartdata.build("bar", events, x="event_type").agg(F.sum("height")).first()[0]
    assert total == events.count()


def test_line3d_follows_the_order(spark, events):
    rows = chartdata.build("line3d", events, x="event_id", y="value", z="user_id", order_by=["ts"], key=["event_id"]).collect()
    ids = [r["x"] for r in rows]
    assert len(ids) == events.count() and ids == sorted(ids)


def test_contingency_leaves_out_missing(spark):
    df = pd.DataFrame({"a": ["x", "x", None, "y"], "b": ["p", None, "p", "q"]})
    rows = hypothesis.contingency(spark.createDataFrame(df), "a", "b").collect()
    assert [tuple(r) for r in rows] == [("x", 1, 0), ("y", 0, 1)]
