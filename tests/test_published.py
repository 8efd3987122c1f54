"""Known numbers: computed from the textbook formulas, or of well-known data, not by this library."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import diagnostics, hypothesis, models, power, profile, scale

#: Sepal lengths of the iris flowers as value and count. Fixed values.
SEPALS = [
    (4.3, 1), (4.4, 3), (4.5, 1), (4.6, 4), (4.7, 2), (4.8, 5), (4.9, 6), (5.0, 10), (5.1, 9), (5.2, 4), (5.3, 1), (5.4, 6),
    (5.5, 7), (5.6, 6), (5.7, 8), (5.8, 7), (5.9, 3), (6.0, 6), (6.1, 6), (6.2, 4), (6.3, 9), (6.4, 7), (6.5, 5), (6.6, 2),
    (6.7, 8), (6.8, 3), (6.9, 4), (7.0, 1), (7.1, 1), (7.2, 3), (7.3, 1), (7.4, 1), (7.6, 1), (7.7, 4), (7.9, 1),
]
#: Rows per age group for four sites. Fixed values.
SITES = {"18-25": [48, 109, 122, 40], "26-35": [118, 110, 41, 83], "36-45": [105, 29, 16, 79], "45+": [56, 8, 7, 29]}


@pytest.fixture(scope="module")
def sepals(spark):
    return spark.createDataFrame([(v,) for v, n in SEPALS for _ in range(n)], "x double").repartition(4)


def test_sepals_in_every_diagnostic(sepals):
    row = diagnostics.diagnostics_all(sepals, ["x"]).first()
    assert (row["n"], row["outliers"], row["q1"], row["q3"]) == (150, 0, 5.1, 6.4)
    want = {"mean": 5.843333, "std": 0.828066, "skewness": 0.311753, "kurtosis": -0.573568, "ks": 0.088654, "anderson": 0.889199}
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-6), name
    assert diagnostics.kolmogorov_smirnov(sepals, "x").first()["statistic"] == pytest.approx(0.088654, abs=1e-6)
    assert diagnostics.anderson_darling(sepals, "x").first()["statistic"] == pytest.approx(0.889199, abs=1e-6)
    assert diagnostics.shapiro(sepals, ["x"]).first()["statistic"] == pytest.approx(0.97609, abs=1e-5)
    assert profile.skew_kurtosis(sepals, ["x"]).first()["skewness"] == pytest.approx(0.311753, abs=1e-6)


def test_power_parameters(spark, sepals, events):
    customer = spark.read.parquet("/root/testdata/sf0.01/customer.parquet")
    assert power.boxcox_lambda(sepals, "x") == pytest.approx(-0.14475, abs=2e-5)
    assert power.yeojohnson_lambda(sepals, "x") == pytest.approx(-0.32122, abs=2e-5)
    assert power.boxcox_lambda(events, "value") == pytest.approx(0.26677, abs=2e-5)
    assert power.yeojohnson_lambda(events, "value") == pytest.approx(0.20980, abs=2e-5)
    assert power.yeojohnson_lambda(customer, "c_acctbal") == pytest.approx(0.91253, abs=2e-5)
    with pytest.raises(ValueError):
        scale.scale(customer, ["c_acctbal"], "boxcox")


def test_ages_and_sites(spark):
    rows = [(age, site) for age, counts in SITES.items() for site, n in enumerate(counts) for _ in range(n)]
    df = spark.createDataFrame(rows, "age string, site int").withColumn("site", F.col("site").cast("string"))
    result = hypothesis.run(df, "chisquare", "age", "site")["result"].first()
    assert result["statistic"] == pytest.approx(228.790686, abs=1e-6) and result["dof"] == 9


def test_small_groups_by_hand(spark):
    """Ranks 1 to 9 in three groups of three: H = 12 / (9 * 10) * (6² + 15² + 24²) / 3 - 3 * 10 = 7.2; U of two groups of three is 0."""
    df = spark.createDataFrame([(g, 10.0 * i + g * 100) for g in range(3) for i in range(3)], "g int, v double")
    row = hypothesis.kruskal(df, "g", "v").first()
    assert row["statistic"] == pytest.approx(7.2) and row["dof"] == 2
    assert hypothesis.mann_whitney(df.where("g < 2"), "g", "v").first()["statistic"] in (0.0, 9.0)
    # F = between / within: means 110, 210 and 310 less 100 each; 3 * 2 * 100² / 2 over 100.
    assert hypothesis.run(df, "anova", "g", "v")["result"].first()["statistic"] == pytest.approx(300.0)


def test_nearest_of_given_centres(spark):
    df = spark.createDataFrame([(0.0, 0.0), (9.0, 1.0), (5.0, 0.0), (None, 1.0)], "a double, b double")
    rows = models.nearest_centres(df, ["a", "b"], [(0.0, 0.0), (10.0, 0.0)]).orderBy("a").collect()
    assert [(r["cluster"], r["distance"]) for r in rows] == [(None, None), (0, 0.0), (0, 25.0), (1, 2.0)]
