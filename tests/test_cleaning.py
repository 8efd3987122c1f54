import datetime as dt
from collections import Counter
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import clean, encode, impute, profile, scale
from millrace.plans import preparation


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


def frame(spark, values, kind):
    return spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")


@pytest.mark.parametrize(
    ("kind", "target", "values", "expected"),
    [
        ("string", "INT", ["$1,200.50", "1e5", "1.2.3", "(5)", None], [1200, 15, None, 5, None]),
        ("double", "INT", [22.9, -22.9, None, float("nan")], [22, -22, None, None]),
        ("string", "FLOAT", ["$1,200.50", "abc", "-3"], [1200.5, None, -3.0]),
        ("int", "BOOLEAN", [0, 2, None], [False, True, None]),
        ("double", "BOOLEAN", [0.0, float("nan")], [False, None]),
        ("string", "BOOLEAN", ["YES", "n", None], [True, False, False]),
        ("double", "STRING", [1.5, None], ["1.5", None]),
        ("string", "DATETIME", ["2024-03-01", "03/02/2024", "junk", None],
         [dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 2), None, None]),
        ("bigint", "DATETIME", [1_000, None], [dt.datetime(1970, 1, 1, 0, 0, 0, 1), None]),
    ],
)
def test_convert(spark, kind, target, values, expected):
    assert column(clean.convert(frame(spark, values, kind), "x", target), "x") == expected


@pytest.mark.parametrize(
    ("kind", "values", "expected"),
    [
        ("decimal(38,0)", [-1, 10**19 + 999, 10**22, -(10**37), None],
         [dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2286, 11, 20, 17, 46, 40), None, None, None]),
        ("decimal(20,2)", ["1999.99", "-0.99"], [dt.datetime(1970, 1, 1, 0, 0, 0, 1), dt.datetime(1970, 1, 1)]),
    ],
)
def test_decimal_nanoseconds(spark, kind, values, expected):
    numbers = [None if v is None else Decimal(v) for v in values]
    assert column(clean.convert(frame(spark, numbers, kind), "x", "DATETIME"), "x") == expected


def test_convert_numbers_of_large_keys(spark, tmp_path):
    """Nanoseconds beyond the range of bigint, and dates beyond the year 9999, which Python cannot hold."""
    keys = [0, 1499, 106_751, 106_752, 2_000_000, 5_400_000, None]
    rows = [(k, "x", 3, 1.5, "y") for k in keys]
    columns = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/customer.parquet")
    after = preparation.convert_numbers(spark, str(tmp_path))
    assert after.schema["instant"].dataType.simpleString() == "timestamp_ntz"
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', instant)")
    got = {r[0]: r[1] for r in after.select("c_custkey", micros).collect()}
    assert got == {k: None if k is None else k * 1_000_000_007 * 86_400 // 1000 for k in keys}


def day(text):
    return dt.datetime.fromisoformat(text) if text else None


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        (["13/04/2021", "25/12/2020", "03/04/2021"], ["2021-04-13", "2020-12-25", "2021-04-03"]),
        (["04/13/2021", "12/25/2020", "03/04/2021"], ["2021-04-13", "2020-12-25", "2021-03-04"]),
        # the column's winner decides what fits both; the rest falls through
        (["13/04/2021", "14/04/2021", "04/15/2021", "03/04/2021"], ["2021-04-13", "2021-04-14", "2021-04-15", "2021-04-03"]),
        (["03/04/2021", "04/05/2021"], ["2021-03-04", "2021-04-05"]),
        (["13.4.2021 9:05", "3.4.2021", "2021-05-01", None, ""], ["2021-04-13T09:05", "2021-04-03", "2021-05-01", None, None]),
        (["1-2-2021", "31-1-2021", "30/02/2021", "x"], ["2021-02-01", "2021-01-31", None, None]),
        (["1 Mar 2021", "Mar 2, 2021 10:00:01", "20210303"], ["2021-03-01", "2021-03-02T10:00:01", "2021-03-03"]),
        ([None, None], [None, None]),
    ],
)
def test_date_formats_are_voted_on(spark, values, expected):
    assert column(clean.convert(frame(spark, values, "string"), "x", "DATETIME"), "x") == [day(x) for x in expected]


def test_given_date_formats_are_not_voted_on(spark):
    got = clean.convert(frame(spark, ["13/04/2021", "25/12/2020", "03/04/2021"], "string"), "x", "DATETIME", ["M/d/yyyy", "d/M/yyyy"])
    assert column(got, "x") == [day(x) for x in ["2021-04-13", "2020-12-25", "2021-03-04"]]


def test_convert_rejects_unknown_type(spark):
    with pytest.raises(ValueError, match="unknown target type"):
        clean.convert(frame(spark, [1], "int"), "x", "DECIMAL")


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, None), (None, None)], "k string, v int")
    assert clean.duplicate_count(df).first()[0] == 4
    once = clean.drop_duplicates(df)
    assert once.count() == 3
    assert clean.duplicate_count(once).first()[0] == 0


def test_schema_changes(spark):
    before = frame(spark, ["1"], "string")
    changes = clean.schema_changes(before, clean.convert(before, "x", "INT")).collect()
    assert [(r["column"], r["before"], r["after"], r["changed"]) for r in changes] == [
        ("i", "int", "int", False), ("x", "string", "bigint", True),
    ]


@pytest.mark.parametrize(
    ("method", "values", "expected"),
    [
        ("ffill", [None, 1.0, None, 3.0, None], [None, 1.0, 1.0, 3.0, 3.0]),
        ("bfill", [None, 1.0, None, 3.0, None], [1.0, 1.0, 3.0, 3.0, None]),
        ("nearest_neighbor", [None, 5.0, None, None, 9.0], [5.0, 5.0, 5.0, 9.0, 9.0]),
        ("interpolate", [None, 1.0, None, None, 4.0, None], [None, 1.0, 2.0, 3.0, 4.0, None]),
        ("mean", [1.0, None, 3.0], [1.0, 2.0, 3.0]),
        ("median", [1.0, None, 2.0, 10.0], [1.0, 2.0, 2.0, 10.0]),
        ("distribution", [5.0, None, None, 5.0], [5.0, 5.0, 5.0, 5.0]),
        ("mean", [None, None], [None, None]),
        ("ffill", [None, None], [None, None]),
    ],
)
def test_impute(spark, method, values, expected):
    filled = impute.impute(frame(spark, values, "double"), "x", method, order_by=["i"])
    assert column(filled, "x") == expected


def test_nearest_first(spark):
    df = frame(spark, [None, 5.0, None, 9.0], "double")
    filled = impute.impute(df, "x", "nearest_neighbor", order_by=["i"], nearest="first")
    assert column(filled, "x") == [5.0, 5.0, 5.0, 9.0]


def test_distribution_stays_above_zero_and_repeats(spark):
    df = spark.range(2000).select(F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, F.col("id") % 7 - 3.0).alias("x"))
    first = column(impute.impute(df, "x", "distribution", key=["i"]), "x")
    again = column(impute.impute(df.repartition(13), "x", "distribution", key=["i"]), "x")
    assert first == again
    assert min(first[1::2]) >= 0


def test_impute_errors(spark):
    df = frame(spark, [1.0, None], "double")
    with pytest.raises(ValueError, match="replacement value"):
        impute.impute(df, "x", "specific_value")
    with pytest.raises(ValueError, match="order_by"):
        impute.impute(df, "x", "ffill")
    with pytest.raises(ValueError, match="unknown imputation"):
        impute.impute(df, "x", "guess")


def test_label_keeps_numeric_order(spark):
    assert column(encode.encode(frame(spark, [10, 2, 10, None], "int"), ["x"], "label"), "x") == [1, 0, 1, 2]


def test_ordinal_keeps_missing_numbers(spark):
    assert column(encode.encode(frame(spark, [10.0, None, 2.0], "double"), ["x"], "ordinal"), "x") == [1.0, None, 0.0]


def test_label_names_missing_text(spark):
    assert column(encode.encode(frame(spark, ["z", None, "a"], "string"), ["x"], "label"), "x") == [2, 1, 0]


@pytest.mark.parametrize("method", ["label", "ordinal"])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_large_dictionaries_give_the_same_codes(spark, monkeypatch, method, kind):
    values = [None, *range(40), *[7] * 60]
    df = frame(spark, values, "int").withColumn("x", F.col("x").cast(kind))
    expected = column(encode.encode(df, ["x"], method), "x")
    monkeypatch.setattr("millrace.operators.shape.MAX_BROADCAST_ROWS", 5)
    monkeypatch.setattr(encode, "HOT_VALUES", 3)
    assert column(encode.encode(df, ["x"], method), "x") == expected


@pytest.mark.parametrize("limit", [20_000, 1])
def test_columns_named_like_the_code_table(spark, monkeypatch, limit):
    monkeypatch.setattr("millrace.operators.shape.MAX_BROADCAST_ROWS", limit)
    df = spark.createDataFrame([("b", 1, 2), ("a", 3, 4)], "value string, code int, `x.y` int")
    rows = encode.encode(df, ["value"], "label").orderBy("value").collect()
    assert [tuple(r) for r in rows] == [(0, 3, 4), (1, 1, 2)]


def test_onehot(spark):
    df = spark.createDataFrame([(0, "x", 1), (1, None, 2), (2, "y", 3)], "i int, k string, n int")
    made = encode.encode(df, ["k"], "onehot").orderBy("i")
    assert made.columns == ["i", "n", "k_x", "k_y"]
    assert [tuple(r)[2:] for r in made.collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 1.0)]


def test_onehot_names_and_limit(spark):
    assert encode.encode(frame(spark, [0.0, 2.0], "double"), ["x"], "onehot").columns == ["i", "x_0.0", "x_2.0"]
    with pytest.raises(ValueError, match="more than 1 categories"):
        encode.encode(frame(spark, [0.0, 2.0], "double"), ["x"], "onehot", max_categories=1)


def test_unknown_category_gives_zeros(spark):
    steps = encode.fit(frame(spark, ["a", "b"], "string"), ["x"], "onehot")
    assert tuple(steps.transform(frame(spark, ["c"], "string")).first()) == (0, 0.0, 0.0)


def test_encode_errors(spark):
    df = frame(spark, [1], "int")
    with pytest.raises(ValueError, match="at least one"):
        encode.encode(df, [], "label")
    with pytest.raises(ValueError, match="unknown encoding"):
        encode.encode(df, ["x"], "hash")


@pytest.mark.parametrize(("method", "value"), [("minmax", 0.0), ("standard", 0.0), ("robust", 0.0), ("maxabs", 1.0)])
def test_constant_column_scaling(spark, method, value):
    assert column(scale.scale(frame(spark, [3.0] * 3, "double"), ["x"], method), "x") == [value] * 3


def test_scaling_keeps_missing(spark):
    assert column(scale.scale(frame(spark, [1.0, None, 3.0], "double"), ["x"], "minmax"), "x") == [0.0, None, 1.0]


def test_log_of_impossible_values(spark):
    assert column(scale.scale(frame(spark, [-1.0, -2.0, 0.0], "double"), ["x"], "log"), "x") == [None, None, 0.0]


def test_boxcox_needs_positive_values(spark):
    with pytest.raises(ValueError, match="positive"):
        scale.scale(frame(spark, [-1.0, 2.0], "double"), ["x"], "boxcox")


@pytest.mark.parametrize("method", ["standard", "boxcox", "yeojohnson"])
def test_standardised_output(spark, events, method):
    values = events.select((F.col("value") + 1).alias("x"))
    row = scale.scale(values, ["x"], method).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(row[0]) < 1e-9
    assert abs(row[1] - 1) < 1e-9


def test_power_of_constant_column(spark):
    assert column(scale.scale(frame(spark, [3.0] * 3, "double"), ["x"], "yeojohnson"), "x") == [0.0] * 3


def test_quantile_output_is_uniform(spark, events):
    row = scale.scale(events.select("value"), ["value"], "quantile").agg(F.min("value"), F.avg("value"), F.max("value")).first()
    assert row[0] == 0 and row[2] == 1
    assert abs(row[1] - 0.5) < 1e-3


def test_constant_column_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    r = {(x["x"], x["y"]): x["r"] for x in profile.correlation(df).collect()}
    assert r[("a", "b")] is None and r[("b", "b")] is None and abs(r[("a", "a")] - 1) < 1e-12


def test_correlation_uses_complete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 9.0), (3.0, 6.0)], "a double, b double")
    r = {(x["x"], x["y"]): x["r"] for x in profile.correlation(df).collect()}
    assert abs(r[("a", "b")] - 1) < 1e-12


def test_profile_of_odd_names_and_nan(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), None)], ["a.b c", "t"])
    row = profile.describe_numeric(df).first()
    assert (row["column"], row["count"], row["mean"]) == ("a.b c", 1, 1.0)
    assert {r["column"]: r["missing"] for r in profile.missing_summary(df).collect()} == {"a.b c": 1, "t": 1}
    assert set(profile.preview(df)) == {"shape", "dtypes", "missing", "head", "numeric", "categorical"}


def test_empty_column_is_left_out_of_shape_table(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert [r["column"] for r in profile.skew_kurtosis(df).collect()] == ["b"]


def test_correlation_of_a_wide_gappy_table(spark):
    random = np.random.default_rng(8)
    base = random.normal(0, 1, (900, 5))
    data = base @ random.normal(0, 1, (5, 100)) + random.normal(0, 1, (900, 100))
    data = data * 10.0 ** random.integers(-3, 6, 100) + 10.0 ** random.integers(0, 10, 100)
    data[random.random(data.shape) < 0.2] = np.nan
    data[:, 7] = 3.0
    data[:, 8] = np.nan
    data[5:, 9] = np.nan
    pdf = pd.DataFrame(data, columns=[f"c {i}" for i in range(100)])
    found = profile.correlation(spark.createDataFrame(pdf).repartition(7))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = {(r["x"], r["y"]): r["r"] for r in found.collect()}
    assert len(rows) == 10_000
    with np.errstate(all="ignore"):
        want = (pdf - pdf.mean()).corr(min_periods=2)
    for (a, b), r in rows.items():
        w = want.loc[a, b]
        if "c 7" in (a, b) or np.isnan(w):
            assert r is None or "c 9" in (a, b)
        else:
            assert r == pytest.approx(w, abs=1e-6), (a, b)


def test_correlation_far_from_zero(spark):
    """Values that differ only behind their tenth digit, in parts of very different level."""
    random = np.random.default_rng(9)
    x = random.normal(0, 1, 4000)
    pdf = pd.DataFrame({"x": 1e10 + x, "y": -1e10 + 0.5 * x + random.normal(0, 1, 4000), "z": np.where(np.arange(4000) < 2000, 0.0, 1e6) + x})
    r = {(q["x"], q["y"]): q["r"] for q in profile.correlation(spark.createDataFrame(pdf).repartition(9)).collect()}
    want = (pdf - pdf.mean()).corr()
    for a, b in r:
        assert r[a, b] == pytest.approx(want.loc[a, b], abs=1e-5 if {a, b} != {"z"} else 1e-9)


def wide_rows(spark):
    rows = [(i % 40, "x" * 2000 + str(i % 40), [i % 2], float("nan") if i % 4 else -0.0) for i in range(60)] + [(100 + i, f"single {i}", None, None) for i in range(300)]
    rows += [(500, None, None, 0.0), (500, None, None, -0.0)]
    return spark.createDataFrame(rows, "a int, `t.x` string, l array<int>, d double").repartition(6), rows


@pytest.mark.parametrize("case", ["digests", "clash", "too many"])
def test_duplicates_of_wide_rows(spark, monkeypatch, case):
    df, rows = wide_rows(spark)
    same = lambda r: (r[0], r[1], str(r[2]), None if r[3] is None else str(r[3] + 0.0))
    groups = Counter(map(same, rows))
    if case == "clash":
        monkeypatch.setattr(clean, "_digested", lambda df: df.withColumns({"_digest0": F.lit(1).cast("long"), "_digest1": F.col("a").cast("long") % 3}))
    if case == "too many":
        monkeypatch.setattr(clean, "MAX_DIGESTS", 5)
    assert clean.duplicate_count(df).first()[0] == sum(n for n in groups.values() if n > 1)
    kept = clean.drop_duplicates(df)
    assert kept.columns == df.columns and Counter(same(tuple(r)) for r in kept.collect()) == Counter(groups.keys())


def test_only_digests_of_single_rows_are_shuffled(spark):
    df, _ = wide_rows(spark)
    plan = clean.drop_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    single = plan[plan.index("Union") :]
    assert "BroadcastHashJoin" in single and plan.count("SortMergeJoin") == 0
    assert clean.drop_duplicates(df.limit(0)).count() == 0 and clean.duplicate_count(df.limit(0)).first()[0] == 0
