import json

import pytest

from millrace.operators import encode, impute, scale
from millrace.sources import delimited, stages
from millrace.streaming.steps import apply_steps


def write(path, text):
    path.write_text(text)
    return str(path)


def test_types_and_missing_tokens(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        ',n,f,m,t,ok,e,x,x\n1,7,1.5,NA,red,True,,1,2\n2,-8,2e3,4,"a, ""b""",False,,1,2\n3,9,.5,5,null,TRUE,nan,1,2\n',
    )
    df = delimited.load_csv(spark, path)
    assert df.dtypes == [
        ("Unnamed: 0", "bigint"), ("n", "bigint"), ("f", "double"), ("m", "double"), ("t", "string"),
        ("ok", "boolean"), ("e", "double"), ("x", "bigint"), ("x.1", "bigint"),
    ]
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == (1, 7, 1.5, None, "red", True, None, 1, 2)
    assert rows[1][4] == 'a, "b"'
    assert rows[2][4] is None


def test_blank_header(spark, tmp_path):
    df = delimited.load_csv(spark, write(tmp_path / "b.csv", ",,\n1,2,x\n3,4,y\n"))
    assert df.columns == ["column_0", "column_1", "column_2"]
    assert [tuple(r) for r in df.collect()] == [(None, None, None), (1.0, 2.0, "x"), (3.0, 4.0, "y")]


def test_single_letter_header(spark, tmp_path):
    path = write(tmp_path / "c.csv", "A,B\nname,size\nfoo,1\nname,size\nbar,2\n")
    df = delimited.load_csv(spark, path, repair_header=True)
    assert df.columns == ["name", "size"]
    assert sorted(r["name"] for r in df.collect()) == ["bar", "foo", "name"]
    assert delimited.load_csv(spark, path).columns == ["A", "B"]


def test_odd_headers(spark, tmp_path):
    one = delimited.load_csv(spark, write(tmp_path / "d.csv", "x\n5\n7\n"))
    assert one.columns == ["x"] and [r[0] for r in one.collect()] == [5, 7]
    blank = delimited.load_csv(spark, write(tmp_path / "e.csv", "\n\na,b\n1,2\n"))
    assert blank.columns == ["a", "b"] and [tuple(r) for r in blank.collect()] == [(1, 2)]
    broken = delimited.load_csv(spark, write(tmp_path / "f.csv", '"a","b\nc",d\n1,2,3\n'), multiline=True)
    assert broken.columns == ["a", "b\nc", "d"] and [tuple(r) for r in broken.collect()] == [(1, 2, 3)]
    assert delimited.header_names(["A", "a", "a.1", "", "A"]) == ["A", "a.1", "a.1.1", "Unnamed: 3", "A.2"]
    twice = delimited.load_csv(spark, write(tmp_path / "g.csv", "A,a\n1,2\n"))
    assert [tuple(r) for r in twice.collect()] == [(1, 2)]


def test_json_rows(spark):
    df = spark.createDataFrame([(1, float("nan"), float("inf"), None)], "a int, b double, c double, d string")
    assert json.loads(delimited.json_rows(df).first()[0]) == {"a": 1, "b": None, "c": None, "d": None}


def test_csv_and_json_files(spark, small, tmp_path):
    nations = spark.read.parquet(f"{small}/nation.parquet")
    delimited.save_csv(nations, str(tmp_path / "csv"))
    back = delimited.load_csv(spark, str(tmp_path / "csv"))
    assert back.exceptAll(nations.selectExpr(*[f"cast({c} as {t}) {c}" for c, t in back.dtypes])).count() == 0
    delimited.save_json(nations, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 25


def test_stages(spark):
    stages.put("df_cleaned", spark.range(3))
    assert stages.get(spark, "df_cleaned").count() == 3
    assert "df_cleaned" in stages.names(spark)
    with pytest.raises(KeyError, match="no table loaded"):
        stages.get(spark, "df_absent")


def test_fitted_steps_run_on_a_stream(spark, small, tmp_path):
    customer = spark.read.parquet(f"{small}/customer.parquet")
    gaps = customer.selectExpr("c_custkey", "if(c_custkey % 7 = 0, null, c_acctbal) c_acctbal", "c_mktsegment", "c_nationkey")
    steps = [impute.fit(gaps, "c_acctbal", "median")]
    filled = apply_steps(gaps, steps)
    steps.append(scale.fit(filled, ["c_acctbal"], "standard"))
    steps.append(encode.fit(gaps, ["c_mktsegment"], "onehot"))
    steps.append(encode.fit(gaps, ["c_nationkey"], "label"))
    steps.append(scale.fit(filled, ["c_nationkey"], "quantile"))
    expected = apply_steps(gaps, steps)
    gaps.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(gaps.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        apply_steps(stream, steps).writeStream.format("memory").queryName("prepared")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    made = spark.table("prepared")
    assert made.count() == customer.count()
    assert made.exceptAll(expected).count() == 0
