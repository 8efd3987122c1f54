"""One time series: pattern, validation, resampling, lag features, forecast.

A series is a table (ds, y, position). Neighbouring rows are found by position:
rows are cut into blocks, and the last rows of a block are copied into the next
one, so no window ever runs over the whole series in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.columns import is_numeric, micros, missing_as_null, number, require_columns, require_numeric
from millrace.operators.clean import converted
from millrace.operators.rank import ranked, with_order_bucket, with_position
from millrace.operators.shape import few_tasks
from millrace.session import materialise, shared_folder

FREQUENCIES = [None, "D", "W", "M", "Q", "Y"]
AGGREGATES = ["mean", "sum", "max", "min", "first", "last"]
LAGS = 5
FILL_LIMIT = 2
TRAIN_SHARE = 0.8
LEAST_ROWS = 30
MAX_HORIZON = 365
BAND = 0.1
BLOCK = 100_000
DAY = 86400.0
#: The deepest tree that can be fitted.
MAX_DEPTH = 30

# Median distance in seconds below which a frequency has its name and code.
FREQUENCY_LIMITS = [
    (60, "seconds", "S"), (3600, "minutes", "T"), (DAY, "hours", "H"), (7 * DAY, "days", "D"), (31 * DAY, "weeks", "W"), (365 * DAY, "months", "M"),
]

# Model settings.
TREES = {
    "maxIter": 200,
    "maxDepth": 5,
    "stepSize": 0.05,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "lossType": "squared",
    "seed": 42,
}


# ---------------------------------------------------------------- pattern and validation


def _dates(df: DataFrame, date_column: str) -> DataFrame:
    """Distinct dates with the number of rows on each."""
    rows = df.select(converted(df, date_column, "DATETIME").alias("ds")).where("ds is not null")
    return rows.groupBy("ds").agg(F.count("*").alias("cnt"))


def gaps(df: DataFrame, date_column: str) -> DataFrame:
    """Seconds between consecutive rows in date order, with how often each gap occurs."""
    dates = materialise(_dates(df, date_column))
    bucketed = with_order_bucket(dates, ["ds"]).withColumn("at", micros(F.col("ds")))
    last = bucketed.groupBy("_bucket").agg(F.max("at").alias("_last"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_bucket", F.max("_last").over(earlier).alias("_carry"))
    inside = Window.partitionBy("_bucket").orderBy("at")
    before = F.coalesce(F.col("_previous"), F.col("_carry"))
    between = (
        bucketed.withColumn("_previous", F.lag("at").over(inside))
        .join(F.broadcast(carried), "_bucket")
        .select(((F.col("at") - before) / 1e6).alias("gap"), F.lit(1).cast("bigint").alias("times"))
    )
    # rows that share a date follow each other at distance zero
    same = dates.agg(F.lit(0.0).alias("gap"), F.sum(F.col("cnt") - 1).alias("times")).where("times > 0")
    return between.where("gap is not null").unionByName(same).groupBy("gap").agg(F.sum("times").alias("times"))


def _gap_numbers(df: DataFrame, date_column: str) -> Row:
    # several numbers are read off the gap counts: compute them once
    table = materialise(gaps(df, date_column))
    places = ranked(table, F.col("gap"), weight=F.col("times"))
    end = F.col("before") + F.col("ties")
    at = lambda rank: F.max(F.when((rank >= F.col("before")) & (rank < end), F.col("value")))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    mean = table.agg((F.sum(F.col("gap") * F.col("times")) / F.sum("times")).alias("mean"))
    away = F.col("times") * F.pow(F.col("gap") - F.col("mean"), F.lit(2.0))
    spread = table.crossJoin(F.broadcast(mean)).agg(
        F.sum("times").alias("gaps"),
        F.min("gap").alias("shortest"),
        F.min(F.struct((-F.col("times")).alias("minus"), "gap")).getField("gap").alias("common"),
        F.sqrt(F.sum(away) / F.nullif(F.sum("times") - 1, F.lit(0))).alias("std"),
    )
    middle = places.agg(((at(low) + at(high)) / 2).alias("median"))
    irregular = table.join(F.broadcast(spread.select("common"))).agg(
        F.sum(F.when(F.col("gap") != F.col("common"), F.col("times")).otherwise(0)).alias("irregular")
    )
    return spread.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(irregular)).first()


def pattern(df: DataFrame, date_column: str) -> DataFrame:
    """Frequency, intervals in seconds, duplicates and regularity of a date column."""
    require_columns(df, date_column)
    sizes = _dates(df, date_column).agg(
        F.sum("cnt").alias("rows"), F.count("*").alias("distinct"), F.max("cnt").alias("most")
    ).first()
    row = _gap_numbers(df, date_column) if (sizes["rows"] or 0) > 1 else None
    median = row["median"] if row else None
    name, code = _frequency(median)
    regular = bool(median) and row["std"] is not None and row["std"] / median < 0.1
    return df.sparkSession.createDataFrame(
        [
            (
                name, code, row["shortest"] if row else None, median, (sizes["most"] or 0) > 1,
                sizes["distinct"], sizes["rows"] or 0, regular,
            )
        ],
        "frequency string, freq_code string, min_interval double, median_interval double, has_duplicates boolean, "
        "unique_dates bigint, total_records bigint, regular_intervals boolean",
    )


def _frequency(median: float | None) -> tuple[str | None, str | None]:
    if median is None:
        return None, None
    for limit, name, code in FREQUENCY_LIMITS:
        if median < limit:
            return name, code
    return "years", "Y"


def validate(df: DataFrame, date_column: str, target: str) -> DataFrame:
    """Problems that keep a table from being a series; no rows means none.

    Too few rows end the check; irregular gaps are a warning above 5 % and an error above 20 %.
    """
    found: list[tuple[str, str, float]] = []
    absent = [c for c in (date_column, target) if c not in df.columns]
    if absent:
        found.append(("date column not found" if absent[0] == date_column else "target column not found", "error", 1.0))
        return _findings(df, found)
    raw, parsed = missing_as_null(df, date_column), converted(df, date_column, "DATETIME")
    row = df.agg(
        F.count("*").alias("rows"),
        F.count_if(raw.isNull()).alias("no_date"),
        F.count_if(raw.isNotNull() & parsed.isNull()).alias("bad_date"),
        F.count_if(missing_as_null(df, target).isNull()).alias("no_target"),
    ).first()
    if row["bad_date"]:
        return _findings(df, [("dates cannot be read", "error", float(row["bad_date"]))])
    if not is_numeric(df, target):
        found.append(("target is not numeric", "error", 1.0))
    if row["no_date"]:
        found.append(("missing dates", "error", float(row["no_date"])))
    if row["no_target"]:
        found.append(("missing target values", "error", float(row["no_target"])))
    if row["rows"] < LEAST_ROWS:
        found.append((f"fewer than {LEAST_ROWS} rows", "error", float(row["rows"])))
        return _findings(df, found)
    shared = _dates(df, date_column).agg(F.sum(F.when(F.col("cnt") > 1, F.col("cnt")).otherwise(0))).first()[0]
    if shared:
        found.append(("duplicate dates", "error", float(shared)))
    numbers = _gap_numbers(df, date_column)
    percent = 100.0 * numbers["irregular"] / numbers["gaps"] if numbers["gaps"] else 0.0
    if percent > 5:
        found.append(("irregular intervals in percent", "error" if percent > 20 else "warning", percent))
    return _findings(df, found)


def _findings(df: DataFrame, found: list[tuple[str, str, float]]) -> DataFrame:
    return df.sparkSession.createDataFrame(found, "check string, level string, value double")


# ---------------------------------------------------------------- series


def period_end(ds: Column, freq: str) -> Column:
    """Last day of the period; weeks end on Sunday."""
    day = ds.cast("date")
    return {
        "D": lambda: day,
        "W": lambda: F.date_add(day, 6 - F.weekday(day)),
        "M": lambda: F.last_day(day),
        "Q": lambda: F.last_day(F.add_months(F.trunc(day, "quarter"), 2)),
        "Y": lambda: F.last_day(F.add_months(F.trunc(day, "year"), 11)),
    }[freq]()


def step_forward(start: Column, steps: Column, freq: str | None) -> Column:
    """The date a number of periods later; without a frequency a period is a day."""
    if freq in (None, "D", "W"):
        days = steps * (7 if freq == "W" else 1)
        return (start + F.make_dt_interval(days.cast("int"))).cast("timestamp_ntz")
    months = steps * {"M": 1, "Q": 3, "Y": 12}[freq]
    return F.last_day(F.add_months(start.cast("date"), months.cast("int"))).cast("timestamp_ntz")


def last_per_date(df: DataFrame, date_column: str, target: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """One row (ds, y) per date: the last one along ``order_by``, else the one with the largest value."""
    require_columns(df, date_column)
    require_numeric(df, target)
    keys = [missing_as_null(df, c) for c in order_by or [target]]
    rows = df.select(
        converted(df, date_column, "DATETIME").alias("ds"),
        number(df, target).alias("y"),
        # a single key keeps this a hash aggregate; a struct would make it sort all rows
        (keys[0] if len(keys) == 1 else F.struct(*keys)).alias("o"),
    )
    return rows.where("ds is not null").groupBy("ds").agg(F.max_by("y", "o").alias("y"))


def resample(series: DataFrame, freq: str, agg: str = "mean") -> DataFrame:
    """One row per period between the first and the last one; empty periods have no value, or 0 when summing."""
    if freq not in FREQUENCIES[1:]:
        raise ValueError(f"unknown frequency: {freq}")
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {agg}")
    known = F.when(F.col("y").isNotNull(), F.col("ds"))
    value = {
        "mean": lambda: F.avg("y"),
        "sum": lambda: F.sum("y"),
        "max": lambda: F.max("y"),
        "min": lambda: F.min("y"),
        "first": lambda: F.min_by("y", known),
        "last": lambda: F.max_by("y", known),
    }[agg]()
    periods = series.groupBy(period_end(F.col("ds"), freq).alias("period")).agg(value.alias("y"))
    ends = series.agg(
        period_end(F.min("ds"), freq).alias("first"), period_end(F.max("ds"), freq).alias("last")
    ).where("first is not null")
    if freq in ("D", "W"):
        step = "interval 1 day" if freq == "D" else "interval 7 days"
        every = F.explode(F.sequence("first", "last", F.expr(step)))
        calendar = ends.select(every.alias("period"))
    else:
        months = {"M": 1, "Q": 3, "Y": 12}[freq]
        starts = F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr(f"interval {months} months"))
        calendar = ends.select(F.explode(starts).alias("start")).select(F.last_day("start").alias("period"))
    y = F.coalesce("y", F.lit(0.0)) if agg == "sum" else F.col("y")
    return calendar.join(periods, "period", "left").select(F.col("period").cast("timestamp_ntz").alias("ds"), y.alias("y"))


def with_earlier_rows(numbered: DataFrame, reach: int) -> tuple[DataFrame, Window]:
    """Cut a numbered table into blocks that also hold the ``reach`` rows before them, marked ``_copy``.

    Gives the table and a window along the rows of a block.
    """
    block = F.floor(F.col("position") / BLOCK)
    edge = F.pmod(F.col("position"), F.lit(BLOCK)) >= BLOCK - reach
    here = F.struct(block.alias("_block"), F.lit(False).alias("_copy"))
    there = F.struct((block + 1).alias("_block"), F.lit(True).alias("_copy"))
    spread = numbered.withColumn("_at", F.explode(F.when(edge, F.array(here, there)).otherwise(F.array(here))))
    return spread.select(*numbered.columns, "_at.*"), Window.partitionBy("_block").orderBy("position")


def prepare(
    df: DataFrame,
    date_column: str,
    target: str,
    freq: str | None = None,
    agg: str = "mean",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """The series (ds, y, position, is_train): one row per date or period, short gaps filled forward.

    At most two missing values in a row are filled, the rest is left out. The
    first 80 % of the rows are for training.
    """
    series = last_per_date(df, date_column, target, order_by)
    if freq is not None:
        series = resample(series, freq, agg)
    numbered = with_position(materialise(series), ["ds"])
    spread, along = with_earlier_rows(numbered, FILL_LIMIT)
    filled = F.last("y", ignorenulls=True).over(along.rowsBetween(-FILL_LIMIT, 0))
    kept = spread.withColumn("y", filled).where("not _copy and y is not null").select("ds", "y")
    kept = materialise(kept)
    final = with_position(kept, ["ds"])
    size = kept.agg(F.floor(F.count("*") * TRAIN_SHARE).alias("_train"))
    return final.crossJoin(F.broadcast(size)).select("ds", "y", "position", (F.col("position") < F.col("_train")).alias("is_train"))


def lag_features(series: DataFrame, steps: int = LAGS) -> DataFrame:
    """Each value with the ``steps`` values before it, oldest first; rows without all of them are left out.

    Training and test rows do not look into each other.
    """
    spread, along = with_earlier_rows(series, steps)
    lags = {f"lag{k}": F.lag("y", k).over(along) for k in range(steps, 0, -1)}
    first = F.lag("is_train", steps).over(along)
    table = spread.withColumns({**lags, "_first": first}).where("not _copy")
    return table.where(F.col("_first") == F.col("is_train")).select("ds", "position", "is_train", *lags, "y")


# ---------------------------------------------------------------- forecast


@dataclass(frozen=True)
class Forecast:
    history: DataFrame
    predictions: DataFrame


#: A table of trees: one row per node, the root being node 0; a leaf has left -1, and values up to ``threshold`` go left.
NODES = "tree int, weight double, node int, left int, right int, feature int, threshold double, value double"


def tree_nodes(model: GBTRegressionModel) -> DataFrame:
    """The trees of a fitted model as a table of NODES, from what the model writes into the shared folder."""
    spark = SparkSession.active()
    folder = f"{shared_folder(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.save(folder)
    weights = F.create_map(*[F.lit(x) for i, w in enumerate(model.treeWeights) for x in (i, float(w))])
    node = F.col("nodeData")
    return spark.read.parquet(f"{folder}/data").select(
        F.col("treeID").alias("tree"), F.element_at(weights, F.col("treeID")).alias("weight"), node["id"].alias("node"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), node["prediction"].alias("value"),
    )


def forest(nodes: DataFrame) -> DataFrame:
    """One row: ``trees``, an array of trees with their weight and their nodes in order. At most a few hundred small trees."""
    fields = F.struct("left", "right", "feature", "threshold", "value")
    each = nodes.groupBy("tree").agg(F.first("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("node", fields.alias("n")))).alias("nodes"))
    tree = F.struct("tree", "weight", F.transform("nodes", lambda x: x["n"]).alias("nodes"))
    return each.agg(F.array_sort(F.collect_list(tree)).alias("trees"))


def _grown(trees: Column, window: Column) -> Column:
    """What an array of trees says to an array of values: the weighted sum of the leaves that these lead to."""

    def leaf(nodes: Column, w: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            here = F.get(nodes, at)
            return F.when(here["left"] < 0, at).when(F.get(w, here["feature"]) <= here["threshold"], here["left"]).otherwise(here["right"])

        # No path is longer than half the nodes of its tree.
        return F.get(nodes, F.aggregate(F.sequence(F.lit(1), F.least(F.ceil(F.size(nodes) / 2).cast("int"), F.lit(MAX_DEPTH))), F.lit(0), step))["value"]

    total = lambda w: F.aggregate(trees, F.lit(0.0), lambda acc, t: acc + t["weight"] * leaf(t["nodes"], w))
    return F.get(F.transform(F.array(window), total), F.lit(0))


def recursion(trees: DataFrame, window: DataFrame, periods: int) -> DataFrame:
    """``periods`` values, each from the LAGS before it: i (from 0), yhat. One row of trees, one row of ``window`` (an array of values)."""
    last = lambda xs: F.slice(xs, F.size(xs) - (LAGS - 1), F.lit(LAGS))
    grow = F.aggregate(F.sequence(F.lit(1), F.lit(periods)), F.col("window"), lambda xs, _: F.concat(xs, F.array(_grown(F.col("trees"), last(xs)))))
    rows = trees.crossJoin(F.broadcast(window)).select(F.slice(grow, F.size("window") + 1, F.lit(periods)).alias("xs"))
    return rows.select(F.posexplode("xs").alias("i", "yhat")).withColumn("i", F.col("i").cast("bigint"))


def forecast(
    df: DataFrame,
    date_column: str,
    target: str,
    periods: int = 30,
    freq: str | None = None,
    agg: str = "mean",
    order_by: Sequence[str] | None = None,
    trees: DataFrame | None = None,
    **settings: object,
) -> Forecast:
    """Boosted trees on the five values before; predicts the test rows, then ``periods`` rows beyond.

    Beyond the data each prediction becomes an input of the next, in one Spark expression over the fitted trees. The band is
    ten percent to either side of the prediction. ``trees``, a table of NODES, are taken instead of fitted ones.
    """
    if not 1 <= periods <= MAX_HORIZON:
        raise ValueError(f"periods must lie between 1 and {MAX_HORIZON}")
    history = materialise(prepare(df, date_column, target, freq, agg, order_by))
    lags = [f"lag{k}" for k in range(LAGS, 0, -1)]
    rows = few_tasks(materialise(lag_features(history))).withColumn("features", array_to_vector(F.array(*lags)))
    test = rows.where("not is_train")
    if history.where("not is_train").limit(LAGS).count() < LAGS or not test.limit(1).count():
        raise ValueError("the test part is too short for the lags")
    if trees is None:
        model = GBTRegressor(featuresCol="features", labelCol="y", **{**TREES, **settings}).fit(rows.where("is_train"))
        wood, made = forest(tree_nodes(model)), model.transform(test)
    else:
        wood = forest(trees)
        made = test.crossJoin(F.broadcast(wood)).withColumn("prediction", _grown(F.col("trees"), F.array(*lags)))
    # the last five test values start the recursion
    tail = history.where("not is_train").orderBy(F.desc("position")).limit(LAGS)
    window = tail.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "y"))), lambda r: r["y"]).alias("window"))
    first = test.agg(F.min_by("ds", "position").alias("start"), F.min("position").alias("base"), F.count("*").alias("rows"))
    fitted = (
        made.crossJoin(F.broadcast(first))
        .select("start", (F.col("position") - F.col("base")).alias("k"), F.col("prediction").alias("yhat"), F.lit(False).alias("is_future"))
    )
    future = recursion(wood, window, periods).crossJoin(F.broadcast(first)).select(
        "start", (F.col("rows") + F.col("i")).alias("k"), "yhat", F.lit(True).alias("is_future")
    )
    predictions = fitted.unionByName(future).select(
        step_forward(F.col("start"), F.col("k"), freq).alias("ds"),
        "yhat",
        (F.col("yhat") * (1 - BAND)).alias("yhat_lower"),
        (F.col("yhat") * (1 + BAND)).alias("yhat_upper"),
        "is_future",
    )
    return Forecast(history, materialise(predictions))


def common_dates(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    return actual.select("ds").intersect(predicted.select("ds"))


def metrics(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Errors over the dates present in both tables (ds, y) and (ds, yhat), to four decimals."""
    both = actual.select("ds", "y").join(predicted.select("ds", "yhat"), "ds")
    error = F.col("y") - F.col("yhat")
    total = F.var_pop("y") * F.count("y")
    squares = F.sum(error * error)
    return both.agg(
        F.count("*").alias("n"),
        F.round(F.avg(error * error), 4).alias("mse"),
        F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
        F.round(F.avg(F.abs(error)), 4).alias("mae"),
        F.round(1 - squares / F.nullif(total, F.lit(0.0)), 4).alias("r2"),
    )


def plot_rows(result: Forecast) -> DataFrame:
    """History, fitted and future values with their bands, one table with a ``series`` column."""
    nothing = F.lit(None).cast("double")
    past = result.history.select(
        F.lit("history").alias("series"), "ds", F.col("y").alias("value"), nothing.alias("lower"), nothing.alias("upper")
    )
    made = result.predictions.select(
        F.when(F.col("is_future"), "future").otherwise("fitted").alias("series"),
        "ds",
        F.col("yhat").alias("value"),
        F.col("yhat_lower").alias("lower"),
        F.col("yhat_upper").alias("upper"),
    )
    return past.unionByName(made)
