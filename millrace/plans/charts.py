"""Registered queries: the rows behind every chart kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import chartdata, scale
from millrace.plans.tables import GAPPY_EVENTS, Query, gappy_events, rounded, table

BOX = ["q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high", "mean", "std"]


def _box_sql(source: str, group: str, value: str) -> str:
    inside = "v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)"
    r = lambda e: f"round({e}, 6) + 0.0"
    return f"""SELECT g AS "group", any_value(n) AS n, {r('any_value(q1)')} AS q1, {r('any_value(md)')} AS median, {r('any_value(q3)')} AS q3,
      {r('any_value(q1 - 1.5 * (q3 - q1))')} AS lower_fence, {r('any_value(q3 + 1.5 * (q3 - q1))')} AS upper_fence,
      {r(f'min(v) FILTER ({inside})')} AS whisker_low, {r(f'max(v) FILTER ({inside})')} AS whisker_high,
      {r('any_value(m)')} AS mean, {r('any_value(s)')} AS std, count(*) - count(*) FILTER ({inside}) AS outliers
      FROM (SELECT {group} AS g, {value}::DOUBLE AS v FROM {source} WHERE {value} IS NOT NULL) JOIN
      (SELECT {group} AS g, count(*) AS n, quantile_cont({value}::DOUBLE, 0.25) AS q1, quantile_cont({value}::DOUBLE, 0.5) AS md,
        quantile_cont({value}::DOUBLE, 0.75) AS q3, avg({value}) AS m, stddev_samp({value}) AS s
        FROM {source} WHERE {value} IS NOT NULL GROUP BY 1) USING (g) GROUP BY g"""


def _frame_sql(source: str, column: str, bins: int) -> str:
    return f"(SELECT min({column})::DOUBLE AS lo, (max({column}) - min({column})) / {bins}.0::DOUBLE AS w FROM {source})"


def _bin_sql(value: str, low: str, width: str, bins: int) -> str:
    return f"CAST(least(floor(({value} - {low}) / {width}), {bins - 1}) AS INTEGER)"


def _histogram_sql(source: str, column: str, bins: int, lead: str = "") -> str:
    frame = _frame_sql(source, column, bins)
    return f"""SELECT {lead} i AS bin, round(lo + i * w, 5) + 0.0 AS "left", round(lo + i * w + w, 5) + 0.0 AS "right",
      coalesce(c, 0) AS count, round(coalesce(c, 0) / (SELECT count({column}) FROM {source})::DOUBLE / w, 8) AS density
      FROM (SELECT CAST(i AS INTEGER) AS i, lo, w FROM range({bins}) t(i), {frame}) f LEFT JOIN
      (SELECT {_bin_sql(column, 'lo', 'w', bins)} AS i, count(*) AS c FROM {source}, {frame} WHERE {column} IS NOT NULL GROUP BY 1) USING (i)"""


def _histogram(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, 5, "left", "right"), 8, "density")


def histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _histogram(chartdata.build("histogram", gappy_events(spark, folder), x="value"))


def histogram_all(spark: SparkSession, folder: str) -> DataFrame:
    return _histogram(chartdata.histogram_all(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"], 20))


def compare_histograms(spark: SparkSession, folder: str) -> DataFrame:
    before = table(spark, folder, "orders").select("o_totalprice")
    after = scale.scale(before, ["o_totalprice"], "minmax")
    return _histogram(chartdata.compare_histograms(before, after, "o_totalprice", 10))


SCALED_ORDERS = """(SELECT (o_totalprice - (SELECT min(o_totalprice) FROM orders)) / ((SELECT max(o_totalprice) FROM orders)
    - (SELECT min(o_totalprice) FROM orders)) AS o_totalprice FROM orders)"""


def _grid_sql(x: str, y: str, bins: int) -> str:
    return f"""SELECT {_bin_sql(x, 'fx.lo', 'fx.w', bins)} AS bin_x, {_bin_sql(y, 'fy.lo', 'fy.w', bins)} AS bin_y, fx.lo + 0 AS lx, fx.w AS wx,
      fy.lo AS ly, fy.w AS wy, * FROM lineitem, {_frame_sql('lineitem', x, bins)} fx, {_frame_sql('lineitem', y, bins)} fy"""


def violin(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rounded(chartdata.build("violin", table(spark, folder, "events"), y="value", x="event_type"), 6, "value"), 7, "density")


def _violin_sql(source: str, group: str) -> str:
    """The density by its definition: a sum over all rows of a group at every point."""
    return f"""WITH r AS (SELECT {group} AS g, value AS v FROM {source} WHERE value IS NOT NULL AND isfinite(value)),
  s AS (SELECT g, count(*) AS n, min(v) AS lo, max(v) AS hi,
    coalesce(1.059 * least(nullif(stddev_samp(v), 0), nullif((quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349, 0)) * pow(count(*), -0.2),
      greatest(0.001 * abs(quantile_cont(v, 0.5)), 0.001)) AS h FROM r GROUP BY 1),
  p AS (SELECT g, n, h, lo - 2 * h + i * ((hi - lo + 4 * h) / 99) AS x FROM s, range(100) t(i))
SELECT g AS "group", round(x, 6) + 0.0 AS value, round(sum(exp(-0.5 * pow((x - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 7) + 0.0 AS density
FROM p JOIN r USING (g) GROUP BY g, x"""


VIOLIN_SQL = _violin_sql("events", "event_type")


def with_far_values(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a few values a million times as large, and an infinite one."""
    far = F.when(F.col("event_id") % 997 == 5, 1e9 + F.col("event_id")).when(F.col("event_id") == 3, float("inf")).otherwise(F.col("value"))
    return table(spark, folder, "events").withColumn("value", far)


FAR_EVENTS = "(SELECT event_id, event_type, user_id, CASE WHEN event_id % 997 = 5 THEN 1e9 + event_id WHEN event_id = 3 THEN 'inf'::DOUBLE ELSE value END AS value FROM events)"


def violin_outlier(spark: SparkSession, folder: str) -> DataFrame:
    far = with_far_values(spark, folder).withColumn("kind", F.when(F.col("value") > 1e8, "far").otherwise(F.col("event_type")))
    both = far.unionByName(far.withColumn("kind", F.lit("all")))
    return rounded(rounded(chartdata.violin(both, "value", "kind"), 4, "value"), 7, "density")


OUTLIER_SQL = _violin_sql(f"(SELECT value, CASE WHEN value > 1e8 THEN 'far' ELSE event_type END AS kind FROM {FAR_EVENTS} UNION ALL SELECT value, 'all' FROM {FAR_EVENTS})", "kind").replace(
    "round(x, 6)", "round(x, 4)"
)


def histogram_kde(spark: SparkSession, folder: str) -> DataFrame:
    parts = chartdata.histogram_kde(table(spark, folder, "events"), "value")
    bars = parts["histogram"].select(F.lit("histogram").alias("part"), F.col("left").alias("at"), "density")
    curve = parts["kde"].select(F.lit("kde").alias("part"), F.col("value").alias("at"), "density")
    return rounded(rounded(bars, 5, "at"), 8, "density").unionByName(rounded(rounded(curve, 6, "at"), 7, "density"))


ONE_GROUP = _violin_sql("events", "'all'")
HISTOGRAM_KDE_SQL = f"""SELECT 'histogram' AS part, "left" AS at, density FROM ({_histogram_sql("events", "value", 30)})
    UNION ALL SELECT 'kde', value, density FROM ({ONE_GROUP})"""


def with_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with a latitude and longitude made from their columns."""
    customer = table(spark, folder, "customer")
    return customer.withColumns(
        {"lat": F.col("c_acctbal") / 125 - 5, "lon": (F.col("c_nationkey") * 14 - 170).cast("double")}
    )


COORDINATES = "(SELECT *, c_acctbal / 125 - 5 AS lat, CAST(c_nationkey * 14 - 170 AS DOUBLE) AS lon FROM customer)"


def points(kind: str, **fields):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return chartdata.build(kind, table(spark, folder, "part"), key=["p_partkey"], **fields)

    return run


def map_points(kind: str, **fields):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        result = chartdata.build(kind, with_coordinates(spark, folder), key=["c_custkey"], **fields)
        return rounded(result, 6, "lat", "lon")

    return run


def scatter_sampled(spark: SparkSession, folder: str) -> DataFrame:
    """The sample that a chart may ask for: 5,000 rows drawn by a hash of the key."""
    return chartdata.build(
        "scatter", table(spark, folder, "lineitem"), x="l_quantity", y="l_extendedprice", color="l_returnflag",
        key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], max_points=5000,
    )


SAMPLED_SQL = """SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color, (SELECT count(*) FROM lineitem) AS of_rows
    FROM lineitem ORDER BY ('0x' || substr(md5(l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':42'), 1, 13))::BIGINT LIMIT 5000"""


def county_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Balances by a five-digit code with a given colour range and hover text."""
    customer = table(spark, folder, "customer").withColumn("code", F.col("c_nationkey") * 37 + 8)
    result = chartdata.build(
        "choropleth", customer, locations="code", values="c_acctbal", locationmode="geojson-id", agg="avg",
        color_range=(0, 5000), hover="c_mktsegment",
    )
    return rounded(result, 6, "value")


COUNTY_SQL = """SELECT lpad((c_nationkey * 37 + 8)::VARCHAR, 5, '0') AS location, round(avg(c_acctbal), 6) + 0.0 AS value,
    min(c_mktsegment) AS hover, 0.0::DOUBLE AS color_min, 5000.0::DOUBLE AS color_max, 'geojson-id' AS locationmode FROM customer GROUP BY 1"""


def infinite_values(spark: SparkSession, folder: str) -> DataFrame:
    """A histogram of values of which some are infinite; these have no bin."""
    events = table(spark, folder, "events")
    value = F.when(F.col("event_id") % 5 == 0, float("inf")).when(F.col("event_id") % 5 == 1, float("-inf")).otherwise(F.col("value"))
    return _histogram(chartdata.build("histogram", events.withColumn("value", value), x="value"))


FINITE_EVENTS = "(SELECT value FROM events WHERE event_id % 5 > 1)"


def choropleth(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation")
    located = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    result = chartdata.build("choropleth", located, locations="n_name", values="c_acctbal", locationmode="country names")
    return rounded(result, 2, "value", "color_min", "color_max")


QUERIES = {
    "chart_box": Query(
        lambda s, d: rounded(chartdata.build("box", gappy_events(s, d), y="value", x="event_type"), 6, *BOX),
        _box_sql(GAPPY_EVENTS, "event_type", "value"),
    ),
    "chart_box_user": Query(
        lambda s, d: rounded(chartdata.build("box", table(s, d, "events"), y="value", x="user_id"), 6, *BOX),
        _box_sql("events", "user_id", "value"),
    ),
    "chart_box_all": Query(
        lambda s, d: rounded(chartdata.box_all(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 6, *BOX),
        " UNION ALL ".join(
            _box_sql("lineitem", f"'{c}'", c).replace('AS "group"', 'AS "column"')
            for c in ["l_quantity", "l_extendedprice", "l_discount"]
        ),
    ),
    "chart_histogram": Query(histogram, _histogram_sql(GAPPY_EVENTS, "value", 30)),
    "chart_histogram_all": Query(
        histogram_all,
        " UNION ALL ".join(
            _histogram_sql("lineitem", c, 20, f"""'{c}' AS "column",""") for c in ["l_quantity", "l_extendedprice"]
        ),
    ),
    "scale_compare_histograms": Query(
        compare_histograms,
        _histogram_sql("orders", "o_totalprice", 10, "'before' AS stage,")
        + " UNION ALL "
        + _histogram_sql(SCALED_ORDERS, "o_totalprice", 10, "'after' AS stage,"),
    ),
    "chart_histogram_kde": Query(histogram_kde, HISTOGRAM_KDE_SQL),
    "chart_scatter": Query(
        points("scatter", x="p_size", y="p_retailprice", color="p_brand"),
        "SELECT p_size AS x, p_retailprice AS y, p_brand AS color FROM part",
    ),
    "chart_scatter_sampled": Query(scatter_sampled, SAMPLED_SQL),
    "chart_histogram_infinite": Query(infinite_values, _histogram_sql(FINITE_EVENTS, "value", 30)),
    "chart_box_outliers": Query(
        lambda s, d: chartdata.box_outliers(table(s, d, "events"), "value", "event_type"),
        """SELECT event_type AS "group", value FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1,
        quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) USING (event_type)
        WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    ),
    "chart_bar": Query(
        lambda s, d: rounded(chartdata.build("bar", table(s, d, "orders"), x="o_orderpriority", y="o_totalprice"), 2, "height"),
        "SELECT o_orderpriority AS category, round(sum(o_totalprice), 2) AS height FROM orders GROUP BY 1",
    ),
    "chart_bar_count": Query(
        lambda s, d: chartdata.build("bar", table(s, d, "orders"), x="o_orderpriority", y=None),
        "SELECT o_orderpriority AS category, CAST(count(*) AS DOUBLE) AS height FROM orders GROUP BY 1",
    ),
    "chart_bar_color": Query(
        lambda s, d: rounded(
            chartdata.build("bar", table(s, d, "orders"), x="o_orderpriority", y="o_totalprice", color="o_orderstatus"), 2, "height"
        ),
        "SELECT o_orderpriority AS category, o_orderstatus AS color, round(sum(o_totalprice), 2) AS height FROM orders GROUP BY 1, 2",
    ),
    "chart_pie": Query(
        lambda s, d: rounded(chartdata.build("pie", table(s, d, "events"), names="event_type"), 6, "share"),
        """SELECT event_type AS category, CAST(count(*) AS DOUBLE) AS height, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS share
        FROM events GROUP BY 1""",
    ),
    "chart_pie_values": Query(
        lambda s, d: rounded(
            rounded(chartdata.build("pie", gappy_events(s, d), names="event_type", values="value"), 3, "height"), 6, "share"
        ),
        f"""SELECT event_type AS category, round(sum(value), 3) AS height, round(sum(value) / (SELECT sum(value) FROM {GAPPY_EVENTS}), 6) AS share
        FROM {GAPPY_EVENTS} GROUP BY 1""",
    ),
    "chart_line": Query(
        points("line", x="p_retailprice", y="p_size", color="p_type"),
        "SELECT p_retailprice AS x, p_size AS y, p_type AS color FROM part",
    ),
    "chart_violin": Query(violin, VIOLIN_SQL),
    "chart_violin_outlier": Query(violin_outlier, OUTLIER_SQL),
    "chart_contour": Query(
        lambda s, d: rounded(
            chartdata.build("contour", table(s, d, "lineitem"), x="l_quantity", y="l_extendedprice"), 4, "left_x", "left_y"
        ),
        f"""SELECT bin_x, bin_y, round(any_value(lx + bin_x * wx), 4) + 0.0 AS left_x, round(any_value(ly + bin_y * wy), 4) + 0.0 AS left_y,
        count(*) AS count FROM ({_grid_sql('l_quantity', 'l_extendedprice', 20)}) GROUP BY 1, 2""",
    ),
    "chart_histcontour": Query(
        lambda s, d: chartdata.build(
            "histcontour", table(s, d, "lineitem"), x="l_quantity", y="l_extendedprice", color="l_returnflag", bins_x=10, bins_y=10
        ),
        f"""SELECT l_returnflag AS color, bin_x, bin_y, count(*) AS count FROM ({_grid_sql('l_quantity', 'l_extendedprice', 10)})
        GROUP BY GROUPING SETS ((l_returnflag, bin_x, bin_y), (l_returnflag, bin_x), (l_returnflag, bin_y))""",
    ),
    "chart_contour_z": Query(
        lambda s, d: rounded(chartdata.contour(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", "l_tax"), 6, "z"),
        f"""SELECT bin_x, bin_y, round(avg(l_tax), 6) + 0.0 AS z, count(*) AS count FROM ({_grid_sql('l_quantity', 'l_extendedprice', 20)})
        GROUP BY 1, 2""",
    ),
    "chart_scatter3d": Query(
        points("scatter3d", x="p_size", y="p_retailprice", z="p_partkey"),
        "SELECT p_size AS x, p_retailprice AS y, p_partkey AS z FROM part",
    ),
    "chart_line3d": Query(
        points("line3d", x="p_size", y="p_retailprice", z="p_partkey", order_by=["p_partkey"]),
        "SELECT p_size AS x, p_retailprice AS y, p_partkey AS z FROM part",
    ),
    "chart_line3d_color": Query(
        points("line3d", x="p_size", y="p_retailprice", z="p_partkey", order_by=["p_partkey"], color="p_type"),
        "SELECT p_size AS x, p_retailprice AS y, p_partkey AS z, p_type AS color FROM part",
    ),
    "chart_polarscatter": Query(
        points("polarscatter", theta="p_size", r="p_retailprice", color="p_brand", symbol="p_type"),
        "SELECT p_size AS theta, p_retailprice AS r, p_brand AS color, p_type AS symbol FROM part",
    ),
    "chart_polarbar": Query(
        lambda s, d: rounded(chartdata.build("polarbar", table(s, d, "part"), theta="p_type", r="p_retailprice"), 2, "r"),
        "SELECT p_type AS theta, round(sum(p_retailprice), 2) AS r FROM part GROUP BY 1",
    ),
    "chart_polarbar_color": Query(
        lambda s, d: rounded(chartdata.build("polarbar", table(s, d, "part"), theta="p_type", r="p_retailprice", color="p_brand"), 2, "r"),
        "SELECT p_type AS theta, p_brand AS color, round(sum(p_retailprice), 2) AS r FROM part GROUP BY 1, 2",
    ),
    "chart_scattergeo": Query(
        map_points("scattergeo", lat="lat", lon="lon", color="c_mktsegment", size="c_acctbal", hover=["c_name"]),
        f"""SELECT round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, c_mktsegment AS color, c_acctbal AS size, c_name
        FROM {COORDINATES}""",
    ),
    "chart_bubblemap": Query(
        map_points("bubblemap", lat="lat", lon="lon", size="c_acctbal"),
        f"SELECT round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, c_acctbal AS size FROM {COORDINATES}",
    ),
    "chart_bubblemap_color": Query(
        map_points("bubblemap", lat="lat", lon="lon", size="c_acctbal", color="c_mktsegment", hover=["c_name"]),
        f"""SELECT round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, c_mktsegment AS color, c_acctbal AS size, c_name
        FROM {COORDINATES}""",
    ),
    "chart_choropleth_counties": Query(county_sums, COUNTY_SQL),
    "chart_choropleth": Query(
        choropleth,
        """WITH p AS (SELECT n_name AS location, sum(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
        SELECT location, round(v, 2) + 0.0 AS value, (SELECT round(min(v), 2) + 0.0 FROM p) AS color_min,
        (SELECT round(max(v), 2) + 0.0 FROM p) AS color_max, 'country names' AS locationmode FROM p""",
    ),
    "chart_point_map": Query(
        lambda s, d: rounded(chartdata.point_map(with_coordinates(s, d), "lat", "lon"), 6, "lat", "lon"),
        f"""SELECT round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS valid
        FROM {COORDINATES}""",
    ),
    "coordinate_check": Query(
        lambda s, d: rounded(
            chartdata.coordinate_check(with_coordinates(s, d), "lat", "lon"), 5,
            "lat_min", "lat_max", "lon_min", "lon_max", "lat_centre", "lon_centre",
        ),
        f"""SELECT round(min(lat), 5) + 0.0 AS lat_min, round(max(lat), 5) + 0.0 AS lat_max, round(min(lon), 5) + 0.0 AS lon_min,
        round(max(lon), 5) + 0.0 AS lon_max, round(avg(lat), 5) + 0.0 AS lat_centre, round(avg(lon), 5) + 0.0 AS lon_centre,
        min(lat) >= -90 AND max(lat) <= 90 AND min(lon) >= -180 AND max(lon) <= 180 AS valid FROM {COORDINATES}""",
    ),
}
