"""The numbers behind charts, as DataFrames.

Every kind uses all rows. Kinds that draw one point per row take ``max_points``
for a random sample of that size, and then name the number of rows it stands for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import missing_as_null, number, numeric_columns, quoted, require_columns, require_numeric
from millrace.operators.profile import sum_by, value_counts, value_range
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.rank import grouped_quantiles
from millrace.operators.sample import SEED, sample_rows
from millrace.operators.shape import records, with_group_numbers

DEFAULT_BINS = 30
DEFAULT_GRID_BINS = 20
WHISKER = 1.5
KDE_POINTS = 100
#: Bins of a density in parts of its bandwidth, moments that a bin keeps, and bandwidths beyond which the kernel counts as zero.
KDE_PARTS, KDE_MOMENTS, KDE_REACH = 8, 8, 8.0
#: Bandwidth of a group without any spread, as a share of its value and at least.
KDE_NARROW = 1e-3

# The ways a location can be written.
COUNTIES = "geojson-id"
LOCATION_MODES = ["USA-states", "country names", "ISO-3", COUNTIES]


# ---------------------------------------------------------------- boxes


def box(df: DataFrame, y: str, x: str | None = None, k: float = WHISKER) -> DataFrame:
    """Quartiles, fences, whiskers, mean, deviation and outlier count of ``y``, per value of ``x``."""
    require_numeric(df, y)
    if x is None:
        return box_all(df, [y], k).drop("column")
    require_columns(df, x)
    rows = df.select(missing_as_null(df, x).alias("g"), number(df, y).alias("v"))
    rows = rows.where("g is not null and v is not null")
    quartiles = grouped_quantiles(rows, ["g"], "v", [0.25, 0.5, 0.75])
    spread = rows.groupBy("g").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    gap = (F.col("q2") - F.col("q0")) * k
    table = quartiles.join(spread, "g").withColumns({"low": F.col("q0") - gap, "high": F.col("q2") + gap})
    inside = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
    stats = ["n", "q0", "q1", "q2", "low", "high", "mean", "std"]
    return (
        with_group_numbers(rows, table, ["g"])
        .groupBy("g")
        .agg(
            *[F.max(s).alias(s) for s in stats],
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("cnt"))).alias("outliers"),
        )
        .select(
            F.col("g").alias("group"),
            "n",
            F.col("q0").alias("q1"),
            F.col("q1").alias("median"),
            F.col("q2").alias("q3"),
            F.col("low").alias("lower_fence"),
            F.col("high").alias("upper_fence"),
            "whisker_low",
            "whisker_high",
            "mean",
            "std",
            "outliers",
        )
    )


def box_outliers(df: DataFrame, y: str, x: str | None = None, k: float = WHISKER) -> DataFrame:
    """The values that lie outside the fences of their box, one row per row: group and value."""
    boxes = box(df, y, x, k).select("group" if x else F.lit("all").alias("group"), "lower_fence", "upper_fence")
    group = missing_as_null(df, x) if x else F.lit("all")
    rows = df.select(group.alias("group"), number(df, y).alias("value")).where("group is not null and value is not null")
    near = with_group_numbers(rows, boxes, ["group"]).where("value < lower_fence or value > upper_fence")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("cnt").cast("bigint")))
    return near.withColumn("_copy", each).select("group", "value")


def box_all(df: DataFrame, columns: Sequence[str] | None = None, k: float = WHISKER) -> DataFrame:
    """Box numbers of many columns from shared scans; one row per column."""
    columns = list(columns or numeric_columns(df))
    found = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggregates, rows = [], []
    for i, c in enumerate(columns):
        v, q = number(df, c), found[c]
        if q[0.5] is None:
            continue
        gap = k * (q[0.75] - q[0.25])
        low, high = q[0.25] - gap, q[0.75] + gap
        inside = (v >= low) & (v <= high)
        aggregates += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.min(F.when(inside, v)).alias(f"low{i}"),
            F.max(F.when(inside, v)).alias(f"high{i}"),
            F.count_if(~inside).alias(f"out{i}"),
        ]
        rows.append(
            {
                "column": F.lit(c),
                "n": F.col(f"n{i}"),
                "q1": F.lit(q[0.25]),
                "median": F.lit(q[0.5]),
                "q3": F.lit(q[0.75]),
                "lower_fence": F.lit(low),
                "upper_fence": F.lit(high),
                "whisker_low": F.col(f"low{i}"),
                "whisker_high": F.col(f"high{i}"),
                "mean": F.col(f"mean{i}"),
                "std": F.col(f"std{i}"),
                "outliers": F.col(f"out{i}"),
            }
        )
    if not rows:
        raise ValueError("no column holds a number to draw")
    return records(df.agg(*aggregates), rows)


# ---------------------------------------------------------------- bins


def finite(df: DataFrame, name: str) -> Column:
    """The column as double; infinite numbers have no bin and count as missing."""
    value = number(df, name)
    return F.when(F.abs(value) < math.inf, value)


@dataclass(frozen=True)
class Bins:
    low: float
    width: float
    count: int

    def index(self, value: Column) -> Column:
        """Bin of a value; the largest value belongs to the last bin."""
        place = F.floor((value - self.low) / self.width)
        return F.when(place < self.count, place).when(place.isNotNull(), self.count - 1).cast("int")

    def left(self, index: Column) -> Column:
        return F.lit(self.low) + index * F.lit(self.width)


def _bins(df: DataFrame, columns: dict[str, int]) -> dict[str, Bins]:
    aggregates = []
    for i, c in enumerate(columns):
        v = finite(df, c)
        aggregates += [F.min(v).alias(f"low{i}"), F.max(v).alias(f"high{i}")]
    row = df.agg(*aggregates).first()
    result = {}
    for i, (c, count) in enumerate(columns.items()):
        low, high = row[f"low{i}"], row[f"high{i}"]
        if low is None:
            raise ValueError(f"'{c}' holds no finite number to draw")
        if low == high:
            low, high = low - 0.5, high + 0.5
        result[c] = Bins(low, (high - low) / count, count)
    return result


def _check_bins(bins: int, least: int, most: int) -> None:
    if not least <= bins <= most:
        raise ValueError(f"bins must lie between {least} and {most}")


def histogram(df: DataFrame, x: str, bins: int = DEFAULT_BINS) -> DataFrame:
    """Count and probability density per bin, empty bins included."""
    return histogram_all(df, [x], bins).drop("column")


def histogram_all(df: DataFrame, columns: Sequence[str] | None = None, bins: int = DEFAULT_BINS) -> DataFrame:
    """Histograms of many columns; every row is read once and reduced before the shuffle."""
    _check_bins(bins, 5, 100)
    columns = list(columns or numeric_columns(df))
    found = _bins(df, dict.fromkeys(columns, bins))
    entries = [F.struct(F.lit(c).alias("column"), b.index(finite(df, c)).alias("bin")) for c, b in found.items()]
    counts = (
        df.select(F.inline(F.array(*entries))).where("bin is not null").groupBy("column", "bin").agg(F.count("*").alias("cnt"))
    )
    frame = df.sparkSession.createDataFrame(
        [(c, i, b.low, b.width) for c, b in found.items() for i in range(bins)],
        "column string, bin int, low double, width double",
    )
    total = F.sum("cnt").over(Window.partitionBy("column"))
    left = F.col("low") + F.col("bin") * F.col("width")
    count = F.coalesce("cnt", F.lit(0))
    return (
        frame.join(counts, ["column", "bin"], "left")
        .withColumn("n", total)
        .select(
            "column",
            "bin",
            left.alias("left"),
            (left + F.col("width")).alias("right"),
            count.alias("count"),
            (count / F.col("n") / F.col("width")).alias("density"),
        )
    )


def compare_histograms(
    before: DataFrame, after: DataFrame, column: str, bins: int = DEFAULT_BINS
) -> DataFrame:
    """Histograms of one column before and after a transformation."""
    old = histogram(before, column, bins).withColumn("stage", F.lit("before"))
    return old.unionByName(histogram(after, column, bins).withColumn("stage", F.lit("after")))


def density2d(
    df: DataFrame, x: str, y: str, bins_x: int = DEFAULT_GRID_BINS, bins_y: int = DEFAULT_GRID_BINS, color: str | None = None
) -> DataFrame:
    """Counts of the occupied cells of a two-dimensional grid."""
    cells, found = _cells(df, x, y, bins_x, bins_y, color)
    keys = [*(["color"] if color else []), "bin_x", "bin_y"]
    counts = cells.groupBy(*keys).agg(F.count("*").alias("count"))
    return counts.select(
        *keys,
        found[x].left(F.col("bin_x")).alias("left_x"),
        found[y].left(F.col("bin_y")).alias("left_y"),
        "count",
    )


def histogram2d(
    df: DataFrame, x: str, y: str, bins_x: int = DEFAULT_GRID_BINS, bins_y: int = DEFAULT_GRID_BINS, color: str | None = None
) -> DataFrame:
    """Grid counts with both marginal histograms; a marginal row has one bin empty."""
    _check_bins(bins_x, 5, 50)
    _check_bins(bins_y, 5, 50)
    cells, _ = _cells(df, x, y, bins_x, bins_y, color)
    lead = ["color"] if color else []
    sets = [[F.col(c) for c in [*lead, *keys]] for keys in (["bin_x", "bin_y"], ["bin_x"], ["bin_y"])]
    everything = [F.col(c) for c in [*lead, "bin_x", "bin_y"]]
    return cells.groupingSets(sets, *everything).agg(F.count("*").alias("count"))


def _cells(df: DataFrame, x: str, y: str, bins_x: int, bins_y: int, color: str | None) -> tuple[DataFrame, dict]:
    require_numeric(df, x, y)
    found = _bins(df, {x: bins_x, y: bins_y})
    extra = [missing_as_null(df, color).alias("color")] if color else []
    cells = df.select(
        *extra, found[x].index(finite(df, x)).alias("bin_x"), found[y].index(finite(df, y)).alias("bin_y")
    )
    return cells.where("bin_x is not null and bin_y is not null"), found


def contour(
    df: DataFrame, x: str, y: str, z: str, bins_x: int = DEFAULT_GRID_BINS, bins_y: int = DEFAULT_GRID_BINS
) -> DataFrame:
    """Mean of ``z`` per occupied grid cell."""
    require_numeric(df, x, y, z)
    found = _bins(df, {x: bins_x, y: bins_y})
    cells = df.select(
        found[x].index(finite(df, x)).alias("bin_x"), found[y].index(finite(df, y)).alias("bin_y"), number(df, z).alias("z")
    )
    cells = cells.where("bin_x is not null and bin_y is not null and z is not null")
    return cells.groupBy("bin_x", "bin_y").agg(F.avg("z").alias("z"), F.count("*").alias("count"))


# ---------------------------------------------------------------- smooth densities


def violin(df: DataFrame, y: str, x: str | None = None, points: int = KDE_POINTS) -> DataFrame:
    """Gaussian kernel density of ``y`` per value of ``x``, at points from two bandwidths below a group's least value to two above its largest.

    ``box`` gives the box inside. Bandwidth: 1.059 * min(std, iqr / 1.349) * n^(-1/5) of the group. Bins are an eighth of the group's
    bandwidth wide and keep the first moments of their rows around their middle, from which a Hermite series gives
    their share of the density, as good as the rows themselves; a bin only meets the points within reach of the kernel, and rows out of
    reach of all points are left out. So a far value neither widens the bins of its group or of others nor adds to their number.
    """
    require_numeric(df, y)
    if x is not None:
        require_columns(df, x)
    group = missing_as_null(df, x) if x else F.lit("all")
    rows = df.select(group.alias("group"), finite(df, y).alias("v")).where("group is not null and v is not null")
    quartiles = grouped_quantiles(rows, ["group"], "v", [0.25, 0.5, 0.75])
    spread = rows.groupBy("group").agg(F.stddev_samp("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))
    scale = F.least(F.nullif("std", F.lit(0.0)), F.nullif((F.col("q2") - F.col("q0")) / 1.349, F.lit(0.0)))
    narrow = F.greatest(F.abs("q1") * KDE_NARROW, F.lit(KDE_NARROW))
    h, step = F.col("h"), F.col("step")
    bands = quartiles.join(spread, "group").withColumn("h", F.coalesce(1.059 * scale * F.pow(F.col("n"), F.lit(-0.2)), narrow))
    bands = bands.select("group", "n", "h", (F.col("low") - 2 * h).alias("first"), ((F.col("high") - F.col("low") + 4 * h) / (points - 1)).alias("step"))
    near = with_group_numbers(rows, bands, ["group"])
    point = F.least(F.greatest(F.round((F.col("v") - F.col("first")) / step), F.lit(0.0)), F.lit(points - 1.0))
    near = near.where(F.abs(F.col("first") + point * step - F.col("v")) <= (KDE_REACH + 1 / KDE_PARTS) * h)
    place = F.floor((F.col("v") - F.col("first")) / h * KDE_PARTS).cast("double")
    middle = (F.col("bin") + 0.5) / KDE_PARTS
    off = (F.col("v") - F.col("first")) / h - middle
    moments = [F.sum(F.col("cnt") * F.pow(off, F.lit(float(k))) / math.factorial(k)).alias(f"m{k}") for k in range(KDE_MOMENTS)]
    fine = near.withColumn("bin", place).groupBy("group", "n", "h", "first", "step", "bin").agg(*moments)
    # Points in reach of a bin, in bandwidths from the first point.
    apart = step / h
    least = F.greatest(F.ceil((middle - KDE_REACH) / apart), F.lit(0))
    most = F.least(F.floor((middle + KDE_REACH) / apart), F.lit(points - 1))
    fine = fine.where(least <= most).withColumn("point", F.explode(F.sequence(least.cast("int"), most.cast("int"))))
    fine = fine.withColumn("u", F.col("point") * apart - middle)
    # He(k + 1) = u He(k) - k He(k - 1)
    u, hermite = F.col("u"), [F.lit(1.0), F.col("u")]
    for k in range(2, KDE_MOMENTS):
        fine = fine.withColumn(f"he{k}", u * hermite[-1] - (k - 1) * hermite[-2])
        hermite.append(F.col(f"he{k}"))
    series = sum((F.col(f"m{k}") * e for k, e in enumerate(hermite[1:], 1)), F.col("m0"))
    summed = fine.groupBy("group", "point", "n", "h", "first", "step").agg(F.sum(F.exp(-0.5 * u * u) * series).alias("mass"))
    frame = bands.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select("group", "point", "n", "h", "first", "step")
    found = frame.join(summed.select("group", "point", "mass"), ["group", "point"], "left")
    density = F.greatest(F.coalesce("mass", F.lit(0.0)), F.lit(0.0)) / (F.col("n") * h * math.sqrt(2 * math.pi))
    return found.select("group", (F.col("first") + F.col("point") * step).alias("value"), density.alias("density"))


def histogram_kde(df: DataFrame, x: str, bins: int = DEFAULT_BINS) -> dict[str, DataFrame]:
    return {"histogram": histogram(df, x, bins), "kde": violin(df, x).drop("group")}


# ---------------------------------------------------------------- categories


def bar(df: DataFrame, x: str, y: str | None = None, color: str | None = None) -> DataFrame:
    """Sum of ``y``, or the number of rows, per category."""
    if color is None:
        if y is None:
            return value_counts(df, x).select(F.col("value").alias("category"), F.col("count").cast("double").alias("height"))
        return sum_by(df, x, y).select(F.col("value").alias("category"), F.col("total").alias("height"))
    require_columns(df, x, color)
    amount = number(df, y) if y else F.lit(1.0)
    rows = df.select(missing_as_null(df, x).alias("category"), missing_as_null(df, color).alias("color"), amount.alias("v"))
    return rows.where("category is not null and color is not null").groupBy("category", "color").agg(F.sum("v").alias("height"))


def pie(df: DataFrame, names: str, values: str | None = None) -> DataFrame:
    """Bar heights with their share of the total."""
    parts = bar(df, names, values)
    total = parts.agg(F.sum("height").alias("total"))
    return parts.crossJoin(F.broadcast(total)).select(
        "category", "height", (F.col("height") / F.nullif("total", F.lit(0.0))).alias("share")
    )


def polar_bar(df: DataFrame, theta: str, r: str, color: str | None = None) -> DataFrame:
    """Sum of ``r`` per direction, and per colour group."""
    names = {"category": "theta", "height": "r"}
    return bar(df, theta, r, color).withColumnsRenamed(names)


def choropleth(
    df: DataFrame,
    locations: str,
    values: str,
    locationmode: str = "USA-states",
    agg: str = "sum",
    color_range: Sequence[float] | None = None,
    hover: str | None = None,
) -> DataFrame:
    """One value per location, with the given range of the colour scale or that of the values, and a hover text.

    County codes are texts of five digits; numbers get their leading zeros back.
    """
    if locationmode not in LOCATION_MODES:
        raise ValueError(f"unknown location type: {locationmode}")
    if agg not in ("sum", "avg", "min", "max", "count"):
        raise ValueError(f"unknown aggregate: {agg}")
    require_columns(df, locations)
    place = missing_as_null(df, locations)
    if locationmode == COUNTIES:
        place = F.lpad(place.cast("string"), 5, "0")
    text = [missing_as_null(df, hover).alias("hover")] if hover else []
    rows = df.select(place.alias("location"), number(df, values).alias("v"), *text).where("location is not null")
    # a hover text belongs to a location; where rows differ, the smallest is shown
    texts = [F.min("hover").alias("hover")] if hover else []
    places = rows.groupBy("location").agg(getattr(F, agg)("v").cast("double").alias("value"), *texts)
    if color_range is not None:
        low, high = color_range
        places = places.withColumns({"color_min": F.lit(float(low)), "color_max": F.lit(float(high))})
    else:
        colors = value_range(places, "value").withColumnsRenamed({"min": "color_min", "max": "color_max"})
        places = places.crossJoin(F.broadcast(colors))
    return places.withColumn("locationmode", F.lit(locationmode))


# ---------------------------------------------------------------- points


def points(
    df: DataFrame,
    columns: dict[str, str | None],
    key: Sequence[str] | None = None,
    seed: int = SEED,
    keep: Sequence[str] = (),
    max_points: int | None = None,
) -> DataFrame:
    """The named columns of all rows, or of ``max_points`` random ones with a column ``of_rows``."""
    used = {name: c for name, c in columns.items() if c}
    require_columns(df, *used.values())
    chosen = df.select(*dict.fromkeys([*used.values(), *(key or []), *keep]))
    names = [missing_as_null(df, c).alias(name) for name, c in used.items()]
    if max_points is None:
        return chosen.select(*names, *keep)
    total = F.lit(df.count()).alias("of_rows")
    return sample_rows(chosen, max_points, seed, key).select(*names, *keep, total)


def scatter(
    df: DataFrame, x: str, y: str, color: str | None = None, key: Sequence[str] | None = None, max_points: int | None = None
) -> DataFrame:
    return points(df, {"x": x, "y": y, "color": color}, key, max_points=max_points)


def line(
    df: DataFrame, x: str, y: str, color: str | None = None, key: Sequence[str] | None = None, max_points: int | None = None
) -> DataFrame:
    return scatter(df, x, y, color, key, max_points).orderBy("x")


def scatter3d(
    df: DataFrame, x: str, y: str, z: str, color: str | None = None, key: Sequence[str] | None = None, max_points: int | None = None
) -> DataFrame:
    return points(df, {"x": x, "y": y, "z": z, "color": color}, key, max_points=max_points)


def line3d(
    df: DataFrame,
    x: str,
    y: str,
    z: str,
    order_by: Sequence[str],
    color: str | None = None,
    key: Sequence[str] | None = None,
    max_points: int | None = None,
) -> DataFrame:
    """Points in row order, as given by ``order_by``; ``color`` makes a line of its own for each value."""
    if not order_by:
        raise ValueError("a line in space follows the row order: give order_by")
    ordered = [f"_o{i}" for i in range(len(order_by))]
    rows = df.withColumns({o: quoted(c) for o, c in zip(ordered, order_by, strict=True)})
    found = points(rows, {"x": x, "y": y, "z": z, "color": color}, key, keep=ordered, max_points=max_points)
    return found.orderBy(*(["color"] if color else []), *ordered).drop(*ordered)


def polar_scatter(
    df: DataFrame,
    theta: str,
    r: str,
    color: str | None = None,
    symbol: str | None = None,
    key: Sequence[str] | None = None,
    max_points: int | None = None,
) -> DataFrame:
    return points(df, {"theta": theta, "r": r, "color": color, "symbol": symbol}, key, max_points=max_points)


def coordinate_check(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Extent and centre of the coordinates and whether all of them are possible."""
    a, o = number(df, lat), number(df, lon)
    return df.agg(
        F.min(a).alias("lat_min"),
        F.max(a).alias("lat_max"),
        F.min(o).alias("lon_min"),
        F.max(o).alias("lon_max"),
        F.avg(a).alias("lat_centre"),
        F.avg(o).alias("lon_centre"),
    ).withColumn("valid", F.expr("lat_min >= -90 and lat_max <= 90 and lon_min >= -180 and lon_max <= 180"))


def scatter_map(
    df: DataFrame,
    lat: str,
    lon: str,
    color: str | None = None,
    size: str | None = None,
    hover: Sequence[str] = (),
    key: Sequence[str] | None = None,
    max_points: int | None = None,
) -> DataFrame:
    rows = df.withColumns({c: number(df, c) for c in (lat, lon)})
    columns = {"lat": lat, "lon": lon, "color": color, "size": size, **{h: h for h in hover}}
    return points(rows, columns, key, max_points=max_points)


def point_map(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """All coordinates as double with a flag for impossible ones."""
    a, o = number(df, lat), number(df, lon)
    valid = a.between(-90, 90) & o.between(-180, 180)
    return df.select(a.alias("lat"), o.alias("lon"), valid.alias("valid"))


# ---------------------------------------------------------------- dispatch


@dataclass(frozen=True)
class ChartSpec:
    fields: tuple[str, ...]
    data: Callable[..., DataFrame]
    optional: tuple[str, ...] = ()


SAMPLED = ("key", "max_points")
# One entry per kind: the fields it needs, what makes its rows, the fields it may have.
SPECS = {
    # a row per point
    "scatter": ChartSpec(("x", "y"), scatter, ("color", *SAMPLED)),
    "line": ChartSpec(("x", "y"), line, ("color", *SAMPLED)),
    "scatter3d": ChartSpec(("x", "y", "z"), scatter3d, ("color", *SAMPLED)),
    "line3d": ChartSpec(("x", "y", "z", "order_by"), line3d, ("color", *SAMPLED)),
    "polarscatter": ChartSpec(("theta", "r"), polar_scatter, ("color", "symbol", *SAMPLED)),
    "scattergeo": ChartSpec(("lat", "lon"), scatter_map, ("color", "size", "hover", *SAMPLED)),
    "bubblemap": ChartSpec(("lat", "lon"), scatter_map, ("color", "size", "hover", *SAMPLED)),
    # a row per group, bin or cell
    "box": ChartSpec(("y",), box, ("x",)),
    "violin": ChartSpec(("y",), violin, ("x",)),
    "histogram": ChartSpec(("x",), histogram, ("bins",)),
    "contour": ChartSpec(("x", "y"), density2d, ("bins_x", "bins_y")),
    "histcontour": ChartSpec(("x", "y"), histogram2d, ("bins_x", "bins_y", "color")),
    "bar": ChartSpec(("x",), bar, ("y", "color")),
    "pie": ChartSpec(("names",), pie, ("values",)),
    "polarbar": ChartSpec(("theta", "r"), polar_bar, ("color",)),
    "choropleth": ChartSpec(("locations", "values"), choropleth, ("locationmode", "agg", "color_range", "hover")),
}


def build(kind: str, df: DataFrame, **fields) -> DataFrame:
    """The rows behind one chart kind; blank optional fields are left out."""
    if kind not in SPECS:
        raise ValueError(f"unknown chart kind: {kind}")
    spec = SPECS[kind]
    given = {name: value for name, value in fields.items() if value not in (None, "")}
    absent = [f for f in spec.fields if f not in given]
    if absent:
        raise ValueError(f"{kind} needs {', '.join(absent)}")
    unknown = [f for f in given if f not in spec.fields + spec.optional]
    if unknown:
        raise ValueError(f"{kind} has no field {', '.join(unknown)}")
    return spec.data(df, **given)
