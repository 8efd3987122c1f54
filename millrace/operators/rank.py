"""Ranks, positions and quantiles over a global order without a one-task window.

All of these cut the order key into buckets at sketch quantiles. The sketch
weighs rows, so no bucket holds more than about rows / buckets of them, apart
from copies of one value; those are counted before any shuffle, or split along
the next order column and a hash of the row. Windows then run inside buckets and
a table of bucket totals, at most one row per bucket, links them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import bucket_of, constant_array, missing_as_null, number, order_number, quoted
from millrace.operators.quantiles import BRACKET, MAX_BETWEEN, MAX_ROUNDS, SKETCH_ACCURACY
from millrace.operators.shape import bounded
from millrace.session import materialise

MAX_BUCKETS = 4096
#: Groups of at most so many rows are held whole.
FEW_ROWS = 2000
#: Values of small groups that one aggregate may hold in all.
MAX_HELD = 1_000_000
ROWS_PER_BUCKET = 1_000_000
THRESHOLD_ACCURACY = 20000
#: Parts that the rows of one value can be cut into.
SPLITS = 1024


def thresholds(df: DataFrame, values: dict[str, Column]) -> dict[str, list[float]]:
    """Sorted bucket limits per value, repeated where one value fills several buckets."""
    grid = constant_array([i / MAX_BUCKETS for i in range(1, MAX_BUCKETS)])
    aggregates = []
    for name, value in values.items():
        aggregates += [
            F.count(value).alias(f"{name}#count"),
            F.percentile_approx(value, grid, THRESHOLD_ACCURACY).alias(f"{name}#t"),
        ]
    row = df.agg(*aggregates).first()
    return {name: _every(row[f"{name}#t"], row[f"{name}#count"], df.sparkSession) for name in values}


def _every(grid: list[float] | None, n: int, spark: SparkSession) -> list[float]:
    """Those of the grid's quantiles that cut n rows into as many buckets as they need."""
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MAX_BUCKETS, max(parallel, n // ROWS_PER_BUCKET), max(1, n))
    step = max(1, MAX_BUCKETS // wanted)
    return list((grid or [])[step - 1 :: step])


def with_order_bucket(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Add ``_bucket``, a number that never decreases along ``order_by`` (nulls first), and ``_tie``, a hash of the row.

    Rows that share a value, or have none, and fill buckets by themselves are split
    along the next order column, after the last one along the hash, and where whole rows repeat along
    a stored row number: ties may stand in any order. So no value of any column makes a large bucket,
    however many such values there are.
    """
    hashed = F.xxhash64(*[quoted(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])
    levels = [order_number(df, c) for c in order_by] + [F.col("_tie").cast("double")]
    rows, known = df.agg(F.count("*"), F.count(levels[0])).first()
    limits = thresholds(df, {"key": levels[0]})["key"]
    distinct = sorted(set(limits))
    share = max(1, rows // (len(limits) + 1))
    coarse = F.when(levels[0].isNull(), F.lit(0)).otherwise(1 + bucket_of(levels[0], distinct)).cast("bigint")
    data = _opaque(df.withColumns({"_tie": hashed, "_bucket": coarse}))
    if len(distinct) == len(limits) and rows - known <= 2 * share:
        return data
    edge = F.get(constant_array(distinct), F.col("_bucket").cast("int") - 1) if distinct else F.lit(None).cast("double")
    data = data.withColumn("_top", F.when(F.col("_bucket") == 0, True).otherwise(F.coalesce(levels[0] == edge, F.lit(False))))
    for level in levels[1:]:
        if _small_tops(data, share):
            return data.drop("_top")
        data = _split(data, level, share)
    if not _small_tops(data, share):
        # Whole rows repeat: their number tells them apart, and stays what it is once it is stored.
        data = _split(materialise(data.withColumn("_row", F.monotonically_increasing_id())), F.col("_row").cast("double"), share)
    return data.drop("_top")


def _tops(data: DataFrame, share: int, *more: Column) -> DataFrame:
    """The buckets whose last value fills more than two shares, at most half as many as there are buckets."""
    return data.where("_top").groupBy("_bucket").agg(F.count("*").alias("_n"), *more).where(F.col("_n") > 2 * share)


def _small_tops(data: DataFrame, share: int) -> bool:
    return _tops(data, share).isEmpty()


def _split(data: DataFrame, level: Column, share: int) -> DataFrame:
    """Cut the rows that share a bucket's last value along ``level``, where they fill more than two shares.

    A bucket of n rows is cut at n / share places, so all cuts together are fewer than twice the buckets: that is
    what the broadcast holds.
    """
    grid = constant_array([k / SPLITS for k in range(1, SPLITS)])
    cut = _tops(data, share, F.percentile_approx(level, grid, THRESHOLD_ACCURACY).alias("_cut"))
    step = F.greatest(F.lit(1), F.floor(F.lit(SPLITS * share) / F.col("_n"))).cast("int")
    some = F.filter("_cut", lambda x, k: k % step == step - 1)
    cut = cut.select("_bucket", F.array_sort(F.array_distinct(some)).alias("_cut"))
    data = data.join(F.broadcast(cut), "_bucket", "left")
    split = F.col("_top") & F.col("_cut").isNotNull()
    below = F.size(F.filter("_cut", lambda x: x < level))
    place = F.when(split, F.when(level.isNull(), 1).otherwise(2 + below)).otherwise(0)
    top = split & F.coalesce(level.isNull() | (level == F.get("_cut", below)), F.lit(False))
    return _opaque(data.withColumns({"_bucket": F.col("_bucket") * (SPLITS + 2) + place, "_top": top}).drop("_cut"))


def _opaque(data: DataFrame) -> DataFrame:
    """``_bucket`` without the expression behind it.

    Of a self-join on a projected expression with a lambda the optimizer infers a filter for the side that lacks its columns.
    """
    return data.withColumn("_bucket", F.explode(F.array("_bucket")))


def ordering(df: DataFrame, order_by: Sequence[str]) -> list[Column]:
    return [*[missing_as_null(df, c).asc_nulls_first() for c in order_by], F.col("_tie").asc()]


def with_position(df: DataFrame, order_by: Sequence[str], name: str = "position") -> DataFrame:
    """Number the rows 0, 1, 2, … along ``order_by``."""
    bucketed = with_order_bucket(df, order_by)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    starts = totals.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy(*ordering(df, order_by))
    numbered = bucketed.withColumn("_row", F.row_number().over(inside))
    joined = numbered.join(F.broadcast(starts), "_bucket")
    return joined.select(*[quoted(c) for c in df.columns], (F.col("_start") + F.col("_row") - 1).alias(name))


def ranked(
    df: DataFrame, value: Column, by: Column | None = None, weight: Column | None = None
) -> DataFrame:
    """Distinct values with their place in the whole sorted table.

    One row per distinct (``by``, value): ``cnt`` rows hold it, ``ties`` rows of
    any group share the value, ``before`` rows lie below it, ``midrank`` is the
    average 1-based rank of the tied rows and ``n`` the number of rows in all.

    Only the distinct values are ranked; the groups that hold a value join it afterwards, so a value of very many
    groups is one row of a window, however many there are.
    """
    keyed = df.select(
        value.cast("double").alias("value"),
        (by if by is not None else F.lit(None).cast("string")).alias("grp"),
        (weight if weight is not None else F.lit(1)).cast("bigint").alias("_w"),
    ).where("value is not null")
    limits = thresholds(keyed, {"value": F.col("value")})["value"]
    counts = keyed.groupBy("value", *(["grp"] if by is not None else [])).agg(F.sum("_w").alias("cnt"))
    distinct = counts.groupBy("value").agg(F.sum("cnt").alias("ties")) if by is not None else counts.withColumnRenamed("cnt", "ties")
    placed = _placed(distinct.withColumn("_bucket", bucket_of(F.col("value"), sorted(set(limits)))))
    if by is None:
        counts = placed.withColumns({"cnt": F.col("ties"), "grp": F.lit(None).cast("string")})
    else:
        counts = counts.join(placed, "value")
    return counts.select("grp", "value", "cnt", "ties", "before", "midrank", "n")


def ranked_columns(df: DataFrame, values: dict[str, Column], hits: dict[str, Column] | None = None) -> DataFrame:
    """The distinct values of many columns with their places, from one scan and one ranking: column, value, ties, hits, before, midrank, n.

    ``hits`` counts the rows of a value for which a column's condition holds. The counts per value are stored, so ``df`` is
    read once; buckets are cut at quantiles of the distinct values, which are what the windows hold.
    """
    hit = lambda c: F.coalesce(hits[c] if hits else F.lit(False), F.lit(False)).alias("hit")
    entries = F.array(*[F.struct(F.lit(i).alias("_c"), v.cast("double").alias("value"), hit(c)) for i, (c, v) in enumerate(values.items())])
    counts = df.select(F.inline(entries)).where("value is not null").groupBy("_c", "value")
    counts = materialise(counts.agg(F.count("*").alias("ties"), F.count_if("hit").alias("hits")))
    grid = constant_array([i / MAX_BUCKETS for i in range(1, MAX_BUCKETS)])
    sketched = counts.groupBy("_c").agg(F.count("*").alias("n"), F.percentile_approx("value", grid, THRESHOLD_ACCURACY).alias("t"))
    limits = {r["_c"]: sorted(set(_every(r["t"], r["n"], df.sparkSession))) for r in sketched.collect()}
    bucket = F.coalesce(*[F.when(F.col("_c") == i, bucket_of(F.col("value"), t)) for i, t in limits.items()], F.lit(0))
    names = F.array(*[F.lit(c) for c in values])
    placed = _placed(counts.withColumn("_bucket", bucket), "_c").withColumn("column", F.get(names, "_c"))
    return placed.select("column", "value", "ties", "hits", "before", "midrank", "n")


def _placed(distinct: DataFrame, *lead: str) -> DataFrame:
    """Distinct values (lead columns, value, ties, _bucket) with before, midrank and n."""
    totals = distinct.groupBy(*lead, "_bucket").agg(F.sum("ties").alias("_n"))
    line = Window.partitionBy(*lead).orderBy("_bucket")
    starts = totals.select(
        *lead,
        "_bucket",
        (F.sum("_n").over(line) - F.col("_n")).alias("_start"),
        F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
    )
    upto = Window.partitionBy(*lead, "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        distinct.withColumn("_upto", F.sum("ties").over(upto))
        .join(F.broadcast(starts), [*lead, "_bucket"])
        .withColumn("before", F.col("_start") + F.col("_upto") - F.col("ties"))
        .withColumn("midrank", F.col("before") + (F.col("ties") + 1) / 2)
        .drop("_bucket", "_upto", "_start")
    )


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Iterable[float]
) -> DataFrame:
    """Exact quantiles of ``value`` per group: keys, n and q0, q1, … in the order given.

    Where the table of groups is small enough to broadcast, a sketch per group brackets every
    wanted rank and a second scan picks it among the few rows inside, as for
    whole columns: both scans combine before the shuffle. With more groups, or groups too large
    for that, rows are counted per distinct value.
    """
    probabilities = list(probabilities)
    keyed = df.select(*keys, number(df, value).alias("_v")).where("_v is not null")
    found = _bracketed_quantiles(keyed, keys, probabilities)
    return found if found is not None else _counted_quantiles(keyed, keys, probabilities)


def _bracketed_quantiles(keyed: DataFrame, keys: Sequence[str], probabilities: list[float]) -> DataFrame | None:
    """Quantiles by a bracket per group, in two scans; None where groups are too many or too large, or a bracket misses."""
    ends = sorted({min(1.0, max(0.0, p + s)) for p in probabilities for s in (-BRACKET, BRACKET)})
    groups = keyed.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", constant_array(ends), SKETCH_ACCURACY).alias("_ends"),
    )
    groups, small = bounded(groups)
    most = groups.agg(F.max("n"), F.sum(F.least("n", F.lit(FEW_ROWS)))).first()
    if not small or most[0] is not None and (4 * most[0] * (BRACKET + 1 / SKETCH_ACCURACY) > MAX_BETWEEN or most[1] > MAX_HELD):
        return None
    low, high = {}, {}
    for i, p in enumerate(probabilities):
        few = F.col("n") <= FEW_ROWS
        low[f"_low{i}"] = F.when(few | F.lit(p <= BRACKET), F.col("_min")).otherwise(F.get("_ends", F.lit(ends.index(max(0.0, p - BRACKET)))))
        high[f"_high{i}"] = F.when(few | F.lit(p >= 1 - BRACKET), F.col("_max")).otherwise(F.get("_ends", F.lit(ends.index(min(1.0, p + BRACKET)))))
    v, aggregates = F.col("_v"), []
    for i in range(len(probabilities)):
        a, b = F.col(f"_low{i}"), F.col(f"_high{i}")
        aggregates += [
            F.count_if(v < a).alias(f"_below{i}"), F.count_if(v == a).alias(f"_on{i}"), F.max(a).alias(f"_a{i}"), F.max(b).alias(f"_b{i}"),
            F.array_sort(F.collect_list(F.when((v > a) & (v < b), v))).alias(f"_in{i}"), F.count_if((v == b) & (b > a)).alias(f"_top{i}"),
        ]
    near = keyed.join(F.broadcast(groups.withColumns({**low, **high}).drop("_ends", "_min", "_max")), list(keys))
    counted = near.groupBy(*keys).agg(F.max("n").alias("n"), *aggregates)
    picked = {}
    for i, p in enumerate(probabilities):
        place = (F.col("n") - 1) * F.lit(float(p))
        below, on, inner, top = (F.col(f"_{name}{i}") for name in ("below", "on", "in", "top"))

        def at(rank: Column, i=i, below=below, on=on, inner=inner, top=top) -> Column:
            start = below + on
            return (
                F.when((rank >= below) & (rank < start), F.col(f"_a{i}"))
                .when((rank >= start) & (rank < start + F.size(inner)), F.get(inner, (rank - start).cast("int")))
                .when((rank >= start + F.size(inner)) & (rank < start + F.size(inner) + top), F.col(f"_b{i}"))
            )

        first, second, weight = at(F.floor(place)), at(F.ceil(place)), place - F.floor(place)
        picked[f"q{i}"] = F.when(weight == 0, first).otherwise(first + (second - first) * weight)
    result, _ = bounded(counted.select(*keys, "n", *[c.alias(name) for name, c in picked.items()]))
    missed = result.where(" or ".join(f"q{i} is null" for i in range(len(probabilities))))
    return result if missed.isEmpty() else None


def _counted_quantiles(keyed: DataFrame, keys: Sequence[str], probabilities: list[float]) -> DataFrame:
    """Rows are counted per distinct value first; only the buckets that hold a wanted rank are
    then sorted, so a group that owns most rows is spread over all buckets."""
    limits = sorted(set(thresholds(keyed, {"v": F.col("_v")})["v"]))
    counts = (
        keyed.groupBy(*keys, "_v")
        .agg(F.count("*").alias("_cnt"))
        .withColumn("_bucket", bucket_of(F.col("_v"), limits))
    )
    totals = counts.groupBy(*keys, "_bucket").agg(F.sum("_cnt").alias("_rows"))
    line = Window.partitionBy(*keys).orderBy("_bucket")
    everything = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.floor((F.col("n") - 1) * p).alias("first"))
            for i, p in enumerate(probabilities)
        ]
    )
    places = (
        totals.withColumn("n", F.sum("_rows").over(everything))
        .withColumn("_start", F.sum("_rows").over(line) - F.col("_rows"))
        .withColumn("_want", F.explode(wanted))
        .select(*keys, "_bucket", "n", "_start", "_rows", "_want.*")
        .withColumn("second", F.least(F.col("first") + 1, F.col("n") - 1))
        .where("(first >= _start and first < _start + _rows) or (second >= _start and second < _start + _rows)")
    )
    run = Window.partitionBy(*keys, "_bucket", "i").orderBy("_v")
    hit = (
        counts.join(places, [*keys, "_bucket"])
        .withColumn("_end", F.col("_start") + F.sum("_cnt").over(run))
        .withColumn("_from", F.col("_end") - F.col("_cnt"))
    )
    at = lambda rank: F.max(F.when((F.col(rank) >= F.col("_from")) & (F.col(rank) < F.col("_end")), F.col("_v")))
    picked = hit.groupBy(*keys, "i", "p").agg(
        F.max("n").alias("n"), F.max("first").alias("first"), at("first").alias("_a"), at("second").alias("_b")
    )
    weight = (F.col("n") - 1) * F.col("p") - F.col("first")
    exact = F.when(weight == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * weight)
    return picked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("i") == i, exact)).alias(f"q{i}") for i in range(len(probabilities))],
    )


def quantile_grid(df: DataFrame, value: Column, points: int) -> list[float]:
    """Exact quantiles at j / (points - 1) for every j, without a shuffle of the column.

    A sketch gives two ends around every wanted rank. All ends together cut the numbers into points and gaps; one scan counts the
    rows of each, so the gaps that hold a wanted rank are known, and another scan picks the ranks inside these. A gap with
    more rows than a task should hold gets ends of its own from a sketch of its rows, and is counted again.
    """
    data = df.select(value.cast("double").alias("v")).where("v is not null")
    wanted = [j / (points - 1) for j in range(points)]
    shares = sorted({min(1.0, max(0.0, p + s)) for p in wanted for s in (-BRACKET, BRACKET)})
    row = data.agg(F.count("v").alias("n"), F.percentile_approx("v", constant_array(shares), SKETCH_ACCURACY).alias("ends")).first()
    n, ends = row["n"], set(row["ends"] or [])
    ranks = sorted({r for p in wanted for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))})
    for _ in range(MAX_ROUNDS):
        found, gaps = _ranks_on_ends(data, sorted(ends), ranks)
        wide = {g: at for g, at in gaps.items() if at["rows"] > MAX_BETWEEN}
        if not wide:
            break
        ends |= _ends_inside(data, sorted(ends), wide)
    else:
        raise RuntimeError("the quantile search did not settle")
    found |= _ranks_in_gaps(data, sorted(ends), gaps)
    result = []
    for p in wanted:
        first, second, weight = math.floor((n - 1) * p), math.ceil((n - 1) * p), (n - 1) * p - math.floor((n - 1) * p)
        result.append(found[first] + (found[second] - found[first]) * weight if weight else found[first])
    return result


def _with_cell(data: DataFrame, ends: list[float]) -> DataFrame:
    """``data`` with where ``v`` lies among sorted ends: 2 k + 1 on the k-th of them, 2 k in the gap before it.

    The search is generated, so that it runs once a row, however often its result is read.
    """
    placed = data.withColumn("_k", F.explode(F.array(bucket_of(F.col("v"), ends))))
    on = F.when(F.get(constant_array(ends), F.col("_k")) == F.col("v"), 1).otherwise(0)
    return placed.withColumn("cell", (2 * F.col("_k") + on).cast("int")).drop("_k")


def _ranks_on_ends(data: DataFrame, ends: list[float], ranks: list[int]) -> tuple[dict[int, float], dict[int, dict]]:
    """The wanted ranks that fall on an end, and per gap that holds others its rows and the ranks inside it, from 0."""
    counts = {r["cell"]: r["n"] for r in _with_cell(data, ends).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    found, gaps, start, left = {}, {}, 0, iter(ranks)
    rank = next(left, None)
    for cell in sorted(counts):
        while rank is not None and rank < start + counts[cell]:
            if cell % 2:
                found[rank] = ends[cell // 2]
            else:
                gaps.setdefault(cell, {"rows": counts[cell], "start": start, "ranks": []})["ranks"].append(rank - start)
            rank = next(left, None)
        start += counts[cell]
    return found, gaps


def _in_gaps(data: DataFrame, ends: list[float], gaps: dict[int, dict]) -> DataFrame:
    return _with_cell(data, ends).where(f"cell IN ({', '.join(map(str, gaps))})")


def _ends_inside(data: DataFrame, ends: list[float], gaps: dict[int, dict]) -> set[float]:
    """New ends around the wanted ranks of each gap, by a sketch of its rows."""
    new, room = set(), 4 / SKETCH_ACCURACY
    shares = {g: sorted({min(1.0, max(0.0, r / max(1, at["rows"] - 1) + s)) for r in at["ranks"] for s in (-room, room)}) for g, at in gaps.items()}
    every = sorted({p for q in shares.values() for p in q})
    sketched = _in_gaps(data, ends, gaps).groupBy("cell").agg(F.percentile_approx("v", constant_array(every), SKETCH_ACCURACY).alias("at"))
    for r in sketched.collect():
        own = set(shares[r["cell"]])
        new |= {x for p, x in zip(every, r["at"], strict=True) if p in own}
    return new


def _ranks_in_gaps(data: DataFrame, ends: list[float], gaps: dict[int, dict]) -> dict[int, float]:
    """The wanted ranks inside gaps of few rows each."""
    if not gaps:
        return {}
    rows = [(g, r, r + at["start"]) for g, at in gaps.items() for r in at["ranks"]]
    asked = data.sparkSession.createDataFrame(rows, "cell int, place int, rank bigint")
    held = _in_gaps(data, ends, gaps).groupBy("cell").agg(F.array_sort(F.collect_list("v")).alias("held"))
    picked = held.join(F.broadcast(asked), "cell").select("rank", F.get("held", F.col("place")).alias("v"))
    return {r["rank"]: r["v"] for r in picked.collect()}


def distinct_positions(distinct: DataFrame, value: str, name: str = "code") -> DataFrame:
    """Number distinct values of any sortable type 0, 1, 2, … in ascending order.

    The range-partitioned sort is written out once, so that the partition each
    value landed in is fixed before it is used as an offset.
    """
    placed = materialise(distinct.orderBy(F.col(value).asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    line = Window.orderBy("_part")
    starts = totals.select("_part", (F.sum("_n").over(line) - F.col("_n")).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(F.col(value).asc_nulls_last())
    return placed.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(starts), "_part").select(
        *distinct.columns, (F.col("_start") + F.col("_row") - 1).alias(name)
    )
