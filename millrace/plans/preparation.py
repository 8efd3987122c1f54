"""Registered queries: profiles, cleaning, imputation, encoding, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import clean, encode, impute, profile, sample, scale
from millrace.plans import sqltext
from millrace.plans.tables import (
    GAPPY_CUSTOMER,
    GAPPY_EVENTS,
    Query,
    gappy_categories,
    gappy_events,
    rounded,
    table,
)

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(source: str, columns: list[str], digits: int = 4) -> str:
    parts = []
    for c in columns:
        r = lambda e: f"round({e}, {digits}) + 0.0"
        parts.append(
            f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std,
            {r(f'min({c})')} AS min, {r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS q50,
            {r(f'quantile_cont({c}, 0.75)')} AS q75, {r(f'max({c})')} AS max FROM {source}"""
        )
    return " UNION ALL ".join(parts)


def describe_numeric(spark: SparkSession, folder: str) -> DataFrame:
    result = profile.describe_numeric(table(spark, folder, "lineitem"), MEASURES)
    return rounded(result, 4, "mean", "std", "min", "q25", "q50", "q75", "max")


def describe_numeric_gaps(spark: SparkSession, folder: str) -> DataFrame:
    result = profile.describe_numeric(gappy_events(spark, folder), ["value", "user_id"])
    return rounded(result, 4, "mean", "std", "min", "q25", "q50", "q75", "max")


def describe_categorical(spark: SparkSession, folder: str) -> DataFrame:
    return profile.describe_categorical(gappy_categories(spark, folder), ["c_mktsegment", "c_nationkey", "c_name"])


def _describe_categorical_sql() -> str:
    parts = []
    for c in ["c_mktsegment", "c_nationkey", "c_name"]:
        parts.append(
            f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS unique,
            first(v ORDER BY n DESC, v) AS top, max(n) AS freq
            FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {GAPPY_CUSTOMER} WHERE {c} IS NOT NULL GROUP BY 1)"""
        )
    return " UNION ALL ".join(parts).replace("AS unique", 'AS "unique"')


def missing_summary(spark: SparkSession, folder: str) -> DataFrame:
    return profile.missing_summary(gappy_events(spark, folder), ["value", "event_type", "props"])


def _missing_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
        round(100.0 * (count(*) - count({c})) / count(*), 1) AS percent FROM {GAPPY_EVENTS}"""
        for c in ["value", "event_type", "props"]
    )


def _correlation_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for a in columns for b in columns
    )


def _moments_sql(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS "column", m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) - 3 AS k FROM (
            SELECT avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM (
            SELECT {c} - (SELECT avg({c}) FROM {source}) AS d FROM {source}))"""
        )
    label = lambda e, up, down, zero: (
        f"CASE WHEN {e} > 0 THEN '{up}' WHEN {e} < 0 THEN '{down}' ELSE '{zero}' END"
    )
    return f"""SELECT "column", round(s, 5) + 0.0 AS skewness, round(k, 5) + 0.0 AS kurtosis,
        {label('s', 'right-skewed', 'left-skewed', 'symmetric')} AS skew_label,
        {label('k', 'leptokurtic', 'platykurtic', 'mesokurtic')} AS kurtosis_label FROM ({' UNION ALL '.join(parts)})"""


def convert(target: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        events = table(spark, folder, "events")
        text = {
            "INT": F.concat(F.lit("$"), F.col("props"), F.lit(" = 1,2"), F.col("user_id").cast("string"), F.lit(".9")),
            "FLOAT": F.when(F.col("event_id") % 11 == 0, F.lit("1.2.3")).otherwise(
                F.concat(F.lit("("), F.col("user_id").cast("string"), F.lit(".25 EUR)"))
            ),
            "STRING": F.when(F.col("event_id") % 7 != 0, F.col("user_id")),
            "DATETIME": F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "MM/dd/yyyy"))
            .when(F.col("event_id") % 5 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
            .when(F.col("event_id") % 5 == 2, F.date_format("ts", "yyyy/MM/dd"))
            .otherwise(F.lit("no date")),
            "BOOLEAN": F.when(F.col("user_id") % 4 == 0, F.lit("YES"))
            .when(F.col("user_id") % 4 == 1, F.lit("n"))
            .when(F.col("user_id") % 4 == 2, F.lit("True")),
        }[target]
        raw = events.select("event_id", text.alias("raw"))
        return clean.convert(raw, "raw", target)

    return run


def convert_dayfirst(spark: SparkSession, folder: str) -> DataFrame:
    """Dates with the day first in two spellings, beside others; days up to the 12th fit the month-first format too."""
    events, kind = table(spark, folder, "events"), F.col("event_id") % 5
    said = ["dd/MM/yyyy", "d/M/yyyy H:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd"]
    raw = F.coalesce(*[F.when(kind == k, F.date_format("ts", f)) for k, f in enumerate(said)], F.lit("31/02/2021"))
    return clean.convert(events.select("event_id", raw.alias("raw")), "raw", "DATETIME")


def convert_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Conversions of numeric columns: truncation toward zero, non-zero as true, nanoseconds as time."""
    customer = table(spark, folder, "customer")
    gaps = customer.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("whole"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("truth"),
        # a bigint holds the nanoseconds of the first 106,751 keys only
        (F.col("c_custkey").cast("decimal(20,0)") * 1_000_000_007 * 86_400).alias("instant"),
    )
    for column, target in (("whole", "INT"), ("truth", "BOOLEAN"), ("instant", "DATETIME")):
        gaps = clean.convert(gaps, column, target)
    return gaps


def conversion_report(spark: SparkSession, folder: str) -> DataFrame:
    before = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    after = clean.convert(clean.convert(before, "c_name", "INT"), "c_mktsegment", "FLOAT")
    return clean.conversion_report(before, after)


def downcast(spark: SparkSession, folder: str) -> DataFrame:
    """Value ranges survive the smaller types; the labels become boolean."""
    labels = table(spark, folder, "labels")
    return clean.downcast(labels)


def _impute(method: str, **more):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        filled = impute.impute(gappy_events(spark, folder), "value", method, **more)
        return rounded(filled.select("event_id", "value"), 4, "value")

    return run


def impute_hot_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Fills along a key that a third of the rows do not have and another third share."""
    key = F.when(F.col("event_id") % 3 == 1, 500).when(F.col("event_id") % 3 == 2, F.col("event_id"))
    events = gappy_events(spark, folder).withColumn("k", key)
    filled = impute.impute(events, "value", "ffill", order_by=["k", "event_id"])
    return rounded(filled.select("event_id", "value"), 4, "value")


HOT_KEYS_SQL = f"""SELECT event_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY k NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS value
    FROM (SELECT event_id, value, CASE event_id % 3 WHEN 1 THEN 500 WHEN 2 THEN event_id END AS k FROM {GAPPY_EVENTS})"""


def impute_text(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts carried over gaps, some of them long."""
    docs = table(spark, folder, "documents")
    gaps = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("text")).alias("text"))
    filled = impute.impute(gaps, "text", "ffill", order_by=["doc_id"])
    return filled.select("doc_id", F.md5("text").alias("digest"))


IMPUTE_TEXT_SQL = """SELECT doc_id, md5(last_value(CASE WHEN doc_id % 4 = 0 THEN text END IGNORE NULLS) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) AS digest FROM documents"""


def _neighbour_sql(expression: str) -> str:
    return f"""SELECT event_id, round({expression}, 4) + 0.0 AS value FROM (SELECT event_id, value,
        last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS pv,
        last_value(CASE WHEN value IS NOT NULL THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS po,
        last_value(value IGNORE NULLS) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS nv,
        last_value(CASE WHEN value IS NOT NULL THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS no
        FROM {GAPPY_EVENTS})"""


def _constant_fill_sql(value: str) -> str:
    return f"SELECT event_id, round(coalesce(value, ({value})), 4) + 0.0 AS value FROM {GAPPY_EVENTS}"


def impute_target(task: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        customers = gappy_categories(spark, folder)
        target = {"regression": "c_nationkey", "number": "c_nationkey", "text": "c_mktsegment"}[task]
        filled, _ = impute.impute_target(customers, target, "regression" if task == "regression" else "classification")
        return filled.select("c_custkey", F.round(target, 6).alias(target) if task == "regression" else F.col(target))

    return run


def encode_columns(columns: list[str], method: str, keep: list[str]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        result = encode.encode(gappy_categories(spark, folder).select(*keep), columns, method)
        return result

    return run


def encode_label_orderkey(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of a key with very many values."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return encode.encode(lines, ["l_orderkey"], "label")


ONEHOT_SQL = f"""SELECT c_custkey, {', '.join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1.0 ELSE 0.0 END AS c_mktsegment_{s}"
    for s in ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])} FROM {GAPPY_CUSTOMER}"""


def _scale(method: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        customer = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
        return rounded(scale.scale(customer, ["c_acctbal", "c_nationkey"], method), 6, "c_acctbal", "c_nationkey")

    return run


def _scale_lines(method: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
        return rounded(scale.scale(lines, ["l_extendedprice"], method), 6, "l_extendedprice")

    return run


SCALE_FORMULAS = {
    "minmax": "({c} - (SELECT min({c}) FROM {t})) / ((SELECT max({c}) FROM {t}) - (SELECT min({c}) FROM {t}))",
    "standard": "({c} - (SELECT avg({c}) FROM {t})) / (SELECT stddev_pop({c}) FROM {t})",
    "robust": "({c} - (SELECT quantile_cont({c}, 0.5) FROM {t})) / ((SELECT quantile_cont({c}, 0.75) FROM {t}) - (SELECT quantile_cont({c}, 0.25) FROM {t}))",
    "maxabs": "{c} / (SELECT max(abs({c})) FROM {t})",
    "log": "CASE WHEN {c} > -1 THEN ln(1 + {c}) END",
}


def _scale_sql(method: str, source: str, keys: str, columns: list[str]) -> str:
    formula = SCALE_FORMULAS[method]
    scaled = ", ".join(f"round({formula.format(c=c, t=source)}, 6) + 0.0 AS {c}" for c in columns)
    return f"SELECT {keys}, {scaled} FROM {source}"


def scale_power(name: str, key: str, column: str, method: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, name).select(key, column)
        return rounded(scale.scale(rows, [column], method), 4, column)

    return run


def scale_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of two columns before and after their standardisation."""
    before = table(spark, folder, "customer").select("c_acctbal", "c_nationkey")
    after = scale.scale(before, ["c_acctbal", "c_nationkey"], "standard")
    return rounded(scale.comparison(before, after, ["c_acctbal", "c_nationkey"]), 6, "mean", "std", "min", "q25", "q50", "q75", "max")


def _comparison_sql() -> str:
    scaled = lambda c: f"(SELECT ({c} - (SELECT avg({c}) FROM customer)) / (SELECT stddev_pop({c}) FROM customer) AS x FROM customer)"
    return " UNION ALL ".join(
        f"""SELECT '{stage}' AS stage, '{c}' AS "column", count(x) AS count, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) + 0.0 AS min,
        round(quantile_cont(x, 0.25), 6) + 0.0 AS q25, round(quantile_cont(x, 0.5), 6) + 0.0 AS q50, round(quantile_cont(x, 0.75), 6) + 0.0 AS q75, round(max(x), 6) + 0.0 AS max FROM {source}"""
        for c in ("c_acctbal", "c_nationkey")
        for stage, source in (("before", f"(SELECT {c}::DOUBLE AS x FROM customer)"), ("after", scaled(c)))
    )


GAPPY_ORDERS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders)"

SCALE_QUANTILE_SQL = f"""WITH q AS (
    SELECT unnest(quantile_cont(o_totalprice, [{', '.join(f'{j}/999.0' for j in range(1000))}])) AS q, unnest(range(1000)) / 999.0 AS r
    FROM {GAPPY_ORDERS}),
  steps AS (SELECT q AS qa, r AS ra, lead(q) OVER (ORDER BY r) AS qb, lead(r) OVER (ORDER BY r) AS rb FROM q),
  spots AS (SELECT q, min(r) AS first_r, max(r) AS last_r FROM q GROUP BY q),
  v AS (SELECT DISTINCT o_totalprice AS x FROM {GAPPY_ORDERS} WHERE o_totalprice IS NOT NULL),
  placed AS (SELECT v.x, CASE WHEN v.x <= (SELECT min(q) FROM q) THEN 0.0 WHEN v.x >= (SELECT max(q) FROM q) THEN 1.0
      WHEN s.q IS NOT NULL THEN (s.first_r + s.last_r) / 2
      ELSE t.ra + (t.rb - t.ra) * (v.x - t.qa) / (t.qb - t.qa) END AS y
    FROM v LEFT JOIN spots s ON s.q = v.x LEFT JOIN steps t ON v.x > t.qa AND v.x < t.qb)
SELECT e.o_orderkey, round(p.y, 5) + 0.0 AS o_totalprice FROM {GAPPY_ORDERS} e LEFT JOIN placed p ON p.x = e.o_totalprice"""


def scale_quantile(spark: SparkSession, folder: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice")
    orders = table(spark, folder, "orders").select("o_orderkey", price)
    return rounded(scale.scale(orders, ["o_totalprice"], "quantile"), 5, "o_totalprice")


def _normal_sql(key: str, seed: int) -> str:
    u = lambda salt: f"(('0x' || substr(md5({key} || ':{salt}'), 1, 13))::BIGINT + 0.5) / pow(2, 52)"
    return f"sqrt(-2 * ln({u(2 * seed)})) * cos(2 * pi() * {u(2 * seed + 1)})"


DRAWN_SQL = f"""SELECT event_id, round(coalesce(value, greatest(0.0, m + s * {_normal_sql('event_id', 42)})), 4) + 0.0 AS value
    FROM {GAPPY_EVENTS}, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM {GAPPY_EVENTS})"""


def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sample.sample_rows(table(spark, folder, "lineitem"), 5000, key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def preview(spark: SparkSession, folder: str) -> DataFrame:
    """What is shown right after loading, as one table: part, column, measure, value."""
    parts = profile.preview(gappy_events(spark, folder).select("event_id", "event_type", "value"), order_by=["event_id"])
    label = lambda part, column, measure, value: F.struct(
        F.lit(part).alias("part"), column.alias("column"), F.lit(measure).alias("measure"), F.round(value.cast("double"), 4).alias("value")
    )
    wanted = [
        ("shape", F.lit(""), ["rows", "columns"]),
        ("missing", F.col("column"), ["missing", "percent"]),
        ("numeric", F.col("column"), ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]),
        ("categorical", F.col("column"), ["count", "unique", "freq"]),
    ]
    result = None
    for part, column, measures in wanted:
        rows = parts[part].select(F.inline(F.array(*[label(part, column, m, F.col(m)) for m in measures])))
        result = rows if result is None else result.unionByName(rows)
    return result


def _preview_sql() -> str:
    row = lambda part, column, measure, value: (
        f"SELECT '{part}' AS part, '{column}' AS \"column\", '{measure}' AS measure, round(({value})::DOUBLE, 4) AS value FROM {GAPPY_EVENTS}"
    )
    rows = [row("shape", "", "rows", "count(*)"), row("shape", "", "columns", "any_value(3)")]
    for c in ("event_id", "event_type", "value"):
        rows += [row("missing", c, "missing", f"count(*) - count({c})"), row("missing", c, "percent", f"round(100.0 * (count(*) - count({c})) / count(*), 1)")]
    for c in ("event_id", "value"):
        numbers = {"count": f"count({c})", "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})"}
        numbers |= {f"q{q}": f"quantile_cont({c}::DOUBLE, 0.{q})" for q in (25, 50, 75)}
        rows += [row("numeric", c, m, v) for m, v in numbers.items()]
    frequent = f"(SELECT max(c) FROM (SELECT count(*) AS c FROM {GAPPY_EVENTS} GROUP BY event_type))"
    counted = {"count": "count(event_type)", "unique": "count(DISTINCT event_type)", "freq": f"any_value({frequent})"}
    return " UNION ALL ".join(rows + [row("categorical", "event_type", m, v) for m, v in counted.items()])


QUERIES = {
    "preview": Query(preview, _preview_sql()),
    "describe_numeric": Query(describe_numeric, _describe_sql("lineitem", MEASURES)),
    "describe_numeric_gaps": Query(describe_numeric_gaps, _describe_sql(GAPPY_EVENTS, ["value", "user_id"])),
    "describe_categorical": Query(describe_categorical, _describe_categorical_sql()),
    "missing_summary": Query(missing_summary, _missing_sql()),
    "table_shape": Query(
        lambda s, d: profile.shape(table(s, d, "lineitem")),
        "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem",
    ),
    "head": Query(
        lambda s, d: profile.head(table(s, d, "orders"), 10, ["o_orderkey"]),
        "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
    ),
    "value_counts": Query(
        lambda s, d: profile.value_counts(table(s, d, "events"), "event_type"),
        "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1",
    ),
    "sum_by_category": Query(
        lambda s, d: rounded(profile.sum_by(gappy_events(s, d), "event_type", "value"), 3, "total"),
        f"SELECT event_type AS value, round(sum(value), 3) AS total FROM {GAPPY_EVENTS} GROUP BY 1",
    ),
    "value_range": Query(
        lambda s, d: profile.value_range(table(s, d, "lineitem"), "l_extendedprice"),
        "SELECT min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem",
    ),
    "cardinality": Query(
        lambda s, d: profile.cardinality(table(s, d, "documents"), ["text", "lang", "source"]),
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique", count(DISTINCT {c}) <= 11 AS low FROM documents"""
            for c in ["text", "lang", "source"]
        ),
    ),
    "most_frequent": Query(
        lambda s, d: profile.most_frequent(table(s, d, "events"), "user_id"),
        "SELECT user_id AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    ),
    "correlation_matrix": Query(
        lambda s, d: rounded(profile.correlation(table(s, d, "lineitem"), MEASURES), 6, "r"), _correlation_sql(MEASURES)
    ),
    "correlation_gaps": Query(
        lambda s, d: rounded(profile.correlation(gappy_events(s, d), ["value", "user_id", "event_id"]), 6, "r"),
        " UNION ALL ".join(
            f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) + 0.0 AS r FROM {GAPPY_EVENTS} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
            for a in ["value", "user_id", "event_id"]
            for b in ["value", "user_id", "event_id"]
        ),
    ),
    "skew_kurtosis": Query(
        lambda s, d: rounded(
            profile.skew_kurtosis(table(s, d, "lineitem"), ["l_extendedprice", "l_discount"]), 5, "skewness", "kurtosis"
        ),
        _moments_sql("lineitem", ["l_extendedprice", "l_discount"]),
    ),
    "duplicate_count": Query(
        lambda s, d: clean.duplicate_count(table(s, d, "documents").select("text")),
        "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_count FROM (SELECT count(*) AS n FROM documents GROUP BY text) WHERE n > 1",
    ),
    "drop_duplicates": Query(
        lambda s, d: clean.drop_duplicates(table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")),
        "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem",
    ),
    "drop_duplicate_documents": Query(
        lambda s, d: clean.drop_duplicates(table(s, d, "documents").select("text", "lang")),
        "SELECT DISTINCT text, lang FROM documents",
    ),
    "convert_int": Query(
        convert("INT"),
        r"""SELECT event_id, TRY_CAST(trunc(TRY_CAST(regexp_replace(props || ' = 1,2' || user_id || '.9', '[^0-9.\-]', '', 'g') AS DOUBLE)) AS BIGINT) AS raw FROM events""",
    ),
    "convert_float": Query(
        convert("FLOAT"), "SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN user_id + 0.25 END AS raw FROM events"
    ),
    "convert_string": Query(
        convert("STRING"), "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(user_id AS VARCHAR) END AS raw FROM events"
    ),
    "convert_datetime": Query(
        convert("DATETIME"),
        """SELECT event_id, CASE WHEN event_id % 5 IN (0, 2) THEN date_trunc('day', ts)
        WHEN event_id % 5 = 1 THEN date_trunc('second', ts) END::TIMESTAMP AS raw FROM events""",
    ),
    "convert_datetime_dayfirst": Query(
        convert_dayfirst,
        """SELECT event_id, CASE event_id % 5 WHEN 1 THEN date_trunc('second', ts) WHEN 4 THEN NULL ELSE date_trunc('day', ts) END::TIMESTAMP AS raw FROM events""",
    ),
    "convert_bool": Query(convert("BOOLEAN"), "SELECT event_id, user_id % 4 IN (0, 2) AS raw FROM events"),
    "convert_numbers": Query(
        convert_numbers,
        """SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN CAST(trunc(c_acctbal) AS BIGINT) END AS whole,
        CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey <> 0 END AS truth,
        make_timestamp(CAST(floor(c_custkey * 1000000007 * 86400 / 1000) AS BIGINT)) AS instant FROM customer""",
    ),
    "conversion_report": Query(
        conversion_report,
        """SELECT * FROM (VALUES (0, 'c_custkey', 'bigint', 'bigint', false), (1, 'c_name', 'string', 'bigint', true),
        (2, 'c_mktsegment', 'string', 'double', true), (3, 'c_acctbal', 'double', 'double', false))
        AS t("position", "column", "before", "after", changed),
        LATERAL (SELECT CAST(0 AS BIGINT) AS missing_before,
          CASE WHEN "column" = 'c_mktsegment' THEN (SELECT count(*) FROM customer) ELSE 0 END AS missing_after)""",
    ),
    "downcast": Query(
        downcast, "SELECT CAST(doc_id AS INTEGER) AS doc_id, quality <> 0 AS quality, toxic <> 0 AS toxic FROM labels"
    ),
    "impute_ffill_hot_keys": Query(impute_hot_keys, HOT_KEYS_SQL),
    "impute_ffill_text": Query(impute_text, IMPUTE_TEXT_SQL),
    "impute_drop": Query(_impute("drop"), f"SELECT event_id, round(value, 4) + 0.0 AS value FROM {GAPPY_EVENTS} WHERE value IS NOT NULL"),
    "impute_value": Query(_impute("specific_value", value=12.5), _constant_fill_sql("12.5")),
    "impute_mean": Query(_impute("mean"), _constant_fill_sql(f"SELECT avg(value) FROM {GAPPY_EVENTS}")),
    "impute_median": Query(_impute("median"), _constant_fill_sql(f"SELECT quantile_cont(value, 0.5) FROM {GAPPY_EVENTS}")),
    "impute_ffill": Query(_impute("ffill", order_by=["event_id"]), _neighbour_sql("coalesce(value, pv)")),
    "impute_bfill": Query(_impute("bfill", order_by=["event_id"]), _neighbour_sql("coalesce(value, nv)")),
    "impute_nearest": Query(
        _impute("nearest_neighbor", order_by=["event_id"]),
        _neighbour_sql("coalesce(value, CASE WHEN no - event_id < event_id - po THEN nv ELSE coalesce(pv, nv) END)"),
    ),
    "impute_nearest_first": Query(
        _impute("nearest_neighbor", order_by=["event_id"], nearest="first"),
        _constant_fill_sql(f"SELECT value FROM {GAPPY_EVENTS} WHERE value IS NOT NULL ORDER BY event_id LIMIT 1"),
    ),
    "impute_interpolate": Query(
        _impute("interpolate", order_by=["event_id"]),
        _neighbour_sql("coalesce(value, pv + (nv - pv) * (event_id - po) / (no - po))"),
    ),
    "impute_distribution": Query(_impute("distribution", key=["event_id"]), DRAWN_SQL),
    "impute_target_mean": Query(
        impute_target("regression"),
        f"""SELECT c_custkey, round(coalesce(c_nationkey, (SELECT avg(c_nationkey) FROM {GAPPY_CUSTOMER})), 6) AS c_nationkey
        FROM {GAPPY_CUSTOMER}""",
    ),
    "impute_target_mode": Query(
        impute_target("number"),
        f"""SELECT c_custkey, coalesce(c_nationkey, (SELECT c_nationkey FROM {GAPPY_CUSTOMER} WHERE c_nationkey IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_nationkey FROM {GAPPY_CUSTOMER}""",
    ),
    "impute_target_text": Query(
        impute_target("text"),
        f"SELECT c_custkey, coalesce(c_mktsegment, 'missing') AS c_mktsegment FROM {GAPPY_CUSTOMER}",
    ),
    "encode_label": Query(
        encode_columns(["c_mktsegment", "c_nationkey"], "label", ["c_custkey", "c_mktsegment", "c_nationkey"]),
        f"""SELECT c_custkey, dense_rank() OVER (ORDER BY coalesce(c_mktsegment, 'nan')) - 1 AS c_mktsegment,
        dense_rank() OVER (ORDER BY c_nationkey NULLS LAST) - 1 AS c_nationkey FROM {GAPPY_CUSTOMER}""",
    ),
    "encode_label_text": Query(
        lambda s, d: encode.encode(table(s, d, "documents").select("doc_id", "text"), ["text"], "label"),
        "SELECT doc_id, dense_rank() OVER (ORDER BY coalesce(text, 'nan')) - 1 AS text FROM documents",
    ),
    "encode_ordinal": Query(
        encode_columns(["c_mktsegment", "c_nationkey"], "ordinal", ["c_custkey", "c_mktsegment", "c_nationkey"]),
        f"""SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY coalesce(c_mktsegment, 'nan')) - 1 AS DOUBLE) AS c_mktsegment,
        CASE WHEN c_nationkey IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY c_nationkey NULLS LAST) - 1 AS DOUBLE) END AS c_nationkey
        FROM {GAPPY_CUSTOMER}""",
    ),
    "encode_onehot": Query(encode_columns(["c_mktsegment"], "onehot", ["c_custkey", "c_mktsegment"]), ONEHOT_SQL),
    "encode_label_orderkey": Query(
        encode_label_orderkey,
        "SELECT dense_rank() OVER (ORDER BY l_orderkey) - 1 AS l_orderkey, l_linenumber, l_quantity FROM lineitem",
    ),
    **{
        f"scale_{m}": Query(_scale(m), _scale_sql(m, "customer", "c_custkey", ["c_acctbal", "c_nationkey"]))
        for m in SCALE_FORMULAS
    },
    **{
        f"scale_{m}_lineitem": Query(
            _scale_lines(m), _scale_sql(m, "lineitem", "l_orderkey, l_linenumber", ["l_extendedprice"])
        )
        for m in ("minmax", "standard", "robust")
    },
    "scale_comparison": Query(scale_comparison, _comparison_sql()),
    "scale_quantile": Query(scale_quantile, SCALE_QUANTILE_SQL),
    "scale_boxcox": Query(
        scale_power("orders", "o_orderkey", "o_totalprice", "boxcox"),
        sqltext.power_fit("orders", "o_orderkey", "o_totalprice", "boxcox", 4),
    ),
    "scale_yeojohnson": Query(
        scale_power("customer", "c_custkey", "c_acctbal", "yeojohnson"),
        sqltext.power_fit("customer", "c_custkey", "c_acctbal", "yeojohnson", 4),
    ),
    "sample_rows": Query(
        sample_rows,
        """SELECT * FROM lineitem ORDER BY ('0x' || substr(md5(l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':42'), 1, 13))::BIGINT LIMIT 5000""",
    ),
}
