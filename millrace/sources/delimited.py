"""CSV and Parquet in, CSV, Parquet and JSON out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import missing_as_null, quoted

# Cell texts that mean "missing", and the spellings of the two truth values.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]


def load_csv(
    spark: SparkSession, path: str, multiline: bool = False, repair_header: bool = False, infer: bool = True
) -> DataFrame:
    """Read CSV with a header line; types are inferred from all rows.

    Blank lines are passed over, also before the header. A header of only blank
    cells is data: columns become column_0, column_1, … and the line stays as a
    row of missing values. With ``repair_header`` a header of only single letters gives
    way to the first data row. Cells with line breaks, also in the header, need ``multiline``.
    """
    reader = spark.read.option("multiLine", multiline).option("escape", '"')
    first = [[c or "" for c in r] for r in reader.option("header", False).csv(path).limit(2).collect()]
    reader = spark.read.option("multiLine", multiline).option("escape", '"')
    if not first:
        raise ValueError(f"no header in '{path}'")
    cells = first[0]
    if not any(c.strip() for c in cells):
        table = reader.schema(_text_schema([f"column_{i}" for i in range(len(cells))])).csv(path)
    else:
        names = header_names(cells)
        table = reader.option("header", True).schema(_text_schema(names)).csv(path)
        if repair_header and all(len(c) == 1 and c.isalpha() for c in cells):
            table = _promote_first_row(table, first[1] if len(first) > 1 else [])
    return infer_types(table) if infer else table


def _promote_first_row(table: DataFrame, first: Sequence[str]) -> DataFrame:
    """Use the first data row as the header; later rows with the same texts stay."""
    if len(first) != len(table.columns) or not all(first):
        return table
    same = F.lit(True)
    for c, text in zip(table.columns, first, strict=True):
        same = same & quoted(c).eqNullSafe(F.lit(text))
    again = table.where(same).count() - 1
    copies = table.sparkSession.range(again).select(*[F.lit(t).alias(c) for c, t in zip(table.columns, first, strict=True)])
    return table.where(~same).unionByName(copies).toDF(*header_names(first))


def header_names(cells: Sequence[str]) -> list[str]:
    """Names for header cells: blank ones by position, taken ones numbered until the name is free, whatever its case."""
    names: list[str] = []
    taken: set[str] = set()
    for i, cell in enumerate(cells):
        name = start = cell if cell.strip() else f"Unnamed: {i}"
        number = 0
        while name.lower() in taken:
            number += 1
            name = f"{start}.{number}"
        taken.add(name.lower())
        names.append(name)
    return names


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def infer_types(df: DataFrame) -> DataFrame:
    """Type every text column: bigint, double, boolean or text, whichever fits all its values.

    One aggregate over the table decides for all columns. A whole-number column
    with missing values becomes double, and so does an empty one.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    known = {c: F.when(~quoted(c).isin(MISSING_TOKENS), quoted(c)) for c in texts}
    aggregates = [F.count("*").alias("rows")]
    for i, c in enumerate(texts):
        v, trimmed = known[c], F.trim(known[c])
        aggregates += [
            F.count(v).alias(f"known{i}"),
            F.count(F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("bigint"))).alias(f"whole{i}"),
            F.count(_double(trimmed)).alias(f"real{i}"),
            F.count_if(v.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"truth{i}"),
        ]
    row = df.agg(*aggregates).first()
    changes = {}
    for i, c in enumerate(texts):
        n, v = row[f"known{i}"], known[c]
        if n == row["rows"] and row[f"whole{i}"] == n and n:
            changes[c] = F.trim(v).try_cast("bigint")
        elif row[f"real{i}"] == n:
            changes[c] = _double(F.trim(v))
        elif row[f"truth{i}"] == n == row["rows"]:
            changes[c] = v.isin(TRUE_TOKENS)
        else:
            changes[c] = v
    return df.withColumns(changes)


def _double(text: Column) -> Column:
    """A number in plain or scientific notation; words such as NaN or Infinity and suffixes do not count."""
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def load_parquet(spark: SparkSession, path: str, tighten: bool = False) -> DataFrame:
    """Read Parquet; ``tighten`` also types text columns that hold only numbers."""
    df = spark.read.parquet(path)
    df = df.withColumns(
        {f.name: missing_as_null(df, f.name) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    )
    return infer_types(df) if tighten else df


def save_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def save_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row; NaN and infinite numbers become null, times are ISO texts."""
    columns = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
        columns.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def save_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_rows(df).write.mode(mode).text(path)
