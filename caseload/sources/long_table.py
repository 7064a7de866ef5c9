"""Long observation tables (``date, SERVICE, valeur``): CSV source and sink."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.operators.lookup import attach
from caseload.operators.series import by_date
from caseload.session import materialise

REQUIRED = ("date", "SERVICE", "valeur")
# More kinds of header than this in one folder are refused: each is a scan of its own.
MAX_HEADERS = 100


def text_schema(columns: list[str]) -> T.StructType:
    """All-text schema, so that every value reaches our own coercions unchanged."""
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the CSV, read from one header line."""
    first = spark.read.option("header", True).csv(path, enforceSchema=False).limit(0)
    return first.columns


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """``file, header, lines``: the first line of every file, and how many it has.

    The text is read once; lines combine per file before anything is shuffled.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("place"),
        "value",
    )
    return lines.groupBy("file").agg(F.min_by("value", "place").alias("header"), F.count(F.lit(1)).alias("lines"))


def read_long_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, mixed_headers: bool = False
) -> DataFrame:
    """SRC-4: read a long CSV; refuse one without the required columns or rows.

    Extra columns are kept. Without a schema every column is read as text: the
    file is never scanned to guess types. Columns are taken by name, in the order
    of the file. A folder whose files disagree on their header is refused when it is
    read, unless ``mixed_headers`` is set: then the headers are collected in a pass
    of their own, each kind of header is read by itself and all are united by name;
    a column that a file lacks is null in its rows.
    """
    if mixed_headers:
        df = _read_by_header(spark, path, schema)
    else:
        names = csv_header(spark, path)
        df = spark.read.schema(_typed(names, schema)).option("header", True).csv(path, enforceSchema=False)
    if schema:
        df = df.select(*[f"`{name}`" for name in schema.fieldNames() if name in df.columns])
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def _typed(names: list[str], schema: T.StructType | None) -> T.StructType:
    """The columns of a header, as text unless the schema types them."""
    missing = [name for name in REQUIRED if name not in names]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    typed = {field.name: field for field in schema.fields} if schema else {}
    return T.StructType([typed.get(field.name, field) for field in text_schema(names).fields])


def _read_by_header(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    files = materialise(file_headers(spark, path), "headers")
    kinds = [row["header"] for row in files.select("header").distinct().limit(MAX_HEADERS + 1).collect()]
    if len(kinds) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} kinds of header in {path}")
    if not kinds:
        raise ValueError(f"no rows in {path}")
    parts = []
    for header in sorted(kinds):
        names = next(csv.reader([header]))
        rows = spark.read.schema(_typed(names, schema)).option("header", True).csv(path)
        if len(kinds) > 1:
            own = files.where(F.col("header") == header).select(F.col("file").alias("_file"), "lines")
            rows = attach(rows.withColumn("_file", F.col("_metadata.file_path")), own, ["_file"], "lines").select(*[f"`{n}`" for n in names])
        parts.append(rows)
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part, allowMissingColumns=True)
    return df


def write_long_csv(df: DataFrame, path: str) -> str:
    """SNK-1, SRT-1: write long rows as CSV ordered by date; refuse an empty table.

    The sort is a range shuffle over many files, in date order across them.
    """
    if df.isEmpty():
        raise ValueError("nothing to write")
    (
        by_date(df.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "SERVICE", "valeur"))
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )
    return path
