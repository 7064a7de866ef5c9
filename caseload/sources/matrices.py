"""Yearly matrix files (one row per indicator, one column per month) to long rows.

All files are read together. Lines keep their order through the pair (block start
of the file split, row id inside the scan), so a file of any size is split over
many tasks; nothing is grouped into one row or one task per file. What is joined
back to the lines is one small row per file: it is written first, so that header
detection runs once and the planner knows the table's size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.functions.rules import DEFAULT_YEAR, HEADER_MONTHS, LABEL_WORDS, MISSING_CELLS, MONTH_SPELLINGS
from caseload.functions.text import (
    at_least,
    is_blank,
    month_number,
    month_start,
    numeric,
    strip,
    year_from_name,
)
from caseload.session import materialise

MONTH_OF = {word: n for n, words in MONTH_SPELLINGS.items() for word in words}


def split_cells(line: Column, sep: str = ",") -> Column:
    """Cells of one delimited line; quoted cells may hold the separator."""
    mark = re.escape(sep)
    # A leading separator gives every cell the same form: separator, then text.
    quoted = F.transform(
        F.regexp_extract_all(
            F.concat(F.lit(sep), line), F.lit(rf'{mark}("(?:[^"]|"")*"|[^{mark}]*)'), F.lit(1)
        ),
        lambda cell: F.when(
            cell.startswith('"'),
            F.replace(F.regexp_replace(cell, r'\A"|"\z', ""), F.lit('""'), F.lit('"')),
        ).otherwise(cell),
    )
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, mark, -1))


def data_cells(line: Column, sep: str = ",") -> Column:
    """Cells of a data row; the usual texts for "missing" become null."""
    return F.transform(split_cells(line, sep), lambda c: F.when(~c.isin(*MISSING_CELLS), c))


def _file_url() -> Column:
    """The file of a scanned row; local URLs are written with one slash."""
    return F.replace(F.col("_metadata.file_path"), F.lit("file:///"), F.lit("file:/")).alias("file")


def read_lines(spark: SparkSession, paths: Sequence[str], encoding: str = "utf-8") -> DataFrame:
    """Lines of text files with their place: ``file, block, pos, line``.

    The places are those of one scan. Spark cuts files by the cores it has at that
    moment, so the lines are written once and every later step reads that copy.
    """
    text = spark.read.option("encoding", encoding).text(list(paths))
    lines = text.select(
        _file_url(),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.regexp_replace("value", "\\A\ufeff", "").alias("line"),
    )
    return materialise(lines, "lines")


def _headers(lines: DataFrame, sep: str, header_rows: int) -> DataFrame:
    """One row per file: where its header row is, or null if it has none in time.

    The row number of the header is rebuilt from the line count of every file
    split. Counting keeps only numbers per split, so it is a hash aggregate over
    the scan; texts are kept for the few candidate lines alone.
    """
    splits = lines.groupBy("file", "block").agg(
        F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("line_count")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn(
        "rows_before", F.coalesce(F.sum("line_count").over(earlier), F.lit(0))
    )
    is_header = F.exists(
        split_cells(F.col("line"), sep), lambda c: F.upper(strip(c)).isin(*HEADER_MONTHS)
    )
    first = (
        lines.where(is_header)
        .groupBy("file")
        .agg(F.min(F.struct("block", "pos", "line")).alias("header"))
        .select("file", "header.*")
    )
    row_no = F.col("rows_before") + F.col("pos") - F.col("first_pos")
    in_time = (
        splits.join(first, ["file", "block"])
        .where(row_no < header_rows)
        .select(
            "file",
            F.col("block").alias("header_block"),
            F.col("pos").alias("header_pos"),
            split_cells(F.col("line"), sep).alias("names"),
        )
    )
    return splits.select("file").distinct().join(in_time, "file", "left")


def _described(headers: DataFrame, default_year: int, year_of: Callable[[Column], Column] | None) -> DataFrame:
    """Add the year, the month columns and the keyword label column of every file."""
    names = F.transform("names", lambda c: F.upper(strip(c)))
    # The scan names files as URLs: undo the escapes, their digits are no year.
    path = F.coalesce(F.try_url_decode("file"), "file")
    year = year_of(path).cast("int") if year_of else year_from_name(path, default_year)
    # A name that repeats word for word is a copy of the first column, not a month.
    months = F.filter(
        F.transform(
            F.col("names"),
            lambda c, i: F.struct(
                i.alias("at"),
                F.when(F.array_position("names", c) == i + 1, month_number(c)).alias("month"),
            ),
        ),
        lambda s: s["month"].isNotNull(),
    )
    keyword = F.filter(
        F.transform(
            names,
            lambda c, i: F.when(
                F.greatest(*[c.contains(word) for word in LABEL_WORDS]), i
            ),
        ),
        lambda i: i.isNotNull(),
    )
    return headers.select(
        "*",
        F.coalesce(year, F.lit(default_year)).alias("year"),
        months.alias("months"),
        F.try_element_at(keyword, F.lit(1)).alias("keyword_at"),
    ).withColumn(
        "reason",
        F.when(F.col("names").isNull(), F.lit("no header row with a month name")).when(
            F.size(F.array_distinct("months.month")) < F.size("months"),
            F.lit("two columns of the same month"),
        ),
    )


def _body(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines after the header row of their file, with the file's description."""
    after = (F.col("block") > F.col("header_block")) | (
        (F.col("block") == F.col("header_block")) & (F.col("pos") > F.col("header_pos"))
    )
    return lines.join(headers, "file").where(after)


def label_column(body: DataFrame, sep: str = ",") -> DataFrame:
    """PRJ-2 fallback: per file, the first column that holds any non-numeric text.

    The minimum over rows of a row's first text cell is the answer, so the
    aggregate combines before the shuffle and no cell is exploded.
    """
    cells = data_cells(F.col("line"), sep)
    text_at = F.filter(
        F.transform(cells, lambda c, i: F.when(~is_blank(c) & numeric(c).isNull(), i)),
        lambda i: i.isNotNull(),
    )
    first = F.try_element_at(text_at, F.lit(1))
    return body.groupBy("file").agg(F.min(first).alias("text_at"))


def parse_matrices(
    lines: DataFrame,
    default_year: int = DEFAULT_YEAR,
    header_rows: int = 10,
    sep: str = ",",
    keep: bool = False,
    year_of: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """SRC-1/2, PRJ-1/2/3/5/7, FLT-1/2, RSH-1 on ``file, block, pos, line`` rows.

    Returns ``(date, SERVICE, valeur)`` rows of all good files and
    ``(file, reason)`` of the rejected ones. ``keep`` writes the rows once, for
    callers that use them more than once: the text is then parsed only here.
    ``year_of`` takes the year from a file's path in another way than by its name.
    """
    long, errors, _ = _parse(lines, default_year, header_rows, sep, keep, year_of)
    return long, errors


def _parse(
    lines: DataFrame,
    default_year: int,
    header_rows: int,
    sep: str,
    keep: bool,
    year_of: Callable[[Column], Column] | None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long rows, rejected files, and all files that hold a line."""
    described = materialise(
        _described(_headers(lines, sep, header_rows), default_year, year_of), "headers"
    )
    good = described.where(F.col("reason").isNull())
    placed = good.withColumn("label_at", F.col("keyword_at"))
    unnamed = good.where(F.col("keyword_at").isNull())
    if not unnamed.isEmpty():
        guessed = label_column(_body(lines, unnamed), sep)
        label_at = F.coalesce("keyword_at", "text_at", F.lit(0))
        placed = materialise(
            good.join(guessed, "file", "left").select("*", label_at.alias("label_at")), "labels"
        )
    rows = _body(lines, placed).select(
        "file",
        "year",
        "months",
        "label_at",
        data_cells(F.col("line"), sep).alias("cells"),
    )
    label = F.get(F.col("cells"), F.col("label_at"))
    measured = rows.where(~is_blank(label)).select(
        "file",
        "year",
        label.alias("SERVICE"),
        F.inline(
            F.transform(
                "months",
                lambda m: F.struct(
                    m["month"].alias("month"), F.get(F.col("cells"), m["at"]).alias("cell")
                ),
            )
        ),
    )
    long = measured.select(
        "file",
        month_start(F.col("year"), F.col("month")).alias("date"),
        "SERVICE",
        numeric(F.col("cell"), min_value=0).alias("valeur"),
    ).dropna(subset=["valeur", "date"])
    if keep:
        long = materialise(long, "long")
    no_data = (
        good.select("file")
        .join(long.select("file").distinct(), "file", "left_anti")
        .select("file", F.lit("no usable value").alias("reason"))
    )
    errors = described.where(F.col("reason").isNotNull()).select("file", "reason")
    return long.select("date", "SERVICE", "valeur"), errors.unionByName(no_data), described.select("file")


def _existing(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """Split the caller's path list by whether anything is there."""
    there, missing = [], []
    for path in paths:
        try:
            spark.read.text(path)
            there.append(path)
        except AnalysisException:
            missing.append(path)
    return there, missing


def _unread_files(spark: SparkSession, paths: Sequence[str], seen: DataFrame) -> DataFrame:
    """Listed files that gave no line at all, i.e. empty ones.

    Scans leave out files without a byte, so the names come from the listing that
    Spark's file index holds for the scan anyway.
    """
    listed = [(url.replace("file:///", "file:/", 1), "empty file") for url in spark.read.text(list(paths)).inputFiles()]
    return spark.createDataFrame(listed, "file string, reason string").join(
        seen, "file", "left_anti"
    )


def read_matrices(
    spark: SparkSession,
    paths: str | Sequence[str],
    default_year: int = DEFAULT_YEAR,
    header_rows: int = 10,
    sep: str = ",",
    encoding: str = "utf-8",
    keep: bool = False,
    year_of: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """SRC-3: consolidate many matrix files; bad ones are listed, not fatal.

    Fails only if none of the paths exists. ``year_of`` as in :func:`parse_matrices`.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    there, missing = _existing(spark, wanted)
    if not there:
        raise FileNotFoundError(f"no matrix file found: {', '.join(wanted)}")
    lines = read_lines(spark, there, encoding)
    long, errors, seen = _parse(lines, default_year, header_rows, sep, keep, year_of)
    errors = errors.unionByName(_unread_files(spark, there, seen))
    if missing:
        absent = spark.createDataFrame(
            [(path, "file does not exist") for path in missing], errors.schema
        )
        errors = errors.unionByName(absent)
    return long, errors


def matrix_to_long(
    df: DataFrame, label: str, months: Sequence[str], year: Column | int
) -> DataFrame:
    """RSH-1 on a matrix that is a DataFrame already: unpivot, clean, date.

    ``months`` names the value columns; names that are no month are ignored,
    none at all or two columns of one month are refused.
    """
    numbers = {name: MONTH_OF.get(name.strip().upper()) for name in months}
    known = {name: n for name, n in numbers.items() if n}
    if not known or len(set(known.values())) < len(known):
        raise ValueError(f"need distinct month columns, got {list(months)}")

    def amount(name: str) -> Column:
        is_text = isinstance(df.schema[name].dataType, T.StringType)
        cell = F.col(f"`{name}`")
        return numeric(cell, 0) if is_text else at_least(cell.cast("double"), 0)

    # An array of (month, value) pairs per row: month numbers are constants here.
    pairs = [
        F.struct(F.lit(n).alias("month"), amount(name).alias("valeur"))
        for name, n in known.items()
    ]
    return (
        df.where(~is_blank(F.col(label)))
        .select(
            F.col(label).alias("SERVICE"),
            (F.lit(year) if isinstance(year, int) else year).alias("year"),
            F.inline(F.array(*pairs)),
        )
        .select(month_start(F.col("year"), F.col("month")).alias("date"), "SERVICE", "valeur")
        .dropna(subset=["valeur", "date"])
    )
