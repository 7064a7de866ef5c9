"""Queries on sources, sinks, coercions, filters and reshapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.functions.rules import MONTH_SPELLINGS
from caseload.functions.text import (
    is_blank,
    month_number,
    month_start,
    numeric,
    numeric_or_zero,
    strict_date,
    year_from_name,
)
from caseload.operators.prepare import before_year, key_indicators, monthly_view, name_indicators, prepare
from caseload.operators.series import union_years
from caseload.plans.analysis import run_full_analysis
from caseload.plans.reports import all_reports
from caseload.session import materialise, shared_folder
from caseload.sources.long_table import read_long_csv, write_long_csv
from caseload.sources.matrices import label_column, matrix_to_long, parse_matrices, read_matrices
from caseload.sources.results import load_results, save_reports, save_results
from caseload.workload.tables import (
    SQL_KEYS,
    closed_tables,
    orders_long,
    orders_series,
    priority_label,
    read,
    rounded,
    sql,
    sql_standardise,
)

FRENCH_MONTHS = [words[0] for words in MONTH_SPELLINGS.values()]
PREAMBLE = 10


def matrix_lines(
    spark: SparkSession, sf_dir: str, preamble_rows: int, label_first: bool = True
) -> DataFrame:
    """One yearly matrix per nation and ship year, as lines of delimited text.

    Rows are suppliers, cells their monthly quantity. Nation k's files have
    ``k % preamble_rows`` title rows above the header.
    """
    shipped = F.col("l_shipdate")
    cells = [
        F.coalesce(
            F.sum(F.when(F.month(shipped) == m, F.col("l_quantity"))).cast("string"), F.lit("")
        ).alias(f"m{m}")
        for m in range(1, 13)
    ]
    # Quantities are summed per supplier and year first; the nation joins the few sums.
    sums = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.year(shipped).alias("year"))
        .agg(*cells)
    )
    nations = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")
    )
    label = F.concat(F.lit('"Supplier, '), F.col("l_suppkey").cast("string"), F.lit('"'))
    values = [F.col(f"m{m}") for m in range(1, 13)]
    number = F.col("l_suppkey").cast("string")
    row = [label, *values] if label_first else [number, label, *values]
    names = ["Indicateur"] if label_first else ["No", "Nom"]
    file = F.concat(
        F.lit("/matrices/nation_"), F.col("nation").cast("string"), F.lit("_releve"),
        F.col("year").cast("string"), F.lit(".csv"),
    )
    rows = sums.join(nations, "l_suppkey").select(
        file.alias("file"),
        "nation",
        (F.col("l_suppkey") + 100).alias("pos"),
        F.concat_ws(",", *row).alias("line"),
    )
    files = rows.select("file", "nation").distinct()
    titles = F.col("nation") % F.lit(preamble_rows)
    heading = F.lit(",".join(names + FRENCH_MONTHS))
    head = files.select(
        "file",
        F.explode(F.sequence(F.lit(0).cast("bigint"), titles.cast("bigint"))).alias("pos"),
        titles.alias("titles"),
        heading.alias("heading"),
    ).select(
        "file",
        "pos",
        F.when(F.col("pos") == F.col("titles"), F.col("heading")).otherwise("Relevé,,").alias("line"),
    )
    body = rows.select("file", "pos", "line")
    lines = head.unionByName(body).select("file", F.lit(0).cast("bigint").alias("block"), "pos", "line")
    return materialise(lines, "matrices")


def matrix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1..3, PRJ-1/2/3/5/7, FLT-1/2, RSH-1."""
    return parse_matrices(matrix_lines(spark, sf_dir, PREAMBLE))[0]


MATRIX_LONG_SQL = """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  'Supplier, ' || l_suppkey AS "SERVICE", sum(l_quantity) AS valeur
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
GROUP BY 1, 2 HAVING sum(l_quantity) >= 0"""


def matrix_label_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1, PRJ-2 without keyword: the label is the first column that holds text."""
    return parse_matrices(matrix_lines(spark, sf_dir, PREAMBLE, label_first=False))[0]


def matrix_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3: files whose header comes too late are rejected and listed."""
    return parse_matrices(matrix_lines(spark, sf_dir, preamble_rows=25))[1]


MATRIX_ERRORS_SQL = """
SELECT DISTINCT '/matrices/nation_' || s_nationkey || '_releve' || year(l_shipdate) || '.csv' AS file,
  'no header row with a month name' AS reason
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey % 25 >= 10"""


def year_folder(path: Column) -> Column:
    """The year of a matrix that lies in a folder ``year=…``."""
    return F.regexp_extract(path, "/year=([0-9]{4})/", 1)


def write_matrices(lines: DataFrame, folders: list[str]) -> str:
    """One text file per folder, its lines in the order of ``pos``."""
    spark = lines.sparkSession
    path = shared_folder(spark, "matrix-files")
    ordered = lines.repartition(*folders).sortWithinPartitions(*folders, "pos")
    ordered.select(*folders, "line").write.partitionBy(*folders).text(path)
    return path


def _matrix_files(spark: SparkSession, sf_dir: str, preamble_rows: int) -> str:
    """The yearly matrices as files in folders by year and nation."""
    lines = matrix_lines(spark, sf_dir, preamble_rows).select(
        F.regexp_extract("file", "releve([0-9]{4})", 1).alias("year"),
        F.regexp_extract("file", "nation_([0-9]+)", 1).alias("nation"),
        "pos",
        "line",
    )
    return write_matrices(lines, ["year", "nation"])


def matrix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1, SRC-3 on real files, with an empty one among them and a missing path."""
    path = _matrix_files(spark, sf_dir, PREAMBLE)
    spark.createDataFrame([], "line string").coalesce(1).write.text(f"{path}/year=1900/nation=none")
    return read_matrices(spark, [path, f"{path}/absent"], year_of=year_folder)[0]


def matrix_file_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3: how many files were rejected, by reason."""
    path = _matrix_files(spark, sf_dir, 25)
    spark.createDataFrame([], "line string").coalesce(1).write.text(f"{path}/year=1900/nation=none")
    problems = read_matrices(spark, [path, f"{path}/absent"], year_of=year_folder)[1]
    return problems.groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


MATRIX_FILE_ERRORS_SQL = """
SELECT 'no header row with a month name' AS reason, count(*) AS files FROM (
  SELECT DISTINCT s_nationkey, year(l_shipdate) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  WHERE s_nationkey % 25 >= 10)
HAVING count(*) > 0
UNION ALL SELECT 'empty file', 1
UNION ALL SELECT 'file does not exist', 1"""


def order_matrices(spark: SparkSession, sf_dir: str) -> str:
    """Monthly orders per raw indicator as one matrix file per year."""
    made = F.col("o_orderdate")
    cells = [
        F.coalesce(F.sum(F.when(F.month(made) == m, 1)).cast("string"), F.lit("")).alias(f"m{m}")
        for m in range(1, 13)
    ]
    counts = read(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year(made).alias("year")).agg(*cells)
    body = counts.select(
        "year",
        F.lit(1).alias("pos"),
        F.concat_ws(",", priority_label(F.col("o_orderpriority")), *[f"m{m}" for m in range(1, 13)]).alias("line"),
    )
    heading = F.lit(",".join(["Indicateur", *FRENCH_MONTHS]))
    head = counts.select("year").distinct().select("year", F.lit(0).alias("pos"), heading.alias("line"))
    return write_matrices(head.unionByName(body), ["year"])


def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix files to stored results and reports; the history the run has kept, and its outcome."""
    output = shared_folder(spark, "run")
    tables = run_full_analysis(spark, order_matrices(spark, sf_dir), output, year_of=year_folder)
    chosen = tables.selection.select("service", F.col("model").isNotNull().alias("has_model"))
    listed = spark.read.parquet(f"{output}/reports_*/summary").select(F.col("Service").alias("service")).distinct()
    chosen = chosen.join(listed.withColumn("reported", F.lit(True)), "service", "left")
    return tables.history.join(chosen, "service").select("service", "ds", "y", "has_model", "reported")


def label_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-2: position of the first text column per file."""
    lines = matrix_lines(spark, sf_dir, 1, label_first=False).where(F.col("pos") > 0)
    return label_column(lines)


LABEL_POSITIONS_SQL = """
SELECT DISTINCT '/matrices/nation_' || s_nationkey || '_releve' || year(l_shipdate) || '.csv' AS file,
  1 AS text_at
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""


def years_from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2: order keys and dates as file names; names without a year get the default."""
    name = F.concat(
        F.lit("/in.2019/etat_"),
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyyMM")).otherwise(
            F.concat(F.lit("no"), F.substring("o_orderpriority", 1, 1))
        ),
        F.lit(".2031"),
    )
    rows = read(spark, sf_dir, "orders").select(year_from_name(name).alias("year"))
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("files"))


YEARS_SQL = """
SELECT CAST(CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate) ELSE 2024 END AS INTEGER) AS year,
  count(*) AS files FROM orders GROUP BY 1"""


def long_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1, SRC-4, SRT-1: write the long table as CSV, read and prepare it."""
    path = write_long_csv(orders_long(spark, sf_dir), shared_folder(spark, "long"))
    return prepare(read_long_csv(spark, path))


def mixed_long_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4: one folder of CSV files that write their columns in two orders, one with a further column."""
    path = shared_folder(spark, "mixed")
    long = orders_long(spark, sf_dir).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    early = F.coalesce(F.substring("date", 1, 4) < "1995", F.lit(True))
    long.where(early).select("date", "SERVICE", "valeur").write.option("header", True).csv(path)
    other = long.where(~early).select("valeur", F.lit("x").alias("note"), "SERVICE", "date")
    other.write.option("header", True).mode("append").csv(path)
    return prepare(read_long_csv(spark, path, mixed_headers=True).drop("note"))


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2, SRC-5: save the result tables for one run year and read one back."""
    path = save_results(closed_tables(spark, sf_dir), shared_folder(spark, "results"), 2001)
    return rounded(load_results(spark, path, 2001).selection)


def result_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2, SRC-5: rows of all four published tables of one run."""
    path = save_results(closed_tables(spark, sf_dir), shared_folder(spark, "results"), 2001)
    loaded = load_results(spark, path, 2001)
    return union_years(
        *[df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in loaded._asdict().items()]
    )


def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3: every non-empty report in its folder; rows per report."""
    kept = save_results(closed_tables(spark, sf_dir), shared_folder(spark, "results"), 2001)
    path = shared_folder(spark, "reports")
    written = save_reports(all_reports(load_results(spark, kept, 2001)), path)
    counted = [
        spark.read.parquet(f"{path}/{name}").agg(
            F.lit(name).alias("report"), F.count(F.lit(1)).alias("rows")
        )
        for name in written
    ]
    return union_years(*counted)


STORED_REPORTS_SQL = sql(
    """SELECT 'summary' AS report, count(*) AS "rows" FROM selection WHERE error IS NULL
UNION ALL SELECT 'comparison', count(*) FROM metrics
UNION ALL SELECT 'forecasts', count(*) * 12 FROM selection WHERE error IS NULL
UNION ALL SELECT 'charts', (SELECT count(*) FROM eligible) + count(*) * 12 FROM selection WHERE error IS NULL
UNION ALL SELECT 'run_summary', 1
UNION ALL SELECT 'ranking', count(*) FROM selection WHERE error IS NULL
UNION ALL SELECT 'errors', count(*) FROM selection WHERE error IS NOT NULL HAVING count(*) > 0
UNION ALL SELECT 'volume', count(*) FROM selection WHERE error IS NULL
UNION ALL SELECT 'trend', count(*) FROM eligible""",
    "selection", "metrics", "eligible",
)


def month_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-1: order months spelled in French, padded and in mixed case."""
    names = F.array(*[F.lit(f"  {name.capitalize()} ") for name in FRENCH_MONTHS], F.lit("Total"))
    spelled = F.element_at(
        names, F.when(F.col("o_orderstatus") == "P", 13).otherwise(F.month("o_orderdate"))
    )
    rows = read(spark, sf_dir, "orders").select(month_number(spelled).alias("month"))
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("orders"))


MONTH_NAMES_SQL = """
SELECT CAST(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE month(o_orderdate) END AS INTEGER) AS month,
  count(*) AS orders FROM orders GROUP BY 1"""

# Number spellings by line number: padded, negative, Java suffix, exponent, and so on.
SPELLINGS = {
    1: ("' '", "'\t'"),
    2: ("'-'", "''"),
    3: ("''", "'d'"),
    4: ("''", "'e1'"),
    5: ("'+'", "'.5'"),
    6: ("'n'", "''"),
}


def dirty_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.col("l_quantity").cast("bigint").cast("string")
    branches = F
    for line, (before, after) in SPELLINGS.items():
        text = F.concat(F.lit(before.strip("'")), whole, F.lit(after.strip("'")))
        branches = branches.when(F.col("l_linenumber") == line, text)
    return read(spark, sf_dir, "lineitem").select("l_linenumber", branches.otherwise("inf").alias("text"))


_DIRTY_SQL = "SELECT l_linenumber, CASE l_linenumber {} ELSE 'inf' END AS text FROM lineitem".format(
    " ".join(
        f"WHEN {n} THEN {a} || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || {b}"
        for n, (a, b) in SPELLINGS.items()
    )
).replace("'\t'", "chr(9)")
_NUMBER_SQL = (
    "CASE WHEN regexp_matches(trim(text, ' ' || chr(9)), "
    r"'^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?)$', 'i') "
    "THEN TRY_CAST(trim(text, ' ' || chr(9)) AS DOUBLE) END"
)


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-3: usable, non-negative numbers per kind of spelling."""
    value = numeric(F.col("text"), min_value=0)
    rows = dirty_numbers(spark, sf_dir).select("l_linenumber", value.alias("v"))
    return rows.groupBy("l_linenumber").agg(F.count("v").alias("kept"), F.sum("v").alias("total"))


NUMBERS_SQL = f"""
SELECT l_linenumber, count(v) AS kept, sum(v) AS total FROM (
  SELECT l_linenumber, CASE WHEN NOT isnan(v) AND v >= 0 THEN v END AS v
  FROM (SELECT l_linenumber, {_NUMBER_SQL} AS v FROM ({_DIRTY_SQL}))) GROUP BY 1"""


def numbers_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-4: the same, unusable ones as 0 and negatives kept."""
    rows = dirty_numbers(spark, sf_dir).select("l_linenumber", numeric_or_zero(F.col("text")).alias("v"))
    return rows.groupBy("l_linenumber").agg(F.count("v").alias("rows"), F.sum("v").alias("total"))


NUMBERS_OR_ZERO_SQL = f"""
SELECT l_linenumber, count(v) AS "rows", sum(v) AS total FROM (
  SELECT l_linenumber, coalesce({_NUMBER_SQL}, 0.0) AS v FROM ({_DIRTY_SQL})) GROUP BY 1"""


def month_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-5: first of the month from a year and a month number."""
    date = month_start(F.year("l_shipdate"), F.month("l_shipdate"))
    return (
        read(spark, sf_dir, "lineitem").groupBy(date.alias("date")).agg(F.count(F.lit(1)).alias("rows"))
    )


def strict_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-6: dates from text; one bad text would fail the query."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return (
        read(spark, sf_dir, "orders")
        .groupBy(strict_date(text).alias("date"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order under a messy label: odd keys carry an age group."""
    label = priority_label(F.col("o_orderpriority"))
    aged = F.concat(F.lit("  "), label, F.lit(" < 5 ans"))
    odd = F.col("o_orderkey") % 2 == 1
    return read(spark, sf_dir, "orders").select(
        F.when(odd, aged).otherwise(label).alias("service"), "o_totalprice"
    )


def standard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1: messy labels to standard names, rules run once per distinct label."""
    named = name_indicators(raw_labels(spark, sf_dir), "service")
    return named.groupBy("service").agg(F.count(F.lit(1)).alias("orders"))


def standard_names_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1 without the label pass: rules run on every row, nothing is joined."""
    named = name_indicators(raw_labels(spark, sf_dir), "service", per="row")
    return named.groupBy("service").agg(F.count(F.lit(1)).alias("orders"))


_RAW_LABEL_SQL = """
SELECT CASE WHEN o_orderkey % 2 = 1 THEN '  ' || label || ' < 5 ans' ELSE label END AS raw
FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Nombre de consultants'
  WHEN '2-HIGH' THEN 'NOMBRE DE CONSULTATIONS' WHEN '3-MEDIUM' THEN 'TOTAL PALUDISME'
  WHEN '4-NOT SPECIFIED' THEN 'accouchement en ÉTABLISSEMENT' ELSE 'Service Inconnu' END AS label
  FROM orders)"""
STANDARD_NAMES_SQL = (
    f"SELECT {sql_standardise('raw')} AS service, count(*) AS orders FROM ({_RAW_LABEL_SQL}) GROUP BY 1"
)


def blank_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1: rows whose label is null or white space only are dropped."""
    status = F.col("o_orderstatus")
    label = F.when(status == "P", F.lit(" \t ")).when(status == "O", F.col("o_orderpriority"))
    rows = read(spark, sf_dir, "orders").select(label.alias("label"))
    return rows.where(~is_blank(F.col("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("orders"))


def drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-2: rows without value or date are dropped."""
    rows = read(spark, sf_dir, "lineitem").select(
        "l_linestatus",
        F.when(F.col("l_discount") > 0.02, F.col("l_quantity")).alias("valeur"),
        F.when(F.col("l_tax") > 0.01, F.col("l_shipdate").cast("date")).alias("date"),
    )
    kept = rows.dropna(subset=["valeur", "date"])
    return kept.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("valeur").alias("total"), F.max("date").alias("last")
    )


def rows_before_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-3: shipments strictly before the target year."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ds"), "l_quantity")
    return before_year(rows, 1999).groupBy(F.year("ds").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity")
    )


def rows_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-4: only key indicators stay."""
    named = name_indicators(orders_long(spark, sf_dir).withColumnRenamed("SERVICE", "service"), "service")
    return key_indicators(named)


def rows_of_key_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-4 with a key table: shipments of the suppliers of one region."""
    suppliers = read(spark, sf_dir, "supplier")
    nations = read(spark, sf_dir, "nation").where(F.col("n_regionkey") == 2)
    keys = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey")
    kept = key_indicators(read(spark, sf_dir, "lineitem"), keys, service="l_suppkey")
    return kept.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"))


def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH-1: yearly matrices per priority unpivoted to rows."""
    names = ["January", "fev", "MARS", "Avril", "mai", "JUN", "juil", "AOÛT", "sept", "October", "NOV", "DECEM"]
    made = F.col("o_orderdate")
    months = [
        F.sum(F.when(F.month(made) == i + 1, F.col("o_totalprice"))).alias(name)
        for i, name in enumerate(names)
    ]
    wide = read(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year(made).alias("y")).agg(*months)
    return rounded(matrix_to_long(wide, "o_orderpriority", names, F.col("y")), 2)


QUERIES = {
    "src_matrix_files": (matrix_files, MATRIX_LONG_SQL),
    "src_matrix_file_errors": (matrix_file_errors, MATRIX_FILE_ERRORS_SQL),
    "run_full_analysis": (
        whole_run, sql("SELECT service, ds, y, TRUE AS has_model, TRUE AS reported FROM series", "series"),
    ),
    "src_matrix_scan": (matrix_scan, MATRIX_LONG_SQL),
    "src_matrix_label_guess": (matrix_label_guess, MATRIX_LONG_SQL),
    "src_matrix_errors": (matrix_errors, MATRIX_ERRORS_SQL),
    "src_year_from_name": (years_from_names, YEARS_SQL),
    "snk_long_csv_round_trip": (
        long_csv_round_trip, sql("SELECT ds, service, y FROM series", "series"),
    ),
    "src_long_csv_mixed_headers": (
        mixed_long_csv, sql("SELECT ds, service, y FROM series", "series"),
    ),
    "snk_results_round_trip": (
        stored_results, sql("SELECT * FROM selection", "selection", doubles="score"),
    ),
    "snk_reports": (stored_reports, STORED_REPORTS_SQL),
    "snk_results_snapshot": (
        result_snapshot,
        sql(
            """SELECT 'history' AS "table", count(*) AS "rows" FROM mixed UNION ALL
               SELECT 'forecasts', count(*) FROM forecasts UNION ALL
               SELECT 'metrics', count(*) FROM metrics UNION ALL
               SELECT 'selection', count(*) FROM selection""",
            "mixed", "forecasts", "metrics", "selection",
        ),
    ),
    "prj_month_names": (month_names, MONTH_NAMES_SQL),
    "prj_label_column": (label_positions, LABEL_POSITIONS_SQL),
    "prj_numeric": (numbers, NUMBERS_SQL),
    "prj_numeric_or_zero": (numbers_or_zero, NUMBERS_OR_ZERO_SQL),
    "prj_month_start": (
        month_starts,
        """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, count(*) AS "rows"
           FROM lineitem GROUP BY 1""",
    ),
    "prj_strict_date": (
        strict_dates,
        "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders FROM orders GROUP BY 1",
    ),
    "prj_long_rows": (orders_long, sql('SELECT date, SERVICE AS "SERVICE", valeur FROM orders_long', "orders_long")),
    "prj_series": (orders_series, sql("SELECT ds, service, y FROM series", "series")),
    "prj_monthly_view": (
        lambda spark, sf_dir: monthly_view(orders_series(spark, sf_dir)),
        sql("SELECT ds AS date, service, y AS valeur FROM series", "series"),
    ),
    "str_standard_names": (standard_names, STANDARD_NAMES_SQL),
    "str_standard_names_per_row": (standard_names_per_row, STANDARD_NAMES_SQL),
    "flt_blank_labels": (
        blank_labels,
        "SELECT o_orderpriority AS label, count(*) AS orders FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
    ),
    "flt_drop_nulls": (
        drop_nulls,
        """SELECT l_linestatus, count(*) AS "rows", sum(l_quantity) AS total,
           max(CAST(l_shipdate AS DATE)) AS "last"
           FROM lineitem WHERE l_discount > 0.02 AND l_tax > 0.01 GROUP BY 1""",
    ),
    "flt_before_year": (
        rows_before_year,
        """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS "rows", sum(l_quantity) AS quantity
           FROM lineitem WHERE l_shipdate < DATE '1999-01-01' GROUP BY 1""",
    ),
    "flt_key_indicators": (
        rows_of_keys,
        sql(
            f"SELECT ds AS date, service, y AS valeur FROM named WHERE service IN ({SQL_KEYS})", "named"
        ),
    ),
    "flt_key_table": (
        rows_of_key_table,
        """SELECT l_suppkey, sum(l_quantity) AS quantity FROM lineitem WHERE l_suppkey IN (
           SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2)
           GROUP BY 1""",
    ),
    "rsh_wide_to_long": (
        wide_to_long,
        """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_orderpriority AS "SERVICE",
           round(sum(o_totalprice) + 1e-9, 2) AS valeur FROM orders GROUP BY 1, 2""",
    ),
}
