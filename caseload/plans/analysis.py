"""End to end: matrix files to stored forecasts and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.functions.rules import KEY_INDICATORS
from caseload.operators.forecast import ForecastTables, forecast
from caseload.operators.prepare import monthly_view, prepare
from caseload.operators.series import latest_year
from caseload.plans.reports import all_reports
from caseload.sources.long_table import read_long_csv, write_long_csv
from caseload.sources.matrices import read_matrices
from caseload.sources.results import load_results, save_reports, save_results


def load_and_prepare(spark: SparkSession, path: str, target_year: int | None = None) -> DataFrame:
    """PRJ-8: a long CSV to its monthly view ``date, service, valeur``."""
    return monthly_view(prepare(read_long_csv(spark, path), target_year))


def demand_forecast(
    df: DataFrame, periods: int | None = None, target_year: int | None = None
) -> ForecastTables | None:
    """MOD-6: forecast prepared series; None without data.

    Without ``periods`` the horizon follows the target year: 12 months without one.
    """
    if df.isEmpty():
        return None
    return forecast(df, horizon=periods, target_year=target_year)


def run_full_analysis(
    spark: SparkSession,
    paths: str | Sequence[str],
    output: str,
    target_year: int | None = None,
    keys: Sequence[str] = KEY_INDICATORS,
    sep: str = ",",
    year_of: Callable[[Column], Column] | None = None,
) -> ForecastTables:
    """Read all matrices, forecast, store results and reports under ``output``.

    Folders written: ``long`` (CSV), ``ingest_errors``, ``results`` (per run year)
    and ``reports_<year>``. The text is parsed once; the result tables are read
    back from the store, so no report runs a fit again.
    """
    output = output.rstrip("/")
    long, problems = read_matrices(spark, paths, sep=sep, keep=True, year_of=year_of)
    problems.write.mode("overwrite").parquet(f"{output}/ingest_errors")
    write_long_csv(long, f"{output}/long")
    series = prepare(long, target_year, keys).select("service", "ds", "y")
    if series.isEmpty():
        raise ValueError("no key indicator has data before the target year")
    year = target_year or latest_year(long.select(F.col("date").alias("ds"))).first()[0]
    tables = forecast(series, target_year=target_year)
    save_results(tables, f"{output}/results", year)
    tables = load_results(spark, f"{output}/results", year)
    save_reports(all_reports(tables), f"{output}/reports_{year}")
    return tables
