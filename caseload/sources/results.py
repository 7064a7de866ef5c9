"""Stored results: snapshots of the four tables, published per run year by one marker."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.operators.forecast import ForecastTables


SNAPSHOTS, PUBLISHED = "snapshots", "_published"


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def save_results(tables: ForecastTables, path: str, run_year: int) -> str:
    """SNK-2: write the four result tables of one run year aside, then publish them at once.

    The tables go to a new snapshot folder. Only when all four are written is one empty
    marker ``_published/<run_year>.<snapshot>`` created, a single atomic file creation.
    Readers take the newest marker of each run year, so they meet the four tables of one
    run, never a mix of two; a run that stops midway publishes nothing and the previous
    run stays in view. Other run years are not touched. Snapshots are named by time, so
    the newest sorts last.
    """
    root = path.rstrip("/")
    snapshot = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    spark = None
    for name, df in tables._asdict().items():
        spark = df.sparkSession
        df.withColumn("run_year", F.lit(run_year)).write.parquet(f"{root}/{SNAPSHOTS}/{snapshot}/{name}")
    filesystem, marker = _filesystem(spark, f"{root}/{PUBLISHED}/{run_year}.{snapshot}")
    filesystem.create(marker, False).close()
    return path


def published(spark: SparkSession, path: str) -> dict[int, str]:
    """Run year to its newest published snapshot; one marker per run, read from the folder."""
    filesystem, folder = _filesystem(spark, f"{path.rstrip('/')}/{PUBLISHED}")
    if not filesystem.exists(folder):
        return {}
    newest: dict[int, str] = {}
    for status in filesystem.listStatus(folder):
        year, _, snapshot = status.getPath().getName().partition(".")
        if year.lstrip("-").isdigit() and snapshot:
            newest[int(year)] = max(newest.get(int(year), ""), snapshot)
    return newest


def load_results(
    spark: SparkSession, path: str, run_year: int | None = None
) -> ForecastTables | None:
    """SRC-5: read the published results, of one run year or of all.

    None if nothing is published (for that year).
    """
    root = path.rstrip("/")
    current = published(spark, root)
    if run_year is not None:
        current = {run_year: current[run_year]} if run_year in current else {}
    if not current:
        return None
    loaded = {}
    for name in ForecastTables._fields:
        df = spark.read.parquet(*[f"{root}/{SNAPSHOTS}/{snapshot}/{name}" for snapshot in current.values()])
        loaded[name] = df.drop("run_year") if run_year is not None else df
    return ForecastTables(**loaded)


def save_reports(reports: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> list[str]:
    """SNK-3: one folder per report; an empty report is not written.

    Raises if there is no report at all.
    """
    if not reports:
        raise ValueError("no results to report")
    written = []
    for name, df in reports.items():
        if df.isEmpty():
            continue
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{path.rstrip('/')}/{name}")
        written.append(name)
    return written
