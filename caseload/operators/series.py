"""Aggregations, windows and reshapes over series rows ``service, ds, y``.

Windows only ever run over rows that were aggregated to one per date (or per
indicator and date) first, so no window partition grows with the raw data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.functions.dates import horizon_months, month_ends_after


def row_counts(df: DataFrame) -> DataFrame:
    """AGG-1: rows per indicator, most first."""
    counts = df.groupBy("service").agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), "service")


def services(df: DataFrame) -> DataFrame:
    """AGG-2: the distinct indicators."""
    return df.select("service").distinct()


def latest_year(df: DataFrame) -> DataFrame:
    """AGG-3: year of the newest observation."""
    return df.agg(F.year(F.max("ds")).alias("latest_year"))


def volume_share(df: DataFrame) -> DataFrame:
    """AGG-4: volume per indicator and its percentage of the total."""
    volumes = df.groupBy("service").agg(F.sum("y").alias("volume"))
    total = volumes.agg(F.sum("volume").alias("total")).scalar()
    return volumes.withColumn("percent", F.try_divide(F.col("volume") * 100, total))


def monthly_totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG-5: sum over all indicators (or per ``by`` columns) and date."""
    return df.groupBy(*by, "ds").agg(F.sum("y").alias("total"))


def overview(df: DataFrame) -> DataFrame:
    """AGG-6: number of indicators and rows, and the data year, in one pass.

    Counted per indicator first: no distinct set has to reach a single task.
    """
    per_service = df.groupBy("service").agg(
        F.count(F.lit(1)).alias("rows"), F.max("ds").alias("last_ds")
    )
    return per_service.agg(
        F.count(F.lit(1)).alias("services"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.year(F.max("last_ds")).alias("data_year"),
    )


def sum_of(service: str) -> Column:
    """Conditional sum of one indicator, 0 when it is absent."""
    return F.coalesce(F.sum(F.when(F.col("service") == service, F.col("y"))), F.lit(0.0))


def named_totals(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """AGG-7: totals of the named indicators and of everything, one row, one pass."""
    named = [sum_of(name).alias(name) for name in names]
    return df.agg(*named, F.coalesce(F.sum("y"), F.lit(0.0)).alias("all"))


def mean_of(df: DataFrame, service: str) -> DataFrame:
    """AGG-16: mean of one indicator; null when it is absent."""
    return df.agg(F.avg(F.when(F.col("service") == service, F.col("y"))).alias("mean"))


def only(df: DataFrame, service: str) -> DataFrame:
    """FLT-7: rows of one indicator."""
    return df.where(F.col("service") == service)


def change(now: Column, before: Column) -> Column:
    """Relative change; from 0 it is infinite, from 0 to 0 undefined (null)."""
    infinite = F.when(now > 0, F.lit(float("inf"))).when(now < 0, F.lit(float("-inf")))
    return F.when(before == 0, infinite).otherwise(F.try_divide(now - before, before))


def growth(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """WIN-1: change against the previous present date.

    The ungrouped window sees one row per date, however large ``df`` is.
    """
    order = (Window.partitionBy(*by) if by else Window).orderBy("ds")
    totals = monthly_totals(df, by).withColumn("previous", F.lag("total").over(order))
    return totals.withColumn("growth", change(F.col("total"), F.col("previous")))


def series_bounds(df: DataFrame) -> DataFrame:
    """WIN-4/5: first and last date and last value per indicator.

    Several rows on the last date: the largest value is taken, so the answer
    does not depend on row order. Reduced per date first, with plain numbers in
    the buffers, so that no row has to be sorted.
    """
    dates = df.groupBy("service", "ds").agg(
        F.count(F.lit(1)).alias("n"), F.max("y").alias("y")
    )
    return dates.groupBy("service").agg(
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
        F.max_by("y", "ds").alias("last_y"),
        F.sum("n").alias("rows"),
    )


def horizons(
    df: DataFrame, target_year: int | None = None, through_target: bool = False
) -> DataFrame:
    """DAT-3 as an operator: months to forecast per indicator."""
    months = horizon_months(F.col("last_ds"), target_year, through_target)
    return series_bounds(df).select("service", "last_ds", months.alias("horizon"))


def future_calendar(
    df: DataFrame, target_year: int | None = None, through_target: bool = False
) -> DataFrame:
    """DAT-2 as an operator: the month-ends to forecast per indicator."""
    ends = month_ends_after(F.col("last_ds"), F.col("horizon"))
    return horizons(df, target_year, through_target).select("service", F.explode(ends).alias("ds"))


def union_years(*tables: DataFrame) -> DataFrame:
    """SET-1: bag union of yearly long tables."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result


def spread_sort(df: DataFrame, *keys: str) -> DataFrame:
    """Global order by ``keys`` that also splits a hot key over many tasks.

    A row number inside the input breaks ties, so the sampled ranges can cut
    through rows whose keys are all equal.
    """
    numbered = df.withColumn("_tie", F.monotonically_increasing_id())
    return numbered.orderBy(*keys, "_tie").drop("_tie")


def by_date(df: DataFrame, date: str = "date") -> DataFrame:
    """SRT-1: order by date, for a sink."""
    return spread_sort(df, date)


def dated_cells(df: DataFrame, unique_dates: bool = False) -> DataFrame:
    """One row per indicator and date with row count, mean and sum of squares.

    Combines before the shuffle, so a hot indicator shrinks to its number of
    distinct dates; that bounds every per-series step behind it. The caller may
    promise ``unique_dates`` where one row per date is known; then no shuffle is
    needed here.
    """
    if unique_dates:
        return df.select(
            "service", "ds", F.lit(1).cast("bigint").alias("n"), "y", (F.col("y") * F.col("y")).alias("yy")
        )
    return df.groupBy("service", "ds").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("y").alias("y"),
        F.sum(F.col("y") * F.col("y")).alias("yy"),
    )
