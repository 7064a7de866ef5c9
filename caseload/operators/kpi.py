"""Staffing indicators, cost tables and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.functions.rules import CONSULTANTS, CONSULTATIONS, PRIORITY_DISEASE
from caseload.operators.series import change, growth, mean_of, sum_of

DEFAULT_COST = 1000
DEFAULT_PER_CONSULTANT = 1000


def recommended(demand: Column, per_consultant: int = DEFAULT_PER_CONSULTANT) -> Column:
    """KPI-1: consultants for a demand, cut to whole ones towards 0."""
    return (demand / F.lit(per_consultant)).cast("bigint")


def coverage(consultants: Column, wanted: Column) -> Column:
    """KPI-2: percentage of the wanted consultants that exist, at most 100."""
    rate = F.least(F.lit(100.0), F.try_divide(consultants, wanted) * 100)
    return F.when(wanted == 0, F.lit(0.0)).otherwise(rate)


def monthly_staffing(df: DataFrame) -> DataFrame:
    """Consultants, consultations and all demand per date: one row per date."""
    return df.groupBy("ds").agg(
        sum_of(CONSULTANTS).alias("consultants"),
        sum_of(CONSULTATIONS).alias("consultations"),
        F.sum("y").alias("demand"),
    )


def staffing_kpis(
    df: DataFrame, cost: float = DEFAULT_COST, per_consultant: int = DEFAULT_PER_CONSULTANT
) -> DataFrame:
    """KPI-1..4, KPI-7: one row, from one shuffle of per-date partial sums.

    The growth window sees only the rows per date, so totals and growth come out
    of the same small table without any join.
    """
    months = monthly_staffing(df)
    months = months.withColumn(
        "growth", change(F.col("demand"), F.lag("demand").over(Window.orderBy("ds")))
    )
    totals = months.agg(
        F.coalesce(F.sum("consultants"), F.lit(0.0)).alias("consultants"),
        F.coalesce(F.sum("consultations"), F.lit(0.0)).alias("consultations"),
        F.coalesce(F.sum("demand"), F.lit(0.0)).alias("demand"),
        (F.avg("growth") * 100).alias("mean_growth_percent"),
    ).withColumn("recommended_consultants", recommended(F.col("demand"), per_consultant))
    return totals.select(
        "*",
        coverage(F.col("consultants"), F.col("recommended_consultants")).alias("coverage_percent"),
        (F.col("recommended_consultants") * F.lit(float(cost))).alias("estimated_cost"),
    )


def mean_growth(df: DataFrame) -> DataFrame:
    """KPI-4: mean month-over-month growth in percent."""
    return growth(df).agg((F.avg("growth") * 100).alias("mean_growth_percent"))


def disease_alert(
    df: DataFrame, service: str = PRIORITY_DISEASE, threshold: float = 10
) -> DataFrame:
    """KPI-5: ``alert``, ``ok`` or ``no data`` for one indicator's monthly mean."""
    state = (
        F.when(F.col("mean").isNull(), F.lit("no data"))
        .when(F.col("mean") > F.lit(threshold), F.lit("alert"))
        .otherwise(F.lit("ok"))
    )
    return mean_of(df, service).select(
        F.lit(service).alias("service"), "mean", state.alias("state")
    )


def growth_alerts(df: DataFrame, percent: float = 20.0, by: Sequence[str] = ()) -> DataFrame:
    """DCL-9: dates whose growth exceeds the threshold."""
    alert = F.coalesce(F.col("growth") > F.lit(percent / 100), F.lit(False))
    return growth(df, by).withColumn("alert", alert)


def efficiency(df: DataFrame) -> DataFrame:
    """DCL-1: consultations per consultant and date."""
    return monthly_staffing(df).select(
        "ds",
        "consultations",
        "consultants",
        F.try_divide("consultations", "consultants").alias("efficiency"),
    )


def high_efficiency(df: DataFrame, factor: float = 1.1) -> DataFrame:
    """DCL-2: dates whose efficiency exceeds ``factor`` times the mean."""
    rows = efficiency(df)
    mean = rows.agg(F.avg("efficiency").alias("mean")).scalar()
    high = F.coalesce(F.col("efficiency") > F.lit(factor) * mean, F.lit(False))
    return rows.withColumn("high_efficiency", high)


def seasonal_staffing(df: DataFrame, staffing: float | None = None) -> DataFrame:
    """DCL-3: staff per calendar month in proportion to its usual demand.

    ``staffing`` is the staff of an average month; without it the mean number of
    consultants of the data is used.
    """
    months = monthly_staffing(df)
    mean = months.agg(F.avg("demand")).scalar()
    base = (
        months.agg(F.avg("consultants")).scalar() if staffing is None else F.lit(float(staffing))
    )
    return (
        months.groupBy(F.month("ds").alias("mois"))
        .agg(F.try_divide(F.avg("demand"), mean).alias("seasonal_index"))
        .withColumn("recommended_staff", F.col("seasonal_index") * base)
    )


def cost_benefit(
    df: DataFrame, cost: float = DEFAULT_COST, per_consultant: int = DEFAULT_PER_CONSULTANT
) -> DataFrame:
    """DCL-4: actual against recommended consultants and their cost per date."""
    wanted = recommended(F.col("demand"), per_consultant)
    return (
        monthly_staffing(df)
        .select("ds", "consultants", wanted.alias("recommended_consultants"))
        .select(
            "*",
            (F.col("consultants") * cost).alias("actual_cost"),
            (F.col("recommended_consultants") * F.lit(float(cost))).alias("recommended_cost"),
        )
        .withColumn("saving", F.col("actual_cost") - F.col("recommended_cost"))
    )


def scenarios(
    kpis: DataFrame,
    costs: Sequence[float] = (DEFAULT_COST,),
    growth_percents: Sequence[float] = (15.0,),
    per_consultant: int = DEFAULT_PER_CONSULTANT,
) -> DataFrame:
    """DCL-5: what the KPI row would be at other costs and demand growths.

    The grid is a literal array on the one KPI row, not a join.
    """
    grid = F.array(
        *[
            F.struct(F.lit(float(c)).alias("cost"), F.lit(float(g)).alias("growth_percent"))
            for c in costs
            for g in growth_percents
        ]
    )
    demand = F.col("demand") * (1 + F.col("growth_percent") / 100)
    return (
        kpis.select("consultants", "demand", F.inline(grid))
        .select("cost", "growth_percent", "consultants", demand.alias("demand"))
        .withColumn("recommended_consultants", recommended(F.col("demand"), per_consultant))
        .select(
            "cost",
            "growth_percent",
            "demand",
            "recommended_consultants",
            coverage(F.col("consultants"), F.col("recommended_consultants")).alias(
                "coverage_percent"
            ),
            (F.col("recommended_consultants") * F.col("cost")).alias("estimated_cost"),
        )
    )
