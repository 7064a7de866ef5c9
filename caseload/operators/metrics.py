"""Forecast accuracy: one aggregation computes every metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload.functions.scoring import composite_score


def mae(t: Column, p: Column) -> Column:
    """AGG-8: mean absolute error."""
    return F.avg(F.abs(t - p))


def rmse(t: Column, p: Column) -> Column:
    """AGG-9: root mean squared error."""
    return F.sqrt(F.avg((t - p) * (t - p)))


def r2(t: Column, p: Column) -> Column:
    """AGG-10: R²; a constant target gives 1 if hit exactly, else 0; null below 2 rows."""
    sse = F.sum((t - p) * (t - p))
    constant = F.min(t) == F.max(t)
    spread = F.count(t) * F.var_pop(t)
    return (
        F.when(F.count(t) < 2, F.lit(None).cast("double"))
        .when(constant, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(1 - F.try_divide(sse, spread))
    )


def mape(t: Column, p: Column) -> Column:
    """AGG-11: mean absolute percentage error, denominator shifted by 1e-8."""
    return F.avg(F.abs(F.try_divide(t - p, t + F.lit(1e-8)))) * 100


def smape(t: Column, p: Column) -> Column:
    """AGG-12: symmetric MAPE; a pair of zeros counts as no error."""
    size = (F.abs(t) + F.abs(p)) / 2
    return F.avg(F.when(size == 0, F.lit(0.0)).otherwise(F.abs(p - t) / size)) * 100


def evaluate(
    fitted: DataFrame,
    by: Sequence[str] = ("service", "model"),
    y: str = "y",
    yhat: str = "yhat",
) -> DataFrame:
    """AGG-13: all metrics per group; partial sums combine before the shuffle."""
    t, p = F.col(y), F.col(yhat)
    return fitted.groupBy(*by).agg(
        r2(t, p).alias("r2"),
        mae(t, p).alias("mae"),
        rmse(t, p).alias("rmse"),
        mape(t, p).alias("mape"),
        smape(t, p).alias("smape"),
    )


def with_score(metrics: DataFrame, health: bool = True) -> DataFrame:
    """MTH-1 as an operator: add the composite score."""
    columns = (F.col(name) for name in ("r2", "mae", "rmse", "smape"))
    return metrics.withColumn("score", composite_score(*columns, health=health))
