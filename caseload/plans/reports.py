"""Report tables over the result tables (history, forecasts, metrics, selection)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload.functions.scoring import band3, band4, display_score, zero_if_null
from caseload.operators.lookup import attach_per_service
from caseload.operators.forecast import ForecastTables
from caseload.operators.selection import (
    best_forecast,
    rank_services,
    score_stats,
    successful,
)
from caseload.operators.series import volume_share

# --- fixed values: published column names of the metrics -------------------
METRICS = {"R2": "r2", "MAE": "mae", "RMSE": "rmse", "sMAPE": "smape"}


def _metric_columns(display: bool) -> list[Column]:
    suffix = " du Modèle" if display else ""
    return [F.col(column).alias(name + suffix) for name, column in METRICS.items()]


def _chosen(selection: DataFrame) -> DataFrame:
    return selection.where(F.col("error").isNull())


def summary(tables: ForecastTables, display: bool = False) -> DataFrame:
    """RPT-1: best model per indicator, best score first."""
    chosen = _chosen(tables.selection).select("service", "model", "score")
    joined = chosen.join(tables.metrics.drop("score", "error"), ["service", "model"])
    return joined.select(
        F.col("service").alias("Service"),
        F.col("model").alias("Meilleur Modèle"),
        F.col("score").alias("Score Composite"),
        *_metric_columns(display),
    ).orderBy(F.desc("Score Composite"), "Service")


def comparison(tables: ForecastTables, display: bool = False) -> DataFrame:
    """RPT-2, SRT-3: all models of the successful indicators.

    ``display`` is the dashboard's variant: minus infinity instead of 0 for a
    failed model, and marks instead of Oui/Non.
    """
    chosen = _chosen(tables.selection).select("service", F.col("model").alias("best"))
    joined = tables.metrics.join(chosen, "service")
    score = F.when(F.col("error").isNull(), F.col("score")).otherwise(F.lit(0.0))
    if display:
        score = display_score(
            *(F.col(name) for name in ("r2", "mae", "rmse", "smape")), error=F.col("error")
        )
    yes, no = ("✅", "❌") if display else ("Oui", "Non")
    return joined.select(
        F.col("service").alias("Service"),
        F.col("model").alias("Modèle"),
        score.alias("Score Composite"),
        F.when(F.col("model") == F.col("best"), yes).otherwise(no).alias("Sélectionné"),
        *_metric_columns(display),
    ).orderBy("Service", F.desc("Score Composite"), "Modèle")


def detail(tables: ForecastTables, include_fitted: bool = False) -> DataFrame:
    """RPT-3: forecast of each indicator's best model."""
    rows = tables.forecasts
    if not include_fitted:
        rows = rows.where(F.col("kind") == "future")
    return best_forecast(tables.selection, rows).select(
        F.col("ds").alias("Date"),
        F.col("service").alias("Service"),
        F.col("yhat").alias("Prévision"),
    )


def forecast_view(tables: ForecastTables, model: str = "best") -> DataFrame:
    """FLT-8, MTH-4/5: forecast points, metrics and band of the best or a named model.

    An indicator without that model is left out; ``errors`` lists the failed ones.
    """
    chosen = _chosen(tables.selection).select("service", F.col("model").alias("best"))
    metrics = tables.metrics.where(F.col("error").isNull()).join(chosen, "service")
    wanted = F.col("best") if model == "best" else F.lit(model)
    shown = metrics.where(F.col("model") == wanted).select(
        "service",
        "model",
        "score",
        band3(F.col("score")).alias("band"),
        *[zero_if_null(F.col(name)).alias(name) for name in ("r2", "mae", "rmse", "smape")],
    )
    future = tables.forecasts.where(F.col("kind") == "future")
    return future.select("service", "model", "ds", "yhat").join(shown, ["service", "model"])


def history_and_forecast(tables: ForecastTables, model: str = "best") -> DataFrame:
    """RSH-2: history and forecast of each indicator stacked as two measures."""
    past = successful(tables.history, tables.selection).select(
        "service", F.col("ds").alias("Date"), F.col("y").alias("Historique")
    )
    ahead = forecast_view(tables, model).select(
        "service", F.col("ds").alias("Date"), F.col("yhat").alias("Prévision")
    )
    return past.unionByName(ahead, allowMissingColumns=True)


def chart_series(tables: ForecastTables) -> DataFrame:
    """RPT-4: the points and the title of every indicator's chart."""
    chosen = _chosen(tables.selection).select("service", "model", "score")
    past = (
        attach_per_service(tables.history, chosen)
        .select("service", F.lit("history").alias("kind"), "model", "ds", F.col("y").alias("value"), "score")
    )
    ahead = (
        best_forecast(tables.selection, tables.forecasts.where(F.col("kind") == "future"))
        .select("service", F.lit("forecast").alias("kind"), "model", "ds", F.col("yhat").alias("value"), "score")
    )
    title = F.format_string("Prévisions pour %s - Score: %.3f", "service", "score")
    return past.unionByName(ahead).withColumn("title", title)


def run_summary(tables: ForecastTables) -> DataFrame:
    """RPT-5: one row with indicators done and in total, and the score statistics."""
    counts = tables.selection.agg(
        F.count_if(F.col("error").isNull()).alias("services_ok"),
        F.count(F.lit(1)).alias("services_total"),
    )
    stats = score_stats(tables.selection)
    names = stats.columns
    row = stats.select(F.struct(*names).alias("s")).scalar()
    return counts.select("*", row.alias("s")).select("services_ok", "services_total", "s.*")


def ranking(tables: ForecastTables) -> DataFrame:
    """RPT-5, WIN-3, MTH-3: indicators by score with their quality band."""
    ranked = rank_services(tables.selection)
    return ranked.withColumn("band", band4(F.col("score"))).orderBy("rank", "service")


def errors(tables: ForecastTables) -> DataFrame:
    """RPT-6: indicators without a forecast, and why."""
    return tables.selection.where(F.col("error").isNotNull()).select("service", "error")


def volume_and_trend(tables: ForecastTables) -> tuple[DataFrame, DataFrame]:
    """RPT-7: share of the volume, and the monthly points, of the successful indicators.

    Volumes are summed before the indicators are matched: few rows meet the join.
    """
    sums = tables.history.groupBy("service").agg(F.sum("y").alias("y"))
    points = successful(tables.history, tables.selection).select("ds", "service", "y")
    return volume_share(successful(sums, tables.selection)), points


def all_reports(tables: ForecastTables) -> dict[str, DataFrame]:
    """Every report table under its folder name."""
    share, trend = volume_and_trend(tables)
    return {
        "summary": summary(tables),
        "comparison": comparison(tables),
        "forecasts": detail(tables),
        "charts": chart_series(tables),
        "run_summary": run_summary(tables),
        "ranking": ranking(tables),
        "errors": errors(tables),
        "volume": share,
        "trend": trend,
    }
