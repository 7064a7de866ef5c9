"""Queries on date, score and band expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.functions.dates import horizon_months
from caseload.functions.scoring import band3, band4, composite_score, display_score, zero_if_null
from caseload.operators.metrics import evaluate
from caseload.operators.prepare import calendar_features
from caseload.operators.series import future_calendar, series_bounds
from caseload.workload.tables import (
    SQL_SCORE,
    customer_series,
    mixed_series,
    rounded,
    shipment_pairs,
    sql,
    supplier_series,
)

METRIC_NAMES = ("r2", "mae", "rmse", "smape")
TARGETS = (None, 1999, 2002, 2003)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-1: calendar month and year of every series row."""
    return calendar_features(supplier_series(spark, sf_dir))


def future_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-2: twelve month-ends after each customer's last month."""
    return future_calendar(customer_series(spark, sf_dir))


def horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-3: horizon of every series without and with target years."""
    last = series_bounds(mixed_series(spark, sf_dir))
    return last.select(
        "service",
        *[horizon_months(F.col("last_ds"), year).alias(f"h_{year or 'none'}") for year in TARGETS],
        horizon_months(F.col("last_ds"), 2002, through_target=True).alias("h_through_2002"),
    )


def _horizon_sql(year: int, extra: int = 0) -> str:
    return (
        f"CAST(greatest(1, 12 - month(last_ds) + 12 * greatest(0, {year} - year(last_ds) - 1) + {extra}) AS INTEGER)"
    )


HORIZONS_SQL = sql(
    f"""SELECT service, 12 AS h_none, {_horizon_sql(1999)} AS h_1999, {_horizon_sql(2002)} AS h_2002,
  {_horizon_sql(2003)} AS h_2003, {_horizon_sql(2002, 12)} AS h_through_2002
FROM (SELECT service, max(ds) AS last_ds FROM mixed GROUP BY service)""",
    "mixed",
)


def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(shipment_pairs(spark, sf_dir))


def _metrics() -> list:
    return [F.col(name) for name in METRIC_NAMES]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-1: health and equal weights, a null metric, an absent one."""
    r2, mae, rmse, smape = _metrics()
    gap = F.when(F.col("model") != "ARIMA", mae)
    scored = pair_metrics(spark, sf_dir).select(
        "service",
        "model",
        composite_score(r2, mae, rmse, smape).alias("health"),
        composite_score(r2, mae, rmse, smape, health=False).alias("equal"),
        composite_score(r2, gap, rmse, smape).alias("with_null"),
        composite_score(r2, None, rmse, smape).alias("without_mae"),
    )
    return rounded(scored)


_CLAMPED = "greatest(0.0, least(1.0, r2))"
SCORES_SQL = sql(
    f"""SELECT service, model, {SQL_SCORE} AS health,
  0.25 * ({_CLAMPED} + 1 / (1 + mae) + 1 / (1 + rmse) + 1 / (1 + smape / 100)) AS equal,
  CASE WHEN model = 'ARIMA' THEN 0.0 ELSE {SQL_SCORE} END AS with_null,
  0.2 * {_CLAMPED} + 0.1 / (1 + rmse) + 0.4 / (1 + smape / 100) AS without_mae
FROM pair_metrics""",
    "pair_metrics",
    doubles="health, equal, with_null, without_mae",
)


def display_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-2: failed models score minus infinity."""
    failed = F.when(F.col("model") == "ARIMA", F.lit("failed"))
    shown = pair_metrics(spark, sf_dir).select(
        "service", "model", display_score(*_metrics(), error=failed).alias("score")
    )
    return rounded(shown)


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-3/4: four and three quality levels per supplier, model and line number."""
    score = composite_score(*_metrics())
    return pair_metrics(spark, sf_dir).select(
        "service", "model", band4(score * 1.6).alias("four"), band3(score * 1.4).alias("three")
    )


BANDS_SQL = sql(
    f"""SELECT service, model,
  CASE WHEN s * 1.6 >= 0.8 THEN 'Excellent' WHEN s * 1.6 >= 0.6 THEN 'Bon'
       WHEN s * 1.6 >= 0.4 THEN 'Moyen' ELSE 'Faible' END AS four,
  CASE WHEN s * 1.4 >= 0.7 THEN 'Excellent' WHEN s * 1.4 >= 0.5 THEN 'Bon' ELSE 'Faible' END AS three
FROM (SELECT service, model, {SQL_SCORE} AS s FROM pair_metrics)""",
    "pair_metrics",
)


def nulls_as_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-5: a metric that could not be computed is shown as 0."""
    shown = pair_metrics(spark, sf_dir).select(
        "service",
        "model",
        zero_if_null(F.when(F.col("model") != "Prophet", F.col("r2"))).alias("r2"),
        zero_if_null(F.col("mae")).alias("mae"),
    )
    return rounded(shown)


QUERIES = {
    "dat_calendar_features": (
        features,
        sql(
            """SELECT service, ds, y, CAST(month(ds) AS INTEGER) AS mois, CAST(year(ds) AS INTEGER) AS annee
               FROM sup""",
            "sup",
        ),
    ),
    "dat_future_calendar": (
        future_dates,
        sql(
            """SELECT service, last_day(last_ds + to_months(CAST(k AS INTEGER))) AS ds
               FROM (SELECT service, max(ds) AS last_ds FROM cus GROUP BY service)
               CROSS JOIN range(1, 13) AS steps(k)""",
            "cus",
        ),
    ),
    "dat_horizon": (horizons, HORIZONS_SQL),
    "mth_composite_score": (scores, SCORES_SQL),
    "mth_display_score": (
        display_scores,
        sql(
            f"""SELECT service, model, CASE WHEN model = 'ARIMA' THEN CAST('-inf' AS DOUBLE)
                ELSE {SQL_SCORE} END AS score FROM pair_metrics""",
            "pair_metrics",
            doubles="score",
        ),
    ),
    "mth_bands": (bands, BANDS_SQL),
    "mth_null_as_zero": (
        nulls_as_zero,
        sql(
            """SELECT service, model, CASE WHEN model = 'Prophet' THEN 0.0 ELSE coalesce(r2, 0.0) END AS r2,
               coalesce(mae, 0.0) AS mae FROM pair_metrics""",
            "pair_metrics",
            doubles="r2, mae",
        ),
    ),
}
