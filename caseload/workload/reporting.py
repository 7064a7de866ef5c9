"""Queries on the report tables, over the closed-form result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.operators.forecast import ForecastTables, forecast
from caseload.plans import reports
from caseload.plans.dashboard import dashboard
from caseload.workload.tables import SQL_SCORE, closed_tables, mixed_series, rounded, sql


def _with_failed(tables: ForecastTables) -> ForecastTables:
    """Every metric row of the line model marked as failed, where it is not selected."""
    bad = F.col("model") == "Prophet"
    best = tables.selection.select("service", F.col("model").alias("best"))
    metrics = tables.metrics.join(best, "service")
    failed = bad & (F.col("best") != "Prophet")
    columns = [
        F.when(~failed, F.col(name)).alias(name) for name in ("r2", "mae", "rmse", "mape", "smape")
    ]
    return tables._replace(
        metrics=metrics.select(
            "service", "model", *columns, "score", F.when(failed, F.lit("failed")).alias("error")
        )
    )


def report(make, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(make(closed_tables(spark, sf_dir), **options))

    return query


def compared(display: bool):
    """RPT-2 with failed models."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(reports.comparison(_with_failed(closed_tables(spark, sf_dir)), display))

    return query


_METRICS = 'r2 AS "R2{0}", mae AS "MAE{0}", rmse AS "RMSE{0}", smape AS "sMAPE{0}"'
_FAILED = "(m.model = 'Prophet' AND s.model <> 'Prophet')"
_NULLED = ", ".join(
    f'CASE WHEN NOT {_FAILED} THEN {c} END AS "{n}{{0}}"'
    for c, n in (("r2", "R2"), ("mae", "MAE"), ("rmse", "RMSE"), ("smape", "sMAPE"))
)


def comparison_sql(suffix: str, yes: str, no: str, failed: str, score: str) -> str:
    names = ", ".join(f"{n}{suffix}" for n in ("Score Composite", "R2", "MAE", "RMSE", "sMAPE"))
    names = names.replace(f"Score Composite{suffix}", "Score Composite")
    return sql(
        f"""SELECT m.service AS "Service", m.model AS "Modèle",
  CASE WHEN {_FAILED} THEN {failed} ELSE {score} END AS "Score Composite",
  CASE WHEN m.model = s.model THEN '{yes}' ELSE '{no}' END AS "Sélectionné", {_NULLED.format(suffix)}
FROM metrics m JOIN selection s ON m.service = s.service WHERE s.error IS NULL""",
        "metrics", "selection",
        doubles=names,
    )


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-4 without the title, whose number formatting is the engine's own."""
    return rounded(reports.chart_series(closed_tables(spark, sf_dir)).drop("title"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-7, AGG-4."""
    return rounded(reports.volume_and_trend(closed_tables(spark, sf_dir))[0])


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-7."""
    return reports.volume_and_trend(closed_tables(spark, sf_dir))[1]


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-5, WIN-3, MTH-3 on rounded scores: ties share a rank."""
    tables = closed_tables(spark, sf_dir)
    return reports.ranking(tables._replace(selection=rounded(tables.selection)))


def shown(name: str):
    """One table of the dashboard over the closed-form results."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(dashboard(closed_tables(spark, sf_dir), cost=1100)[name])

    return query


DASHBOARD_KPI_SQL = sql(
    """SELECT consultants, consultations, demand, mean_growth_percent, recommended_consultants,
  CASE WHEN recommended_consultants = 0 THEN 0.0
    ELSE least(100.0, consultants / recommended_consultants * 100) END AS coverage_percent,
  recommended_consultants * 1100.0::DOUBLE AS estimated_cost
FROM (SELECT 0.0::DOUBLE AS consultants, 0.0::DOUBLE AS consultations, sum(y) AS demand,
        CAST(trunc(sum(y) / 1000) AS BIGINT) AS recommended_consultants FROM eligible)
CROSS JOIN (SELECT avg((total - previous) / previous) * 100 AS mean_growth_percent FROM (
  SELECT total, lag(total) OVER (ORDER BY ds) AS previous FROM (
    SELECT ds, sum(y) AS total FROM eligible GROUP BY ds)))""",
    "eligible",
    doubles="mean_growth_percent, coverage_percent",
)


def fitted_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-3 from real fits: best forecasts of all series."""
    return reports.detail(forecast(mixed_series(spark, sf_dir), unique_dates=True))


def fitted_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RPT-2 from real fits."""
    return reports.comparison(forecast(mixed_series(spark, sf_dir), unique_dates=True))


_BAND4 = """CASE WHEN score >= 0.8 THEN 'Excellent' WHEN score >= 0.6 THEN 'Bon'
  WHEN score >= 0.4 THEN 'Moyen' ELSE 'Faible' END"""
_VIEW = """SELECT f.service, f.model, ds, yhat, m.score,
  CASE WHEN m.score >= 0.7 THEN 'Excellent' WHEN m.score >= 0.5 THEN 'Bon' ELSE 'Faible' END AS band,
  coalesce(r2, 0.0) AS r2, coalesce(mae, 0.0) AS mae, coalesce(rmse, 0.0) AS rmse,
  coalesce(smape, 0.0) AS smape
FROM forecasts f JOIN metrics m ON f.service = m.service AND f.model = m.model
JOIN selection s ON s.service = m.service WHERE kind = 'future' AND s.error IS NULL AND m.model = {}"""
_VIEW_DOUBLES = "yhat, score, r2, mae, rmse, smape"
_BEST = "forecasts f JOIN selection s ON f.service = s.service AND f.model = s.model"

QUERIES = {
    "rpt_summary": (
        report(reports.summary),
        sql(
            f"""SELECT s.service AS "Service", s.model AS "Meilleur Modèle", s.score AS "Score Composite",
                {_METRICS.format("")} FROM selection s JOIN metrics m
                ON s.service = m.service AND s.model = m.model""",
            "selection", "metrics",
            doubles="Score Composite, R2, MAE, RMSE, sMAPE",
        ),
    ),
    "rpt_summary_display": (
        report(reports.summary, display=True),
        sql(
            f"""SELECT s.service AS "Service", s.model AS "Meilleur Modèle", s.score AS "Score Composite",
                {_METRICS.format(" du Modèle")} FROM selection s JOIN metrics m
                ON s.service = m.service AND s.model = m.model""",
            "selection", "metrics",
            doubles="Score Composite, R2 du Modèle, MAE du Modèle, RMSE du Modèle, sMAPE du Modèle",
        ),
    ),
    "rpt_comparison": (compared(False), comparison_sql("", "Oui", "Non", "0.0", "m.score")),
    "rpt_comparison_display": (
        compared(True),
        comparison_sql(" du Modèle", "✅", "❌", "CAST('-inf' AS DOUBLE)", SQL_SCORE),
    ),
    "rpt_forecast_detail": (
        report(reports.detail),
        sql(
            f"""SELECT ds AS "Date", f.service AS "Service", yhat AS "Prévision" FROM {_BEST}
                WHERE kind = 'future'""",
            "forecasts", "selection",
            doubles="Prévision",
        ),
    ),
    "rpt_forecast_detail_fitted": (
        report(reports.detail, include_fitted=True),
        sql(
            f'SELECT ds AS "Date", f.service AS "Service", yhat AS "Prévision" FROM {_BEST}',
            "forecasts", "selection",
            doubles="Prévision",
        ),
    ),
    "rpt_chart_series": (
        charts,
        sql(
            f"""SELECT e.service, 'history' AS kind, model, ds, y AS value, score
                FROM eligible e JOIN selection s ON e.service = s.service
                UNION ALL SELECT f.service, 'forecast', f.model, ds, yhat, score FROM {_BEST}
                WHERE kind = 'future'""",
            "eligible", "forecasts", "selection",
            doubles="value, score",
        ),
    ),
    "rpt_run_summary": (
        report(reports.run_summary),
        sql(
            """SELECT count(*) FILTER (error IS NULL) AS services_ok, count(*) AS services_total,
               avg(score) FILTER (error IS NULL) AS mean_score,
               median(score) FILTER (error IS NULL) AS median_score,
               max(score) FILTER (error IS NULL) AS max_score,
               min(score) FILTER (error IS NULL) AS min_score FROM selection""",
            "selection",
            doubles="mean_score, median_score, max_score, min_score",
        ),
    ),
    "rpt_ranking": (
        ranking,
        sql(
            f"""SELECT rank() OVER (ORDER BY round(score + 1e-9, 6) DESC) AS rank, service, model, score, {_BAND4} AS band
                FROM selection WHERE error IS NULL""",
            "selection",
            doubles="score",
        ),
    ),
    "rpt_errors": (
        report(reports.errors),
        sql("SELECT service, error FROM selection WHERE error IS NOT NULL", "selection"),
    ),
    "rpt_volume": (
        volume,
        sql(
            """SELECT service, sum(y) AS volume, sum(y) * 100 / sum(sum(y)) OVER () AS percent
               FROM eligible GROUP BY service""",
            "eligible",
            doubles="percent",
        ),
    ),
    "rpt_trend": (trend, sql("SELECT ds, service, y FROM eligible", "eligible")),
    "dsh_overview": (
        shown("overview"),
        sql(
            """SELECT count(DISTINCT service) AS services, count(*) AS "rows",
               CAST(year(max(ds)) AS INTEGER) AS data_year FROM eligible""",
            "eligible",
        ),
    ),
    "dsh_kpis": (shown("kpis"), DASHBOARD_KPI_SQL),
    "rpt_fitted_detail": (fitted_detail, None),
    "rpt_fitted_comparison": (fitted_comparison, None),
    "flt_forecast_view_best": (
        report(reports.forecast_view),
        sql(_VIEW.format("s.model"), "forecasts", "metrics", "selection", doubles=_VIEW_DOUBLES),
    ),
    "flt_forecast_view_model": (
        report(reports.forecast_view, model="ARIMA"),
        sql(_VIEW.format("'ARIMA'"), "forecasts", "metrics", "selection", doubles=_VIEW_DOUBLES),
    ),
    "rsh_history_and_forecast": (
        report(reports.history_and_forecast),
        sql(
            f"""SELECT service, ds AS "Date", y AS "Historique", CAST(NULL AS DOUBLE) AS "Prévision"
                FROM eligible
                UNION ALL SELECT f.service, ds, NULL, yhat FROM {_BEST} WHERE kind = 'future'""",
            "eligible", "forecasts", "selection",
            doubles="Prévision",
        ),
    ),
}
