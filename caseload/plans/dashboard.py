"""The dashboard's tables over stored results: overview, forecasts, indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from caseload.operators.forecast import ForecastTables
from caseload.operators.kpi import DEFAULT_COST, disease_alert, staffing_kpis
from caseload.operators.selection import accepted, models_index, successful
from caseload.operators.series import overview
from caseload.plans.reports import errors, forecast_view, history_and_forecast, volume_and_trend


def dashboard(
    tables: ForecastTables, model: str = "best", cost: float = DEFAULT_COST
) -> dict[str, DataFrame]:
    """Every table the dashboard shows, by name; all of them see successful series only.

    ``model`` chooses the forecasts shown, ``cost`` is one consultant's month.
    """
    history = successful(tables.history, tables.selection)
    share, trend = volume_and_trend(tables)
    return {
        "overview": overview(history),
        "volume": share,
        "trend": trend,
        "models": models_index(tables.metrics),
        "forecasts": forecast_view(tables, model),
        "curves": history_and_forecast(tables, model),
        "errors": errors(tables),
        "kpis": staffing_kpis(history, cost),
        "disease_alert": disease_alert(history),
        "accepted": accepted(tables.selection),
    }
