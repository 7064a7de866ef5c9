"""caseload: monthly activity series on Spark, from matrix files to staffing reports."""

from caseload.operators.forecast import ForecastTables, forecast
from caseload.operators.prepare import prepare
from caseload.plans.analysis import demand_forecast, load_and_prepare, run_full_analysis
from caseload.plans.dashboard import dashboard
from caseload.session import configure, local_session, release
from caseload.sources.matrices import read_matrices
from caseload.sources.results import load_results, save_reports, save_results

__all__ = [
    "ForecastTables",
    "configure",
    "dashboard",
    "demand_forecast",
    "forecast",
    "load_and_prepare",
    "load_results",
    "local_session",
    "prepare",
    "read_matrices",
    "release",
    "run_full_analysis",
    "save_reports",
    "save_results",
]
