"""Queries on the models and on choosing among them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.functions.dates import month_ends_after
from caseload.functions.rules import SHORT_HISTORY_ERROR
from caseload.operators import fits
from caseload.operators import selection as sel
from caseload.operators.forecast import (
    fit_metrics,
    fit_series,
    forecast,
    forecast_rows,
    random_walk,
    series_arrays,
)
from caseload.plans.analysis import demand_forecast
from caseload.workload.tables import (
    closed_tables,
    mixed_series,
    orders_series,
    part_series,
    rounded,
    shipment_pairs,
    sql,
    supplier_series,
)
from caseload.operators.metrics import evaluate, with_score


def _fitted(df: DataFrame, models, min_rows: int = 12) -> DataFrame:
    ahead = F.transform(month_ends_after(F.col("last_ds"), F.lit(12)), F.unix_date)
    return fit_series(series_arrays(df, unique_dates=True).withColumn("future", ahead), models, min_rows)


def one_model(name: str, fit):
    """MOD-1..3: fitted and future rows of one model over all suppliers."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return forecast_rows(_fitted(supplier_series(spark, sf_dir), {name: fit}))

    return query


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-4."""
    return random_walk(supplier_series(spark, sf_dir), unique_dates=True).drop("error")


def walk_before_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-4 with DAT-3: history before 2001 forecast up to December 2002."""
    history = orders_series(spark, sf_dir, target_year=2001)
    walked = random_walk(history, target_year=2003)
    return walked.where(F.col("kind") == "future").select("service", "ds", "yhat")


def all_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-5: three models on all series, scored, best one selected."""
    return forecast(mixed_series(spark, sf_dir), unique_dates=True).selection


def many_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-5 over every part: which series were long enough, and that all got a model."""
    chosen = forecast(part_series(spark, sf_dir), unique_dates=True).selection
    return chosen.select(
        "service", "error", F.col("model").isNotNull().alias("has_model"), F.col("score").between(0, 1).alias("in_range")
    )


MANY_SQL = f"""SELECT 'P' || l_partkey AS service,
  CASE WHEN count(DISTINCT date_trunc('month', l_shipdate)) < 12 THEN '{SHORT_HISTORY_ERROR}' END AS error,
  count(DISTINCT date_trunc('month', l_shipdate)) >= 12 AS has_model, TRUE AS in_range
FROM lineitem GROUP BY l_partkey"""


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-1..3: dates, kinds and observed values of real fits, and two promises.

    Every forecast is a finite number, and a forest stays within its data.
    """
    history = supplier_series(spark, sf_dir)
    rows = forecast(history, unique_dates=True).forecasts
    limits = history.groupBy("service").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    finite = F.coalesce(F.abs("yhat") < float("inf"), F.lit(False))
    inside = (F.col("model") != "RandomForest") | F.col("yhat").between(F.col("low"), F.col("high"))
    return rows.join(limits, "service").select(
        "service", "model", "ds", "y", "kind", finite.alias("finite"), inside.alias("inside")
    )


CONTRACT_SQL = sql(
    """SELECT service, model, ds, y, kind, TRUE AS finite, TRUE AS inside FROM (
  SELECT service, ds, y, 'fitted' AS kind FROM sup
  UNION ALL
  SELECT service, last_day(last_ds + to_months(CAST(k AS INTEGER))), NULL, 'future'
  FROM (SELECT service, max(ds) AS last_ds FROM sup GROUP BY service) CROSS JOIN range(1, 13) AS steps(k))
CROSS JOIN (VALUES ('Prophet'), ('RandomForest'), ('ARIMA')) AS m(model)""",
    "sup",
)


def shared_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-5 on rows that share dates: every duplicate row is scored by itself."""
    cut = F.when(F.length("service") % 2 == 0, "even").otherwise("odd")
    merged = supplier_series(spark, sf_dir).withColumn("service", cut)
    return forecast(merged).metrics


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-6: six months of the key indicators."""
    tables = demand_forecast(orders_series(spark, sf_dir), periods=6)
    return tables.forecasts.where(F.col("kind") == "future")


def demand_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-6, DAT-3: which months are forecast with and without a target year."""
    history = orders_series(spark, sf_dir, target_year=2001)

    def dates(target_year: int | None) -> DataFrame:
        rows = demand_forecast(history, target_year=target_year).forecasts
        rows = rows.where(F.col("kind") == "future").select("service", "model", "ds")
        return rows.withColumn("target_year", F.lit(target_year).cast("int"))

    return dates(None).unionByName(dates(2003))


DEMAND_DATES_SQL = sql(
    """SELECT service, model, last_day(last_ds + to_months(CAST(k AS INTEGER))) AS ds, target_year
FROM (SELECT service, max(ds) AS last_ds FROM series WHERE ds < DATE '2001-01-01' GROUP BY service)
CROSS JOIN (VALUES ('Prophet'), ('RandomForest'), ('ARIMA')) AS m(model)
CROSS JOIN (VALUES (CAST(NULL AS INTEGER)), (2003)) AS t(target_year)
CROSS JOIN range(1, 40) AS steps(k)
WHERE k <= CASE WHEN target_year IS NULL THEN 12
  ELSE 12 - month(last_ds) + 12 * (2003 - year(last_ds) - 1) END""",
    "series",
)


def level_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-1..3, MOD-7: on suppliers' series held at their mean, every model repeats it exactly."""
    history = supplier_series(spark, sf_dir)
    level = history.groupBy("service").agg(F.round(F.avg("y"), 3).alias("y"))
    flat = history.select("service", "ds").join(level, "service")
    tables = forecast(flat, unique_dates=True)
    return tables.forecasts.select("service", "model", "ds", "yhat", "kind")


LEVEL_SQL = sql(
    """SELECT service, model, ds, yhat, kind FROM (
  SELECT service, ds, 'fitted' AS kind FROM sup
  UNION ALL
  SELECT service, last_day(last_ds + to_months(CAST(k AS INTEGER))), 'future'
  FROM (SELECT service, max(ds) AS last_ds FROM sup GROUP BY service) CROSS JOIN range(1, 13) AS steps(k))
JOIN (SELECT service, round(avg(y), 3) AS yhat FROM sup GROUP BY service) USING (service)
CROSS JOIN (VALUES ('Prophet'), ('RandomForest'), ('ARIMA')) AS m(model)""",
    "sup",
)


def failing_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-7: one model that always fails next to one that works."""

    def refuse(days, y, n, yy, future):
        raise ValueError("refused")

    models = {"Prophet": refuse, "ARIMA": fits.arima}
    metrics = fit_metrics(_fitted(supplier_series(spark, sf_dir), models))
    chosen = sel.best_model(metrics)
    return metrics.where(F.col("error").isNotNull()).join(
        chosen.select("service", F.col("model").alias("chosen")), "service"
    ).select("service", "model", "score", "error", "chosen")


FAILING_SQL = sql(
    """SELECT service, 'Prophet' AS model, 0.0::DOUBLE AS score, 'refused' AS error, 'ARIMA' AS chosen
       FROM sup GROUP BY service""",
    "sup",
)


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-2 on metrics of all shipments."""
    metrics = with_score(evaluate(shipment_pairs(spark, sf_dir)))
    scored = metrics.withColumn("error", F.lit(None).cast("string"))
    # Scores cut to two places tie often; the model registered first then wins.
    return sel.best_model(scored.withColumn("score", F.floor(F.col("score") * 100) / 100))


BEST_SQL = sql(
    """SELECT service, model, score, CAST(NULL AS VARCHAR) AS error FROM (
  SELECT *, row_number() OVER (PARTITION BY service ORDER BY score DESC,
    CASE model WHEN 'Prophet' THEN 0 WHEN 'RandomForest' THEN 1 ELSE 2 END) AS place FROM (
    SELECT service, model, floor((CASE WHEN r2 IS NULL THEN 0.0 ELSE 0.2 * greatest(0.0, least(1.0, r2))
      + 0.3 / (1 + mae) + 0.1 / (1 + rmse) + 0.4 / (1 + smape / 100) END) * 100) / 100 AS score
    FROM pair_metrics)) WHERE place = 1""",
    "pair_metrics",
)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-3 on rounded scores: ties share a rank."""
    return sel.rank_services(rounded(closed_tables(spark, sf_dir).selection))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14."""
    return rounded(sel.score_stats(closed_tables(spark, sf_dir).selection))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15."""
    return sel.models_index(closed_tables(spark, sf_dir).metrics)


def best_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-1, SET-3."""
    tables = closed_tables(spark, sf_dir)
    future = tables.forecasts.where(F.col("kind") == "future").select("service", "model", "ds", "yhat")
    return rounded(sel.best_forecast(tables.selection, future))


def successful_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-6, SET-2."""
    tables = closed_tables(spark, sf_dir)
    return sel.successful(tables.history, tables.selection)


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-5 plumbing with closed-form models: the selection table with its error rows."""
    return rounded(closed_tables(spark, sf_dir).selection)


def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI-6."""
    return rounded(sel.accepted(closed_tables(spark, sf_dir).selection, 0.4))


QUERIES = {
    "mod_trend_seasonality": (one_model("Prophet", fits.trend_seasonality), None),
    "mod_calendar_forest": (one_model("RandomForest", fits.calendar_forest), None),
    "mod_arima": (one_model("ARIMA", fits.arima), None),
    "mod_multiplicative_seasonality": (
        one_model("Prophet", partial(fits.trend_seasonality, multiplicative=True)), None,
    ),
    "mod_seasonal_difference": (
        one_model("ARIMA", partial(fits.arima, seasonal_difference=12)), None,
    ),
    "mod_random_walk": (
        walk,
        sql(
            """SELECT service, 'ARIMA' AS model, '0,1,0' AS variant, ds, y,
               coalesce(lag(y) OVER (PARTITION BY service ORDER BY ds), 0.0) AS yhat, 'fitted' AS kind FROM sup
               UNION ALL
               SELECT service, 'ARIMA', '0,1,0', last_day(last_ds + to_months(CAST(k AS INTEGER))), NULL,
                 last_y, 'future'
               FROM (SELECT service, max(ds) AS last_ds, arg_max(y, ds) AS last_y FROM sup GROUP BY service)
               CROSS JOIN range(1, 13) AS steps(k)""",
            "sup",
        ),
    ),
    "mod_random_walk_target_year": (
        walk_before_year,
        sql(
            """SELECT service, last_day(last_ds + to_months(CAST(k AS INTEGER))) AS ds, last_y AS yhat
               FROM (SELECT service, max(ds) AS last_ds, arg_max(y, ds) AS last_y FROM series
                     WHERE ds < DATE '2001-01-01' GROUP BY service)
               CROSS JOIN range(1, 40) AS steps(k)
               WHERE k <= 12 - month(last_ds) + 12 * (2003 - year(last_ds) - 1)""",
            "series",
        ),
    ),
    "mod_contract": (contract, CONTRACT_SQL),
    "mod_all_models": (all_models, None),
    "mod_many_series": (many_series, MANY_SQL),
    "mod_shared_dates": (shared_dates, None),
    "mod_demand_forecast": (demand, None),
    "mod_demand_dates": (demand_dates, DEMAND_DATES_SQL),
    "mod_level_series": (level_models, LEVEL_SQL),
    "mod_failure_capture": (failing_model, FAILING_SQL),
    "mod_selection_table": (
        selection, sql("SELECT * FROM selection", "selection", doubles="score"),
    ),
    "win_best_model": (best, BEST_SQL),
    "win_rank_services": (
        ranked,
        sql(
            """SELECT rank() OVER (ORDER BY round(score + 1e-9, 6) DESC) AS rank, service, model, score
               FROM selection WHERE error IS NULL""",
            "selection",
            doubles="score",
        ),
    ),
    "agg_score_stats": (
        statistics,
        sql(
            """SELECT avg(score) AS mean_score, median(score) AS median_score, max(score) AS max_score,
               min(score) AS min_score FROM selection WHERE error IS NULL""",
            "selection",
            doubles="mean_score, median_score, max_score, min_score",
        ),
    ),
    "agg_models_index": (index, sql("SELECT DISTINCT model, service FROM metrics", "metrics")),
    "jon_best_forecast": (
        best_forecasts,
        sql(
            """SELECT service, model, ds, yhat, score FROM forecasts JOIN selection USING (service, model)
               WHERE kind = 'future'""",
            "forecasts", "selection",
            doubles="yhat, score",
        ),
    ),
    "flt_successful_history": (
        successful_history,
        sql(
            "SELECT * FROM mixed WHERE service IN (SELECT service FROM selection WHERE error IS NULL)",
            "mixed", "selection",
        ),
    ),
    "kpi_accepted": (
        acceptance,
        sql(
            "SELECT *, error IS NULL AND score >= 0.4 AS accepted FROM selection", "selection",
            doubles="score",
        ),
    ),
}
