"""Queries on staffing indicators, costs and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.operators import kpi
from caseload.operators.kpi import coverage, recommended
from caseload.workload.tables import mixed_series, orders_series, rounded, sql, supplier_series

PER = 100


def kpi_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI-1..4, KPI-7."""
    return rounded(kpi.staffing_kpis(orders_series(spark, sf_dir), cost=1200, per_consultant=PER))


_TOTALS = """SELECT sum(y) FILTER (service = 'Nb Consultants') AS consultants,
  sum(y) FILTER (service = 'Nb Consultations') AS consultations, sum(y) AS demand FROM series"""
_MEAN_GROWTH = """SELECT avg((total - previous) / previous) * 100 AS mean_growth_percent FROM (
  SELECT total, lag(total) OVER (ORDER BY ds) AS previous FROM (
    SELECT ds, sum(y) AS total FROM series GROUP BY ds))"""
KPI_SQL = sql(
    f"""SELECT consultants, consultations, demand, mean_growth_percent, recommended_consultants,
  CASE WHEN recommended_consultants = 0 THEN 0.0
    ELSE least(100.0, consultants / recommended_consultants * 100) END AS coverage_percent,
  recommended_consultants * 1200.0::DOUBLE AS estimated_cost
FROM (SELECT *, CAST(trunc(demand / {PER}) AS BIGINT) AS recommended_consultants FROM ({_TOTALS}))
CROSS JOIN ({_MEAN_GROWTH})""",
    "series",
    doubles="mean_growth_percent, coverage_percent",
)


def consultants_per_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI-1/2/3 as expressions, per supplier instead of over everything."""
    sums = supplier_series(spark, sf_dir).groupBy("service").agg(
        F.sum("y").alias("demand"), F.count(F.lit(1)).alias("rows")
    )
    wanted = recommended(F.col("demand"), 37)
    staff = F.when(F.col("rows") % 2 == 0, F.col("rows")).otherwise(F.lit(0)).cast("double")
    return rounded(
        sums.select(
            "service",
            wanted.alias("recommended"),
            coverage(staff, wanted).alias("coverage"),
            (wanted * 1000).alias("cost"),
        )
    )


def mean_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI-4."""
    return rounded(kpi.mean_growth(orders_series(spark, sf_dir)))


def alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI-5: a priority disease above, below and without data."""
    series = orders_series(spark, sf_dir)
    return rounded(
        kpi.disease_alert(series)
        .unionByName(kpi.disease_alert(series, "Accouchements", 1e9))
        .unionByName(kpi.disease_alert(series, "Diarrhées"))
    )


_ALERT = """SELECT '{0}' AS service, avg(y) AS mean, CASE WHEN avg(y) IS NULL THEN 'no data'
  WHEN avg(y) > {1} THEN 'alert' ELSE 'ok' END AS state FROM series WHERE service = '{0}'"""


def growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-9: per supplier and customer, months with more than 20 % growth."""
    return rounded(kpi.growth_alerts(mixed_series(spark, sf_dir), by=["service"]))


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-1."""
    return rounded(kpi.efficiency(orders_series(spark, sf_dir)))


def high_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-2."""
    return rounded(kpi.high_efficiency(orders_series(spark, sf_dir)))


_MONTHS = """SELECT ds, coalesce(sum(y) FILTER (service = 'Nb Consultants'), 0.0) AS consultants,
  coalesce(sum(y) FILTER (service = 'Nb Consultations'), 0.0) AS consultations, sum(y) AS demand
  FROM series GROUP BY ds"""
_RATIO = f"""SELECT ds, consultations, consultants,
  CASE WHEN consultants <> 0 THEN consultations / consultants END AS efficiency FROM ({_MONTHS})"""


def seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-3."""
    return rounded(kpi.seasonal_staffing(orders_series(spark, sf_dir)))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-4."""
    return kpi.cost_benefit(orders_series(spark, sf_dir), per_consultant=10)


def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-5."""
    row = kpi.staffing_kpis(orders_series(spark, sf_dir), per_consultant=PER)
    return rounded(kpi.scenarios(row, [900, 1000], [0, 15, 37.5], per_consultant=PER))


QUERIES = {
    "kpi_row": (kpi_row, KPI_SQL),
    "kpi_per_supplier": (
        consultants_per_supplier,
        sql(
            """SELECT service, CAST(trunc(demand / 37) AS BIGINT) AS recommended,
               CASE WHEN trunc(demand / 37) = 0 THEN 0.0
                 ELSE least(100.0, CASE WHEN n % 2 = 0 THEN n ELSE 0 END / trunc(demand / 37) * 100) END
                 AS coverage,
               CAST(trunc(demand / 37) * 1000 AS BIGINT) AS cost
               FROM (SELECT service, sum(y) AS demand, count(*) AS n FROM sup GROUP BY service)""",
            "sup",
            doubles="coverage",
        ),
    ),
    "kpi_mean_growth": (mean_growth, sql(_MEAN_GROWTH, "series", doubles="mean_growth_percent")),
    "kpi_disease_alert": (
        alert,
        sql(
            " UNION ALL ".join(
                _ALERT.format(*a) for a in (("Paludisme", 10), ("Accouchements", 1e9), ("Diarrhées", 10))
            ),
            "series",
            doubles="mean",
        ),
    ),
    "dcl_growth_alerts": (
        growing,
        sql(
            """SELECT service, ds, y AS total, previous, (y - previous) / previous AS growth,
               coalesce((y - previous) / previous > 0.2, FALSE) AS alert
               FROM (SELECT *, lag(y) OVER (PARTITION BY service ORDER BY ds) AS previous FROM mixed)""",
            "mixed",
            doubles="growth",
        ),
    ),
    "dcl_efficiency": (ratios, sql(_RATIO, "series", doubles="efficiency")),
    "dcl_high_efficiency": (
        high_ratios,
        sql(
            f"""SELECT *, coalesce(efficiency > 1.1 * avg(efficiency) OVER (), FALSE) AS high_efficiency
                FROM ({_RATIO})""",
            "series",
            doubles="efficiency",
        ),
    ),
    "dcl_seasonal_staffing": (
        seasonal,
        sql(
            f"""SELECT mois, seasonal_index, seasonal_index * (SELECT avg(consultants) FROM ({_MONTHS}))
                  AS recommended_staff
                FROM (SELECT CAST(month(ds) AS INTEGER) AS mois,
                        avg(demand) / (SELECT avg(demand) FROM ({_MONTHS})) AS seasonal_index
                      FROM ({_MONTHS}) GROUP BY 1)""",
            "series",
            doubles="seasonal_index, recommended_staff",
        ),
    ),
    "dcl_cost_benefit": (
        costs,
        sql(
            f"""SELECT *, actual_cost - recommended_cost AS saving FROM (
                SELECT ds, consultants, CAST(trunc(demand / 10) AS BIGINT) AS recommended_consultants,
                  consultants * 1000 AS actual_cost, trunc(demand / 10) * 1000 AS recommended_cost
                FROM ({_MONTHS}))""",
            "series",
        ),
    ),
    "dcl_scenarios": (
        what_if,
        sql(
            f"""SELECT cost, growth_percent, demand, CAST(recommended AS BIGINT) AS recommended_consultants,
                  CASE WHEN recommended = 0 THEN 0.0 ELSE least(100.0, consultants / recommended * 100) END
                    AS coverage_percent,
                  recommended * cost AS estimated_cost
                FROM (SELECT *, trunc(demand / {PER}) AS recommended FROM (
                  SELECT cost, growth_percent, consultants, demand * (1 + growth_percent / 100) AS demand
                  FROM ({_TOTALS})
                  CROSS JOIN (VALUES (900.0::DOUBLE), (1000.0::DOUBLE)) AS c(cost)
                  CROSS JOIN (VALUES (0.0::DOUBLE), (15.0::DOUBLE), (37.5::DOUBLE)) AS g(growth_percent)))""",
            "series",
            doubles="demand, coverage_percent, estimated_cost",
        ),
    ),
}
