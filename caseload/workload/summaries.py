"""Queries on aggregations, windows, sorts and unions over series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.operators import metrics as m
from caseload.operators import series as s
from caseload.operators.prepare import in_series_order, split_by_history
from caseload.workload.tables import (
    SQL_EVALUATE,
    customer_series,
    mixed_series,
    orders_long,
    orders_series,
    read,
    rounded,
    shipment_pairs,
    sql,
    supplier_series,
)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1."""
    return s.row_counts(mixed_series(spark, sf_dir))


def service_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-2."""
    return s.services(mixed_series(spark, sf_dir))


def newest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3, straight on the shipments."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ds"))
    return s.latest_year(rows)


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-4."""
    return rounded(s.volume_share(supplier_series(spark, sf_dir)))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-5."""
    return s.monthly_totals(mixed_series(spark, sf_dir))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-6."""
    return s.overview(mixed_series(spark, sf_dir))


NAMED = ["Nb Consultants", "Nb Consultations"]


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7."""
    return s.named_totals(orders_series(spark, sf_dir), NAMED)


def one_metric(name: str):
    """AGG-8..12 on every shipment, one metric per query."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = getattr(m, name)(F.col("y"), F.col("yhat"))
        grouped = shipment_pairs(spark, sf_dir).groupBy("service", "model")
        return rounded(grouped.agg(value.alias(name)))

    return query


def one_metric_sql(name: str) -> str:
    return sql(
        f"SELECT service, model, {name} FROM (SELECT service, model, {SQL_EVALUATE} FROM pairs "
        "GROUP BY service, model)",
        "pairs",
        doubles=name,
    )


def all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13."""
    return rounded(m.evaluate(shipment_pairs(spark, sf_dir)))


def mean_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16."""
    return rounded(s.mean_of(orders_series(spark, sf_dir), "Paludisme"))


def one_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-7."""
    return s.only(orders_series(spark, sf_dir), "Paludisme")


def long_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5: rows of series with at least 12 of them."""
    return split_by_history(mixed_series(spark, sf_dir))[0]


def too_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5: series with fewer than 12 rows."""
    return split_by_history(mixed_series(spark, sf_dir))[1]


def overall_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-1."""
    return rounded(s.growth(orders_series(spark, sf_dir)))


def service_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-1 per indicator."""
    return rounded(s.growth(mixed_series(spark, sf_dir), by=["service"]))


_GROWTH = """CASE WHEN previous = 0 THEN CASE WHEN total > 0 THEN CAST('inf' AS DOUBLE)
  WHEN total < 0 THEN CAST('-inf' AS DOUBLE) END ELSE (total - previous) / previous END AS growth"""


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-4/5."""
    return s.series_bounds(mixed_series(spark, sf_dir))


def yearly_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-1: yearly tables put together again, as a bag."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
    early = rows.where(F.col("date") < "1998-01-01")
    late = rows.where(F.col("date") >= "1998-01-01")
    whole = s.union_years(early, late)
    return whole.groupBy(F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity")
    )


QUERIES = {
    "agg_row_counts": (counts, sql('SELECT service, count(*) AS "rows" FROM mixed GROUP BY 1', "mixed")),
    "agg_services": (service_list, sql("SELECT DISTINCT service FROM mixed", "mixed")),
    "agg_latest_year": (
        newest_year, "SELECT CAST(year(max(l_shipdate)) AS INTEGER) AS latest_year FROM lineitem",
    ),
    "agg_volume_share": (
        shares,
        sql(
            """SELECT service, sum(y) AS volume, sum(y) * 100 / sum(sum(y)) OVER () AS percent
               FROM sup GROUP BY service""",
            "sup",
            doubles="volume, percent",
        ),
    ),
    "agg_monthly_totals": (totals, sql("SELECT ds, sum(y) AS total FROM mixed GROUP BY 1", "mixed")),
    "agg_overview": (
        tiles,
        sql(
            """SELECT count(DISTINCT service) AS services, count(*) AS "rows",
               CAST(year(max(ds)) AS INTEGER) AS data_year FROM mixed""",
            "mixed",
        ),
    ),
    "agg_named_totals": (
        named,
        sql(
            """SELECT sum(y) FILTER (service = 'Nb Consultants') AS "Nb Consultants",
               sum(y) FILTER (service = 'Nb Consultations') AS "Nb Consultations", sum(y) AS "all"
               FROM series""",
            "series",
        ),
    ),
    **{f"agg_{name}": (one_metric(name), one_metric_sql(name)) for name in ("mae", "rmse", "r2", "mape", "smape")},
    "agg_evaluation": (
        all_metrics,
        sql("SELECT * FROM pair_metrics", "pair_metrics", doubles="r2, mae, rmse, mape, smape"),
    ),
    "agg_mean_of": (
        mean_of_one,
        sql("SELECT avg(y) AS mean FROM series WHERE service = 'Paludisme'", "series", doubles="mean"),
    ),
    "flt_one_service": (
        one_service, sql("SELECT ds, service, y FROM series WHERE service = 'Paludisme'", "series"),
    ),
    "flt_long_enough": (long_enough, sql("SELECT service, ds, y FROM eligible", "eligible")),
    "flt_too_short": (
        too_short,
        sql('SELECT service, count(*) AS "rows" FROM mixed GROUP BY 1 HAVING count(*) < 12', "mixed"),
    ),
    "win_growth": (
        overall_growth,
        sql(
            f"""SELECT ds, total, previous, {_GROWTH} FROM (SELECT ds, total, lag(total) OVER (ORDER BY ds)
                AS previous FROM (SELECT ds, sum(y) AS total FROM series GROUP BY ds))""",
            "series",
            doubles="growth",
        ),
    ),
    "win_growth_per_service": (
        service_growth,
        sql(
            f"""SELECT service, ds, y AS total, previous, {_GROWTH.replace('total', 'y')} FROM (
                SELECT *, lag(y) OVER (PARTITION BY service ORDER BY ds) AS previous FROM mixed)""",
            "mixed",
            doubles="growth",
        ),
    ),
    "win_series_bounds": (
        bounds,
        sql(
            """SELECT service, min(ds) AS first_ds, max(ds) AS last_ds, arg_max(y, ds) AS last_y,
               count(*) AS "rows" FROM mixed GROUP BY service""",
            "mixed",
        ),
    ),
    "srt_by_date": (
        lambda spark, sf_dir: s.by_date(orders_long(spark, sf_dir)),
        sql('SELECT date, SERVICE AS "SERVICE", valeur FROM orders_long', "orders_long"),
    ),
    "srt_by_series": (
        lambda spark, sf_dir: in_series_order(customer_series(spark, sf_dir)),
        sql("SELECT service, ds, y FROM cus ORDER BY service, ds", "cus"),
    ),
    "set_yearly_union": (
        yearly_union,
        """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS "rows", sum(l_quantity) AS quantity
           FROM lineitem GROUP BY 1""",
    ),
}
