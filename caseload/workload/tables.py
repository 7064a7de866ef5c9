"""Series derived from the given tables, in Spark and in SQL side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.functions.dates import month_index
from caseload.functions.rules import (
    INDICATOR_RULES,
    KEY_INDICATORS,
    MIN_HISTORY_ROWS,
    MODEL_ORDER,
    SHORT_HISTORY_ERROR,
)
from caseload.operators.forecast import ForecastTables, random_walk
from caseload.operators.metrics import evaluate, with_score
from caseload.operators.prepare import prepare, split_by_history
from caseload.operators.selection import best_model
from caseload.operators.series import union_years
from caseload.session import materialise

# Raw indicator names given to the order priorities; the last one is no key indicator.
PRIORITY_LABELS = {
    "1-URGENT": "Nombre de consultants",
    "2-HIGH": "NOMBRE DE CONSULTATIONS",
    "3-MEDIUM": "TOTAL PALUDISME",
    "4-NOT SPECIFIED": "accouchement en ÉTABLISSEMENT",
    "5-LOW": "Service Inconnu",
}


# Added before rounding for comparison: above summation noise, below the last place.
NUDGE = 1e-9


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so that two engines agree on the text.

    The nudge keeps exact halves, which sums in another order may miss by a hair,
    on the same side in both.
    """
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`") + NUDGE, places).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def month(column: str) -> Column:
    return F.trunc(F.col(column), "month")


def priority_label(priority: Column) -> Column:
    branches = F
    for code, label in PRIORITY_LABELS.items():
        branches = branches.when(priority == code, F.lit(label))
    return branches


def orders_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly orders per raw label: ``date, SERVICE, valeur``.

    Orders are counted per priority first; names are given to the few groups. The
    label hangs on the count, so that no filter on it moves below the aggregate,
    where it would be computed for every order.
    """
    counts = (
        read(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", month("o_orderdate").alias("date"))
        .agg(F.count(F.lit(1)).cast("double").alias("valeur"))
    )
    label = F.when(F.col("valeur") > 0, priority_label(F.col("o_orderpriority")))
    return counts.select("date", label.alias("SERVICE"), "valeur")


def orders_series(spark: SparkSession, sf_dir: str, target_year: int | None = None) -> DataFrame:
    """Key-indicator series of the orders: ``ds, service, y``."""
    return prepare(orders_long(spark, sf_dir), target_year, per="row")


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly shipped quantity per supplier."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", month("l_shipdate").alias("ds"))
        .agg(F.sum("l_quantity").alias("y"))
        .select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("service"), "ds", "y")
    )


def part_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly shipped quantity per part: the most series the tables hold."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", month("l_shipdate").alias("ds"))
        .agg(F.sum("l_quantity").alias("y"))
        .select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("service"), "ds", "y")
    )


def customer_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly orders per customer; many customers have fewer than 12 months."""
    return (
        read(spark, sf_dir, "orders")
        .groupBy("o_custkey", month("o_orderdate").alias("ds"))
        .agg(F.count(F.lit(1)).cast("double").alias("y"))
        .select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("service"), "ds", "y")
    )


def mixed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers together: long and short series."""
    return union_years(supplier_series(spark, sf_dir), customer_series(spark, sf_dir))


def shipment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shipment as a pair of a value and an estimate of it, in three groups."""
    flag = F.col("l_returnflag")
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("service"),
        F.when(flag == "A", "Prophet").when(flag == "N", "RandomForest").otherwise("ARIMA").alias("model"),
        F.col("l_quantity").alias("y"),
        (F.col("l_extendedprice") / 1500).alias("yhat"),
    )


def closed_forecasts(df: DataFrame) -> DataFrame:
    """Forecast rows of three models in closed form, so that SQL can check the plumbing.

    ARIMA is the random walk; RandomForest the mean of the calendar month;
    Prophet a straight line through the months. All windows share the walk's
    partitioning on the indicator: one shuffle, no join.
    """
    whole = Window.partitionBy("service")
    same_month = Window.partitionBy("service", "month")
    at = month_index(F.col("ds")).cast("double")
    walk = random_walk(df, unique_dates=True).select("service", "ds", "y", "yhat", "kind", F.month("ds").alias("month"))
    placed = walk.withColumn("x", at).select(
        "service",
        "ds",
        "y",
        "kind",
        "yhat",
        F.coalesce(F.avg("y").over(same_month), F.avg("y").over(whole)).alias("seasonal"),
        (
            F.regr_intercept("y", "x").over(whole) + F.regr_slope("y", "x").over(whole) * F.col("x")
        ).alias("straight"),
    )
    models = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.col(column).alias("yhat"))
            for name, column in (
                ("ARIMA", "yhat"), ("RandomForest", "seasonal"), ("Prophet", "straight"),
            )
        ]
    )
    return placed.select("service", "ds", "y", "kind", F.inline(models))


def closed_tables(spark: SparkSession, sf_dir: str) -> ForecastTables:
    """Result tables of the closed-form models over the mixed series.

    The monthly series and the forecasts feed many tables: both are written once,
    so the shipments and orders are scanned once per run.
    """
    history = materialise(mixed_series(spark, sf_dir), "series")
    eligible, short = split_by_history(history)
    forecasts = materialise(closed_forecasts(eligible), "closed")
    none = F.lit(None).cast("string")
    metrics = with_score(evaluate(forecasts.where(F.col("kind") == "fitted"))).withColumn("error", none)
    rejected = short.select(
        "service", none.alias("model"), F.lit(0.0).alias("score"), F.lit(SHORT_HISTORY_ERROR).alias("error")
    )
    selection = best_model(metrics).unionByName(rejected)
    return ForecastTables(history, forecasts.withColumn("error", none), metrics, selection)


# --- the same in SQL ---------------------------------------------------------

# RE2 has no look-ahead: "not followed by < on this line" is spelled out.
_SQL_RULES = [
    (pattern.replace("(?!.*<)", r"[^<\n]*(\n|\z)"), name) for pattern, name in INDICATOR_RULES
]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_standardise(column: str) -> str:
    clean = f"trim({column})"
    whens = " ".join(
        f"WHEN regexp_matches({clean}, {quoted(pattern)}, 'i') THEN {quoted(name)}"
        for pattern, name in _SQL_RULES
    )
    return f"CASE {whens} ELSE {clean} END"


SQL_KEYS = ", ".join(quoted(name) for name in KEY_INDICATORS)
_LABEL_CASE = "CASE o_orderpriority {} END".format(
    " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in PRIORITY_LABELS.items())
)

SQL_EVALUATE = """
    CASE WHEN count(y) < 2 THEN NULL
         WHEN min(y) = max(y) THEN CASE WHEN sum((y - yhat) * (y - yhat)) = 0 THEN 1.0 ELSE 0.0 END
         ELSE 1 - sum((y - yhat) * (y - yhat)) / (count(y) * var_pop(y)) END AS r2,
    avg(abs(y - yhat)) AS mae,
    sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
    avg(abs((y - yhat) / (y + 1e-8))) * 100 AS mape,
    avg(CASE WHEN abs(y) + abs(yhat) = 0 THEN 0.0
        ELSE abs(yhat - y) / ((abs(y) + abs(yhat)) / 2) END) * 100 AS smape"""

SQL_SCORE = (
    "CASE WHEN r2 IS NULL OR mae IS NULL OR rmse IS NULL OR smape IS NULL THEN 0.0 ELSE "
    "greatest(0.0, least(1.0, 0.2 * greatest(0.0, least(1.0, r2)) + 0.3 / (1 + mae) "
    "+ 0.1 / (1 + rmse) + 0.4 / (1 + smape / 100))) END"
)

_MODEL_RANK = "CASE model {} END".format(
    " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(MODEL_ORDER))
)

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "orders_long": (
        (),
        f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
            {_LABEL_CASE} AS SERVICE, CAST(count(*) AS DOUBLE) AS valeur
            FROM orders GROUP BY 1, 2""",
    ),
    "named": (
        ("orders_long",),
        f"SELECT date AS ds, {sql_standardise('SERVICE')} AS service, valeur AS y FROM orders_long",
    ),
    "series": (("named",), f"SELECT ds, service, y FROM named WHERE service IN ({SQL_KEYS})"),
    "sup": (
        (),
        """SELECT 'S' || l_suppkey AS service, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
            sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2""",
    ),
    "cus": (
        (),
        """SELECT 'C' || o_custkey AS service, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
            CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY 1, 2""",
    ),
    "mixed": (("sup", "cus"), "SELECT * FROM sup UNION ALL SELECT * FROM cus"),
    "pairs": (
        (),
        """SELECT 'S' || l_suppkey AS service,
            CASE l_returnflag WHEN 'A' THEN 'Prophet' WHEN 'N' THEN 'RandomForest' ELSE 'ARIMA' END AS model,
            l_quantity AS y, l_extendedprice / 1500 AS yhat FROM lineitem""",
    ),
    "pair_metrics": (
        ("pairs",),
        f"SELECT service, model, {SQL_EVALUATE} FROM pairs GROUP BY service, model",
    ),
    "eligible": (
        ("mixed",),
        f"""SELECT * FROM mixed WHERE service IN
            (SELECT service FROM mixed GROUP BY service HAVING count(*) >= {MIN_HISTORY_ROWS})""",
    ),
    "last_rows": (
        ("eligible",),
        "SELECT service, max(ds) AS last_ds, arg_max(y, ds) AS last_y FROM eligible GROUP BY service",
    ),
    "dated": (
        ("eligible", "last_rows"),
        """SELECT service, ds, y, 'fitted' AS kind FROM eligible
            UNION ALL
            SELECT service, last_day(last_ds + to_months(CAST(k AS INTEGER))), NULL, 'future'
            FROM last_rows CROSS JOIN range(1, 13) AS steps(k)""",
    ),
    "walk": (
        ("eligible", "last_rows", "dated"),
        """SELECT service, 'ARIMA' AS model, ds, y,
            coalesce(lag(y) OVER (PARTITION BY service ORDER BY ds), 0.0) AS yhat, 'fitted' AS kind
            FROM eligible
            UNION ALL
            SELECT service, 'ARIMA', ds, NULL, last_y, 'future'
            FROM dated JOIN last_rows USING (service) WHERE kind = 'future'""",
    ),
    "forecasts": (
        ("walk", "dated", "eligible"),
        """SELECT * FROM walk
            UNION ALL
            SELECT service, 'RandomForest', ds, y,
              coalesce(avg(y) OVER (PARTITION BY service, month(ds)), avg(y) OVER (PARTITION BY service)),
              kind FROM dated
            UNION ALL
            SELECT service, 'Prophet', ds, y, intercept + slope * (year(ds) * 12 + month(ds)), kind
            FROM dated JOIN (
              SELECT service, regr_slope(y, CAST(year(ds) * 12 + month(ds) AS DOUBLE)) AS slope,
                regr_intercept(y, CAST(year(ds) * 12 + month(ds) AS DOUBLE)) AS intercept
              FROM eligible GROUP BY service) USING (service)""",
    ),
    "measured": (
        ("forecasts",),
        f"""SELECT service, model, {SQL_EVALUATE} FROM forecasts
            WHERE kind = 'fitted' GROUP BY service, model""",
    ),
    "metrics": (("measured",), f"SELECT *, {SQL_SCORE} AS score FROM measured"),
    "placed": (
        ("metrics",),
        f"""SELECT service, model, score, row_number() OVER (
            PARTITION BY service ORDER BY score DESC, {_MODEL_RANK}) AS place FROM metrics""",
    ),
    "selection": (
        ("placed", "mixed"),
        f"""SELECT service, model, score, CAST(NULL AS VARCHAR) AS error FROM placed WHERE place = 1
            UNION ALL
            SELECT service, NULL, 0.0, {quoted(SHORT_HISTORY_ERROR)} FROM mixed
            GROUP BY service HAVING count(*) < {MIN_HISTORY_ROWS}""",
    ),
}


def sql(body: str, *names: str, doubles: str = "") -> str:
    """A query over the named CTEs; ``doubles`` lists the columns to round."""
    needed: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        need(name)
    head = "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in needed) if needed else ""
    if doubles:
        changes = ", ".join(
            f'round("{c}" + {NUDGE}, 6) AS "{c}"' for c in (d.strip() for d in doubles.split(","))
        )
        body = f"SELECT * REPLACE ({changes}) FROM ({body})"
    return f"{head}\n{body}"


