"""Queries on data-quality screens, validation splits and forecast options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.operators import conformal, quality, sarima, unit_root
from caseload.operators.prepare import split_by_history
from caseload.operators.validation import backtest, backtest_splits
from caseload.plans.reports import summary
from caseload.session import materialise
from caseload.workload.tables import (
    NUDGE,
    closed_tables,
    mixed_series,
    read,
    rounded,
    sql,
    supplier_series,
)


def averaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-6."""
    return rounded(quality.ensemble(closed_tables(spark, sf_dir).forecasts))


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-6 weighted by score."""
    tables = closed_tables(spark, sf_dir)
    return rounded(quality.ensemble(tables.forecasts, tables.metrics))


def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-7 on every single shipment of every supplier."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("service"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y")
    )
    return rounded(quality.flag_outliers(rows, sigmas=1.7)).select(
        "service", "l_orderkey", "l_linenumber", "y", "outlier"
    )


def series_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-7 on the monthly series at the default of three deviations."""
    return rounded(quality.flag_outliers(mixed_series(spark, sf_dir)))


def filled(strategy: str):
    """DCL-8: customers order in few months, so most months are gaps."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(quality.fill_gaps(mixed_series(spark, sf_dir), strategy))

    return query


_STEPS = """SELECT service, ds, y, next_y, k, gap FROM (
  SELECT *, lead(y) OVER w AS next_y,
    coalesce((year(lead(ds) OVER w) * 12 + month(lead(ds) OVER w)) - (year(ds) * 12 + month(ds)), 1) AS gap
  FROM mixed WINDOW w AS (PARTITION BY service ORDER BY ds)), unnest(range(0, gap)) AS steps(k)"""


def _filled_sql(value: str) -> str:
    return sql(
        f"""SELECT service, CAST(ds + to_months(CAST(k AS INTEGER)) AS DATE) AS ds,
            CASE WHEN k = 0 THEN y ELSE {value} END AS y, k > 0 AS filled FROM ({_STEPS})""",
        "mixed",
        doubles="y",
    )


def model_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-10 on rounded metrics, so that both engines see the same side of a limit."""
    return quality.quality_alerts(rounded(closed_tables(spark, sf_dir).metrics.drop("error")))


_ROUNDED = ", ".join(
    f"round({c} + {NUDGE}, 6) AS {c}" for c in ("r2", "mae", "rmse", "mape", "smape", "score")
)


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-11: the folds."""
    return backtest_splits(mixed_series(spark, sf_dir))


_SPLITS_BODY = """SELECT service, CAST(fold AS INTEGER) AS fold, ds, y,
  CASE WHEN pos <= trained THEN 'train' ELSE 'test' END AS role FROM (
  SELECT *, n - (4 - fold) * tested AS trained FROM (
    SELECT *, greatest(1, floor(n * 0.2)) AS tested FROM (
      SELECT *, row_number() OVER (PARTITION BY service ORDER BY ds) AS pos,
        count(*) OVER (PARTITION BY service) AS n FROM mixed)
    CROSS JOIN range(1, 4) AS folds(fold)))
WHERE trained >= 6 AND pos <= trained + tested"""
SPLITS_SQL = sql(_SPLITS_BODY, "mixed")


def out_of_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-11: metrics of all models on data they have not seen."""
    return backtest(supplier_series(spark, sf_dir))


def _null_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as series by return flag, one of which is turned into a null label."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flag = F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))
    return items.select(
        flag.alias("service"), F.col("l_shipdate").cast("date").alias("ds"), F.col("l_quantity").cast("double").alias("y")
    )


def null_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-7 with a null label: its rows are kept and screened."""
    flagged = quality.flag_outliers(_null_labels(spark, sf_dir), 1.5)
    return flagged.groupBy("service").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("outlier").alias("outliers")
    )


def null_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5 with a null label: a series like any other."""
    enough, short = split_by_history(_null_labels(spark, sf_dir))
    sizes = enough.groupBy("service").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.withColumn("enough", F.lit(True)).unionByName(short.withColumn("enough", F.lit(False)))


_NULL_LABELS = "SELECT nullif(l_returnflag, 'R') AS service, CAST(l_quantity AS DOUBLE) AS y FROM lineitem"


def unit_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-12."""
    return rounded(quality.stationarity(supplier_series(spark, sf_dir)))


STATIONARITY_SQL = sql(
    """SELECT service, n, t, coalesce(t < -2.86, FALSE) AS stationary FROM (
  SELECT service, n, CASE WHEN n > 2 AND syy - slope * sxy > 0
    THEN slope / sqrt((syy - slope * sxy) / (n - 2) / sxx) END AS t FROM (
    SELECT service, count(*) AS n, regr_slope(d, x) AS slope, regr_sxx(d, x) AS sxx,
      regr_syy(d, x) AS syy, regr_sxy(d, x) AS sxy
    FROM (SELECT service, x, y - x AS d FROM (
      SELECT service, y, lag(y) OVER (PARTITION BY service ORDER BY ds) AS x FROM sup) WHERE x IS NOT NULL)
    GROUP BY service))""",
    "sup",
    doubles="t",
)


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-13."""
    return quality.low_volume(mixed_series(spark, sf_dir))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-14."""
    return rounded(quality.intervals(closed_tables(spark, sf_dir).forecasts))


INTERVALS_SQL = sql(
    """SELECT service, model, ds, yhat, yhat - width AS yhat_lower, yhat + width AS yhat_upper FROM (
  SELECT service, model, ds, yhat, 1.959963984540054 * sd * CASE model WHEN 'ARIMA'
    THEN sqrt(year(ds) * 12 + month(ds) - year(last_ds) * 12 - month(last_ds)) ELSE 1.0 END AS width
  FROM forecasts JOIN (
    SELECT service, model, stddev_samp(CASE WHEN before IS NOT NULL THEN y - yhat END) AS sd, max(ds) AS last_ds
    FROM (SELECT *, lag(ds) OVER (PARTITION BY service, model ORDER BY ds) AS before
          FROM forecasts WHERE kind = 'fitted') GROUP BY service, model) USING (service, model)
  WHERE kind = 'future')""",
    "forecasts",
    doubles="yhat, yhat_lower, yhat_upper",
)


def seasonal_arima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-16: (1,1,1)(1,1,1,12) coefficients of every supplier series by two-stage regression."""
    return rounded(sarima.two_stage(supplier_series(spark, sf_dir)))


def _lag_sql(column: str, k: int) -> str:
    return f"max({column}) OVER (PARTITION BY service ORDER BY m RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)"


def _gram_sql(xs: list[str], y: str, ok: str) -> tuple[list[str], str, str]:
    """Sums of a regression over the rows where ``ok`` holds, the augmented rows, the right side."""
    sums = [f"count(CASE WHEN {ok} THEN 1 END) AS n"]
    for i, a in enumerate(xs):
        sums += [f"sum(CASE WHEN {ok} THEN {a} * {b} END) AS g_{a}_{b}" for b in xs[i:]]
        sums.append(f"sum(CASE WHEN {ok} THEN {a} * {y} END) AS g_{a}_{y}")
    sums.append(f"sum(CASE WHEN {ok} THEN {y} * {y} END) AS g_{y}_{y}")

    def g(a: str, b: str) -> str:
        return f"g_{a}_{b}" if xs.index(a) <= xs.index(b) else f"g_{b}_{a}"

    flat = ", ".join(cell for a in xs for cell in (*[g(a, b) for b in xs], f"g_{a}_{y}"))
    return sums, f"[{flat}]", "[" + ", ".join(f"g_{a}_{y}" for a in xs) + "]"


def _solve_sql(flat: str, n: int) -> str:
    """Gauss-Jordan over the augmented rows, as in ``sarima.solve``: the reduced array."""
    w = n + 1
    pivot = f"m[k * {w} + k + 1]"
    cell = (
        f"CASE WHEN (idx - 1) // {w} = k THEN v / nullif({pivot}, 0) "
        f"ELSE v - m[((idx - 1) // {w}) * {w} + k + 1] * (m[k * {w} + (idx - 1) % {w} + 1] / nullif({pivot}, 0)) END"
    )
    return f"list_reduce(range(0, {n}), lambda m, k: list_transform(m, lambda v, idx: {cell}), {flat})"


def _seasonal_body(season: int = sarima.SEASON, long_order: int = sarima.LONG_ORDER) -> str:
    """The coefficients of ``sarima.two_stage`` as SQL over the CTE ``sup``, unrounded."""
    lags = [f"w{k}" for k in range(1, long_order + 1)]
    ok1 = " AND ".join(f"{c} IS NOT NULL" for c in ["w", *lags])
    sums1, flat1, _ = _gram_sql(lags, "w", ok1)
    n1 = len(lags)
    seasonal = (1, season, season + 1)
    regs = [f"w{k}" for k in seasonal] + [f"e{k}" for k in seasonal]
    ok2 = " AND ".join(f"{c} IS NOT NULL" for c in ["w", *regs])
    sums2, flat2, right2 = _gram_sql(regs, "w", ok2)
    n2 = len(regs)
    guess = "0.0" + "".join(f" + alpha[{i + 1}] * {c}" for i, c in enumerate(lags))
    explained = f"list_reduce(list_transform(range(0, {n2}), lambda i: beta[i + 1] * b[i + 1]), lambda acc, x: acc + x, 0.0)"
    coefficients = ", ".join(f"beta[{i + 1}] AS {name}" for i, name in enumerate(sarima.NAMES))
    return f"""WITH cells AS (SELECT service, year(ds) * 12 + month(ds) AS m, sum(y) AS y FROM sup WHERE y IS NOT NULL AND ds IS NOT NULL GROUP BY 1, 2),
diffs AS (SELECT service, m, y - {_lag_sql("y", 1)} - {_lag_sql("y", season)} + {_lag_sql("y", season + 1)} AS w FROM cells),
first AS (SELECT service, m, w, {", ".join(f"{_lag_sql('w', k)} AS w{k}" for k in range(1, long_order + 1))} FROM diffs),
fitted AS (SELECT service, n AS n_long, CASE WHEN n >= {2 * long_order} THEN list_transform(range(0, {n1}), lambda i: red[i * {n1 + 1} + {n1} + 1]) END AS alpha
  FROM (SELECT *, {_solve_sql(flat1, n1)} AS red FROM (SELECT service, {", ".join(sums1)} FROM first GROUP BY service))),
shocks AS (SELECT service, m, w, n_long, CASE WHEN {ok1} THEN w - ({guess}) END AS e FROM first JOIN fitted USING (service)),
second AS (SELECT service, m, w, n_long, {", ".join(f"{_lag_sql('w', k)} AS w{k}" for k in seasonal)},
  {", ".join(f"{_lag_sql('e', k)} AS e{k}" for k in seasonal)} FROM shocks),
solved AS (SELECT service, n_long, n AS n_rows, g_w_w AS ww, {right2} AS b,
  CASE WHEN n >= {4 * n2} THEN list_transform(range(0, {n2}), lambda i: red[i * {n2 + 1} + {n2} + 1]) END AS beta
  FROM (SELECT *, {_solve_sql(flat2, n2)} AS red FROM (SELECT service, n_long, {", ".join(sums2)} FROM second GROUP BY service, n_long)))
SELECT service, n_long, n_rows, {coefficients}, (ww - {explained}) / nullif(n_rows - {n2}, 0) AS sigma2 FROM solved"""


def _seasonal_sql() -> str:
    return sql(_seasonal_body(), "sup", doubles=", ".join([*sarima.NAMES, "sigma2"]))


def seasonal_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-14 for DCL-16: psi weights and 95 % half widths, 1 to 12 months ahead."""
    return rounded(sarima.psi_bands(sarima.two_stage(supplier_series(spark, sf_dir))))


def _bands_sql(level: float = 0.95, horizon: int = sarima.HORIZON, season: int = sarima.SEASON) -> str:
    from statistics import NormalDist

    ar, ma = sarima._lag_polynomials(season)
    order = max(ar)

    def term(sign: int, name: str | None) -> str:
        value = "1.0" if name is None else name
        return value if sign > 0 else f"(-{value})"

    a = ", ".join(("0.0" + "".join(f" + {term(*t)}" for t in ar[k])) if k in ar else "0.0" for k in range(1, order + 1))
    m = ", ".join(ma.get(k, "0.0") for k in range(1, horizon)) or "0.0"
    inner = f"list_reduce(range(1, {order + 1}), lambda s, i: s + CASE WHEN i <= j THEN a[i] * acc[j - i + 1] ELSE 0.0 END, 0.0)"
    psi = f"list_reduce(range(1, {horizon}), lambda acc, j: list_concat(acc, [m[j] + {inner}]), [1.0])" if horizon > 1 else "[1.0]"
    squares = f"list_transform(range(1, {horizon + 1}), lambda k: list_reduce(list_slice(psi, 1, k), lambda s, p: s + p * p, 0.0))"
    z = NormalDist().inv_cdf((1 + level) / 2)
    return sql(
        f"""SELECT service, step, psi[step] AS psi, {z!r} * sqrt(sigma2 * sq[step]) AS half_width FROM (
  SELECT service, sigma2, psi, {squares} AS sq, unnest(range(1, {horizon + 1})) AS step FROM (
    SELECT service, sigma2, {psi} AS psi FROM (
      SELECT service, sigma2, [{a}] AS a, [{m}] AS m FROM ({_seasonal_body(season)}))))""",
        "sup",
        doubles="psi, half_width",
    )


def lagged_unit_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-12 with lags: augmented Dickey-Fuller, 0 to 2 lags chosen by AIC."""
    return rounded(unit_root.augmented(supplier_series(spark, sf_dir)))


def _solution_sql(xs: list[str], rhs: list[str]) -> str:
    """The solution vector of the Gram block of ``xs`` with right side ``rhs``, as in ``sarima.solve``."""

    def g(a: str, b: str) -> str:
        return f"g_{a}_{b}" if xs.index(a) <= xs.index(b) else f"g_{b}_{a}"

    k = len(xs)
    flat = "[" + ", ".join(cell for a, r in zip(xs, rhs, strict=True) for cell in (*[g(a, b) for b in xs], r)) + "]"
    return f"list_transform(range(0, {k}), lambda i: ({_solve_sql(flat, k)})[i * {k + 1} + {k} + 1])"


def _adf_sql(max_lags: int = unit_root.MAX_LAGS) -> str:
    lags = [f"d{i}" for i in range(1, max_lags + 1)]
    xs = ["one", "y1", *lags]
    ok = " AND ".join(f"{c} IS NOT NULL" for c in ["d", "y1", *lags])
    sums, _, _ = _gram_sql(xs, "d", ok)
    fits, columns = [], []
    for p in range(max_lags + 1):
        k = p + 2
        part = xs[:k]
        columns.append(f"{_solution_sql(part, [f'g_{a}_d' for a in part])} AS beta{p}")
        columns.append(f"{_solution_sql(part, ['1.0' if i == 1 else '0.0' for i in range(k)])} AS inv{p}")
        columns.append("[" + ", ".join(f"g_{a}_d" for a in part) + f"] AS b{p}")
        rss = f"(g_d_d - list_reduce(list_transform(range(0, {k}), lambda i: beta{p}[i + 1] * b{p}[i + 1]), lambda acc, x: acc + x, 0.0))"
        aic = f"CASE WHEN {rss} > 0 THEN nd * ln({rss} / nd) + {2.0 * k} END"
        t = f"beta{p}[2] / sqrt(({rss} / nullif(nd - {k}, 0)) * inv{p}[2])"
        fits.append(f"{{'aic': {aic}, 'lags': {p}, 't': {t}}}")
    b0, b1, b2, b3 = unit_root.CRITICAL_5
    crit = f"{b0} + {b1} / nullif(nd, 0) + {b2} / nullif(nd * nd, 0) + {b3} / nullif(nd * nd * nd, 0)"
    chosen = f"CASE WHEN n >= {unit_root.MIN_ROWS} THEN list_sort(list_filter([{', '.join(fits)}], lambda s: s.aic IS NOT NULL))[1] END"
    body = f"""SELECT service, n, best.lags AS lags, best.aic AS aic, best.t AS t, {crit} AS critical,
  coalesce(best.t < {crit}, FALSE) AS stationary FROM (
  SELECT service, n, nd, {chosen} AS best FROM (
    SELECT *, CAST(n AS DOUBLE) AS nd, {", ".join(columns)} FROM (
      SELECT service, {", ".join(sums)} FROM (
        SELECT service, m, d, y1, 1.0 AS one, {", ".join(f"{_lag_sql('d', i)} AS d{i}" for i in range(1, max_lags + 1))} FROM (
          SELECT service, m, y - {_lag_sql("y", 1)} AS d, {_lag_sql("y", 1)} AS y1 FROM (
            SELECT service, year(ds) * 12 + month(ds) AS m, sum(y) AS y FROM sup
            WHERE y IS NOT NULL AND ds IS NOT NULL GROUP BY 1, 2)))
      GROUP BY service)))"""
    return sql(body, "sup", doubles="aic, t, critical")


def conformal_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-14 from out-of-sample errors: split-conformal widths of random-walk forecasts
    by months ahead, over the backtest folds of all series, with their coverage."""
    points = materialise(conformal.random_walk_points(backtest_splits(mixed_series(spark, sf_dir))), "points")
    return rounded(conformal.coverage(points, conformal.quantiles(points)))


CONFORMAL_SQL = sql(
    f"""WITH splits AS ({_SPLITS_BODY}),
last AS (SELECT service, fold, max_by(y, ds) AS yhat FROM splits WHERE role = 'train' GROUP BY 1, 2),
points AS (SELECT 'RandomWalk' AS model, t.service, t.fold, t.ds,
  row_number() OVER (PARTITION BY t.service, t.fold ORDER BY t.ds) AS step, t.y, l.yhat
  FROM splits t JOIN last l ON t.service = l.service AND t.fold = l.fold WHERE t.role = 'test'),
scores AS (SELECT model, step, abs(y - yhat) AS r FROM points WHERE y IS NOT NULL AND yhat IS NOT NULL),
ranked AS (SELECT model, step, r, row_number() OVER (PARTITION BY model, step ORDER BY r) AS rn,
  count(*) OVER (PARTITION BY model, step) AS n FROM scores),
widths AS (SELECT model, step, max(n) AS n,
  max(CASE WHEN rn = CAST(ceil((n + 1) * {conformal.LEVEL}) AS BIGINT) THEN r END) AS quantile FROM ranked GROUP BY 1, 2)
SELECT w.model, w.step, w.n, w.quantile, c.coverage FROM widths w LEFT JOIN (
  SELECT s.model, s.step, avg(CASE WHEN v.quantile IS NOT NULL THEN CAST(s.r <= v.quantile AS DOUBLE) END) AS coverage
  FROM scores s JOIN widths v ON s.model = v.model AND s.step = v.step GROUP BY 1, 2) c
  ON w.model = c.model AND w.step = c.step""",
    "mixed",
    doubles="quantile, coverage",
)


def short_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DCL-15: two places, metric columns switched off."""
    return quality.round_report(rounded(summary(closed_tables(spark, sf_dir))), 2, metrics=False)


QUERIES = {
    "dcl_ensemble": (
        averaged,
        sql(
            "SELECT service, ds, avg(yhat) AS yhat FROM forecasts WHERE kind = 'future' GROUP BY 1, 2",
            "forecasts",
            doubles="yhat",
        ),
    ),
    "dcl_ensemble_weighted": (
        weighted,
        sql(
            """SELECT service, ds, sum(yhat * score) / sum(score) AS yhat
               FROM forecasts JOIN metrics USING (service, model) WHERE kind = 'future' GROUP BY 1, 2""",
            "forecasts", "metrics",
            doubles="yhat",
        ),
    ),
    "dcl_outliers": (
        outliers,
        """SELECT l_suppkey AS service, l_orderkey, l_linenumber, l_extendedprice AS y,
           coalesce(abs(l_extendedprice - avg(l_extendedprice) OVER w)
             > 1.7 * stddev_samp(l_extendedprice) OVER w, FALSE) AS outlier
           FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""",
    ),
    "dcl_series_outliers": (
        series_outliers,
        sql(
            """SELECT service, ds, y, mean, deviation, coalesce(abs(y - mean) > 3 * deviation, FALSE) AS outlier
               FROM (SELECT *, avg(y) OVER w AS mean, stddev_samp(y) OVER w AS deviation
                     FROM mixed WINDOW w AS (PARTITION BY service))""",
            "mixed",
            doubles="mean, deviation",
        ),
    ),
    "dcl_fill_interpolate": (filled("interpolate"), _filled_sql("y + (next_y - y) * k / gap")),
    "dcl_fill_forward": (filled("forward_fill"), _filled_sql("y")),
    "dcl_fill_drop": (
        filled("drop"), sql("SELECT service, ds, y, FALSE AS filled FROM mixed", "mixed"),
    ),
    "dcl_quality_alerts": (
        model_alerts,
        sql(
            f"""SELECT *, coalesce(r2 < 0.3, FALSE) AS alert_r2, coalesce(mape > 15, FALSE) AS alert_mape
               FROM (SELECT service, model, {_ROUNDED} FROM metrics)""",
            "metrics",
        ),
    ),
    "dcl_validation_splits": (splits, SPLITS_SQL),
    "dcl_backtest": (out_of_sample, None),
    "dcl_stationarity": (unit_roots, STATIONARITY_SQL),
    "dcl_stationarity_lags": (lagged_unit_roots, _adf_sql()),
    "dcl_conformal": (conformal_widths, CONFORMAL_SQL),
    "dcl_outliers_null_label": (
        null_outliers,
        f"""WITH s AS ({_NULL_LABELS}), m AS (
            SELECT service, avg(y) AS mean, stddev_samp(y) AS deviation FROM s GROUP BY 1)
        SELECT s.service, count(*) AS rows, count_if(abs(y - mean) > 1.5 * deviation) AS outliers
        FROM s JOIN m ON s.service IS NOT DISTINCT FROM m.service GROUP BY 1""",
    ),
    "flt_history_null_label": (
        null_history,
        f"""SELECT service, count(*) AS rows, count(*) >= 12 AS enough
        FROM ({_NULL_LABELS}) GROUP BY 1""",
    ),
    "dcl_low_volume": (
        volumes,
        sql("SELECT service, sum(y) AS volume FROM mixed GROUP BY 1 HAVING sum(y) >= 10", "mixed"),
    ),
    "dcl_intervals": (bounds, INTERVALS_SQL),
    "dcl_seasonal_arima": (seasonal_arima, _seasonal_sql()),
    "dcl_seasonal_bands": (seasonal_bands, _bands_sql()),
    "dcl_round_report": (
        short_report,
        sql(
            f"""SELECT service AS "Service", model AS "Meilleur Modèle",
                round(round(score + {NUDGE}, 6), 2) AS "Score Composite"
                FROM selection WHERE error IS NULL""",
            "selection",
        ),
    ),
}
