"""DCL-12: augmented Dickey-Fuller test with the number of lags chosen per series.

For p = 0 to ``max_lags``: d_t = c + gamma y_(t-1) + sum of delta_i d_(t-i), with
d = y - y_(t-1). All fits of a series use the same rows (those where every lag up to
``max_lags`` exists), so their information criteria compare; they come from one
Gram matrix, summed map-side per series, whose leading blocks are the smaller fits.
Each system is solved by Gauss-Jordan in one array expression, once for the
coefficients and once for the column of the inverse that gives gamma's standard
error. The p of least AIC (ties: fewer lags) is kept, and its t statistic is set
against the finite-sample 5 % critical value of MacKinnon (2010), constant only.

Defined cases: lags are calendar months, so a missing month drops the rows that need
it; values of one service and month are added up; undated or null values are left
out; a service needs ``MIN_ROWS`` rows, else its statistic is null and it is not
called stationary; a fit whose residuals vanish has no AIC and is not chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload.functions.dates import month_index
from caseload.operators.sarima import _complete, _gram, at, solve

MAX_LAGS = 2
MIN_ROWS = 10
# MacKinnon (2010), one series, constant, 5 %: tau = b0 + b1/T + b2/T^2 + b3/T^3.
CRITICAL_5 = (-2.86154, -2.8903, -4.234, -40.040)


def critical(n: Column) -> Column:
    b0, b1, b2, b3 = CRITICAL_5
    return F.lit(b0) + F.try_divide(F.lit(b1), n) + F.try_divide(F.lit(b2), n * n) + F.try_divide(F.lit(b3), n * n * n)


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def augmented(df: DataFrame, max_lags: int = MAX_LAGS) -> DataFrame:
    """Per service: n, lags (chosen p), aic, t, critical, stationary."""
    dated = df.where(F.col("y").isNotNull() & F.col("ds").isNotNull())
    cells = dated.groupBy("service", month_index(F.col("ds")).alias("m")).agg(F.sum("y").alias("y"))
    first = cells.select("service", "m", (F.col("y") - at("y", 1)).alias("d"), at("y", 1).alias("y1"))
    lags = [f"d{i}" for i in range(1, max_lags + 1)]
    rows = first.select("service", "m", "d", "y1", F.lit(1.0).alias("one"), *[at("d", i).alias(name) for i, name in enumerate(lags, 1)])
    xs = ["one", "y1", *lags]
    sums, gram, right = _gram(xs, "d", _complete("d", "y1", *lags))
    stats = rows.groupBy("service").agg(*sums)
    n = F.col("n").cast("double")
    fits = []
    for p in range(max_lags + 1):
        k = p + 2
        g = [row[:k] for row in gram[:k]]
        beta, inverse = solve(g, right[:k]), solve(g, [F.lit(1.0 if i == 1 else 0.0) for i in range(k)])
        rss = F.col("g_d_d") - _dot(beta, F.array(*right[:k]))
        aic = F.when(rss > 0, n * F.log(rss / n) + F.lit(2.0 * k))
        t = F.try_divide(beta[1], F.sqrt(F.try_divide(rss, n - k) * inverse[1]))
        fits.append(F.struct(aic.alias("aic"), F.lit(p).alias("lags"), t.alias("t")))
    chosen = F.array_min(F.filter(F.array(*fits), lambda s: s["aic"].isNotNull()))
    enough = F.col("n") >= MIN_ROWS
    out = stats.select("service", "n", F.when(enough, chosen).alias("best"))
    return out.select(
        "service",
        "n",
        F.col("best.lags").alias("lags"),
        F.col("best.aic").alias("aic"),
        F.col("best.t").alias("t"),
        critical(F.col("n").cast("double")).alias("critical"),
        F.coalesce(F.col("best.t") < critical(F.col("n").cast("double")), F.lit(False)).alias("stationary"),
    )
