"""Data-quality screens and options on series and forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.functions.dates import month_index
from caseload.operators.lookup import attach
from caseload.operators.series import dated_cells

METRIC_COLUMNS = ("r2", "mae", "rmse", "mape", "smape", "R2", "MAE", "RMSE", "sMAPE")
VALIDATION_COLUMNS = ("fold", "accepted", "alert_r2", "alert_mape")


def flag_outliers(df: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """DCL-7: rows further than ``sigmas`` standard deviations from their series' mean.

    Mean and deviation come from a pre-combined aggregate that is joined back, so a
    hot series is never sorted or buffered whole, as a window would do.
    """
    stats = df.groupBy("service").agg(
        F.avg("y").alias("mean"),
        F.stddev_samp("y").alias("deviation"),
        F.count(F.lit(1)).alias("rows"),
    )
    far = F.abs(F.col("y") - F.col("mean")) > F.lit(float(sigmas)) * F.col("deviation")
    joined = attach(df, stats, ["service"], "rows").drop("rows")
    return joined.withColumn("outlier", F.coalesce(far, F.lit(False)))


def fill_gaps(df: DataFrame, strategy: str = "interpolate") -> DataFrame:
    """DCL-8: add the missing months of every series.

    ``interpolate`` is linear between the neighbours, ``forward_fill`` repeats the
    last value, ``drop`` adds nothing. Rows of one date are summed first. Every row
    spawns the months up to the next one, so no calendar has to be joined.
    """
    if strategy not in ("interpolate", "forward_fill", "drop"):
        raise ValueError(f"unknown strategy {strategy!r}")
    series = Window.partitionBy("service").orderBy("ds")
    rows = df.groupBy("service", "ds").agg(F.sum("y").alias("y"))
    if strategy == "drop":
        return rows.withColumn("filled", F.lit(False))
    gap = F.coalesce(
        month_index(F.lead("ds").over(series)) - month_index(F.col("ds")), F.lit(1)
    )
    steps = rows.select(
        "service",
        "ds",
        "y",
        F.lead("y").over(series).alias("next_y"),
        F.greatest(gap, F.lit(1)).alias("gap"),
    ).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("gap") - 1)))
    between = F.col("y") + (F.col("next_y") - F.col("y")) * F.col("k") / F.col("gap")
    filled = between if strategy == "interpolate" else F.col("y")
    return steps.select(
        "service",
        F.add_months("ds", F.col("k")).alias("ds"),
        F.when(F.col("k") == 0, F.col("y")).otherwise(filled).alias("y"),
        (F.col("k") > 0).alias("filled"),
    )


def quality_alerts(metrics: DataFrame, r2: float = 0.3, mape: float = 15.0) -> DataFrame:
    """DCL-10: models that explain too little or miss by too much."""
    return metrics.select(
        "*",
        F.coalesce(F.col("r2") < F.lit(r2), F.lit(False)).alias("alert_r2"),
        F.coalesce(F.col("mape") > F.lit(mape), F.lit(False)).alias("alert_mape"),
    )


def stationarity(df: DataFrame, critical: float = -2.86) -> DataFrame:
    """DCL-12: Dickey-Fuller t statistic (constant, no lags) per series.

    Regression of the change on the previous value, from aggregates only; a series
    is called stationary when t lies below the 5 % critical value.
    """
    series = Window.partitionBy("service").orderBy("ds")
    steps = (
        dated_cells(df)
        .select("service", "y", F.lag("y").over(series).alias("x"))
        .where(F.col("x").isNotNull())
        .select("service", "x", (F.col("y") - F.col("x")).alias("d"))
    )
    d, x = F.col("d"), F.col("x")
    sums = steps.groupBy("service").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(d, x).alias("slope"),
        F.regr_sxx(d, x).alias("sxx"),
        F.regr_syy(d, x).alias("syy"),
        F.regr_sxy(d, x).alias("sxy"),
    )
    noise = F.try_divide(F.col("syy") - F.col("slope") * F.col("sxy"), F.col("n") - 2)
    error = F.sqrt(F.try_divide(F.when(noise > 0, noise), F.col("sxx")))
    t = F.when(F.col("n") > 2, F.try_divide(F.col("slope"), error))
    return sums.select("service", "n", t.alias("t")).withColumn(
        "stationary", F.coalesce(F.col("t") < F.lit(critical), F.lit(False))
    )


def low_volume(df: DataFrame, minimum: float = 10) -> DataFrame:
    """DCL-13: volume per indicator, of those that reach the minimum."""
    volumes = df.groupBy("service").agg(F.sum("y").alias("volume"))
    return volumes.where(F.col("volume") >= F.lit(float(minimum)))


def ensemble(forecasts: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """DCL-6: mean of the models per indicator and date, weighted by score if given."""
    future = forecasts.where(F.col("kind") == "future")
    if metrics is None:
        return future.groupBy("service", "ds").agg(F.avg("yhat").alias("yhat"))
    weighted = future.join(metrics.select("service", "model", "score"), ["service", "model"])
    return weighted.groupBy("service", "ds").agg(
        F.try_divide(F.sum(F.col("yhat") * F.col("score")), F.sum("score")).alias("yhat")
    )


def intervals(
    forecasts: DataFrame, level: float = 0.95, growing: Sequence[str] = ("ARIMA",)
) -> DataFrame:
    """DCL-14: forecast bounds from the spread of the in-sample errors.

    The first fitted value of a series has no past and is left out. For the models
    in ``growing`` the width grows with the square root of the months ahead.
    """
    keys = ["service", "model"]
    series = Window.partitionBy(*keys).orderBy("ds")
    fitted = forecasts.where(F.col("kind") == "fitted").select(
        *keys, "ds", (F.col("y") - F.col("yhat")).alias("e"), F.lag("ds").over(series).alias("before")
    )
    spread = fitted.groupBy(*keys).agg(
        F.stddev_samp(F.when(F.col("before").isNotNull(), F.col("e"))).alias("sd"),
        F.max("ds").alias("last_ds"),
    )
    z = F.lit(NormalDist().inv_cdf((1 + level) / 2))
    ahead = month_index(F.col("ds")) - month_index(F.col("last_ds"))
    steps = F.when(F.col("model").isin(*growing), F.sqrt(ahead)).otherwise(F.lit(1.0))
    width = z * F.col("sd") * steps
    return (
        forecasts.where(F.col("kind") == "future")
        .join(spread, keys)
        .select(
            *keys,
            "ds",
            "yhat",
            (F.col("yhat") - width).alias("yhat_lower"),
            (F.col("yhat") + width).alias("yhat_upper"),
        )
    )


def round_report(
    df: DataFrame, places: int = 2, metrics: bool = True, validation: bool = True
) -> DataFrame:
    """DCL-15: rounded numbers, with metric and validation columns on or off."""
    hidden = (() if metrics else METRIC_COLUMNS) + (() if validation else VALIDATION_COLUMNS)
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), places).alias(f.name)
            if isinstance(f.dataType, floats)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
            if f.name not in hidden
        ]
    )
