"""Forecasting every series with every model in one distributed pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.functions.dates import horizon_months, month_ends_after
from caseload.functions.rules import MIN_HISTORY_ROWS, SHORT_HISTORY_ERROR
from caseload.operators import fits
from caseload.operators.lookup import attach
from caseload.operators.metrics import evaluate, with_score
from caseload.operators.selection import best_model
from caseload.operators.series import dated_cells
from caseload.session import compute_partitions, materialise

# Workers receive the fits with the task; the package need not be installed there.
cloudpickle.register_pickle_by_value(fits)

REGISTRY: Mapping[str, Callable] = fits.REGISTRY

FIT_SCHEMA = (
    "service string, model string, variant string, error string, "
    "days array<int>, n array<bigint>, y array<double>, fitted array<double>, "
    "future array<int>, ahead array<double>"
)
FORECAST_SCHEMA = (
    "service string, model string, variant string, ds date, y double, yhat double, "
    "kind string, error string"
)


class ForecastTables(NamedTuple):
    """The four result tables: see FIXTURES.md for their columns."""

    history: DataFrame
    forecasts: DataFrame
    metrics: DataFrame
    selection: DataFrame


def series_arrays(
    df: DataFrame, partitions: int | None = None, unique_dates: bool = False
) -> DataFrame:
    """One row per indicator with its dates, counts, means and squares as arrays.

    Rows combine to one per date before the shuffle, so an array is as long as
    the series has dates, whatever the number of rows behind it. A row without a
    date has no place in a series and is not part of it.
    """
    partitions = partitions or compute_partitions(df.sparkSession)
    return (
        dated_cells(df, unique_dates)
        .where(F.col("ds").isNotNull())
        .repartition(partitions, "service")
        .groupBy("service")
        .agg(F.sort_array(F.collect_list(F.struct("ds", "n", "y", "yy"))).alias("cells"))
        .select(
            "service",
            F.transform("cells.ds", F.unix_date).alias("days"),
            F.col("cells.n").alias("n"),
            F.col("cells.y").alias("y"),
            F.col("cells.yy").alias("yy"),
            F.element_at("cells.ds", -1).alias("last_ds"),
        )
    )


# Dates of the series fitted together in one call; a longer series comes alone.
BATCH_DATES = 100_000


def _fit_batches(models: Mapping[str, Callable], min_rows: int, too_short: str, schema: T.StructType):
    """MOD-5, MOD-7: run all models on each series; a failure becomes an error text.

    Series of equal length and horizon are fitted together, as rows of one matrix.
    """
    fit_many = fits.fit_many
    most, names = BATCH_DATES, [field.name for field in schema.fields]
    doubles = pa.list_(pa.float64())

    def matrix(column, rows, size, kind):
        """Lists of ``size`` values each as rows of a matrix; null is not a number."""
        flat = column.take(pa.array(rows)).flatten()
        return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(rows), size)

    def lengths(column):
        return column.value_lengths().to_numpy(zero_copy_only=False).astype(int)

    def fit_table(batch: pa.RecordBatch) -> pa.RecordBatch:
        days, n, y, yy, future = (batch.column(name) for name in ("days", "n", "y", "yy", "future"))
        size, ahead = lengths(days), lengths(future)
        wanted = batch.column("wanted").to_pylist()
        groups: dict[tuple[int, int], list[int]] = {}
        for i, key in enumerate(zip(size.tolist(), ahead.tolist(), strict=True)):
            groups.setdefault(key, []).append(i)
        out = []
        for (dates, horizon), rows in groups.items():
            enough = matrix(n, rows, dates, "f8").sum(1) >= min_rows
            out += [(rows[i], -1, None, None, too_short, None, None) for i in np.flatnonzero(~enough).tolist()]
            rows = [rows[i] for i in np.flatnonzero(enough).tolist()]
            for place, (name, fit) in enumerate(models.items()):
                mine = [i for i in rows if wanted[i] is None or name in wanted[i]]
                if not mine:
                    continue
                found = fit_many(
                    fit,
                    matrix(days, mine, dates, "i8"),
                    matrix(y, mine, dates, "f8"),
                    matrix(n, mine, dates, "f8"),
                    matrix(yy, mine, dates, "f8"),
                    matrix(future, mine, horizon, "i8"),
                )
                for i, result in zip(mine, found, strict=True):
                    if isinstance(result, Exception):  # one model never stops the others
                        out.append((i, place, name, None, str(result) or repr(result), None, None))
                    else:
                        out.append((i, place, name, result.variant, None, result.fitted, result.future))
        out.sort(key=lambda row: row[:2])
        rows, _, model, variant, error, fitted, values = zip(*out, strict=True) if out else [()] * 7
        of = pa.array(rows, pa.int64())
        text = pa.string()
        return pa.RecordBatch.from_arrays([
            batch.column("service").take(of), pa.array(model, text), pa.array(variant, text), pa.array(error, text),
            days.take(of), n.take(of), y.take(of), pa.array(fitted, doubles), future.take(of), pa.array(values, doubles),
        ], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Freed at once: from here on the allocator keeps arrays up to this size in its heap
        # instead of fetching fresh pages for each.
        np.empty(30 << 20, np.uint8)
        held, dates = [], 0
        for batch in batches:
            held.append(batch)
            dates += len(batch.column("days").flatten())
            if dates >= most:
                yield fit_table(pa.concat_batches(held))
                held, dates = [], 0
        if held:
            yield fit_table(pa.concat_batches(held))

    return run


def fit_series(
    series: DataFrame,
    models: Mapping[str, Callable] = REGISTRY,
    min_rows: int = MIN_HISTORY_ROWS,
    too_short: str = SHORT_HISTORY_ERROR,
) -> DataFrame:
    """MOD-1..3, MOD-5, MOD-7: fit each model on each row of ``series``.

    ``series`` holds one series per row: ``service, days, n, y, yy, future``.
    The result has one row per series and model (``FIT_SCHEMA``); a series below
    ``min_rows`` gives one row without model. A further column ``wanted`` may name
    the models to fit on that series.
    """
    wanted = F.col("wanted") if "wanted" in series.columns else F.lit(None).cast("array<string>").alias("wanted")
    inputs = series.select("service", "days", "n", "y", "yy", "future", wanted)
    schema = T.StructType.fromDDL(FIT_SCHEMA)
    return inputs.mapInArrow(_fit_batches(models, min_rows, too_short, schema), schema)


def forecast_rows(fitted: DataFrame) -> DataFrame:
    """Fit rows to dated rows: ``fitted`` for the history, ``future`` ahead of it."""
    dated = fitted.where(F.col("model").isNotNull() & F.col("error").isNull())
    past = F.transform(
        F.arrays_zip("days", "y", "fitted"),
        lambda s: _point(s["days"], s["y"], s["fitted"], "fitted"),
    )
    ahead = F.transform(
        F.arrays_zip("future", "ahead"),
        lambda s: _point(s["future"], F.lit(None).cast("double"), s["ahead"], "future"),
    )
    return dated.select(
        "service", "model", "variant", F.inline(F.concat(past, ahead)), "error"
    )


def _point(day: Column, y: Column, yhat: Column, kind: str) -> Column:
    return F.struct(
        F.date_from_unix_date(day).alias("ds"),
        y.alias("y"),
        yhat.alias("yhat"),
        F.lit(kind).alias("kind"),
    )


def fit_metrics(fitted: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """AGG-13, MTH-1 per indicator and model, failed models included.

    Dates with one row are scored from the fit itself. Dates shared by several
    rows need each row: those fits are attached to ``history`` by indicator and
    date. Without ``history`` the mean of the date is scored.
    """
    models = fitted.where(F.col("model").isNotNull())
    cells = models.where(F.col("error").isNull()).select(
        "service",
        "model",
        "error",
        F.inline(
            F.transform(
                F.arrays_zip("days", "n", "y", "fitted"),
                lambda s: F.struct(
                    F.date_from_unix_date(s["days"]).alias("ds"),
                    s["n"].alias("n"),
                    s["y"].alias("y"),
                    s["fitted"].alias("yhat"),
                ),
            )
        ),
    )
    none = F.lit(None).cast("double")
    failed = models.where(F.col("error").isNotNull()).select(
        "service", "model", "error", none.alias("y"), none.alias("yhat")
    )
    pairs = ["service", "model", "error", "y", "yhat"]
    if history is None:
        scored = cells.select(*pairs)
    else:
        # One row per shared date, with the values of all models side by side.
        shared = (
            cells.where(F.col("n") > 1)
            .groupBy("service", "ds")
            .agg(F.max("n").alias("n"), F.collect_list(F.struct("model", "error", "yhat")).alias("at"))
        )
        rows = attach(history.select("service", "ds", "y"), shared, ["service", "ds"], "n")
        rows = rows.select("service", "y", F.inline("at"))
        scored = cells.where(F.col("n") == 1).select(*pairs).unionByName(rows.select(*pairs))
    measured = evaluate(scored.unionByName(failed), by=("service", "model", "error"))
    return with_score(measured).select(
        "service", "model", "r2", "mae", "rmse", "mape", "smape", "score", "error"
    )


def forecast(
    df: DataFrame,
    models: Mapping[str, Callable] = REGISTRY,
    horizon: int | None = None,
    target_year: int | None = None,
    through_target: bool = False,
    min_rows: int = MIN_HISTORY_ROWS,
    unique_dates: bool = False,
) -> ForecastTables:
    """MOD-5, MOD-6: all models on all series, scored, best one selected.

    ``df`` has ``service, ds, y``. ``horizon`` overrides the months implied by
    ``target_year``. The fits run once, here, and are written to the shared
    folder; every table of the result is derived from that copy.
    ``unique_dates`` promises one row per indicator and date, which saves a
    shuffle and the join that scores rows sharing a date.
    """
    series = series_arrays(df, unique_dates=unique_dates)
    months = (
        F.lit(horizon)
        if horizon
        else horizon_months(F.col("last_ds"), target_year, through_target)
    )
    ahead = F.transform(month_ends_after(F.col("last_ds"), months), F.unix_date)
    fitted = materialise(
        fit_series(series.withColumn("future", ahead), models, min_rows), "fits"
    )
    return tables_from_fits(df, fitted, tuple(models), unique_dates)


def tables_from_fits(
    df: DataFrame, fitted: DataFrame, order: tuple[str, ...], unique_dates: bool = False
) -> ForecastTables:
    """The four result tables behind a table of fits."""
    metrics = fit_metrics(fitted, None if unique_dates else df)
    rejected = fitted.where(F.col("model").isNull()).select(
        "service", "model", F.lit(0.0).alias("score"), "error"
    )
    selection = best_model(metrics, order).unionByName(rejected)
    return ForecastTables(df, forecast_rows(fitted), metrics, selection)


def random_walk(
    df: DataFrame,
    horizon: int | None = None,
    target_year: int | None = None,
    model: str = "ARIMA",
    unique_dates: bool = False,
) -> DataFrame:
    """MOD-4: ARIMA(0,1,0) without any Python: previous value, then the last one.

    Forecast rows as in :func:`forecast_rows`. One shuffle on the indicator serves
    both the lag and the future rows, which hang on each series' last row.
    """
    series = Window.partitionBy("service").orderBy("ds")
    cells = dated_cells(df, unique_dates).select(
        "service",
        "ds",
        "y",
        F.coalesce(F.lag("y").over(series), F.lit(0.0)).alias("yhat"),
        F.lead("ds").over(series).isNull().alias("is_last"),
    )
    months = F.lit(horizon) if horizon else horizon_months(F.col("ds"), target_year)
    here = F.struct(
        "ds", "y", "yhat", F.lit("fitted").alias("kind")
    )
    ahead = F.transform(
        month_ends_after(F.col("ds"), months),
        lambda d: F.struct(
            d.alias("ds"),
            F.lit(None).cast("double").alias("y"),
            F.col("y").alias("yhat"),
            F.lit("future").alias("kind"),
        ),
    )
    points = F.when(F.col("is_last"), F.concat(F.array(here), ahead)).otherwise(F.array(here))
    return cells.select(
        "service",
        F.lit(model).alias("model"),
        F.lit("0,1,0").alias("variant"),
        F.inline(points),
        F.lit(None).cast("string").alias("error"),
    )
