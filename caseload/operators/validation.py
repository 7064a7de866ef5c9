"""DCL-11: holdout and rolling-origin validation of the models."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.operators.forecast import REGISTRY, fit_series, series_arrays
from caseload.operators.metrics import evaluate, with_score
from caseload.operators.series import dated_cells
from caseload.session import materialise


def _fold_sizes(dates: Column, fold: Column, folds: int, test_size: float):
    """Dates tested per fold, and dates trained on before them."""
    tested = F.greatest(F.lit(1), F.floor(dates * F.lit(test_size))).cast("int")
    trained = dates - (F.lit(folds + 1) - fold) * tested
    return tested, trained


def backtest_splits(
    df: DataFrame, folds: int = 3, test_size: float = 0.2, min_points: int = 6
) -> DataFrame:
    """Which date is trained on or tested in which fold.

    Fold ``folds`` tests the newest dates (the plain holdout is ``folds=1``), each
    earlier fold the block before. Folds with too little to train on are left out.
    """
    whole = Window.partitionBy("service")
    cells = dated_cells(df).select(
        "service",
        "ds",
        "y",
        F.row_number().over(whole.orderBy("ds")).alias("at"),
        F.count(F.lit(1)).over(whole).alias("dates"),
    )
    # Only now one copy per fold: a generator beside windows would run before them.
    cells = cells.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    tested, trained = _fold_sizes(F.col("dates"), F.col("fold"), folds, test_size)
    role = F.when(F.col("at") <= trained, F.lit("train")).when(
        F.col("at") <= trained + tested, F.lit("test")
    )
    return (
        cells.where(trained >= min_points)
        .select("service", "fold", "ds", "y", role.alias("role"))
        .where(F.col("role").isNotNull())
    )


def backtest(
    df: DataFrame,
    models: Mapping[str, Callable] = REGISTRY,
    folds: int = 3,
    test_size: float = 0.2,
    min_points: int = 6,
) -> DataFrame:
    """Out-of-sample metrics per indicator, model and fold.

    A model that fails on a fold has a row with null metrics, score 0 and its ``error``.

    Folds are slices of the series row, so all of them are fitted in the same pass
    and spread over the cluster like series.
    """
    series = series_arrays(df).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    tested, trained = _fold_sizes(F.size("days"), F.col("fold"), folds, test_size)
    cut = series.withColumn("tested", tested).withColumn("trained", trained)
    cut = cut.where(F.col("trained") >= min_points)
    # The fold travels in the service name through the fit and is split off again.
    parts = cut.select(
        F.concat_ws("\u001f", F.col("fold").cast("string"), "service").alias("service"),
        *[F.slice(name, F.lit(1), F.col("trained")).alias(name) for name in ("days", "n", "y", "yy")],
        F.slice("days", F.col("trained") + 1, F.col("tested")).alias("future"),
    )
    fitted = fit_series(parts, models, min_rows=0)
    fitted = materialise(fitted, "backtest")
    fold = F.regexp_extract("service", "\\A([0-9]+)", 1).cast("int").alias("fold")
    service = F.regexp_replace("service", "\\A[0-9]+\u001f", "").alias("service")
    ahead = fitted.where(F.col("error").isNull()).select(
        fold,
        service,
        "model",
        F.inline(
            F.transform(
                F.arrays_zip("future", "ahead"),
                lambda s: F.struct(
                    F.date_from_unix_date(s["future"]).alias("ds"), s["ahead"].alias("yhat")
                ),
            )
        ),
    )
    truth = dated_cells(df).select("service", "ds", "y")
    scored = ahead.join(truth, ["service", "ds"])
    measured = evaluate(scored, by=("service", "model", "fold"))
    failed = fitted.where(F.col("error").isNotNull()).select(service, "model", fold, "error")
    return with_score(measured.unionByName(failed, allowMissingColumns=True))
