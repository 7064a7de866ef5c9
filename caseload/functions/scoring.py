"""Model scores and quality bands as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseload.functions.rules import (
    BANDS_3,
    BANDS_4,
    EQUAL_WEIGHTS,
    HEALTH_WEIGHTS,
    LOWEST_BAND,
)


def _missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def _weighted(r2: Column, mae: Column, rmse: Column, smape: Column, health: bool) -> Column:
    weights = HEALTH_WEIGHTS if health else EQUAL_WEIGHTS
    closeness = {
        "r2": F.greatest(F.lit(0.0), F.least(F.lit(1.0), r2)),
        "mae": 1 / (1 + mae),
        "rmse": 1 / (1 + rmse),
        "smape": 1 / (1 + smape / 100),
    }
    return sum((F.lit(weights[name]) * part for name, part in closeness.items()), F.lit(0.0))


def composite_score(
    r2: Column | None,
    mae: Column | None,
    rmse: Column | None,
    smape: Column | None,
    health: bool = True,
    when_missing: float = 0.0,
    clamp: bool = True,
) -> Column:
    """MTH-1: weighted score in 0..1; 0 as soon as one metric is null or NaN.

    ``None`` stands for a metric that is not there at all: R² then counts 0 and
    an error counts as infinite, which is not the same as a null value.
    """
    r2 = F.lit(0.0) if r2 is None else r2
    mae, rmse, smape = (F.lit(float("inf")) if m is None else m for m in (mae, rmse, smape))
    unusable = _missing(r2) | _missing(mae) | _missing(rmse) | _missing(smape)
    score = _weighted(r2, mae, rmse, smape, health)
    if clamp:
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(unusable, F.lit(when_missing)).otherwise(score)


def display_score(
    r2: Column | None,
    mae: Column | None,
    rmse: Column | None,
    smape: Column | None,
    health: bool = True,
    error: Column | None = None,
) -> Column:
    """MTH-2: as MTH-1, but minus infinity for a failed model and no final clamp."""
    worst = float("-inf")
    score = composite_score(r2, mae, rmse, smape, health, when_missing=worst, clamp=False)
    return score if error is None else F.when(error.isNotNull(), F.lit(worst)).otherwise(score)


def band(score: Column, limits: Sequence[tuple[float, str]]) -> Column:
    """Name of the first band whose lower limit the score reaches."""
    branches = F
    for limit, name in limits:
        branches = branches.when(score >= F.lit(limit), F.lit(name))
    return branches.otherwise(F.lit(LOWEST_BAND))


def band4(score: Column) -> Column:
    """MTH-3: four quality levels."""
    return band(score, BANDS_4)


def band3(score: Column) -> Column:
    """MTH-4: three quality levels."""
    return band(score, BANDS_3)


def zero_if_null(metric: Column) -> Column:
    """MTH-5: a missing metric is displayed as 0."""
    return F.coalesce(metric, F.lit(0.0))
