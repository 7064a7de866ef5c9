"""Calendar expressions of a monthly series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseload.functions.rules import DEFAULT_HORIZON


def horizon_months(
    last_ds: Column, target_year: int | None = None, through_target: bool = False
) -> Column:
    """DAT-3: months to forecast after ``last_ds``.

    With a target year the forecast stops at the December before it; with
    ``through_target`` it covers the target year too. Never below 1.
    """
    if not target_year:
        return F.lit(DEFAULT_HORIZON)
    rest_of_year = F.lit(12) - F.month(last_ds)
    whole_years = F.greatest(F.lit(0), F.lit(target_year - 1) - F.year(last_ds))
    months = rest_of_year + whole_years * 12 + (12 if through_target else 0)
    return F.greatest(F.lit(1), months).cast("int")


def month_ends_after(last_ds: Column, months: Column) -> Column:
    """DAT-2: array of the month-ends of the ``months`` months after ``last_ds``."""
    return F.transform(
        F.sequence(F.lit(1), months), lambda k: F.last_day(F.add_months(last_ds, k))
    )


def month_index(ds: Column) -> Column:
    """Months since year 0, so that differences count calendar months."""
    return F.year(ds) * 12 + F.month(ds)
