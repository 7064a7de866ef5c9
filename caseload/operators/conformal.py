"""DCL-14 from out-of-sample errors: split-conformal bands by model and step ahead.

The score of a backtest point is its absolute error. For a group (model and months
ahead) of n scores, the band's half width is the ceil((n + 1) * level)-th smallest
score: a new point of the same exchangeable kind lies within it with probability of
at least ``level``. With too few scores (that rank above n) the width is null.

The order statistic is exact and distributed: equal scores are counted first, so a
score shared by a third of all points is one row; the distinct scores are dealt out
by ranges that follow the data and written; each range learns the counts of the
ranges before it in its group from a table of one row per range and group, and the
order inside a range does the rest. No group is ever gathered into one task.

Defined cases: points with a null truth or forecast are left out; ties count each
point; an empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload.session import materialise

LEVEL = 0.95


def random_walk_points(splits: DataFrame) -> DataFrame:
    """Random-walk forecasts of the test dates of ``backtest_splits``: the last value trained on.

    Columns: model, service, fold, ds, step (months of the fold's test block, from 1), y, yhat.
    """
    keys = ["service", "fold"]
    last = splits.where(F.col("role") == "train").groupBy(*keys).agg(F.max_by("y", "ds").alias("yhat"))
    tested = splits.where(F.col("role") == "test")
    step = F.row_number().over(Window.partitionBy(*keys).orderBy("ds"))
    return tested.join(last, keys).select(
        F.lit("RandomWalk").alias("model"), *keys, "ds", step.alias("step"), "y", "yhat"
    )


def quantiles(points: DataFrame, by: Sequence[str] = ("model", "step"), level: float = LEVEL) -> DataFrame:
    """Per group of ``by``: n scores and the conformal half width ``quantile``."""
    by = list(by)
    score = F.abs(F.col("y") - F.col("yhat"))
    counts = points.where(score.isNotNull()).groupBy(*by, score.alias("r")).agg(F.count(F.lit(1)).alias("rows"))
    ordered = counts.repartitionByRange(*[F.col(c) for c in by], F.col("r")).withColumn("part", F.spark_partition_id())
    ordered = materialise(ordered, "conformal")
    per_part = ordered.groupBy("part", *by).agg(F.sum("rows").alias("part_rows"))
    group = Window.partitionBy(*by)
    offsets = per_part.select(
        "part",
        *by,
        F.coalesce(F.sum("part_rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("part_rows").over(group).alias("n"),
    )
    offsets = materialise(offsets, "conformal-offsets")
    inside = Window.partitionBy("part", *by).orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ordered.join(offsets, ["part", *by]).select(
        *by, "r", "rows", "n", (F.col("offset") + F.sum("rows").over(inside)).alias("through")
    )
    target = F.ceil((F.col("n") + 1) * F.lit(level))
    picked = ranked.where((F.col("through") >= target) & (F.col("through") - F.col("rows") < target))
    totals = offsets.groupBy(*by).agg(F.max("n").alias("n"))
    return totals.join(picked.select(*by, F.col("r").alias("quantile")), by, "left")


def coverage(points: DataFrame, widths: DataFrame, by: Sequence[str] = ("model", "step")) -> DataFrame:
    """``widths`` with the share of ``points`` whose absolute error lies within the width."""
    by = list(by)
    inside = F.abs(F.col("y") - F.col("yhat")) <= F.col("quantile")
    scored = points.where(F.col("y").isNotNull() & F.col("yhat").isNotNull()).join(widths.select(*by, "quantile"), by)
    shares = scored.groupBy(*by).agg(F.avg(F.when(F.col("quantile").isNotNull(), inside.cast("double"))).alias("coverage"))
    return widths.join(shares, by, "left")
