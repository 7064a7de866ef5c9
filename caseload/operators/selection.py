"""Choosing, ranking and viewing models per indicator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload.functions.rules import MODEL_ORDER, NO_MODEL_ERROR
from caseload.operators.lookup import attach_per_service
from caseload.session import materialise


def best_model(metrics: DataFrame, order: Sequence[str] = MODEL_ORDER) -> DataFrame:
    """WIN-2: best scored model per indicator, ties to the model registered first.

    Failed models are no candidates; an indicator with none left gets an error
    row. A plain max of a struct: no sort, and it combines before the shuffle.
    """
    place = F.coalesce(
        F.array_position(F.array(*[F.lit(name) for name in order]), F.col("model")), F.lit(0)
    )
    # Unregistered models come after the registered ones, by name.
    rank = F.when(place > 0, -place).otherwise(F.lit(-(len(order) + 1)))
    candidate = F.when(F.col("error").isNull(), F.struct("score", rank.alias("rank"), "model"))
    return (
        metrics.groupBy("service")
        .agg(F.max(candidate).alias("best"))
        .select(
            "service",
            F.col("best.model").alias("model"),
            F.coalesce("best.score", F.lit(0.0)).alias("score"),
            F.when(F.col("best").isNull(), F.lit(NO_MODEL_ERROR)).alias("error"),
        )
    )


def successful(history: DataFrame, selection: DataFrame) -> DataFrame:
    """FLT-6, SET-2: history rows of the indicators that have a forecast."""
    ok = selection.where(F.col("error").isNull()).select("service")
    return attach_per_service(history, ok.distinct())


def best_forecast(selection: DataFrame, forecasts: DataFrame) -> DataFrame:
    """JON-1, SET-3: forecast rows of each indicator's best model."""
    best = selection.where(F.col("error").isNull()).select("service", "model", "score")
    return forecasts.join(best, ["service", "model"])


def models_index(metrics: DataFrame) -> DataFrame:
    """AGG-15: which indicators have which model, one sorted row per pair.

    Rows instead of one list per model: with three models a list would hold a
    third of all indicators in one row.
    """
    return metrics.select("model", "service").distinct()


def score_ranks(selection: DataFrame, score: str = "score") -> DataFrame:
    """Distinct scores with row count, rank (1 = best) and total, fully distributed.

    Equal scores are counted before anything is ordered, so a score shared by a
    third of all indicators is one row here. The distinct scores are dealt out by
    ranges that follow the data and written, so that the ranges stay as they are;
    ranks are the counts of the ranges before plus the order inside a range.
    """
    counts = selection.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("rows"))
    parts = counts.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id())
    parts = materialise(parts, "scores")
    ordered = Window.orderBy("part")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        parts.groupBy("part")
        .agg(F.sum("rows").alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("offset"),
            F.sum("part_rows").over(everything).alias("total_rows"),
        )
    )
    inside = (
        Window.partitionBy("part")
        .orderBy(F.desc("score"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    better = F.col("offset") + F.coalesce(F.sum("rows").over(inside), F.lit(0))
    # One row per shuffle partition: a proven bound for the broadcast.
    return parts.join(F.broadcast(offsets), "part").select(
        "score", "rows", (better + 1).alias("rank"), "total_rows"
    )


def rank_services(selection: DataFrame) -> DataFrame:
    """WIN-3: indicators by score, best first; equal scores share a rank."""
    ok = selection.where(F.col("error").isNull())
    ranks = score_ranks(ok).select("score", "rank")
    return ok.join(ranks, "score").select("rank", "service", "model", "score")


def score_stats(selection: DataFrame) -> DataFrame:
    """AGG-14: mean, exact median, best and worst score of the successful indicators.

    The median is read off the ranks of the distinct scores, so no task has to
    hold all of them.
    """
    ranks = score_ranks(selection.where(F.col("error").isNull()))
    last = F.col("rank") + F.col("rows") - 1
    half = F.col("total_rows") / 2
    low, high = F.ceil(half), F.floor(half) + 1

    def at(k):
        return F.max(F.when(k.between(F.col("rank"), last), F.col("score")))

    return ranks.agg(
        F.try_divide(F.sum(F.col("score") * F.col("rows")), F.sum("rows")).alias("mean_score"),
        ((at(low) + at(high)) / 2).alias("median_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
    )


def accepted(selection: DataFrame, minimum: float = 0.5) -> DataFrame:
    """KPI-6: whether the best score is good enough to use the model."""
    ok = F.col("error").isNull() & (F.col("score") >= F.lit(minimum))
    return selection.withColumn("accepted", ok)
