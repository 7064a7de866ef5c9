"""Forecast memo: refit only what is missing: series whose data changed, models that expired.

A memo is a table of fits with ``cache_key, fingerprint, created_at`` in front;
it is written as Parquet. Versions are folders: purging and clearing write a new
one, nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.functions.dates import horizon_months, month_ends_after
from caseload.functions.rules import EMPTY_FINGERPRINT, MODEL_ORDER
from caseload.operators.forecast import (
    FIT_SCHEMA,
    REGISTRY,
    fit_series,
    series_arrays,
)
from caseload.operators.lookup import attach_per_service, null_safe_join
from caseload.session import materialise

TTL_HOURS = 24
MEMO_SCHEMA = (
    f"cache_key string, fingerprint string, created_at timestamp, {FIT_SCHEMA}"
)


def fingerprint_text(first: Column, last: Column, rows: Column, total: Column) -> Column:
    """MEM-1: md5 over first and last date, row count and sum to two decimals."""
    stamp = "yyyy-MM-dd HH:mm:ss"
    amount = F.coalesce(total.try_cast("decimal(38,2)").cast("string"), total.cast("string"))
    text = F.concat_ws(
        "_", F.date_format(first, stamp), F.date_format(last, stamp), rows.cast("string"), amount
    )
    return F.when(rows == 0, F.lit(EMPTY_FINGERPRINT)).otherwise(F.md5(text))


def fingerprint(df: DataFrame) -> DataFrame:
    """MEM-1 per indicator; partial sums combine before the shuffle."""
    return (
        df.groupBy("service")
        .agg(
            F.min("ds").alias("first"),
            F.max("ds").alias("last"),
            F.count(F.lit(1)).alias("rows"),
            F.sum("y").alias("total"),
        )
        .select(
            "service",
            fingerprint_text(F.col("first"), F.col("last"), F.col("rows"), F.col("total")).alias(
                "fingerprint"
            ),
        )
    )


def cache_key(
    prints: DataFrame, models: Sequence[str] = MODEL_ORDER, setting: str | None = None
) -> DataFrame:
    """MEM-2: one key per indicator and model, and per horizon ``setting`` if one is given."""
    each = prints.select(
        "service", "fingerprint", F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    )
    key = F.md5(F.concat_ws("_", "service", "model", "fingerprint", F.lit(setting).cast("string")))
    return each.select(key.alias("cache_key"), "service", "model", "fingerprint")


def is_valid(created_at: Column, as_of: Column, ttl_hours: float = TTL_HOURS) -> Column:
    """MEM-3: strictly younger than the time to live."""
    age = F.unix_micros(as_of) - F.unix_micros(created_at)
    return age < F.lit(int(ttl_hours * 3_600_000_000))


def _instant(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def latest(memo: DataFrame) -> DataFrame:
    """Newest entry per key: saving a key again replaces it."""
    columns = [name for name in memo.columns if name != "cache_key"]
    ordered = ["created_at", *[name for name in columns if name != "created_at"]]
    newest = memo.groupBy("cache_key").agg(F.max_by(F.struct(*ordered), "created_at").alias("e"))
    return newest.select("cache_key", "e.*").select(*memo.columns)


def valid(
    memo: DataFrame, as_of: datetime | str | Column, ttl_hours: float = TTL_HOURS
) -> DataFrame:
    """MEM-3 as an operator: the entries that may still be used."""
    return _entries(memo, _usable(memo, as_of, ttl_hours))


def _usable(memo: DataFrame, as_of: datetime | str | Column, ttl_hours: float) -> DataFrame:
    """``cache_key, created_at`` of the usable entries; no other column is read."""
    newest = memo.groupBy("cache_key").agg(F.max("created_at").alias("created_at"))
    return newest.where(is_valid(F.col("created_at"), _instant(as_of), ttl_hours))


def _entries(memo: DataFrame, wanted: DataFrame) -> DataFrame:
    """The payload of the wanted ``cache_key, created_at``, one entry per key."""
    return memo.join(wanted, ["cache_key", "created_at"], "left_semi").dropDuplicates(["cache_key"])


def lookup(
    memo: DataFrame,
    keys: DataFrame,
    as_of: datetime | str | Column,
    ttl_hours: float = TTL_HOURS,
    enabled: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """MEM-4, JON-2: usable entries of the wanted keys, and the keys to refit.

    Which keys are usable is told from two columns; the arrays are read for hits only.
    """
    usable = _usable(memo, as_of, ttl_hours)
    if not enabled:
        usable = usable.where(F.lit(False))
    hits = _entries(memo, usable.join(keys.select("cache_key"), "cache_key", "left_semi"))
    misses = keys.join(usable.select("cache_key"), "cache_key", "left_anti")
    return hits, misses


def store(entries: DataFrame, path: str) -> str:
    """MEM-5: append entries; the newest one per key counts."""
    entries.write.mode("append").parquet(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    """The memo table of a version folder."""
    return spark.read.schema(MEMO_SCHEMA).parquet(path)


def stats(
    memo: DataFrame, as_of: datetime | str | Column, ttl_hours: float = TTL_HOURS
) -> DataFrame:
    """MEM-6: how many entries there are, and how many of them are still valid."""
    ok = is_valid(F.col("created_at"), _instant(as_of), ttl_hours)
    return (
        memo.groupBy("cache_key")
        .agg(F.max("created_at").alias("created_at"))
        .agg(
            F.count(F.lit(1)).alias("total_entries"),
            F.count_if(ok).alias("valid_entries"),
            (F.count(F.lit(1)) - F.count_if(ok)).alias("expired_entries"),
        )
    )


def size_mb(spark: SparkSession, path: str) -> DataFrame:
    """MEM-6: size of the memo's files in MB; only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(
        F.round(F.coalesce(F.sum("length"), F.lit(0)) / (1024 * 1024), 2).alias("total_size_mb")
    )


def purge(
    memo: DataFrame,
    new_path: str,
    as_of: datetime | str | Column,
    ttl_hours: float = TTL_HOURS,
) -> str:
    """MEM-7: write a new version without the expired entries."""
    valid(memo, as_of, ttl_hours).write.mode("errorifexists").parquet(new_path)
    return new_path


def clear(spark: SparkSession, new_path: str) -> str:
    """MEM-8: write an empty version."""
    spark.createDataFrame([], MEMO_SCHEMA).write.mode("errorifexists").parquet(new_path)
    return new_path


def refresh(
    df: DataFrame,
    memo: DataFrame,
    as_of: datetime | str | Column,
    models: Mapping[str, Callable] = REGISTRY,
    horizon: int | None = None,
    target_year: int | None = None,
    ttl_hours: float = TTL_HOURS,
) -> tuple[DataFrame, DataFrame]:
    """Fits of all series, of which only the missing ones are computed.

    Returns ``(fits, new_entries)``: the first feeds ``tables_from_fits``, the
    second is to be stored. A model that is missing alone is fitted alone. The
    horizon is part of the key, so one memo may serve several. A short series is
    stored as well, without a model under each of its keys.
    """
    setting = f"h{horizon}" if horizon else f"y{target_year}" if target_year else None
    keys = materialise(cache_key(fingerprint(df), list(models), setting), "keys")
    hits, misses = lookup(memo, keys, as_of, ttl_hours)
    misses = materialise(misses, "misses")
    names = [field.split()[0] for field in FIT_SCHEMA.split(", ")]
    if misses.isEmpty():
        return _rejected_once(hits.select(*names)), memo.sparkSession.createDataFrame([], MEMO_SCHEMA)
    asked = misses.groupBy("service").agg(F.collect_set("model").alias("wanted"))
    # Only rows of missed series are combined and put in order.
    rows = attach_per_service(df, asked.select("service"))
    series = null_safe_join(series_arrays(rows), asked, ["service"])
    months = F.lit(horizon) if horizon else horizon_months(F.col("last_ds"), target_year)
    ahead = F.transform(month_ends_after(F.col("last_ds"), months), F.unix_date)
    fresh = materialise(fit_series(series.withColumn("future", ahead), models), "refits")
    missed = misses.select("cache_key", "fingerprint", F.col("service").alias("_service"), F.col("model").alias("_model"))
    same = missed["_service"].eqNullSafe(fresh["service"]) & (
        fresh["model"].isNull() | (missed["_model"] == fresh["model"])
    )
    entries = (
        missed.join(fresh, same)
        .withColumn("created_at", _instant(as_of))
        .select("cache_key", "fingerprint", "created_at", *names)
    )
    return _rejected_once(hits.select(*names).unionByName(entries.select(*names))), entries


def _rejected_once(found: DataFrame) -> DataFrame:
    """A short series lies in the memo under each of its keys; it counts once."""
    rejected = found.where(F.col("model").isNull()).dropDuplicates(["service"])
    return found.where(F.col("model").isNotNull()).unionByName(rejected)
