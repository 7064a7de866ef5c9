"""Queries on the forecast memo. The memo entries are derived from the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.operators import memo as mm
from caseload.operators.forecast import FIT_SCHEMA
from caseload.session import shared_folder
from caseload.workload.tables import customer_series, mixed_series, sql, supplier_series

AS_OF = "2024-03-02 12:00:00"


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mm.cache_key(mm.fingerprint(customer_series(spark, sf_dir)))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memo entries of the customers' keys, as old as the key says: 0 to 49 hours.

    Every model is saved at its own age, so fresh, exactly 24 h old and expired
    entries all occur.
    """
    names = [field.split(" ", 1) for field in FIT_SCHEMA.split(", ")]
    payload = [F.lit(None).cast(kind).alias(name) for name, kind in names if name not in ("service", "model")]
    hours = F.regexp_replace("service", "\\AC", "").cast("bigint") % 25 + F.when(
        F.col("model") == "Prophet", 0
    ).when(F.col("model") == "ARIMA", 24).otherwise(12)
    created = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(hours=hours.cast("int"))
    return keys(spark, sf_dir).select(
        "cache_key", "fingerprint", created.alias("created_at"), "service", "model", *payload
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-1."""
    return mm.fingerprint(mixed_series(spark, sf_dir))


def _prints_sql(table: str) -> str:
    return (
        "SELECT service, md5(strftime(min(ds), '%Y-%m-%d') || ' 00:00:00_' || strftime(max(ds), '%Y-%m-%d') "
        "|| ' 00:00:00_' || count(*) || '_' || CAST(sum(y) AS DECIMAL(38, 2))) AS fingerprint "
        f"FROM {table} GROUP BY service"
    )


KEYS_SQL = (
    "SELECT md5(service || '_' || model || '_' || fingerprint) AS cache_key, service, model, fingerprint "
    f"FROM ({_prints_sql('cus')}) CROSS JOIN (VALUES ('Prophet'), ('RandomForest'), ('ARIMA')) AS m(model)"
)
ENTRIES_SQL = (
    "SELECT *, CAST(substr(service, 2) AS BIGINT) % 25 + CASE model WHEN 'Prophet' THEN 0 "
    f"WHEN 'ARIMA' THEN 24 ELSE 12 END AS age FROM ({KEYS_SQL})"
)


def valid_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-3."""
    return mm.valid(entries(spark, sf_dir), AS_OF).select("cache_key", "service", "model")


def _changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys wanted now: the suppliers are new, the customers are known."""
    return mm.cache_key(mm.fingerprint(mixed_series(spark, sf_dir)))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-4, JON-2: entries that can be reused."""
    found, _ = mm.lookup(entries(spark, sf_dir), _changed_keys(spark, sf_dir), AS_OF)
    return found.select("cache_key", "service", "model")


def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-4, JON-2: keys to fit again."""
    _, missing = mm.lookup(entries(spark, sf_dir), _changed_keys(spark, sf_dir), AS_OF)
    return missing.select("cache_key", "service", "model")


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-5: everything is saved twice, the newest entry per key counts."""
    old = entries(spark, sf_dir)
    path = mm.store(old, shared_folder(spark, "memo"))
    newer = old.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 6 HOURS"))
    mm.store(newer.where(F.col("model") == "ARIMA"), path)
    return mm.valid(mm.load(spark, path), AS_OF).select("cache_key", "service", "model")


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-6."""
    return mm.stats(entries(spark, sf_dir), AS_OF)


def purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-7."""
    path = mm.purge(entries(spark, sf_dir), shared_folder(spark, "memo"), AS_OF)
    return mm.load(spark, path).select("cache_key", "service", "model")


def cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-8: after clearing, every key is a miss."""
    path = mm.clear(spark, shared_folder(spark, "memo"))
    _, missing = mm.lookup(mm.load(spark, path), keys(spark, sf_dir), AS_OF)
    return missing.select("cache_key", "service", "model")


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-1..5 together: the second run over unchanged suppliers fits nothing new."""
    series = supplier_series(spark, sf_dir)
    path = mm.clear(spark, shared_folder(spark, "memo"))
    _, new = mm.refresh(series, mm.load(spark, path), AS_OF)
    filled = mm.store(new, shared_folder(spark, "memo"))
    again, fresh = mm.refresh(series, mm.load(spark, filled), AS_OF)
    reused = again.where(F.col("error").isNull()).groupBy("service").agg(F.count("model").alias("reused"))
    refits = fresh.groupBy("service").agg(F.count("model").alias("refits"))
    return reused.join(refits, "service", "left").na.fill(0, ["refits"])


def one_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-4: where one model's entries expired alone, that model alone is fitted again."""
    series = supplier_series(spark, sf_dir)
    path = mm.clear(spark, shared_folder(spark, "memo"))
    _, new = mm.refresh(series, mm.load(spark, path), AS_OF)
    aged = F.when(F.col("model") == "ARIMA", F.col("created_at") - F.expr("INTERVAL 30 HOURS"))
    stored = mm.store(new.withColumn("created_at", F.coalesce(aged, "created_at")), shared_folder(spark, "memo"))
    again, fresh = mm.refresh(series, mm.load(spark, stored), AS_OF)
    models = again.groupBy("service").agg(F.count("model").alias("models"))
    return models.join(fresh.select("service", F.col("model").alias("refitted")), "service")


_PAIR = "SELECT cache_key, service, model FROM"
QUERIES = {
    "mem_one_expired": (
        one_expired,
        sql("SELECT service, 3::BIGINT AS models, 'ARIMA' AS refitted FROM sup GROUP BY service", "sup"),
    ),
    "mem_fingerprint": (fingerprints, sql(_prints_sql("mixed"), "mixed")),
    "mem_cache_key": (keys, sql(KEYS_SQL, "cus")),
    "mem_valid": (valid_entries, sql(f"{_PAIR} ({ENTRIES_SQL}) WHERE age < 24", "cus")),
    "mem_hits": (hits, sql(f"{_PAIR} ({ENTRIES_SQL}) WHERE age < 24", "cus")),
    "mem_misses": (
        misses,
        sql(
            f"""{_PAIR} ({KEYS_SQL.replace("FROM cus", "FROM mixed")}) WHERE cache_key NOT IN (
                SELECT cache_key FROM ({ENTRIES_SQL}) WHERE age < 24)""",
            "mixed",
        ),
    ),
    "mem_save": (
        replaced,
        sql(f"{_PAIR} ({ENTRIES_SQL}) WHERE age - CASE model WHEN 'ARIMA' THEN 6 ELSE 0 END < 24", "cus"),
    ),
    "mem_stats": (
        statistics,
        sql(
            f"""SELECT count(*) AS total_entries, count(*) FILTER (age < 24) AS valid_entries,
                count(*) FILTER (age >= 24) AS expired_entries FROM ({ENTRIES_SQL})""",
            "cus",
        ),
    ),
    "mem_purge": (purged, sql(f"{_PAIR} ({ENTRIES_SQL}) WHERE age < 24", "cus")),
    "mem_clear": (cleared, sql(f"{_PAIR} ({KEYS_SQL})", "cus")),
    "mem_refresh": (
        incremental,
        sql("SELECT service, 3::BIGINT AS reused, 0::BIGINT AS refits FROM sup GROUP BY service", "sup"),
    ),
}
