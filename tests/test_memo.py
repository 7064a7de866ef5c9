"""The forecast memo: keys, validity, reuse, versions."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from caseload.operators import memo
from caseload.operators.forecast import tables_from_fits

AS_OF = "2024-05-02 12:00:00"


@pytest.fixture
def entries(spark, complete):
    keys = memo.cache_key(memo.fingerprint(complete))
    ages = F.when(F.col("model") == "Prophet", 1).when(F.col("model") == "ARIMA", 24).otherwise(30)
    names = [f.split(" ", 1) for f in memo.FIT_SCHEMA.split(", ")]
    rest = [F.lit(None).cast(kind).alias(name) for name, kind in names if name not in ("service", "model")]
    created = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(hours=ages)
    return keys.select("cache_key", "fingerprint", created.alias("created_at"), "service", "model", *rest)


def test_fingerprint_and_key(complete):
    total = sum(r["y"] for r in complete.collect())
    text = f"2022-01-31 00:00:00_2023-12-31 00:00:00_24_{total:.2f}"
    printed = memo.fingerprint(complete).first()["fingerprint"]
    assert printed == hashlib.md5(text.encode()).hexdigest()
    keys = {r["model"]: r["cache_key"] for r in memo.cache_key(memo.fingerprint(complete)).collect()}
    assert keys["ARIMA"] == hashlib.md5(f"Nb Consultations_ARIMA_{printed}".encode()).hexdigest()
    changed = memo.fingerprint(complete.withColumn("y", F.col("y") + 1)).first()["fingerprint"]
    assert changed != printed


def test_empty_series_fingerprint(spark):
    null = F.lit(None).cast("date")
    column = memo.fingerprint_text(null, null, F.lit(0), F.lit(None).cast("double"))
    assert spark.range(1).select(column).first()[0] == "empty_data"


def test_validity_is_strict(entries):
    assert [r["model"] for r in memo.valid(entries, AS_OF).collect()] == ["Prophet"]
    assert memo.valid(entries, AS_OF, ttl_hours=24.5).count() == 2
    row = memo.stats(entries, AS_OF).first()
    assert (row["total_entries"], row["valid_entries"], row["expired_entries"]) == (3, 1, 2)


def test_lookup(entries):
    keys = entries.select("cache_key", "service", "model", "fingerprint")
    hits, misses = memo.lookup(entries, keys, AS_OF)
    assert hits.count() == 1 and misses.count() == 2
    hits, misses = memo.lookup(entries, keys, AS_OF, enabled=False)
    assert hits.count() == 0 and misses.count() == 3


def test_versions(spark, entries, tmp_path):
    first = memo.store(entries, str(tmp_path / "v1"))
    newer = entries.withColumn("created_at", F.lit(AS_OF).cast("timestamp")).where("model = 'ARIMA'")
    memo.store(newer, first)
    stored = memo.load(spark, first)
    assert memo.latest(stored).count() == 3
    assert {r["model"] for r in memo.valid(stored, AS_OF).collect()} == {"Prophet", "ARIMA"}
    second = memo.purge(stored, str(tmp_path / "v2"), AS_OF)
    assert memo.load(spark, second).count() == 2
    third = memo.clear(spark, str(tmp_path / "v3"))
    assert memo.load(spark, third).count() == 0
    assert memo.size_mb(spark, first).first()[0] >= 0.0


def test_refresh_fits_only_what_changed(spark, complete, outlier, short, tmp_path):
    df = complete.unionByName(outlier).unionByName(short)
    empty = memo.load(spark, memo.clear(spark, str(tmp_path / "v0")))
    fits, new = memo.refresh(df, empty, AS_OF)
    assert new.where("model IS NOT NULL").count() == 6
    assert new.where("model IS NULL").count() == 3  # the short series, under each of its keys
    path = memo.store(new, str(tmp_path / "v1"))
    changed = df.withColumn("y", F.when(F.col("service") == "Service Outlier", F.col("y") + 1).otherwise(F.col("y")))
    again, fresh = memo.refresh(changed, memo.load(spark, path), AS_OF)
    assert {r["service"] for r in fresh.collect()} == {"Service Outlier"}
    tables = tables_from_fits(changed, again, ("Prophet", "RandomForest", "ARIMA"))
    picked = {r["service"]: r["error"] for r in tables.selection.collect()}
    assert picked["Nb Consultations"] is None and picked["Service Outlier"] is None
    assert picked["Consultations PF"].startswith("Données historiques")


def test_refresh_keeps_horizons_apart_and_refits_single_models(spark, complete, short, tmp_path):
    df = complete.unionByName(short)
    empty = memo.load(spark, memo.clear(spark, str(tmp_path / "v0")))
    _, new = memo.refresh(df, empty, AS_OF, horizon=3)
    aged = F.when(F.col("model") == "ARIMA", F.lit("2024-04-01 00:00:00").cast("timestamp"))
    path = memo.store(new.withColumn("created_at", F.coalesce(aged, "created_at")), str(tmp_path / "v1"))
    stored = memo.load(spark, path)
    again, fresh = memo.refresh(df, stored, AS_OF, horizon=3)
    assert [(r["service"], r["model"]) for r in fresh.collect()] == [("Nb Consultations", "ARIMA")]
    assert again.where("model IS NULL").count() == 1
    assert {len(r["ahead"]) for r in again.where("model IS NOT NULL").collect()} == {3}
    longer, fresh = memo.refresh(df, stored, AS_OF, horizon=6)
    assert fresh.where("model IS NOT NULL").count() == 3
    assert {len(r["ahead"]) for r in longer.where("model IS NOT NULL").collect()} == {6}


def test_refresh_of_a_null_label(spark, complete, tmp_path):
    df = complete.withColumn("service", F.lit(None).cast("string"))
    empty = memo.load(spark, memo.clear(spark, str(tmp_path / "v0")))
    fits, new = memo.refresh(df, empty, AS_OF)
    assert fits.count() == 3 and new.count() == 3
