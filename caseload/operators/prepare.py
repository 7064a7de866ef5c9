"""From long observation rows to series rows ``service, ds, y``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.functions.rules import INDICATOR_RULES, KEY_INDICATORS, MIN_HISTORY_ROWS
from caseload.functions.text import (
    clean_label,
    match_rules,
    numeric_or_zero,
    strict_date,
    zero_if_missing,
)
from caseload.operators import lookup
from caseload.operators.series import spread_sort
from caseload.session import materialise


def before_year(df: DataFrame, target_year: int | None, ds: str = "ds") -> DataFrame:
    """FLT-3: rows strictly before January of the target year; None or 0 keeps all.

    A plain date bound instead of ``year(ds) < y``: Parquet can skip row groups.
    """
    if not target_year:
        return df
    return df.where(F.col(ds) < F.make_date(F.lit(target_year), F.lit(1), F.lit(1)))


def key_indicators(
    df: DataFrame, keys: Sequence[str] | DataFrame = KEY_INDICATORS, service: str = "service"
) -> DataFrame:
    """FLT-4: keep listed indicators. A DataFrame of keys is joined by measured size."""
    if isinstance(keys, DataFrame):
        wanted = keys.select(F.col(keys.columns[0]).alias(service)).distinct()
        weights = df.groupBy(service).agg(F.count(F.lit(1)).alias("_rows"))
        return lookup.attach(df, weights.join(wanted, service), [service], "_rows").drop("_rows")
    return df.where(F.col(service).isin(*keys))


def name_indicators(
    df: DataFrame,
    label: str,
    rules: Sequence[tuple[str, str]] = INDICATOR_RULES,
    keys: Sequence[str] | None = None,
    per: str = "label",
) -> DataFrame:
    """STR-1 as an operator: replaces ``label`` by its standard name.

    ``per="label"`` runs the rules once per distinct label: one job over the label
    column alone writes the names, and they are broadcast to the rows if their
    measured size allows. Otherwise, and with ``per="row"`` (good for aggregated input), the
    rules run on every row. Neither way shuffles the rows. With ``keys`` (FLT-4)
    other indicators are dropped.
    """
    if per == "label":
        raw = df.groupBy(F.col(label).alias("raw_label")).agg(F.count(F.lit(1)).alias("n"))
        clean = raw.select("raw_label", clean_label(F.col("raw_label")).alias("clean"))
        names = clean.select("raw_label", match_rules(F.col("clean"), rules).alias("name"))
        names = materialise(names, "names")
        size = names.agg(F.sum(lookup.row_bytes(names))).first()[0] or 0
        if size <= lookup.MAX_BROADCAST_BYTES:
            if keys is not None:
                names = names.where(F.col("name").isin(*keys))
            joined = df.join(F.broadcast(names), F.col(label).eqNullSafe(F.col("raw_label")))
            return joined.select(
                *[F.col("name").alias(c) if c == label else F.col(c) for c in df.columns]
            )
    # Two projections, so that the stripped text is computed once for all rules.
    named = df.withColumn(label, clean_label(F.col(label)))
    named = named.withColumn(label, match_rules(F.col(label), rules))
    return named if keys is None else key_indicators(named, keys, label)


def series_values(df: DataFrame, value: str) -> DataFrame:
    """PRJ-4 as an operator: text or number to DOUBLE with 0 for anything unusable."""
    is_text = isinstance(df.schema[value].dataType, T.StringType)
    coerce = numeric_or_zero if is_text else zero_if_missing
    return df.withColumn(value, coerce(F.col(value)))


def prepare(
    df: DataFrame,
    target_year: int | None = None,
    keys: Sequence[str] | DataFrame | None = KEY_INDICATORS,
    rules: Sequence[tuple[str, str]] = INDICATOR_RULES,
    dedupe: str = "keep",
    per: str = "label",
    date: str = "date",
    label: str = "SERVICE",
    value: str = "valeur",
) -> DataFrame:
    """PRJ-4/6/8, STR-1, FLT-3/4: long rows to ``service, ds, y`` (+ extra columns).

    ``keys=None`` keeps every indicator. ``dedupe="sum"`` merges rows of the same
    indicator and date (and drops extra columns); the default keeps them apart.
    ``per`` is explained at :func:`name_indicators`.
    """
    dates = df.schema[date].dataType
    if isinstance(dates, T.StringType):
        df = df.withColumn(date, strict_date(F.col(date)))
    elif not isinstance(dates, T.DateType):
        df = df.withColumn(date, F.col(date).cast("date"))
    listed = None if isinstance(keys, DataFrame) else keys
    named = name_indicators(before_year(df, target_year, date), label, rules, listed, per)
    series = series_values(named, value).withColumnsRenamed({date: "ds", label: "service", value: "y"})
    if isinstance(keys, DataFrame):
        series = key_indicators(series, keys)
    if dedupe == "sum":
        return series.groupBy("service", "ds").agg(F.sum("y").alias("y"))
    if dedupe != "keep":
        raise ValueError(f"dedupe is 'keep' or 'sum', not {dedupe!r}")
    return series


def in_series_order(df: DataFrame) -> DataFrame:
    """SRT-2: order by indicator and date, for a sink."""
    return spread_sort(df, "service", "ds")


def monthly_view(df: DataFrame) -> DataFrame:
    """PRJ-8: series rows under their published names."""
    return df.withColumnsRenamed({"ds": "date", "y": "valeur"})


def calendar_features(df: DataFrame, ds: str = "ds") -> DataFrame:
    """DAT-1: calendar month and year of every row."""
    return df.select("*", F.month(ds).alias("mois"), F.year(ds).alias("annee"))


def split_by_history(
    df: DataFrame, min_rows: int = MIN_HISTORY_ROWS
) -> tuple[DataFrame, DataFrame]:
    """FLT-5: rows of long enough series, and one ``(service, rows)`` per short one."""
    counts = df.groupBy("service").agg(F.count(F.lit(1)).alias("rows"))
    enough = lookup.attach(df, counts.where(F.col("rows") >= min_rows), ["service"], "rows")
    return enough.select(*df.columns), counts.where(F.col("rows") < min_rows)
