"""Attaching per-key values to raw rows without a hot key ending in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.session import materialise

# Largest table that is broadcast as a whole.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# A key is hot above this share of all rows; so there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 10_000


def row_bytes(df: DataFrame) -> Column:
    """Generous estimate of a row's size in memory."""

    def size(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            return F.coalesce(F.octet_length(value), F.lit(0)) + 32
        if isinstance(field.dataType, T.ArrayType):
            return F.greatest(F.size(value), F.lit(0)) * 256 + 32
        return F.lit(16)

    return sum((size(field) for field in df.schema.fields), F.lit(0)).cast("bigint")


def attach(rows: DataFrame, values: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Inner join of raw ``rows`` with one row of ``values`` per key; null is a key like any other.

    ``values[weight]`` is the number of rows behind the key. The values are written
    and measured: a small table is broadcast. Of a large one only the hot keys are,
    whose number is bounded by construction; the rows of the others are shuffled, and
    none of those groups is large.
    """
    values = materialise(values, "values")
    keys = list(keys)
    size, total = values.agg(F.sum(row_bytes(values)), F.sum(weight)).first()
    if (size or 0) <= MAX_BROADCAST_BYTES:
        return null_safe_join(rows, F.broadcast(values), keys)
    is_hot = F.col(weight) > F.lit(float(total) * HOT_SHARE)
    hot, cold = values.where(is_hot), values.where(~is_hot)
    at_home = null_safe_join(rows, F.broadcast(hot), keys)
    others = null_safe_join(rows, F.broadcast(hot.select(*keys)), keys, "left_anti")
    return at_home.unionByName(null_safe_join(others, cold, keys))


def attach_per_service(rows: DataFrame, values: DataFrame) -> DataFrame:
    """:func:`attach` on ``service`` for ``values`` that do not know their weight.

    The rows are counted per indicator first, which combines before its shuffle, so
    the raw rows themselves are never dealt out by indicator.
    """
    weights = rows.groupBy("service").agg(F.count(F.lit(1)).alias("_rows"))
    return attach(rows, null_safe_join(values, weights, ["service"]), ["service"], "_rows").drop("_rows")


def null_safe_join(rows: DataFrame, values: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on null-safe equality of the keys, which come once."""
    own = {key: f"_key_{key}" for key in keys}
    values = values.withColumnsRenamed(own)
    same = [rows[f"`{key}`"].eqNullSafe(values[f"`{name}`"]) for key, name in own.items()]
    return rows.join(values, same, how).drop(*own.values())
