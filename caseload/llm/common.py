"""Helpers of the operators: folds, text batches as bytes, tables of the query modules."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts handed to one call of a batch function; a longer text comes alone.
BATCH_BYTES = 2 << 20

Texts = tuple[np.ndarray, np.ndarray]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def text_bytes(column: pa.Array) -> Texts:
    """UTF-8 bytes of a string column without copying, and n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count:
        return text_bytes(column.fill_null(""))
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first, last = int(offsets[0]), int(offsets[-1])
    return data[first:last], offsets - first


def pieces(batch: pa.RecordBatch, text: str, limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Runs of rows with at most ``limit`` bytes of text, one row at least."""
    data, offsets = text_bytes(batch.column(text))
    begin, rows = 0, len(offsets) - 1
    while begin < rows:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), rows)
        part = data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        yield batch.slice(begin, end - begin), part
        begin = end


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    added: T.StructType,
    make: Callable[[], Callable[[np.ndarray, np.ndarray], Sequence]],
) -> DataFrame:
    """``keep`` columns plus ``added`` ones, computed from the bytes of ``text``.

    ``make`` runs once per task and returns the function of a run of texts. A kept
    column named like an added one is replaced by it; other columns are not read.
    """
    fresh = {field.name.lower() for field in added.fields}
    kept = [name for name in keep if name.lower() not in fresh]
    source = df.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([source.schema[name] for name in kept] + added.fields)
    types = [pa_type(field.dataType) for field in added.fields]
    names = [field.name for field in schema.fields]

    def run(batches):
        score = make()
        for batch in batches:
            for rows, texts in pieces(batch, text):
                new = score(*texts)
                arrays = [rows.column(name) for name in kept]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(new, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return source.mapInArrow(run, schema)


def pa_type(kind: T.DataType) -> pa.DataType:
    plain = {
        T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(),
        T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary(),
    }
    return pa.list_(pa_type(kind.elementType)) if isinstance(kind, T.ArrayType) else plain[kind]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values[offsets[i]:offsets[i + 1]]`` along the first axis; 0 for empty ones."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.result_type(values.dtype, np.float64) if values.dtype.kind == "f" else np.int64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=out.dtype)
    return out


def sample_share(df: DataFrame, by: str, size: Column, bound: float, key: str, salt: str) -> DataFrame:
    """About ``bound`` of ``size`` from every value of ``by``, chosen by a hash of ``key``.

    Two aggregates fix each share; the rows are then a filter, so nothing is sorted.
    """
    totals = {row[0]: float(row[1] or 0) for row in df.groupBy(by).agg(F.sum(size)).collect()}
    share = F.lit(0.0)
    for value, total in totals.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, bound / max(total, 1.0)))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit(salt), F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    return df.where(place < share)
