"""SimHash near-duplicates through tables of distances to reference fingerprints.

The references are the zero fingerprint and, for each of five blocks of bits, random
patterns inside the block. Distances to a block's references less the distance to
zero depend on that block alone. Two fingerprints at most ``MAX_BITS`` = 2 apart agree in
three blocks, hence in their coordinates there: each fingerprint enters one bucket per
choice of three blocks, named by those coordinates. Inside a bucket, pairs whose
largest difference of coordinates exceeds the limit are discarded; survivors are
verified on the fingerprints. A bucket above ``BUCKET`` rows is split by the
coordinates of a third of its free bits, in all three ways, until it is small: again
nothing is lost, since one third must agree.

Equal fingerprints are collapsed first, so copies never form pairs, and the work
between different ones is told as links to the smallest member of a local group.

Defined cases: a null text, or one without words, has fingerprint zero and links
like any other; fewer words than a shingle make one shingle; repeated rows and ids
each get a row; a null id never names a component unless it has no other; an empty
table gives no rows; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.llm.common import map_texts
from caseload.llm.components import components, local_roots
from caseload.session import materialise

SHINGLE, SEED, MAX_BITS = 3, 42, 2
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
PER_BLOCK = 12
BUCKET = 2048
CUT_BYTES = 1 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' hashes; words and case as in ASCII."""
    ones, total, tail, begin = np.zeros(64, np.int64), 0, [], 0
    hashed = xxhash.xxh64_intdigest
    words: list[bytes] = []
    while begin < len(text):
        end = min(begin + CUT_BYTES, len(text))
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = tail + text[begin:end].lower().split()
        runs = zip(*(islice(words, k, None) for k in range(shingle)), strict=False)
        hashes = np.array([hashed(b" ".join(run), SEED) for run in runs], "<u8")
        if len(hashes):
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
        tail, begin = words[-(shingle - 1) :] if shingle > 1 else [], end
    if not total:
        return hashed(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def references(first: int, last: int, count: int = PER_BLOCK) -> np.ndarray:
    """Fixed random patterns inside the bits ``first`` to ``last``."""
    draw = np.random.default_rng(1000 * first + last)
    return (draw.integers(1, 1 << (last - first), count, dtype=np.uint64)) << np.uint64(first)


def block_table(prints: np.ndarray, first: int, last: int) -> np.ndarray:
    """Distances to the block's references less the distance to zero."""
    zero = np.bitwise_count(prints).astype(np.int8)
    return np.stack([np.bitwise_count(prints ^ r).astype(np.int8) - zero for r in references(first, last)], axis=1)


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Distances to all references, zero first."""
    every = np.concatenate([[np.uint64(0)], *(references(*block) for block in BLOCKS)])
    return np.stack([np.bitwise_count(prints ^ r).astype(np.int8) for r in every], axis=1)


def _named(table: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit name for each row of coordinates."""
    factors = np.random.default_rng(salt).integers(1, 1 << 63, table.shape[1], dtype=np.uint64) | np.uint64(1)
    out = ((table.astype(np.int64).view(np.uint64) + np.uint64(64)) * factors).sum(axis=1, dtype=np.uint64)
    return out ^ (out >> np.uint64(31))


def bucket_keys(prints: np.ndarray) -> np.ndarray:
    """One column per choice of three blocks."""
    names = [_named(block_table(prints, *block), k) for k, block in enumerate(BLOCKS)]
    mix = np.uint64(0x9E3779B97F4A7C15)
    keys = []
    for n, (a, b, c) in enumerate(combinations(range(5), 3)):
        key = (names[a] * mix + names[b]) * mix + names[c]
        keys.append(((key ^ (key >> np.uint64(29))) & np.uint64((1 << 60) - 1)) | np.uint64(n << 60))
    return np.stack(keys, axis=1)


def free_parts(choice: int, path: Sequence[int]) -> list[tuple[int, int]]:
    """The bits a bucket leaves free, in thirds, after the thirds in ``path`` agreed."""
    taken = list(combinations(range(5), 3))[choice]
    bits = [bit for k, block in enumerate(BLOCKS) if k not in taken for bit in range(*block)]
    for part in path:
        thirds = np.array_split(np.array(bits), 3)
        bits = [int(b) for k, third in enumerate(thirds) if k != part for b in third]
    return [tuple(map(int, third)) for third in np.array_split(np.array(bits), 3)]


def split_keys(prints: np.ndarray, keys: np.ndarray, choices: np.ndarray, paths: Sequence[str]):
    """Three rows for each: the bucket split by the coordinates of one third of its free bits."""
    out_keys = np.zeros((len(prints), 3), np.uint64)
    marks = np.array([f"{c}/{p}" for c, p in zip(choices, paths, strict=True)])
    for mark in np.unique(marks):
        rows = np.flatnonzero(marks == mark)
        choice, path = mark.split("/")
        for part, bits in enumerate(free_parts(int(choice), [int(c) for c in path])):
            mask = np.uint64(sum(1 << b for b in bits))
            draw = np.random.default_rng(bits[0] * 64 + part)
            refs = draw.integers(0, 1 << 63, PER_BLOCK, dtype=np.uint64) & mask
            zero = np.bitwise_count(prints[rows]).astype(np.int8)
            table = np.stack([np.bitwise_count(prints[rows] ^ r).astype(np.int8) - zero for r in refs], axis=1)
            out_keys[rows, part] = (keys[rows] * np.uint64(0xC2B2AE3D27D4EB4F) + _named(table, 77 + part)) ^ np.uint64(part)
    return out_keys


def close_pairs(keys: np.ndarray, prints: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of verified pairs among rows sorted by bucket."""
    table = distance_table(prints)
    found_a, found_b = [], []
    row, shift = np.arange(len(keys) - 1), 1
    while True:
        row = row[row + shift < len(keys)]
        row = row[keys[row] == keys[row + shift]]
        if not len(row):
            break
        near = row[np.abs(table[row, :8] - table[row + shift, :8]).max(axis=1) <= limit]
        near = near[np.abs(table[near] - table[near + shift]).max(axis=1) <= limit]
        near = near[np.bitwise_count(prints[near] ^ prints[near + shift]) <= limit]
        found_a.append(near)
        found_b.append(near + shift)
        shift += 1
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (row, row)


def _search(limit: int):
    def run(batches):
        import pyarrow as pa

        key, fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def emit(key, fp):
            a, b = close_pairs(key, fp, limit)
            root = local_roots(len(fp), a, b)
            moved = np.flatnonzero(root != np.arange(len(fp)))
            moved = moved[fp[moved] != fp[root[moved]]]
            columns = [fp[moved].view(np.int64), fp[root[moved]].view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy().view(np.uint64)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            if len(key) > 16384:  # keep the last bucket: it may go on, and is small
                cut = int(np.argmax(key == key[-1]))
                if cut:
                    yield emit(key[:cut], fp[:cut])
                    key, fp = key[cut:], fp[cut:]
        if len(key) > 1:
            yield emit(key, fp)

    return run


def links(prints: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """``a, b``: links that join the groups of distinct fingerprints ``fp``.

    ``limit`` is at most 2, for which the blocks are made.
    """
    if not 0 <= limit <= 2:
        raise ValueError("the blocks hold for a distance of at most 2")

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            keys = bucket_keys(fp)
            n = keys.shape[1]
            columns = [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, n).view(np.int64))]
            columns += [pa.array(np.tile(np.arange(n, dtype=np.int32), len(fp))), pa.array([""] * (n * len(fp)))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "fp", "choice", "path"])

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            fp, paths = batch.column("fp").to_numpy(), batch.column("path").to_pylist()
            choice = batch.column("choice").to_numpy()
            keys = split_keys(fp.view(np.uint64), batch.column("key").to_numpy().view(np.uint64), choice, paths)
            columns = [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, 3)), pa.array(np.repeat(choice, 3))]
            columns.append(pa.array([f"{p}{k}" for p in paths for k in range(3)]))
            yield pa.RecordBatch.from_arrays(columns, ["key", "fp", "choice", "path"])

    schema = "key long, fp long, choice int, path string"
    rows = materialise(prints.select("fp").mapInArrow(spread, schema), "buckets")
    parts = []
    for level in range(4):
        large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET)
        large = materialise(large, "large-buckets")
        if level == 3 or large.isEmpty():  # by now 8 bits at most are free: 256 rows
            parts.append(rows)
            break
        parts.append(rows.join(large, "key", "left_anti"))
        rows = materialise(rows.join(large, "key", "left_semi").mapInArrow(split, schema), "buckets")
    found = None
    for part in parts:
        ordered = part.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
        pairs = ordered.mapInArrow(_search(limit), "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, limit: int = MAX_BITS
) -> DataFrame:
    """``doc_id, fp, component_id`` per row: the smallest id reachable over links of fingerprints."""
    fields = T.StructType([T.StructField("fp", T.LongType())])

    def make():
        def prints(data, offsets):
            raw = data.tobytes()
            values = [fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return [np.array(values, np.uint64).view(np.int64)]

        return prints

    docs = materialise(map_texts(df, text, [doc_id], fields, make), "fingerprints")
    distinct = materialise(docs.groupBy("fp").agg(F.min(doc_id).alias("rep")), "distinct")
    groups = components(links(distinct, limit), "a", "b")
    members = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    members = members.join(distinct, F.col("node") == F.col("fp")).select("fp", "component", "rep")
    named = members.join(members.groupBy("component").agg(F.min("rep").alias("least")), "component").select("fp", "least")
    labels = distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return docs.join(materialise(labels, "labels"), "fp").select(doc_id, "fp", "component_id")
