"""Exact top-k by inner product over norm-sorted buckets.

Vectors are packed into blocks of similar length, longest first. A task holds a block of
queries and meets the blocks of a group in that order. A query's k-th score so far gives its
local cosine threshold in a block: above one, the block is skipped; a low one prunes by
length (a prefix of the block); a high one prunes by the query's largest coordinate,
whose range in a good enough candidate is known. Survivors' products are verified.

Defined cases: vectors null, empty, or with null or non-finite components, and null ids take no part;
rows of the query's id are the query's own; an id queried twice counts
once; ties go to the smaller id; shorter vectors count as filled with zeros; an empty table
gives no rows; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.llm.vectors import matrix, usable
from caseload.session import materialise

SCALE = 64.0
K = 20
BLOCK, QUERIES, GROUP = 1024, 1024, 16
COORDINATE_FROM = 0.3  # local threshold from which the coordinate bound is the sharper one

ROW = "vec_id long, norm double, v binary"
BLOCKS = "part int, at int, ids binary, norms binary, v binary, width int, item int"


def integers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """Rows with components floor(scale x) packed as integers, and their length."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.floor(matrix(batch.column("x")) * scale)
            norm = np.sqrt((x * x).sum(axis=1))
            packed = [row.astype("<i8").tobytes() for row in x]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(norm), pa.array(packed, pa.binary())], ["vec_id", "norm", "v"])

    rows = df.where(F.col(vec_id).isNotNull() & usable(vector))
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).mapInArrow(run, ROW)


def _unpacked(raws: list[bytes]) -> np.ndarray:
    width = max(map(len, raws), default=0) // 8
    return np.stack([np.frombuffer(raw.ljust(8 * width, b"\0"), "<i8") for raw in raws]) if raws else np.zeros((0, 0), np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes that hold them all."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(f"<i{n}" for n in (1, 2, 4, 8) if -(1 << 8 * n - 1) <= low and high < 1 << 8 * n - 1))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Runs of ``size`` rows by falling length, each packed into one row and numbered by length.

    Ranges of length follow each other, so a block's number is its place in its range
    after the blocks of the ranges before: only their counts meet in one task.
    """

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        ids, norms, raws = [], [], []

        def out(n):
            x = _narrow(_unpacked(raws[:n]))
            row = [[part], [at], [np.array(ids[:n], "<i8").tobytes()], [np.array(norms[:n], "<f8").tobytes()], [x.tobytes()], [x.shape[1]], [x.itemsize]]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
            names = ["part", "at", "ids", "norms", "v", "width", "item"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            norms += batch.column("norm").to_pylist()
            raws += batch.column("v").to_pylist()
            while len(ids) >= size:
                yield out(size)
                at += 1
                ids, norms, raws = ids[size:], norms[size:], raws[size:]
        if ids:
            yield out(len(ids))

    ordered = rows.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    packed = materialise(ordered.mapInArrow(pack, BLOCKS), "blocks")
    # One row per range: the blocks of the ranges before it.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = packed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return packed.join(before, "part").withColumn("number", (F.col("before") + F.col("at")).cast("int")).drop("part", "at", "before")


class Best:
    """The k best of every query of a block so far."""

    def __init__(self, ids, norms, x, k):
        self.ids, self.norms, self.x, self.k = ids, norms, x, k
        self.query = np.zeros(0, np.int64)
        self.score, self.found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(len(ids), -np.inf)
        size = np.maximum(norms, 1e-300)
        self.focus = np.abs(x).argmax(axis=1) if x.shape[1] else np.zeros(len(ids), np.int64)
        self.part = x[np.arange(len(ids)), self.focus] / size if x.shape[1] else np.zeros(len(ids))

    def meet(self, ids, norms, y):
        width = max(self.x.shape[1], y.shape[1])
        x = np.pad(self.x, ((0, 0), (0, width - self.x.shape[1])))
        y = np.pad(y, ((0, 0), (0, width - y.shape[1])))
        slack = 1e-9
        bound = self.norms * norms[0]
        live = np.flatnonzero((self.least <= bound * (1 + slack)) | np.isneginf(self.least))
        if not len(live):
            return
        exact = max(np.abs(x).max(initial=0), 1) * float(max(np.abs(y).max(initial=0), 1)) * max(width, 1) < 2**53
        open_ = live[np.isneginf(self.least[live])]
        pairs = []
        if len(open_):  # nothing to prune by yet
            scores = (x[open_].astype(float) @ y.T.astype(float)).astype(np.int64) if exact else x[open_] @ y.T
            scores_ok = ids[None, :] != self.ids[open_][:, None]
            if scores.shape[1] > self.k + 1:
                cut = np.partition(np.where(scores_ok, scores, np.iinfo(np.int64).min), -self.k, axis=1)[:, -self.k]
                scores_ok &= scores >= cut[:, None]
            q, c = np.nonzero(scores_ok)
            pairs.append((open_[q], c, scores[q, c]))
        rest = live[~np.isneginf(self.least[live])]
        if len(rest):
            need = self.least[rest]
            share = need / np.maximum(self.norms[rest] * norms[0], 1e-300)
            # Length: with a positive threshold only a prefix of the block is long enough.
            least_norm = np.where(need > 0, need / np.maximum(self.norms[rest], 1e-300) * (1 - slack), -1.0)
            keep = norms[None, :] >= least_norm[:, None]
            sharp = np.flatnonzero(share >= COORDINATE_FROM)
            if len(sharp):  # coordinate: x_f / |x| lies within the cap of the threshold
                t, f, p = np.minimum(share[sharp], 1.0), self.focus[rest[sharp]], self.part[rest[sharp]]
                spread = np.sqrt(np.maximum((1 - t * t) * (1 - p * p), 0))
                low, high = p * t - spread - slack, p * t + spread + slack
                low = np.where(p <= -t, -1.0 - slack, low)
                high = np.where(p >= t, 1.0 + slack, high)
                unit = (y[:, f] / np.maximum(norms, 1e-300)[:, None]).T
                keep[sharp] &= (unit >= low[:, None]) & (unit <= high[:, None])
            if keep.mean() > 0.1:
                scores = (x[rest].astype(float) @ y.T.astype(float)).astype(np.int64) if exact else x[rest] @ y.T
                q, c = np.nonzero(keep & (scores >= need[:, None]))
                pairs.append((rest[q], c, scores[q, c]))
            else:
                q, c = np.nonzero(keep)
                for at in range(0, len(q), 1 << 16):
                    a, b = q[at : at + (1 << 16)], c[at : at + (1 << 16)]
                    s = (x[rest[a]] * y[b]).sum(axis=1)
                    good = s >= need[a]
                    pairs.append((rest[a[good]], b[good], s[good]))
        query = np.concatenate([self.query, *(p[0] for p in pairs)])
        found = np.concatenate([self.found, *(ids[p[1]] for p in pairs)])
        score = np.concatenate([self.score, *(p[2] for p in pairs)])
        own = found == self.ids[query]
        query, found, score = query[~own], found[~own], score[~own]
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        first = np.searchsorted(query, query)
        top = np.arange(len(query)) - first < self.k
        self.query, self.found, self.score = query[top], found[top], score[top]
        full = np.bincount(self.query, minlength=len(self.ids)) >= self.k
        last = np.searchsorted(self.query, np.arange(len(self.ids)), "right") - 1
        self.least[full] = self.score[last[full]]


def _search(k):
    def run(batches):
        import pyarrow as pa

        key, best = None, None

        def out():
            columns = [best.ids[best.query], best.found, best.score]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                ids, norms = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["norms"], "<f8")
                x = np.frombuffer(row["v"], f"<i{row['item']}").astype(np.int64).reshape(len(ids), row["width"])
                if row["kind"] == 0:
                    if best is not None:
                        yield out()
                    key, best = (row["qb"], row["g"]), Best(ids, norms, x, k)
                elif key == (row["qb"], row["g"]):
                    best.meet(ids, norms, x)
        if best is not None:
            yield out()

    return run


def search(df: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of each query."""
    rows = materialise(integers(df, vec_id, vector, scale), "vectors")
    wanted = df.where(is_query).select(F.col(vec_id).cast("long").alias("vec_id")).distinct()
    queries = rows.join(wanted, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("norm", "v")).alias("s"))
    blocks = _blocks(rows, BLOCK)
    asked = _blocks(queries.select("vec_id", "s.norm", "s.v"), QUERIES)
    n_blocks, n_asked = blocks.count(), asked.count()
    groups = max(1, -(-n_blocks // GROUP))
    # The stated queries against all rows, block by block.
    left = asked.select(
        F.col("number").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"),
        F.lit(0).alias("kind"), F.lit(0).alias("at"), "ids", "norms", "v", "width", "item",
    )
    right = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(max(n_asked - 1, 0)))).alias("qb"), (F.col("number") % groups).alias("g"),
        F.lit(1).alias("kind"), F.col("number").alias("at"), "ids", "norms", "v", "width", "item",
    )
    met = left.unionByName(right).repartition("qb", "g").sortWithinPartitions("qb", "g", "kind", "at")
    some = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return some.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
