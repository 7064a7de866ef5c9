"""Embedding near-duplicates by product quantisation with exact rerank.

Unit vectors are assigned to the nearest of the coarse centres, and their residual is coded per
subspace. A query probes every cell whose border it could cross within the distance
that belongs to the cosine limit, so probes suffice by construction; table-lookup distances from the
query to the codes discard what lies beyond that distance plus the stored error of the code,
which no linked vector can; the rest is verified by the exact cosine in double precision.
The recall is one. Centres and codebooks are fitted on a bounded sample; every vector is indexed.

Identical vectors are one class. The lists of a label are packed into blocks of about ``BLOCK``
classes, large lists cut over several, and a query goes to each block it probes.

Defined cases: a null label, or a vector that is null, empty, zero or holds a null or non-finite
component, links with nothing, and so does a null id; repeated rows are copies; shorter vectors
count as filled with zeros; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.llm.components import components, local_roots
from caseload.llm.vectors import k_means, matrix, squared_distances, usable
from caseload.operators.lookup import attach
from caseload.session import materialise

COSINE = 0.98
SAMPLE = 20_000
SUBSPACES, CODES = 8, 64
MAX_CELLS = 1024
BLOCK = 4096
SLACK = 1e-7


class Index:
    """Coarse centres and residual codebooks."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.width = sample.shape[1]
        self.part = -(-self.width // SUBSPACES)
        self.centres = k_means(sample, cells)
        self.between = np.sqrt(squared_distances(self.centres, self.centres))
        residual = sample - self.centres[squared_distances(sample, self.centres).argmin(axis=1)]
        self.books = [k_means(part, CODES, seed=9 + s) for s, part in enumerate(self._cut(residual))]

    def _cut(self, x: np.ndarray) -> list[np.ndarray]:
        x = np.pad(x, ((0, 0), (0, self.part * SUBSPACES - x.shape[1])))
        return [x[:, s * self.part : (s + 1) * self.part] for s in range(SUBSPACES)]

    def unit(self, column) -> np.ndarray:
        x = matrix(column, None)
        x = np.pad(x, ((0, 0), (0, max(0, self.width - x.shape[1]))))
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def assign(self, x: np.ndarray):
        """Cell, codes and the length of the coding error of unit vectors."""
        near = x[:, : self.width]
        cell = squared_distances(near, self.centres).argmin(axis=1)
        residual = near - self.centres[cell]
        codes = np.stack([squared_distances(p, b).argmin(axis=1) for p, b in zip(self._cut(residual), self.books, strict=True)], axis=1)
        decoded = np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], axis=1)[:, : self.width]
        return cell, codes.astype(np.uint8), np.sqrt(((residual - decoded) ** 2).sum(axis=1))

    def probes(self, x: np.ndarray, radius: float) -> np.ndarray:
        """For each vector the cells that a vector within ``radius`` of it can lie in."""
        gap = squared_distances(x[:, : self.width], self.centres)
        own = gap.argmin(axis=1)
        beyond = (gap - gap[np.arange(len(x)), own][:, None]) / np.maximum(2 * self.between[own], 1e-300)
        return beyond <= radius + SLACK

    def table_distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances from vectors to the coded vectors of a cell, by table look-up."""
        total = np.zeros((len(x), len(codes)))
        for s, part in enumerate(self._cut(x[:, : self.width] - self.centres[cell])):
            total += squared_distances(part, self.books[s])[:, codes[:, s]]
        return np.sqrt(total)


def fit(classes: DataFrame, vector: str, sample: int = SAMPLE, cells: int | None = None) -> Index | None:
    """An index from about ``sample`` vectors, chosen by a hash; cells grow with the root of the rows."""
    n = classes.count()
    if not n:
        return None
    place = F.pmod(F.xxhash64(F.lit("index"), vector), F.lit(1 << 30))
    rows = classes.where(place < min(1.0, sample / n) * (1 << 30)).select(vector)
    chosen = rows.limit(2 * sample).toArrow()
    if not chosen.num_rows:
        chosen = classes.select(vector).limit(1).toArrow()
    x = matrix(chosen.column(vector).combine_chunks())
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = x[np.lexsort(x.T)]  # an order that does not depend on how the table is cut
    return Index(x, min(MAX_CELLS, cells or max(4, math.ceil(math.sqrt(n) / 2)), len(x)))


def _links(index: Index, limit: float):
    radius = math.sqrt(max(0.0, 2 - 2 * limit))

    def in_block(members, ids, x):
        """Link rows of a batch of queries against the members of a block."""
        m_ids, m_weight, m_cell, m_codes, m_error, m_x = members
        width = max(x.shape[1], m_x.shape[1])
        x, m_x = np.pad(x, ((0, 0), (0, width - x.shape[1]))), np.pad(m_x, ((0, 0), (0, width - m_x.shape[1])))
        probe = index.probes(x, radius)
        found_q, found_m = [], []
        for cell in np.unique(m_cell):
            inside = np.flatnonzero(m_cell == cell)
            asking = np.flatnonzero(probe[:, cell])
            if not len(asking):
                continue
            far = index.table_distances(x[asking], cell, m_codes[inside])
            q, m = np.nonzero(far <= radius + m_error[inside] + SLACK)
            q, m = asking[q], inside[m]
            good = (x[q] * m_x[m]).sum(axis=1) >= limit
            good &= ids[q] != m_ids[m]
            found_q.append(q[good])
            found_m.append(m[good])
        q = np.concatenate(found_q) if found_q else np.zeros(0, np.int64)
        m = np.concatenate(found_m) if found_m else np.zeros(0, np.int64)
        count = np.bincount(q, m_weight[m], minlength=len(ids)).astype(np.int64)
        nodes = np.concatenate([ids, m_ids])
        order = np.argsort(nodes, kind="stable")  # the smallest id becomes the root
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes))
        root = local_roots(len(nodes), place[q], place[m + len(ids)])
        ends = nodes[order[root[place]]]
        moved = (ends != nodes)
        moved[: len(ids)] |= count > 0
        return nodes[moved], ends[moved], np.concatenate([count, np.zeros(len(m_ids), np.int64)])[moved]

    return in_block


def links(classes: DataFrame, index: Index, limit: float = COSINE) -> DataFrame:
    """``a, b, n`` rows: ``n`` adds up to the linked vectors of class ``a``; ``a - b`` join the groups."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(index)
    radius = math.sqrt(max(0.0, 2 - 2 * limit))

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            cell, _, _ = shared.value.assign(shared.value.unit(batch.column("embedding")))
            columns = [*batch.columns, pa.array(cell.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cell"])

    schema = "label int, rep long, m long, embedding array<float>, cell int"
    placed = materialise(classes.select(F.col("label").cast("int"), "rep", "m", F.col("embedding").cast("array<float>")).mapInArrow(assign, schema), "cells")
    cells = len(index.centres)
    sizes = placed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.map_from_entries(F.collect_list(F.struct("cell", "n")))  # at most one entry per cell
    sizes = sizes.groupBy("label").agg(F.sum("n").alias("weight"), pairs.alias("by_cell"))
    sizes = sizes.select("label", "weight", F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda c: F.coalesce(F.try_element_at("by_cell", c), F.lit(0)).cast("long")).alias("counts"))
    rows = attach(placed, sizes, ["label"], "weight")

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            x = shared.value.unit(batch.column("embedding"))
            counts = matrix(batch.column("counts"), cells).astype(np.int64)
            before = np.cumsum(counts, axis=1) - counts
            cell = batch.column("cell").to_numpy()
            rep = batch.column("rep").to_numpy()
            here = np.arange(len(rep))
            spread = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            block = (before[here, cell] + spread % counts[here, cell]) // BLOCK
            probe = shared.value.probes(x, radius) & (counts > 0)
            q, c = np.nonzero(probe)
            first, last = before[q, c] // BLOCK, (before[q, c] + counts[q, c] - 1) // BLOCK
            reach = last - first + 1
            visit = np.repeat(first, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
            ask = np.unique(np.column_stack([np.repeat(q, reach), visit]), axis=0)
            take = pa.array(np.concatenate([here, ask[:, 0]]))
            table = batch.select(["label", "rep", "m", "embedding", "cell"]).take(take)
            columns = [*table.columns, pa.array(np.concatenate([block, ask[:, 1]])), pa.array(np.repeat([0, 1], [len(here), len(ask)]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*table.schema.names, "block", "kind"])

    dealt = rows.mapInArrow(deal, f"{schema}, block long, kind int")
    dealt = dealt.repartition("label", "block").sortWithinPartitions("label", "block", "kind")

    def meet(batches):
        import pyarrow as pa

        in_block = _links(shared.value, limit)
        key, parts, members = None, [], None

        for batch in batches:
            keys = np.column_stack([batch.column("label").to_numpy(), batch.column("block").to_numpy(), batch.column("kind").to_numpy()])
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                run = batch.slice(int(a), int(b - a))
                here = tuple(keys[a][:2])
                if here != key:
                    key, parts, members = here, [], None
                x = shared.value.unit(run.column("embedding"))
                rep = run.column("rep").to_numpy()
                if keys[a][2] == 0:
                    parts.append((rep, run.column("m").to_numpy(), *shared.value.assign(x), x))
                    continue
                if members is None:
                    width = max((p[-1].shape[1] for p in parts), default=0)
                    parts = [(*p[:-1], np.pad(p[-1], ((0, 0), (0, width - p[-1].shape[1])))) for p in parts]
                    members = [np.concatenate(column) for column in zip(*parts, strict=True)] if parts else None
                if members is not None:
                    columns = in_block(members, rep, x)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])

    return dealt.mapInArrow(meet, "a long, b long, n long")


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", limit: float = COSINE
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    ok = usable("embedding") & F.coalesce(nonzero, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = rows.where(ok)
    classes = materialise(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")), "classes")
    index = fit(classes, "embedding")
    alone = F.col("vec_id").alias("component_id")
    bad = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), alone)
    if index is None:
        result = bad
    else:
        found = materialise(links(classes, index, limit), "found")
        counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
        groups = components(found, "a", "b").withColumnRenamed("node", "rep")
        told = classes.join(counts, "rep", "left").join(groups, "rep", "left").select(
            "label", "embedding",
            (F.coalesce("others", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
        told = materialise(told, "told")
        result = good.join(told, ["label", "embedding"]).select("vec_id", "n_links", "component_id").unionByName(bad)
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
