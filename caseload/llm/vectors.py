"""Vectors as packed rows: reading arrays, blocks, k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as doubles, shorter lists filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0)) if width is None else width
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, at] = flat
    return out


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gap = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    return np.maximum(gap, 0)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of at most ``k`` cells; an empty cell keeps its centre."""
    draw = np.random.default_rng(seed)
    centres = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        cell = squared_distances(x, centres).argmin(axis=1)
        count = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
    return centres
