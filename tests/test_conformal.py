"""Split-conformal widths against a direct sort."""

from __future__ import annotations

import math

import numpy as np
import pytest

from caseload.operators import conformal

SCHEMA = "model string, step int, y double, yhat double"


def brute(rows, level=0.95):
    groups = {}
    for model, step, y, yhat in rows:
        if y is not None and yhat is not None:
            groups.setdefault((model, step), []).append(abs(y - yhat))
    out = {}
    for key, scores in groups.items():
        scores.sort()
        rank = math.ceil((len(scores) + 1) * level)
        q = scores[rank - 1] if rank <= len(scores) else None
        cover = None if q is None else float(np.mean([s <= q for s in scores]))
        out[key] = (len(scores), q, cover)
    return out


def test_against_sort_with_ties_and_a_hot_value(spark):
    rng = np.random.default_rng(2)
    rows = [("A", 1, float(v), 0.0) for v in rng.normal(size=500).round(1)]  # many ties
    rows += [("A", 2, 5.0, 0.0)] * 3000 + [("A", 2, float(v), 0.0) for v in rng.normal(size=200)]  # a hot value
    rows += [("B", 1, 1.0, 0.5)] * 5 + [("B", 1, None, 1.0), ("B", 1, 1.0, None)]  # too few for 95 %
    points = spark.createDataFrame(rows, SCHEMA)
    got = {(r.model, r.step): (r.n, r.quantile, r.coverage) for r in conformal.coverage(points, conformal.quantiles(points)).collect()}
    assert got == brute(rows)
    assert got[("B", 1)] == (5, None, None) and got[("A", 2)][1] == 5.0


def test_empty(spark):
    points = spark.createDataFrame([], SCHEMA)
    assert conformal.quantiles(points).count() == 0


@pytest.mark.parametrize("name", ["dcl_conformal"])
def test_query_against_sql(spark, sf_dir, name):
    import __spark_entry__ as entry
    from oracle import connect, differences

    df = entry.queries()[name](spark, sf_dir)
    assert differences(df, connect(sf_dir), entry.oracle_sql()[name]) == []
    assert all(r.coverage >= 0.95 for r in df.collect() if r.quantile is not None)
