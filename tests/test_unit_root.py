"""DCL-12 with lags: augmented Dickey-Fuller against numpy least squares."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import month_ends

from caseload.operators import unit_root


def frame(spark, series: dict[str, np.ndarray]):
    rows = [(name, d, float(v)) for name, y in series.items() for d, v in zip(month_ends("2001-01-31", len(y)), y, strict=True)]
    return spark.createDataFrame(rows, "service string, ds date, y double")


def adf_numpy(y: np.ndarray, max_lags: int = 2):
    d = np.diff(y)
    fits = []
    rows = range(max_lags, len(d))
    for p in range(max_lags + 1):
        x = np.array([[1.0, y[t], *[d[t - i] for i in range(1, p + 1)]] for t in rows])
        target = d[list(rows)]
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        rss = float(((target - x @ beta) ** 2).sum())
        n, k = len(target), p + 2
        se = np.sqrt(rss / (n - k) * np.linalg.inv(x.T @ x)[1, 1])
        fits.append((n * np.log(rss / n) + 2 * k, p, beta[1] / se))
    return min(fits), len(rows)


def test_against_least_squares(spark):
    rng = np.random.default_rng(11)
    ar = np.zeros(120)
    for t in range(1, 120):
        ar[t] = 0.3 * ar[t - 1] + rng.normal()
    walk = np.cumsum(rng.normal(size=120))
    seasonal = 10 * np.sin(np.arange(90) * 2 * np.pi / 12) + rng.normal(size=90)
    series = {"ar": 50 + ar, "walk": 50 + walk, "seasonal": seasonal}
    got = {r.service: r for r in unit_root.augmented(frame(spark, series)).collect()}
    for name, y in series.items():
        (aic, lags, t), n = adf_numpy(y)
        r = got[name]
        assert (r.n, r.lags) == (n, lags) and np.isclose(r.aic, aic, rtol=1e-9) and np.isclose(r.t, t, rtol=1e-8)
        b0, b1, b2, b3 = unit_root.CRITICAL_5
        assert np.isclose(r.critical, b0 + b1 / n + b2 / n**2 + b3 / n**3)
    assert got["ar"].stationary and not got["walk"].stationary


def test_short_and_gapped(spark):
    df = frame(spark, {"short": np.arange(8.0), "flat": np.full(40, 3.0)})
    got = {r.service: r for r in unit_root.augmented(df).collect()}
    assert got["short"].t is None and got["short"].stationary is False
    assert got["flat"].lags is None and got["flat"].stationary is False  # no residuals: no AIC


@pytest.mark.parametrize("name", ["dcl_stationarity_lags"])
def test_query_against_sql(spark, sf_dir, name):
    import __spark_entry__ as entry
    from oracle import connect, differences

    df = entry.queries()[name](spark, sf_dir)
    assert differences(df, connect(sf_dir), entry.oracle_sql()[name]) == []
