"""DCL-16: two-stage seasonal ARIMA against numpy and a simulated process."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import month_ends

from caseload.operators import sarima


def simulate(n: int, phi: float, sphi: float, theta: float, stheta: float, seed: int = 3) -> np.ndarray:
    """y with (1 - phi B)(1 - sphi B^12) w = (1 + theta B)(1 + stheta B^12) e, w the two differences."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 10, n + 200)
    w = np.zeros(n + 200)
    for t in range(14, n + 200):
        w[t] = (phi * w[t - 1] + sphi * w[t - 12] - phi * sphi * w[t - 13] + e[t] + theta * e[t - 1]
                + stheta * e[t - 12] + theta * stheta * e[t - 13])
    w = w[200:]
    d = np.zeros(n)  # undo the seasonal difference, then the regular one
    for t in range(n):
        d[t] = w[t] + (d[t - 12] if t >= 12 else 0)
    return 1000 + np.cumsum(d)


def two_stage_numpy(y: np.ndarray, long_order: int = 13) -> np.ndarray:
    w = np.full(len(y), np.nan)
    w[13:] = y[13:] - y[12:-1] - y[1:-12] + y[:-13]
    rows = [t for t in range(len(y)) if not np.isnan(w[t - long_order : t + 1]).any() and t >= long_order]
    x = np.array([[w[t - k] for k in range(1, long_order + 1)] for t in rows])
    alpha = np.linalg.lstsq(x, w[rows], rcond=None)[0]
    e = np.full(len(y), np.nan)
    e[rows] = w[rows] - x @ alpha
    lags = (1, 12, 13)
    rows2 = [t for t in range(13, len(y)) if not np.isnan([w[t], *[w[t - k] for k in lags], *[e[t - k] for k in lags]]).any()]
    x2 = np.array([[w[t - k] for k in lags] + [e[t - k] for k in lags] for t in rows2])
    return np.linalg.lstsq(x2, w[rows2], rcond=None)[0]


def series(spark, name: str, y: np.ndarray, gaps=()):
    dates = month_ends("2000-01-31", len(y))
    rows = [(name, d, float(v)) for i, (d, v) in enumerate(zip(dates, y, strict=True)) if i not in gaps]
    return spark.createDataFrame(rows, "service string, ds date, y double")


def test_equals_least_squares_and_recovers_the_process(spark):
    y = simulate(480, 0.5, 0.3, 0.2, -0.3)
    got = sarima.two_stage(series(spark, "A", y)).collect()[0]
    found = np.array([got[name] for name in sarima.NAMES])
    assert np.allclose(found, two_stage_numpy(y), atol=1e-8)
    assert got.n_rows == 480 - 13 - 13 - 13 and got.sigma2 > 0
    assert abs(got.phi - 0.5) < 0.1 and abs(got.theta - 0.2) < 0.1
    # a long autoregression of 13 lags renders a seasonal MA term only in part
    assert abs(got.seasonal_phi - 0.3) < 0.25 and abs(got.seasonal_theta + 0.3) < 0.25


def test_short_constant_and_gapped_series(spark):
    short = series(spark, "short", np.arange(30.0))
    constant = series(spark, "flat", np.full(100, 5.0))
    gapped = series(spark, "gap", simulate(200, 0.4, 0.2, 0.1, 0.1, seed=5), gaps={50})
    nulls = spark.createDataFrame([("n", None, 1.0), ("n", month_ends("2000-01-31", 1)[0], None)], "service string, ds date, y double")
    got = {r.service: r for r in sarima.two_stage(short.unionByName(constant).unionByName(gapped).unionByName(nulls)).collect()}
    assert got["short"].phi is None and got["short"].n_long == 30 - 13 - 13
    assert got["flat"].phi is None  # all differences are zero: singular
    full = sarima.two_stage(series(spark, "gap", simulate(200, 0.4, 0.2, 0.1, 0.1, seed=5))).collect()[0]
    assert got["gap"].n_long < full.n_long and got["gap"].phi is not None
    assert "n" not in got  # no dated value: no series


@pytest.mark.parametrize("name", ["dcl_seasonal_arima", "dcl_seasonal_bands"])
def test_query_against_sql(spark, sf_dir, name):
    import __spark_entry__ as entry
    from oracle import connect, differences

    df = entry.queries()[name](spark, sf_dir)
    assert differences(df, connect(sf_dir), entry.oracle_sql()[name]) == []
    assert df.where("phi IS NOT NULL").count() > 0


def psi_numpy(row, horizon: int = 12) -> np.ndarray:
    """psi weights of the y-level model by long division of the MA by the AR polynomial."""
    ar = np.zeros(27)
    ar[0], ar[1], ar[12], ar[13] = 1.0, -row["phi"], -row["seasonal_phi"], -row["phi_13"]
    full = np.convolve(ar, np.convolve([1.0, -1.0], np.r_[1.0, np.zeros(11), -1.0]))
    ma = np.zeros(horizon)
    ma[0] = 1.0
    for k, name in ((1, "theta"), (12, "seasonal_theta"), (13, "theta_13")):
        if k < horizon:
            ma[k] = row[name]
    psi = np.zeros(horizon)
    for j in range(horizon):
        psi[j] = ma[j] - sum(full[i] * psi[j - i] for i in range(1, min(j, len(full) - 1) + 1))
    return psi


def test_psi_bands_against_division(spark):
    y = simulate(480, 0.5, 0.3, 0.2, -0.3)
    fit = sarima.two_stage(series(spark, "A", y))
    row = fit.collect()[0].asDict()
    bands = sorted(sarima.psi_bands(fit, horizon=15).collect(), key=lambda r: r.step)
    psi = psi_numpy(row, 15)
    assert np.allclose([r.psi for r in bands], psi, atol=1e-9)
    widths = 1.959963984540054 * np.sqrt(row["sigma2"] * np.cumsum(psi**2))
    assert np.allclose([r.half_width for r in bands], widths, rtol=1e-9)


def test_psi_without_coefficients_is_a_seasonal_random_walk(spark):
    zero = spark.createDataFrame([("Z", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 4.0), ("N", None, None, None, None, None, None, None)],
                                 "service string, phi double, seasonal_phi double, phi_13 double, theta double, "
                                 "seasonal_theta double, theta_13 double, sigma2 double")  # fmt: skip
    got = {(r.service, r.step): r for r in sarima.psi_bands(zero).collect()}
    assert all(got[("Z", k)].psi == 1.0 for k in range(1, 13))
    assert np.isclose(got[("Z", 12)].half_width, 1.959963984540054 * 2 * np.sqrt(12))
    assert got[("N", 1)].psi == 1.0 and got[("N", 1)].half_width is None
    assert all(got[("N", k)].psi is None for k in range(2, 13))
