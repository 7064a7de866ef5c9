"""Models, evaluation and selection."""

from __future__ import annotations

import datetime as dt
import math
from fractions import Fraction
from functools import partial, reduce

import numpy as np
import pytest
from conftest import month_ends
from pyspark.sql import functions as F

import caseload
from caseload.functions.rules import NO_MODEL_ERROR, SHORT_HISTORY_ERROR
from caseload.operators import fits, kpi, lookup, quality, selection, series
from caseload.operators import forecast as forecast_module
from caseload.operators.forecast import forecast, random_walk
from caseload.operators.metrics import evaluate, with_score
from caseload.operators.prepare import split_by_history
from caseload.operators.quality import flag_outliers
from caseload.operators.validation import backtest, backtest_splits
from caseload.plans import reports
from caseload.session import materialise, release, shared_folder

MODELS = list(fits.REGISTRY)


def days(n: int, start: str = "2015-01") -> np.ndarray:
    first = np.datetime64(start, "M")
    return (first + np.arange(n)).astype("M8[D]").astype(int)


def call(fit, y, horizon=12, n=None, yy=None):
    y = np.asarray(y, float)
    d = days(len(y) + horizon)
    n = np.ones(len(y)) if n is None else np.asarray(n, float)
    return fits.fit_one(fit, d[: len(y)], y, n, n * y**2 if yy is None else yy, d[len(y):])


SEASONAL = 200 + 30 * np.sin(np.arange(84) * np.pi / 6) + np.arange(84)


@pytest.mark.parametrize("name", MODELS)
def test_shapes_and_determinism(name):
    first, second = (call(fits.REGISTRY[name], SEASONAL, 7) for _ in range(2))
    assert first.fitted.shape == (84,) and first.future.shape == (7,)
    assert (first.fitted == second.fitted).all() and (first.future == second.future).all()


@pytest.mark.parametrize("name", MODELS)
@pytest.mark.parametrize("value", [0.0, 50.0, 0.1])
def test_constant_series_is_reproduced(name, value):
    fit = call(fits.REGISTRY[name], [value] * 15)
    assert (fit.fitted == value).all() and (fit.future == value).all()


def test_trend_and_season_are_recovered():
    fit = call(fits.trend_seasonality, SEASONAL)
    expected = 200 + 30 * np.sin(np.arange(84, 96) * np.pi / 6) + np.arange(84, 96)
    assert np.abs(fit.fitted - SEASONAL).max() < 6
    assert np.abs(fit.future - expected).max() < 15
    assert call(fits.trend_seasonality, SEASONAL[:20]).variant == "trend"


def test_multiplicative_season():
    level = np.linspace(100, 400, 96)
    y = level * (1 + 0.3 * np.sin(np.arange(96) * np.pi / 6))
    errors = {
        mode: np.abs(call(lambda *a: fits.trend_seasonality(*a, multiplicative=mode), y).fitted - y).mean()
        for mode in (False, True)
    }
    assert errors[True] < errors[False]


def grow(cells, weight, value):
    """Plain recursive regression tree on (month, year) cells, in exact arithmetic."""
    present = [c for c in cells if weight[c] > 0]
    if len({c for c in present}) <= 1:
        mean = value[present[0]]
        return {c: mean for c in cells}
    best = None
    for axis in (0, 1):
        for cut in sorted({c[axis] for c in cells})[:-1]:
            sides = [[c for c in present if (c[axis] <= cut) is low] for low in (True, False)]
            if all(sides):
                gain = sum(
                    sum(weight[c] * value[c] for c in side) ** 2 / sum(weight[c] for c in side)
                    for side in sides
                )
                if best is None or gain > best[0]:
                    best = (gain, axis, cut)
    _, axis, cut = best
    out = {}
    for low in (True, False):
        out |= grow([c for c in cells if (c[axis] <= cut) is low], weight, value)
    return out


def test_forest_equals_recursive_trees(monkeypatch):
    monkeypatch.setattr(fits, "TREES", 8)
    rng = np.random.default_rng(5)
    y = rng.normal(100, 20, 36)
    fit = call(fits.calendar_forest, y)
    rows = np.zeros(36)
    index = [(i % 12, i // 12) for i in range(36)]
    for i, (m, a) in enumerate(index):
        rows[m * 3 + a] = 1
    draws = np.random.default_rng(fits.SEED).multinomial(36, rows / 36, 8)
    value = {c: Fraction(y[i]) for i, c in enumerate(index)}
    trees = [grow(index, {(m, a): int(draw[m * 3 + a]) for m, a in index}, value) for draw in draws]
    expected = [float(sum(tree[c] for tree in trees) / 8) for c in index]
    assert np.allclose(fit.fitted, expected)
    # The next year behaves like the last one seen.
    assert np.allclose(fit.future, expected[24:])


def test_forest_stays_within_the_data():
    fit = call(fits.calendar_forest, SEASONAL**2)
    both = np.r_[fit.fitted, fit.future]
    assert both.min() >= (SEASONAL**2).min() and both.max() <= (SEASONAL**2).max()


def test_arima_recovers_a_known_process():
    rng = np.random.default_rng(3)
    e, w = rng.normal(0, 1, 3000), np.zeros(3000)
    for t in range(1, 3000):
        w[t] = 0.6 * w[t - 1] + e[t] + 0.3 * e[t - 1]
    phi, theta, resid = fits._css(w, 1, 1)
    assert abs(phi[0] - 0.6) < 0.06 and abs(theta - 0.3) < 0.08
    assert abs(resid.var() - 1) < 0.1


def test_arima_tries_the_orders_in_turn():
    assert call(fits.arima, SEASONAL).variant == "1,1,1"
    y = np.r_[np.zeros(3), 1.0]
    d = days(6)
    short = fits.arima(d[:4], y, np.ones(4), y**2, d[4:])
    assert short.variant == "0,1,1"
    tiny = np.array([1.0, 2.0])
    with pytest.raises(ValueError, match="ARIMA"):
        fits.arima(d[:2], tiny, np.ones(2), tiny**2, d[2:])


def test_arima_starts_from_nothing_and_walks():
    phi_free = fits._arima_order(np.array([5.0, 7.0, 4.0]), 2, (0, 1, 0))
    assert phi_free[0].tolist() == [0.0, 5.0, 7.0]
    assert phi_free[1].tolist() == [4.0, 4.0]


def test_seasonal_difference_repeats_the_season():
    y = np.tile(np.arange(12.0), 6)
    fit = call(lambda *a: fits.arima(*a, seasonal_difference=12), y)
    assert np.allclose(fit.future, np.arange(12.0))
    assert fit.variant.endswith("+s12")


def test_duplicate_rows_weigh_like_rows():
    y = SEASONAL[:40]
    n = np.r_[np.ones(20), np.full(20, 3.0)]
    weighted = call(fits.trend_seasonality, y, n=n)
    assert np.abs(weighted.fitted - y).mean() < np.abs(y - y.mean()).mean() / 2


def test_series_fitted_together_are_fitted_as_alone():
    """One pass over many series gives each the fit it gets by itself, failures included."""
    rng = np.random.default_rng(11)
    y = rng.normal(100, 20, (40, 30)).round(1)
    y[3], y[4, 2], y[5, ::2] = 7.0, np.nan, 0.0
    first = days(30 + 12)
    at = np.array([first + 31 * (i % 5) for i in range(40)])
    for fit in (*fits.REGISTRY.values(), partial(fits.trend_seasonality, multiplicative=True)):
        together = fits.fit_many(fit, at[:, :30], y, np.ones(y.shape), y**2, at[:, 30:])
        for i, got in enumerate(together):
            if i == 4:
                assert str(got) == "the values are not finite"
                continue
            alone = fits.fit_one(fit, at[i, :30], y[i], np.ones(30), y[i] ** 2, at[i, 30:])
            assert (got.fitted == alone.fitted).all() and (got.future == alone.future).all()
            assert got.variant == alone.variant


def test_one_call_fits_all_series_of_a_length(spark, complete):
    """The cost of a call is shared: series of equal length come in one."""
    sizes = spark.sparkContext.accumulator(0)

    def counted(days, y, n, yy, future):
        raise AssertionError("series by series")

    def many(days, y, n, yy, future):
        sizes.add(1)
        return [fits.Fit(row, np.zeros(future.shape[1]), "kept") for row in y]

    counted.many = many
    copies = complete.crossJoin(spark.range(50)).select(F.concat("service", F.col("id").cast("string")).alias("service"), "ds", "y")
    series = forecast_module.series_arrays(copies, 1).withColumn("future", F.col("days"))
    fitted = forecast_module.fit_series(series, {"own": counted}).collect()
    assert len(fitted) == 50 and all(r["error"] is None and r["fitted"] == r["y"] for r in fitted)
    assert sizes.value == 1


# --- the distributed pass ---------------------------------------------------


def test_all_zero_series(zeros):
    tables = forecast(zeros)
    best = reports.detail(tables, include_fitted=True)
    assert best.where(F.col("Prévision") != 0).count() == 0
    chosen = tables.selection.first()
    assert (chosen["score"], chosen["error"], chosen["model"]) == (1.0, None, "Prophet")


def test_constant_series_has_a_forecast(constant):
    tables = forecast(constant)
    arima = tables.forecasts.where("model = 'ARIMA' and kind = 'future'")
    assert arima.count() == 12
    assert arima.where("yhat <> 50").count() == 0


def test_outlier_series_has_a_forecast(outlier):
    tables = forecast(outlier)
    assert reports.detail(tables).count() == 12
    assert tables.metrics.where("error is not null").count() == 0


def test_short_series_is_an_error_row(short):
    tables = forecast(short)
    row = tables.selection.first()
    assert (row["model"], row["score"], row["error"]) == (None, 0.0, SHORT_HISTORY_ERROR)
    assert tables.forecasts.count() == 0 and tables.metrics.count() == 0
    assert reports.errors(tables).collect()[0]["error"] == SHORT_HISTORY_ERROR


def test_integration(complete):
    tables = forecast(complete, target_year=2025)
    row = tables.selection.first()
    assert 0 <= row["score"] <= 1 and row["model"] in MODELS and row["error"] is None
    future = tables.forecasts.where("kind = 'future'")
    assert future.count() == 3 * 12
    dates = [r["ds"] for r in future.where("model = 'ARIMA'").orderBy("ds").collect()]
    assert dates == month_ends("2024-01-31", 12)
    fitted = tables.forecasts.where("kind = 'fitted'")
    assert fitted.join(complete, ["service", "ds", "y"]).count() == 3 * 24


def test_horizon_is_honoured(complete):
    assert forecast(complete, horizon=5).forecasts.where("kind = 'future'").count() == 15
    assert caseload.demand_forecast(complete, 4).forecasts.where("kind = 'future'").count() == 12
    assert caseload.demand_forecast(complete.limit(0)) is None


def test_same_result_for_any_partitioning(spark, complete, outlier):
    df = complete.unionByName(outlier)
    results = []
    for partitions in ("1", "5"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            shuffled = df.repartition(int(partitions), "ds")
            rows = forecast(shuffled).forecasts.select("service", "model", "ds", "kind", "yhat").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        results.append(sorted(map(tuple, rows)))
    assert results[0] == results[1]


def test_failures_do_not_stop_other_models(complete):
    def broken(days, y, n, yy, future):
        raise RuntimeError("no luck")

    tables = forecast(complete, models={"Prophet": broken, "ARIMA": fits.arima})
    metrics = {r["model"]: r for r in tables.metrics.collect()}
    assert metrics["Prophet"]["error"] == "no luck"
    assert metrics["Prophet"]["score"] == 0.0 and metrics["Prophet"]["mae"] is None
    assert tables.selection.first()["model"] == "ARIMA"
    compared = {r["Modèle"]: r for r in reports.comparison(tables).collect()}
    assert compared["Prophet"]["Score Composite"] == 0.0
    shown = {r["Modèle"]: r for r in reports.comparison(tables, display=True).collect()}
    assert shown["Prophet"]["Score Composite"] == -math.inf
    assert shown["ARIMA"]["Sélectionné"] == "✅"
    nothing = forecast(complete, models={"Prophet": broken})
    assert nothing.selection.first()["error"] == NO_MODEL_ERROR


def test_rows_sharing_a_date_are_scored_one_by_one(spark, complete):
    doubled = complete.unionByName(complete.withColumn("y", F.col("y") + 10))
    tables = forecast(doubled)
    fitted = tables.forecasts.where("kind = 'fitted'").select("service", "model", "ds", "yhat")
    by_hand = with_score(evaluate(doubled.join(fitted, ["service", "ds"])))
    expected = {r["model"]: r for r in by_hand.collect()}
    for row in tables.metrics.collect():
        assert row["mae"] == pytest.approx(expected[row["model"]]["mae"])
        assert row["r2"] == pytest.approx(expected[row["model"]]["r2"])
        assert row["score"] == pytest.approx(expected[row["model"]]["score"])
    # 6 months with two rows each are 12 rows.
    assert forecast(doubled.where("ds < '2022-07-01'")).selection.first()["error"] is None


@pytest.mark.parametrize("most, share", [(1 << 20, 1e-4), (99, 0.2), (99, 1.0)])
def test_attach_by_broadcast_and_by_hot_keys(spark, monkeypatch, most, share):
    monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", most)
    monkeypatch.setattr(lookup, "HOT_SHARE", share)
    rows = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 7).alias("key"), "id"
    )
    values = rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum("id").alias("total"))
    found = sorted(map(tuple, lookup.attach(rows, values, ["key"], "rows").collect()))
    assert found == sorted(map(tuple, rows.join(values, "key").collect()))
    assert len(found) == 300


def test_trend_fit_is_the_best_one():
    """No nearby coefficients do better on the posterior the fit maximises."""
    rng = np.random.default_rng(0)
    t = np.linspace(0, 1, 60)
    x = np.column_stack([np.ones(60), t, *(np.maximum(t - k, 0) for k in (0.2, 0.4, 0.6))])
    y = 0.2 + 0.5 * t - 0.8 * np.maximum(t - 0.4, 0) + rng.normal(0, 0.02, 60)
    bends = np.array([False, False, True, True, True])
    precision = np.full(5, 1 / fits.TREND_SCALE**2)
    beta = fits._map_regression(x, y, np.ones(60), 0.0, precision, bends)
    variance = max(((y - x @ beta) ** 2).mean(), fits.NOISE_FLOOR**2)

    def loss(b):
        return (
            ((y - x @ b) ** 2).sum() / (2 * variance)
            + (b[~bends] ** 2 @ precision[~bends]) / 2
            + np.abs(b[bends]).sum() / fits.CHANGEPOINT_SCALE
        )

    best = loss(beta)
    for scale in (1e-1, 1e-2, 1e-3):
        assert min(loss(beta + rng.normal(0, scale, 5)) for _ in range(300)) > best - 1e-3


def test_arima_search_equals_a_fine_grid():
    rng = np.random.default_rng(8)
    w = rng.normal(0, 1, 60).cumsum() * 0.3 + rng.normal(0, 1, 60)
    phi, theta, e = fits._css(w, 1, 1)

    def sse(p, q):
        last_w = last_e = total = 0.0
        for v in w:
            last_e = v - p * last_w - q * last_e
            last_w = v
            total += last_e**2
        return total

    assert sse(phi[0], theta) == pytest.approx((e**2).sum())
    grid = [sse(p, q) for p in np.linspace(-0.98, 0.98, 99) for q in np.linspace(-0.98, 0.98, 99)]
    assert (e**2).sum() <= min(grid) * (1 + 1e-6)


def test_rows_that_cannot_be_fitted(spark, complete):
    """No date: not in the series. An infinite value: every model fails, visibly."""
    undated = spark.createDataFrame([("Nb Consultations", None, 5.0)], complete.schema)
    plain, more = forecast(complete), forecast(complete.unionByName(undated))
    assert sorted(map(tuple, more.forecasts.collect())) == sorted(map(tuple, plain.forecasts.collect()))
    endless = complete.withColumn("y", F.when(F.month("ds") == 3, float("inf")).otherwise(F.col("y")))
    tables = forecast(endless)
    assert tables.metrics.where("error is not null and score = 0").count() == 3
    assert tables.selection.first()["error"] == NO_MODEL_ERROR


def test_random_walk(complete):
    walk = random_walk(complete, horizon=2).orderBy("ds").collect()
    values = [r["y"] for r in complete.orderBy("ds").collect()]
    assert [r["yhat"] for r in walk] == [0.0, *values[:-1], values[-1], values[-1]]


PAIRS = [(0.0, 0.0), (10.0, 12.0), (-5.0, -4.0), (20.0, 15.0)]


def measured(spark, pairs):
    df = spark.createDataFrame([("s", "m", t, p) for t, p in pairs], "service string, model string, y double, yhat double")
    return evaluate(df).first()


def test_metrics(spark):
    m = measured(spark, PAIRS)
    assert m["mape"] == pytest.approx(16.250000001874998, abs=1e-12)
    assert m["smape"] == pytest.approx(17.243867243867246, abs=1e-12)
    assert m["mae"] == 2.0
    assert m["rmse"] == pytest.approx(2.7386127875258306, abs=1e-12)
    assert m["r2"] == pytest.approx(0.9186440677966101, abs=1e-12)
    assert measured(spark, [(3.0, 3.0), (3.0, 3.0)])["r2"] == 1.0
    assert measured(spark, [(3.0, 3.0), (3.0, 4.0)])["r2"] == 0.0
    assert measured(spark, [(3.0, 3.0)])["r2"] is None


def test_ties_go_to_the_model_registered_first(spark):
    rows = [("a", "ARIMA", 0.5), ("a", "RandomForest", 0.5), ("a", "Prophet", 0.4), ("b", "Own", 0.1), ("b", "ARIMA", 0.1)]
    df = spark.createDataFrame(rows, "service string, model string, score double").withColumn("error", F.lit(None).cast("string"))
    best = {r["service"]: r["model"] for r in selection.best_model(df).collect()}
    assert best == {"a": "RandomForest", "b": "ARIMA"}


def scored(spark, scores):
    rows = [(f"s{i}", "ARIMA", float(v), None) for i, v in enumerate(scores)]
    return spark.createDataFrame(rows, "service string, model string, score double, error string")


@pytest.mark.parametrize("scores", [[0.5], [0.1, 0.9], [0.0] * 50 + [1.0] * 49, np.random.default_rng(1).random(501), [0.3, 0.3, 0.7, 0.7]])
def test_ranks_and_exact_median(spark, scores):
    df = scored(spark, scores)
    stats = selection.score_stats(df).first()
    assert stats["median_score"] == pytest.approx(float(np.median(scores)), abs=1e-15)
    assert stats["mean_score"] == pytest.approx(float(np.mean(scores)))
    assert (stats["max_score"], stats["min_score"]) == (max(scores), min(scores))
    ranks = {r["service"]: r["rank"] for r in selection.rank_services(df).collect()}
    assert ranks == {f"s{i}": 1 + sum(o > v for o in scores) for i, v in enumerate(scores)}


# --- growth, indicators, screens --------------------------------------------


@pytest.mark.parametrize(
    "values, expected, mean",
    [
        ([100, 110, 121], [None, 0.1, 0.1], 10.0),
        ([0, 5, 0, 10], [None, math.inf, -1.0, math.inf], math.inf),
        ([0, 0, 5], [None, None, math.inf], math.inf),
    ],
)
def test_growth(make_series, values, expected, mean):
    df = make_series("x", "2023-01-31", values)
    found = [r["growth"] for r in series.growth(df).orderBy("ds").collect()]
    assert found == [None if e is None else pytest.approx(e) for e in expected]
    assert kpi.mean_growth(df).first()[0] == pytest.approx(mean)


def test_staffing_row(make_series):
    df = make_series("Nb Consultants", "2023-01-31", [3, 3]).unionByName(
        make_series("Nb Consultations", "2023-01-31", [2000, 1999])
    )
    row = kpi.staffing_kpis(df, cost=500).first()
    assert (row["recommended_consultants"], row["estimated_cost"]) == (4, 2000.0)
    assert row["coverage_percent"] == 100.0
    none = kpi.staffing_kpis(df.where("y < 10")).first()
    assert (none["recommended_consultants"], none["coverage_percent"]) == (0, 0.0)
    empty = kpi.staffing_kpis(df.limit(0)).first()
    assert empty["demand"] == 0.0


def test_disease_alert(make_series):
    df = make_series("Paludisme", "2023-01-31", [10, 10])
    assert kpi.disease_alert(df).first()["state"] == "ok"
    assert kpi.disease_alert(df, threshold=9).first()["state"] == "alert"
    assert kpi.disease_alert(df, "Absent").first()["state"] == "no data"


def test_fill_gaps(spark):
    rows = [("a", dt.date(2023, 1, 1), 10.0), ("a", dt.date(2023, 4, 1), 40.0), ("b", dt.date(2023, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "service string, ds date, y double")
    found = {s: [tuple(r)[1:3] for r in quality.fill_gaps(df, s).where("service = 'a'").orderBy("ds").collect()]
             for s in ("interpolate", "forward_fill", "drop")}
    assert [y for _, y in found["interpolate"]] == [10, 20, 30, 40]
    assert [y for _, y in found["forward_fill"]] == [10, 10, 10, 40]
    assert [d.month for d, _ in found["interpolate"]] == [1, 2, 3, 4]
    assert [y for _, y in found["drop"]] == [10, 40]
    with pytest.raises(ValueError):
        quality.fill_gaps(df, "guess")


def test_round_report(spark):
    df = spark.createDataFrame([("a", 0.12345, 1.5, True)], "Service string, R2 double, `Score Composite` double, accepted boolean")
    assert quality.round_report(df).first().asDict() == {"Service": "a", "R2": 0.12, "Score Composite": 1.5, "accepted": True}
    assert quality.round_report(df, metrics=False, validation=False).columns == ["Service", "Score Composite"]


def test_backtest_folds(complete):
    folds = backtest_splits(complete)
    sizes = {(r["fold"], r["role"]): r["count"] for r in folds.groupBy("fold", "role").count().collect()}
    assert sizes == {(1, "train"): 12, (1, "test"): 4, (2, "train"): 16, (2, "test"): 4, (3, "train"): 20, (3, "test"): 4}
    found = backtest(complete, folds=2)
    assert found.count() == 6
    assert {r["service"] for r in found.select("service").distinct().collect()} == {"Nb Consultations"}
    last = [r["y"] for r in complete.orderBy("ds").collect()]
    walk = backtest(complete, models={"last": lambda d, y, n, yy, f: fits.Fit(y, np.full(len(f), y[-1]), "")}, folds=1)
    expected = np.mean(np.abs(np.array(last[20:]) - last[19]))
    assert walk.first()["mae"] == pytest.approx(expected)


def test_many_series_in_one_pass(make_series):
    parts = [make_series(f"s{i}", "2022-01-31", [i + j % 5 for j in range(18)]) for i in range(6)]
    tables = forecast(reduce(lambda a, b: a.unionByName(b), parts), unique_dates=True)
    assert tables.selection.count() == 6
    assert reports.detail(tables).count() == 72
    assert reports.chart_series(tables).count() == 6 * (18 + 12)
    summary = reports.run_summary(tables).first()
    assert (summary["services_ok"], summary["services_total"]) == (6, 6)
    view = reports.history_and_forecast(tables, "ARIMA")
    assert view.where("`Historique` is null").count() == 72
    shown = {name: df.count() for name, df in caseload.dashboard(tables, "ARIMA").items()}
    assert shown == {
        "overview": 1, "volume": 6, "trend": 108, "models": 18, "forecasts": 72, "curves": 180,
        "errors": 0, "kpis": 1, "disease_alert": 1, "accepted": 6,
    }


def test_short_series_for_a_seasonal_difference_is_an_error():
    days, y = np.arange(20) * 30, np.arange(20.0) ** 2
    with pytest.raises(ValueError, match="seasonal difference"):
        fits.arima(days, y, np.ones(20), y * y, days[-1] + np.arange(1, 4) * 30, seasonal_difference=12)


def test_backtest_keeps_failures(complete):
    def broken(*_):
        raise ValueError("broken")

    found = backtest(complete, models={"ARIMA": fits.arima, "broken": broken}, folds=2).collect()
    assert {(r["model"], r["fold"]) for r in found} == {(m, f) for m in ("ARIMA", "broken") for f in (1, 2)}
    assert all(r["error"] == "broken" and r["score"] == 0 and r["mae"] is None for r in found if r["model"] == "broken")


def test_demand_forecast_follows_the_target_year(make_series):
    series = make_series("Paludisme", "2022-01-31", [50 + i % 7 for i in range(24)])
    ahead = lambda **k: caseload.demand_forecast(series, **k).forecasts.where("kind = 'future' and model = 'ARIMA'").count()
    assert (ahead(), ahead(target_year=2024), ahead(target_year=2025)) == (12, 1, 12)


def test_null_labels_are_kept(spark):
    rows = [(s, dt.date(2020, 1, d), float(d)) for s in (None, "A") for d in range(1, 21)] + [("B", dt.date(2020, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "service string, ds date, y double")
    enough, short = split_by_history(df)
    assert enough.count() == 40 and [r["service"] for r in short.collect()] == ["B"]
    assert flag_outliers(df).count() == 41


def test_shared_folder_needs_a_shared_place():
    class Context:
        master, applicationId = "spark://somewhere", "app"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session, "x")


def test_release_deletes_the_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("caseload.session._application_folder", lambda _: str(tmp_path))
    materialise(spark.range(3), "numbers")
    assert list(tmp_path.rglob("*.parquet"))
    release(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_ranks_of_crowded_and_unbounded_scores(spark):
    scores = [0.5 + k * 1e-9 for k in range(3000)] + [-4.0, 7.5, 7.5, 0.5]
    rows = [(f"s{k}", "ARIMA", float(v), None) for k, v in enumerate(scores)]
    table = spark.createDataFrame(rows, "service string, model string, score double, error string")
    expected = {f"s{k}": 1 + sum(o > v for o in scores) for k, v in enumerate(scores)}
    assert {r["service"]: r["rank"] for r in selection.rank_services(table).collect()} == expected
    stats = selection.score_stats(table).first()
    assert (stats["max_score"], stats["min_score"]) == (7.5, -4.0)
    assert stats["median_score"] == pytest.approx(float(np.median(scores)), abs=1e-12)


def test_history_of_a_null_label_is_attached(spark, complete):
    history = complete.withColumn("service", F.lit(None).cast("string"))
    chosen = spark.createDataFrame([(None, "ARIMA", 0.5, None)], "service string, model string, score double, error string")
    assert selection.successful(history, chosen).count() == history.count()
