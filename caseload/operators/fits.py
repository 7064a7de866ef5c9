"""Small numpy fits of monthly series, called inside Spark tasks.

Each fit takes ``(days, y, n, yy, future)``: day numbers of the distinct dates,
mean value, row count and sum of squared values per date, and the day numbers to
forecast. Least squares and tree splits on the dates see the same optimum through
these sums as through the rows, so rows sharing a date need not be kept apart.
Shipped to the workers by value: only constants may come from the rest of the package.

The three registered fits work on many series of equal length at once: their ``many``
takes matrices of one series per row and gives one :class:`Fit` per row. Every sum runs
within a series and in the same order, so no result depends on the other rows.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

import numpy as np

from caseload.functions.rules import ARIMA_ERROR, ARIMA_ORDERS


class Fit(NamedTuple):
    fitted: np.ndarray
    future: np.ndarray
    variant: str


def _alone(many, days, y, n, yy, future, **options) -> Fit:
    """One series as a matrix of one row."""
    found = many(days[None], y[None], n[None], yy[None], future[None], **options)[0]
    if isinstance(found, Exception):
        raise found
    return found


# --- additive trend and yearly seasonality ---------------------------------

CHANGEPOINTS, CHANGEPOINT_RANGE, CHANGEPOINT_SCALE = 25, 0.8, 0.05
SEASONAL_SCALE, TREND_SCALE, FOURIER_ORDER = 10.0, 5.0, 10
NOISE_FLOOR = 0.01  # of the largest value: keeps short series from being interpolated


def _fourier(days: np.ndarray) -> np.ndarray:
    angle = 2 * np.pi * ((days / 365.25)[..., None] * np.arange(1, FOURIER_ORDER + 1))
    return np.concatenate([np.sin(angle), np.cos(angle)], -1)


def _map_regression(x, y, n, within, precision, laplace):
    """MAP estimate under normal priors and, where ``laplace``, a double exponential.

    The double exponential is solved as a sequence of ridge problems; the noise
    variance is re-estimated in between. With fewer rows than columns each ridge problem
    is solved by rows: beta = P^-1 X' (X P^-1 X' + variance)^-1 y. Leading axes are series.
    """
    root = np.sqrt(n)
    rows, target = x * root[..., None], root * y
    total = n.sum(-1)
    variance = np.maximum((n * y**2).sum(-1) / total, NOISE_FLOOR**2)
    bends, size = rows[..., laplace], rows.shape[-2]
    penalty = np.broadcast_to(precision, (*y.shape[:-1], len(precision))).copy()
    by_rows = size < len(precision)
    if by_rows:
        base = (rows[..., ~laplace] / precision[~laplace]) @ rows[..., ~laplace].swapaxes(-1, -2)
    else:
        gram = rows.swapaxes(-1, -2) @ rows
        moment = (rows.swapaxes(-1, -2) @ target[..., None])[..., 0]
    for _ in range(20):
        if by_rows:
            cover = base + (bends / penalty[..., None, laplace]) @ bends.swapaxes(-1, -2)
            cover[..., np.arange(size), np.arange(size)] += variance[..., None]
            dual = np.linalg.solve(cover, target[..., None])
            apart = variance[..., None] * dual[..., 0]
            beta = (rows.swapaxes(-1, -2) @ dual)[..., 0] / penalty
        else:
            system = gram / variance[..., None, None]
            system[..., np.arange(len(precision)), np.arange(len(precision))] += penalty
            beta = np.linalg.solve(system, (moment / variance[..., None])[..., None])[..., 0]
            apart = target - (rows @ beta[..., None])[..., 0]
        variance = np.maximum(((apart**2).sum(-1) + within) / total, NOISE_FLOOR**2)
        slack = np.maximum(np.abs(beta[..., laplace]), 1e-5)
        penalty[..., laplace] = 1.0 / (CHANGEPOINT_SCALE * slack)
    return beta


def _trends(days, y, n, yy, future, multiplicative=False) -> list[Fit]:
    seasonal = days[:, -1] - days[:, 0] >= 730
    out = [None] * len(y)
    for yearly in (False, True):
        at = np.flatnonzero(seasonal == yearly)
        if len(at):
            found = _trend_group(days[at], y[at], n[at], yy[at], future[at], yearly, multiplicative)
            for i, fit in zip(at.tolist(), found, strict=True):
                out[i] = fit
    return out


def _trend_group(days, y, n, yy, future, seasonal, multiplicative):
    scale = np.abs(y).max(1, keepdims=True)
    first, span = days[:, :1], np.maximum(days[:, -1:] - days[:, :1], 1)
    target = y / scale
    within = np.maximum(yy.sum(1) - (n * y**2).sum(1), 0.0) / scale[:, 0] ** 2
    inside = int(days.shape[1] * CHANGEPOINT_RANGE)
    count = max(min(CHANGEPOINTS, inside - 1), 0)
    knots = (days[:, np.linspace(0, max(inside - 1, 0), count + 1).round().astype(int)][:, 1:] - first) / span

    def trend_terms(at):
        t = ((at - first) / span)[..., None]
        return np.concatenate([np.ones_like(t), t, np.maximum(t - knots[:, None], 0)], -1)

    trend_precision = np.r_[np.full(2, 1 / TREND_SCALE**2), np.full(count, 1 / CHANGEPOINT_SCALE**2)]
    season_precision = np.full(2 * FOURIER_ORDER, 1 / SEASONAL_SCALE**2)
    bends = np.r_[np.zeros(2, bool), np.ones(count, bool)]
    if seasonal and not multiplicative:
        def terms(at):
            return np.concatenate([trend_terms(at), _fourier(at)], -1)
        precision = np.r_[trend_precision, season_precision]
        bends = np.r_[bends, np.zeros(2 * FOURIER_ORDER, bool)]
    else:
        terms, precision = trend_terms, trend_precision

    def predict(x, beta):
        return (x @ beta[..., None])[..., 0]

    x = terms(days)
    beta = _map_regression(x, target, n, within, precision, bends)
    fitted, ahead = predict(x, beta), predict(terms(future), beta)
    if seasonal and multiplicative:
        usable = np.abs(fitted) > 1e-6
        ratio = np.where(usable, target / np.where(usable, fitted, 1.0), 1.0) - 1
        factor = _map_regression(
            _fourier(days), ratio, n * usable, np.zeros(len(y)), season_precision,
            np.zeros(2 * FOURIER_ORDER, bool),
        )
        fitted = fitted * (1 + predict(_fourier(days), factor))
        ahead = ahead * (1 + predict(_fourier(future), factor))
    kind = ("multiplicative" if multiplicative else "additive") if seasonal else "trend"
    return [Fit(f, a, kind) for f, a in zip(fitted * scale, ahead * scale, strict=True)]


def trend_seasonality(days, y, n, yy, future, multiplicative=False) -> Fit:
    """Piecewise-linear trend plus yearly Fourier terms (Taylor & Letham, 2018)."""
    return _alone(_trends, days, y, n, yy, future, multiplicative=multiplicative)


trend_seasonality.many = _trends


# --- bagged regression trees on (month, year) ------------------------------

TREES, SEED = 100, 42
FOREST_SERIES = 16  # series whose trees grow together: their tables stay near a core's cache
_DRAWS: dict[tuple, np.ndarray] = {}


def _bootstrap(counts: np.ndarray) -> np.ndarray:
    """Weights of cells with these row counts in each tree; equal counts share the draw."""
    key = (TREES, counts.tobytes())
    if key not in _DRAWS:
        if len(_DRAWS) >= 200:
            _DRAWS.clear()
        total = counts.sum()
        _DRAWS[key] = np.random.default_rng(SEED).multinomial(int(total), counts / total, TREES).T.astype(float)
    return _DRAWS[key]


def _forests(days, y, n, yy, future) -> list[Fit]:
    year = days.astype("M8[D]").astype("M8[Y]").astype(int)
    ordered = np.sort(year, 1)
    fresh = np.concatenate([np.ones((len(y), 1), bool), ordered[:, 1:] != ordered[:, :-1]], 1)
    years = fresh.sum(1)
    out = [None] * len(y)
    for count in np.unique(years).tolist():
        same = np.flatnonzero(years == count)
        for begin in range(0, len(same), FOREST_SERIES):
            at = same[begin : begin + FOREST_SERIES]
            names = ordered[at][fresh[at]].reshape(len(at), count)
            for i, fit in zip(at.tolist(), _forest_group(days[at], y[at], n[at], future[at], names), strict=True):
                out[i] = fit
    return out


def _forest_group(days, y, n, future, year_names) -> list[Fit]:
    series, years = year_names.shape
    cells, side = 12 * years, years + 1

    def place(at):
        """Month and year index; a tree can only cut between years it has seen."""
        dates = at.astype("M8[D]")
        year = (year_names[:, None, :] < dates.astype("M8[Y]").astype(int)[:, :, None]).sum(2)
        return dates.astype("M8[M]").astype(int) % 12, year.clip(0, years - 1)

    month, year = place(days)
    cell = (np.arange(series)[:, None] * cells + month * years + year).ravel()
    rows = np.bincount(cell, n.ravel(), series * cells).reshape(series, cells)
    # Scaled, so that no square of a sum can overflow.
    scale = np.abs(y).max(1)
    mean = np.bincount(cell, (n * (y / scale[:, None])).ravel(), series * cells).reshape(series, cells) / np.maximum(rows, 1)
    trees = series * TREES
    weight = np.zeros((cells, series, TREES))
    for i in range(series):
        # Empty cells take nothing of a draw, but for its rest, which falls to the last cell.
        used = np.flatnonzero(np.append(rows[i, :-1] > 0, True))
        weight[used, i] = _bootstrap(rows[i, used])

    def running_sums(grid):
        table = np.zeros((13, side, trees), grid.dtype)
        table[1:, 1:] = grid.reshape(12, years, trees)
        for m in range(1, 13):
            table[m] += table[m - 1]
        for a in range(1, side):
            table[:, a] += table[:, a - 1]
        return table

    # Running sums over months and years of weight and weighted value, as the two parts of a
    # number, and of filled cells.
    pairs = np.empty(weight.shape, complex)
    pairs.real = weight
    np.multiply(weight, mean.T[:, :, None], out=pairs.imag)
    by_month, filled = running_sums(pairs), running_sums((weight > 0).astype(np.int32))
    w, s, c = by_month[12, years].real.copy(), by_month[12, years].imag.copy(), filled[12, years]
    by_year = np.ascontiguousarray(by_month.swapaxes(0, 1)).reshape(side, -1)
    by_month, sums, filled = by_month.reshape(13, -1), by_month.ravel(), filled.ravel()
    order = np.arange(13 + side, 0, -1, dtype=np.int16)[:, None]
    node = np.array([np.arange(trees), *np.broadcast_to([[0], [12], [0], [years]], (4, trees))])
    corners, values = [], []

    def add_leaves(tree, m0, m1, a0, a1):
        """A leaf's mean, at the corners of its box: running sums over them spread it out."""
        top, bottom = m1 * side, m0 * side
        total = sums.take((top + a1) * trees + tree) - sums.take((top + a0) * trees + tree)
        total = total - sums.take((bottom + a1) * trees + tree) + sums.take((bottom + a0) * trees + tree)
        value = total.imag / total.real
        base = tree // TREES * (13 * side)
        corners.extend([base + bottom + a0, base + top + a0, base + bottom + a1, base + top + a1])
        values.extend([value, -value, -value, value])

    while True:
        leaf, inner = np.flatnonzero(c < 2), np.flatnonzero(c > 1)
        add_leaves(*node.take(leaf, 1))
        if not len(inner):
            break
        node, w, s, c = node.take(inner, 1), w.take(inner), s.take(inner), c.take(inner)
        tree, m0, m1, a0, a1 = node
        # Sums before every cut, months first; at the ends and outside of a node's own range
        # one side has no positive weight, so those cuts drop out by themselves.
        size, at = len(tree), np.arange(len(tree))
        left_w, left_s = np.empty((2, 13 + side, size))
        for table, at_cuts, low, high, start in (
            (by_month, slice(0, 13), a0 * trees + tree, a1 * trees + tree, m0),
            (by_year, slice(13, None), m0 * trees + tree, m1 * trees + tree, a0),
        ):
            strip = table.take(high, 1)
            strip -= table.take(low, 1)
            first = strip.ravel().take(start * size + at)
            np.subtract(strip.real, first.real, out=left_w[at_cuts])
            np.subtract(strip.imag, first.imag, out=left_s[at_cuts])
        # Between-part variance, 0 where a side is empty; weights are whole numbers.
        both = w - left_w
        both *= left_w
        cut = both > 0.5
        np.maximum(both, 0.5, out=both)
        gain = left_s * w
        gain -= left_w * s
        gain *= gain
        gain /= both
        gain *= cut
        # The first of equally good cuts, whatever the rounding of their sums.
        cut &= gain >= gain.max(0) * (1 - 1e-9)
        best = 13 + side - (cut * order).max(0).astype(np.intp)
        on_month = best < 13
        cut_m, cut_a = np.where(on_month, best, m1), np.where(on_month, a1, best - 13)
        flat = best * size + at
        lw, ls = left_w.ravel().take(flat), left_s.ravel().take(flat)
        top, bottom = cut_m * side, m0 * side
        lc = filled.take((top + cut_a) * trees + tree) - filled.take((bottom + cut_a) * trees + tree)
        lc -= filled.take((top + a0) * trees + tree) - filled.take((bottom + a0) * trees + tree)
        left = np.array([tree, m0, cut_m, a0, cut_a])
        right = np.array([tree, np.where(on_month, best, m0), m1, np.where(on_month, a0, best - 13), a1])
        node = np.concatenate([left, right], 1)
        w, s, c = (np.concatenate([x, y - x]) for x, y in ((lw, w), (ls, s), (lc, c)))

    surface = np.bincount(np.concatenate(corners), np.concatenate(values), series * 13 * side)
    surface = surface.reshape(series, 13, side).cumsum(1).cumsum(2) / TREES * scale[:, None, None]
    which = np.arange(series)[:, None]
    low, high = y.min(1, keepdims=True), y.max(1, keepdims=True)
    fitted, ahead = (surface[(which, *place(at))].clip(low, high) for at in (days, future))
    return [Fit(f, a, "bagged") for f, a in zip(fitted, ahead, strict=True)]


def calendar_forest(days, y, n, yy, future) -> Fit:
    """Random forest on month and year.

    With two integer features every tree node is a box of a month x year grid, so
    all trees of several series grow together, level by level, on summed-area tables
    of their bootstrap weights.
    """
    return _alone(_forests, days, y, n, yy, future)


calendar_forest.many = _forests


# --- ARIMA by conditional least squares ------------------------------------

ARIMA_SERIES = 64  # series whose search grids are filtered together


def _innovations(w, p, thetas):
    """MA-filtered copies of w (series, time) and its first p lags: (lag, time, series, theta)."""
    series, size = w.shape
    lagged = np.zeros((p + 1, size, series, 1))
    for j in range(p + 1):
        lagged[j, j:, :, 0] = w.T[: size - j]
    out = np.empty((p + 1, size, series, thetas.shape[1]))
    state = np.zeros((p + 1, series, thetas.shape[1]))
    for t in range(size):
        state = np.subtract(lagged[:, t], thetas * state, out=out[:, t])
    return out


def _over_time(x):
    """Sum along the first axis, always one step after the other."""
    total = x[0].copy()
    for part in x[1:]:
        total += part
    return total


def _ar_given_theta(u, p):
    """AR coefficients (closed form) and residuals for every series and theta."""
    if p == 0:
        return np.zeros((0, *u.shape[2:])), u[0]
    moment = [_over_time(u[1 + i] * u[0]) for i in range(p)]
    gram = {(i, j): _over_time(u[1 + i] * u[1 + j]) for i in range(p) for j in range(i, p)}
    if p == 1:
        phi = (moment[0] / (gram[0, 0] + 1e-12)).clip(-0.99, 0.99)[None]
    else:
        system = np.array([[gram[min(i, j), max(i, j)] for j in range(p)] for i in range(p)]).transpose(2, 3, 0, 1)
        solved = np.linalg.solve(system + 1e-12 * np.eye(p), np.array(moment).transpose(1, 2, 0)[..., None])
        phi = solved[..., 0].transpose(2, 0, 1)
    e = u[0].copy()
    e -= sum(phi[j] * u[1 + j] for j in range(p))
    return phi, e


def _css_many(w, p, q):
    """Best (phi, theta, residuals) of an ARMA(p, q) without constant per row, and whether there is one."""
    if w.shape[1] < p + q + 2:
        raise ValueError("too few differences")
    which, step = np.arange(len(w)), 0.05
    thetas = np.broadcast_to(np.linspace(-0.95, 0.95, 39) if q else np.zeros(1), (len(w), 39 if q else 1))
    found = np.ones(len(w), bool)
    for _ in range(3 if q else 1):
        phi, e = _ar_given_theta(_innovations(w, p, thetas), p)
        sse = _over_time(e**2)
        if p == 2:
            stable = (np.abs(phi[1]) < 1) & (phi[0] + phi[1] < 1) & (phi[1] - phi[0] < 1)
            sse = np.where(stable, sse, np.inf)
        best = sse.argmin(1)
        found &= np.isfinite(sse[which, best])
        result = phi[:, which, best], thetas[which, best], e[:, which, best]
        thetas = np.clip(thetas[which, best][:, None] + np.linspace(-step, step, 21), -0.99, 0.99)
        step /= 10
    return *result, found


def _css(w, p, q):
    """:func:`_css_many` of one series."""
    phi, theta, e, found = _css_many(w[None], p, q)
    if not found[0]:
        raise ValueError("no stationary solution")
    return phi[:, 0], theta[0], e[:, 0]


def _arima_orders(y, horizon, order):
    """Fit one (p, 1, q) order per row; the first fitted value has no past and is 0."""
    p, _, q = order
    w = np.diff(y)
    phi, theta, e, found = _css_many(w, p, q)
    past, shock, ahead = [w[:, -1 - j] for j in range(p)], theta * e[-1], np.empty((len(y), horizon))
    for k in range(horizon):
        ahead[:, k] = sum(c * v for c, v in zip(phi, past, strict=True)) + shock
        past, shock = [ahead[:, k], *past[:-1]][:p], 0.0
    fitted = np.concatenate([np.zeros((len(y), 1)), y[:, 1:] - e.T], 1)
    return fitted, y[:, -1:] + np.cumsum(ahead, 1), found


def _arima_order(y, horizon, order):
    """:func:`_arima_orders` of one series."""
    fitted, ahead, found = _arima_orders(y[None], horizon, order)
    if not found[0]:
        raise ValueError("no stationary solution")
    return fitted[0], ahead[0]


def _arimas(days, y, n, yy, future, seasonal_difference=0) -> list[Fit | Exception]:
    lag, size, horizon = seasonal_difference, y.shape[1], future.shape[1]
    if lag and size - 12 <= lag:
        raise ValueError(f"a seasonal difference of {lag} needs more than {lag + 12} dates")
    out: list = [None] * len(y)
    for begin in range(0, len(y), ARIMA_SERIES):
        left = np.arange(begin, min(begin + ARIMA_SERIES, len(y)))
        for order in ARIMA_ORDERS:
            if not len(left):
                break
            part = y[left]
            z = part[:, lag:] - part[:, : size - lag] if lag else part
            try:
                fitted, ahead, found = _arima_orders(z, horizon, order)
            except ValueError:
                continue
            except np.linalg.LinAlgError:  # of one series: each by itself
                fitted, ahead, found = np.zeros(z.shape), np.zeros((len(z), horizon)), np.zeros(len(z), bool)
                for i in range(len(z)):
                    try:
                        fitted[i : i + 1], ahead[i : i + 1], found[i : i + 1] = _arima_orders(z[i : i + 1], horizon, order)
                    except np.linalg.LinAlgError:
                        pass
            found &= np.isfinite(fitted).all(1) & np.isfinite(ahead).all(1)
            if lag:
                values = np.concatenate([part, ahead], 1)
                for k in range(horizon):
                    values[:, size + k] += values[:, size + k - lag]
                ahead = values[:, size:]
                # Before the first seasonal difference: the previous value.
                start = np.concatenate([np.zeros((len(z), 1)), part[:, :-1]], 1)[:, : lag + 1]
                fitted = np.concatenate([start, (fitted + part[:, : z.shape[1]])[:, 1:]], 1)
            name = ",".join(map(str, order)) + (f"+s{lag}" if lag else "")
            for i in np.flatnonzero(found).tolist():
                out[left[i]] = Fit(fitted[i], ahead[i], name)
            left = left[~found]
        for i in left.tolist():
            out[i] = ValueError(ARIMA_ERROR)
    return out


def arima(days, y, n, yy, future, seasonal_difference=0) -> Fit:
    """First order of the try-list that can be fitted, on the values in date order.

    A series too short for the seasonal difference is an error, never another model.
    """
    return _alone(_arimas, days, y, n, yy, future, seasonal_difference=seasonal_difference)


arima.many = _arimas


REGISTRY = {"Prophet": trend_seasonality, "RandomForest": calendar_forest, "ARIMA": arima}


def fit_one(fit, days, y, n, yy, future) -> Fit:
    """Run one fit; a constant series needs none, an endless value gets none."""
    found = fit_many(fit, days[None], y[None], n[None], yy[None], future[None])[0]
    if isinstance(found, Exception):
        raise found
    return found


def fit_many(fit, days, y, n, yy, future) -> list[Fit | Exception]:
    """Fit series of equal length, one per row; what a series fails on takes its place."""
    known, options = (fit.func, fit.keywords) if isinstance(fit, partial) and not fit.args else (fit, {})
    many = getattr(known, "many", None)

    def attempt(at):
        try:
            if many is not None:
                return many(days[at], y[at], n[at], yy[at], future[at], **options)
            return [fit(days[i], y[i], n[i], yy[i], future[i]) for i in at]
        except Exception as problem:  # of one series: each by itself
            return [problem] if len(at) == 1 else [attempt(at[i : i + 1])[0] for i in range(len(at))]

    finite = np.isfinite(y).all(1)
    constant = finite & (y.min(1) == y.max(1))
    out: list = [ValueError("the values are not finite")] * len(y)
    for i in np.flatnonzero(constant).tolist():
        out[i] = Fit(np.full(y.shape[1], y[i, 0]), np.full(future.shape[1], y[i, 0]), "constant")
    rest = np.flatnonzero(finite & ~constant)
    if len(rest):
        for i, found in zip(rest.tolist(), attempt(rest), strict=True):
            if not isinstance(found, Exception) and not (np.isfinite(found.fitted).all() and np.isfinite(found.future).all()):
                found = ValueError("the fit is not finite")
            out[i] = found
    return out
