"""DCL-16: seasonal ARIMA (1,1,1)(1,1,1,12) by two-stage regression, as DataFrame work.

Hannan-Rissanen in two regressions per series, both from Gram sums that Spark
combines map-side, so no series is ever collected into one value:

1. ``w = (1 - B)(1 - B^12) y``, the regular and seasonal difference; a long
   autoregression of ``w`` on its ``long_order`` previous months gives residuals
   ``e`` that stand for the unseen shocks.
2. ``w`` regressed on ``w`` and ``e`` at lags 1, 12 and 13: the coefficients at 1
   and 12 are phi and the seasonal phi (the one at 13 is their product's slot),
   those of ``e`` at 1 and 12 are theta and the seasonal theta.

Lags are calendar months (a frame of exactly k months back), so a missing month
leaves the rows that need it out instead of shifting the series. Both systems are
solved by Gauss-Jordan elimination over a flat array inside one ``aggregate``
expression; Gram matrices are symmetric and positive definite when the regressors
are not collinear, so no pivoting is needed. A zero pivot gives null coefficients.

Defined cases: values of one service and month are added up first; null values
are missing months; undated rows belong to no series, and a service without a dated value has no row; a series needs ``2 * long_order`` complete rows for the first
regression and ``4 * 6`` for the second, else its coefficients are null; a constant
or purely seasonal series has zero differences and null coefficients.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.functions.dates import month_index

SEASON = 12
LONG_ORDER = 13
NAMES = ("phi", "seasonal_phi", "phi_13", "theta", "seasonal_theta", "theta_13")


def at(column: str, k: int) -> Column:
    """The value of ``column`` exactly ``k`` months before, null if that month is absent."""
    frame = Window.partitionBy("service").orderBy("m").rangeBetween(-k, -k)
    return F.max(column).over(frame)


def solve(gram: list[list[Column]], right: list[Column]) -> Column:
    """Solution of ``gram x = right`` as an array, by Gauss-Jordan over the augmented rows."""
    n = len(right)
    width = n + 1
    flat = F.array(*[cell for i in range(n) for cell in (*gram[i], right[i])])

    def step(m: Column, k: Column) -> Column:
        pivot = F.element_at(m, k * width + k + 1)

        def cell(v: Column, idx: Column) -> Column:
            i, j = F.floor(idx / width).cast("int"), idx % width
            scaled = F.try_divide(F.element_at(m, k * width + j + 1), pivot)
            return F.when(i == k, F.try_divide(v, pivot)).otherwise(v - F.element_at(m, i * width + k + 1) * scaled)

        return F.transform(m, cell)

    reduced = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), flat, step)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(reduced, i * width + n + 1))


def _gram(xs: list[str], y: str, ok: Column) -> tuple[list[Column], list[list[Column]], list[Column]]:
    """Aggregates of a regression of ``y`` on ``xs`` over the rows where ``ok`` holds."""
    sums = [F.count(F.when(ok, F.lit(1))).alias("n")]
    for i, a in enumerate(xs):
        for b in xs[i:]:
            sums.append(F.sum(F.when(ok, F.col(a) * F.col(b))).alias(f"g_{a}_{b}"))
        sums.append(F.sum(F.when(ok, F.col(a) * F.col(y))).alias(f"g_{a}_{y}"))
    sums.append(F.sum(F.when(ok, F.col(y) * F.col(y))).alias(f"g_{y}_{y}"))
    gram = [[F.col(f"g_{min(a, b, key=xs.index)}_{max(a, b, key=xs.index)}") for b in xs] for a in xs]
    return sums, gram, [F.col(f"g_{a}_{y}") for a in xs]


def _complete(*names: str) -> Column:
    ok = F.lit(True)
    for name in names:
        ok = ok & F.col(name).isNotNull()
    return ok


def two_stage(df: DataFrame, season: int = SEASON, long_order: int = LONG_ORDER) -> DataFrame:
    """Per service: n_long, n_rows, the six coefficients of ``NAMES`` and sigma2."""
    dated = df.where(F.col("y").isNotNull() & F.col("ds").isNotNull())
    cells = dated.groupBy("service", month_index(F.col("ds")).alias("m")).agg(F.sum("y").alias("y"))
    w = F.col("y") - at("y", 1) - at("y", season) + at("y", season + 1)
    diffs = cells.select("service", "m", w.alias("w"))
    lags = [f"w{k}" for k in range(1, long_order + 1)]
    first = diffs.select("service", "m", "w", *[at("w", k).alias(name) for k, name in enumerate(lags, 1)])
    ok = _complete("w", *lags)
    sums, gram, right = _gram(lags, "w", ok)
    fitted = first.groupBy("service").agg(*sums).select(
        "service", F.col("n").alias("n_long"), F.when(F.col("n") >= 2 * long_order, solve(gram, right)).alias("alpha")
    )
    guess = F.lit(0.0)
    for i, name in enumerate(lags):
        guess = guess + F.col("alpha")[i] * F.col(name)
    shocks = first.join(fitted, "service").select("service", "m", "w", F.when(ok, F.col("w") - guess).alias("e"), "n_long")
    seasonal = (1, season, season + 1)
    regressors = [f"w{k}" for k in seasonal] + [f"e{k}" for k in seasonal]
    second = shocks.select(
        "service", "m", "w", "n_long", *[at("w", k).alias(f"w{k}") for k in seasonal], *[at("e", k).alias(f"e{k}") for k in seasonal]
    )
    sums, gram, right = _gram(regressors, "w", _complete("w", *regressors))
    stats = second.groupBy("service", "n_long").agg(*sums)
    beta = F.when(F.col("n") >= 4 * len(regressors), solve(gram, right))
    solved = stats.select("service", "n_long", F.col("n").alias("n_rows"), F.col("g_w_w").alias("ww"), beta.alias("beta"), F.array(*right).alias("b"))
    explained = F.aggregate(F.zip_with("beta", "b", lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    sigma2 = F.try_divide(F.col("ww") - explained, F.col("n_rows") - len(regressors))
    coefficients = [F.col("beta")[i].alias(name) for i, name in enumerate(NAMES)]
    return solved.select("service", "n_long", "n_rows", *coefficients, sigma2.alias("sigma2"))


HORIZON = 12


def _lag_polynomials(season: int) -> tuple[dict[int, list[tuple[int, str]]], dict[int, str]]:
    """The y-level AR coefficients as sums of signed terms, and the MA coefficients.

    (1 - phi B - Phi B^s - phi_13 B^(s+1)) times the two differences
    (1 - B)(1 - B^s); a coefficient a_k of y_t = sum a_k y_(t-k) + ... is minus the
    product's coefficient at k. Terms are listed in a fixed order, so that every
    engine adds them alike.
    """
    model = {0: (1, None), 1: (-1, "phi"), season: (-1, "seasonal_phi"), season + 1: (-1, "phi_13")}
    diff = {0: 1, 1: -1, season: -1, season + 1: 1}
    ar: dict[int, list[tuple[int, str]]] = {}
    for i, (sign, name) in model.items():
        for j, d in diff.items():
            if i + j:
                ar.setdefault(i + j, []).append((-sign * d, name))
    ma = {1: "theta", season: "seasonal_theta", season + 1: "theta_13"}
    return ar, ma


def _term(sign: int, name: str | None) -> Column:
    value = F.lit(1.0) if name is None else F.col(name)
    return value if sign > 0 else -value


def psi_bands(coefficients: DataFrame, level: float = 0.95, horizon: int = HORIZON, season: int = SEASON) -> DataFrame:
    """DCL-14 for DCL-16: per service and step k (1 to ``horizon``), psi_(k-1) and the
    half width z * sqrt(sigma2 * sum of psi_j^2 for j < k) of a forecast k months ahead.

    The psi weights of the integrated model follow the recurrence
    psi_0 = 1, psi_j = ma_j + sum over i of a_i psi_(j-i), run as one ``aggregate``
    over an array per series. Null coefficients give null weights and widths.
    """
    from statistics import NormalDist

    ar, ma = _lag_polynomials(season)
    order = max(ar)
    a = F.array(*[sum((_term(s, n) for s, n in ar.get(k, [])), F.lit(0.0)) if k in ar else F.lit(0.0) for k in range(1, order + 1)])
    m = F.array(*[F.col(ma[k]) if k in ma else F.lit(0.0) for k in range(1, horizon)] or [F.lit(0.0)])

    def step(acc: Column, j: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            return s + F.when(i <= j, F.element_at("a", i) * F.element_at(acc, j - i + 1)).otherwise(F.lit(0.0))

        return F.concat(acc, F.array(F.element_at("m", j) + F.aggregate(F.sequence(F.lit(1), F.lit(order)), F.lit(0.0), add)))

    # elements may be null: an array of non-null elements would turn a null weight into 0.0
    first = F.array(F.lit(1.0)).cast(T.ArrayType(T.DoubleType(), True))
    psi = F.aggregate(F.sequence(F.lit(1), F.lit(horizon - 1)), first, step) if horizon > 1 else first
    z = NormalDist().inv_cdf((1 + level) / 2)
    squares = F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda k: F.aggregate(F.slice("psi", 1, k), F.lit(0.0), lambda s, p: s + p * p),
    )
    weights = coefficients.select("service", "sigma2", a.alias("a"), m.alias("m")).select("service", "sigma2", psi.alias("psi"))
    rows = weights.select("service", "sigma2", F.posexplode(F.arrays_zip("psi", squares.alias("sq"))).alias("k", "w"))
    width = F.lit(z) * F.sqrt(F.col("sigma2") * F.col("w.sq"))
    return rows.select("service", (F.col("k") + 1).alias("step"), F.col("w.psi").alias("psi"), width.alias("half_width"))
