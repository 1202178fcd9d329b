"""Confidence limits of proportions, rates, counts and means.

Every closed formula is written once over a small set of operations and runs either on numpy arrays or
as a Column expression inside the plan. The exact methods need inverse distribution functions; they run
as vectorised UDFs, which should meet summary rows only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from tallyframe.functions import special as sp


class _Numpy:
    sqrt, log, exp, low, high = staticmethod(np.sqrt), staticmethod(np.log), staticmethod(np.exp), staticmethod(np.minimum), staticmethod(np.maximum)

    @staticmethod
    def pick(cond: Any, a: Any, b: Any) -> Any:
        return np.where(cond, a, b)


class _Columns:
    sqrt, log, exp = staticmethod(F.sqrt), staticmethod(F.ln), staticmethod(F.exp)
    low, high = staticmethod(lambda a, b: F.least(a, F.lit(b))), staticmethod(lambda a, b: F.greatest(a, F.lit(b)))

    @staticmethod
    def pick(cond: Column, a: Any, b: Any) -> Column:
        return F.when(cond, a).otherwise(b)


def alpha_of(conflev: float) -> float:
    if not 0.5 <= conflev < 1:
        raise ValueError("the confidence level must be at least 0.5 and less than 1")
    return 1 - conflev


def _z(conflev: float) -> float:
    return abs(sp.probit(alpha_of(conflev) / 2))


# -- proportions: x of n
def _wald(x, n, conflev, o):
    p = x / n
    half = o.sqrt(p * (1 - p) / n) * _z(conflev)
    return p - half, p + half


def _modwald(x, n, conflev, o):
    """Agresti and Coull 1998: Wald about the estimate with z^2 / 2 successes and failures added."""
    return _wald(x + _z(conflev) ** 2 / 2, n + _z(conflev) ** 2, conflev, o)


def _wilson(x, n, conflev, o):
    z2 = _z(conflev) ** 2
    p = x / n
    mid, half = (p + z2 / (n * 2)) / (1 + z2 / n), o.sqrt((p * (1 - p) + z2 / (n * 4)) / n) * _z(conflev) / (1 + z2 / n)
    return mid - half, mid + half


def _fleiss(x, n, conflev, o):
    """Fleiss 1981: the score interval with continuity correction."""
    z, p = _z(conflev), x / n
    z2 = z * z
    side = lambda s: (x * 2 + z2 + s + o.sqrt(o.high(z2 - s * -2 - 1 / n + p * 4 * (n * (1 - p) - s), 0.0)) * (s * z)) / ((n + z2) * 2)
    return o.pick(x == 0, 0.0, side(-1)), o.pick(x == n, 1.0, side(1))


def _geigy(x, n, conflev, o):
    """Fixed formula of the Geigy Scientific Tables, vol. 2: a limit is a root p of square p^2 - linear p + constant = 0.

    The lower limit is the smaller root at r = x, the upper the greater one at r = x + 1. With u the normal value,
    square = u^4 / 18 + u^2 (2 n + 1) / 6 + (n + 1/3)^2,
    linear = u^4 / 18 + u^2 (4 (n - r) + 3) / 6 + 2 (r (3 n + 1) - n) / 3 - 2/9 and
    constant = u^4 / 18 - u^2 (2 r - 1) / 6 + (r - 1/3)^2. None of n and all of n have limits of their own.
    """
    tail = alpha_of(conflev) / 2
    u2 = sp.probit(1 - tail) ** 2
    square = u2 * u2 / 18 + u2 * (n * 2 + 1) / 6 + (n + 1 / 3) ** 2

    def roots(r):
        linear = u2 * u2 / 18 + u2 * ((n - r) * 4 + 3) / 6 + (r * (n * 3 + 1) - n) * 2 / 3 - 2 / 9
        constant = u2 * u2 / 18 - u2 * (r * 2 - 1) / 6 + (r - 1 / 3) ** 2
        spread = o.sqrt(o.high(linear**2 - square * constant * 4, 0.0))
        return (linear - spread) / (square * 2), (linear + spread) / (square * 2)

    all_but = o.exp(math.log(tail) / n)
    low = o.pick(x == 0, 0.0, o.pick(x == n, all_but, roots(x)[0]))
    return low, o.pick(x == n, 1.0, o.pick(x == 0, 1 - all_but, roots(x + 1)[1]))


def _exact(x, n, conflev, o):
    """Clopper and Pearson, by beta quantiles."""
    a2 = alpha_of(conflev) / 2
    low = np.where(x > 0, sp.beta_quantile(a2, np.maximum(x, 1e-9), n - x + 1), 0.0)
    return low, np.where(x < n, sp.beta_quantile(1 - a2, x + 1, np.maximum(n - x, 1e-9)), 1.0)


def _acceptability(x, n, p):
    """Blaker 2000: the probability of a tail as unlikely as the observed one, both sides together."""
    up, down = 1 - sp.binomial_cdf(x - 1, n, p), sp.binomial_cdf(x, n, p)
    a = up + sp.binomial_cdf(sp.binomial_quantile(up, n, p) - 1, n, p)
    b = down + 1 - sp.binomial_cdf(sp.binomial_quantile(1 - down, n, p), n, p)
    return np.minimum(a, b)


def _blaker(x, n, conflev, o, step: float = 1e-5):
    """From the Clopper-Pearson limits inwards on a grid, to the last point that is not acceptable."""
    alpha = alpha_of(conflev)
    low, high = (np.array(v, float) for v in _exact(x, n, conflev, o))
    x, n = np.broadcast_arrays(np.asarray(x, float), np.asarray(n, float))
    for i in np.ndindex(low.shape):
        if x[i] != np.floor(x[i]) or n[i] != np.floor(n[i]):
            continue  # the binomial distribution is not defined: the exact limits stand
        for limit, sign, needed in ((low, 1, x[i] > 0), (high, -1, x[i] < n[i])):
            at = limit[i]
            while needed:
                grid = at + sign * step * np.arange(1, 257)
                grid = grid[(grid > 0) & (grid < 1)]
                stop = np.flatnonzero(_acceptability(x[i], n[i], grid) >= alpha)
                at += sign * step * (int(stop[0]) if len(stop) else len(grid))
                if len(stop) or not len(grid):
                    break
            limit[i] = at
    return low, high


PROPORTION = {"wald": _wald, "modwald": _modwald, "wilsonscore": _wilson, "fleissquadratic": _fleiss, "geigy": _geigy}
PROPORTION_EXACT = {"exact": _exact, "blaker": _blaker}


# -- rates: x events in n, per base
def _rate_rg(x, n, conflev, o):
    """Rothman and Greenland 1998: normal limits of the logarithm."""
    f = o.exp(_z(conflev) / o.sqrt(x))
    return x / n / f, x / n * f


def _rate_normal(x, n, conflev, o):
    half = o.sqrt(x) / n * _z(conflev)
    return o.high(x / n - half, 0.0), x / n + half


def _count_byar(x, conflev, o):
    z = _z(conflev)
    cube = lambda m, s: m * (1 - 1 / (m * 9) + s * z / 3 / o.sqrt(m)) ** 3
    safe = o.pick(x > 0, x, 1.0)
    return o.pick(x > 0, o.high(cube(safe, -1), 0.0), 0.0), cube(x + 1, 1)


def _count_daly(x, conflev, o=None):
    """Exact Poisson limits by gamma quantiles; -ln(alpha / 2) above for no events."""
    a2 = alpha_of(conflev) / 2
    x = np.asarray(x, float)
    low = np.where(x > 0, sp.gamma_quantile(a2, np.maximum(x, 1e-9)), 0.0)
    return low, np.where(x > 0, sp.gamma_quantile(1 - a2, x + 1), -math.log(a2))


def _check(name: str, methods: Any) -> None:
    if name not in methods:
        raise ValueError(f"method must be one of {', '.join(methods)}, not {name!r}")


def propcl(num: float, den: float, conflev: float = 0.95, method: str = "blaker", noninteger: str = "reject") -> tuple[float, float, float]:
    """(proportion, lower, upper). noninteger: reject, accept, round or truncate fractions."""
    _check(method, {**PROPORTION, **PROPORTION_EXACT})
    _check(noninteger, ("reject", "accept", "round", "truncate"))
    alpha_of(conflev)
    if num < 0 or den <= 0 or num > den:
        raise ValueError("the numerator must be from 0 to the denominator, which must be positive")
    if num != int(num) or den != int(den):
        if noninteger == "reject":
            raise ValueError("numerator and denominator must be whole numbers")
        if noninteger != "accept":
            num, den = (math.floor(v + 0.5) if noninteger == "round" else int(v) for v in (num, den))
    x, n = np.float64(num), np.float64(den)
    low, high = {**PROPORTION, **PROPORTION_EXACT}[method](x, n, conflev, _Numpy)
    return float(x / n), float(max(low, 0.0)), float(min(high, 1.0))


def ratecl(num: float, den: float, conflev: float = 0.95, basepop: float = 100_000, method: str = "daly") -> tuple[float, float, float]:
    """(rate, lower, upper) per basepop."""
    _check(method, ("rg", "byar", "normal", "daly"))
    if num < 0 or den <= 0 or num != int(num) or den != int(den) or basepop <= 0:
        raise ValueError("the numerator must be a whole number from 0, denominator and base positive")
    x, n = np.float64(num), np.float64(den)
    if method in ("rg", "normal"):
        low, high = (_rate_rg if method == "rg" else _rate_normal)(x, n, conflev, _Numpy)
    else:
        low, high = (v / n for v in (_count_byar if method == "byar" else _count_daly)(x, conflev, _Numpy))
    return float(x / n * basepop), float(max(low, 0.0) * basepop), float(high * basepop)


def freqcl(num: float, conflev: float = 0.95, method: str = "daly") -> tuple[float, float, float]:
    """(count, lower, upper) under the Poisson distribution."""
    _check(method, ("byar", "daly"))
    if num < 0 or num != int(num):
        raise ValueError("the count must be a whole number from 0")
    low, high = (_count_byar if method == "byar" else _count_daly)(np.float64(num), conflev, _Numpy)
    return float(num), float(low), float(high)


def _exact_udf(function: Any) -> Any:
    """A vectorised UDF of (x, n) giving a struct of limits; null where x or n is null or no count."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, n in parts:
            ok = x.notna() & n.notna() & (n > 0) & (x >= 0)
            low, high = np.full(len(x), np.nan), np.full(len(x), np.nan)
            if ok.any():
                low[ok], high[ok] = function(x[ok].to_numpy(float), n[ok].to_numpy(float))
            yield pd.DataFrame({"lower": pd.Series(low).where(ok.to_numpy()), "upper": pd.Series(high).where(ok.to_numpy())})

    return F.pandas_udf(run, "lower double, upper double")


def proportion_limits(num: Column, den: Column, conflev: float = 0.95, method: str = "blaker") -> Column:
    """Struct (lower, upper) in [0, 1]; null where the denominator is not positive."""
    _check(method, {**PROPORTION, **PROPORTION_EXACT})
    x, n = num.cast("double"), F.when(den > 0, den.cast("double"))
    if method in PROPORTION:
        low, high = PROPORTION[method](x, n, conflev, _Columns)
        return F.struct(F.when(n.isNotNull(), F.greatest(low, F.lit(0.0))).alias("lower"), F.when(n.isNotNull(), F.least(high, F.lit(1.0))).alias("upper"))
    exact = PROPORTION_EXACT[method]
    return _exact_udf(lambda x, n: exact(x, n, conflev, _Numpy))(x, n)


def rate_limits(num: Column, den: Column, conflev: float = 0.95, basepop: float = 100_000, method: str = "daly") -> Column:
    """Struct (lower, upper) of the rate per basepop; null where the denominator is not positive."""
    _check(method, ("rg", "byar", "normal", "daly"))
    x, n = num.cast("double"), F.when(den > 0, den.cast("double"))
    if method == "daly":
        return _exact_udf(lambda x, n: tuple(v / n * basepop for v in _count_daly(x, conflev)))(x, n)
    if method == "byar":
        low, high = (v / n for v in _count_byar(x, conflev, _Columns))
    else:
        x = F.when(x > 0, x) if method == "rg" else x
        low, high = (_rate_rg if method == "rg" else _rate_normal)(x, n, conflev, _Columns)
    return F.struct((F.greatest(low, F.lit(0.0)) * basepop).alias("lower"), (high * basepop).alias("upper"))


def count_limits(num: Column, conflev: float = 0.95, method: str = "daly") -> Column:
    """Struct (lower, upper) of a Poisson count."""
    _check(method, ("byar", "daly"))
    x = num.cast("double")
    if method == "daly":
        return _exact_udf(lambda x, n: _count_daly(x, conflev))(x, F.lit(1.0))
    low, high = _count_byar(x, conflev, _Columns)
    return F.struct(F.when(x.isNotNull(), low).alias("lower"), high.alias("upper"))


def t_quantile(df: Column, conflev: float = 0.95) -> Column:
    """The two-sided t value for each number of degrees of freedom; null below 1."""
    p = 1 - alpha_of(conflev) / 2

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for d in parts:
            seen = {v: float(sp.t_quantile(p, v)) for v in d.dropna().unique() if v >= 1}
            yield d.map(seen)

    return F.pandas_udf(run, "double")(df.cast("double"))


def chi2_p(x: Column, df: int = 1) -> Column:
    """P(X > x)."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in parts:
            ok = v.notna() & (v >= 0)
            out = pd.Series(np.nan, index=v.index)
            if ok.any():
                out[ok] = sp.chi2_tail_1(v[ok].to_numpy()) if df == 1 else sp.chi2_tail(v[ok].to_numpy(), df)
            yield out.where(ok)

    return F.pandas_udf(run, "double")(x.cast("double"))


def probit_column(p: Column) -> Column:
    """Algorithm AS 70 as a plain expression; null outside (0, 1)."""
    q = F.least(p, 1 - p)
    y = F.sqrt(F.ln(F.when(q > 0, q)) * -2)

    def poly(c: tuple[float, ...]) -> Column:
        out = F.lit(c[-1])
        for a in reversed(c[:-1]):
            out = out * y + a
        return out

    x = y + poly(sp.AS70_P) / poly(sp.AS70_Q)
    return F.when(p == 0.5, F.lit(0.0)).when(p < 0.5, -x).otherwise(x)


def normal_cdf_column(x: Column) -> Column:
    """The normal distribution function, vectorised."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in parts:
            yield pd.Series(sp.normal_cdf(v.to_numpy(float)), index=v.index).where(v.notna())

    return F.pandas_udf(run, "double")(x.cast("double"))
