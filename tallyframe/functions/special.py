"""Distribution functions that Spark lacks, vectorised in numpy. No Spark in here.

One incomplete gamma and one incomplete beta function carry everything: chi-square and Poisson limits
come from the gamma quantile; t, F and binomial tails from the beta function.
"""

from __future__ import annotations

import math

import numpy as np

lgamma = np.vectorize(math.lgamma, otypes=[float])
EPS, TINY = 1e-16, 1e-300


def normal_cdf(x):
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x, float) / math.sqrt(2))


#: Coefficients of algorithm AS 70 (Odeh and Evans 1974), numerator and denominator, lowest power first.
AS70_P = (-0.322232431088, -1.0, -0.342242088547, -0.0204231210245, -0.453642210148e-4)
AS70_Q = (0.0993484626060, 0.588581570495, 0.531103462366, 0.103537752850, 0.38560700634e-2)


def probit(p: float) -> float:
    """Inverse of the normal distribution function by algorithm AS 70 (about 8 digits)."""
    if not 0 < p < 1:
        raise ValueError("p must be between 0 and 1")
    q = min(p, 1 - p)
    if q == 0.5:
        return 0.0
    y = math.sqrt(-2 * math.log(q))
    poly = lambda c: sum(a * y**i for i, a in enumerate(c))
    x = y + poly(AS70_P) / poly(AS70_Q)
    return -x if p < 0.5 else x


def _gamma_p_large(a, x):
    """Temme's uniform expansion with its first correction, for shapes so large that the error vanishes."""
    m = x / a - 1
    near = np.abs(m) < 0.1
    small = sum((-1) ** k * np.where(near, m, 0.0) ** k / k for k in range(2, 20))
    half = np.where(near, small, m - np.log1p(np.maximum(m, -1 + 1e-300)))
    eta = np.sign(m) * np.sqrt(2 * half)
    with np.errstate(all="ignore"):
        c = np.where(np.abs(eta) < 1e-3, -1 / 3 + eta / 12, 1 / m - 1 / eta)
    tail = np.exp(-a * half) / np.sqrt(2 * math.pi * a)
    return normal_cdf(eta * np.sqrt(a)) - c * tail


def gamma_p(a, x):
    """Regularised lower incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.where(x <= 0, 0.0, np.nan)
    live = (x > 0) & np.isfinite(x) & (a > 0)
    out = np.where(np.isinf(x) & (x > 0), 1.0, out)
    if (large := live & (a > 1e5)).any():
        out = out.copy()
        out[large] = _gamma_p_large(a[large], x[large])
        live = live & ~large
    series = live & (x < a + 1)
    if series.any():
        s, z = a[series], x[series]
        term = total = 1 / s
        n = s.copy()
        for _ in range(100_000):
            n = n + 1
            term = term * z / n
            total = total + term
            if (np.abs(term) < np.abs(total) * EPS).all():
                break
        out = out.copy()
        out[series] = total * np.exp(-z + s * np.log(z) - lgamma(s))
    cont = live & ~series
    if cont.any():
        s, z = a[cont], x[cont]
        b = z + 1 - s
        c, d = np.full_like(z, 1 / TINY), 1 / np.where(b == 0, TINY, b)
        h = d
        for i in range(1, 100_000):
            an = -i * (i - s)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            step = d * c
            h = h * step
            if (np.abs(step - 1) < 20 * EPS).all():
                break
        out = out.copy()
        out[cont] = 1 - h * np.exp(-z + s * np.log(z) - lgamma(s))
    return out


def gamma_quantile(p, a):
    """x with gamma_p(a, x) = p; 0 for p <= 0. Newton steps kept inside a shrinking bracket."""
    p, a = (np.array(v, float) for v in np.broadcast_arrays(np.asarray(p, float), np.asarray(a, float)))
    shape = p.shape
    p, a = p.ravel(), a.ravel()
    z = np.array([probit(min(max(v, 1e-12), 1 - 1e-12)) for v in p])
    x = np.maximum(a * (1 - 1 / (9 * a) + z / (3 * np.sqrt(a))) ** 3, 1e-8 * a)
    low, high = np.zeros_like(x), a + 40 * np.sqrt(a) + 60
    for _ in range(200):
        f = gamma_p(a, x) - p
        low, high = np.where(f < 0, x, low), np.where(f >= 0, x, high)
        density = np.exp(np.where(x > 0, (a - 1) * np.log(np.maximum(x, TINY)), 0) - x - lgamma(a))
        with np.errstate(all="ignore"):
            new = x - f / density
        new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
        done = np.abs(new - x) <= 1e-14 * np.maximum(new, 1e-300)
        x = new
        if done.all() or (high - low <= 1e-15 * high).all():
            break
    return np.where(p <= 0, 0.0, np.where(p >= 1, np.inf, x)).reshape(shape)


def chi2_quantile(p, k):
    return 2 * gamma_quantile(p, np.asarray(k, float) / 2)


def chi2_tail(x, k):
    """P(X > x) for k degrees of freedom."""
    return 1 - gamma_p(np.asarray(k, float) / 2, np.asarray(x, float) / 2)


def chi2_tail_1(x):
    """P(X > x) for one degree of freedom, accurate far in the tail."""
    return np.vectorize(math.erfc, otypes=[float])(np.sqrt(np.maximum(np.asarray(x, float), 0) / 2))


def beta_i(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    s, t, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (z > 0) & (z < 1)
    zz = np.where(inside, z, 0.5)
    front = np.exp(lgamma(s + t) - lgamma(s) - lgamma(t) + s * np.log(zz) + t * np.log1p(-zz)) / s
    c, d = np.ones_like(zz), 1 - (s + t) * zz / (s + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    h = d
    for m in range(1, 20_000):
        even = m * (t - m) * zz / ((s + 2 * m - 1) * (s + 2 * m))
        odd = -(s + m) * (s + t + m) * zz / ((s + 2 * m) * (s + 2 * m + 1))
        for k in (even, odd):
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            step = d * c
            h = h * step
        if (np.abs(step - 1) < 20 * EPS).all():
            break
    v = np.where(inside, front * h, np.where(z <= 0, 0.0, 1.0))
    return np.where(flip, 1 - v, v)


def beta_quantile(p, a, b):
    """x with beta_i(a, b, x) = p, by bisection to machine precision."""
    p, a, b = (np.array(v, float) for v in np.broadcast_arrays(p, a, b))
    low, high = np.zeros_like(p), np.ones_like(p)
    for _ in range(120):
        mid = (low + high) / 2
        below = beta_i(a, b, mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
        if (high - low <= 1e-16 * np.maximum(high, 1e-16)).all():
            break
    return (low + high) / 2


def t_quantile(p, df):
    """Quantile of Student's t; nan for df < 1."""
    p, df = (np.array(v, float) for v in np.broadcast_arrays(p, df))
    ok = df >= 1
    d = np.where(ok, df, 1.0)
    tail = 2 * np.minimum(p, 1 - p)
    x = beta_quantile(tail, d / 2, 0.5)
    with np.errstate(divide="ignore"):
        t = np.sqrt(d * (1 - x) / np.maximum(x, TINY))
    return np.where(ok, np.where(p < 0.5, -t, t), np.nan)


def binomial_cdf(k, n, p):
    """P(X <= k), k and n may be any real numbers (by the beta function)."""
    k = np.floor(np.asarray(k, float) + 1e-7)
    return np.where(k < 0, 0.0, np.where(k >= n, 1.0, beta_i(np.maximum(n - k, 1e-9), np.maximum(k + 1, 1e-9), 1 - np.asarray(p, float))))


def binomial_quantile(q, n, p):
    """The least whole k with P(X <= k) >= q."""
    q, n, p = (np.array(v, float) for v in np.broadcast_arrays(q, n, p))
    low, high = np.full_like(q, -1.0), np.floor(n)
    fuzz = q * (1 - 64 * 2.2e-16)
    while (high - low > 1).any():
        mid = np.floor((low + high) / 2)
        reach = binomial_cdf(mid, n, p) >= fuzz
        high, low = np.where(reach & (high - low > 1), mid, high), np.where(~reach & (high - low > 1), mid, low)
    return high
