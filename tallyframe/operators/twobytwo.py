"""Measures of association in 2x2xk tables.

A stratum is a row with the counts a (exposed, diseased), b (unexposed, diseased), c (exposed, not
diseased) and d (unexposed, not diseased). Closed measures are column expressions over such rows, null
where undefined; adjusted ones are sums over the strata of a group, so everything up to there is one
aggregation. Exact measures weigh the possible tables with fixed margins; they run vectorised on the few
resulting rows. Only tables within 40 standard deviations of the likeliest have a weight that a double can
hold, so the work grows with the root of the counts, and there is no count that is too large.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import special as sp
from tallyframe.functions.intervals import alpha_of, chi2_p, proportion_limits


def strata_from_rows(df: DataFrame, exposed: Column, diseased: Column, by: list[str], weight: Column | None = None) -> DataFrame:
    """Count rows (or sum weights) into strata by the columns `by`; rows with a null flag are left out."""
    w = F.lit(1) if weight is None else weight
    cell = lambda e, d: F.coalesce(F.sum(F.when(e & d, w)), F.lit(0)).cast("double")
    return df.where(exposed.isNotNull() & diseased.isNotNull()).groupBy(*[F.col(f"`{c}`") for c in by]).agg(
        cell(exposed, diseased).alias("a"), cell(~exposed, diseased).alias("b"), cell(exposed, ~diseased).alias("c"), cell(~exposed, ~diseased).alias("d")
    )


def _z(conflev: float) -> float:
    return -sp.probit(alpha_of(conflev) / 2)


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def _real(c: Column, ok: Column) -> Column:
    return F.when(ok, c)


def stratum_measures(strata: DataFrame, conflev: float = 0.95, add_half_if_zeros: bool = False) -> DataFrame:
    """strata with every closed measure of each row (E20 to E28).

    With add_half_if_zeros, 0.5 is added to every cell of a row that has a zero. Negative or null
    counts give nulls.
    """
    z = _z(conflev)
    div = F.try_divide
    out = strata
    valid = (F.col("a") >= 0) & (F.col("b") >= 0) & (F.col("c") >= 0) & (F.col("d") >= 0)
    has_zero = (F.col("a") == 0) | (F.col("b") == 0) | (F.col("c") == 0) | (F.col("d") == 0)
    half = F.when(has_zero & F.lit(add_half_if_zeros), 0.5).otherwise(0.0)
    out = out.withColumns({x: F.when(valid, F.col(x).cast("double") + half) for x in "abcd"} | {"added_half": half > 0, "has_cell_zeros": has_zero & (half == 0)})
    a, b, c, d = (F.col(x) for x in "abcd")
    out = out.withColumns({"r1": a + b, "r2": c + d, "c1": a + c, "c2": b + d, "t": a + b + c + d})
    r1, r2, c1, c2, t = (F.col(x) for x in ("r1", "r2", "c1", "c2", "t"))
    whole = (c1 > 0) & (c2 > 0) & (r1 > 0) & (r2 > 0)
    least = F.least(r1, r2) * F.least(c1, c2)
    cross, margins = a * d - b * c, c1 * c2 * r1 * r2
    out = out.withColumns(
        {
            "has_marginal_zeros": ~whole, "any_expected_lt_5": F.coalesce(div(least, t) < 5, F.lit(True)),
            "cs": _real(div(t * cross * cross, margins), whole), "csc": _real(div(t * (F.abs(cross) - t / 2) * (F.abs(cross) - t / 2), margins), whole), "mhcs": _real(div((t - 1) * cross * cross, margins), whole),
        }
    )
    out = out.withColumns({"p" + k: chi2_p(F.col(k)) for k in ("cs", "csc", "mhcs")})
    for name, x, n in (("risk_exposed", a, c1), ("risk_unexposed", b, c2), ("risk_overall", r1, t)):
        limits = proportion_limits(x, n, conflev, "modwald")
        out = out.withColumns({name: div(x, n), f"{name}_lower": limits["lower"], f"{name}_upper": limits["upper"]})
    re, ru, ro = F.col("risk_exposed"), F.col("risk_unexposed"), F.col("risk_overall")
    se_rr, se_or = F.sqrt(div(1 - re, a) + div(1 - ru, b)), F.sqrt(div(F.lit(1.0), a) + div(F.lit(1.0), b) + div(F.lit(1.0), c) + div(F.lit(1.0), d))
    rr, odds = div(re, ru), div(a * d, b * c)
    se_rd = F.sqrt(div(a * c, c1 * c1 * c1) + div(b * d, c2 * c2 * c2))
    out = out.withColumns(
        {
            "rr": rr, "rr_lower": rr * F.exp(se_rr * -z), "rr_upper": rr * F.exp(se_rr * z), "rd": re - ru, "rd_lower": re - ru - se_rd * z, "rd_upper": re - ru + se_rd * z,
            "oddsratio": odds, "or_lower": odds * F.exp(se_or * -z), "or_upper": odds * F.exp(se_or * z),
        }
    )
    rr, odds = F.col("rr"), F.col("oddsratio")
    # Fractions by risks. Of those exposed, a fraction is 1 - 1/RR, so its limits are those of RR.
    aefp = _clamp(div(ro - ru, ro))
    se_aefp = F.sqrt(div(b * t * (a * d * (t - b) + c * b * b), r1 * r1 * r1 * c2 * c2 * c2))
    excess = lambda x: F.when(x != 0, 1 - div(F.lit(1.0), x))
    # By odds: with f the share of the exposed among the undiseased, f (OR - 1) / (f (OR - 1) + 1).
    share = div(c, r2)
    aefpor = _clamp(div(share * (odds - 1), share * (odds - 1) + 1))
    se_aefpor = F.sqrt(div(b * r2, d * r1) * div(b * r2, d * r1) * (div(a, b * r1) + div(c, d * r2)))
    out = out.withColumns(
        {
            "aefp": aefp, "aefp_lower": F.greatest(F.lit(-1.0), aefp - se_aefp * z) + aefp * 0, "aefp_upper": F.least(F.lit(1.0), aefp + se_aefp * z) + aefp * 0,
            "aefe": _null_safe_clamp(excess(rr)), "aefe_lower": _at_least(excess(F.col("rr_lower"))), "aefe_upper": _at_most(excess(F.col("rr_upper"))),
            "pfe": div(ru - re, ru), "pfe_lower": 1 - F.col("rr_upper"), "pfe_upper": 1 - F.col("rr_lower"),
            "aefpor": aefpor, "aefpor_lower": F.greatest(F.lit(-1.0), aefpor - se_aefpor * z) + aefpor * 0, "aefpor_upper": F.least(F.lit(1.0), aefpor + se_aefpor * z) + aefpor * 0,
            "aefeor": _null_safe_clamp(excess(odds)), "aefeor_lower": _at_least(excess(F.col("or_lower"))), "aefeor_upper": _at_most(excess(F.col("or_upper"))),
            "pfeor": 1 - odds, "pfeor_lower": 1 - F.col("or_upper"), "pfeor_upper": 1 - F.col("or_lower"),
        }
    )
    prevented = lambda x: F.when(x != 1, 1 - div(F.lit(1.0), 1 - x))
    return out.withColumns(
        {
            "pfp": div(ru - ro, ru), "pfp_lower": F.when(ru > 0, prevented(F.col("aefp_upper"))), "pfp_upper": F.when(ru > 0, prevented(F.col("aefp_lower"))),
            "pfpor": share * (1 - odds), "pfpor_lower": prevented(F.col("aefpor_upper")), "pfpor_upper": prevented(F.col("aefpor_lower")),
        }
    )


def _null_safe_clamp(c: Column) -> Column:
    return F.when(c.isNotNull(), _clamp(c))


def _at_least(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(-1.0)))


def _at_most(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(c, F.lit(1.0)))


def adjusted_measures(strata: DataFrame, by: list[str] | None = None, conflev: float = 0.95) -> DataFrame:
    """Per group (or overall) the crude table and the measures adjusted over its strata (E32 to E37, Woolf E39).

    Two aggregations combined map-side: the sums, then the distances of strata from the adjusted
    measures. A measure that any stratum leaves undefined is null. Groups of one stratum have nulls.
    """
    by, z, div = by or [], _z(conflev), F.try_divide
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    s = strata.select(*[F.col(f"`{k}`") for k in by], *[F.col(x).cast("double").alias(x) for x in "abcd"])
    one = F.lit(1.0)
    n1, n0, m1, m0, t = a + c, b + d, a + b, c + d, a + b + c + d
    positive = lambda x: F.when(x > 0, x)
    s = s.withColumns(
        {
            "mh_num": div(a * d - b * c, t), "mh_den": div(n0 * n1 * m0 * m1, (t - 1) * t * t), "mh_e": div(m1 * n1, t),
            "ln_rr": F.ln(positive(div(div(a, n1), div(b, n0)))), "w_rr": div(one, div(c, a * n1) + div(d, b * n0)),
            "rd": div(a, n1) - div(b, n0), "w_rd": div(one, div(a * c, n1 * n1 * n1) + div(b * d, n0 * n0 * n0)),
            "ln_or": F.ln(positive(div(a * d, b * c))), "w_or": div(one, div(one, a) + div(one, b) + div(one, c) + div(one, d)),
            "rr_num": div(a * n0, t), "rr_den": div(b * n1, t), "rr_var": div(m1 * n1 * n0 - a * b * t, t * t),
            "r": div(a * d, t), "s": div(b * c, t), "p": div(a + d, t), "q": div(b + c, t),
        }
    )
    half = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    # Woolf's test adds half to all strata of a group if any has a zero cell.
    zero = F.max((half > 0).cast("int")).alias("any_zero")
    whole = lambda *names: F.count(F.lit(1)) == F.least(F.lit(2**62), *[F.count(n) for n in names])
    sums = [
        F.count(F.lit(1)).alias("n_strata"), *[F.sum(x).alias(f"crude_{x}") for x in "abcd"], F.sum("mh_num").alias("mh_num"), F.sum("mh_den").alias("mh_den"), F.sum(F.col("a") - F.col("mh_e")).alias("mh_delta"),
        (F.count("mh_den") == F.count(F.lit(1))).alias("mh_ok"), whole("ln_rr", "w_rr").alias("rr_ok"), whole("rd", "w_rd").alias("rd_ok"), whole("ln_or", "w_or").alias("or_ok"), whole("r").alias("t_ok"),
        F.sum(F.col("w_rr") * F.col("ln_rr")).alias("s_rr"), F.sum("w_rr").alias("w_rr"), F.sum(F.col("w_rr") * F.col("ln_rr") * F.col("ln_rr")).alias("q_rr"),
        F.sum(F.col("w_rd") * F.col("rd")).alias("s_rd"), F.sum("w_rd").alias("w_rd"), F.sum(F.col("w_rd") * F.col("rd") * F.col("rd")).alias("q_rd"),
        F.sum(F.col("w_or") * F.col("ln_or")).alias("s_or"), F.sum("w_or").alias("w_or"), F.sum(F.col("w_or") * F.col("ln_or") * F.col("ln_or")).alias("q_or"),
        F.sum("rr_num").alias("rr_num"), F.sum("rr_den").alias("rr_den"), F.sum("rr_var").alias("rr_var"), F.sum("r").alias("sum_r"), F.sum("s").alias("sum_s"),
        F.sum(F.col("p") * F.col("r")).alias("pr"), F.sum(F.col("p") * F.col("s") + F.col("q") * F.col("r")).alias("psqr"), F.sum(F.col("q") * F.col("s")).alias("qs"),
    ]
    h = half_sums(s)
    g = s.groupBy(*by).agg(*sums, zero, *h)
    many = F.col("n_strata") > 1
    ok = lambda flag: F.col(flag) & many
    col = F.col
    out: dict[str, Column] = {f"crude_{x}": col(f"crude_{x}") for x in "abcd"} | {"n_strata": col("n_strata")}
    mh_ok = ok("mh_ok") & (col("mh_den") > 0)
    out["mh_uncorrected_chisq"] = F.when(mh_ok, div(col("mh_num") * col("mh_num"), col("mh_den")))
    out["mh_chisq_corrected"] = F.when(mh_ok, div(F.pow(F.abs(col("mh_delta")) - F.when(F.abs(col("mh_delta")) >= 0.5, 0.5).otherwise(0.0), F.lit(2.0)), col("mh_den")))
    for k, name, log in (("rr", "rr_direct", True), ("rd", "rd_direct", False), ("or", "or_direct", True)):
        mid, se = div(col(f"s_{k}"), col(f"w_{k}")), div(F.lit(z), F.sqrt(col(f"w_{k}")))
        wrap: Callable[[Column], Column] = F.exp if log else (lambda x: x)
        for tail, v in (("", mid), ("_lower", mid - se), ("_upper", mid + se)):
            out[name + tail] = F.when(ok(f"{k}_ok"), wrap(v))
        # sum of w (x - mean)^2 for the few strata of a group
        out[f"bd_chisq_{k}"] = F.when(ok(f"{k}_ok"), F.greatest(F.lit(0.0), col(f"q_{k}") - mid * col(f"s_{k}")))
    rr, se = div(col("rr_num"), col("rr_den")), F.sqrt(div(col("rr_var"), col("rr_num") * col("rr_den")))
    for tail, v in (("", rr), ("_lower", rr * F.exp(se * -z)), ("_upper", rr * F.exp(se * z))):
        out["rr_mh" + tail] = F.when(ok("t_ok") & se.isNotNull(), v)
    odds = div(col("sum_r"), col("sum_s"))
    se = F.sqrt(div(col("pr"), col("sum_r") * col("sum_r") * 2) + div(col("psqr"), col("sum_r") * col("sum_s") * 2) + div(col("qs"), col("sum_s") * col("sum_s") * 2))
    for tail, v in (("", odds), ("_lower", odds * F.exp(se * -z)), ("_upper", odds * F.exp(se * z))):
        out["or_mh" + tail] = F.when(ok("t_ok"), v)
    use = lambda k: F.when(col("any_zero") == 1, col(f"h{k}")).otherwise(col(f"{k}_or"))
    out["woolf_chisq"] = F.when(many, F.greatest(F.lit(0.0), use("q") - div(use("s") * use("s"), use("w"))))
    res = g.select(*[F.col(f"`{k}`") for k in by], *[v.alias(k) for k, v in out.items()])
    res = res.withColumns({"p_mh_uncorrected_chisq": chi2_p(col("mh_uncorrected_chisq")), "p_mh_chisq_corrected": chi2_p(col("mh_chisq_corrected"))})
    return res.withColumns({f"p_{k}": _chi2_p_df(col(k), col("n_strata") - 1) for k in ("bd_chisq_rr", "bd_chisq_rd", "bd_chisq_or", "woolf_chisq")}).withColumn("woolf_df", F.when(many, col("n_strata") - 1))


def half_sums(s: DataFrame) -> list[Column]:
    """Sums of the log odds ratios with 0.5 added to every cell, for Woolf's test."""
    a, b, c, d = (F.col(x) + 0.5 for x in "abcd")
    ln, w = F.ln(a * d / (b * c)), 1 / (1 / a + 1 / b + 1 / c + 1 / d)
    return [F.sum(w).alias("hw"), F.sum(w * ln).alias("hs"), F.sum(w * ln * ln).alias("hq")]


def _chi2_p_df(x: Column, df: Column) -> Column:
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, k in parts:
            ok = (v.notna() & (k > 0)).to_numpy()
            out = np.full(len(v), np.nan)
            if ok.any():
                out[ok] = sp.chi2_tail(v.to_numpy(float)[ok], k.to_numpy(float)[ok])
            yield pd.Series(out).where(ok)

    return F.pandas_udf(run, "double")(x, df.cast("double"))


# -- exact measures
#: Standard deviations, and tables besides, on each side of the likeliest table: beyond, weights are 0 as doubles.
REACH, BESIDES = 40, 400


def noncentral(a: int, b: int, c: int, d: int, log_odds: float) -> tuple[int, np.ndarray]:
    """The first corner cell and the weights, the greatest being 1, of the tables with these margins under an odds ratio.

    Weights come from the ratios of neighbours, added up from the likeliest table outwards.
    """
    m, k, n = a + b, a + c, a + b + c + d
    low, high = max(0, m + k - n), min(m, k)
    step = lambda x: log_odds + np.log((m - x + 1.0) * (k - x + 1.0)) - np.log(x * (n - k - m + x + 0.0))
    # The likeliest: the last table that is not below the one before it. Ratios fall.
    at, end = low, high
    while at < end:
        mid = (at + end + 1) // 2
        at, end = (mid, end) if step(mid) >= 0 else (at, mid - 1)
    cells = (at + 1.0, m - at + 1.0, k - at + 1.0, n - m - k + at + 1.0)
    width = int(REACH / math.sqrt(sum(1 / x for x in cells))) + BESIDES
    first, last = max(low, at - width), min(high, at + width)
    w = np.concatenate([[0.0], np.cumsum(step(np.arange(first + 1, last + 1, dtype=float)))])
    return first, np.exp(w - w[at - first])


def _convolved(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The weights of sums. Very long ones go through Fourier transforms, which keep 15 digits of the greatest weight only."""
    if len(x) * len(y) <= 4_000_000_000:
        out = np.convolve(x, y)
    else:
        size = 1 << (len(x) + len(y) - 2).bit_length()
        out = np.maximum(np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)[: len(x) + len(y) - 1], 0.0)
    return out / out.max()


class TableDistribution:
    """The distribution of the sum of corner cells of tables with fixed margins, for any odds ratio."""

    def __init__(self, tables: list[tuple[int, int, int, int]]) -> None:
        self.tables = tables
        self.seen = sum(t[0] for t in tables)
        self.low = sum(max(0, a - d) for a, b, c, d in tables)
        self.high = sum(min(a + b, a + c) for a, b, c, d in tables)
        sums = [sum(t[i] for t in tables) + 0.5 for i in range(4)]
        self.start = math.log(sums[0] * sums[3] / (sums[1] * sums[2]))
        self.reach = 6 * math.sqrt(sum(1 / v for v in sums))
        self._kept: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, log_odds: float) -> tuple[np.ndarray, np.ndarray]:
        """Values of the sum and their probabilities."""
        if log_odds not in self._kept:
            self._kept = {0.0: self._kept[0.0]} if 0.0 in self._kept else {}
            first, w = 0, np.ones(1)
            for t in self.tables:
                x, v = noncentral(*t, log_odds)
                first, w = first + x, _convolved(w, v)
            self._kept[log_odds] = first + np.arange(len(w)), w / w.sum()
        return self._kept[log_odds]

    def tails(self, log_odds: float = 0.0) -> tuple[float, float, float]:
        """P(X < seen), P(X = seen), P(X > seen)."""
        x, p = self.at(log_odds)
        i = min(max(self.seen - int(x[0]), 0), len(x))
        here = float(p[i]) if i < len(x) and x[i] == self.seen else 0.0
        after = i + 1 if here or (i < len(x) and x[i] == self.seen) else i
        return float(p[:i].sum()), here, float(p[after:].sum())

    def mean(self, log_odds: float) -> float:
        x, p = self.at(log_odds)
        return float(x[0]) + float((p * np.arange(len(p))).sum())

    def solve(self, rising: Callable[[float], float]) -> float:
        """The odds ratio at which a function of its logarithm, rising in it, is zero.

        From a bracket around the crude odds ratio, by false position with halved ends, bisecting where that is slow.
        """
        low, high, wide = self.start - self.reach, self.start + self.reach, self.reach
        while (f_low := rising(low)) > 0 and low > -700:
            low, wide = low - wide, wide * 2
        while (f_high := rising(high)) < 0 and high < 700:
            high, wide = high + wide, wide * 2
        side = 0
        for k in range(200):
            if high - low <= 1e-14 * max(1.0, abs(low), abs(high)):
                break
            mid = (low * f_high - high * f_low) / (f_high - f_low) if f_high > f_low else (low + high) / 2
            if k % 4 == 3 or not low < mid < high:
                mid = (low + high) / 2
            f = rising(mid)
            if f == 0:
                return math.exp(mid)
            if f < 0:
                low, f_low, f_high, side = mid, f, f_high / (2 if side == -1 else 1), -1
            else:
                high, f_high, f_low, side = mid, f, f_low / (2 if side == 1 else 1), 1
        return math.exp((low + high) / 2)

    def estimate(self) -> float:
        """The conditional maximum likelihood odds ratio: the expected equals the observed sum."""
        if self.seen <= self.low:
            return 0.0
        return math.inf if self.seen >= self.high else self.solve(lambda t: self.mean(t) - self.seen)

    def limits(self, conflev: float) -> tuple[float, float]:
        a2 = alpha_of(conflev) / 2
        low = 0.0 if self.seen <= self.low else self.solve(lambda t: sum(self.tails(t)[1:]) - a2)
        return low, math.inf if self.seen >= self.high else self.solve(lambda t: a2 - sum(self.tails(t)[:2]))

    def mid_p(self, conflev: float) -> tuple[float, float, float]:
        """Median unbiased odds ratio and limits: half of the observed table's probability counts."""
        if self.low == self.high:
            return math.nan, math.nan, math.nan
        a2 = alpha_of(conflev) / 2
        at = lambda q: self.solve(lambda t: q - (self.tails(t)[0] + self.tails(t)[1] / 2))
        return at(0.5), (0.0 if self.seen <= self.low else at(1 - a2)), (math.inf if self.seen >= self.high else at(a2))

    def p_values(self) -> dict[str, float]:
        _, p = self.at(0.0)
        below, here, above = self.tails()
        # The estimate is at most 1 where no more is seen than expected.
        one = below + here if self.seen <= self.mean(0.0) else here + above
        mid = min(below + here / 2, above + here / 2)
        return {
            "exact_p_onesided": min(1.0, one), "exact_p_twice_onesided": 2 * one, "exact_p_as_extreme": float(min(1.0, p[p <= here * (1 + 1e-7)].sum())),
            "mid_p_onesided": mid, "mid_p_twosided": 2 * mid,
        }


KHAN = ("khan_p_onesided", "khan_p_twosided")
EXACT = ("exact_p_onesided", "exact_p_twice_onesided", "exact_p_as_extreme", "mid_p_onesided", "mid_p_twosided", "cmle_or", "cmle_or_lower", "cmle_or_upper", "midp_or", "midp_or_lower", "midp_or_upper")


def exact_values(tables: list[tuple[int, int, int, int]], conflev: float = 0.95, largest: int | None = None) -> dict[str, float]:
    """The exact measures of one table or of several strata; nan for missing and negative counts.

    largest: a cell of their sum above which they are not worked out (nan); None for no limit.
    """
    sums = [sum(t[i] for t in tables) for i in range(4)]
    nothing = dict.fromkeys(EXACT, math.nan)
    if not tables or any(v is None or v < 0 or v != v for t in tables for v in t) or (largest is not None and max(sums) > largest):
        return nothing
    dist = TableDistribution([tuple(int(v) for v in t) for t in tables])
    out = nothing | dist.p_values()
    out["cmle_or"] = dist.estimate()
    out["cmle_or_lower"], out["cmle_or_upper"] = dist.limits(conflev)
    out["midp_or"], out["midp_or_lower"], out["midp_or_upper"] = dist.mid_p(conflev)
    return out


def stratum_exact(strata: DataFrame, conflev: float = 0.95, largest: int | None = None) -> DataFrame:
    """strata with the exact measures of each row (E29, E30), and Khan's p values (E31)."""

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for a, b, c, d in parts:
            rows = [exact_values([t], conflev, largest) | dict(zip(KHAN, _khan_or_nan(*t))) for t in zip(a, b, c, d)]
            yield pd.DataFrame(rows, columns=[*EXACT, *KHAN]).astype(float)

    udf = F.pandas_udf(run, ", ".join(f"{n} double" for n in (*EXACT, *KHAN)))
    out = strata.withColumn("__exact", udf(*[F.col(x).cast("double") for x in "abcd"]))
    return out.withColumns({n: F.nanvl(F.col(f"__exact.{n}"), F.lit(None).cast("double")) for n in (*EXACT, *KHAN)}).drop("__exact")


def adjusted_exact(strata: DataFrame, by: list[str] | None = None, conflev: float = 0.95, largest: int | None = None) -> DataFrame:
    """Exact common odds ratio and p values over the strata of each group (E38). Groups hold one row per stratum."""
    by = by or []
    keys = ", ".join(f"`{k}` {dict(strata.dtypes)[k]}" for k in by)
    schema = ", ".join(x for x in (keys, ", ".join(f"{n} double" for n in EXACT)) if x)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r) for r in frame[list("abcd")].astype(float).itertuples(index=False)]
        out = exact_values(rows, conflev, largest)
        return pd.DataFrame([{k: frame[k].iloc[0] for k in by} | out])

    picked = strata.select(*[F.col(f"`{k}`") for k in by], *[F.col(x).cast("double").alias(x) for x in "abcd"])
    if not by:
        picked = picked.withColumn("__all", F.lit(1))
    out = picked.groupBy(*(by or ["__all"])).applyInPandas(run, schema)
    return out.select(*by, *[F.nanvl(F.col(n), F.lit(None).cast("double")).alias(n) for n in EXACT])


def khan_p(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """One-sided p by walking from the observed table towards a smaller least cell, and twice it, below 1.

    The walk ends at a table of probability below one in a million.
    """
    # Turned so that the least cell is the corner; the margins stay paired.
    a, b, c, d = min(((a, b, c, d), (b, a, d, c), (c, d, a, b), (d, c, b, a)), key=lambda t: t[0])
    first, w = noncentral(a, b, c, d, 0.0)
    p = (w / w.sum())[: max(a - first + 1, 0)][::-1]
    small = np.flatnonzero(p < 1e-6)
    total = float(p[: small[0] if len(small) else len(p)].sum())
    return total, min(2 * total, math.nextafter(1.0, 0.0))


def _khan_or_nan(*t: float) -> tuple[float, float]:
    return (math.nan, math.nan) if any(v is None or v != v or v < 0 for v in t) else khan_p(*(int(v) for v in t))


def report(rows: list[dict], adjusted: dict | None = None, digits: int = 5) -> str:
    """The measures of strata and their adjusted values as text, section by section."""
    number = lambda v: "-" if v is None or v != v else f"{v:.{digits}f}"
    three = lambda r, k, lo="_lower", hi="_upper": f"{number(r.get(k))} ({number(r.get(k + lo))}, {number(r.get(k + hi))})"
    sections = {
        "Measures of association": [("Chi-square", "cs", "p"), ("Yates-corrected chi-square", "csc", "p"), ("Mantel-Haenszel chi-square", "mhcs", "p")],
        "Risk-based measures": [("Risk in exposed", "risk_exposed", ""), ("Risk in unexposed", "risk_unexposed", ""), ("Overall risk", "risk_overall", ""), ("Risk ratio", "rr", ""), ("Risk difference", "rd", ""), ("Attributable fraction, population", "aefp", ""), ("Attributable fraction, exposed", "aefe", ""), ("Prevented fraction, population", "pfp", ""), ("Prevented fraction, exposed", "pfe", "")],
        "Odds-based measures": [("Sample odds ratio", "oddsratio", "or"), ("CMLE odds ratio", "cmle_or", ""), ("mid-p odds ratio", "midp_or", ""), ("Attributable fraction, population", "aefpor", ""), ("Attributable fraction, exposed", "aefeor", ""), ("Prevented fraction, population", "pfpor", ""), ("Prevented fraction, exposed", "pfeor", "")],
    }
    lines = []
    for title, items in sections.items():
        lines += [title, "=" * len(title)]
        for i, r in enumerate(rows):
            lines.append(f"{r.get('label') or f'Stratum {i + 1}'}: " + " ".join(f"{x}={number(r[x])}" for x in "abcd"))
            for text, k, kind in items:
                if kind == "p":
                    lines.append(f"  {text}: {number(r.get(k))}, p={number(r.get('p' + k))}")
                elif kind == "or":
                    lines.append(f"  {text}: {number(r.get(k))} ({number(r.get('or_lower'))}, {number(r.get('or_upper'))})")
                elif k in r:
                    lines.append(f"  {text}: {three(r, k)}")
    if adjusted:
        lines += ["Adjusted", "========"]
        lines += [f"  {k}: {number(v)}" for k, v in adjusted.items() if isinstance(v, (int, float)) or v is None]
    return "\n".join(lines)
