"""SQL of the queries whose limits and p values have no closed form: distribution functions as sums, solved by halving.

Each SQL states the defining equation of a limit, so that it says the same as the query by other means: Poisson and
gamma limits by the series of the incomplete gamma function, binomial and hypergeometric ones by adding up all
outcomes, normal and t values by Simpson's rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import relation_queries as rq, summary_queries as sq
from tallyframe.functions import intervals, special
from tallyframe.operators import measures as m, rates, twobytwo

QUERIES = {}
ORACLES = {}
A2 = 0.025


def add(name, run, sql):
    QUERIES[name] = run
    ORACLES[name] = sql


def solved(base: str, low: str, high: str, below: str, name: str, steps: int = 70) -> str:
    """base with the column name at which the condition `below`, over the candidate m, turns from true to false."""
    return f"""SELECT * EXCLUDE (s_lo, s_hi, s_k), (s_lo + s_hi) / 2 AS {name} FROM (
WITH RECURSIVE r AS (SELECT *, CAST({low} AS DOUBLE) AS s_lo, CAST({high} AS DOUBLE) AS s_hi, 0 AS s_k FROM ({base})
UNION ALL SELECT * EXCLUDE (m, s_b) REPLACE (CASE WHEN s_b THEN m ELSE s_lo END AS s_lo, CASE WHEN s_b THEN s_hi ELSE m END AS s_hi, s_k + 1 AS s_k)
  FROM (SELECT *, coalesce({below}, FALSE) AS s_b FROM (SELECT *, (s_lo + s_hi) / 2 AS m FROM r WHERE s_k < {steps})))
SELECT * FROM r WHERE s_k = {steps})"""


def gamma_p(a: str, x: str) -> str:
    """P(X <= x) of a gamma variable of shape a; the series is cut where its terms have vanished."""
    return f"list_sum(list_transform(range(0, CAST(60 + greatest(0, {x} - {a}) + 12 * sqrt(greatest({x}, 1)) AS BIGINT)), lambda i: exp(({a} + i) * ln({x}) - {x} - lgamma({a} + i + 1))))"


def gamma_limits(base: str, shape: str, name: str, zero_upper: str | None = None) -> str:
    """base with {name}_lo and {name}_hi: exact limits of a count; 0 below for none."""
    top = f"(2 * ({shape}) + 60)"
    low = solved(base, "0", top, f"{gamma_p(f'({shape})', 'm')} < {A2}", f"{name}_l")
    both = solved(low, "0", top, f"{gamma_p(f'({shape} + 1)', 'm')} < {1 - A2}", f"{name}_h")
    high = f"{name}_h" if zero_upper is None else f"CASE WHEN ({shape}) = 0 THEN {zero_upper} ELSE {name}_h END"
    return f"SELECT * EXCLUDE ({name}_l, {name}_h), CASE WHEN ({shape}) = 0 THEN 0 ELSE {name}_l END AS {name}_lo, {high} AS {name}_hi FROM ({both})"


def simpson(density: str, upto: str, steps: int = 400) -> str:
    """The integral of a density over u from 0 to upto."""
    h = f"(({upto}) / {steps})"
    f = density.replace("$u", f"(i * {h})")
    return f"({h} / 3 * list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f})))"


_NORMAL = "exp(-$u * $u / 2) / sqrt(2 * pi())"


def limited(df, digits=4):
    """Doubles rounded to what the solved limits hold."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _limits(make, method, digits):
    def run(spark, d):
        df = rq._long_stays(spark, d).withColumn("l", make(F.col("x"), F.col("n"), method=method))
        return df.select("geog_region", "x", "n", F.round("l.lower", digits).alias("lower"), F.round("l.upper", digits).alias("upper"))

    return run


# -- counts and rates
add(
    "summ_count_limits_exact",
    lambda s, d: limited(sq.orders(s, d).summ("o_orderpriority", m.freqcl(), ordered=False).df.drop("_condcols_", "_freq_")),
    f"""SELECT o_orderpriority, 1 AS _level_, '1' AS _type_, n AS freqcl, round(n_lo, 4) AS freqcl_ll, round(n_hi, 4) AS freqcl_ul
FROM ({gamma_limits("SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL", "n", "n")})""",
)
add(
    "rate_limits_exact",
    _limits(intervals.rate_limits, "daly", 4),
    f"SELECT geog_region, x, n, round(x_lo / n * 100000, 4) AS lower, round(x_hi / n * 100000, 4) AS upper FROM ({gamma_limits(rq._LONG, 'x', 'x')})",
)
_CELLS = rq._CELLS.replace(" AND region IS NOT NULL", "")
_GROUPED = _CELLS.strip() + """, g AS (SELECT sex, year, CAST(sum(d) AS DOUBLE) AS e, sum(p) AS pop, CAST(sum(CASE WHEN w IS NOT NULL THEN d END) AS DOUBLE) AS es, sum(d * w / p) AS y, sum(d * w / p * w / p) AS v,
  (SELECT max(w / p) FROM c) AS wm FROM c GROUP BY ALL)"""
_COMMON = "sex, year, e AS summfreq, pop AS popfreq, round(e / pop * 100000, 4) AS cr, round(e_lo / pop * 100000, 4) AS cr_ll, round(e_hi / pop * 100000, 4) AS cr_ul, es AS std_strata_summfreq, round(y * 100000, 4) AS dsr"
_CRUDE = gamma_limits("SELECT * FROM g", "e", "e")
add(
    "rate_direct_dobson",
    lambda s, d: limited(rates.direct_rates(rq._deaths(s, d), rq._population(s, d), rq._standard(s, d)).df),
    f"""{_GROUPED} SELECT {_COMMON}, round((y + sqrt(v / es) * (es_lo - es)) * 100000, 4) AS dsr_ll, round((y + sqrt(v / es) * (es_hi - es)) * 100000, 4) AS dsr_ul
FROM ({gamma_limits(_CRUDE, "es", "es", "-ln(0.05)")})""",
)
_FAY = solved(
    solved(f"SELECT *, y * y / v AS shape_l, (y + wm) * (y + wm) / (v + wm * wm) AS shape_h FROM ({_CRUDE})", "0", "2 * shape_l + 60", f"{gamma_p('shape_l', 'm')} < {A2}", "g_l"),
    "0", "2 * shape_h + 60", f"{gamma_p('shape_h', 'm')} < {1 - A2}", "g_h",
)
add(
    "rate_direct_fay",
    lambda s, d: limited(rates.direct_rates(rq._deaths(s, d), rq._population(s, d), rq._standard(s, d), ci_method="ff").df),
    f"{_GROUPED} SELECT {_COMMON}, round(v / y * g_l * 100000, 4) AS dsr_ll, round((v + wm * wm) / (y + wm) * g_h * 100000, 4) AS dsr_ul FROM ({_FAY})",
)
add(
    "rate_stratified_exact",
    lambda s, d: limited(rates.stratified_rates(rq._deaths(s, d), rq._population(s, d)).df),
    f"""{_CELLS} SELECT agegrp, sex, year, n AS summfreq, p AS popfreq, round(n / p * 100000, 4) AS sr, round(n_lo / p * 100000, 4) AS sr_ll, round(n_hi / p * 100000, 4) AS sr_ul
FROM ({gamma_limits("SELECT agegrp, sex, year, CAST(d AS DOUBLE) AS n, p FROM c", "n", "n")})""",
)
_OBSERVED = gamma_limits("SELECT * FROM q", "observed", "o", "-ln(0.05)")
add(
    "rate_indirect_exact",
    lambda s, d: limited(rq._indirect_df(s, d, 0.95)),
    f"""WITH q AS ({rq.ORACLES["rate_indirect_all"].replace("round(", "(").replace(", 6)", ")")}) SELECT region, popfreq, observed, round(expected, 4) AS expected, round(isr, 4) AS isr, round(o_lo / expected * 100, 4) AS isr_ll, round(o_hi / expected * 100, 4) AS isr_ul FROM ({_OBSERVED})""",
)

# -- proportions
_BINOMIAL = "list_sum(list_transform(range({a}, {b}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(m) + (n - i) * ln(1 - m))))"
_UP, _DOWN = _BINOMIAL.format(a="CAST(x AS BIGINT)", b="CAST(n AS BIGINT) + 1"), _BINOMIAL.format(a="0", b="CAST(x AS BIGINT) + 1")
_CLOPPER = solved(solved(rq._LONG, "0", "1", f"{_UP} < {A2}", "lower"), "0", "1", f"{_DOWN} > {A2}", "upper")
add("prop_limits_clopper_pearson", _limits(intervals.proportion_limits, "exact", 7), f"SELECT geog_region, x, n, round(lower, 7) AS lower, round(upper, 7) AS upper FROM ({_CLOPPER})")


def _geigy_root(r: str, sign: str) -> str:
    z2 = f"{special.probit(1 - A2) ** 2!r}"
    lead = f"({z2} * {z2} / 18 + {z2} / 6 * (2 * n + 1) + (n + 1.0 / 3) ^ 2)"
    linear = f"({z2} * {z2} / 18 + {z2} / 6 * (4 * (n - {r}) + 3) + 2.0 / 3 * ({r} * (3 * n + 1) - n) - 2.0 / 9)"
    constant = f"({z2} * {z2} / 18 + ({r} - 1.0 / 3) ^ 2 - {z2} / 6 * (2 * {r} - 1))"
    return f"({linear} {sign} sqrt({linear} ^ 2 - 4 * {lead} * {constant})) / (2 * {lead})"


add("prop_limits_geigy_tables", _limits(intervals.proportion_limits, "geigy", 7), f"SELECT geog_region, x, n, round({_geigy_root('x', '-')}, 7) AS lower, round({_geigy_root('(x + 1)', '+')}, 7) AS upper FROM ({rq._LONG})")

# -- normal and t values
_Y = "sqrt(-2 * ln(least(p, 1 - p)))"
_POLY = lambda c: " + ".join(f"{v!r} * {_Y} ^ {i}" for i, v in enumerate(c))
add(
    "normal_values",
    lambda s, d: rq.QUERIES["normal_functions"](s, d),
    f"""SELECT r_regionkey, round(0.5 + {simpson(_NORMAL, "r_regionkey")}, 9) AS cdf, round(CASE WHEN p = 0.5 THEN 0 ELSE sign(p - 0.5) * ({_Y} + ({_POLY(special.AS70_P)}) / ({_POLY(special.AS70_Q)})) END, 9) AS quantile
FROM (SELECT r_regionkey, (r_regionkey + 1) / 10 AS p FROM region)""",
)
_T = solved(
    "SELECT l_returnflag, count(*) AS k, avg(l_extendedprice) AS mu, stddev_samp(l_extendedprice) / sqrt(count(*)) AS se, CAST(count(*) - 1 AS DOUBLE) AS v FROM lineitem GROUP BY ALL",
    "0", "100", simpson("exp(lgamma((v + 1) / 2) - lgamma(v / 2) - (v + 1) / 2 * ln(1 + $u * $u / v)) / sqrt(v * pi())", "m") + f" < {0.5 - A2}", "t",
)
add(
    "summ_mean_limits_t",
    lambda s, d: limited(sq.lineitem(s, d).summ("l_returnflag", m.meancl("l_extendedprice", weight=False), ordered=False).df.select("l_returnflag", "meancl_of_l_extendedprice", "meancl_of_l_extendedprice_ll", "meancl_of_l_extendedprice_ul")),
    f"SELECT l_returnflag, round(mu, 4) AS meancl_of_l_extendedprice, round(mu - t * se, 4) AS meancl_of_l_extendedprice_ll, round(mu + t * se, 4) AS meancl_of_l_extendedprice_ul FROM ({_T})",
)

# -- 2x2 tables
_ROWS = f"SELECT *, list_transform(range(CAST(greatest(0, a - d) AS BIGINT), CAST(least(a + b, a + c) AS BIGINT) + 1), lambda i: i) AS xs FROM ({rq._STRATA})"
_LW = "(-lgamma({i} + 1) - lgamma(a + b - {i} + 1) - lgamma(a + c - {i} + 1) - lgamma(d - a + {i} + 1))"
#: The logarithm of a table's weight against that of the observed one.
_WEIGHED = f"SELECT *, ln(a * d / (b * c)) AS l0, list_transform(xs, lambda i: {_LW.format(i='i')} - {_LW.format(i='a')}) AS lw FROM ({_ROWS})"


def _share(test: str, log_odds: str = "m") -> str:
    """The probability of the tables whose corner cell $i meets a test."""
    weight = f"exp(q[2] + (q[1] - a) * {log_odds})"
    part = f"list_sum(list_transform(list_zip(xs, lw), lambda q: CASE WHEN {test.replace('$i', 'q[1]')} THEN {weight} ELSE 0 END))"
    return f"({part} / list_sum(list_transform(list_zip(xs, lw), lambda q: {weight})))"


_EXACT = _WEIGHED
for _name, _below in (("lo", f"{_share('$i >= a')} < {A2}"), ("hi", f"{_share('$i <= a')} > {A2}"), ("mid", f"{_share('$i > a')} + {_share('$i = a')} / 2 < 0.5")):
    _EXACT = solved(_EXACT, "l0 - 1", "l0 + 1", _below, f"t_{_name}", 40)
add(
    "twobytwo_exact_limits",
    lambda s, d: limited(twobytwo.stratum_exact(rq._strata(s, d)).select("geog_region", *"abcd", "exact_p_onesided", "mid_p_onesided", "cmle_or_lower", "cmle_or_upper", "midp_or"), 6),
    f"""SELECT geog_region, a, b, c, d, round(least({_share("$i <= a", "0")}, {_share("$i >= a", "0")}), 6) AS exact_p_onesided,
round(least({_share("$i < a", "0")}, {_share("$i > a", "0")}) + {_share("$i = a", "0")} / 2, 6) AS mid_p_onesided, round(exp(t_lo), 6) AS cmle_or_lower, round(exp(t_hi), 6) AS cmle_or_upper, round(exp(t_mid), 6) AS midp_or FROM ({_EXACT})""",
)
_P = {"mh_uncorrected_chisq": 1, "bd_chisq_or": 3, "bd_chisq_rr": 3}
_TAIL = lambda x, k: f"CASE WHEN {x} > 0 THEN greatest(0, 1 - {gamma_p(f'({k} / 2.0)', f'({x} / 2)')}) ELSE 1 END"
_ADJUSTED = rq.ORACLES["twobytwo_adjusted"].replace("round(", "(").replace(", 6)", ")")
add(
    "twobytwo_adjusted_p",
    lambda s, d: limited(twobytwo.adjusted_measures(rq._strata(s, d)).select("n_strata", *[f"p_{k}" for k in _P]), 6),
    "SELECT n_strata, " + ", ".join(f"round({_TAIL(k, df)}, 6) AS p_{k}" for k, df in _P.items()) + f" FROM ({_ADJUSTED})",
)

# -- text
add(
    "search_highlight_text",
    lambda s, d: rq.QUERIES["search_highlight"](s, d),
    f"""{rq._TOKENS} SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+|[^A-Za-z0-9'']+'),
  lambda x: CASE WHEN regexp_full_match(x, '(?i)m''?e''?r''?g''?e') THEN '<b>' || x || '</b>' ELSE x END), '')) AS marked FROM documents WHERE doc_id IN (SELECT doc_id FROM p WHERE word = 'MERGE')""",
)
