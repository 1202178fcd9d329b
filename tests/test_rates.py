"""Published rates and 2x2 measures."""

import math

import numpy as np
import pytest

from tallyframe.meta import ColumnMeta, Dataset
from tallyframe.operators import rates, twobytwo

CAT, ORD, NUM = ColumnMeta("categorical"), ColumnMeta("ordinal"), ColumnMeta("scalar")
DEATHS = {1960: [141, 926, 1253, 1080, 1869, 4891, 14956, 30888, 41725, 26501, 5928], 1940: [45, 201, 320, 670, 1126, 3160, 9723, 17935, 22179, 13461, 2238]}
POP = {
    1960: [1784033, 7065148, 15658730, 10482916, 9939972, 10563872, 9114202, 6850263, 4702482, 1874619, 330915],
    1940: [906897, 3794573, 10003544, 10629526, 9465330, 8249558, 7294330, 5022499, 2920220, 1019504, 142532],
}


def _long(spark, name, by_year):
    rows = [(i + 1, y, v) for y, vs in by_year.items() for i, v in enumerate(vs)]
    return Dataset.of(spark.createDataFrame(rows, "agegrp int, year int, _freq_ long"), name, agegrp=CAT, year=ORD, _freq_=NUM)


@pytest.fixture(scope="module")
def tables(spark):
    std = Dataset.of(spark.createDataFrame([(i + 1, v) for i, v in enumerate(POP[1960])], "agegrp int, _stdpop_ long"), "std", agegrp=CAT, _stdpop_=NUM)
    return _long(spark, "deaths", DEATHS), _long(spark, "pops", POP), std


def test_direct_dobson(tables):
    r = {x["year"]: x for x in rates.direct_rates(*tables).df.collect()}
    want = {1940: (139.25054, 138.21410, 140.29275, 119.52864, 118.65139, 120.41077), 1960: (166.08744, 165.18636, 166.99223, 166.08744, 165.18636, 166.99223)}
    for y, w in want.items():
        got = tuple(round(r[y][k], 5) for k in ("dsr", "dsr_ll", "dsr_ul", "cr", "cr_ll", "cr_ul"))
        assert got == pytest.approx(w, abs=2e-5)


def test_fay_feuer_near_dobson(tables):
    for x in rates.direct_rates(*tables, ci_method="ff").df.collect():
        assert x["dsr_ll"] < x["dsr"] < x["dsr_ul"] and x["dsr_ul"] - x["dsr_ll"] < 3


def test_crude_only_and_stratified(tables):
    crude = rates.direct_rates(tables[0], tables[1]).df
    assert "dsr" not in crude.columns and crude.count() == 2
    s = rates.stratified_rates(tables[0], tables[1]).df.where("agegrp = 1 and year = 1960").first()
    assert s["sr"] == pytest.approx(141 / 1784033 * 1e5) and s["sr_ll"] < s["sr"] < s["sr_ul"]


def test_indirect(spark, tables):
    deaths, pops, _ = tables
    std_events = Dataset.of(deaths.df.where("year = 1960").drop("year"), "stdev", agegrp=CAT, _freq_=NUM)
    std_pop = Dataset.of(pops.df.where("year = 1960").drop("year"), "stdpop", agegrp=CAT, _freq_=NUM)
    by_year = deaths.summ("year", weightcol="_freq_")
    events = Dataset.of(deaths.df.groupBy("year").sum("_freq_").withColumnRenamed("sum(_freq_)", "_freq_"), "ev", year=ORD, _freq_=NUM)
    r = {x["year"]: x for x in rates.indirect_ratios(events, pops, std_events, std_pop).df.collect()}
    assert r[1960]["isr"] == pytest.approx(100) and by_year is not None
    expected = sum(d / p * q for d, p, q in zip(DEATHS[1960], POP[1960], POP[1940]))
    assert r[1940]["expected"] == pytest.approx(expected) and r[1940]["isr"] == pytest.approx(sum(DEATHS[1940]) / expected * 100)
    with pytest.raises(ValueError):
        rates.indirect_ratios(events, std_pop, std_events, std_pop)


STRATA = [("s1", 66, 36, 28, 32), ("s2", 139, 93, 61, 54)]


@pytest.fixture(scope="module")
def strata(spark):
    return spark.createDataFrame(STRATA, "label string, a int, b int, c int, d int")


def _near(row, want):
    assert {k: round(row[k], 5) for k in want} == pytest.approx(want, abs=1.1e-5)


def test_stratum(strata):
    r = twobytwo.stratum_exact(twobytwo.stratum_measures(strata)).where("label = 's1'").first()
    _near(r, {"cs": 5.04737, "pcs": 0.02466, "csc": 4.33389, "pcsc": 0.03736, "mhcs": 5.01621, "pmhcs": 0.02511, "risk_exposed": 0.70213, "risk_exposed_lower": 0.60290, "risk_exposed_upper": 0.78549})
    _near(r, {"rr": 1.32624, "rr_lower": 1.02269, "rr_upper": 1.71988, "rd": 0.17272, "rd_lower": 0.02231, "rd_upper": 0.32312, "oddsratio": 2.09524, "or_lower": 1.09410, "or_upper": 4.01244})
    _near(r, {"exact_p_onesided": 0.01881, "exact_p_twice_onesided": 0.03762, "exact_p_as_extreme": 0.03204, "mid_p_onesided": 0.01341, "mid_p_twosided": 0.02682})
    _near(r, {"cmle_or": 2.08538, "cmle_or_lower": 1.03962, "cmle_or_upper": 4.22297, "midp_or": 2.08281})
    # The published mid-p limits come from a root finder that stops at 1e-4.
    assert (r["midp_or_lower"], r["midp_or_upper"]) == pytest.approx((1.08768, 4.02798), rel=1e-4)


def test_crude_fractions(spark):
    df = spark.createDataFrame([(205, 129, 89, 86)], "a int, b int, c int, d int")
    r = twobytwo.stratum_measures(df).first()
    _near(r, {"aefp": 0.08563, "aefp_lower": 0.01098, "aefp_upper": 0.16028, "aefe": 0.13951, "aefe_lower": 0.01750, "aefe_upper": 0.24638, "pfp": -0.09365, "pfp_lower": -0.19087, "pfp_upper": -0.01110, "pfe": -0.16213, "pfe_lower": -0.32692, "pfe_upper": -0.01781})
    _near(r, {"aefpor": 0.21407, "aefpor_lower": 0.05494, "aefpor_upper": 0.37320, "aefeor": 0.34878, "aefeor_lower": 0.05791, "aefeor_upper": 0.54984, "pfpor": -0.27238, "pfpor_lower": -0.59540, "pfpor_upper": -0.05814, "pfeor": -0.53558, "pfeor_lower": -1.22145, "pfeor_upper": -0.06147})


def test_adjusted(strata):
    r = twobytwo.adjusted_measures(strata).first()
    _near(r, {"mh_uncorrected_chisq": 5.21052, "p_mh_uncorrected_chisq": 0.02245, "mh_chisq_corrected": 4.78871, "p_mh_chisq_corrected": 0.02865})
    _near(r, {"rr_direct": 1.15345, "rr_direct_lower": 1.01056, "rr_direct_upper": 1.31655, "rr_mh": 1.16240, "rr_mh_lower": 1.01794, "rr_mh_upper": 1.32736, "bd_chisq_rr": 1.49516, "p_bd_chisq_rr": 0.22142})
    _near(r, {"rd_direct": 0.09652, "rd_direct_lower": 0.01283, "rd_direct_upper": 0.18021, "bd_chisq_rd": 1.42813, "p_bd_chisq_rd": 0.23207})
    _near(r, {"or_direct": 1.53615, "or_direct_lower": 1.06078, "or_direct_upper": 2.22456, "or_mh": 1.53597, "or_mh_lower": 1.06192, "or_mh_upper": 2.22163, "bd_chisq_or": 1.29834, "woolf_chisq": 1.29834, "p_woolf_chisq": 0.25452})
    e = twobytwo.adjusted_exact(strata).first()
    _near(e, {"exact_p_onesided": 0.01438, "exact_p_twice_onesided": 0.02876, "exact_p_as_extreme": 0.02371, "mid_p_onesided": 0.01158, "mid_p_twosided": 0.02316})
    assert (e["cmle_or"], e["cmle_or_lower"], e["cmle_or_upper"]) == pytest.approx((1.53481, 1.04352, 2.25940), rel=1e-4)  # as above


def test_zero_cells(spark):
    df = spark.createDataFrame([(0, 5, 3, 7), (0, 0, 0, 0), (4, 0, 0, 2), (None, 1, 1, 1)], "a int, b int, c int, d int")
    rows = twobytwo.stratum_exact(twobytwo.stratum_measures(df)).collect()
    assert rows[0]["rr"] == 0 and rows[0]["rr_lower"] is None and rows[1]["cs"] is None and rows[2]["oddsratio"] is None and rows[3]["rr"] is None
    assert twobytwo.stratum_measures(df, add_half_if_zeros=True).first()["oddsratio"] == pytest.approx(0.5 * 7.5 / 5.5 / 3.5)
    assert twobytwo.adjusted_measures(df).first()["rr_direct"] is None
    assert twobytwo.khan_p(1, 21, 4, 16)[0] == pytest.approx(twobytwo.exact_values([(1, 21, 4, 16)])["exact_p_onesided"], abs=1e-5)
    assert "Risk ratio" in twobytwo.report([r.asDict() for r in rows])


@pytest.mark.parametrize("name", ["rate_direct_limits", "rate_direct_limits_ff", "rate_stratified_limits", "rate_direct_all", "rate_crude_all", "rate_stratified_all", "align_join_all", "crosstab_dense_all"])
def test_deaths_of_unknown_region_are_counted(spark, sf, name):
    from tallyframe.relation_queries import QUERIES

    known = spark.read.parquet(f"{sf}/syndeath.parquet").where("agegrp is not null and sex is not null and year is not null")
    assert known.where("region is null").count() > 0
    out = QUERIES[name](spark, sf)
    n = "summfreq" if "summfreq" in out.columns else "_freq_"
    assert sum(r[n] or 0 for r in out.collect()) == known.count()


@pytest.mark.parametrize("name", ["rate_indirect_all", "rate_indirect_limits"])
def test_indirect_leaves_out_only_what_it_counts_by(spark, sf, name):
    from tallyframe.relation_queries import QUERIES

    deaths, pop = spark.read.parquet(f"{sf}/syndeath.parquet"), spark.read.parquet(f"{sf}/synpop.parquet")
    rows = QUERIES[name](spark, sf).collect()
    assert sum(r["observed"] for r in rows) == deaths.where("region is not null").count()
    # Over all regions, the expected are the standard's own deaths.
    cells = pop.groupBy("agegrp", "sex").sum("pop").join(deaths.groupBy("agegrp", "sex").count(), ["agegrp", "sex"])
    regions = {r["region"] for r in pop.select("region").distinct().collect()}
    if regions == {r["region"] for r in rows}:
        assert sum(r["expected"] for r in rows) == pytest.approx(sum(r["count"] for r in cells.collect()))


def _brute(table, log_odds):
    """All tables with the margins, by logarithms of factorials."""
    a, b, c, d = table
    m, k, n = a + b, a + c, a + b + c + d
    x = np.arange(max(0, m + k - n), min(m, k) + 1)
    lg = np.vectorize(math.lgamma)
    w = -(lg(x + 1.0) + lg(m - x + 1.0) + lg(k - x + 1.0) + lg(n - m - k + x + 1.0)) + x * log_odds
    w = np.exp(w - w.max())
    return x, w / w.sum()


@pytest.mark.parametrize("table", [(3, 1, 2, 4), (0, 5, 7, 2), (1200, 800, 700, 600), (100_000, 99_500, 70_000, 70_600), (150_000, 3, 40, 90_000)])
def test_exact_measures_of_any_count(table):
    got = twobytwo.exact_values([table])
    x, p = _brute(table, 0.0)
    a = table[0]
    one = min(p[x <= a].sum(), p[x >= a].sum()) if (p * x).sum() != a else None
    assert got["exact_p_onesided"] == pytest.approx(p[x <= a].sum() if a <= (p * x).sum() else p[x >= a].sum(), rel=1e-5, abs=1e-290)
    assert got["mid_p_onesided"] == pytest.approx(min(p[x < a].sum(), p[x > a].sum()) + p[x == a].sum() / 2, rel=1e-5, abs=1e-290) and one is not None
    # The estimate and limits satisfy their equations.
    for name, equation in {
        "cmle_or": lambda x, p: (p * x).sum() / a - 1, "cmle_or_lower": lambda x, p: p[x >= a].sum() / 0.025 - 1, "cmle_or_upper": lambda x, p: p[x <= a].sum() / 0.025 - 1,
        "midp_or": lambda x, p: (p[x < a].sum() + p[x == a].sum() / 2) / 0.5 - 1, "midp_or_lower": lambda x, p: (p[x > a].sum() + p[x == a].sum() / 2) / 0.025 - 1, "midp_or_upper": lambda x, p: (p[x < a].sum() + p[x == a].sum() / 2) / 0.025 - 1,
    }.items():
        if 0 < got[name] < math.inf:
            assert equation(*_brute(table, math.log(got[name]))) == pytest.approx(0, abs=2e-5)
        else:
            assert name != "cmle_or" or a == x[0]


def test_exact_common_odds_ratio_of_large_strata():
    tables = [(5200, 4800, 4900, 5100), (900, 700, 800, 1000), (30, 2, 1, 4)]
    got = twobytwo.exact_values(tables)
    seen = sum(t[0] for t in tables)

    def spread(log_odds):
        w = np.ones(1)
        first = 0
        for t in tables:
            x, p = _brute(t, log_odds)
            first, w = first + x[0], np.convolve(w, p)
        return first + np.arange(len(w)), w

    x, p = spread(math.log(got["cmle_or"]))
    assert (p * x).sum() == pytest.approx(seen, rel=1e-8)
    x, p = spread(math.log(got["cmle_or_lower"]))
    assert p[x >= seen].sum() == pytest.approx(0.025, rel=1e-5)
    x, p = spread(0.0)
    assert got["exact_p_onesided"] == pytest.approx(p[x >= seen].sum(), rel=1e-5)
    assert math.isnan(twobytwo.exact_values(tables, largest=1000)["cmle_or"])


def test_exact_measures_of_very_large_counts():
    import time

    began = time.perf_counter()
    got = twobytwo.exact_values([(300_000_000, 299_990_000, 200_000_000, 200_050_000)])
    assert got["cmle_or_lower"] < got["cmle_or"] < got["cmle_or_upper"] and got["cmle_or"] == pytest.approx(300_000_000 * 200_050_000 / 299_990_000 / 200_000_000, rel=1e-7)
    assert time.perf_counter() - began < 60
