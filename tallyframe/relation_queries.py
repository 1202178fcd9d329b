"""Queries of filters, text search, joins, tables, rates, 2x2 tables, row sets and conversions, and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyframe.functions import dates, intervals
from tallyframe.functions.special import probit
from tallyframe.meta import ColumnMeta, Dataset
from tallyframe.operators import itemsets, joins, measures as m, plotdata, rates, rowset, tables, twobytwo
from tallyframe.plans.scale import table

CAT, ORD, NUM, TEXT = ColumnMeta("categorical"), ColumnMeta("ordinal"), ColumnMeta("scalar"), ColumnMeta("searchabletext")
Z = abs(probit(0.025))
QUERIES = {}
ORACLES = {}


def add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# -- filters: name -> (table, columns out, filter, SQL condition)
_LINE, _NHDS, _PART, _ORDERS = ("lineitem", ["l_orderkey", "l_linenumber"]), ("nhds", ["row_ordinal"]), ("part", ["p_partkey"]), ("orders", ["o_orderkey"])
_ROLES = {"nhds": {"sex": CAT, "geog_region": CAT, "age": NUM, "days_of_care": NUM, "diagnosis1": CAT, "diagnosis_all": CAT, "randomdate": ORD, "row_ordinal": ColumnMeta("row_ordinal")}}
_NOW = dt.date(2002, 6, 5)
FILTERS = {
    "filter_equal": (_LINE, "l_returnflag eq 'R' and l_linenumber equals 3", "l_returnflag = 'R' AND l_linenumber = 3"),
    "filter_not_equal_null": (_NHDS, "sex != 1", "sex IS DISTINCT FROM 1"),
    "filter_less_null": (_NHDS, "sex less than 1", "sex IS NULL OR sex < 1"),
    "filter_less_equal": (_NHDS, "geog_region less than or equal to 2", "geog_region IS NULL OR geog_region <= 2"),
    "filter_greater": (_NHDS, "geog_region gt 3", "coalesce(geog_region > 3, FALSE)"),
    "filter_greater_equal": (_NHDS, "age >= 65", "coalesce(age >= 65, FALSE)"),
    "filter_scalar_null": (_NHDS, "not days_of_care > 5", "NOT coalesce(days_of_care > 5, FALSE)"),
    "filter_in": (_NHDS, "sex in (1, null)", "sex = 1 OR sex IS NULL"),
    "filter_not_in": (_NHDS, "geog_region notin (1, 2)", "geog_region IS NULL OR geog_region NOT IN (1, 2)"),
    "filter_in_prefix": (_NHDS, "diagnosis1 in: ('03*', '7')", "coalesce(starts_with(diagnosis1, '03') OR starts_with(diagnosis1, '7'), FALSE)"),
    "filter_not_in_prefix": (_NHDS, "diagnosis1 notin: ('03', '7')", "NOT coalesce(starts_with(diagnosis1, '03') OR starts_with(diagnosis1, '7'), FALSE)"),
    "filter_prefix": (_PART, "p_brand starting with 'Brand#1'", "starts_with(p_brand, 'Brand#1')"),
    "filter_not_prefix": (_PART, "p_brand !=: 'Brand#1'", "NOT starts_with(p_brand, 'Brand#1')"),
    "filter_prefix_order": (_NHDS, "diagnosis1 >: '4' and diagnosis1 <=: '72'", "coalesce(left(diagnosis1, 1) > '4' AND left(diagnosis1, 2) <= '72', FALSE)"),
    "filter_prefix_less": (_PART, "p_brand lt: 'Brand#3'", "left(p_brand, 7) < 'Brand#3'"),
    "filter_prefix_at_least": (_PART, "p_brand >=: 'Brand#3'", "left(p_brand, 7) >= 'Brand#3'"),
    "filter_prefix_number": (_PART, "p_size eq: 4", "starts_with(CAST(p_size AS VARCHAR), '4')"),
    "filter_between_half_open": (_LINE, "l_quantity between (10, 20)", "l_quantity >= 10 AND l_quantity < 20"),
    "filter_precedence": (_NHDS, "sex = 1 or sex = 2 and not (geog_region = 1 or geog_region = 2)", "coalesce(sex = 1, FALSE) OR (coalesce(sex = 2, FALSE) AND NOT (coalesce(geog_region = 1, FALSE) OR coalesce(geog_region = 2, FALSE)))"),
    "filter_dates": (_NHDS, "randomdate ge date(1998, 2, 1) and randomdate < date 1998-4-1", "coalesce(randomdate >= DATE '1998-02-01' AND randomdate < DATE '1998-04-01', FALSE)"),
    "filter_relative_date": (_NHDS, "randomdate between (reldate(months=-1, align='bom'), reldate(days=-7, align='monday'))", "coalesce(randomdate >= DATE '2002-05-01' AND randomdate < DATE '2002-05-27', FALSE)"),
    "filter_any_element": (_NHDS, "diagnosis_all startswith '03' and diagnosis_all != '037.96'", "len(list_filter(diagnosis_all, lambda x: starts_with(x, '03'))) > 0 AND len(list_filter(diagnosis_all, lambda x: x <> '037.96')) > 0"),
    "filter_no_element": (_NHDS, "not diagnosis_all in: ('0', '1')", "coalesce(len(list_filter(diagnosis_all, lambda x: starts_with(x, '0') OR starts_with(x, '1'))), 0) = 0"),
    "filter_row_ordinal": (_NHDS, "row_ordinal between (100, 200) or row_ordinal in (5, 7)", "(row_ordinal >= 100 AND row_ordinal < 200) OR row_ordinal IN (5, 7)"),
}


def _filtered(target, text):
    name, columns = target

    def run(spark, d):
        ds = Dataset.of(table(spark, d, name), name, **_ROLES.get(name, {}))
        return ds.filter(text, now=_NOW).df.select(*columns)

    return run


for _n, (_t, _text, _sql) in FILTERS.items():
    add(_n, _filtered(_t, _text), f"SELECT {', '.join(_t[1])} FROM {_t[0]} WHERE {_sql}")
add("filter_nested", lambda s, d: Dataset.of(table(s, d, "orders"), "o").filter("o_orderstatus = 'F'").filter("o_totalprice > 100000").df.select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")

# -- text search
_TOKENS = """WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9'']+'), lambda x: upper(replace(x, '''', ''))) AS t FROM documents),
p AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM w), ids AS (SELECT doc_id FROM documents)
"""
_HAS = "doc_id IN (SELECT doc_id FROM p WHERE {})"
_PAIR = "doc_id IN (SELECT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id WHERE a.word = '{}' AND b.word = '{}' AND {})"
SEARCHES = {
    "search_word": ("merge", _HAS.format("word = 'MERGE'")),
    "search_and": ("merge branch", _HAS.format("word = 'MERGE'") + " AND " + _HAS.format("word = 'BRANCH'")),
    "search_or": ("fix | remove", _HAS.format("word IN ('FIX', 'REMOVE')")),
    "search_but_not": ("diff &- index", _HAS.format("word = 'DIFF'") + " AND NOT " + _HAS.format("word = 'INDEX'")),
    "search_wildcard": ("commit* the", _HAS.format("starts_with(word, 'COMMIT')") + " AND " + _HAS.format("word = 'THE'")),
    "search_near": ("index ~[3] mode", _PAIR.format("INDEX", "MODE", "abs(a.pos - b.pos) <= 3")),
    "search_before": ("author < date", _PAIR.format("AUTHOR", "DATE", "b.pos - 10 <= a.pos AND a.pos <= b.pos")),
    "search_after": ("date >[5] from", _PAIR.format("DATE", "FROM", "b.pos <= a.pos AND a.pos <= b.pos + 5")),
    "search_phrase": ('"diff git"', _PAIR.format("DIFF", "GIT", "b.pos = a.pos + 1")),
    "search_mixed": ('(author | from) < (date | subject) - merge', "doc_id IN (SELECT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id WHERE a.word IN ('AUTHOR', 'FROM') AND b.word IN ('DATE', 'SUBJECT') AND b.pos - 10 <= a.pos AND a.pos <= b.pos) AND NOT " + _HAS.format("word = 'MERGE'")),
}


def _searched(text):
    return lambda spark, d: Dataset.of(table(spark, d, "documents").select("doc_id", "text"), "documents", text=TEXT).filter(f"text contains [[{text}]]").df.select("doc_id")


for _n, (_text, _sql) in SEARCHES.items():
    add(_n, _searched(_text), f"{_TOKENS} SELECT doc_id FROM ids WHERE {_sql}")


def _by_postings(text):
    def run(spark, d):
        from tallyframe.plans import textsearch

        return textsearch.search_postings(textsearch.postings(table(spark, d, "documents"), "doc_id", "text"), "doc_id", textsearch.parse(text))

    return run


for _n in ("search_mixed", "search_phrase", "search_wildcard", "search_but_not"):
    add(_n.replace("search_", "postings_"), _by_postings(SEARCHES[_n][0]), ORACLES[_n])


def search_highlight(spark, d):
    from tallyframe.plans import textsearch

    node = textsearch.parse("merge")
    docs = table(spark, d, "documents").where(textsearch.matches(node, F.col("text")))
    return docs.select("doc_id", F.md5(textsearch.highlight(node, F.col("text"))).alias("marked"))


add("search_highlight", search_highlight)

# -- joins and tables
add(
    "join_inner_renamed",
    lambda s, d: joins.inner_join(table(s, d, "orders"), ["o_custkey=custkey"], ["o_orderkey", "o_totalprice=price"], table(s, d, "customer"), ["c_custkey=custkey"], ["c_mktsegment=segment"]),
    "SELECT o_custkey AS custkey, o_orderkey, o_totalprice AS price, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey",
)
add(
    "join_left_default",
    lambda s, d: joins.left_outer_join(table(s, d, "customer"), ["c_custkey=k"], ["c_name"], table(s, d, "orders").where("o_totalprice > 400000"), ["o_custkey=k"], ["o_orderkey", "o_orderstatus"], {"o_orderkey": -1, "o_orderstatus": "none"}),
    "SELECT c_custkey AS k, c_name, coalesce(o_orderkey, -1) AS o_orderkey, coalesce(o_orderstatus, 'none') AS o_orderstatus FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey",
)


def _deaths(spark, d, *known):
    """Deaths counted by age group, sex and year; rows without them, or without another column that must be known, are no cells."""
    df = table(spark, d, "syndeath").where(" and ".join(f"{c} is not null" for c in ("agegrp", "sex", "year", *known)))
    counted = df.groupBy("agegrp", "sex", "year").agg(F.count(F.lit(1)).alias("_freq_"))
    return Dataset.of(counted, "deaths", agegrp=CAT, sex=CAT, year=CAT, _freq_=NUM)


def _add_deaths(name, run, sql):
    """name as its SQL has it, without the deaths of unknown region; name_all with them."""
    add(name, lambda s, d: run(s, d, "region"), sql)
    add(f"{name}_all", run, sql.replace(" AND region IS NOT NULL", ""))


def _population(spark, d):
    df = table(spark, d, "synpop").withColumnRenamed("pop", "_freq_")
    return Dataset.of(df, "pop", agegrp=CAT, sex=CAT, region=CAT, year=CAT, _freq_=NUM)


def _standard(spark, d):
    return Dataset.of(table(spark, d, "aus01stdpop_mf").withColumnRenamed("pop", "_stdpop_"), "std", agegrp=CAT, sex=CAT, _stdpop_=NUM)


add("align_collapse", lambda s, d: tables.collapse(_population(s, d).df, ["agegrp", "year"], ["_freq_"]), "SELECT agegrp, year, CAST(sum(pop) AS DOUBLE) AS _freq_ FROM synpop GROUP BY ALL")
_add_deaths(
    "align_join",
    lambda s, d, *known: tables.aligned(_deaths(s, d, *known).df, ["agegrp", "sex", "year"], _population(s, d), "_freq_", "pop"),
    """SELECT agegrp, sex, year, _freq_, pop FROM (SELECT agegrp, sex, year, count(*) AS _freq_ FROM syndeath WHERE agegrp IS NOT NULL AND sex IS NOT NULL AND year IS NOT NULL AND region IS NOT NULL GROUP BY ALL)
LEFT JOIN (SELECT agegrp, sex, year, CAST(sum(pop) AS DOUBLE) AS pop FROM synpop GROUP BY ALL) USING (agegrp, sex, year)""",
)
add(
    "align_replicate",
    lambda s, d: tables.replicate(tables.collapse(_standard(s, d).df, ["sex"], ["_stdpop_"]), {"region": table(s, d, "synpop").select("region").distinct()}),
    "SELECT sex, region, s AS _stdpop_ FROM (SELECT sex, CAST(sum(pop) AS DOUBLE) AS s FROM aus01stdpop_mf GROUP BY sex) CROSS JOIN (SELECT DISTINCT region FROM synpop)",
)
_add_deaths(
    "crosstab_dense",
    lambda s, d, *known: tables.crosstab(_deaths(s, d, *known)).df,
    """WITH c AS (SELECT agegrp, sex, year, count(*) AS _freq_ FROM syndeath WHERE agegrp IS NOT NULL AND sex IS NOT NULL AND year IS NOT NULL AND region IS NOT NULL GROUP BY ALL)
SELECT a.agegrp, b.sex, y.year, c._freq_ FROM (SELECT DISTINCT agegrp FROM c) a CROSS JOIN (SELECT DISTINCT sex FROM c) b CROSS JOIN (SELECT DISTINCT year FROM c) y LEFT JOIN c ON c.agegrp = a.agegrp AND c.sex = b.sex AND c.year = y.year""",
)
add(
    "crosstab_pivot",
    lambda s, d: tables.pivot_table(Dataset.of(table(s, d, "orders"), "orders").summ("o_orderstatus", "o_orderpriority", ordered=False), ["o_orderpriority"], "o_orderstatus", "_freq_", ["F", "O", "P", "X"]),
    "SELECT o_orderpriority, " + ", ".join(f"nullif(count_if(o_orderstatus = '{x}'), 0) AS {x}" for x in "FOPX") + " FROM orders GROUP BY ALL",
)

# -- rates
_CELLS = """WITH e AS (SELECT agegrp, sex, year, count(*) AS d FROM syndeath WHERE agegrp IS NOT NULL AND sex IS NOT NULL AND year IS NOT NULL AND region IS NOT NULL GROUP BY ALL),
p AS (SELECT agegrp, sex, year, CAST(sum(pop) AS DOUBLE) AS p FROM synpop GROUP BY ALL),
s AS (SELECT agegrp, sex, pop AS s, sum(pop) OVER (PARTITION BY sex) AS st FROM aus01stdpop_mf WHERE agegrp IN (SELECT agegrp FROM e) AND sex IN (SELECT sex FROM e)),
c AS (SELECT e.*, CASE WHEN p > 0 THEN p END AS p, s / st AS w FROM e LEFT JOIN p USING (agegrp, sex, year) LEFT JOIN s USING (agegrp, sex)) """


def _rounded(df, *drop):
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in drop])


def rate_direct(spark, d, *known):
    out = rates.direct_rates(_deaths(spark, d, *known), _population(spark, d), _standard(spark, d)).df
    return _rounded(out, "cr_ll", "cr_ul", "dsr_ll", "dsr_ul")


_add_deaths(
    "rate_direct",
    rate_direct,
    _CELLS + """SELECT sex, year, CAST(sum(d) AS DOUBLE) AS summfreq, sum(p) AS popfreq, round(sum(d) / sum(p) * 100000, 6) AS cr,
CAST(sum(CASE WHEN w IS NOT NULL THEN d END) AS DOUBLE) AS std_strata_summfreq, round(sum(d * w / p) * 100000, 6) AS dsr FROM c GROUP BY ALL""",
)
add("rate_direct_limits", lambda s, d: _rounded(rates.direct_rates(_deaths(s, d), _population(s, d), _standard(s, d)).df))
add("rate_direct_limits_ff", lambda s, d: _rounded(rates.direct_rates(_deaths(s, d), _population(s, d), _standard(s, d), ci_method="ff").df))
_add_deaths(
    "rate_crude",
    lambda s, d, *known: _rounded(rates.direct_rates(_deaths(s, d, *known), _population(s, d), conflev=None).df),
    _CELLS + "SELECT sex, year, CAST(sum(d) AS DOUBLE) AS summfreq, sum(p) AS popfreq, round(sum(d) / sum(p) * 100000, 6) AS cr FROM c GROUP BY ALL",
)
_add_deaths(
    "rate_stratified",
    lambda s, d, *known: _rounded(rates.stratified_rates(_deaths(s, d, *known), _population(s, d), conflev=None).df),
    _CELLS + "SELECT agegrp, sex, year, CAST(d AS DOUBLE) AS summfreq, p AS popfreq, round(d / p * 100000, 6) AS sr FROM c",
)
add("rate_stratified_limits", lambda s, d: _rounded(rates.stratified_rates(_deaths(s, d), _population(s, d)).df))


def _indirect(spark, d, conflev, *known):
    return _rounded(_indirect_df(spark, d, conflev, *known))


def _indirect_df(spark, d, conflev, *known):
    """Deaths without what they are counted by, or without another column that must be known, are left out."""
    base = table(spark, d, "syndeath")
    count = lambda *k: base.where(" and ".join(f"{c} is not null" for c in (*k, *known))).groupBy(*k).agg(F.count(F.lit(1)).alias("_freq_"))
    events = Dataset.of(count("region"), "events", region=CAT, _freq_=NUM)
    std = Dataset.of(count("agegrp", "sex"), "stdevents", agegrp=CAT, sex=CAT, _freq_=NUM)
    return rates.indirect_ratios(events, _population(spark, d), std, _population(spark, d), conflev).df


add(
    "rate_indirect",
    lambda s, d: _indirect(s, d, None, "agegrp", "sex", "year", "region"),
    """WITH b AS (SELECT * FROM syndeath WHERE agegrp IS NOT NULL AND sex IS NOT NULL AND year IS NOT NULL AND region IS NOT NULL),
r AS (SELECT agegrp, sex, n / p AS rate FROM (SELECT agegrp, sex, count(*) AS n FROM b GROUP BY ALL) JOIN (SELECT agegrp, sex, CAST(sum(pop) AS DOUBLE) AS p FROM synpop GROUP BY ALL) USING (agegrp, sex)),
x AS (SELECT region, sum(p) AS popfreq, sum(p * rate) AS expected FROM (SELECT agegrp, sex, region, CAST(sum(pop) AS DOUBLE) AS p FROM synpop GROUP BY ALL) JOIN r USING (agegrp, sex) GROUP BY region)
SELECT region, popfreq, CAST(n AS DOUBLE) AS observed, round(expected, 6) AS expected, round(n / expected * 100, 6) AS isr FROM (SELECT region, count(*) AS n FROM b GROUP BY region) LEFT JOIN x USING (region)""",
)
add(
    "rate_indirect_all",
    lambda s, d: _indirect(s, d, None),
    ORACLES["rate_indirect"].replace(" WHERE agegrp IS NOT NULL AND sex IS NOT NULL AND year IS NOT NULL AND region IS NOT NULL", "").replace("FROM b GROUP BY region", "FROM b WHERE region IS NOT NULL GROUP BY region"),
)
add("rate_indirect_limits", lambda s, d: _indirect(s, d, 0.95))

# -- intervals of proportions and rates: long stays among discharges, by region
_LONG = "SELECT geog_region, CAST(count_if(days_of_care > 7) AS DOUBLE) AS x, CAST(count(days_of_care) AS DOUBLE) AS n FROM nhds WHERE geog_region BETWEEN 1 AND 4 GROUP BY ALL"


def _long_stays(spark, d):
    df = table(spark, d, "nhds").where("geog_region between 1 and 4")
    return df.groupBy("geog_region").agg(F.sum(F.when(F.col("days_of_care") > 7, 1.0).otherwise(0.0)).alias("x"), F.count("days_of_care").cast("double").alias("n"))


def _limits(kind, method):
    make = {"prop": intervals.proportion_limits, "rate": intervals.rate_limits}[kind]

    def run(spark, d):
        df = _long_stays(spark, d).withColumn("l", make(F.col("x"), F.col("n"), method=method))
        return df.select("geog_region", "x", "n", F.round("l.lower", 9).alias("lower"), F.round("l.upper", 9).alias("upper"))

    return run


_WALD = "sqrt({p} * (1 - {p}) / {n}) * {z!r}"
_P2 = f"((x + {Z * Z / 2!r}) / (n + {Z * Z!r}))"
_FL = "((2 * x + {zz!r} {s} 1) {s} {z!r} * sqrt({zz!r} {t} (2 {u} 1 / n) + 4 * x / n * (n * (1 - x / n) {t2} 1))) / (2 * (n + {zz!r}))"
_CLOSED = {
    ("prop", "wald"): ("x / n - " + _WALD.format(p="(x / n)", n="n", z=Z), "x / n + " + _WALD.format(p="(x / n)", n="n", z=Z)),
    ("prop", "modwald"): (f"{_P2} - " + _WALD.format(p=_P2, n=f"(n + {Z * Z!r})", z=Z), f"{_P2} + " + _WALD.format(p=_P2, n=f"(n + {Z * Z!r})", z=Z)),
    ("prop", "wilsonscore"): tuple(f"(x / n + {Z * Z / 2!r} / n {s} {Z!r} * sqrt((x / n * (1 - x / n) + {Z * Z / 4!r} / n) / n)) / (1 + {Z * Z!r} / n)" for s in "-+"),
    ("prop", "fleissquadratic"): (_FL.format(zz=Z * Z, z=Z, s="-", t="-", u="+", t2="+"), _FL.format(zz=Z * Z, z=Z, s="+", t="+", u="-", t2="-")),
    ("rate", "rg"): tuple(f"x / n * exp({s}{Z!r} / sqrt(x)) * 100000" for s in "-+"),
    ("rate", "normal"): tuple(f"(x / n {s} {Z!r} * sqrt(x) / n) * 100000" for s in "-+"),
    ("rate", "byar"): (f"x * power(1 - 1 / (9 * x) - {Z!r} / 3 / sqrt(x), 3) / n * 100000", f"(x + 1) * power(1 - 1 / (9 * (x + 1)) + {Z!r} / 3 / sqrt(x + 1), 3) / n * 100000"),
}
for (_k, _m), (_lo, _hi) in _CLOSED.items():
    add(f"{_k}_limits_{_m}", _limits(_k, _m), f"SELECT geog_region, x, n, round({_lo}, 9) AS lower, round({_hi}, 9) AS upper FROM ({_LONG})")
for _k, _m in (("prop", "geigy"), ("prop", "exact"), ("prop", "blaker"), ("rate", "daly")):
    add(f"{_k}_limits_{_m}", _limits(_k, _m))
add(
    "normal_functions",
    lambda s, d: table(s, d, "region").select("r_regionkey", F.round(intervals.normal_cdf_column(F.col("r_regionkey").cast("double")), 9).alias("cdf"), F.round(intervals.probit_column((F.col("r_regionkey") + 1) / 10), 9).alias("quantile")),
)

# -- 2x2xk: long stay among older patients, by sex
_STRATA = "SELECT geog_region, " + ", ".join(
    f"CAST(count_if({e} AND {o}) AS DOUBLE) AS {x}" for x, e, o in (("a", "age >= 65", "days_of_care > 7"), ("b", "NOT age >= 65", "days_of_care > 7"), ("c", "age >= 65", "NOT days_of_care > 7"), ("d", "NOT age >= 65", "NOT days_of_care > 7"))
) + " FROM nhds WHERE age IS NOT NULL AND days_of_care IS NOT NULL AND geog_region BETWEEN 1 AND 4 GROUP BY ALL"


def _strata(spark, d):
    df = table(spark, d, "nhds").where("geog_region between 1 and 4")
    return twobytwo.strata_from_rows(df, F.col("age") >= 65, F.col("days_of_care") > 7, ["geog_region"])


_MEASURES = {
    "cs": "t * (a * d - b * c) ^ 2 / (c1 * c2 * r1 * r2)", "csc": "t * (abs(a * d - b * c) - t / 2) ^ 2 / (c1 * c2 * r1 * r2)", "mhcs": "(t - 1) * (a * d - b * c) ^ 2 / (c1 * c2 * r1 * r2)",
    "risk_exposed": "a / c1", "risk_unexposed": "b / c2", "risk_overall": "r1 / t", "rr": "(a / c1) / (b / c2)", "rr_lower": f"(a / c1) / (b / c2) * exp(-{Z!r} * sqrt((1 - a / c1) / a + (1 - b / c2) / b))",
    "rd": "a / c1 - b / c2", "rd_upper": f"a / c1 - b / c2 + {Z!r} * sqrt(a * c / c1 ^ 3 + b * d / c2 ^ 3)", "oddsratio": "a * d / (b * c)", "or_upper": f"a * d / (b * c) * exp({Z!r} * sqrt(1 / a + 1 / b + 1 / c + 1 / d))",
    "aefe": "1 - 1 / ((a / c1) / (b / c2))", "aefp": "(r1 / t - b / c2) / (r1 / t)", "pfe": "1 - (a / c1) / (b / c2)", "pfp": "(b / c2 - r1 / t) / (b / c2)",
    "aefeor": "1 - 1 / (a * d / (b * c))", "aefpor": "(c / r2) * (a * d / (b * c) - 1) / ((c / r2) * (a * d / (b * c) - 1) + 1)", "pfeor": "1 - a * d / (b * c)", "pfpor": "(c / r2) * (1 - a * d / (b * c))",
}
add(
    "twobytwo_stratum",
    lambda s, d: twobytwo.stratum_measures(_strata(s, d)).select("geog_region", *"abcd", *[F.round(k, 6).alias(k) for k in _MEASURES]),
    f"WITH q AS (SELECT *, a + b AS r1, c + d AS r2, a + c AS c1, b + d AS c2, a + b + c + d AS t FROM ({_STRATA})) SELECT geog_region, a, b, c, d, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in _MEASURES.items()) + " FROM q",
)
_ADJUSTED = {
    "mh_uncorrected_chisq": "sum((a * d - b * c) / t) ^ 2 / sum(n0 * n1 * m0 * m1 / ((t - 1) * t ^ 2))", "rr_direct": "exp(sum(wr * lr) / sum(wr))", "rd_direct": "sum(wd * rd) / sum(wd)", "or_direct": "exp(sum(wo * lo) / sum(wo))",
    "rr_mh": "sum(a * n0 / t) / sum(b * n1 / t)", "or_mh": "sum(a * d / t) / sum(b * c / t)",
    "or_mh_lower": f"sum(a * d / t) / sum(b * c / t) * exp(-{Z!r} * sqrt(sum((a + d) / t * a * d / t) / (2 * sum(a * d / t) ^ 2) + sum((a + d) / t * b * c / t + (b + c) / t * a * d / t) / (2 * sum(a * d / t) * sum(b * c / t)) + sum((b + c) / t * b * c / t) / (2 * sum(b * c / t) ^ 2)))",
    "bd_chisq_or": "sum(wo * lo * lo) - sum(wo * lo) ^ 2 / sum(wo)", "bd_chisq_rr": "sum(wr * lr * lr) - sum(wr * lr) ^ 2 / sum(wr)",
}
add(
    "twobytwo_adjusted",
    lambda s, d: twobytwo.adjusted_measures(_strata(s, d)).select("n_strata", *[F.round(k, 6).alias(k) for k in _ADJUSTED]),
    f"""WITH q AS (SELECT *, a + b AS m1, c + d AS m0, a + c AS n1, b + d AS n0, a + b + c + d AS t FROM ({_STRATA})),
v AS (SELECT *, ln(a / n1 / (b / n0)) AS lr, 1 / (c / (a * n1) + d / (b * n0)) AS wr, a / n1 - b / n0 AS rd, 1 / (a * c / n1 ^ 3 + b * d / n0 ^ 3) AS wd, ln(a * d / (b * c)) AS lo, 1 / (1 / a + 1 / b + 1 / c + 1 / d) AS wo FROM q)
SELECT count(*) AS n_strata, """ + ", ".join(f"round({e}, 6) AS {k}" for k, e in _ADJUSTED.items()) + " FROM v",
)
add("twobytwo_stratum_exact", lambda s, d: _rounded(twobytwo.stratum_exact(_strata(s, d))))
add("twobytwo_adjusted_exact", lambda s, d: _rounded(twobytwo.adjusted_exact(_strata(s, d))))
add("twobytwo_adjusted_tests", lambda s, d: _rounded(twobytwo.adjusted_measures(_strata(s, d))))

# -- row sets
_CUST, _SUPP = (lambda s, d: table(s, d, "customer").select("c_nationkey")), (lambda s, d: table(s, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))
_CS, _SS = "SELECT c_nationkey AS v FROM customer", "SELECT s_nationkey AS v FROM supplier WHERE s_acctbal > 5000"
add("set_unique", lambda s, d: rowset.unique(_CUST(s, d)), f"SELECT DISTINCT v FROM ({_CS})")
add("set_union", lambda s, d: rowset.union(_CUST(s, d), _SUPP(s, d)), f"{_CS} UNION {_SS}")
add("set_intersect", lambda s, d: rowset.intersect(_CUST(s, d), _SUPP(s, d)), f"{_CS} INTERSECT {_SS}")
add("set_difference", lambda s, d: rowset.difference(_CUST(s, d), _SUPP(s, d)), f"{_CS} EXCEPT {_SS}")
add("set_outersect", lambda s, d: rowset.outersect(_CUST(s, d), _SUPP(s, d)), f"(({_CS}) UNION ({_SS})) EXCEPT (({_CS}) INTERSECT ({_SS}))")
add(
    "value_positions",
    lambda s, d: rowset.value_positions(rowset.with_ordinals(table(s, d, "orders"), ["o_orderkey"]), table(s, d, "lineitem").where("l_quantity = 50").select("l_orderkey"), "o_orderkey"),
    "SELECT pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)",
)
_RANKED = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_ordinal FROM orders"
add("slice", lambda s, d: rowset.slice_rows(rowset.with_ordinals(table(s, d, "orders"), ["o_orderkey"]), 10, 500, 7).select("o_orderkey", "row_ordinal"), f"SELECT * FROM ({_RANKED}) WHERE row_ordinal BETWEEN 10 AND 499 AND (row_ordinal - 10) % 7 = 0")
add("page", lambda s, d: rowset.page(rowset.with_ordinals(table(s, d, "orders"), ["o_orderkey"]), 3, 50).select("o_orderkey", "row_ordinal"), f"SELECT * FROM ({_RANKED}) WHERE row_ordinal BETWEEN 150 AND 199")
add("take_rows", lambda s, d: rowset.take_rows(rowset.with_ordinals(table(s, d, "orders"), ["o_orderkey"]), [0, 3, 3, 700, -1]).select("o_orderkey", "row_ordinal"), f"SELECT * FROM ({_RANKED}) WHERE row_ordinal IN (0, 3, 700)")
for _m in ("sparse", "dense"):
    add(f"set_intersect_{_m}", lambda s, d, m=_m: rowset.intersect_by(_CUST(s, d), _SUPP(s, d), m), f"{_CS} INTERSECT {_SS}")
add("sample_exact", lambda s, d: rowset.sample_rows(rowset.with_ordinals(table(s, d, "orders"), ["o_orderkey"]), 0.1).select("o_orderkey"))
add("sample_size", lambda s, d: rowset.sample_rows(rowset.with_ordinals(table(s, d, "orders"), ["o_orderkey"]), 0.1).agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(floor(count(*) * 0.1) AS BIGINT) AS n FROM orders")

# -- projections and conversions
add("age_bands", lambda s, d: table(s, d, "nhds").select("row_ordinal", dates.age_group(F.col("age")).alias("band")), "SELECT row_ordinal, CASE WHEN age >= 0 THEN CAST(least(floor(age / 5) + 1, 18) AS INT) END AS band FROM nhds")
add(
    "derived_column",
    lambda s, d: Dataset.of(table(s, d, "lineitem"), "l").derive("net", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), NUM).summ("l_returnflag", m.maximum("net"), ordered=False).df.select("l_returnflag", "_freq_", "maximum_of_net"),
    "SELECT l_returnflag, count(*) AS _freq_, max(round(l_extendedprice * (1 - l_discount), 4)) AS maximum_of_net FROM lineitem GROUP BY ALL",
)
add(
    "zip_columns",
    lambda s, d: Dataset.of(table(s, d, "nhds"), "n").zip_columns("codes", ["procedure1", "procedure2", "procedure3", "procedure4"]).summ("codes", ordered=False).df.select("codes", "_freq_"),
    "SELECT c AS codes, count(*) AS _freq_ FROM (SELECT unnest(list_distinct(list_filter([procedure1, procedure2, procedure3, procedure4], lambda x: x IS NOT NULL))) AS c FROM nhds) GROUP BY ALL",
)
add(
    "output_labels",
    lambda s, d: Dataset.of(table(s, d, "nhds"), "n", sex=ColumnMeta("categorical", labels={1: "male", 2: "female", None: "unknown"})).translated("row_ordinal", "sex"),
    "SELECT row_ordinal, coalesce(CASE sex WHEN 1 THEN 'male' WHEN 2 THEN 'female' END, CAST(sex AS VARCHAR), 'unknown') AS sex FROM nhds",
)
add(
    "dates_parse",
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "d/M/yy").alias("t")).select("o_orderkey", dates.parse_date(F.col("t")).alias("day")),
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders",
)
add(
    "dates_format",
    lambda s, d: table(s, d, "nhds").select("row_ordinal", dates.ddmmyyyy(F.col("randomdate")).alias("short"), dates.fulldate(F.col("randomdate")).alias("long")),
    "SELECT row_ordinal, coalesce(strftime(randomdate, '%d/%m/%Y'), 'All date/times') AS short, coalesce(strftime(randomdate, '%A, %d %B %Y'), 'All date/times') AS long FROM nhds",
)

add(
    "dates_datetime",
    lambda s, d: table(s, d, "events").select("event_id", dates.parse_datetime(F.date_format("ts", "d/M/yyyy HH:mm:ss")).alias("at"), dates.parse_time(F.date_format("ts", "HH:mm:ss"), "HH:MM:SS").alias("seconds")),
    "SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS at, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS DOUBLE) AS seconds FROM events",
)
add(
    "dates_ticks",
    lambda s, d: table(s, d, "region").select("r_regionkey", F.explode(dates.date_ticks(F.lit(dt.date(1998, 1, 15)), F.date_add(F.lit(dt.date(1998, 6, 1)), F.col("r_regionkey").cast("int") * 30))).alias("tick")),
    "SELECT r_regionkey, CAST(unnest(generate_series(DATE '1998-01-01', CAST(DATE '1998-06-01' + CAST(r_regionkey * 30 AS INT) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS tick FROM region",
)
add(
    "frequent_sets",
    lambda s, d: _pairs_of(s, d),
    """WITH t AS (SELECT row_ordinal, unnest(list_distinct(procedure_all)) AS p FROM nhds WHERE procedure_all IS NOT NULL), n AS (SELECT count(*) AS n FROM nhds)
SELECT a.p AS first, b.p AS second, count(*) AS n_rows FROM t a JOIN t b ON a.row_ordinal = b.row_ordinal AND a.p < b.p GROUP BY ALL HAVING count(*) >= 0.002 * (SELECT n FROM n)""",
)
add(
    "plot_scatter_matrix",
    lambda s, d: plotdata.scatter_matrix(Dataset.of(table(s, d, "lineitem"), "l"), ["l_quantity", "l_discount", "l_tax"], 4),
    "WITH e AS (SELECT min(l_quantity) AS a0, max(l_quantity) AS a1, min(l_discount) AS b0, max(l_discount) AS b1, min(l_tax) AS c0, max(l_tax) AS c1 FROM lineitem), g AS (SELECT "
    + ", ".join(f"CAST(least(floor((CAST({c} AS DOUBLE) - {k}0) * 4 / ({k}1 - {k}0)), 3) AS INT) AS {k}" for c, k in (("l_quantity", "a"), ("l_discount", "b"), ("l_tax", "c")))
    + " FROM lineitem, e) "
    + " UNION ALL ".join(f"SELECT '{x}' AS x_column, '{y}' AS y_column, {i} AS x_bin, {j} AS y_bin, count(*) AS n FROM g GROUP BY ALL" for x, y, i, j in (("l_quantity", "l_discount", "a", "b"), ("l_quantity", "l_tax", "a", "c"), ("l_discount", "l_tax", "b", "c"))),
)
add(
    "crosstab_banners",
    lambda s, d: tables.pivot_table(_marked(s, d), ["l_returnflag"], ["l_linestatus"], "_freq_", [["F", "O"]], marginals="after").select("l_returnflag", "F", "O", F.col("all").alias("whole")),
    """WITH c AS (SELECT l_returnflag, count_if(l_linestatus = 'F') AS F, count_if(l_linestatus = 'O') AS O, count(*) AS whole FROM lineitem GROUP BY ALL)
SELECT * FROM c UNION ALL SELECT '_all_', CAST(sum(F) AS BIGINT), CAST(sum(O) AS BIGINT), CAST(sum(whole) AS BIGINT) FROM c""",
)


def _pairs_of(spark, d):
    found = itemsets.frequent_sets(table(spark, d, "nhds"), "procedure_all", 0.002)
    return found.where(F.size("items") == 2).select(F.col("items")[0].alias("first"), F.col("items")[1].alias("second"), "n_rows")


def _marked(spark, d):
    return Dataset.of(table(spark, d, "lineitem"), "l").summ("l_returnflag", "l_linestatus", allcalc=True, ordered=False)


def stream_windows(spark, d):
    from tallyframe.streaming.summaries import windowed_summary

    out = windowed_summary(Dataset.of(table(spark, d, "events"), "events", value=NUM), "ts", "1 day", m.mean("value"), m.maximum("value"), keys=("event_type",))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "_freq_", F.round("mean_of_value", 6).alias("mean_of_value"), "maximum_of_value")


add("stream_windows", stream_windows, "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS _freq_, round(avg(value), 6) AS mean_of_value, max(value) AS maximum_of_value FROM events GROUP BY ALL")
