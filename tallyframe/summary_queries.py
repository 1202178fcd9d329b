"""Queries of summaries, measures and proportions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.meta import ColumnMeta, Dataset
from tallyframe.operators import measures as m
from tallyframe.operators.summarise import coalesce, condcol, order, retain, suppress
from tallyframe.plans.scale import table

CAT, NUM, WGT = ColumnMeta("categorical"), ColumnMeta("scalar"), ColumnMeta("weighting")
#: Fixed value: the marker of marginal rows of whole-number columns in these queries.
ALL = -1


def lineitem(spark: SparkSession, d: str) -> Dataset:
    return Dataset.of(table(spark, d, "lineitem"), "lineitem", l_quantity=WGT, l_linenumber=ColumnMeta("categorical", all_value=ALL))


def orders(spark: SparkSession, d: str) -> Dataset:
    return Dataset.of(table(spark, d, "orders"), "orders")


def nhds(spark: SparkSession, d: str) -> Dataset:
    whole = {c: ColumnMeta("categorical", all_value=ALL) for c in ("sex", "geog_region", "agegrp")}
    return Dataset.of(table(spark, d, "nhds"), "nhds", days_of_care=NUM, analysis_wgt=WGT, age=NUM, **whole)


def shown(ds: Dataset) -> DataFrame:
    """The printed columns; doubles rounded so that sums in another order compare equal."""
    df = ds.df.drop("_condcols_")
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def dense_sql(table: str, keys: list[str], aggregates: dict[str, str], closing: dict[str, str] | None = None, where: str = "TRUE", zeros: bool = False) -> str:
    """Every combination of the keys' values, with aggregates and closing expressions over them."""
    values = [f"(SELECT DISTINCT {k} AS k{i} FROM {table} WHERE {'TRUE' if zeros else where}) v{i}" for i, k in enumerate(keys)]
    names = [k.split(" AS ")[-1] for k in keys]
    on = " AND ".join(f"v{i}.k{i} IS NOT DISTINCT FROM g.{k}" for i, k in enumerate(names))
    last = closing or {a: a for a in aggregates}
    return f"""SELECT {", ".join(f"v{i}.k{i} AS {k}" for i, k in enumerate(names))}, coalesce(n, 0) AS _freq_, {len(keys)} AS _level_, '{"1" * len(keys)}' AS _type_{"".join(f', {e} AS "{k}"' for k, e in last.items())}
FROM {" CROSS JOIN ".join(values)} LEFT JOIN (SELECT {", ".join(keys)}, count(*) AS n{"".join(f", {e} AS {k}" for k, e in aggregates.items())} FROM {table} WHERE {where} GROUP BY {", ".join(map(str, range(1, len(keys) + 1)))}) g ON {on}"""


def cube_sql(table: str, keys: dict[str, str], weight: str = "count(*)", levels: list[int] | None = None) -> str:
    """All groupings of two keys, dense; keys maps a key to the literal of its marginal rows. Columns _freq_ and wt."""
    (a, all_a), (b, all_b) = keys.items()
    sets = [
        (0, "00", f"SELECT {all_a} AS {a}, {all_b} AS {b}, count(*) AS _freq_, {weight} AS wt FROM {table}"),
        (1, "10", f"SELECT {a}, {all_b}, count(*), {weight} FROM {table} GROUP BY {a}"),
        (1, "01", f"SELECT {all_a}, {b}, count(*), {weight} FROM {table} GROUP BY {b}"),
        (2, "11", f"""SELECT x.{a}, y.{b}, coalesce(n, 0), coalesce(w, 0) FROM (SELECT DISTINCT {a} FROM {table}) x CROSS JOIN (SELECT DISTINCT {b} FROM {table}) y
           LEFT JOIN (SELECT {a}, {b}, count(*) AS n, {weight} AS w FROM {table} GROUP BY ALL) g ON g.{a} IS NOT DISTINCT FROM x.{a} AND g.{b} IS NOT DISTINCT FROM y.{b}"""),
    ]
    parts = [f"SELECT {a}, {b}, _freq_, wt, {n} AS _level_, '{t}' AS _type_ FROM ({q}) q({a}, {b}, _freq_, wt)" for n, t, q in sets if levels is None or n in levels]
    return " UNION ALL ".join(parts)


# -- grouping
@query(
    dense_sql(
        "lineitem", ["l_returnflag", "l_linestatus"], {"s": "sum(l_extendedprice)", "c": "count(l_extendedprice)", "lo": "min(l_discount)", "hi": "max(l_discount)", "q": "sum(l_quantity)"},
        {"mean_of_l_extendedprice": "round(s / c, 6)", "minimum_of_l_discount": "lo", "maximum_of_l_discount": "hi", "sum_of_l_quantity": "round(q, 6)", "range_of_l_discount": "round(hi - lo, 6)"},
    )
)
def summ_two_way_dense(spark, d):
    return shown(lineitem(spark, d).summ("l_returnflag", "l_linestatus", m.mean("l_extendedprice"), m.minimum("l_discount"), m.maximum("l_discount"), m.asum("l_quantity"), m.arange("l_discount"), ordered=False))


_ORDER_KEYS = {"o_orderstatus": "'_all_'", "o_orderpriority": "'_all_'"}


@query(f"SELECT * EXCLUDE (wt) FROM ({cube_sql('orders', _ORDER_KEYS)})")
def summ_cube_allcalc(spark, d):
    return shown(orders(spark, d).summ("o_orderstatus", "o_orderpriority", allcalc=True, ordered=False))


@query(f"SELECT * EXCLUDE (wt) FROM ({cube_sql('orders', _ORDER_KEYS, levels=[1])})")
def summ_levels(spark, d):
    return shown(orders(spark, d).summ("o_orderstatus", "o_orderpriority", levels=[1], ordered=False))


@query(f"SELECT * EXCLUDE (wt) FROM ({cube_sql('orders', _ORDER_KEYS, levels=[2])})")
def summ_nomt(spark, d):
    return shown(orders(spark, d).summ("o_orderstatus", "o_orderpriority", allcalc=True, nomt=True, ordered=False))


@query(dense_sql("lineitem", ["l_returnflag", "l_linestatus"], {}, where="l_discount > 0.05 AND l_returnflag <> 'A'"))
def summ_filtered(spark, d):
    return shown(lineitem(spark, d).summ("l_returnflag", "l_linestatus", filterexpr="l_discount > 0.05 and l_returnflag != 'A'", ordered=False))


@query(dense_sql("lineitem", ["l_returnflag", "l_linestatus"], {}, where="l_discount > 0.05 AND l_returnflag <> 'A'", zeros=True))
def summ_zeros_filtered(spark, d):
    return shown(lineitem(spark, d).summ("l_returnflag", "l_linestatus", filterexpr="l_discount > 0.05 and l_returnflag != 'A'", zeros=True, ordered=False))


@query("SELECT count(*) AS _freq_, 0 AS _level_, '' AS _type_, round(sum(l_quantity) / count(l_quantity), 6) AS mean_of_l_quantity FROM lineitem")
def summ_total(spark, d):
    return shown(lineitem(spark, d).summ(m.mean("l_quantity", weight=False), ordered=False))


@query(dense_sql("nhds", ["sex", "geog_region"], {"mi": "count(*) - count(days_of_care)", "nm": "count(days_of_care)"}, {"missing_of_days_of_care": "coalesce(mi, 0)", "nonmissing_of_days_of_care": "coalesce(nm, 0)"}))
def summ_null_group(spark, d):
    return shown(nhds(spark, d).summ("sex", "geog_region", m.missing("days_of_care"), m.nonmissing("days_of_care"), ordered=False))


@query("SELECT t AS diagnosis_all, count(*) AS _freq_, 1 AS _level_, '1' AS _type_ FROM (SELECT unnest(list_distinct(diagnosis_all)) AS t FROM nhds) GROUP BY ALL")
def summ_multivalue(spark, d):
    return shown(Dataset.of(table(spark, d, "nhds"), "nhds", diagnosis_all=CAT).summ("diagnosis_all", ordered=False))


@query(
    """WITH p AS (SELECT sex, unnest(list_distinct(procedure_all)) AS t FROM nhds)
SELECT -1 AS sex, '_all_' AS procedure_all, count(*) AS _freq_, 0 AS _level_, '00' AS _type_ FROM nhds
UNION ALL SELECT sex, '_all_', count(*), 1, '10' FROM nhds GROUP BY sex
UNION ALL SELECT -1, t, count(*), 1, '01' FROM p GROUP BY t
UNION ALL SELECT a.sex, b.t, coalesce(n, 0), 2, '11' FROM (SELECT DISTINCT sex FROM p) a CROSS JOIN (SELECT DISTINCT t FROM p) b
  LEFT JOIN (SELECT sex, t, count(*) AS n FROM p GROUP BY ALL) g ON g.sex IS NOT DISTINCT FROM a.sex AND g.t = b.t"""
)
def summ_multivalue_marginals(spark, d):
    return shown(Dataset.of(table(spark, d, "nhds"), "nhds", procedure_all=CAT, sex=ColumnMeta("categorical", all_value=ALL)).summ("sex", "procedure_all", allcalc=True, ordered=False))


@query("SELECT l_linestatus, count(DISTINCT l_returnflag) AS _freq_, 1 AS _level_, '1' AS _type_, CAST(count(*) AS DOUBLE) AS freq_wgtd_by__freq_ FROM lineitem GROUP BY ALL")
def summ_of_summ(spark, d):
    inner = lineitem(spark, d).summ("l_returnflag", "l_linestatus", ordered=False).filter("_freq_ > 0")
    return shown(inner.summ("l_linestatus", m.freq(), ordered=False))


# -- operations on values
@query("SELECT o_orderstatus, o_orderpriority, count(*) AS _freq_, 2 AS _level_, '11' AS _type_ FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def summ_suppress(spark, d):
    return shown(orders(spark, d).summ(condcol("o_orderstatus", suppress("P")), "o_orderpriority", ordered=False))


@query("SELECT o_orderpriority, count(*) AS _freq_, 1 AS _level_, '1' AS _type_ FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL")
def summ_retain(spark, d):
    return shown(orders(spark, d).summ(condcol("o_orderpriority", retain("1-URGENT", "2-HIGH")), ordered=False))


@query("SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'top' ELSE o_orderpriority END AS o_orderpriority, count(*) AS _freq_, 1 AS _level_, '1' AS _type_, round(avg(o_totalprice), 6) AS mean_of_o_totalprice FROM orders GROUP BY 1")
def summ_coalesce(spark, d):
    return shown(orders(spark, d).summ(condcol("o_orderpriority", coalesce("1-URGENT", "2-HIGH", value="top", label="Top")), m.mean("o_totalprice"), ordered=False))


@query("SELECT left(o_orderpriority, 1) AS o_orderpriority, count(*) AS _freq_, 1 AS _level_, '1' AS _type_ FROM orders GROUP BY 1")
def summ_coalesce_callable(spark, d):
    return shown(orders(spark, d).summ(condcol("o_orderpriority", coalesce(lambda v: v[:1])), ordered=False))


@query("SELECT o_orderpriority, count(*) AS _freq_, 1 AS _level_, '1' AS _type_ FROM orders GROUP BY ALL")
def summ_order(spark, d):
    return shown(orders(spark, d).summ(condcol("o_orderpriority", order("5-LOW", reverse=True))))


# -- proportions
_PROPORTIONS = """SELECT r.o_orderstatus, r.o_orderpriority, r._freq_, r._level_, r._type_{wcol}, round(r.{f} / t.{f}, 6) AS "_prop_of_all-o_orderstatus-o_orderpriority", round(CASE WHEN s.{f} <> 0 THEN r.{f} / s.{f} END, 6) AS "_prop_of_all-o_orderstatus", round(CASE WHEN p.{f} <> 0 THEN r.{f} / p.{f} END, 6) AS "_prop_of_all-o_orderpriority"
FROM ({cube}) r JOIN ({cube}) t ON t._type_ = '00'
JOIN ({cube}) s ON s._type_ = '0' || r._type_[2] AND s.o_orderpriority = r.o_orderpriority
JOIN ({cube}) p ON p._type_ = r._type_[1] || '0' AND p.o_orderstatus = r.o_orderstatus"""


@query(_PROPORTIONS.format(cube=cube_sql("orders", _ORDER_KEYS), f="_freq_", wcol=""))
def summ_proportions(spark, d):
    return shown(orders(spark, d).summ("o_orderstatus", "o_orderpriority", proportions=True, ordered=False))


@query(_PROPORTIONS.format(cube=cube_sql("orders", _ORDER_KEYS, "sum(o_totalprice)"), f="wt", wcol=", round(r.wt, 2) AS freq_wgtd_by_o_totalprice"))
def summ_proportions_weighted(spark, d):
    s = orders(spark, d).summ("o_orderstatus", "o_orderpriority", m.freq(), weightcol="o_totalprice", proportions=True, ordered=False)
    return shown(s).withColumn("freq_wgtd_by_o_totalprice", F.round("freq_wgtd_by_o_totalprice", 2))


# -- measures
@query(
    """SELECT l_returnflag, count(*) AS _freq_, 1 AS _level_, '1' AS _type_, round(var_samp(x), 2) AS samplevar_of_x, round(var_pop(x), 2) AS popvar_of_x, round(stddev_samp(x), 4) AS stddev_of_x,
round(stddev_pop(x), 4) AS popstddev_of_x, round(100 * stddev_samp(x) / avg(x), 6) AS samplecv_of_x, round(100 * stddev_pop(x) / avg(x), 6) AS popcv_of_x, round(stddev_samp(x) / sqrt(count(x)), 6) AS stderr_of_x,
round((avg(x) - 38000) / (stddev_samp(x) / sqrt(count(x))), 6) AS t_of_x, round(exp(avg(ln(x))), 6) AS geomean_of_x FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) GROUP BY ALL"""
)
def summ_moments(spark, d):
    ds = Dataset.of(table(spark, d, "lineitem").withColumnRenamed("l_extendedprice", "x"), "l")
    s = ds.summ("l_returnflag", *[f("x") for f in (m.samplevar, m.popvar, m.stddev, m.popstddev, m.samplecv, m.popcv, m.stderr, m.geomean)], m.studentt("x", muzero=38000), ordered=False)
    return shown(s).withColumns({"samplevar_of_x": F.round("samplevar_of_x", 2), "popvar_of_x": F.round("popvar_of_x", 2), "stddev_of_x": F.round("stddev_of_x", 4), "popstddev_of_x": F.round("popstddev_of_x", 4)})


@query(
    """WITH b AS (SELECT sex, CAST(days_of_care AS DOUBLE) AS x, CASE WHEN days_of_care IS NOT NULL AND analysis_wgt IS NOT NULL THEN CAST(greatest(analysis_wgt, 0) AS DOUBLE) END AS w FROM nhds),
c AS (SELECT sex, CASE WHEN w IS NOT NULL THEN x END AS x, w FROM b), a AS (SELECT sex, count(*) AS n, sum(w * x) / sum(w) AS mu, sum(w) AS sw FROM c GROUP BY sex),
q AS (SELECT c.sex, count(c.x) AS k, sum(w * (x - mu) ^ 2) AS ss FROM c JOIN a ON a.sex IS NOT DISTINCT FROM c.sex GROUP BY ALL),
f AS (SELECT sex, sum(greatest(analysis_wgt, 0)) AS fw FROM nhds GROUP BY ALL)
SELECT a.sex, n AS _freq_, 1 AS _level_, '1' AS _type_, CAST(fw AS DOUBLE) AS freq_wgtd_by_analysis_wgt, round(mu, 6) AS mean_of_days_of_care_wgtd_by_analysis_wgt, round(mu * sw, 6) AS sum_of_days_of_care_wgtd_by_analysis_wgt,
round(ss / (sw - 1), 6) AS samplevar_of_days_of_care_wgtd_by_analysis_wgt, round(ss / sw, 6) AS popvar_of_days_of_care_wgtd_by_analysis_wgt,
round(sqrt(ss / (sw - 1)), 6) AS stddev_of_days_of_care_wgtd_by_analysis_wgt, round(CASE WHEN k > 1 THEN sqrt(ss / (k - 1)) / sqrt(sw) END, 6) AS stderr_of_days_of_care_wgtd_by_analysis_wgt
FROM a JOIN q ON q.sex IS NOT DISTINCT FROM a.sex JOIN f ON f.sex IS NOT DISTINCT FROM a.sex"""
)
def summ_weighted(spark, d):
    s = nhds(spark, d).summ("sex", m.freq(), *[f("days_of_care") for f in (m.mean, m.asum, m.samplevar, m.popvar, m.stddev, m.stderr)], weightcol="analysis_wgt", ordered=False)
    return shown(s)


def _definition(p: float, k: int) -> str:
    at = f"((n + 1) * {p!r})" if k == 4 else f"(n * {p!r})"
    x = lambda e: f"x[CAST(greatest(1, least(n, {e})) AS BIGINT)]"
    j, g = f"floor({at})", f"({at} - floor({at}))"
    if k == 5:
        return f"round(CASE WHEN {g} = 0 THEN ({x(j)} + {x(j + ' + 1')}) / 2 ELSE {x(j + ' + 1')} END, 6)"
    if k == 3:
        return f"CASE WHEN {g} = 0 THEN {x(j)} ELSE {x(j + ' + 1')} END"
    if k == 2:
        return f"CASE WHEN {g} = 0.5 THEN CASE WHEN {j} % 2 = 0 THEN {x(j)} ELSE {x(j + ' + 1')} END ELSE {x(f'floor({at} + 0.5)')} END"
    return f"round(CASE WHEN {j} < 1 THEN {x('1')} ELSE (1 - {g}) * {x(j)} + {g} * {x(j + ' + 1')} END, 6)"


_SORTED = "WITH g AS (SELECT l_returnflag, count(*) AS _freq_, count(l_extendedprice) AS n, list_sort(list(l_extendedprice)) AS x FROM lineitem GROUP BY ALL) SELECT l_returnflag, _freq_, 1 AS _level_, '1' AS _type_"


@query(_SORTED + "".join(f", {_definition(p, 5)} AS {n}_of_l_extendedprice" for n, p in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))) + " FROM g")
def summ_quantiles(spark, d):
    return shown(lineitem(spark, d).summ("l_returnflag", *[f("l_extendedprice") for f in (m.p10, m.p25, m.median, m.p75, m.p90)], ordered=False))


@query(_SORTED + "".join(f", {_definition(p, 2)} AS quantile_{str(p).replace('.', '_')}_def2_of_l_extendedprice" for p in (0.05, 0.5, 0.95)) + " FROM g")
def summ_quantile_list(spark, d):
    return shown(lineitem(spark, d).summ("l_returnflag", m.quantiles("l_extendedprice", (0.05, 0.5, 0.95), defn=2), ordered=False))


@query(
    """WITH v AS (SELECT o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS x FROM orders), g AS (SELECT s, p, count(*) AS n, list_sort(list(x)) AS x FROM v GROUP BY GROUPING SETS ((), (s), (p), (s, p)))
SELECT coalesce(s, '_all_') AS o_orderstatus, coalesce(p, '_all_') AS o_orderpriority, n AS _freq_, (s IS NOT NULL)::INT + (p IS NOT NULL)::INT AS _level_, (s IS NOT NULL)::INT::VARCHAR || (p IS NOT NULL)::INT::VARCHAR AS _type_,
round(CASE WHEN n % 2 = 0 THEN (x[n // 2] + x[n // 2 + 1]) / 2 ELSE x[n // 2 + 1] END, 6) AS median_of_o_totalprice FROM g"""
)
def summ_cube_medians(spark, d):
    return shown(orders(spark, d).summ("o_orderstatus", "o_orderpriority", m.median("o_totalprice"), allcalc=True, ordered=False))


@query(_SORTED + "".join(f", {_definition(0.37, k)} AS quantile_0_37_def{k}_of_l_extendedprice" for k in (1, 2, 3, 4)) + " FROM g")
def summ_quantile_definitions(spark, d):
    return shown(lineitem(spark, d).summ("l_returnflag", *[m.quantile("l_extendedprice", 0.37, defn=k) for k in (1, 2, 3, 4)], ordered=False))


@query(
    """WITH b AS (SELECT l_linestatus, l_extendedprice AS x, sum(l_quantity) OVER w AS cum, sum(l_quantity) OVER (PARTITION BY l_linestatus) AS tot FROM lineitem WINDOW w AS (PARTITION BY l_linestatus ORDER BY l_extendedprice RANGE UNBOUNDED PRECEDING))
SELECT l_linestatus, count(*) AS _freq_, 1 AS _level_, '1' AS _type_, (min(CASE WHEN cum >= 0.5 * tot THEN x END) + min(CASE WHEN cum > 0.5 * tot THEN x END)) / 2 AS median_of_l_extendedprice_wgtd_by_l_quantity FROM b GROUP BY ALL"""
)
def summ_weighted_median(spark, d):
    return shown(lineitem(spark, d).summ("l_linestatus", m.median("l_extendedprice"), weightcol="l_quantity", ordered=False))


@query()
def summ_mean_limits(spark, d):
    return shown(lineitem(spark, d).summ("l_returnflag", m.meancl("l_extendedprice", weight=False), m.freqcl(weight=False), ordered=False))


_BYAR = "{n} * power(1 - 1 / (9.0 * {n}) {s} {z!r} / 3 / sqrt({n}), 3)"


@query(None)
def summ_count_limits_daly(spark, d):
    return shown(orders(spark, d).summ("o_orderpriority", m.freqcl(), ordered=False))


def _z() -> float:
    from tallyframe.functions.special import probit

    return abs(probit(0.025))


@query(
    "SELECT o_orderpriority, n AS _freq_, 1 AS _level_, '1' AS _type_, n AS freqcl, round(greatest(0, " + _BYAR.format(n="n", s="-", z=_z()) + "), 6) AS freqcl_ll, round(" + _BYAR.format(n="(n + 1)", s="+", z=_z()) + ", 6) AS freqcl_ul "
    "FROM (SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL)"
)
def summ_count_limits_byar(spark, d):
    return shown(orders(spark, d).summ("o_orderpriority", m.freqcl(method="byar"), ordered=False)).withColumn("_freq_", F.col("_freq_").cast("double"))


@query("SELECT count(DISTINCT geog_region) + max(CASE WHEN geog_region IS NULL THEN 1 ELSE 0 END) AS cardinality FROM nhds")
def cardinality(spark, d):
    from tallyframe.operators.rowset import cardinality as count

    return count(table(spark, d, "nhds"), "geog_region")


@query("SELECT CAST(least(floor(l_extendedprice / 10000), 9) AS INT) AS bin, floor(least(l_extendedprice / 10000, 9)) * 10000.0 AS bin_low, (floor(least(l_extendedprice / 10000, 9)) + 1) * 10000.0 AS bin_high, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 100000 GROUP BY ALL")
def plot_histogram(spark, d):
    from tallyframe.operators.plotdata import histogram

    return histogram(lineitem(spark, d), "l_extendedprice", 10, 0.0, 100000.0)


@query(_SORTED + f", x[1] AS minimum_of_l_extendedprice, {_definition(0.25, 5)} AS p25_of_l_extendedprice, {_definition(0.5, 5)} AS quantile_0_5_of_l_extendedprice, {_definition(0.75, 5)} AS p75_of_l_extendedprice, x[n] AS maximum_of_l_extendedprice FROM g")
def plot_box(spark, d):
    from tallyframe.operators.plotdata import box_statistics

    return shown(box_statistics(lineitem(spark, d), "l_extendedprice", "l_returnflag"))
