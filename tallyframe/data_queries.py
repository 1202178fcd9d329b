"""Queries of the general data problems (rejected rows, hot keys, profiles) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.operators.keyed_stats import heavy_keys, keyed_stats
from tallyframe.operators.parse_rows import rejected_rows, typed_rows
from tallyframe.operators.profile import DIGIT, LOWER, NHDS_RULES, UPPER, ColumnRule, ProfileSpec, issues, mask_issues, mask_profile, mined_masks, profile
from tallyframe.plans.scale import table

SPEC = ProfileSpec("load_id", NHDS_RULES)


def clean_code(name: str):
    """A code without surrounding blanks, in capitals; null if nothing is left."""
    return F.nullif(F.upper(F.trim(F.col(name))), F.lit(""))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected_rows(table(spark, d, "aus01stdpop_mf_raw"))


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    return typed_rows(table(spark, d, "aus01stdpop_mf_raw"))


def _by_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nhds").select(clean_code("diagnosis1").alias("diagnosis1"), "sex", "days_of_care")
    return keyed_stats(rows, ["diagnosis1", "sex"], "days_of_care", (0.1, 0.25, 0.5, 0.75, 0.9))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    heavy = heavy_keys(_by_diagnosis(spark, d))
    return heavy.where("diagnosis1 is not null and sex is not null").select("diagnosis1", "sex")


def p4_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _by_diagnosis(spark, d)
    return s.select("diagnosis1", "sex", "n_rows", "n_value", "sum_value", F.round("mean_value", 6).alias("mean_value"), "min_value", "max_value", "q10", "q25", "q50", "q75", "q90")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = issues(mask_profile(table(spark, d, "nhds"), SPEC), SPEC)
    return found.select(F.col("load").alias("load_id"), "column_name", "issue")


def _every_column(nhds: DataFrame) -> ProfileSpec:
    known = {r.name: r for r in NHDS_RULES}
    return ProfileSpec("load_id", tuple(known.get(c, ColumnRule(c)) for c in nhds.columns))


def _shown(profiled: DataFrame) -> DataFrame:
    return profiled.select(
        F.col("load").alias("load_id"), "column_name", "n_rows", "n_null", "n_distinct", "min_value", "max_value", "min_text", "max_text", "n_out_of_range", "n_contradicting",
        "dominant_mask", "n_masks", "n_rare_mask", F.round("shift", 9).alias("shift"), F.round("mask_shift", 9).alias("mask_shift"),
    )


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of nhds; distinct values by sketch (standard error 1.6 %)."""
    nhds = table(spark, d, "nhds")
    return _shown(profile(nhds, _every_column(nhds)))


EXACT = ProfileSpec("load_id", (*NHDS_RULES, ColumnRule("diagnosis1"), ColumnRule("sex")), distinct="exact")


def p6_exact(spark: SparkSession, d: str) -> DataFrame:
    """Columns of codes and of the rules; distinct values counted."""
    return _shown(profile(table(spark, d, "nhds"), EXACT))


def p6_masks(spark: SparkSession, d: str) -> DataFrame:
    """Every mask of every column in every load, with the rare ones marked."""
    nhds = table(spark, d, "nhds")
    return mined_masks(nhds, _every_column(nhds)).select(F.col("load").alias("load_id"), "column_name", "mask", "n", "role")


def p6_mask_issues(spark: SparkSession, d: str) -> DataFrame:
    """What masks alone say of the columns of codes and of the rules."""
    return mask_issues(mask_profile(table(spark, d, "nhds"), EXACT), EXACT).select(F.col("load").alias("load_id"), "column_name", "issue")


QUERIES = {"p3_found": p3_found, "p3_rows": p3_rows, "p4_found": p4_found, "p4_stats": p4_stats, "p6_found": p6_found, "p6_profile": p6_profile, "p6_exact": p6_exact, "p6_masks": p6_masks, "p6_mask_issues": p6_mask_issues}

_P3_PARSED = r"""
WITH recs AS (SELECT line_id, raw_line AS t FROM aus01stdpop_mf_raw
              WHERE line_no IS DISTINCT FROM 1 AND raw_line IS NOT NULL AND length(trim(raw_line, E' \t\r\n')) > 0),
quoted AS (SELECT line_id, t, regexp_full_match(t, '([ \t\r\n]*"([^"]|"")*"[ \t\r\n]*|[^",]*)(,([ \t\r\n]*"([^"]|"")*"[ \t\r\n]*|[^",]*))*') AS ok FROM recs),
fields AS (SELECT line_id, ok, string_split(regexp_replace(t, '"([^"]|"")*"', CASE WHEN ok THEN '<\0>' ELSE '' END, 'g'), ',') AS loose,
           regexp_extract_all(t || ',', '([ \t\r\n]*"(?:[^"]|"")*"[ \t\r\n]*|[^",]*),', 1) AS f FROM quoted),
bare AS (SELECT line_id, ok, len(f) AS n,
         list_transform(f, lambda x: trim(regexp_replace(trim(x, E' \t\r\n'), '^"(.*)"$', '\1', 's'), E' \t\r\n')) AS f FROM fields),
vals AS (SELECT line_id, ok, n, list_transform(f, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN TRY_CAST(x AS HUGEINT) END) AS v FROM bare),
marked AS (SELECT line_id, v, CASE WHEN NOT ok THEN 'quoting' WHEN n <> 3 THEN 'column_count'
    WHEN v[1] IS NULL OR v[1] NOT BETWEEN 1 AND 18 THEN 'agegrp'
    WHEN v[2] IS NULL OR v[2] NOT BETWEEN 1 AND 2 THEN 'sex'
    WHEN v[3] IS NULL OR v[3] NOT BETWEEN 0 AND 2000000000 THEN 'pop' END AS reason FROM vals)
"""

_P4_KEYS = """
WITH k AS (SELECT nullif(upper(trim(diagnosis1)), '') AS diagnosis1, sex, CAST(days_of_care AS DOUBLE) AS v FROM nhds)
"""


def _def5(p: float) -> str:
    """SAS definition 5 over the sorted list x of n values."""
    lo = f"CASE WHEN n * {p!r} = floor(n * {p!r}) THEN floor(n * {p!r}) ELSE floor(n * {p!r}) + 1 END"
    hi = f"floor(n * {p!r}) + 1"
    at = lambda e: f"x[CAST(greatest(1, least(n, {e})) AS BIGINT)]"
    return f"CASE WHEN n > 0 THEN {at(lo)} / 2 + {at(hi)} / 2 END"


_MASK = f"translate(t, '{UPPER}{LOWER}{DIGIT}', '{'A' * 26}{'a' * 26}{'9' * 10}')"
_CLASSES = """
WITH cls AS (
  SELECT load_id, 'age' AS column_name, CAST(age AS VARCHAR) AS t, CAST(age AS DOUBLE) AS v, age BETWEEN 0 AND 120 AS ok, CAST(least(floor(age / 5) + 1, 18) AS INT) AS c, FALSE AS bad FROM nhds
  UNION ALL SELECT load_id, 'days_of_care', CAST(days_of_care AS VARCHAR), days_of_care, days_of_care BETWEEN 1 AND 999,
    CASE WHEN days_of_care <= 4 THEN days_of_care WHEN days_of_care < 8 THEN 5 WHEN days_of_care < 15 THEN 8 WHEN days_of_care < 30 THEN 15 ELSE 30 END, FALSE FROM nhds
  UNION ALL SELECT load_id, 'agegrp', CAST(agegrp AS VARCHAR), agegrp, agegrp BETWEEN 1 AND 18, agegrp,
    coalesce(agegrp BETWEEN 1 AND 18 AND age BETWEEN 0 AND 120 AND agegrp <> least(floor(age / 5) + 1, 18), FALSE) FROM nhds
  UNION ALL SELECT load_id, 'diagnosis1', diagnosis1, TRY_CAST(diagnosis1 AS DOUBLE), NULL, NULL, FALSE FROM nhds
  UNION ALL SELECT load_id, 'sex', CAST(sex AS VARCHAR), sex, NULL, NULL, FALSE FROM nhds),
"""
_MASKED = _CLASSES + f"""
m AS (SELECT load_id, column_name, {_MASK} AS mask, count(*) AS n FROM cls WHERE t IS NOT NULL GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY load_id, column_name) AS share FROM m),
mined AS (SELECT load_id, column_name, max({{'n': n, 'm': mask}}).m AS dominant_mask, count(*) AS n_masks, CAST(sum(CASE WHEN share < 0.005 THEN n ELSE 0 END) AS BIGINT) AS n_rare_mask FROM s GROUP BY ALL),
tot AS (SELECT load_id, column_name, count(*) AS n_rows, count(*) - count(t) AS n_null, count(DISTINCT t) AS n_distinct, min(v) AS min_value, max(v) AS max_value,
  CASE WHEN column_name = 'diagnosis1' THEN min(t) END AS min_text, CASE WHEN column_name = 'diagnosis1' THEN max(t) END AS max_text, coalesce(count_if(NOT ok), 0) AS n_out_of_range, coalesce(count_if(bad), 0) AS n_contradicting FROM cls GROUP BY load_id, column_name),
prev AS (SELECT load_id, column_name, lag(load_id) OVER (PARTITION BY column_name ORDER BY load_id) AS b FROM tot),
sh AS (SELECT load_id, column_name, c, count(*) / sum(count(*)) OVER (PARTITION BY load_id, column_name) AS p FROM cls WHERE ok GROUP BY load_id, column_name, c),
mv AS (SELECT load_id, column_name, sum(abs(d)) / 2 AS shift FROM (SELECT load_id, column_name, c, sum(p) AS d FROM (SELECT load_id, column_name, c, p FROM sh UNION ALL SELECT prev.load_id, column_name, c, -p FROM prev JOIN sh USING (column_name) WHERE sh.load_id = prev.b) GROUP BY ALL) GROUP BY ALL),
mm AS (SELECT load_id, column_name, sum(abs(d)) / 2 AS mask_shift FROM (SELECT load_id, column_name, mask, sum(share) AS d FROM (SELECT load_id, column_name, mask, share FROM s UNION ALL SELECT prev.load_id, column_name, mask, -share FROM prev JOIN s USING (column_name) WHERE s.load_id = prev.b) GROUP BY ALL) GROUP BY ALL)
"""
_PROFILED = "FROM tot LEFT JOIN prev USING (load_id, column_name) LEFT JOIN mined USING (load_id, column_name) LEFT JOIN mv USING (load_id, column_name) LEFT JOIN mm USING (load_id, column_name)"

ORACLES = {
    "p6_exact": _MASKED + f"""SELECT load_id, column_name, n_rows, n_null, n_distinct, min_value, max_value, min_text, max_text, n_out_of_range, n_contradicting, dominant_mask, coalesce(n_masks, 0) AS n_masks,
  coalesce(n_rare_mask, 0) AS n_rare_mask, CASE WHEN b IS NOT NULL THEN round(shift, 9) END AS shift, CASE WHEN b IS NOT NULL THEN round(mask_shift, 9) END AS mask_shift {_PROFILED}""",
    "p6_mask_issues": _MASKED + f"""SELECT load_id, column_name, 'rare_masks' AS issue {_PROFILED} WHERE n_rare_mask * 100 > n_rows - n_null
UNION ALL SELECT load_id, column_name, 'mask_shift' {_PROFILED} WHERE b IS NOT NULL AND mask_shift > 0.2""",
    "p3_found": _P3_PARSED + "SELECT line_id, reason FROM marked WHERE reason IS NOT NULL",
    "p3_rows": _P3_PARSED + "SELECT line_id, CAST(v[1] AS BIGINT) AS agegrp, CAST(v[2] AS BIGINT) AS sex, CAST(v[3] AS BIGINT) AS pop FROM marked WHERE reason IS NULL",
    "p4_found": _P4_KEYS + "SELECT diagnosis1, sex FROM k WHERE diagnosis1 IS NOT NULL AND sex IS NOT NULL GROUP BY ALL HAVING count(*) * 100 > (SELECT count(*) FROM nhds)",
    "p4_stats": _P4_KEYS
    + f""", g AS (SELECT diagnosis1, sex, count(*) AS n_rows, count(v) AS n, sum(v) AS s, min(v) AS lo, max(v) AS hi, list_sort(list(v) FILTER (WHERE v IS NOT NULL)) AS x FROM k GROUP BY diagnosis1, sex)
SELECT diagnosis1, sex, n_rows, n AS n_value, s AS sum_value, round(s / nullif(n, 0), 6) AS mean_value, lo AS min_value, hi AS max_value,
{_def5(0.1)} AS q10, {_def5(0.25)} AS q25, {_def5(0.5)} AS q50, {_def5(0.75)} AS q75, {_def5(0.9)} AS q90 FROM g""",
    "p6_found": """
WITH cls AS (
  SELECT load_id, 'age' AS column_name, CAST(age AS DOUBLE) AS v, age BETWEEN 0 AND 120 AS ok, CAST(least(floor(age / 5) + 1, 18) AS INT) AS c, FALSE AS bad FROM nhds
  UNION ALL SELECT load_id, 'days_of_care', days_of_care, days_of_care BETWEEN 1 AND 999,
    CASE WHEN days_of_care <= 4 THEN days_of_care WHEN days_of_care < 8 THEN 5 WHEN days_of_care < 15 THEN 8 WHEN days_of_care < 30 THEN 15 ELSE 30 END, FALSE FROM nhds
  UNION ALL SELECT load_id, 'agegrp', agegrp, agegrp BETWEEN 1 AND 18, agegrp,
    coalesce(agegrp BETWEEN 1 AND 18 AND age BETWEEN 0 AND 120 AND agegrp <> least(floor(age / 5) + 1, 18), FALSE) FROM nhds),
tot AS (SELECT load_id, column_name, count(*) AS n, count(*) - count(v) AS nn, count_if(NOT ok) AS o, count_if(bad) AS b FROM cls GROUP BY ALL),
sh AS (SELECT load_id, column_name, c, count(*) / sum(count(*)) OVER (PARTITION BY load_id, column_name) AS p FROM cls WHERE ok GROUP BY load_id, column_name, c),
prev AS (SELECT load_id, column_name, lag(load_id) OVER (PARTITION BY column_name ORDER BY load_id) AS b FROM tot),
diffs AS (SELECT load_id, column_name, c, sum(p) AS d FROM (
   SELECT load_id, column_name, c, p FROM sh UNION ALL SELECT prev.load_id, column_name, c, -p FROM prev JOIN sh USING (column_name) WHERE sh.load_id = prev.b) GROUP BY ALL),
mv AS (SELECT load_id, column_name, sum(abs(d)) / 2 AS m FROM diffs JOIN prev USING (load_id, column_name) WHERE b IS NOT NULL GROUP BY ALL)
SELECT load_id, column_name, 'nulls' AS issue FROM tot WHERE nn * 20 > n
UNION ALL SELECT load_id, column_name, 'range' FROM tot WHERE o * 100 > n
UNION ALL SELECT load_id, column_name, 'pattern' FROM tot WHERE b * 100 > n
UNION ALL SELECT load_id, column_name, 'shift' FROM mv WHERE m > 0.2
""",
}
