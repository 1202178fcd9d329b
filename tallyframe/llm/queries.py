"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm import calibrated_sample as sampling
from tallyframe.llm.lookalike import VISIBLE, class_sizes, fold_sql, folded_texts, lookalike_pairs
from tallyframe.llm.packing import pack, pack_report
from tallyframe.llm.percentiles import OFFSET, merge, percentiles, sketch
from tallyframe.llm.term_frequency import term_frequency
from tallyframe.llm.tokenizer import count_column, encode_column
from tallyframe.plans.scale import cut, table

ACCURACY = 0.01
PROBS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
CELL = ["sex", "geog_region", "agegrp"]
CAPACITY = 4096


def _per_load(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nhds").select("load_id", "geog_region", "days_of_care", "age")
    return sketch(rows, ["days_of_care", "age"], ["load_id", "geog_region"], ACCURACY)


def p1_load_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each load (scope: its number) and, from the added sketches, of all loads (scope all)."""
    scopes = F.explode(F.array(F.coalesce(F.col("load_id").cast("string"), F.lit("null")), F.lit("all")))
    both = merge(_per_load(spark, d).withColumn("scope", scopes), ["scope", "geog_region"])
    out = percentiles(both, ["scope", "geog_region"], PROBS)
    return out.withColumn("estimate", F.round("estimate", 6))


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = percentiles(merge(_per_load(spark, d), ["geog_region"]), ["geog_region"], PROBS)
    return out.withColumn("estimate", F.round("estimate", 6))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    diagnosis = F.nullif(F.upper(F.trim(F.col("diagnosis1"))), F.lit(""))
    return term_frequency(table(spark, d, "nhds"), "record_id", {"diagnosis1": diagnosis, "geog_region": F.col("geog_region").cast("string")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select("field_name", "field_value", "mark")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def _sample(spark: SparkSession, d: str):
    nhds = table(spark, d, "nhds").select("record_id", *CELL)
    return sampling.sample_report(nhds, table(spark, d, "sample_targets"), "record_id", CELL)


_PLAN = ["cell_id", "available", "required", "goal", "probability", "gap"]
_PLAN_SCHEMA = "cell_id int, available bigint, required bigint, goal bigint, probability double, gap bigint"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    plan, _ = _sample(spark, d)
    return spark.createDataFrame(plan[_PLAN], _PLAN_SCHEMA).where("gap > 0").select("cell_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    plan, _ = _sample(spark, d)
    return spark.createDataFrame(plan[_PLAN], _PLAN_SCHEMA).drop("probability")


def p5_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What every cell has, needs, gets at least, and lacks."""
    plan, _ = _sample(spark, d)
    rows = spark.createDataFrame(plan[_PLAN], _PLAN_SCHEMA)
    return rows.select("cell_id", "available", "required", F.least("goal", "required").alias("met"), "gap")


def p5_margins(spark: SparkSession, d: str) -> DataFrame:
    """Target, goal and available rows of each sex, region and age group, and of the whole sample."""
    plan, _ = _sample(spark, d)
    return spark.createDataFrame(sampling.margin_report(plan, CELL), "category string, value string, target double, goal bigint, available bigint")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    plan, units = _sample(spark, d)
    cells = spark.createDataFrame(plan[["cell_id", "probability", *CELL]].astype({c: "Int32" for c in ["cell_id", *CELL]}), "cell_id int, probability double, sex int, geog_region int, agegrp int")
    # The cells are the rows of sample_targets, a table of fixed size.
    drawn = units.join(F.broadcast(cells.select("cell_id", "probability", *[F.col(c).alias(f"c_{c}") for c in CELL])), [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in CELL])
    return sampling.pivotal(drawn, "record_id", "cell_id", "probability").select(F.col("unit").alias("record_id"), F.col("cell").alias("cell_id"))


def p5_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Rows drawn from each cell, up to its required rows, and (cell_id null) in all."""
    cells = table(spark, d, "sample_targets").select("cell_id", "target_ppm", "min_rows")
    plan, _ = _sample(spark, d)
    required = spark.createDataFrame(plan[["cell_id", "required"]], "cell_id int, required bigint")
    drawn = p5_sample(spark, d).groupBy("cell_id").agg(F.count_distinct("record_id").alias("n"))
    by_cell = cells.join(required, "cell_id").join(drawn, "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).alias("n"), "required")
    # 180 cells: the row of all is added in the same pass.
    both = by_cell.select(F.explode(F.array(F.struct("cell_id", F.least("n", "required").alias("n")), F.struct(F.lit(None).cast("int").alias("cell_id"), F.col("n").alias("n")))).alias("r"))
    return both.groupBy("r.cell_id").agg(F.sum("r.n").alias("n_drawn"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = count_column(table(spark, d, "documents"), "doc_id", "text")
    return pack(sizes, "doc_id", "n_ids", CAPACITY)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the lower bound, and what the program and the best fit placed of them."""
    sizes = count_column(table(spark, d, "documents"), "doc_id", "text")
    return spark.createDataFrame([pack_report(sizes, "n_ids", CAPACITY)], "n_items bigint, n_ids bigint, n_containers bigint, lower_bound double, n_by_program bigint, n_by_best_fit bigint, ids_by_best_fit bigint, n_full_pieces bigint")


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every document and every id of it placed once, none divided without need, no container overfull."""
    sizes = count_column(table(spark, d, "documents"), "doc_id", "text")
    packed = cut(pack(sizes, "doc_id", "n_ids", CAPACITY))
    wide = F.col("size").cast("bigint")
    by_item = packed.groupBy("doc_id").agg(F.sum(wide).alias("n"), F.count(F.lit(1)).alias("n_pieces"), F.max(F.col("first_unit") + wide).alias("upto"), F.count_distinct("first_unit").alias("places"))
    # A piece but the last fills a container: pieces that add up to the document and start at multiples of the capacity cover it once.
    kept = sizes.join(by_item, "doc_id", "left").agg(
        F.count("n_pieces").alias("n_placed"), F.count_if((F.col("n") != F.col("n_ids")) | (F.col("upto") != F.col("n_ids")) | (F.col("places") != F.col("n_pieces"))).alias("n_incomplete"),
        F.count_if(F.col("n_pieces") > F.greatest(F.ceil(F.col("n_ids") / CAPACITY), F.lit(1))).alias("n_divided_without_need"),
    )
    over = packed.groupBy("container_id").agg(F.sum(wide).alias("held")).agg(F.count_if(F.col("held") > CAPACITY).alias("n_overfull"))
    return kept.crossJoin(F.broadcast(over))  # one row each


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p9_folded(spark: SparkSession, d: str) -> DataFrame:
    return folded_texts(table(spark, d, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every form that several texts have: texts, documents and pairs, which need not be written to be counted."""
    return class_sizes(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {
    "p1_load_percentiles": p1_load_percentiles, "p1_percentiles": p1_percentiles, "p2_found": p2_found, "p2_terms": p2_terms, "p5_found": p5_found, "p5_report": p5_report,
    "p5_gaps": p5_gaps, "p5_margins": p5_margins, "p5_sample": p5_sample, "p5_drawn": p5_drawn, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_report": p8_report, "p8_checked": p8_checked, "p9_found": p9_found, "p9_folded": p9_folded, "p9_classes": p9_classes,
}

_G = (1 + ACCURACY) / (1 - ACCURACY)


def _percentile_sql(scopes: str, keys: str) -> str:
    code = f"CASE WHEN v = 0 THEN 0 WHEN v > 0 THEN CAST(ceil(ln(v) / {math.log(_G)!r}) AS BIGINT) + {OFFSET} WHEN v < 0 THEN -(CAST(ceil(ln(-v) / {math.log(_G)!r}) AS BIGINT) + {OFFSET}) END"
    probs = " UNION ALL ".join(f"SELECT CAST({p!r} AS DOUBLE) AS p" for p in PROBS)
    return f"""
WITH long AS (SELECT load_id, geog_region, 'days_of_care' AS column_name, CAST(days_of_care AS DOUBLE) AS v FROM nhds UNION ALL SELECT load_id, geog_region, 'age', age FROM nhds),
coded AS (SELECT {scopes}{code} AS b, v, column_name, geog_region FROM long),
vals AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY b) - 1 AS rk, count(*) OVER (PARTITION BY {keys}) AS n FROM coded WHERE v IS NOT NULL),
keyed AS (SELECT {keys}, count(v) AS n_values, count(*) - count(v) AS n_missing FROM coded GROUP BY ALL),
probs AS ({probs}),
hit AS (SELECT {keys}, p, b FROM vals, probs WHERE rk = floor(p * (n - 1))),
base AS (SELECT * FROM keyed, probs)
SELECT {", ".join("base." + k.strip() for k in keys.split(","))}, n_values, n_missing, base.p AS p,
  round(CASE WHEN b = 0 THEN 0.0 ELSE sign(b) * exp((abs(b) - {OFFSET}) * {math.log(_G)!r}) * {2 / (_G + 1)!r} END, 6) AS estimate, CAST({ACCURACY!r} AS DOUBLE) AS max_relative_error
FROM base LEFT JOIN hit ON base.p = hit.p AND {" AND ".join(f"base.{k.strip()} IS NOT DISTINCT FROM hit.{k.strip()}" for k in keys.split(","))}"""


_TERMS = """
WITH t AS (SELECT record_id, 'diagnosis1' AS field_name, nullif(upper(trim(diagnosis1)), '') AS field_value FROM nhds
           UNION ALL SELECT record_id, 'geog_region', CAST(geog_region AS VARCHAR) FROM nhds),
c AS (SELECT field_name, field_value, count(*) AS n_rows, count(DISTINCT record_id) AS n_records FROM t WHERE field_value IS NOT NULL GROUP BY ALL),
m AS (SELECT *, CASE WHEN n_records < 5 THEN 'rare' WHEN n_records * 20 > (SELECT count(DISTINCT record_id) FROM nhds) THEN 'common' END AS mark FROM c)
"""

_PLANNED = """
WITH u AS (SELECT DISTINCT record_id, sex, geog_region, agegrp FROM nhds WHERE record_id IS NOT NULL),
size AS (SELECT count(DISTINCT record_id) // 10 AS s FROM u),
have AS (SELECT t.cell_id, count(u.record_id) AS available FROM sample_targets t LEFT JOIN u
         ON u.sex IS NOT DISTINCT FROM t.sex AND u.geog_region IS NOT DISTINCT FROM t.geog_region AND u.agegrp IS NOT DISTINCT FROM t.agegrp GROUP BY ALL),
r AS (SELECT t.cell_id, available, greatest(t.min_rows, (t.target_ppm * s + 999999) // 1000000) AS required FROM sample_targets t JOIN have USING (cell_id), size)
"""

_FOLDED = f"WITH f AS (SELECT doc_id, text, {fold_sql('text')} AS form FROM documents), v AS (SELECT * FROM f WHERE text IS NOT NULL AND regexp_matches(form, '{VISIBLE}'))"

ORACLES = {
    "p8_checked": "SELECT count(*) AS n_placed, CAST(0 AS BIGINT) AS n_incomplete, CAST(0 AS BIGINT) AS n_divided_without_need, CAST(0 AS BIGINT) AS n_overfull FROM documents",
    "p9_folded": f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents",
    "p9_found": _FOLDED + " SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM v a JOIN v b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p9_classes": _FOLDED
    + """, t AS (SELECT form, text, count(*) AS n FROM v GROUP BY ALL)
SELECT sha256(form) AS class_id, count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_rows, CAST((sum(n) ^ 2 - sum(n * n)) / 2 AS BIGINT) AS n_pairs FROM t GROUP BY form HAVING count(*) > 1""",
    "p1_load_percentiles": _percentile_sql("unnest([coalesce(CAST(load_id AS VARCHAR), 'null'), 'all']) AS scope, ", "scope, column_name, geog_region"),
    "p1_percentiles": _percentile_sql("", "column_name, geog_region"),
    "p2_found": _TERMS + "SELECT field_name, field_value, mark FROM m WHERE mark IS NOT NULL",
    "p2_terms": _TERMS + "SELECT field_name, field_value, n_rows, n_records, mark FROM m",
    "p5_gaps": _PLANNED + "SELECT cell_id, available, CAST(required AS BIGINT) AS required, CAST(least(available, required) AS BIGINT) AS met, CAST(greatest(required - available, 0) AS BIGINT) AS gap FROM r",
    "p5_drawn": _PLANNED
    + """SELECT cell_id, CAST(least(available, required) AS BIGINT) AS n_drawn FROM r
UNION ALL SELECT NULL, CAST(least((SELECT count(*) FROM u JOIN (SELECT DISTINCT sex, geog_region, agegrp FROM sample_targets WHERE target_ppm > 0) t ON t.sex IS NOT DISTINCT FROM u.sex AND t.geog_region IS NOT DISTINCT FROM u.geog_region AND t.agegrp IS NOT DISTINCT FROM u.agegrp),
  greatest((SELECT s FROM size), (SELECT sum(least(available, required)) FROM r))) AS BIGINT)""",
    "p5_found": _PLANNED + "SELECT cell_id FROM r WHERE available < required",
}
