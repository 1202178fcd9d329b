"""Column-level data quality profile per load, by character-class masks.

The mask of a value is its text with every ASCII letter as `a` or `A` and every digit as `9`. One pass over the
rows counts them by (load, column, mask, class, in range or not), combined map-side, so what is shuffled has the
size of this table of masks, however many distinct values there are. Nulls, ranges, contradictions, shares of
classes and their changes between loads are sums over it, as are the patterns: masks holding at least `rare` of a
column's non-null values in a load are its dominant patterns, the others are violations.

Numbers of distinct values come from mergeable sketches (HyperLogLog of 2^SKETCH registers: a relative standard error of
1.04 / 2^(SKETCH / 2), 1.6 %) in a second pass, with the extremes; distinct="exact" counts the values themselves, which
shuffles every distinct one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.plans.scale import cut

#: Binary logarithm of the registers of a distinct count.
SKETCH = 12
UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


WHOLE = ("int", "bigint", "smallint", "tinyint")
#: A text that reads as a double: asked first, as a failed conversion costs an exception.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?\s*$"


def _number(text: Column) -> Column:
    # A number starts with a blank, a sign, a dot or a digit, all of which come before the colon.
    return F.when((text < ":") & text.rlike(NUMBER), text).try_cast("double")


def mask(text: Column) -> Column:
    return F.translate(text, UPPER + LOWER + DIGIT, "A" * 26 + "a" * 26 + "9" * 10)


@dataclass(frozen=True)
class ColumnRule:
    """What a column should look like.

    low, high: inclusive range of a number. classes: expression over the double `v`, giving the class
    of an in-range value for the comparison of loads. rule: SQL condition over the row that is true
    where the column contradicts other columns.
    """

    name: str
    low: float | None = None
    high: float | None = None
    classes: str | None = None
    rule: str | None = None


@dataclass(frozen=True)
class ProfileSpec:
    load: str
    columns: tuple[ColumnRule, ...]
    null_share: float = 0.05
    range_share: float = 0.01
    pattern_share: float = 0.01
    shift: float = 0.2
    rare: float = 0.005
    distinct: str = "sketch"


NHDS_RULES = (
    ColumnRule("age", 0, 120, "cast(least(floor(v / 5) + 1, 18) as int)"),
    ColumnRule("days_of_care", 1, 999, "case when v <= 4 then cast(floor(v) as int) when v < 8 then 5 when v < 15 then 8 when v < 30 then 15 else 30 end"),
    ColumnRule("agegrp", 1, 18, "cast(v as int)", "agegrp between 1 and 18 and age between 0 and 120 and agegrp <> least(floor(age / 5) + 1, 18)"),
)


def _cells(df: DataFrame, spec: ProfileSpec) -> DataFrame:
    """load, column_id, text, v, bad: every value of every column, as a number where the column has a range, and whether its row contradicts the column's rule."""
    kinds = dict(df.dtypes)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).cast("int").alias("column_id"),
                F.col(f"`{c.name}`").cast("string").alias("text"),
                (F.lit(None).cast("double") if c.low is None else F.col(f"`{c.name}`").cast("double") if kinds[c.name] in (*WHOLE, "double", "float") else _number(F.col(f"`{c.name}`").cast("string"))).alias("v"),
                (F.coalesce(F.expr(c.rule), F.lit(False)) if c.rule else F.lit(False)).alias("bad"),
            )
            for i, c in enumerate(spec.columns)
        ]
    )
    return df.select(F.col(f"`{spec.load}`").alias("load"), F.explode(cells).alias("c")).select("load", "c.*")


def mask_table(df: DataFrame, spec: ProfileSpec) -> DataFrame:
    """load, column_id, mask, class, outside, n, bad: rows by the mask of the value, its class, and whether it is out of range."""
    kinds = dict(df.dtypes)
    outside, cls = F.lit(False), F.lit(None).cast("int")
    for i, c in enumerate(spec.columns):
        here = F.col("column_id") == i
        if c.low is not None:
            ok = F.coalesce(F.col("v").between(c.low, c.high), F.lit(False))
            outside = F.when(here, F.col("text").isNotNull() & ~ok).otherwise(outside)
            if c.classes:
                cls = F.when(here & ok, F.expr(c.classes)).otherwise(cls)
    # Everything is worked out after the columns are under each other: once, in a method that stays small enough to be compiled.
    text = F.col("text")
    whole = [i for i, c in enumerate(spec.columns) if kinds[c.name] in WHOLE]
    digits = F.when(text.startswith("-"), F.concat(F.lit("-"), F.repeat(F.lit("9"), F.length(text) - 1))).otherwise(F.repeat(F.lit("9"), F.length(text)))
    masked = F.when(F.col("column_id").isin(whole), digits).otherwise(mask(text)) if whole else mask(text)
    marked = _cells(df, spec).select("load", "column_id", masked.alias("mask"), cls.alias("class"), outside.alias("outside"), "bad")
    return marked.groupBy("load", "column_id", "mask", "class", "outside").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"))


def extremes(df: DataFrame, spec: ProfileSpec) -> DataFrame:
    """load, column_id, n_distinct, min_value, max_value, min_text, max_text, by one row of aggregates per load."""
    kinds = dict(df.dtypes)
    numeric = (*WHOLE, "double", "float", "decimal")
    out, rows = [], []
    for i, c in enumerate(spec.columns):
        col = F.col(f"`{c.name}`")
        number = kinds[c.name].startswith(numeric)
        v = col if number else _number(col.cast("string"))
        out += [F.min(v).cast("double").alias(f"lo{i}"), F.max(v).cast("double").alias(f"hi{i}")]
        # Text in order of its characters says nothing of numbers, and keeps the aggregation from fixed-size buffers.
        if not number:
            out += [F.min(col.cast("string")).alias(f"first{i}"), F.max(col.cast("string")).alias(f"last{i}")]
        if spec.distinct == "sketch":
            # The sketch passes over empty texts: every text gets a sign.
            out.append(F.hll_sketch_estimate(F.hll_sketch_agg(col.cast("bigint") if kinds[c.name] in WHOLE else F.concat(F.lit("="), col.cast("string")), F.lit(SKETCH))).alias(f"d{i}"))
        text = lambda name, number=number, i=i: (F.lit(None).cast("string") if number else F.col(f"{name}{i}")).alias("min_text" if name == "first" else "max_text")
        distinct = F.col(f"d{i}") if spec.distinct == "sketch" else F.lit(0).cast("bigint")
        rows.append(F.struct(F.lit(i).cast("int").alias("column_id"), distinct.alias("n_distinct"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"), text("first"), text("last")))
    wide = df.groupBy(F.col(f"`{spec.load}`").alias("load")).agg(*out)
    return wide.select("load", F.explode(F.array(*rows)).alias("r")).select("load", "r.*")


def mask_profile(df: DataFrame, spec: ProfileSpec) -> DataFrame:
    """What the table of masks says of each load and column: the rows of profile without n_distinct and the extremes."""
    names = F.array(*[F.lit(c.name) for c in spec.columns])
    n = F.col("n")
    kinds = cut(mask_table(df, spec))
    total = kinds.groupBy("load", "column_id").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("mask").isNull(), n).otherwise(0)).alias("n_null"), F.sum(F.when(F.col("outside"), n).otherwise(0)).alias("n_out_of_range"), F.sum("bad").alias("n_contradicting")
    )
    masks = kinds.where("mask is not null").groupBy("load", "column_id", "mask").agg(F.sum("n").alias("n"))
    share = masks.withColumn("share", n / F.sum("n").over(Window.partitionBy("load", "column_id")))
    mined = share.groupBy("load", "column_id").agg(
        F.max(F.struct("n", "mask")).getField("mask").alias("dominant_mask"), F.count(F.lit(1)).alias("n_masks"), F.sum(F.when(F.col("share") < spec.rare, n).otherwise(0)).alias("n_rare_mask")
    )
    classes = kinds.where("class is not null").groupBy("load", "column_id", F.col("class").cast("string").alias("item")).agg(F.sum("n").alias("n"))
    # Loads are few: their order is a window over the per-load totals, never over rows.
    order = total.select("load", "column_id", F.lag(F.struct("load")).over(Window.partitionBy("column_id").orderBy("load")).alias("before"))
    moved = _shift(classes, order).withColumnRenamed("moved", "shift")
    moved_masks = _shift(masks.withColumnRenamed("mask", "item"), order).withColumnRenamed("moved", "mask_shift")
    result = _with(total, mined, moved, moved_masks)
    return result.withColumns({"column_name": F.get(names, F.col("column_id")), "n_rare_mask": F.coalesce("n_rare_mask", F.lit(0)), "n_masks": F.coalesce("n_masks", F.lit(0))})


def _with(rows: DataFrame, *more: DataFrame) -> DataFrame:
    """rows with the columns of others that have a row per load and column."""
    for extra in more:
        e = extra.withColumnRenamed("load", "e_load").withColumnRenamed("column_id", "e_column")
        rows = rows.join(e, F.col("load").eqNullSafe(F.col("e_load")) & (F.col("column_id") == F.col("e_column")), "left").drop("e_load", "e_column")
    return rows


def profile(df: DataFrame, spec: ProfileSpec) -> DataFrame:
    """One row per load and column.

    n_rows, n_null, n_distinct (of non-null values), min_value and max_value (of what is a number), min_text
    and max_text (of columns that are no numbers), n_out_of_range, n_contradicting, dominant_mask, n_masks, n_rare_mask
    (values whose mask is rare), shift (half the sum of absolute differences of class shares against the load before;
    null for the first load, without classes, or where either has no value in range) and mask_shift
    (the same for masks). The null load is a load and comes first. NaN is out of range. An empty table gives no rows.
    """
    if spec.distinct not in ("sketch", "exact"):
        raise ValueError("distinct must be sketch or exact")
    ends = extremes(df, spec)
    if spec.distinct == "exact":
        values = _cells(df, spec).where("text is not null").groupBy("load", "column_id", "text").agg(F.count(F.lit(1)).alias("n"))
        counted = values.groupBy("load", "column_id").agg(F.count(F.lit(1)).alias("n_distinct"))
        return _with(mask_profile(df, spec), ends.drop("n_distinct"), counted).withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0))).drop("column_id")
    return _with(mask_profile(df, spec), ends).drop("column_id")


def mined_masks(df: DataFrame, spec: ProfileSpec) -> DataFrame:
    """load, column_name, mask, n, share, role of every mask in every load: dominant (the most frequent), usual, or rare (a violation).

    Of two equally frequent masks, the one that is greater as a text is dominant. Nulls have no mask.
    """
    names = F.array(*[F.lit(c.name) for c in spec.columns])
    masks = mask_table(df, spec).where("mask is not null").groupBy("load", "column_id", "mask").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("load", "column_id")
    top = F.max(F.struct("n", "mask")).over(w).getField("mask")
    ranked = masks.withColumns({"share": F.col("n") / F.sum("n").over(w), "top": top})
    role = F.when(F.col("mask") == F.col("top"), "dominant").when(F.col("share") < spec.rare, "rare").otherwise("usual")
    return ranked.select("load", F.get(names, F.col("column_id")).alias("column_name"), "mask", "n", "share", role.alias("role"))


def _shift(items: DataFrame, order: DataFrame) -> DataFrame:
    """load, column_id, moved: half the L1 distance of the item shares to those of the load before."""
    shared = items.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("load", "column_id")))
    o = order.where("before is not null").select(F.col("load").alias("o_load"), F.col("column_id").alias("o_column"), F.col("before.load").alias("o_before"))
    now = o.join(shared, F.col("o_load").eqNullSafe(F.col("load")) & (F.col("o_column") == F.col("column_id")))
    was = o.join(shared, F.col("o_before").eqNullSafe(F.col("load")) & (F.col("o_column") == F.col("column_id")))
    both = now.select("o_load", "o_column", "item", F.col("share").alias("now"), F.lit(0.0).alias("was")).unionAll(was.select("o_load", "o_column", "item", F.lit(0.0).alias("now"), F.col("share").alias("was")))
    diff = both.groupBy("o_load", "o_column", "item").agg(F.sum("now").alias("now"), F.sum("was").alias("was"))
    return diff.groupBy(F.col("o_load").alias("load"), F.col("o_column").alias("column_id")).agg(
        F.when((F.sum("now") > 0) & (F.sum("was") > 0), F.sum(F.abs(F.col("now") - F.col("was"))) / 2).alias("moved")
    )


def issues(profiled: DataFrame, spec: ProfileSpec) -> DataFrame:
    """load, column_name, issue (nulls, range, pattern, shift) for every limit that a profile row exceeds."""
    found = F.array_compact(
        F.array(
            F.when(F.col("n_null") / F.col("n_rows") > spec.null_share, "nulls"),
            F.when(F.col("n_out_of_range") / F.col("n_rows") > spec.range_share, "range"),
            F.when(F.col("n_contradicting") / F.col("n_rows") > spec.pattern_share, "pattern"),
            F.when(F.col("shift") > spec.shift, "shift"),
        )
    )
    return profiled.select("load", "column_name", F.explode(found).alias("issue"))


def mask_issues(profiled: DataFrame, spec: ProfileSpec) -> DataFrame:
    """load, column_name, issue by masks alone: rare_masks (more than pattern_share of the values), mask_shift (above shift)."""
    valued = F.col("n_rows") - F.col("n_null")
    found = F.array_compact(F.array(F.when(F.try_divide("n_rare_mask", valued) > spec.pattern_share, "rare_masks"), F.when(F.col("mask_shift") > spec.shift, "mask_shift")))
    return profiled.select("load", "column_name", F.explode(found).alias("issue"))
