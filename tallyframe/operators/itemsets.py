"""Frequent sets of the values of a multi-valued column, and the maximal ones among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def frequent_sets(df: DataFrame, column: str, min_share: float = 0.01, maximal: bool = False) -> DataFrame:
    """items (sorted), n_rows: sets of values that at least min_share of the rows hold together; maximal: those in no larger one.

    Nulls and repeated values of a row are dropped; rows without values count in the total. Sets are grown in parallel from
    conditional trees (FP-growth); a set that is not maximal is found from the sets of one value more, by an equality of sets.
    An empty table gives no rows.
    """
    from pyspark.ml.fpm import FPGrowth

    if not 0 < min_share <= 1:
        raise ValueError("min_share must be above 0 and at most 1")
    rows = df.select(F.array_distinct(F.array_compact(F.coalesce(F.col(f"`{column}`"), F.array()))).alias("items"))
    if rows.isEmpty():
        return rows.select("items", F.lit(0).cast("bigint").alias("n_rows")).limit(0)
    found = FPGrowth(itemsCol="items", minSupport=min_share).fit(rows).freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n_rows"))
    if not maximal:
        return found
    # Every subset of a frequent set is frequent, so a set is maximal unless one of one value more contains it.
    inner = found.select(F.explode(F.transform("items", lambda x, i: F.filter("items", lambda y: y != x))).alias("items")).where(F.size("items") > 0).distinct()
    return found.join(inner, "items", "left_anti")
