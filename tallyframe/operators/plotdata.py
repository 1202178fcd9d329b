"""Data for plots: what a drawing needs, summarised on the cluster."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.meta import Dataset
from tallyframe.operators.measures import maximum, minimum, p25, p75, quantile

#: Rows up to which single points are drawn.
POINTS = 100_000


def histogram(ds: Dataset, column: str, bins: int = 20, low: float | None = None, high: float | None = None, by: list[str] | None = None) -> DataFrame:
    """bin, bin_low, bin_high, n: equal bins from low to high, both included; others and nulls are left out.

    Without low and high, the range of the data.
    """
    x = F.col(f"`{column}`").cast("double")
    df = ds.df
    if low is None or high is None:
        row = df.agg(F.min(x), F.max(x)).first()
        low, high = (row[0] if low is None else low), (row[1] if high is None else high)
    if low is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0.0).alias("bin_low"), F.lit(0.0).alias("bin_high"), F.lit(0).cast("bigint").alias("n")).limit(0)
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    keys = [F.col(f"`{k}`") for k in by or []]
    out = df.where((x >= low) & (x <= high)).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*(by or []), "bin", (F.lit(low) + F.col("bin") * width).alias("bin_low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_high"), "n")


def box_statistics(ds: Dataset, column: str, by: str) -> Dataset:
    """Minimum, quartiles and maximum per value of a condition column."""
    return ds.summ(by, minimum(column), p25(column), quantile(column, 0.5), p75(column), maximum(column))


def series(ds: Dataset, *args: Any, **options: Any) -> Dataset:
    """Bars, lines, dots and fourfold displays: a summary without marginal rows."""
    return ds.summ(*args, nomt=True, **options)


def density(ds: Dataset, column: str, at: int = 128, bandwidth: float | None = None, bins: int = 2048) -> DataFrame:
    """x, density: a Gaussian kernel estimate at equally spaced points from three bandwidths below the least value to three above.

    The values are counted into bins on the cluster, one pass after their moments; the kernel is applied to the bins, so
    what reaches the driver is `bins` rows. bandwidth: by default 1.06 s n^(-1/5). Nulls and what is not finite are left out.
    """
    x = F.col(f"`{column}`").cast("double")
    df = ds.df.where(F.abs(x) < float("inf")).select(x.alias("x"))
    n, low, high, spread = df.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.stddev_samp("x")).first()
    schema = "x double, density double"
    if not n:
        return ds.df.sparkSession.createDataFrame([], schema)
    h = bandwidth or 1.06 * (spread or 0.0) * n**-0.2 or 1.0
    width = (high - low) / bins or 1.0
    counts = df.groupBy(F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m")).collect()
    places, weights = np.array([r["m"] for r in counts]), np.array([r["n"] for r in counts], float)
    grid = np.linspace(low - 3 * h, high + 3 * h, at)
    values = (np.exp(-(((grid[:, None] - places) / h) ** 2) / 2) @ weights) / (n * h * math.sqrt(2 * math.pi))
    return ds.df.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(grid, values)], schema)


def scatter_matrix(ds: Dataset, columns: list[str], bins: int = 50) -> DataFrame:
    """x_column, y_column, x_bin, y_bin, n for every pair of columns: counts of rows in a grid over the columns' ranges.

    One pass for the ranges and one for all pairs. Rows without a finite value in either column of a pair are left out of it.
    """
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    fine = {c: F.when(F.abs(v) < float("inf"), v) for c, v in x.items()}
    ends = ds.df.agg(*[f(v).alias(f"{k}{i}") for i, v in enumerate(fine.values()) for k, f in (("l", F.min), ("h", F.max))]).first()

    def placed(i: int, c: str) -> Column:
        low, high = ends[f"l{i}"], ends[f"h{i}"]
        if low is None:
            return F.lit(None).cast("int")
        # least passes over nulls.
        return F.when(fine[c].isNotNull(), F.least(F.floor((fine[c] - low) * bins / ((high - low) or 1.0)), F.lit(bins - 1))).cast("int")

    binned = ds.df.select(*[placed(i, c).alias(f"b{i}") for i, c in enumerate(columns)])
    pairs = [F.struct(F.lit(columns[i]).alias("x_column"), F.lit(columns[j]).alias("y_column"), F.col(f"b{i}").alias("x_bin"), F.col(f"b{j}").alias("y_bin")) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    each = binned.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("x_bin is not null and y_bin is not null")
    return each.groupBy("x_column", "y_column", "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def points(ds: Dataset, *columns: str, limit: int | None = POINTS, seed: int = 1) -> DataFrame:
    """Rows for a scatter plot: all, or above `limit` a random share of about as many; limit=None for all rows."""
    df = ds.df.select(*[F.col(f"`{c}`") for c in columns])
    if limit is None:
        return df
    n = df.count()
    return df if n <= limit else df.sample(False, limit / n, seed)


def search_values(ds: Dataset, column: str, pattern: str, most: int | None = 200) -> DataFrame:
    """value, label: values whose label (or text) matches a pattern with *, ignoring case; the first `most` by label.

    most=None for all of them; count_values says how many there are.
    """
    import re

    regex = "(?i)^" + ".*".join(map(re.escape, pattern.split("*"))) + "$"
    pairs = ds.df.select(F.col(f"`{column}`").alias("value")).distinct()
    shown = Dataset(pairs.withColumn("label", F.col("value")), "values", {"label": ds.meta(column)}).translated("value", "label")
    found = shown.where(F.col("label").rlike(regex)).orderBy("label")
    return found if most is None else found.limit(most)


def count_values(ds: Dataset, column: str, pattern: str) -> int:
    """The number of values that search_values finds without a limit."""
    return search_values(ds, column, pattern, None).count()
