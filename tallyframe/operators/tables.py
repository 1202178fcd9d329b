"""Tables over named axes in long form: one row per cell, a column per axis and per amount.

An axis that a table lacks needs no copies of its cells: an equi-join on the shared axes repeats them.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.meta import ColumnMeta, Dataset

HIDDEN = ("_level_", "_type_", "_condcols_", "row_ordinal")


def axes_of(ds: Dataset) -> list[str]:
    """The discrete columns of a summary, in order."""
    return [c for c in ds.df.columns if not c.startswith("_") and c != "row_ordinal" and ds.is_discrete(c)]


def amounts_of(ds: Dataset) -> list[str]:
    return [c for c in ds.df.columns if c not in HIDDEN and c not in axes_of(ds) and ds.is_scalar(c)]


def full_level(ds: Dataset) -> DataFrame:
    """The cells of a summary without its marginal rows."""
    return ds.df.where(F.col("_level_") == len(axes_of(ds))) if "_level_" in ds.df.columns else ds.df


def null_safe(left: DataFrame, right: DataFrame, axes: list[str], prefix: str) -> list[Column]:
    """Join conditions on axes of left and their prefixed copies in right, null being a value."""
    return [left[a].eqNullSafe(right[f"{prefix}{a}"]) for a in axes]


def collapse(df: DataFrame, keep: list[str], amounts: list[str]) -> DataFrame:
    """Sum out every axis that is not kept; missing amounts are left out."""
    sums = [F.sum(F.col(f"`{a}`").cast("double")).alias(a) for a in amounts]
    return df.groupBy(*[F.col(f"`{k}`") for k in keep]).agg(*sums) if keep else df.agg(*sums)


def attach(cells: DataFrame, table: DataFrame, axes: list[str], amounts: dict[str, str], how: str = "left") -> DataFrame:
    """cells with amounts of a table (old name -> new name) that has one row per value of the shared axes.

    Collapsing comes first, so the table is as small as its axes; whether it is broadcast is decided
    at run time from its size.
    """
    if not axes:
        # One row: its columns are attached to every cell.
        return cells.crossJoin(F.broadcast(table.agg(*[F.first(f"`{o}`").alias(n) for o, n in amounts.items()])))
    right = table.select(*[F.col(f"`{a}`").alias(f"__r_{a}") for a in axes], *[F.col(f"`{o}`").alias(n) for o, n in amounts.items()])
    return cells.join(right, null_safe(cells, right, axes, "__r_"), how).drop(*[f"__r_{a}" for a in axes])


def aligned(cells: DataFrame, axes: list[str], table: Dataset | DataFrame, amount: str, name: str, table_axes: list[str] | None = None) -> DataFrame:
    """cells with the amount of another table, summed out over the axes that cells lack."""
    df = full_level(table) if isinstance(table, Dataset) else table
    have = table_axes if table_axes is not None else (axes_of(table) if isinstance(table, Dataset) else [a for a in axes if a in df.columns])
    common = [a for a in axes if a in have]
    return attach(cells, collapse(df, common, [amount]), common, {amount: name})


def replicate(df: DataFrame, domains: dict[str, DataFrame]) -> DataFrame:
    """Every cell repeated for every value of the missing axes (one-column frames of few values)."""
    for axis, values in domains.items():
        one = values.select(F.col(f"`{values.columns[0]}`").alias("v")).agg(F.collect_set(F.struct("v")).alias("__vs"))
        df = df.crossJoin(F.broadcast(one)).withColumn(axis, F.explode("__vs")).withColumn(axis, F.col(f"`{axis}`.v")).drop("__vs")
    return df


def shape_union(a: Dataset, b: Dataset, limit: int = 100_000) -> dict[str, list]:
    """The axes of both tables with their values; shared axes must have the same values."""
    shape = {}
    for ds in (a, b):
        for axis in axes_of(ds):
            rows = full_level(ds).select(F.col(f"`{axis}`").alias("v")).distinct().limit(limit + 1).collect()
            if len(rows) > limit:
                raise ValueError(f"axis {axis!r} has more than {limit} values")
            values = sorted((r["v"] for r in rows), key=lambda v: (v is not None, v))
            if shape.setdefault(axis, values) != values:
                raise ValueError(f"the tables differ in the values of axis {axis!r}")
    return shape


def crosstab(ds: Dataset, shaped_like: Dataset | None = None) -> Dataset:
    """The dense table of a summary: every combination of its axes' values is a row, absent cells null.

    With shaped_like, shared axes take the values of that table: others are dropped. A cell that occurs
    twice keeps one of its rows' greatest amounts.
    """
    from tallyframe.operators.summarise import _dense

    axes, amounts = axes_of(ds), amounts_of(ds)
    cells = full_level(ds).groupBy(*[F.col(f"`{a}`").alias(f"__c_{a}") for a in axes]).agg(*[F.max(f"`{m}`").alias(m) for m in amounts])
    domain = None
    if shaped_like is not None:
        like = full_level(shaped_like)
        common = [a for a in axes if a in axes_of(shaped_like)]
        domain = like.select(*[F.col(f"`{a}`").alias(f"__c_{a}") for a in common])
        for a in axes:
            if a not in common:
                own = cells.select(F.collect_set(F.struct(F.col(f"__c_{a}").alias("v"))).alias("s"))
                domain = domain.crossJoin(F.broadcast(own)).withColumn(f"__c_{a}", F.explode("s")).withColumn(f"__c_{a}", F.col(f"__c_{a}.v")).drop("s")
    dense = _dense(cells, domain, tuple(axes)) if axes else cells
    out = dense.select(*[F.col(f"__c_{a}").alias(a) for a in axes], *[F.col(f"`{m}`") for m in amounts])
    return Dataset(out, ds.name, {c: m for c, m in ds.columns.items() if c in out.columns} | {m: ColumnMeta("scalar") for m in amounts}, ds.weight, ds.label)


def pivot_table(
    ds: Dataset, rows: list[str], column: str | list[str], amount: str, values: list, limits: tuple[str, str] | None = None, digits: int = 2, marginals: str = "as listed", all_label: str = "all"
) -> DataFrame:
    """Nested rows by one banner column or several for display; the listed values keep empty columns.

    column: a name, and values its values; or names, and values a list for each: the last varies fastest, and headers read
    "a | b". marginals: where the marginal rows and columns go: before, after, none of them, or as listed (columns) and
    unordered (rows). Their headers read all_label. With limits (lower, upper) a cell reads "x (ll..ul)".
    """
    if marginals not in ("as listed", "before", "after", "none"):
        raise ValueError("marginals must be before, after, none or as listed")
    shown = F.first(F.col(f"`{amount}`"), ignorenulls=True)
    df = ds.df
    if limits:
        number = lambda c: F.format_number(F.col(f"`{c}`"), digits)
        df = df.withColumn("__shown", F.concat(number(amount), F.lit(" ("), number(limits[0]), F.lit(".."), number(limits[1]), F.lit(")")))
        shown = F.first("__shown", ignorenulls=True)
    if isinstance(column, str) and marginals == "as listed":
        return df.groupBy(*[F.col(f"`{r}`") for r in rows]).pivot(column, values).agg(shown)
    banner, lists = ([column], [list(values)]) if isinstance(column, str) else (list(column), [list(v) for v in values])
    total = {c: ds.all_value(c) for c in [*rows, *banner]}
    marginal = lambda c: F.coalesce(F.col(f"`{c}`") == F.lit(total[c]), F.lit(False))
    if marginals == "none":
        for c in total:
            df = df.where(~marginal(c))
    elif marginals != "as listed":
        lists = [[total[c], *rest] if marginals == "before" else [*rest, total[c]] for c, v in zip(banner, lists) for rest in [[x for x in v if x != total[c]]]]
    text = lambda c: F.when(marginal(c), F.lit(all_label)).otherwise(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    heads = [" | ".join(all_label if v == total[c] else "" if v is None else str(v) for c, v in zip(banner, each)) for each in itertools.product(*lists)]
    table = df.withColumn("__head", F.concat_ws(" | ", *[text(c) for c in banner])).groupBy(*[F.col(f"`{r}`") for r in rows]).pivot("__head", heads).agg(shown)
    if marginals in ("before", "after"):
        order = [(lambda m: m.desc() if marginals == "before" else m.asc())(marginal(r)) for r in rows]
        table = table.orderBy(*[o for r, m in zip(rows, order) for o in (m, F.col(f"`{r}`").asc_nulls_first())])
    return table


def heat_levels(table: DataFrame, columns: list[str], levels: int = 5) -> DataFrame:
    """table with a shade from 0 (least) to levels - 1 (greatest) beside each number, as `<column>_heat`; null for null.

    Levels are equal parts of the range of all the numbers; if they are all the same, every shade is 0.
    """
    each = [F.col(f"`{c}`").cast("double") for c in columns]
    ends = table.agg(F.min(F.least(*each)) if len(each) > 1 else F.min(each[0]), F.max(F.greatest(*each)) if len(each) > 1 else F.max(each[0])).first()
    low, high = ends[0], ends[1]
    place = lambda x: F.least(F.floor((x - F.lit(low)) * levels / F.lit(high - low)), F.lit(levels - 1)).cast("int") if low is not None and high > low else F.lit(0)
    shade = lambda x: F.when(x.isNotNull(), place(x))
    return table.withColumns({f"{c}_heat": shade(x) for c, x in zip(columns, each)})


def summary_array(ds: Dataset, amount: str = "_freq_", most: int = 10_000_000) -> tuple[np.ndarray, dict[str, list]]:
    """A summary's cells (without marginal rows) as an array with an axis per condition column, and the values of the axes.

    Missing cells are NaN. The array is made on the driver, so more than `most` cells are an error.
    """
    axes = axes_of(ds)
    cells = full_level(ds).select(*[F.col(f"`{a}`") for a in axes], F.col(f"`{amount}`").cast("double").alias("__x"))
    if (n := cells.count()) > most:
        raise ValueError(f"{n} cells are more than {most}")
    frame = cells.collect()
    names = {a: sorted({r[i] for r in frame}, key=lambda v: (v is not None, v)) for i, a in enumerate(axes)}
    shape = tuple(len(v) for v in names.values())
    if int(np.prod(shape, dtype=object)) > most:
        raise ValueError(f"an array of shape {shape} has more than {most} cells")
    place = [{v: k for k, v in enumerate(vs)} for vs in names.values()]
    out = np.full(shape, np.nan)
    for r in frame:
        if r["__x"] is not None:
            out[tuple(p[r[i]] for i, p in enumerate(place))] = r["__x"]
    return out, names
