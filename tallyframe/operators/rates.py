"""Crude, directly standardised, stratified and indirectly standardised rates.

Events are the cells of a summary over axes X. Population and standard are summed out to the axes they
share with X and joined on those. What follows is the size of the tables' cells; the
inverse gamma function runs vectorised over the resulting rows only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions import special as sp
from tallyframe.functions.intervals import alpha_of
from tallyframe.meta import ColumnMeta, Dataset
from tallyframe.operators.tables import aligned, amounts_of, attach, axes_of, collapse, full_level


def _gamma_quantile(p: float, shape: Column) -> Column:
    """x with P(X <= x) = p for a gamma variable of unit scale; null for shapes that are not positive."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for a in parts:
            out = np.full(len(a), np.nan)
            ok = (a.notna() & (a > 0)).to_numpy()
            if ok.any():
                out[ok] = sp.gamma_quantile(p, a.to_numpy(float)[ok])
            yield pd.Series(out).where(ok)

    return F.pandas_udf(run, "double")(shape.cast("double"))


def _poisson(n: Column, conflev: float, zero_upper: float | None = None) -> tuple[Column, Column]:
    """Exact limits of a count; zero_upper: the upper limit for no events if it is not the exact one."""
    a2 = alpha_of(conflev) / 2
    low = F.when(n == 0, F.lit(0.0)).otherwise(_gamma_quantile(a2, n))
    high = _gamma_quantile(1 - a2, n + 1)
    return low, high if zero_upper is None else F.when(n == 0, F.lit(zero_upper)).otherwise(high)


def _freqs(ds: Dataset) -> dict[str, str]:
    """The frequency columns and what is added to the names of their results."""
    return {c: "" if c == "_freq_" else c.replace("freq", "", 1) for c in amounts_of(ds) if c == "_freq_" or c.startswith("freq_wgtd_by")}


def _result(df: DataFrame, ds: Dataset, name: str, axes: list[str]) -> Dataset:
    meta = {a: ds.meta(a) for a in axes} | {c: ColumnMeta("scalar") for c in df.columns if c not in axes}
    return Dataset(df, f"{name}_{ds.name}", meta, "_freq_" if "_freq_" in df.columns else None)


def direct_rates(events: Dataset, population: Dataset, standard: Dataset | None = None, conflev: float | None = 0.95, basepop: float = 100_000, ci_method: str = "dobson", pop_column: str = "_freq_", std_column: str = "_stdpop_") -> Dataset:
    """Crude rates and, given a standard population, directly standardised ones.

    The first axis of events is standardised over; a row per combination of the others with summfreq,
    popfreq, std_strata_summfreq, cr, cr_ll, cr_ul, dsr, dsr_ll, dsr_ul. Limits of dsr (for _freq_ only):
    dobson or ff (Fay and Feuer). Cells without population or standard have no rate and are left out of sums.
    """
    if ci_method not in ("dobson", "ff"):
        raise ValueError("ci_method must be dobson or ff")
    axes = axes_of(events)
    if not axes:
        raise ValueError("events need an axis to standardise over")
    over, rest = axes[0], axes[1:]
    freqs = _freqs(events)
    cells = full_level(events).select(*axes, *[F.col(f"`{f}`").cast("double").alias(f"__d{i}") for i, f in enumerate(freqs)])
    cells = aligned(cells, axes, population, pop_column, "__p")
    p = F.when(F.col("__p") > 0, F.col("__p"))
    if standard is not None:
        std_axes = [a for a in axes if a in axes_of(standard)]
        std = collapse(full_level(standard), std_axes, [std_column])
        # The standard counts as far as the events' axes reach.
        for a in std_axes:
            values = cells.select(F.col(f"`{a}`").alias("__v")).distinct()
            std = std.join(values, std[a].eqNullSafe(values["__v"]), "left_semi")
        others = [a for a in std_axes if a != over]
        totals = collapse(std, others, [std_column])
        cells = attach(attach(cells, std, std_axes, {std_column: "__s"}), totals, others, {std_column: "__st"})
        cells = cells.withColumn("__w", F.try_divide("__s", "__st")).withColumn("__wp", F.try_divide(F.col("__w"), p))
        if ci_method == "ff":
            cells = attach(cells, cells.agg(F.max("__wp").alias("__wm")), [], {"__wm": "__wm"})
    sums = [F.sum("__p").alias("__pop")]
    for i in range(len(freqs)):
        d = F.col(f"__d{i}")
        sums.append(F.sum(d).alias(f"__e{i}"))
        if standard is not None:
            sums += [F.sum(F.when(F.col("__w").isNotNull(), d)).alias(f"__es{i}"), F.sum(d * F.col("__wp")).alias(f"__r{i}"), F.sum(d * F.col("__wp") * F.col("__wp")).alias(f"__v{i}")]
            if ci_method == "ff":
                sums.append(F.max("__wm").alias("__wm")) if i == 0 else None
    g = cells.groupBy(*rest).agg(*sums) if rest else cells.agg(*sums)
    out: list[Column] = []
    base = float(basepop)
    for i, (f, tail) in enumerate(freqs.items()):
        e, pop = F.col(f"__e{i}"), F.when(F.col("__pop") > 0, F.col("__pop"))
        out += [e.alias(f"summfreq{tail}"), F.col("__pop").alias(f"popfreq{tail}"), (e / pop * base).alias(f"cr{tail}")]
        if conflev is not None:
            low, high = _poisson(e, conflev)
            out += [(low / pop * base).alias(f"cr_ll{tail}"), (high / pop * base).alias(f"cr_ul{tail}")]
        if standard is None:
            continue
        y, var, n = F.col(f"__r{i}"), F.col(f"__v{i}"), F.col(f"__es{i}")
        out += [n.alias(f"std_strata_summfreq{tail}"), (y * base).alias(f"dsr{tail}")]
        if conflev is None or f != "_freq_":
            continue
        if ci_method == "dobson":
            low, high = _poisson(n, conflev, -math.log(1 - conflev))
            scale = F.sqrt(F.try_divide(var, n))
            low, high = y + scale * (low - n), y + scale * (high - n)
        else:
            a2, wm = alpha_of(conflev) / 2, F.col("__wm")
            low = F.try_divide(var, y) * _gamma_quantile(a2, F.try_divide(y * y, var))
            high = F.try_divide(var + wm * wm, y + wm) * _gamma_quantile(1 - a2, F.try_divide((y + wm) * (y + wm), var + wm * wm))
        out += [(low * base).alias(f"dsr_ll{tail}"), (high * base).alias(f"dsr_ul{tail}")]
    return _result(g.select(*rest, *out), events, "dir_std_rates" if standard is not None else "crude_rates", rest)


def stratified_rates(events: Dataset, population: Dataset, conflev: float | None = 0.95, basepop: float = 100_000, pop_column: str = "_freq_") -> Dataset:
    """A row per cell of events with summfreq, popfreq, sr, sr_ll, sr_ul; null where there is no population."""
    axes, base = axes_of(events), float(basepop)
    freqs = _freqs(events)
    cells = full_level(events).select(*axes, *[F.col(f"`{f}`").cast("double").alias(f"__d{i}") for i, f in enumerate(freqs)])
    cells = aligned(cells, axes, population, pop_column, "__p")
    p = F.when(F.col("__p") > 0, F.col("__p"))
    out: list[Column] = []
    for i, tail in enumerate(freqs.values()):
        d = F.col(f"__d{i}")
        out += [d.alias(f"summfreq{tail}"), F.col("__p").alias(f"popfreq{tail}"), (d / p * base).alias(f"sr{tail}")]
        if conflev is not None:
            low, high = _poisson(d, conflev)
            out += [(low / p * base).alias(f"sr_ll{tail}"), (high / p * base).alias(f"sr_ul{tail}")]
    return _result(cells.select(*axes, *out), events, "stratified_rates", axes)


def indirect_ratios(events: Dataset, population: Dataset, std_events: Dataset, std_population: Dataset, conflev: float | None = 0.95, baseratio: float = 100, pop_column: str = "_freq_", std_pop_column: str = "_freq_") -> Dataset:
    """Observed over expected events: a row per cell of events with observed, expected, popfreq, isr, isr_ll, isr_ul.

    Expected events are the standard's stratum rates applied to the population, which must have all axes of both;
    they are summed out to the axes of events.
    """
    axes, std_axes = axes_of(events), axes_of(std_events)
    every = [*std_axes, *[a for a in axes if a not in std_axes]]
    if lacking := [a for a in every if a not in axes_of(population)]:
        raise ValueError(f"the population lacks the columns {', '.join(lacking)}")
    freqs = {f: t for f, t in _freqs(events).items() if f in _freqs(std_events)}
    rates = full_level(std_events).select(*std_axes, *[F.col(f"`{f}`").cast("double").alias(f"__s{i}") for i, f in enumerate(freqs)])
    rates = aligned(rates, std_axes, std_population, std_pop_column, "__sp")
    rates = rates.select(*std_axes, *[F.try_divide(f"__s{i}", "__sp").alias(f"__rate{i}") for i in range(len(freqs))])
    at_risk = collapse(full_level(population), every, [pop_column]).withColumnRenamed(pop_column, "__p")
    expected = attach(at_risk, rates, std_axes, {f"__rate{i}": f"__rate{i}" for i in range(len(freqs))}, "inner")
    expected = expected.select(*every, "__p", *[(F.col("__p") * F.col(f"__rate{i}")).alias(f"__x{i}") for i in range(len(freqs))])
    expected = collapse(expected, axes, ["__p", *[f"__x{i}" for i in range(len(freqs))]])
    cells = full_level(events).select(*axes, *[F.col(f"`{f}`").cast("double").alias(f"__d{i}") for i, f in enumerate(freqs)])
    cells = attach(cells, expected, axes, {"__p": "popfreq"} | {f"__x{i}": f"__x{i}" for i in range(len(freqs))})
    out: list[Column] = [F.col("popfreq")]
    for i, (f, tail) in enumerate(freqs.items()):
        d, x = F.col(f"__d{i}"), F.when(F.col(f"__x{i}") > 0, F.col(f"__x{i}"))
        out += [d.alias(f"observed{tail}"), F.col(f"__x{i}").alias(f"expected{tail}"), (d / x * baseratio).alias(f"isr{tail}")]
        if conflev is not None and f == "_freq_":
            low, high = _poisson(d, conflev, -math.log(1 - conflev))
            out += [(low / x * baseratio).alias(f"isr_ll{tail}"), (high / x * baseratio).alias(f"isr_ul{tail}")]
    return _result(cells.select(*axes, *out), events, "indir_std_ratios", axes)
