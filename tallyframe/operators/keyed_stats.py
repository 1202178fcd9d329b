"""Per-key counts, moments and exact quantiles when a few keys hold most rows.

No stage groups the rows of a key: every pass counts values into bins per key with map-side
combination, so a task sends at most (keys x bins) partial counts, however many rows a key has.

Pass 1 counts each key's values into fixed, signed, logarithmic bins, each with its count, sum,
least and greatest value; moments are sums over these. For every wanted rank the bin that holds it is
chosen. If the bin's least and greatest value agree, the rank is resolved. Otherwise the next pass
counts only the rows that lie in that bin's range into `BINS` equal parts of it, and so on. Ranges
shrink to the observed extremes, so a pass divides a range by at least BINS, and two distinct doubles
are always told apart in the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.operators.quantiles import choose
from tallyframe.plans.scale import cut, join_small

BINS = 256
#: Signed logarithmic bins of the first pass: this many per factor of e.
FIRST = 16


def _quantile_ranks(n: Column, p: float) -> list[Column]:
    """The two ranks (from 1) whose mean is the quantile under SAS definition 5."""
    np_ = n * F.lit(p)
    j = F.floor(np_)
    exact = np_ == j
    clamp = lambda r: F.greatest(F.lit(1), F.least(n, r)).cast("bigint")
    return [clamp(F.when(exact, j).otherwise(j + 1)), clamp(j + 1)]


def keyed_stats(df: DataFrame, keys: list[str], value: str, probs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per key: n_rows, n_value, sum_value, mean_value, min_value, max_value, q<100p> per p, row_share.

    Null is a key. Null and NaN values count in n_rows only; a key without values has n_value 0 and
    null statistics. Infinities are values (mean and sum follow IEEE rules). Quantiles are exact,
    SAS definition 5. An empty table gives no rows; other columns of df are ignored.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    v = F.col(f"`{value}`").cast("double")
    base = df.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, names)], F.when(~F.isnan(v), v).alias("v"))
    a = F.abs("v")
    first = F.when(F.col("v").isNotNull(), (F.signum("v") * F.when(a == float("inf"), 20000).otherwise(F.floor(F.log1p(a) * FIRST) + F.when(a > 0, 1).otherwise(0))).cast("int"))
    hist = cut(
        base.groupBy(*names, first.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo_seen"), F.max("v").alias("hi_seen")
        )
    )
    has = F.col("bin").isNotNull()
    moments = hist.groupBy(*names).agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_value"), F.sum("s").alias("sum_value"), F.min("lo_seen").alias("min_value"), F.max("hi_seen").alias("max_value")
    )
    total = hist.agg(F.sum("n")).first()[0] or 0

    targets = [(f"q{100 * p:g}".replace(".", "_"), p) for p in probs]
    ranks = F.array(*[F.struct(F.lit(i).alias("target"), r.cast("double").alias("at"), F.lit(False).alias("strict")) for t, (_, p) in enumerate(targets) for i, r in zip((2 * t, 2 * t + 1), _quantile_ranks(F.col("n_value"), p))])
    resolved = None
    if probs:
        wanted = moments.where("n_value > 0").select(*[F.col(k).alias(f"r_{k}") for k in names], F.col("n_value").cast("double").alias("total"), ranks.alias("goals"))
        cells = hist.where(has).join(wanted, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in names]).select(*names, "total", "goals", F.col("lo_seen").alias("lo"), F.col("hi_seen").alias("hi"), "n", F.col("n").cast("double").alias("bw"), F.lit(0.0).alias("before"))
        state = cut(choose(cells, names, names))
        done = [state.where("lo = hi")]
        todo = state.where("lo < hi")
        area = [*names, "total", "r_lo", "r_hi", "before"]
        while left := todo.count():
            # A range that several ranks lie in is one range: a row is counted once a pass.
            ranges = todo.select(*names, "total", "goals", F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"), "before")
            rows = join_small(base.where("v is not null"), ranges, names, left).where("v between r_lo and r_hi")
            # Divided before it is subtracted: hi - lo may exceed the greatest double.
            part = (F.col("v") / 2 - F.col("r_lo") / 2) / (F.col("r_hi") / 2 - F.col("r_lo") / 2)
            placed = F.when(F.col("v") == F.col("r_hi"), BINS - 1).when(F.col("v") == F.col("r_lo"), 0).when(F.isnan(part), BINS // 2).otherwise(F.least(F.lit(BINS - 1), F.floor(part * BINS))).cast("int")
            counts = rows.groupBy(*area, "goals", placed.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            state = cut(choose(counts.withColumn("bw", F.col("n").cast("double")), area, names))
            done.append(state.where("lo = hi"))
            todo = state.where("lo < hi")
        resolved = reduce(DataFrame.unionByName, done).select(*names, F.explode("goals.target").alias("target"), "lo")
        resolved = resolved.groupBy(*names).agg(*[F.sum(F.when(F.col("target").isin(2 * i, 2 * i + 1), F.col("lo") / 2)).alias(q) for i, (q, _) in enumerate(targets)])
        resolved = resolved.select(*[F.col(k).alias(f"r_{k}") for k in names], *[q for q, _ in targets])
    out = moments
    if resolved is not None:
        out = out.join(resolved, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in names], "left")
    return out.select(
        *[F.col(a).alias(k) for k, a in zip(keys, names)], "n_rows", "n_value", "sum_value", F.try_divide("sum_value", "n_value").alias("mean_value"), "min_value", "max_value",
        *[q for q, _ in targets if probs], (F.col("n_rows") / F.lit(max(total, 1))).alias("row_share"),
    )


def heavy_keys(stats: DataFrame, share: float = 0.01) -> DataFrame:
    """The keys of keyed_stats that hold more than `share` of all rows and have no null part."""
    return stats.where(F.col("row_share") > share)
