"""Exact quantiles of many groupings at once, without gathering the values of a group.

1. One scan counts rows and weights into signed logarithmic bins per finest cell, combined map-side. Bins of
   every coarser grouping are added up from these counts, not from rows.
2. The bin that holds a wanted rank is found from the running weights of a cell. A bin whose least and greatest
   value agree is an answer.
3. While a chosen bin has more than `GATHER` rows, one scan counts the rows of all chosen bins, of all groupings,
   into `PARTS` equal parts of their observed range, and so on. The range of a bin shrinks by at least that factor.
4. What is left has at most `GATHER` rows a bin: one scan counts them value by value, and they are ordered per bin.

So no task orders more than `GATHER` values of a cell, however many rows the cell has or how close its values lie.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.operators.measures import quantile
from tallyframe.plans.scale import cut, join_small

#: Signed logarithmic bins of the first scan: this many per factor of e. Parts of a bin in later scans.
FINE, PARTS = 64, 1024
#: Rows of a bin up to which its values are ordered in one task.
GATHER = 100_000


def _groupings(df: DataFrame, names: list[str], sets: list[tuple[int, list[str]]]) -> DataFrame:
    """df once for every grouping (its number in __set), keys that it lacks being null."""
    kinds = dict(df.dtypes)
    one = lambda i, keys: F.struct(F.lit(i).alias("__set"), *[(F.col(k) if k in keys else F.lit(None).cast(kinds[k])).alias(k) for k in names])
    rest = [c for c in df.columns if c not in names]
    if len(sets) == 1:
        return df.select(F.lit(sets[0][0]).alias("__set"), *[(F.col(k) if k in sets[0][1] else F.lit(None).cast(kinds[k])).alias(k) for k in names], *rest)
    out = df.select(F.explode(F.array(*[one(i, keys) for i, keys in sets])).alias("__g"), *rest)
    return out.select("__g.*", *rest)


def choose(bins: DataFrame, area: list[str], cell: list[str]) -> DataFrame:
    """cell, total, goals, lo, hi, n, before: the bins that hold a goal, the first of its area whose running weight reaches it, else the last.

    bins has a row per bin of an area, with the weight before the area, the total of the cell, and the goals of the area:
    (target, at, strict), to be reached or, if strict, exceeded.
    """
    order = Window.partitionBy(*area).orderBy("lo")
    run = bins.withColumn("upto", F.col("before") + F.sum("bw").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumns({"under": F.lag("upto").over(order), "last": F.lead("lo").over(order).isNull()})

    def here(g: Column) -> Column:
        reached = F.when(g["strict"], F.col("upto") > g["at"]).otherwise(F.col("upto") >= g["at"])
        sooner = F.when(g["strict"], F.col("under") > g["at"]).otherwise(F.col("under") >= g["at"])
        return (reached | F.col("last")) & ~F.coalesce(sooner, F.lit(False))

    picked = run.select(*cell, "total", "lo", "hi", "n", F.coalesce("under", "before").alias("before"), F.filter("goals", here).alias("goals"))
    return picked.where("total > 0 and size(goals) > 0")


def rank_values(rows: DataFrame, sets: list[tuple[int, list[str]]], measures: list[quantile]) -> DataFrame:
    """__set, the keys of all sets, and one column per measure: exact quantiles of every cell of every set.

    sets: (number, key columns) of the groupings. All measures have the same column and weight. Runs jobs.
    """
    m = measures[0]
    x, w = m.values()
    keys = list(dict.fromkeys(k for _, s in sets for k in s))
    names = [f"__k{i}" for i in range(len(keys))]
    mine = [(i, [names[keys.index(k)] for k in s]) for i, s in sets]
    a = F.abs("x")
    code = F.signum("x") * F.when(a == float("inf"), 1e6).otherwise(F.floor(F.log1p(a) * FINE) + F.when(a > 0, 1).otherwise(0))
    base = rows.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], x.alias("x"), w.alias("w")).where("x is not null")
    extremes = [F.sum("w").alias("bw"), F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    again = [F.sum("bw").alias("bw"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    finest = base.groupBy(*names, code.cast("int").alias("bin")).agg(*extremes)
    bins = _groupings(cut(finest) if len(mine) > 1 else finest, names, mine).groupBy("__set", *names, "bin").agg(*again)
    targets = [t for one in measures for t in one.targets(F.col("total"))]
    cell = ["__set", *names]
    goals = F.array(*[F.struct(F.lit(i).alias("target"), F.least(t, F.col("total")).alias("at"), F.lit(strict).alias("strict")) for i, (t, strict) in enumerate(targets)])
    # The total is the running weight of the last bin, so that both are the same double.
    upto = F.sum("bw").over(Window.partitionBy(*cell).orderBy("lo").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumn("upto", upto).withColumn("total", F.max("upto").over(Window.partitionBy(*cell))).withColumns({"goals": goals, "before": F.lit(0.0)})
    state = cut(choose(bins, cell, cell))
    done = [state.where("lo = hi")]
    todo = state.where("lo < hi")
    of_sets = _groupings(base, names, mine)

    def inside(state: DataFrame, number: int) -> DataFrame:
        """The rows that lie in the bins of state, each with its bin's range and goals."""
        ranges = state.select(*cell, "total", F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"), "before", "goals")
        return join_small(of_sets, ranges, cell, number).where("x between r_lo and r_hi")

    def left(todo: DataFrame) -> tuple[int, int]:
        """The bins that are too large to be gathered, and all."""
        row = todo.agg(F.count_if(F.col("n") > GATHER), F.count(F.lit(1))).first()
        return row[0], row[1]

    area = [*cell, "r_lo", "r_hi", "before", "total"]
    large, number = left(todo)
    while large:
        # Halved first: the range of two doubles may exceed the greatest double.
        part = (F.col("x") / 2 - F.col("r_lo") / 2) / (F.col("r_hi") / 2 - F.col("r_lo") / 2)
        placed = F.when(F.col("x") == F.col("r_hi"), PARTS - 1).when(F.col("x") == F.col("r_lo"), 0).when(F.isnan(part), PARTS // 2).otherwise(F.least(F.lit(PARTS - 1), F.floor(part * PARTS))).cast("int")
        counted = inside(todo.where(F.col("n") > GATHER), large).groupBy(*area, "goals", placed.alias("bin")).agg(*extremes)
        state = cut(choose(counted, area, cell).unionByName(todo.where(F.col("n") <= GATHER)))
        done.append(state.where("lo = hi"))
        todo = state.where("lo < hi")
        large, number = left(todo)
    answers = [d.select(*cell, "total", "goals", F.col("lo").alias("x")) for d in done]
    if number:
        # A bin goes to one task at once: it has at most GATHER rows.
        values = inside(todo, number).repartition(*area).groupBy(*area, "goals", "x").agg(F.sum("w").alias("bw")).withColumns({"lo": F.col("x"), "hi": F.col("x"), "n": F.lit(1).cast("bigint")})
        answers.append(choose(values, area, cell).select(*cell, "total", "goals", F.col("lo").alias("x")))
    found = reduce(DataFrame.unionByName, answers).select(*cell, "total", F.explode("goals").alias("goal"), "x")
    got = found.groupBy(*cell).agg(F.max("total").alias("total"), *[F.max(F.when(F.col("goal.target") == i, F.col("x"))).alias(f"t{i}") for i in range(len(targets))])
    out, i = {}, 0
    for one in measures:
        n = len(one.targets(F.col("total")))
        out |= one.closed([F.col(f"t{k}") for k in range(i, i + n)], F.col("total"))
        i += n
    return got.select("__set", *[F.col(n).alias(k) for n, k in zip(names, keys)], *[e.alias(n) for n, e in out.items()])
