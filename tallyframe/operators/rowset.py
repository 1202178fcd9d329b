"""Row ordinals, slices, exact samples, and the algebra of sets of row ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyframe.plans.scale import BROADCAST_ROWS, cut


def with_ordinals(df: DataFrame, order_by: list[str] | None = None, name: str = "row_ordinal") -> DataFrame:
    """df with dense ordinals 0..n-1 in the given order (nulls first), or in the order of the input partitions.

    Ordinals are ranks within a partition plus the rows of the partitions before; no task sees all rows.
    With order_by, rows are range-partitioned by sampled bounds first. Ties get ordinals in any order, and a row's
    place in the input is part of the range key, so a value that many rows share is split too.
    """
    if order_by:
        # __place is no sort key of the caller: it only divides ties.
        keys = [*[F.col(f"`{c}`") for c in order_by], F.col("__place")]
        df = df.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__place")
    # The id holds the partition in its upper bits and the rank in it in the lower 33. Written once, so both uses see the same.
    kept = cut(df.withColumn("__id", F.monotonically_increasing_id()))
    part, rank = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    joined = kept.join(F.broadcast(before), part == F.col("__part"))  # a row per partition
    return joined.withColumn(name, rank + F.col("__before")).drop("__id", "__part", "__before")


def take_rows(df: DataFrame, ordinals: DataFrame | list[int], ordinal: str = "row_ordinal") -> DataFrame:
    """The rows with the given ordinals (a list, or the first column of a DataFrame), each once; null and unknown ones give none.

    A list becomes a condition on the ordinal that reaches the scan; a DataFrame is joined by equality.
    """
    if isinstance(ordinals, list):
        return df.where(F.col(f"`{ordinal}`").isin(sorted({o for o in ordinals if o is not None})))
    return df.join(_one(ordinals).select(F.col("v").alias("__o")), F.col(f"`{ordinal}`") == F.col("__o"), "left_semi")


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, ordinal: str = "row_ordinal") -> DataFrame:
    """The rows a Python slice picks by ordinal; negative bounds count from the end, a negative step only picks."""
    if step == 0:
        raise ValueError("the step must not be zero")
    o = F.col(f"`{ordinal}`")
    if any(v is not None and v < 0 for v in (start, stop)) or step < 0:
        n = (df.agg(F.max(o)).first()[0] or -1) + 1
        picked = range(n)[slice(start, stop, step)]
        if not len(picked):
            return df.where(F.lit(False))
        low, high, jump = min(picked[0], picked[-1]), max(picked[0], picked[-1]), abs(step)
        return df.where((o >= low) & (o <= high) & ((o - low) % jump == 0))
    low = start or 0
    cond = o >= low
    if stop is not None:
        cond = cond & (o < stop)
    return df.where(cond & ((o - low) % step == 0) if step > 1 else cond)


def page(df: DataFrame, number: int, size: int, ordinal: str = "row_ordinal") -> DataFrame:
    """Page `number` (from 0) of a listing."""
    return slice_rows(df, number * size, (number + 1) * size, ordinal=ordinal)


def sample_rows(df: DataFrame, fraction: float, seed: int = 1, ordinal: str = "row_ordinal") -> DataFrame:
    """Exactly int(n * fraction) draws with replacement; a row drawn k times comes out k times.

    The drawn ordinals are made by a range of numbers on the executors and joined by equality.
    """
    n = df.count()
    draws = int(n * fraction)
    spark = df.sparkSession
    if not draws:
        return df.limit(0)
    drawn = spark.range(draws).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("__drawn"))
    counted = drawn.groupBy("__drawn").agg(F.count(F.lit(1)).cast("int").alias("__times"))
    return df.join(counted, F.col(f"`{ordinal}`") == F.col("__drawn")).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__drawn", "__times", "__i")


def _one(df: DataFrame) -> DataFrame:
    return df.select(F.col(f"`{df.columns[0]}`").alias("v"))


def unique(*sets: DataFrame) -> DataFrame:
    """The distinct values of one set or several."""
    _told("unique", sets)
    return reduce(DataFrame.unionAll, map(_one, sets)).distinct()


def union(*sets: DataFrame) -> DataFrame:
    return unique(*sets)


def intersect_by(a: DataFrame, b: DataFrame, method: str = "auto") -> DataFrame:
    """Values in both sets, by a chosen algorithm.

    sparse: the smaller set is broadcast and looked up in the other, for sets of very different size; only up to
    BROADCAST_ROWS of it, as counted, otherwise by shuffle. dense: one shuffle of both. auto leaves it to the optimiser.
    """
    left, right = _one(a).distinct(), _one(b).distinct()
    if method == "auto":
        return intersect(a, b)
    if method == "dense":
        return left.join(right.hint("shuffle_hash"), "v", "left_semi")
    if method != "sparse":
        raise ValueError(f"unknown method {method!r}")
    n_left, n_right = left.count(), right.count()
    big, small, n = (left, right, n_right) if n_right <= n_left else (right, left, n_left)
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, "v", "left_semi")


def preload(df: DataFrame) -> DataFrame:
    """df kept in memory and on local disk from its first use on, a hint that it will be read again; results do not change.

    A lost executor's part is read again from its source.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


_instrument: Callable[[str, int], None] | None = None


def set_instrument(function: Callable[[str, int], None] | None) -> None:
    """Call function(operation, number of sets) whenever a set operation is planned; None to stop. For debugging."""
    global _instrument
    _instrument = function


def _told(operation: str, sets: tuple[DataFrame, ...]) -> None:
    if _instrument is not None:
        _instrument(operation, len(sets))


def _membership(sets: tuple[DataFrame, ...]) -> DataFrame:
    """v and the bits of the sets that hold it: one shuffle for any number of sets."""
    tagged = reduce(DataFrame.unionAll, [_one(s).withColumn("bit", F.lit(1 << i).cast("bigint")) for i, s in enumerate(sets)])
    return tagged.groupBy("v").agg(F.bit_or("bit").alias("bits"))


def intersect(*sets: DataFrame) -> DataFrame:
    """Values in every set."""
    _told("intersect", sets)
    return _membership(sets).where(F.col("bits") == (1 << len(sets)) - 1).select("v")


def difference(*sets: DataFrame) -> DataFrame:
    """Values of the first set that are in none of the others."""
    _told("difference", sets)
    return _membership(sets).where(F.col("bits") == 1).select("v")


def outersect(*sets: DataFrame) -> DataFrame:
    """Values that are not in every set."""
    _told("outersect", sets)
    return _membership(sets).where(F.col("bits") != (1 << len(sets)) - 1).select("v")


def value_positions(a: DataFrame, b: DataFrame, value: str = "v", ordinal: str = "row_ordinal") -> DataFrame:
    """Positions in a (its ordinals) of the values in b."""
    return a.join(_one(b).select(F.col("v").alias("__b")).distinct(), F.col(f"`{value}`") == F.col("__b"), "left_semi").select(F.col(f"`{ordinal}`").alias("pos"))


def strip_word(c: Column) -> Column:
    """A word without apostrophes, in capitals."""
    return F.upper(F.replace(c, F.lit("'"), F.lit("")))


def cardinality(df: DataFrame, column: str) -> DataFrame:
    """The number of distinct values of a column (elements of a multi-valued one); null counts as a value."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.ArrayType):
        df, c = df.select(F.explode_outer(F.when(F.size(c) > 0, c)).alias("v")), F.col("v")
    return df.agg((F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))).cast("bigint").alias("cardinality"))
