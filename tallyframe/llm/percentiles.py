"""Mergeable percentiles of numeric columns with a guaranteed relative error.

Values are counted in signed logarithmic buckets: with accuracy a and g = (1 + a) / (1 - a), a
positive v falls in bucket i = ceil(log_g v), which covers (g^(i-1), g^i], and 2 g^i / (g + 1) is
within a relative error of a of every value in it. Negative values mirror this, zero has its own
bucket. Two sketches are combined by adding the counts of equal buckets, so sketches of loads, days
or partitions give exactly the sketch of all their rows. The number of buckets of a key depends on
the spread of its values (at most about 1500 / a), never on the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bucket codes of +v start here and those of -v end at its negative; infinities get twice as much.
OFFSET = 1 << 20


def bucket(v: Column, accuracy: float) -> Column:
    """The code of v's bucket, ascending in v; null for null and NaN."""
    if not 0.001 <= accuracy < 1:
        raise ValueError("accuracy must be in [0.001, 1)")
    a = F.abs(v)
    i = F.when((a > 0) & (a < float("inf")), F.ceil(F.ln(a) / F.lit(math.log((1 + accuracy) / (1 - accuracy)))))
    code = F.when(v == 0, F.lit(0)).when(a == float("inf"), F.lit(2 * OFFSET)).otherwise(i + OFFSET)
    return F.when(v.isNull() | F.isnan(v), None).when(v < 0, -code).otherwise(code).cast("int")


def bucket_value(code: Column, accuracy: Column) -> Column:
    g = (1 + accuracy) / (1 - accuracy)
    size = F.when(F.abs(code) == 2 * OFFSET, F.lit(float("inf"))).otherwise(F.exp((F.abs(code) - OFFSET) * F.ln(g)) * (2 / (g + 1)))
    return F.when(code == 0, F.lit(0.0)).otherwise(F.signum(code) * size)


def sketch(df: DataFrame, columns: list[str], keys: list[str], accuracy: float = 0.01) -> DataFrame:
    """column_name, the keys, bucket, accuracy, n: the counted buckets of each column per key.

    The accuracy goes with the sketch, as buckets of another width mean other values. Null is a key. The bucket null holds the null and NaN values. An empty table gives an empty sketch.
    One scan, one shuffle of counts already added up in each task.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), bucket(F.col(f"`{c}`").cast("double"), accuracy).alias("bucket")) for c in columns])
    long = df.select(*[F.col(f"`{k}`") for k in keys], F.explode(cells).alias("__c"))
    counted = long.groupBy(F.col("__c.column_name").alias("column_name"), *keys, F.col("__c.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("column_name", *keys, "bucket", F.lit(float(accuracy)).alias("accuracy"), "n")


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Add up sketches (a union of them, or one at finer keys) to the given keys.

    Sketches of different accuracy have no common buckets: to add them up is an error when the plan runs.
    """
    most = F.max("accuracy")
    same = F.when(F.min("accuracy") == most, most).otherwise(F.raise_error(F.lit("sketches of different accuracy")).cast("double"))
    return sketches.groupBy("column_name", *keys, "bucket").agg(same.alias("accuracy"), F.sum("n").alias("n"))


def percentiles(sketched: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """column_name, keys, n_values, n_missing, p, estimate, max_relative_error.

    The estimate is within the relative error of the value of rank floor(p (n - 1)) from 0 in sort
    order. A key without values gets null estimates. The relative error is the accuracy of the sketch; a key whose
    buckets have several accuracies is an error when the plan runs.
    """
    group = ["column_name", *keys]
    w = Window.partitionBy(*group)
    valued = F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(F.lit(0))
    run = sketched.withColumn("upto", F.sum(valued).over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum(valued).over(w))
    hits = [
        F.min(F.when(F.col("bucket").isNotNull() & (F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1))), F.col("bucket"))).alias(f"b{i}") for i, p in enumerate(probs)
    ]
    one = F.when(F.min("accuracy") == F.max("accuracy"), F.max("accuracy")).otherwise(F.raise_error(F.lit("sketches of different accuracy")).cast("double"))
    per_key = run.groupBy(*group).agg(one.alias("__accuracy"), F.sum(valued).alias("n_values"), (F.sum("n") - F.sum(valued)).alias("n_missing"), *hits)
    rows = F.array(*[F.struct(F.lit(p).alias("p"), bucket_value(F.col(f"b{i}"), F.col("__accuracy")).alias("estimate")) for i, p in enumerate(probs)])
    out = per_key.select(*group, "n_values", "n_missing", "__accuracy", F.explode(rows).alias("__r"))
    return out.select(*group, "n_values", "n_missing", F.col("__r.p").alias("p"), F.col("__r.estimate").alias("estimate"), F.col("__accuracy").alias("max_relative_error"))
