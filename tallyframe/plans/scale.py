"""Plan-shape helpers shared by the operators: lineage cuts, size-checked broadcasts, salting."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows up to which a side may be broadcast. The rows of every caller are a few dozen bytes wide.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir.

    Where none is set and everything runs in this process, a temporary folder is made and removed at exit; on a
    cluster other machines could not read that, so it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tallyframe-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there; survives a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on keys, null being a key like any other."""
    cond = F.lit(True)
    for i, k in enumerate(keys):
        test = left[k].eqNullSafe(right[k])
        cond = test if i == 0 else cond & test
    return cond


def row_salt(salts: int) -> Column:
    """A number below salts that goes round with a row's place in its partition, whatever the row holds."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")


def join_small(big: DataFrame, small: DataFrame, keys: list[str], small_rows: int, how: str = "inner", salts: int = 32) -> DataFrame:
    """Null-safe equi-join of big with small, where small has few rows per key.

    small_rows, the counted rows of small, decides: a broadcast up to BROADCAST_ROWS, beyond it a
    shuffle join in which every key of big is spread over `salts` tasks and small is repeated as often. A row's
    salt is its place in its partition, so equal rows of a hot key are spread too.
    """
    renamed = small.select([F.col(c).alias(f"__s_{c}" if c in keys else c) for c in small.columns])
    if small_rows <= BROADCAST_ROWS:
        cond = [big[k].eqNullSafe(renamed[f"__s_{k}"]) for k in keys]
        return big.join(F.broadcast(renamed), cond or F.lit(True), how).drop(*[f"__s_{k}" for k in keys])
    left = big.withColumn("__salt", row_salt(salts))
    right = renamed.withColumn("__s_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cond = [left[k].eqNullSafe(right[f"__s_{k}"]) for k in keys] + [left["__salt"] == right["__s_salt"]]
    return left.join(right, cond, how).drop("__salt", "__s_salt", *[f"__s_{k}" for k in keys])
