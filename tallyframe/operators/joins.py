"""Equi-joins of two datasets on several keys, with renaming, and defaults for unmatched rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F


def _renames(columns: list[str]) -> dict[str, str]:
    """"old=new" or "name" -> {old: new}."""
    pairs = [c.split("=", 1) if "=" in c else (c, c) for c in columns]
    return {old.strip(): new.strip() for old, new in pairs}


def _prepared(left: DataFrame, left_keys: list[str], left_data: list[str], right: DataFrame, right_keys: list[str], right_data: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    lk, rk, ld, rd = map(_renames, (left_keys, right_keys, left_data, right_data))
    if sorted(lk.values()) != sorted(rk.values()):
        raise ValueError(f"the join keys differ: {sorted(lk.values())} and {sorted(rk.values())}")
    keys = list(lk.values())
    names = keys + list(ld.values()) + list(rd.values())
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"columns given twice: {sorted(twice)}")
    pick = lambda df, m: [F.col(f"`{o}`").alias(n) for o, n in m.items()]
    return left.select(*pick(left, lk), *pick(left, ld)), right.select(*pick(right, rk), *pick(right, rd)), keys


def inner_join(left: DataFrame, left_keys: list[str], left_data: list[str], right: DataFrame, right_keys: list[str], right_data: list[str]) -> DataFrame:
    """Many-to-many inner join. Columns may be given as old=new; the renamed keys of both sides must agree.

    Null keys match nothing. The join strategy and the splitting of skewed keys are left to the optimiser.
    """
    a, b, keys = _prepared(left, left_keys, left_data, right, right_keys, right_data)
    return a.join(b, keys, "inner")


def left_outer_join(left: DataFrame, left_keys: list[str], left_data: list[str], right: DataFrame, right_keys: list[str], right_data: list[str], default: dict[str, Any] | None = None) -> DataFrame:
    """Left outer join; the right columns of unmatched left rows take the given defaults.

    A matched null stays null.
    """
    a, b, keys = _prepared(left, left_keys, left_data, right, right_keys, right_data)
    joined = a.join(b.withColumn("__matched", F.lit(True)), keys, "left")
    for c, v in (default or {}).items():
        joined = joined.withColumn(c, F.when(F.col("__matched"), F.col(f"`{c}`")).otherwise(F.lit(v)))
    return joined.drop("__matched")
