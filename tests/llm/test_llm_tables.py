"""Percentiles, term frequencies and calibrated samples against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import calibrated_sample as cs
from tallyframe.llm.percentiles import merge, percentiles, sketch
from tallyframe.llm.term_frequency import term_frequency


def test_percentile_error_and_merging(spark):
    rng = random.Random(3)
    values = [rng.lognormvariate(2, 2) * rng.choice([1, 1, 1, -1]) for _ in range(3000)] + [0.0] * 40 + [1e-300, -1e300]
    rows = [(i % 3, "r" if i % 2 else None, v) for i, v in enumerate(values)] + [(0, "e", None), (0, "e", math.nan), (1, "inf", math.inf), (1, "inf", -math.inf)]
    df = spark.createDataFrame(rows, "load int, region string, v double").withColumn("n", F.lit(1)).withColumn("bucket", F.lit(1))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    per_load = sketch(df, ["v"], ["load", "region"], 0.01)
    got = percentiles(merge(per_load, ["region"]), ["region"], probs).collect()
    for region in ("r", None):
        v = sorted(x for _, g, x in rows if g == region)
        for r in (r for r in got if r["region"] == region):
            want = v[math.floor(r["p"] * (len(v) - 1))]
            assert r["n_values"] == len(v) and abs(r["estimate"] - want) <= 0.01 * abs(want) * (1 + 1e-9)
    assert {(r["n_values"], r["n_missing"], r["estimate"]) for r in got if r["region"] == "e"} == {(0, 2, None)}
    assert [r["estimate"] for r in got if r["region"] == "inf"][0] == -math.inf
    # Sketches of parts add up to the sketch of the whole.
    parts = [sketch(df.where(F.col("load") == k), ["v"], ["region"], 0.01) for k in range(3)]
    whole = merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["region"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, merge(sketch(df, ["v"], ["region"], 0.01), ["region"]).collect()))
    assert percentiles(sketch(df.limit(0), ["v"], ["region"]), ["region"], probs).count() == 0
    with pytest.raises(ValueError):
        sketch(df, ["v"], [], 0.0)
    # Sketches of different accuracy do not add up silently.
    other = sketch(df, ["v"], ["region"], 0.02)
    assert {r["max_relative_error"] for r in percentiles(other, ["region"], [0.5]).collect()} == {0.02}
    mixed = sketch(df, ["v"], ["region"], 0.01).unionByName(other)
    for bad in (percentiles(mixed, ["region"], probs), merge(mixed, ["region"])):
        with pytest.raises(Exception, match="different accuracy"):
            bad.collect()


def test_term_frequency(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 400), rng.choice(["hot"] * 60 + ["warm"] * 20 + [f"t{i}" for i in range(60)] + [None]), rng.choice(["1", "2"])) for _ in range(3000)]
    rows += rows[:500] + [(None, "only", "1"), (7, "a:b", "1")]
    df = spark.createDataFrame(rows, "rec int, term string, reg string").withColumn("f", F.lit("x")).withColumn("record", F.lit(0))
    got = {(r["field_name"], r["field_value"]): (r["n_rows"], r["n_records"], r["mark"]) for r in term_frequency(df, "rec", {"term": F.col("term"), "reg": F.col("reg")}).collect()}
    total = len({r for r, _, _ in rows if r is not None})
    want = {}
    for name, at in (("term", 1), ("reg", 2)):
        for t in {r[at] for r in rows if r[at] is not None}:
            n, k = sum(r[at] == t for r in rows), len({r[0] for r in rows if r[at] == t and r[0] is not None})
            want[name, t] = (n, k, "rare" if k < 5 else "common" if k / total > 0.05 else None)
    assert got == want
    assert term_frequency(df.limit(0), "rec", {"term": F.col("term")}).count() == 0


def test_calibration_reproduces_totals():
    """Two overlapping margins, two cells each: the totals are met and every cell is a product of a factor per margin."""
    start, cells = np.array([10.0, 20, 30, 5]), np.array([[1, 0, 1, 0], [1, 0, 0, 1], [0, 1, 1, 0], [0, 1, 0, 1]])
    totals = np.array([30, 20, 25, 25.0])
    x = cs.calibrate(start, np.zeros(4), np.full(4, 1e9), cells, totals)
    assert cells.T @ x == pytest.approx(totals, abs=1e-3)
    f = x / start
    assert f[0] * f[3] == pytest.approx(f[1] * f[2], rel=1e-4)
    # Limits are kept, and the other cells take over what they may not give.
    x = cs.calibrate(start, np.array([0, 0, 12.0, 0]), np.array([99, 19, 99, 99.0]), cells, totals)
    assert x[1] <= 19 and x[2] >= 12 and cells.T @ x == pytest.approx(totals, abs=1e-3)
    assert cs.calibrate(np.array([5.0, 3.0, 0.0]), np.zeros(3), np.array([9, 2, 9]), np.eye(3), np.array([5.0, 3.0, 0.0])) == pytest.approx([5, 2, 0], abs=1e-3)


def test_calibration_against_projected_search():
    """The least exponential-tilting distance with the penalty of missed margins, by plain coordinate search."""
    rng = np.random.default_rng(8)
    start, low, high = np.array([4.0, 6, 2, 8]), np.array([1.0, 0, 0, 3]), np.array([5.0, 20, 3, 20])
    cells, totals, ridge = np.array([[1, 0, 1], [1, 0, 1], [0, 1, 1], [0, 1, 1.0]]), np.array([14.0, 9, 22]), np.array([0.5, 0.5, 0.01])
    cost = lambda x: float((x * np.log(np.maximum(x, 1e-300) / start) - x + start).sum() + (((totals - cells.T @ x) ** 2) / (2 * ridge)).sum())
    x = cs.calibrate(start, low, high, cells, totals, ridge)
    for _ in range(3000):
        y = np.clip(x + rng.normal(0, 10.0 ** -rng.integers(0, 5), 4), low, high)
        assert cost(y) >= cost(x) - 1e-7


def test_plan():
    cells = pd.DataFrame({"a": [1, 1, 2, None], "b": [1, 2, 1, 2], "available": [1000, 5, 0, 400], "target_ppm": [500_000, 300_000, 100_000, 100_000], "min_rows": [0, 0, 2, 80]})
    p = cs.plan_sample(cells, 100, ["a", "b"])
    assert list(p["required"]) == [50, 30, 10, 80] and list(p["gap"]) == [0, 25, 10, 0] and list(p["goal"])[1:3] == [5, 0]
    assert p["goal"].sum() == 135 and p["goal"].iloc[3] >= 80
    assert cs.required_rows(1, 0, 999_999) == 1 and cs.required_rows(0, 0, 10) == 0
    # What a cell lacks is given by the cell of its own margin, not by the others.
    cells = pd.DataFrame({"a": [1, 1, 2, 2], "b": [1, 2, 1, 2], "available": [10, 1000, 1000, 1000], "target_ppm": [250_000] * 4, "min_rows": [0] * 4})
    p = cs.plan_sample(cells, 400, ["a"])
    assert p["goal"].sum() == 400 and abs(p["goal"].iloc[1] - 190) <= 1 and list(p["goal"].iloc[2:]) == [100, 100]
    report = cs.margin_report(p, ["a"])
    assert list(report["category"]) == ["a", "a", "all"] and report["goal"].iloc[2] == 400
    # Less than the size is there at all: everything is taken, whatever the margins.
    p = cs.plan_sample(cells, 4000, ["a", "b"])
    assert list(p["goal"]) == [10, 1000, 1000, 1000] and cs.margin_report(p, ["a", "b"])["target"].iloc[-1] == 4000


def test_whole_rows():
    rng = np.random.default_rng(9)
    for _ in range(200):
        n = rng.integers(1, 8)
        low, high = rng.integers(0, 5, n), rng.integers(5, 30, n)
        x, total = rng.uniform(low, high), int(rng.integers(0, 200))
        got = cs.whole_rows(x, low, high, total)
        assert (got >= low).all() and (got <= high).all() and got.sum() == min(max(total, low.sum()), high.sum())


def test_pivotal_sizes_and_rates(spark):
    rows = [(i, i % 4) for i in range(4000)]
    prob = F.element_at(F.array(F.lit(0.1), F.lit(0.25), F.lit(1.0), F.lit(0.0)), (F.col("cell") + 1).cast("int"))
    df = spark.createDataFrame(rows, "unit long, cell long").withColumn("prob", prob).withColumn("took", F.lit(1))
    first = cs.pivotal(df, "unit", "cell", "prob").collect()
    assert {c: sum(r["cell"] == c for r in first) for c in range(4)} == {0: 100, 1: 250, 2: 1000, 3: 0}
    assert len({r["unit"] for r in first}) == len(first) and all(r["unit"] % 4 == r["cell"] for r in first)
    assert {tuple(r) for r in first} == {tuple(r) for r in cs.pivotal(df, "unit", "cell", "prob").collect()}
    assert cs.pivotal(df.limit(0), "unit", "cell", "prob").count() == 0


def test_duels_are_fair():
    rng = np.random.default_rng(5)
    cell, p = np.repeat([0, 1], [10, 9]), np.repeat([0.3, 0.7], [10, 9])
    taken = np.zeros(19)
    for _ in range(4000):
        took, left = cs.duels(cell, p, rng.integers(0, 1 << 63, 19).astype(np.uint64))
        assert (took[cell == 0] == 1).sum() == 3 and not (took[cell == 0] == -1).any() and (took[cell == 1] == -1).sum() == 1
        # The sum of a cell is kept: 6 are in, and one is left with what is missing.
        assert (took[cell == 1] == 1).sum() + left[took == -1].sum() == pytest.approx(6.3)
        taken += (took == 1) + np.where(took == -1, left, 0)
    assert taken / 4000 == pytest.approx(p, abs=0.035)


def test_report_and_cells(spark):
    rows = [(i, 1 if i % 3 else None, 2) for i in range(300)] * 2 + [(None, 1, 2)]
    df = spark.createDataFrame(rows, "rec int, sex int, g int")
    targets = spark.createDataFrame([(1, 1, 2, 600_000, 0), (2, None, 2, 400_000, 120), (3, 9, 9, 0, 0)], "cell_id int, sex int, g int, target_ppm long, min_rows int")
    plan, units = cs.sample_report(df, targets, "rec", ["sex", "g"])
    plan = plan.set_index("cell_id")
    assert list(plan.loc[[1, 2, 3], "available"]) == [200, 100, 0] and list(plan.loc[[1, 2, 3], "gap"]) == [0, 20, 0] and units.count() == 300


def test_terms_of_hot_records(spark):
    """One record holds a third of the rows and the null record another, in many batches."""
    rng = random.Random(11)
    rows = [(1, f"w{rng.randint(0, 40)}", None) for _ in range(5000)] + [(None, f"w{rng.randint(0, 40)}", "x") for _ in range(5000)]
    rows += [(rng.randint(2, 3000), rng.choice(["w1", "top", "top", f"u{rng.randint(0, 900)}"]), rng.choice(["x", "y", None])) for _ in range(5000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "rec long, a string, b string").repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["field_name"], r["field_value"]): (r["n_rows"], r["n_records"]) for r in term_frequency(df, "rec", {"a": F.col("a"), "b": F.col("b")}).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {(n, r[k]): [0, set()] for n, k in (("a", 1), ("b", 2)) for r in rows if r[k] is not None}
    for r in rows:
        for n, k in (("a", 1), ("b", 2)):
            if r[k] is not None:
                want[n, r[k]][0] += 1
                want[n, r[k]][1] |= {r[0]} - {None}
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}
