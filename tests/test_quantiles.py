"""Exact quantiles of many groupings: narrowing down, groupings from one scan, several quantiles at once."""

import itertools
import random

import pytest

from tallyframe.meta import ColumnMeta, Dataset
from tallyframe.operators import measures as m, quantiles
from tallyframe.plans import scale


def _definition5(values, p):
    x, at = sorted(values), len(values) * p
    j = int(at)
    return (x[max(j, 1) - 1] + x[min(j + 1, len(x)) - 1]) / 2 if at == j else x[j]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    # Epoch seconds of a day: all of them within a ten-thousandth of each other.
    return [(rng.choice(["a", "b", None]), rng.choice([1, 2]), 1_700_000_000 + rng.randint(0, 86_400), rng.randint(0, 3)) for _ in range(4000)] + [("z", 1, None, 1), ("z", 1, 5, 0)]


@pytest.mark.parametrize("gather, broadcast", [(100_000, 200_000), (20, 200_000), (20, 0)])
def test_every_grouping_is_exact(spark, rows, monkeypatch, gather, broadcast):
    monkeypatch.setattr(quantiles, "GATHER", gather)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", broadcast)
    passes = []
    cut = quantiles.cut
    monkeypatch.setattr(quantiles, "cut", lambda df: passes.append(1) or cut(df))
    df = spark.createDataFrame(rows, "g string, s int, t long, w int")
    ds = Dataset.of(df, "d", s=ColumnMeta("categorical", all_value=-1), t=ColumnMeta("scalar"), w=ColumnMeta("scalar"))
    got = ds.summ("g", "s", m.median("t"), m.quantiles("t", (0.1, 0.9)), allcalc=True, ordered=False).df.collect()
    # One scan for the bins of all groupings, one per narrowing: not one per grouping.
    assert len(passes) == (2 if gather > 20 else 3)
    seen = 0
    for r in got:
        here = [t for g, s, t, _ in rows if t is not None and (r["_type_"][0] == "0" or g == r["g"]) and (r["_type_"][1] == "0" or s == r["s"])]
        for name, p in (("median_of_t", 0.5), ("quantile_0_1_of_t", 0.1), ("quantile_0_9_of_t", 0.9)):
            assert r[name] == (_definition5(here, p) if here else None)
        seen += bool(here)
    assert seen >= 12


def test_weighted(spark, rows, monkeypatch):
    monkeypatch.setattr(quantiles, "GATHER", 20)
    df = spark.createDataFrame(rows, "g string, s int, t long, w int")
    ds = Dataset.of(df, "d", s=ColumnMeta("categorical", all_value=-1), t=ColumnMeta("scalar"), w=ColumnMeta("weighting"))
    got = {r["g"]: r["median_of_t_wgtd_by_w"] for r in ds.summ("g", m.median("t"), weightcol="w", ordered=False).df.collect()}
    for g in ("a", "b", None):
        x = sorted(t for a, _, t, w in rows if a == g and t is not None for _ in range(w))
        assert got[g] == _definition5(x, 0.5)
    assert got["z"] is None


def test_ties_and_extremes(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "GATHER", 3)
    values = [7.0] * 500 + [7.0000001] * 300 + [-1e308, 1e308, 0.0, -0.0, float("inf"), float("-inf"), 5e-324] * 3
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = Dataset.of(df, "d").summ(*[m.quantile("v", p, defn=d) for p, d in itertools.product((0.0, 0.01, 0.3, 0.65, 0.99, 1.0), (3, 5))], ordered=False).df.first()
    x = sorted(values)
    assert got["quantile_0_3_of_v"] == _definition5(values, 0.3) == 7.0 and got["quantile_0_65_of_v"] == 7.0000001
    assert got["quantile_0_of_v"] == x[0] and got["quantile_1_of_v"] == x[-1] and got["quantile_0_01_def3_of_v"] == x[8]
    empty = Dataset.of(df.limit(0), "d").summ(m.median("v"), ordered=False).df.first()
    assert empty["_freq_"] == 0 and empty["median_of_v"] is None
    with pytest.raises(ValueError):
        m.quantiles("v", ())
