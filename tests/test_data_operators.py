"""Rejected rows, skew-free statistics and profiles: goldens, brute force and edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import parse_rows, profile as prof
from tallyframe.operators.keyed_stats import heavy_keys, keyed_stats

LINES = [
    ("1,2,3", None), ('"1","2","3"', None), (' "1" ,\t2 , 3\r\n', None), ("001,02,0000000000000000000000003", None), ('" 7 ",1,5', None), ("18,2,2000000000", None),
    ('"1,2,3', "quoting"), ('1"x,2,3', "quoting"), ('"1"x,2,3', "quoting"), ('"1""2",1,3', "agegrp"), ('"1"" ,2,3', "quoting"), ('"1" "2",1,3', "quoting"), ('""",1,2', "quoting"), ('"a\nb",1,2', "agegrp"),
    ("1,2", "column_count"), ("1,2,3,4", "column_count"), ("1,2,3,", "column_count"), ('1,"2,3",4,5', "column_count"), ("1;2;3", "column_count"), (",,", "agegrp"), ('"1,2",2,3', "agegrp"),
    ("0,1,1", "agegrp"), ("19,1,1", "agegrp"), ("+1,1,1", "agegrp"), ("1.0,1,1", "agegrp"), ("١,1,1", "agegrp"), ("1 ,1,1", "agegrp"), ("1,3,1", "sex"), ("1,,1", "sex"), ("1,1,2000000001", "pop"), ("1,1,-1", "pop"), ("1,1,1e3", "pop"), ("1,1,99999999999999999999999", "pop"), ("1,1,5\x0b", "pop"),
    ('"",1,1', "agegrp"), ("1,1,\n", "pop"), ("1\n,1,1", None), ('1,1,"5"' + '""' * 3000, "pop"), ("9" * 100_000 + ",1,1", "agegrp"), ("1," + " " * 100_000 + "x,1", "sex"), (" " * 100_000 + "1,1,1", None), ('"' + '""' * 20_000 + '",1,1', "agegrp"),
]


def test_reasons(spark):
    rows = [(i, 2, t) for i, (t, _) in enumerate(LINES)] + [(900, 1, "agegrp,sex,pop"), (901, 3, None), (902, 3, ""), (903, 3, " \t\r\n"), (904, None, "1,1,1")]
    df = spark.createDataFrame(rows, "line_id long, line_no int, raw_line string").withColumn("reason", F.lit("clash"))
    got = {r["line_id"]: r["reason"] for r in parse_rows.rejected_rows(df).collect()}
    for i, (t, want) in enumerate(LINES):
        assert got.get(i) == want, t[:40]
    assert not {900, 901, 902, 903, 904} & set(got)
    typed = {r["line_id"]: tuple(r)[1:] for r in parse_rows.typed_rows(df).collect()}
    assert set(typed) == {i for i, (_, w) in enumerate(LINES) if w is None} | {904} and typed[3] == (1, 2, 3) and typed[4] == (7, 1, 5)
    assert parse_rows.rejected_rows(df.limit(0)).count() == 0


def _def5(v, p):
    v, n = sorted(v), len(v)
    j = math.floor(n * p)
    at = lambda r: v[max(1, min(n, r)) - 1]
    return at(j) / 2 + at(j + 1) / 2 if n * p == j else at(j + 1)


def test_keyed_stats_against_brute_force(spark):
    rng = random.Random(1)
    kinds = {
        "hot": [rng.expovariate(0.1) for _ in range(4000)], "whole": [float(rng.randint(-5, 2000)) for _ in range(900)], "same": [7.5] * 50, "one": [3.0], "none": [],
        "close": [1e9 + i * 1e-6 for i in range(300)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(300)], "ends": [-math.inf, math.inf, 0.0, 1.0, 5.0], "huge": [-1.7e308, 1.7e308, 1.0, 2.0],
    }
    rows = [(k, 1, x) for k, v in kinds.items() for x in v] + [("none", 1, None), ("hot", 1, None), ("hot", 1, math.nan), (None, None, 5.0), (None, None, 6.0)]
    df = spark.createDataFrame(rows, "k string, s int, v double").withColumn("n_rows", F.lit(0)).withColumn("bin", F.lit(0))
    got = {r["k"]: r for r in keyed_stats(df, ["k", "s"], "v", (0.0, 0.1, 0.5, 0.9, 1.0)).collect()}
    assert len(got) == len(kinds) + 1
    for k, v in {**kinds, None: [5.0, 6.0]}.items():
        r = got[k]
        assert r["n_value"] == len(v)
        if not v:
            assert r["q50"] is None and r["mean_value"] is None
            continue
        assert r["min_value"] == min(v) and r["max_value"] == max(v)
        for name, p in (("q0", 0.0), ("q10", 0.1), ("q50", 0.5), ("q90", 0.9), ("q100", 1.0)):
            want = _def5(v, p)
            assert (math.isnan(want) and math.isnan(r[name])) or r[name] == pytest.approx(want, rel=1e-12), (k, name)
    assert got["hot"]["n_rows"] == 4002 and got["hot"]["row_share"] > 0.5
    assert {r["k"] for r in heavy_keys(keyed_stats(df, ["k", "s"], "v", ())).collect()} == {"hot", "whole", "close", "wide"}
    assert keyed_stats(df.limit(0), ["k"], "v").count() == 0


def test_keyed_stats_without_broadcast(spark, monkeypatch):
    """The salted shuffle join gives what the broadcast gives."""
    from tallyframe.plans import scale

    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice("aab"), rng.gauss(0, 1)) for _ in range(2000)], "k string, v double")
    rows = lambda: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in keyed_stats(df, ["k"], "v").collect())
    a = rows()
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    assert rows() == a


def test_profile(spark):
    rows = [(1, "AB12", 5.0)] * 300 + [(1, "AB13", 5.0)] * 99 + [(1, "x", None)] + [(2, "AB12", 500.0)] * 40 + [(2, None, 7.0)] * 60 + [(None, "", 1.0)]
    df = spark.createDataFrame(rows, "load int, code string, v double").withColumn("n", F.lit(1)).withColumn("mask", F.lit("z"))
    spec = prof.ProfileSpec("load", (prof.ColumnRule("code"), prof.ColumnRule("v", 0, 10, "cast(v as int)", "code = 'AB13'")))
    got = {(r["load"], r["column_name"]): r for r in prof.profile(df, spec).collect()}
    c1, v2 = got[1, "code"], got[2, "v"]
    assert (c1["n_rows"], c1["n_null"], c1["n_distinct"], c1["dominant_mask"], c1["n_masks"], c1["n_rare_mask"]) == (400, 0, 3, "AA99", 2, 1)
    assert got[1, "v"]["n_contradicting"] == 99 and (v2["n_out_of_range"], v2["max_value"], v2["shift"]) == (40, 500.0, 1.0)
    assert got[None, "v"]["shift"] is None and got[1, "v"]["shift"] == 1.0 and got[2, "code"]["mask_shift"] == pytest.approx(1 / 400)
    found = {tuple(r) for r in prof.issues(prof.profile(df, spec), spec).collect()}
    assert found == {(1, "v", "pattern"), (1, "v", "shift"), (2, "v", "range"), (2, "v", "shift"), (2, "code", "nulls")}
    assert prof.profile(df.limit(0), spec).count() == 0
    # Few values are counted alike either way; masks have their roles and issues.
    exact = prof.ProfileSpec("load", spec.columns, distinct="exact")
    key = ["load", "column_name", "n_distinct", "n_rows", "min_value", "max_value", "min_text", "max_text", "mask_shift"]
    assert sorted(map(str, prof.profile(df, exact).select(*key).collect())) == sorted(map(str, prof.profile(df, spec).select(*key).collect()))
    roles = {(r["load"], r["column_name"], r["mask"]): (r["n"], r["role"]) for r in prof.mined_masks(df, spec).collect()}
    assert roles[1, "code", "AA99"] == (399, "dominant") and roles[1, "code", "a"] == (1, "rare") and roles[None, "code", ""] == (1, "dominant") and (2, "code", None) not in roles
    assert {tuple(r) for r in prof.mask_issues(prof.mask_profile(df, spec), spec).collect()} == {(1, "code", "mask_shift"), (2, "v", "mask_shift")}
    with pytest.raises(ValueError):
        prof.profile(df, prof.ProfileSpec("load", spec.columns, distinct="some"))


def test_profile_of_nhds_has_every_column(spark, sf):
    from tallyframe.data_queries import p6_profile

    nhds = spark.read.parquet(f"{sf}/nhds.parquet")
    rows = p6_profile(spark, sf).collect()
    by_load = {r["load_id"]: r["n"] for r in nhds.groupBy("load_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {(r["load_id"], r["column_name"]) for r in rows} == {(k, c) for k in by_load for c in nhds.columns}
    for r in rows:
        if r["column_name"] == "row_ordinal":
            # By sketch: six standard errors of 1.6 %.
            assert (r["n_rows"], r["n_null"]) == (by_load[r["load_id"]], 0) and abs(r["n_distinct"] / by_load[r["load_id"]] - 1) < 0.1
        if r["column_name"] == "load_id":
            assert (r["n_distinct"], r["min_value"]) == (1, r["load_id"])
