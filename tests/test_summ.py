"""Summaries of a made table of bus trips against brute force over its rows, multi-valued columns and edge cases."""

import itertools
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyframe.meta import ColumnMeta, Dataset, RoleError
from tallyframe.operators import measures as m
from tallyframe.operators.summarise import coalesce, condcol, order, retain, reversed_order, suppress

_rng = random.Random(2024)
LINES, DAYS, DEPOTS = [10, 20, 30], ["mon", "sun"], [None, "north", "south"]
# (line, day, depot, minutes, riders); line 30 never runs on Sundays.
ROWS = [(n, d, _rng.choice(DEPOTS), _rng.choice([None, *(_rng.randint(50, 900) / 10 for _ in range(4))]), _rng.randint(0, 60) / 4) for n, d in _rng.choices([(10, "mon"), (10, "sun"), (20, "mon"), (20, "sun"), (30, "mon")], k=60)]
AT = {"line": 0, "day": 1, "depot": 2, "minutes": 3, "riders": 4}


@pytest.fixture(scope="module")
def trips(spark):
    df = spark.createDataFrame(ROWS, "line int, day string, depot string, minutes double, riders double")
    return Dataset.of(df, "trips", line=ColumnMeta("categorical", all_value=-1, labels={10: "Harbour", 20: "Hill", 30: "Airport"}), depot=ColumnMeta("categorical"), minutes=ColumnMeta("scalar"), riders=ColumnMeta("scalar"))


def table(ds, *names):
    """The rows of a summary by its condition columns."""
    keys = [c for c in ds.df.columns if c in AT]
    out = {}
    for r in ds.df.collect():
        k = tuple(r[c] for c in keys)
        assert k not in out
        out[k] = tuple(r[n] for n in names) if len(names) > 1 else r[names[0]]
    return out


def brute(keys, value, rows=ROWS, domain=None):
    """value(rows) of every combination of the values of the keys."""
    domains = [sorted({r[AT[k]] for r in (domain or rows)}, key=str) for k in keys]
    return {c: value([r for r in rows if all(r[AT[k]] == v for k, v in zip(keys, c))]) for c in itertools.product(*domains)}


def mean(rows):
    v = [r[3] for r in rows if r[3] is not None]
    return sum(v) / len(v) if v else None


def weighted_mean(rows):
    v = [(r[3], r[4]) for r in rows if r[3] is not None]
    w = sum(b for _, b in v)
    return sum(a * b for a, b in v) / w if w else None


def near(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (pytest.approx(v, rel=1e-9) if v is not None else None), k


def test_one_and_two_columns(trips):
    s = trips.summ("line")
    assert table(s, "_freq_") == brute(["line"], len) and s.weight == "_freq_"
    assert {tuple(r["_condcols_"]) for r in s.df.collect()} == {("line",)}
    got = table(trips.summ("line", "day"), "_freq_")
    assert got == brute(["line", "day"], len) and got[30, "sun"] == 0


def test_all_marginals_and_levels(trips):
    s = trips.summ("line", "day", allcalc=True).df.collect()
    want = {("00", -1, "_all_"): len(ROWS)} | {("10", *k, "_all_"): n for k, n in brute(["line"], len).items()} | {("01", -1, *k): n for k, n in brute(["day"], len).items()} | {("11", *k): n for k, n in brute(["line", "day"], len).items()}
    assert {(r["_type_"], r["line"], r["day"]): r["_freq_"] for r in s} == want
    # Marginals come first, and within a level the values in order.
    assert [r["_level_"] for r in s] == sorted(r["_level_"] for r in s) and [r["line"] for r in s if r["_type_"] == "10"] == LINES
    assert {r["_level_"] for r in trips.summ("line", "day", levels=[1]).df.collect()} == {1}
    assert trips.summ().df.first()["_freq_"] == len(ROWS)


def test_measures(trips):
    s = trips.summ("day", m.minimum("minutes"), m.mean("minutes"), m.median("minutes"), m.missing("minutes"), m.arange("minutes"))
    values = lambda rows: [r[3] for r in rows if r[3] is not None]
    near(table(s, "mean_of_minutes"), brute(["day"], mean))
    near(table(s, "minimum_of_minutes"), brute(["day"], lambda rows: min(values(rows))))
    near(table(s, "range_of_minutes"), brute(["day"], lambda rows: max(values(rows)) - min(values(rows))))
    import statistics

    near(table(s, "median_of_minutes"), brute(["day"], lambda rows: statistics.median(values(rows))))
    assert table(s, "missing_of_minutes") == brute(["day"], lambda rows: len(rows) - len(values(rows)))
    assert {"minimum_of_minutes", "mean_of_minutes"} <= set(trips.summ("line", m.applyto("minutes", m.minimum, m.mean)).df.columns)


@pytest.mark.parametrize("how", ["summ", "measure", "dataset"])
def test_weights(trips, how):
    ds = replace(trips, weight="riders") if how == "dataset" else trips
    args = {"weight": "riders"} if how == "measure" else {}
    s = ds.summ("line", m.freq(**args), m.mean("minutes", **args), **({"weightcol": "riders"} if how == "summ" else {}))
    near(table(s, "freq_wgtd_by_riders"), brute(["line"], lambda rows: sum(r[4] for r in rows)))
    near(table(s, "mean_of_minutes_wgtd_by_riders"), brute(["line"], weighted_mean))


def test_variance_far_from_zero(spark):
    """Weighted and not, with a mean of 10^7 standard deviations."""
    rng = random.Random(3)
    rows = [(1e9 + rng.gauss(0, 100), float(rng.randint(1, 4))) for _ in range(500)]
    ds = Dataset.of(spark.createDataFrame(rows, "x double, w double"), "far")
    mu = sum(x * w for x, w in rows) / sum(w for _, w in rows)
    want = sum(w * (x - mu) ** 2 for x, w in rows) / sum(w for _, w in rows)
    got = ds.summ(m.popvar("x"), m.popvar("x", weight="w"), ordered=False).df.first()
    plain = sum(x for x, _ in rows) / 500
    assert got["popvar_of_x_wgtd_by_w"] == pytest.approx(want, rel=1e-7) and got["popvar_of_x"] == pytest.approx(sum((x - plain) ** 2 for x, _ in rows) / 500, rel=1e-7)


def test_filters(trips):
    want = brute(["line"], len, [r for r in ROWS if r[0] != 20])
    for s in (trips.summ("line", filterexpr="line != 20"), trips.make_filter("no", "line != 20").summ("line", filtername="no"), trips.filter("line != 20").summ("line")):
        assert table(s, "_freq_") == want
    assert table(trips.summ("line", "day", filterexpr="line != 20", zeros=True), "_freq_") == brute(["line", "day"], len, [r for r in ROWS if r[0] != 20], ROWS)
    assert table(trips.filter("line != 20").summ("line", zeros=True), "_freq_")[20,] == 0


def test_null_group(trips):
    s = trips.summ("line", "depot")
    assert table(s, "_freq_") == brute(["line", "depot"], len)
    assert [r["depot"] for r in s.df.collect()] == DEPOTS * 3


@pytest.mark.parametrize("weight", [None, "riders"])
def test_proportions(trips, weight):
    size = (lambda rows: sum(r[4] for r in rows)) if weight else len
    got = trips.summ("line", "day", proportions=True, weightcol=weight).df.collect()
    lines, days, total = brute(["line"], size), brute(["day"], size), size(ROWS)
    for r in got:
        here = size([x for x in ROWS if (r["_type_"][0] == "0" or x[0] == r["line"]) and (r["_type_"][1] == "0" or x[1] == r["day"])])
        of_day, of_line = total if r["_type_"][1] == "0" else days[r["day"],], total if r["_type_"][0] == "0" else lines[r["line"],]
        assert r["_prop_of_all-line-day"] == pytest.approx(here / total) and r["_prop_of_all-line"] == pytest.approx(here / of_day) and r["_prop_of_all-day"] == pytest.approx(here / of_line)


def test_proportions_keep_what_a_filter_leaves(trips):
    s = trips.summ("day", m.freq(weight="minutes"), weightcol="riders", proportions=True, filterexpr="minutes > 30")
    kept = [r for r in ROWS if r[3] is not None and r[3] > 30]
    got = {r["day"]: (r["freq_wgtd_by_minutes"], r["_prop_of_all-day"]) for r in s.df.collect()}
    for d in DAYS:
        here = [r for r in kept if r[1] == d]
        assert got[d] == (pytest.approx(sum(r[3] for r in here)), pytest.approx(sum(r[4] for r in here) / sum(r[4] for r in kept)))


def test_suppress_retain(trips):
    s = trips.summ(condcol("line", suppress(30)), condcol("depot", suppress(None)), m.mean("minutes"))
    near(table(s, "mean_of_minutes"), {k: v for k, v in brute(["line", "depot"], mean).items() if k[0] != 30 and k[1] is not None})
    assert len(table(trips.summ(condcol("line", suppress()), "depot"), "_freq_")) == 9
    # What is hidden still counts in the whole.
    s = trips.summ(condcol("line", suppress(30)), "day", proportions=True, nomt=True)
    near(table(s, "_prop_of_all-line-day"), {k: n / len(ROWS) for k, n in brute(["line", "day"], len).items() if k[0] != 30})
    assert set(table(trips.summ(condcol("line", retain(10, 20))), "_freq_")) == {(10,), (20,)}


def test_coalesce_and_order(trips):
    s = trips.summ(condcol("line", coalesce(20, 30)), "day", m.mean("minutes"))
    joined = [(20 if r[0] == 30 else r[0], *r[1:]) for r in ROWS]
    near(table(s, "mean_of_minutes"), brute(["line", "day"], mean, joined))
    assert s.meta("line").labels[20] == "Hill/Airport"
    with pytest.raises(ValueError):
        trips.summ(condcol("line", coalesce(10, 20), coalesce(20, 30)))
    assert table(trips.summ(condcol("line", coalesce(lambda v: v // 20))), "_freq_") == {(k,): sum(r[0] // 20 == k for r in ROWS) for k in (0, 1)}
    listed = lambda *ops: [r["line"] for r in trips.summ(condcol("line", *ops)).df.collect()]
    assert listed(order(30, 10)) == [30, 10, 20] and listed(order(lambda a, b: b - a)) == [30, 20, 10] and listed(reversed_order()) == [30, 20, 10]
    assert [r["depot"] for r in trips.summ(condcol("depot", reversed_order())).df.collect()] == ["south", "north", None]


def test_summary_of_summary(trips):
    assert table(trips.summ("line", "day").summ("day", m.freq()), "freq_wgtd_by__freq_") == brute(["day"], lambda rows: float(len(rows)))


def test_multi_valued(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (1, []), (2, None)], "g int, t array<string>")
    ds = Dataset.of(df, "multi", t=ColumnMeta("categorical"))
    assert {r["t"]: r["_freq_"] for r in ds.summ("t").df.collect()} == {"a": 1, "b": 2}
    s = ds.summ("g", "t", allcalc=True, proportions=True)
    rows = {(r["_type_"], r["g"], r["t"]): r["_freq_"] for r in s.df.collect()}
    assert rows["00", s.meta("g").all_value, "_all_"] == 4 and rows["01", s.meta("g").all_value, "b"] == 2 and rows["11", 2, "a"] == 0


def test_bad_use(trips):
    with pytest.raises(RoleError):
        trips.summ("minutes")
    with pytest.raises(RoleError):
        trips.summ("day", m.mean("line"))
    with pytest.raises(TypeError):
        trips.summ("day", nonsense=1)
    with pytest.raises(RoleError):
        trips.summ("day", m.studentt("minutes", weight="riders"))


def test_empty_table(spark, trips):
    e = Dataset.of(trips.df.limit(0), "empty")
    assert e.summ("day", "depot", m.mean("minutes")).df.count() == 0
    assert e.summ(m.mean("minutes"), m.median("minutes"), m.freq()).df.first()["_freq_"] == 0


def test_text_and_describe(trips):
    text = trips.summ("line", allcalc=True).text("line", "_freq_")
    assert text.splitlines()[2].startswith("All") and "Harbour" in text
    assert trips.describe().where(F.col("column_name") == "line").first()["role"] == "categorical"
    called = replace(trips, columns=trips.columns | {"line": ColumnMeta("categorical", labels=lambda v: "none" if v is None else f"no. {v}")})
    assert {r["line"] for r in called.translated("line").collect()} == {"no. 10", "no. 20", "no. 30"}
