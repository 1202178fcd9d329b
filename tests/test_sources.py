"""Readers, conversions, the store, streams and row sets."""

import datetime as dt
import gzip
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import dates
from tallyframe.functions.labels import combinations, cross, pluralise
from tallyframe.meta import ColumnMeta, Dataset
from tallyframe.operators import joins, measures as m, plotdata, rowset, tables
from tallyframe.sources import readers
from tallyframe.sources.columns import SourceColumn, add_datatype
from tallyframe.sources.store import Locked, Store
from tallyframe.streaming.summaries import windowed_summary

AB = [SourceColumn("a_col", ordinalpos=1, posbase=1), SourceColumn("b_col", ordinalpos=2, posbase=1)]
TEXT = '1,2\n"a,b",c\nd,"e\nf"\n'
WANT = [("1", "2"), ("a,b", "c"), ("d", "e\nf")]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_plain_gzip_zip(spark, tmp_path):
    (tmp_path / "x.csv").write_text(TEXT)
    (tmp_path / "h.csv").write_text("skip,me\nand,me\n" + TEXT)
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write(TEXT)
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in.csv", "head,er\n" + TEXT)
    for path, skip in (("x.csv", 0), ("h.csv", 2), ("x.csv.gz", 0), ("x.zip", 1), ("x.zip/in.csv", 1)):
        assert rows(readers.csv_source(spark, f"{tmp_path}/{path}", AB, header_rows=skip)) == WANT, path


def test_header_csv_types_and_missing(spark, tmp_path):
    (tmp_path / "t.csv").write_text("n,x,d\n1.6,2.5,3/2/04\nNA,,\n7,bad,29/2/2003\n")
    cols = [SourceColumn("num", "int", source="n"), SourceColumn("x", "float"), SourceColumn("day", "date", source="d")]
    assert rows(readers.csv_source(spark, f"{tmp_path}/t.csv", cols, header=True, missing=("NA",))) == [(2, 2.5, dt.date(2004, 2, 3)), (None, None, None), (7, None, None)]


def test_fixed_width_and_hooks(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"HEADER\r\nab  12\r\n    34\x1a\n")
    cols = [SourceColumn("a", startpos=1, length=4, posbase=1), SourceColumn("n", "int", startpos=5, length=2, posbase=1)]
    df = readers.fixed_width_source(spark, f"{tmp_path}/f.txt", cols, header_rows=1)
    assert rows(df) == [("ab", 12), (None, 34)]
    assert rows(readers.with_hook(df, lambda r: None if r["a"] is None else r | {"n": r["n"] + 1})) == [("ab", 13)]
    both = readers.load(df, df.select("n"), rowlimit=1)
    assert both.count() == 2 and both.columns == ["a", "n"]
    add_datatype("shout", lambda c, _: F.upper(c))
    assert rows(readers.fixed_width_source(spark, f"{tmp_path}/f.txt", [SourceColumn("a", "shout", startpos=0, length=2)], header_rows=1))[0] == ("AB",)


def test_dbapi(spark, tmp_path):
    path = f"{tmp_path}/t.db"
    db = sqlite3.connect(path)
    db.execute("create table t (a_col int, b_col int)")
    db.executemany("insert into t values (?, ?)", [(i, 100 - i) for i in range(30)])
    db.commit()
    df = readers.dbapi_source(spark, lambda: sqlite3.connect(path), "t", AB, "a_col bigint, b_col bigint", "a_col >= ?", (10,), ["a_col < 20", "a_col >= 20"], fetchcount=5)
    assert sorted(rows(df)) == [(i, 100 - i) for i in range(10, 30)]


def test_dates(spark):
    want = {"23/12/1970": (1970, 12, 23), "23/12/70": (1970, 12, 23), "25/12/00": (2000, 12, 25), "25/12/900": (900, 12, 25), "25/12/9": (2009, 12, 25), "3/2/04": (2004, 2, 3), "29/02/04": (2004, 2, 29)}
    df = spark.createDataFrame([(k,) for k in want] + [("",), (None,), ("29/02/2003",)], "t string")
    assert [r[0] for r in df.select(dates.parse_date(F.col("t"))).collect()] == [dt.date(*v) for v in want.values()] + [None] * 3
    bad = spark.createDataFrame([("23-12-1970",)], "t string")
    assert bad.select(dates.parse_date(F.col("t"), errors="null")).first()[0] is None
    with pytest.raises(Exception, match="no date"):
        bad.select(dates.parse_date(F.col("t"))).collect()
    one = lambda text, f, *a: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"), *a)).first()[0]
    assert one("70-12-23 1:12:23.4", dates.parse_datetime, "iso-datetime") == dt.datetime(1970, 12, 23, 1, 12, 23, 400_000)
    assert one("01:02:62.4", dates.parse_time) == pytest.approx(3782.4) and one("12:23", dates.parse_time, "HH:MM") == 44580
    day = spark.createDataFrame([(dt.date(2004, 2, 3),), (None,)], "d date")
    assert [r[0] for r in day.select(dates.ddmmyyyy(F.col("d"))).collect()] == ["03/02/2004", "All date/times"]
    assert day.select(dates.fulldate(F.col("d"))).first()[0] == "Tuesday, 03 February 2004"
    ticks = day.where("d is not null").select(dates.date_ticks(F.col("d"), F.date_add("d", 400))).first()[0]
    assert 3 <= len(ticks) <= 15
    ages = spark.createDataFrame([(0.5,), (84.0,), (99.0,), (-1.0,), (None,)], "a double")
    assert [r[0] for r in ages.select(dates.age_group(F.col("a"))).collect()] == [1, 17, 18, None, None]


def test_labels():
    assert [pluralise(x) for x in ("year", "box", "city", "day", "analysis", "church", "ox")] == ["years", "boxes", "cities", "days", "analyses", "churches", "oxs"]
    assert combinations("ab") == [(), ("a",), ("b",), ("a", "b")] and cross([1, 2], "a") == [(1, "a"), (2, "a")]


def test_store(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    ds = Dataset.of(spark.createDataFrame([(1, "x"), (2, None)], "g int, t string"), "People", weight="g", g=ColumnMeta("scalar", labels={1: "one"})).make_filter("few", "t = 'x'")
    assert store.save(ds) == 1 and store.save(ds.filter("t = 'x'"), keep=2) == 2
    got = store.load("people")
    assert got.df.count() == 1 and got.weight == "g" and got.meta("g").labels == {1: "one"} and got.filters == {"few": "t = 'x'"}
    assert store.load("people", 1).df.count() == 2 and store.available() == ["People"]
    store.save(ds, keep=2)
    assert store.generations("People") == [2, 3]
    with store.locked("People"), pytest.raises(Locked):
        store.save(ds)
    store.share_filter("people", "f", "g > 1")
    with pytest.raises(ValueError):
        store.share_filter("people", "f", "g > 2")
    store.share_filter("people", "f", "g > 2", expected="g > 1")
    assert store.shared_filters("people") == {"f": "g > 2"}
    with pytest.raises(FileNotFoundError):
        store.load("nobody")


def test_stream(spark, tmp_path, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    make = lambda df: windowed_summary(Dataset.of(df, "ev", value=ColumnMeta("scalar")), "ts", "1 day", m.mean("value"), m.maximum("value"), keys=("event_type",), watermark="1 hour")
    q = make(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = ["window_start", "event_type", "_freq_", "maximum_of_value"]
    assert sorted(rows(spark.table("windows").select(*key))) == sorted(rows(make(batch).select(*key)))
    with pytest.raises(ValueError):
        windowed_summary(Dataset(batch, "ev"), "ts", "1 day", m.median("value"))


def test_row_sets(spark):
    f = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    got = lambda df: sorted(r[0] for r in df.collect())
    a, b, c = f(1, 2, 2, 5), f(2, 3, 5), f(5)
    assert got(rowset.unique(a)) == [1, 2, 5] and got(rowset.union(a, b)) == [1, 2, 3, 5]
    assert got(rowset.intersect(a, b)) == [2, 5] and got(rowset.intersect(a, b, c)) == [5]
    assert got(rowset.difference(a, b)) == [1] and got(rowset.outersect(a, b)) == [1, 3] and got(rowset.outersect(a, b, c)) == [1, 2, 3]
    n = spark.range(100, numPartitions=7).withColumnRenamed("id", "v")
    o = rowset.with_ordinals(n, ["v"])
    assert [r[0] for r in o.orderBy("v").select("row_ordinal").collect()] == list(range(100))
    # Keys beyond the whole numbers of doubles, one of them on most rows, a null, and a column named like the ids.
    far = [2**53 + i for i in range(40)] + [2**53 + 20] * 3000 + [None]
    t = rowset.with_ordinals(spark.createDataFrame([(v, 0) for v in far], "v long, __n int").repartition(6), ["v"])
    assert [r["v"] for r in sorted(t.collect(), key=lambda r: r["row_ordinal"])] == sorted(far, key=lambda v: (v is not None, v))
    assert sorted(r["row_ordinal"] for r in t.collect()) == list(range(len(far))) and rowset.with_ordinals(n.limit(0), ["v"]).count() == 0
    assert got(rowset.take_rows(o, [5, 5, None, 7, 500]).select("v")) == got(rowset.take_rows(o, f(5, 7, 7, None)).select("v")) == [5, 7]
    seen = []
    rowset.set_instrument(lambda name, sets: seen.append((name, sets)))
    assert got(rowset.union(a, b)) == got(rowset.preload(rowset.unique(a, b))) and got(rowset.intersect(a, b, c)) == [5]
    rowset.set_instrument(None)
    assert got(rowset.difference(a, b)) == [1] and seen == [("unique", 2), ("unique", 2), ("intersect", 3)]
    for way in ("auto", "sparse", "dense"):
        assert got(rowset.intersect_by(a, b, way)) == [2, 5]
    for s in (slice(10, 20), slice(-5, None), slice(None, None, 30), slice(50, 10, -7), slice(3, 3)):
        assert got(rowset.slice_rows(o, s.start, s.stop, s.step or 1).select("v")) == sorted(range(100)[s])
    assert got(rowset.page(o, 2, 10).select("v")) == list(range(20, 30))
    assert rowset.sample_rows(o, 0.25).count() == 25 and rowset.sample_rows(o, 0.0).count() == 0
    assert got(rowset.value_positions(o, f(7, 9, 500))) == [7, 9]
    assert f(1).select(rowset.strip_word(F.lit("o'neil"))).first()[0] == "ONEIL"
    arr = spark.createDataFrame([(["a", "b"], 1), (["b"], None), ([], 1)], "t array<string>, n int")
    assert rowset.cardinality(arr, "t").first()[0] == 3 and rowset.cardinality(arr, "n").first()[0] == 2


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, x string")
    right = spark.createDataFrame([(2, "p"), (2, None), (3, "q")], "id int, y string")
    assert sorted(rows(joins.inner_join(left, ["k=key"], ["x"], right, ["id=key"], ["y=z"])), key=str) == sorted([(2, "b", "p"), (2, "b", None), (2, "c", "p"), (2, "c", None)], key=str)
    out = joins.left_outer_join(left, ["k"], ["x"], right, ["id=k"], ["y"], {"y": "none"})
    assert sorted(rows(out), key=str) == sorted([(1, "a", "none"), (None, "d", "none"), (2, "b", "p"), (2, "b", None), (2, "c", "p"), (2, "c", None)], key=str)
    with pytest.raises(ValueError):
        joins.inner_join(left, ["k"], ["x"], right, ["id"], ["y"])


def test_tables(spark):
    meta = {"a": ColumnMeta("categorical"), "b": ColumnMeta("categorical"), "_freq_": ColumnMeta("scalar")}
    ds = Dataset.of(spark.createDataFrame([(1, 1, 5), (1, 2, 7), (2, 1, 9)], "a int, b int, _freq_ long"), "t", **meta)
    assert sorted(rows(tables.crosstab(ds).df), key=str) == sorted([(1, 1, 5), (1, 2, 7), (2, 1, 9), (2, 2, None)], key=str)
    like = ds.filter("a = 1")
    assert sorted(rows(tables.crosstab(ds, like).df)) == [(1, 1, 5), (1, 2, 7)]
    assert sorted(rows(tables.collapse(ds.df, ["a"], ["_freq_"]))) == [(1, 12.0), (2, 9.0)]
    assert tables.replicate(ds.df.select("a"), {"z": spark.createDataFrame([(1,), (2,)], "z int")}).count() == 6
    assert tables.shape_union(ds, ds) == {"a": [1, 2], "b": [1, 2]}
    with pytest.raises(ValueError):
        tables.shape_union(ds, like)
    p = tables.pivot_table(ds, ["a"], "b", "_freq_", [1, 2, 3]).orderBy("a").collect()
    assert tuple(p[0]) == (1, 5, 7, None)


def test_plot_data(spark):
    ds = Dataset.of(spark.createDataFrame([("x", float(i)) for i in range(11)] + [("y", None)], "g string, v double"), "t", v=ColumnMeta("scalar"), g=ColumnMeta("categorical", labels={"x": "Ex", "y": "Why"}))
    h = plotdata.histogram(ds, "v", 5).orderBy("bin").collect()
    assert [r["n"] for r in h] == [2, 2, 2, 2, 3] and h[0]["bin_low"] == 0 and h[-1]["bin_high"] == 10
    assert plotdata.histogram(Dataset(ds.df.limit(0)), "v").count() == 0
    b = plotdata.box_statistics(ds, "v", "g").df.where("g = 'x'").first()
    assert (b["p25_of_v"], b["quantile_0_5_of_v"], b["p75_of_v"]) == (2.0, 5.0, 8.0)
    assert plotdata.points(ds, "v", limit=5).count() <= 12
    assert rows(plotdata.search_values(ds, "g", "*x")) == [("x", "Ex")]


def test_zip_members_are_streamed(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.csv", "h,h\n" + "".join(f"{i},x\n" for i in range(25_000)))
        z.writestr("sub/", "")
        z.writestr("b.csv", "h,h\n7,y\n")
        z.writestr("bad.csv", b"h,h\n1,\xff\n")
    got = rows(readers.csv_source(spark, f"{tmp_path}/two.zip/a.csv", AB, header_rows=1))
    assert len(got) == 25_000 and got[0] == ("0", "x") and got[-1] == ("24999", "x")
    assert rows(readers.csv_source(spark, f"{tmp_path}/two.zip/b.csv", AB, header_rows=1)) == [("7", "y")]
    assert rows(readers.csv_source(spark, f"{tmp_path}/two.zip/bad.csv", AB, header_rows=1, errors="replace")) == [("1", "�")]
    with pytest.raises(Exception, match="decode"):
        rows(readers.csv_source(spark, f"{tmp_path}/two.zip/bad.csv", AB, header_rows=1))


def test_store_replaces_its_pointer_and_breaks_stale_locks(spark, tmp_path):
    from tallyframe.sources.store import Locked, Store

    store = Store(spark, str(tmp_path / "s"))
    ds = Dataset.of(spark.createDataFrame([(1,)], "v int"), "d")
    assert [store.save(ds), store.save(ds)] == [1, 2] and store.load("d").df.count() == 1
    with store.locked("d"):
        with pytest.raises(Locked):
            store.save(ds)
        # Another writer takes this one for dead; this one then leaves the other's lock alone.
        late = Store(spark, str(tmp_path / "s"), stale=-1)
        with late.locked("d"):
            pass
    (tmp_path / "s" / "d" / "_LOCK").write_text("gone")
    with pytest.raises(Locked):
        store.save(ds)
    assert Store(spark, str(tmp_path / "s"), stale=-1).save(ds) == 3 and store.save(ds) == 4


def test_kept_summaries(spark, tmp_path):
    from tallyframe.operators.summarise import coalesce, condcol, suppress
    from tallyframe.sources.store import Store
    from tallyframe.sources.summary_cache import SummaryCache

    data, kept = Store(spark, str(tmp_path / "d")), Store(spark, str(tmp_path / "k"))
    ds = Dataset.of(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 4.0)], "g string, v double"), "d", v=ColumnMeta("scalar"), g=ColumnMeta("categorical"))
    data.save(ds)
    cache = SummaryCache(data, kept)
    for _ in range(2):
        assert sorted((r["g"], r["mean_of_v"]) for r in cache.summ("d", "g", m.mean("v")).df.collect()) == [("a", 2.5), ("b", 2.0)]
    assert len(kept.available()) == 1
    assert cache.summ("d", condcol("g", suppress("b")), m.mean("v")).df.count() == 1 and cache.summ("d", "g", m.mean("v"), filters=("v > 1",)).df.count() == 2
    data.save(ds.filter("v > 3"))
    assert cache.summ("d", "g", m.mean("v")).df.count() == 1 and len(kept.available()) == 4
    with pytest.raises(TypeError):
        cache.summ("d", condcol("g", coalesce(str.upper)), m.mean("v"))


def test_frequent_sets(spark):
    import itertools
    import random

    from tallyframe.operators.itemsets import frequent_sets

    rng = random.Random(5)
    rows_ = [[rng.choice("abcde") for _ in range(rng.randint(0, 4))] for _ in range(200)] + [None, ["a", None]]
    df = spark.createDataFrame([(r, 1) for r in rows_], "t array<string>, items int")
    sets_ = [set(x for x in r or [] if x) for r in rows_]
    want = {c: n for k in range(1, 6) for c in itertools.combinations("abcde", k) if (n := sum(set(c) <= s for s in sets_)) >= 0.1 * len(rows_)}
    assert {tuple(r["items"]): r["n_rows"] for r in frequent_sets(df, "t", 0.1).collect()} == want
    top = {c for c in want if not any(set(c) < set(o) for o in want)}
    assert {tuple(r["items"]) for r in frequent_sets(df, "t", 0.1, maximal=True).collect()} == top
    assert frequent_sets(df.limit(0), "t").count() == 0


def test_display_tables(spark):
    import numpy as np

    meta = {"a": ColumnMeta("categorical", all_value=-1), "b": ColumnMeta("categorical", all_value=-1), "c": ColumnMeta("categorical", all_value="all")}
    base = Dataset.of(spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x"), (2, 1, "x")], "a int, b int, c string"), "t", **meta)
    s = base.summ("a", "b", "c", allcalc=True)
    p = tables.pivot_table(s, ["a"], ["b", "c"], "_freq_", [[1, 2], ["x"]], marginals="after")
    assert p.columns == ["a", "1 | x", "1 | all", "2 | x", "2 | all", "all | x", "all | all"]
    assert rows(p) == [(1, 1, 1, 0, 1, 1, 2), (2, 2, 2, 0, 0, 2, 2), (-1, 3, 3, 0, 1, 3, 4)]
    assert [r[0] for r in tables.pivot_table(s, ["a"], "b", "_freq_", [1], marginals="before").collect()] == [-1, 1, 2]
    none = tables.pivot_table(base.summ("a", "b", allcalc=True), ["a"], ["b"], "_freq_", [[1, 2]], marginals="none")
    assert sorted(rows(none)) == [(1, 1, 1), (2, 2, 0)]
    assert sorted(rows(tables.heat_levels(none, ["1", "2"], 2))) == [(1, 1, 1, 1, 1), (2, 2, 0, 1, 0)]
    x, names = tables.summary_array(base.summ("a", "b", allcalc=True))
    assert names == {"a": [1, 2], "b": [1, 2]} and np.array_equal(x, [[1, 1], [2, 0]])
    with pytest.raises(ValueError):
        tables.summary_array(base.summ("a", "b"), most=3)


def test_density_and_scatter_matrix(spark):
    import math

    vals = [0.0, 1.0, 1.5, 4.0]
    ds = Dataset.of(spark.createDataFrame([(v, 2 * v, None) for v in vals] + [(None, 1.0, 3.0), (float("inf"), 1.0, float("nan"))], "x double, y double, z double"), "t")
    for r in plotdata.density(ds, "x", at=9, bandwidth=0.5).collect():
        assert r["density"] == pytest.approx(sum(math.exp(-(((r["x"] - v) / 0.5) ** 2) / 2) for v in vals) / (4 * 0.5 * math.sqrt(2 * math.pi)), abs=1e-6)
    assert plotdata.density(ds.filter("x > 100"), "z").count() == 0
    got = {tuple(r) for r in plotdata.scatter_matrix(ds, ["x", "y", "z"], bins=2).collect()}
    assert got == {("x", "y", 0, 0, 3), ("x", "y", 1, 1, 1), ("y", "z", 0, 0, 1)}
    assert plotdata.points(ds, "x", limit=None).count() == 6 and plotdata.search_values(ds, "x", "*", None).count() == plotdata.count_values(ds, "x", "*")


def test_word_index(spark, tmp_path):
    from tallyframe.plans import textsearch as ts

    texts = ["The quick fox", "the fox the quick", "o'neil's fox fox", "", None, "a slow foxtrot", "the " * 300 + "end"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "k int, text string, word int")
    ts.write_postings(df, "k", "text", str(tmp_path / "w"))
    index = spark.read.parquet(str(tmp_path / "w"))
    for search in ("fox", "the < fox", '"quick fox"', "fox* - the", "fox* &- the", "oneils ~[2] fox", "(slow | quick) fox*", "end", "nothing", "the >[1] fox"):
        try:
            node = ts.parse(search)
        except ts.SearchError:
            continue
        want = sorted(r["k"] for r in df.where(ts.matches(node, F.col("text"))).collect())
        assert sorted(r["k"] for r in ts.search_postings(index, "k", node).collect()) == want, search
    plan = ts.search_postings(index, "k", ts.parse("fox"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    assert ts.search_postings(ts.postings(df.limit(0), "k", "text"), "k", ts.parse("fox")).count() == 0
