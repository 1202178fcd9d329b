"""A third of all rows in one group: plans keep map-side combination and results stay exact."""

from pyspark.sql import functions as F

from tallyframe.meta import ColumnMeta, Dataset
from tallyframe.operators import measures as m
from tallyframe.operators.keyed_stats import keyed_stats
from tallyframe.plans import scale


def test_hot_key(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), ((F.col("id") * 7919) % 10007).cast("double").alias("v"))
    want = {r["k"]: r for r in df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(v, 0.5)").alias("mid")).collect()}
    got = {r["k"]: r for r in keyed_stats(df, ["k"], "v", (0.5,)).collect()}
    s = {r["k"]: r for r in Dataset.of(df, "d", k=ColumnMeta("categorical"), v=ColumnMeta("scalar")).summ("k", m.median("v")).df.collect()}
    assert got.keys() == want.keys() == s.keys()
    for k, w in want.items():
        assert got[k]["n_rows"] == w["n"] == s[k]["_freq_"] and got[k]["q50"] == s[k]["median_of_v"] == w["mid"]


def test_summaries_combine_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = Dataset.of(df, "d", v=ColumnMeta("scalar")).summ("g", m.mean("v"), ordered=False).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum") > 0 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_join_small_ways_agree(spark, monkeypatch):
    big = spark.createDataFrame([(i % 3 or None, i) for i in range(300)], "k int, x int")
    small = spark.createDataFrame([(None, "n"), (1, "a")], "k int, y string")
    rows = lambda: sorted(map(str, scale.join_small(big, small, ["k"], 2).collect()))
    first = rows()
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    assert rows() == first and len(first) == 200


def test_salts_of_equal_rows(spark):
    """A key with three values, and many rows of each, is spread over every salt."""
    df = spark.range(100_000).select(F.lit("hot").alias("k"), (F.col("id") % 3).alias("v")).withColumn("salt", scale.row_salt(32))
    counts = {r["salt"]: r["count"] for r in df.groupBy("salt").count().collect()}
    assert set(counts) == set(range(32)) and max(counts.values()) < 2 * min(counts.values())


def test_hot_key_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (1.0 + (F.col("id") % 4999) / 1e7).alias("v"))
    want = {r["k"]: r["mid"] for r in df.groupBy("k").agg(F.expr("percentile(v, 0.5)").alias("mid")).collect()}
    got = keyed_stats(df, ["k"], "v", (0.5,)).collect()
    assert all(abs(r["q50"] - want[r["k"]]) < 1e-12 for r in got) and len(got) == len(want)


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    import pytest

    class Context:
        master, folder = "spark://far:7077", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        sparkContext = Context()
        conf = {"spark.checkpoint.dir": None}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scale.ensure_checkpoint_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs:///shared"}
    scale.ensure_checkpoint_dir(Session())
    assert Session.sparkContext.folder == "hdfs:///shared"
