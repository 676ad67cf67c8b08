import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from marginalia import shared
from marginalia.llm import common


def test_file_systems_by_scheme(monkeypatch):
    assert common.open_fs("file:///a/b")[1] == common.open_fs("file:/a/b")[1] == "/a/b"
    assert common.open_fs("dbfs:/a")[1] == "/dbfs/a"
    asked = []
    monkeypatch.setattr(shared.pafs, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda uri: asked.append(uri) or (pafs.LocalFileSystem(), uri))}))
    common.open_fs("s3a://bucket/x"), common.open_fs("hdfs://host/x")
    assert asked == ["s3://bucket/x", "hdfs://host/x"]
    with pytest.raises(ValueError):
        common.open_fs("/a/b")


@pytest.mark.parametrize("rows,hot", [(100_000, True), (0, True), (0, False)])
def test_join_table(spark, monkeypatch, rows, hot):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    big = spark.createDataFrame([(k, i) for i, k in enumerate(["a", None, "a", "b", None, "a"])], "k string, i int")
    table = common.written(spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v int"), "test")
    got = common.join_table(big, table, ["k"], hot=hot)
    assert got.columns == ["k", "i", "v"]
    assert sorted((r["i"], r["v"]) for r in got.collect()) == [(0, 1), (1, 2), (2, 1), (3, None), (4, 2), (5, 1)]
    assert sorted(r["i"] for r in common.join_table(big, table, ["k"], "left_semi", hot=hot).collect()) == [0, 1, 2, 4, 5]


@pytest.mark.parametrize("how,hot", [("left", True), ("left", False), ("inner", True), ("left_semi", True), ("left_semi", False)])
def test_a_large_table_is_never_broadcast(spark, monkeypatch, how, hot):
    """Its files take a few bytes a row, so by their size Spark would send it to all tasks, once per salt."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1_000)
    big = common.written(spark.range(0, 6_000, 2).withColumnRenamed("id", "k"), "test-big")
    table = common.written(spark.range(0, 6_000, 3).withColumnRenamed("id", "k").withColumn("v", F.lit(1)), "test-table")
    joined = common.join_table(big, table, ["k"], how, hot=hot)
    assert len(joined.collect()) == (3_000 if how == "left" else 1_000)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
