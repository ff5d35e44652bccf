"""Shared helpers."""

import pytest
from pyspark.sql import functions as F

from loanlag.llm import common


class Context:
    folder, master = None, "local[2]"

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, path):
        self.folder = path


class Session:
    def __init__(self, setting):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": setting} if setting else {}, Context()


def test_the_folder_comes_from_the_setting_and_is_set_only_where_there_is_none():
    named = Session("hdfs://store/checkpoints")
    assert common.shared_folder(named) == "hdfs://store/checkpoints" and named.sparkContext.folder is None
    unset = Session(None)
    first = common.shared_folder(unset)
    assert first and first == unset.sparkContext.folder == common.shared_folder(unset)


def test_total_before_adds_up_by_buckets(spark):
    rows = [(g, o % 5, o, v) for g in ("a", "b", None) for o, v in enumerate([3, 1, 4, 1, 5, 9, 2, 6, 5, 3])]
    df = spark.createDataFrame(rows, "g string, b int, o int, v long")
    got = {(r.g, r.o): r.total for r in common.total_before(df, ["g"], "b", ["o"], "v", "total").collect()}
    for g in ("a", "b", None):
        at = 0
        for _, b, o, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            assert got[g, o] == at
            at += v


def test_tables_are_written_to_the_folder(spark):
    df = common.materialize(spark.range(5).withColumn("x", F.col("id") * 2))
    assert sorted(r.x for r in df.collect()) == [0, 2, 4, 6, 8]
    assert all(common.shared_folder(spark).removeprefix("file:") in f for f in df.inputFiles())


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        session = Session(None)
        session.sparkContext.master = master
        with pytest.raises(RuntimeError):
            common.shared_folder(session)
        assert session.sparkContext.folder is None
