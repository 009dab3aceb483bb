import os
from types import SimpleNamespace
from urllib.parse import urlparse

import pytest
from pointloom.llm import common
from pointloom.llm.components import connected_components


def test_a_cluster_must_name_its_shared_folder(spark):
    def session(master, named):
        conf = SimpleNamespace(get=lambda key, default: named or default)
        sc = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: sc.dir, setCheckpointDir=lambda d: setattr(sc, "dir", d), dir=None)
        return SimpleNamespace(sparkContext=sc)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.checkpoint_folder(session("spark://host:7077", ""))
    assert common.checkpoint_folder(session("spark://host:7077", "hdfs://x/shared/")) == "hdfs://x/shared"
    assert os.path.isdir(common.checkpoint_folder(session("local[4]", "")))


def test_checkpoints_that_nothing_reads_are_deleted(spark):
    df = common.cut_lineage(spark.range(7))
    folder = urlparse(df._jdf.logicalPlan().rdd().getCheckpointFile().get()).path
    assert os.path.isdir(folder) and df.count() == 7
    common.drop_checkpoint(df, None)
    assert not os.path.exists(folder)


def test_components_leave_one_checkpoint(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101), (None, 3), (5, 5)], "a long, b long")
    root = urlparse(common.checkpoint_folder(spark)).path
    count = lambda: sum(x.startswith("rdd-") for _, names, _ in os.walk(root) for x in names)
    before = count()
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100} and count() == before + 1


def test_unused_names(spark):
    df = spark.range(1).selectExpr("id", "1 as _Rank", "2 as rank")
    assert common.unused(df, "rank", "ID", "own") == ["__rank", "_ID", "own"]
