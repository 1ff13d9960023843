import os

import pytest

from annalog.llm import durable


def test_a_cut_ends_the_lineage_in_the_named_folder(spark):
    frame = durable.cut(spark.range(5), "t")
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert frame._cut_path.startswith(f"{shared}/annalog/t-")
    assert frame.inputFiles() and all(f.startswith(shared.replace("file:///", "file:/")) or f.startswith(shared) for f in frame.inputFiles())
    local = frame._cut_path.removeprefix("file://")
    assert os.path.isdir(local)
    durable.discard(frame)
    assert not os.path.isdir(local)


def test_only_the_discarded_goes(spark):
    a, b = durable.cut(spark.range(3), "a"), durable.cut(spark.range(4), "b")
    durable.discard(a)
    assert b.count() == 4
    durable.discard(b)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "yarn"

        def getConf(self):  # noqa: N802
            return {}

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        durable.shared_dir(Session())
