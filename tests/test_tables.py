import os
from types import SimpleNamespace

import pytest

from memspan.sources import tables


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None)))


def test_a_cluster_needs_a_shared_folder():
    assert tables.shared_folder(session("spark://host:7077", "hdfs:///x")) == "hdfs:///x"
    assert os.path.isdir(tables.shared_folder(session("local[4]")))
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_folder(session(master))


def test_written_tables_can_be_discarded(spark):
    path = tables.fresh_path(spark)
    assert tables.written(spark.range(3), path).count() == 3 and os.path.isdir(path)
    tables.discard(spark, path)
    assert not os.path.exists(path)
