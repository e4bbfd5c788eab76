"""Checkpoint folder: read from the session, created only when unset, and
never written into the (run-time immutable) core setting."""

import pytest

from calltrail.session import checkpoint_dir


class _Ctx:
    def __init__(self, d=None, master="local[2]"):
        self.d, self.master = d, master

    def getCheckpointDir(self):
        return self.d

    def setCheckpointDir(self, d):
        self.d = "file:" + d


class _Conf:
    def __init__(self, v=None):
        self.v = v

    def get(self, key, default=None):
        return self.v if key == "spark.checkpoint.dir" and self.v else default

    def set(self, key, value):
        raise AssertionError("core setting must not be written at run time")


class _Spark:
    def __init__(self, ctx_dir=None, conf_dir=None):
        self.sparkContext = _Ctx(ctx_dir)
        self.conf = _Conf(conf_dir)


def test_existing_folder_is_used():
    assert checkpoint_dir(_Spark(ctx_dir="hdfs://shared/ck/abc")) == "hdfs://shared/ck/abc"


def test_configured_folder_is_registered():
    assert checkpoint_dir(_Spark(conf_dir="/shared/ck")) == "file:/shared/ck"


def test_unset_folder_gets_a_scratch_one():
    d = checkpoint_dir(_Spark())
    assert d.startswith("file:") and "calltrail-ckpt-" in d


def test_unset_folder_on_a_cluster_is_an_error():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        s = _Spark()
        s.sparkContext.master = master
        with pytest.raises(RuntimeError):
            checkpoint_dir(s)


def test_live_session_has_one(spark):
    assert checkpoint_dir(spark)
