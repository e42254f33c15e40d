"""Guardrails: checkpoint folder resolution, shuffle sizing, size-checked broadcast."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from tools.inspect_plan import node_names
from trustlens.plans.sizing import broadcast_if_small
from trustlens.session import checkpoint_dir, ensure_checkpoint_dir, shuffle_partitions_for


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Context:
    def __init__(self, master, ckpt=None):
        self.master, self.ckpt = master, ckpt

    def getCheckpointDir(self):
        return self.ckpt

    def setCheckpointDir(self, path):
        self.ckpt = path


def _fake(master, conf=None, ckpt=None):
    return SimpleNamespace(conf=_Conf(conf or {}), sparkContext=_Context(master, ckpt))


def test_checkpoint_dir_comes_from_the_session():
    s = _fake("spark://cluster:7077", {"spark.checkpoint.dir": "hdfs://shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs://shared/ckpt"
    assert s.sparkContext.getCheckpointDir() == "hdfs://shared/ckpt"
    assert checkpoint_dir(s) == "hdfs://shared/ckpt"


def test_cluster_without_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_fake("spark://cluster:7077"))


def test_local_session_gets_a_scratch_folder(tmp_path):
    s = _fake("local[4]")
    assert ensure_checkpoint_dir(s, fallback=str(tmp_path)) == str(tmp_path)
    assert s.conf.get("spark.checkpoint.dir") == str(tmp_path)


def test_shuffle_partitions_for():
    assert shuffle_partitions_for(1) == 1
    assert shuffle_partitions_for(256 << 20) == 1
    assert shuffle_partitions_for((256 << 20) + 1) == 2
    assert shuffle_partitions_for(4 * 10**12) == 16384


def test_broadcast_only_below_the_byte_limit(spark):
    big = spark.range(1000).withColumnRenamed("id", "k")
    small = spark.range(10).withColumnRenamed("id", "k")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = small.selectExpr("k", "repeat('x', 1000) AS name")  # as few rows, more bytes
        hinted = big.join(broadcast_if_small(small, max_bytes=1000), "k")
        assert "BroadcastHashJoin" in node_names(hinted)
        for large in (big.select("k"), wide):
            plain = big.join(broadcast_if_small(large, max_bytes=1000), "k")
            assert "BroadcastHashJoin" not in node_names(plain)
            assert plain.count() == large.count()  # the same rows either way
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
