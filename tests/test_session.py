"""Scratch tables: where they may lie, and their removal."""

import os

import pytest

from insight import land, remove_scratch
from insight.session import checkpoint_root, cluster_settings


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class sparkContext:  # noqa: N801
        master = "yarn"

        @staticmethod
        def getCheckpointDir():
            return None

        @staticmethod
        def getConf():
            return {}

    conf = {}


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Elsewhere)


def test_partitions_follow_the_input():
    gib = 1 << 30
    parts = [int(cluster_settings(n * gib)["spark.sql.shuffle.partitions"]) for n in (1, 1000, 100_000, 10_000_000)]
    assert parts == [200, 4000, 400_000, 40_000_000]


def test_scratch_is_landed_and_removed(spark, monkeypatch):
    own = f"{checkpoint_root(spark)}/scratch-of-test"
    monkeypatch.setattr("insight.session.scratch_root", lambda _: own)
    assert land(spark.range(10), "ten").count() == 10
    folder = own.removeprefix("file:")
    assert os.path.isdir(folder)
    remove_scratch(spark)
    assert not os.path.exists(folder) and os.path.isdir(os.path.dirname(folder))
