"""Where intermediate tables go."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from viewforge.session import scratch_path, shared_dir


def fake(master, configured=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: configured), sparkContext=SimpleNamespace(master=master)
    )


def test_the_named_folder_is_used(spark):
    assert shared_dir(fake("yarn", "hdfs://nn/shared")) == "hdfs://nn/shared"
    assert scratch_path(fake("yarn", "hdfs://nn/shared/"), "x").startswith("hdfs://nn/shared/x-")
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_cluster_without_a_named_folder_is_refused():
    with pytest.raises(RuntimeError):
        shared_dir(fake("yarn"))


def test_a_local_session_makes_one_folder():
    assert shared_dir(fake("local[2]")) == shared_dir(fake("local[2]"))
