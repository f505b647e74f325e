from types import SimpleNamespace

import pytest

from logloom.session import ensure_checkpoint_dir


def fake(master, conf=None, current=None):
    made = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: current, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default=None: conf or default)), made


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            ensure_checkpoint_dir(fake(master)[0])


def test_the_named_folder_is_used():
    spark, made = fake("yarn", conf="s3://bucket/ckpt")
    assert ensure_checkpoint_dir(spark) == "s3://bucket/ckpt" and made == ["s3://bucket/ckpt"]
    spark, made = fake("yarn", current="/shared/x")
    assert ensure_checkpoint_dir(spark) == "/shared/x" and not made


def test_a_local_master_gets_a_scratch_folder():
    spark, made = fake("local[4]")
    assert made == [] and ensure_checkpoint_dir(spark) == made[0]
