from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from types import SimpleNamespace

import pytest

from ledgerlens.sources import storage
from ledgerlens.sources.storage import forget, settle, shared_dir


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1000]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session(master), "t")
    assert shared_dir(session(master, "s3a://bucket/x/"), "t").startswith("s3a://bucket/x/t-")
    assert shared_dir(session(master), "t", "hdfs://h/y").startswith("hdfs://h/y/t-")


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_one_machine_may_use_its_own_folder_and_keeps_the_setting(master):
    s = session(master)
    a, b = shared_dir(s, "t"), shared_dir(s, "t")
    assert a != b and a.rpartition("/")[0] == b.rpartition("/")[0] and s.conf.get("spark.checkpoint.dir", None) is None


def test_forgotten_tables_are_gone(spark):
    table = settle(spark.range(5).repartition(2), "t")
    at = Path(table._settled_at.removeprefix("file://"))
    assert table.count() == 5 and at.exists()
    forget(spark, table)
    assert not at.exists()
    forget(spark, None)
    forget(spark, spark.range(3))


def test_scratch_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda spark, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    with storage.scratch(spark):
        a = storage.settle(spark.range(5), "inside")
        assert a.count() == 5 and len(list(tmp_path.iterdir())) == 1
    assert not [p for p in tmp_path.iterdir() if p.is_dir()]
    with pytest.raises(ZeroDivisionError), storage.scratch(spark):
        storage.settle(spark.range(5), "inside")
        raise ZeroDivisionError
    assert not [p for p in tmp_path.iterdir() if p.is_dir()]
    assert storage.settle(spark.range(5), "outside").count() == 5 and len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1


def test_threads_that_settle_leave_the_session_as_it_was(spark):
    before = spark.conf.get(storage.CLEANUP, None)
    with ThreadPoolExecutor(6) as pool:
        tables = [*pool.map(lambda n: storage.settle(spark.range(n * 100).repartition(3), "many").count(), range(12))]
    assert tables == [n * 100 for n in range(12)] and spark.conf.get(storage.CLEANUP, None) == before
