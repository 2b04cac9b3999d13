"""Folders in the shared place: scopes, what is kept, and where it may be."""

from types import SimpleNamespace

import pytest

from eddyline.sources import scratch


def test_scopes(spark):
    outside = scratch.written(spark.range(3), "outside")
    with scratch.Scope(spark) as outer:
        first = scratch.written(spark.range(4), "first")
        with scratch.Scope(spark) as inner:
            kept, gone = (scratch.written(spark.range(5), n) for n in ("kept", "gone"))
            lasting = scratch.written(spark.range(6), "lasting", lasting=True)
            inner.keep(kept)
        assert [scratch.exists(spark, t.scratch_path) for t in (first, kept, gone)] == [True, True, False]
        outer.keep(first)
    assert [scratch.exists(spark, t.scratch_path) for t in (outside, first, kept, lasting)] == [True, True, False, True]
    assert first.count() == 4
    with pytest.raises(ZeroDivisionError), scratch.Scope(spark):
        failed = scratch.folder(spark, "failed")
        spark.range(1).write.parquet(failed)
        raise ZeroDivisionError
    assert not scratch.exists(spark, failed)
    assert scratch.complete(spark, outside.scratch_path) and scratch.listed(spark, failed) == []


def test_moving_does_not_overwrite(spark):
    a, b = (scratch.written(spark.range(n), "moved").scratch_path for n in (1, 2))
    with pytest.raises(FileExistsError):
        scratch.moved(spark, a, b)
    scratch.moved(spark, a, f"{b}-new")
    assert spark.read.parquet(f"{b}-new").count() == 1 and scratch.delete(spark, f"{b}-new")


@pytest.mark.parametrize(("master", "fine"), [("local", True), ("local[8]", True), ("local[*]", True), ("local-cluster[3,2,1000]", False), ("spark://h:7077", False), ("yarn", False)])
def test_a_local_folder_only_for_local_executors(master, fine):
    held = {}
    conf = SimpleNamespace(get=held.get, set=held.__setitem__)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    if fine:
        assert scratch.root(session) == scratch.root(session)
    else:
        with pytest.raises(RuntimeError):
            scratch.root(session)
        held["spark.checkpoint.dir"] = "hdfs://shared/place/"
        assert scratch.root(session) == "hdfs://shared/place"
