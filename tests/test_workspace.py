import types

import pytest

from martloom.workspace import Workspace, exists, shared_folder


def session(folder, master, checkpoint=None):
    made = []
    context = types.SimpleNamespace(
        master=master, getCheckpointDir=lambda: checkpoint, setCheckpointDir=made.append
    )
    conf = types.SimpleNamespace(get=lambda name, default: folder)
    return types.SimpleNamespace(conf=conf, sparkContext=context), made


def test_the_named_folder_is_used():
    spark, made = session("hdfs://x/check/", "yarn")
    assert shared_folder(spark) == "hdfs://x/check" and not made


def test_a_folder_set_in_code_is_used():
    spark, made = session(None, "yarn", "s3://x/check")
    assert shared_folder(spark) == "s3://x/check" and not made


def test_a_cluster_without_one_is_refused():
    spark, _ = session(None, "spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(spark)


def test_a_local_session_may_go_without():
    spark, made = session(None, "local[4]")
    assert made == [shared_folder(spark)]


def test_saved_rows_are_counted_while_written(spark, ws):
    saved = ws.save(spark.range(10, numPartitions=3), "r")
    assert (saved.rows, saved.df.count()) == (10, 10)
    assert ws.save(spark.range(0), "r").rows == 0
    assert ws.path("r") != ws.path("r")


def test_two_workspaces_do_not_meet(spark):
    assert Workspace(spark).root != Workspace(spark).root
    assert Workspace(spark).root.startswith(shared_folder(spark))


def test_scratch_goes_and_what_is_kept_stays(spark, ws):
    with ws.scratch():
        outer = ws.save(spark.range(3), "outer")
        with ws.scratch():
            gone = ws.save(spark.range(4), "gone")
            kept = ws.keep(ws.save(spark.range(5), "kept"))
        assert not exists(spark, gone.path) and exists(spark, outer.path)
    assert not exists(spark, outer.path) and kept.df.count() == 5
    with pytest.raises(ZeroDivisionError), ws.scratch():
        left = ws.save(spark.range(1), "left")
        1 / 0
    assert not exists(spark, left.path)
    assert exists(spark, ws.save(spark.range(1), "no block").path)
