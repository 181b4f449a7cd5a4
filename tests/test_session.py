"""Where intermediates go, and appends that meet another writer."""

from types import SimpleNamespace

import pytest

from runsift import session
from runsift.sources import batches


def fake(**values):
    known = {k.replace("_", "."): v for k, v in values.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, *default: known.get(key, *default)))


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(ValueError):
        session.scratch_path(fake(spark_master="spark://host:7077"), "x")
    shared = fake(spark_master="spark://host:7077", **{"spark_checkpoint_dir": "hdfs://all/tmp/"})
    assert session.scratch_path(shared, "x").startswith("hdfs://all/tmp/x-")


def test_of_two_writers_of_a_batch_one_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1,)], "a int")

    def write(rows, folder):
        # Another writer finishes the same batch while this one is at work.
        if not batches.published(spark, path):
            assert batches.publish(df, path, "b", lambda r, f: r.write.json(f))
        rows.write.json(folder)

    assert not batches.publish(df, path, "b", write)
    folders = batches.published(spark, path)
    assert len(folders) == 1 and spark.read.json(folders).count() == 1


def test_a_write_that_died_may_run_again(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1,)], "a int")

    def dies(rows, folder):
        rows.write.json(folder)
        raise OSError("lost")

    with pytest.raises(OSError):
        batches.publish(df, path, "b", dies)
    assert batches.published(spark, path) == []
    # One that died behind its marker's first name.
    (tmp_path / "t" / "batches").mkdir(parents=True, exist_ok=True)
    (tmp_path / "t" / "batches" / "_b-dead").write_text("")
    assert batches.published(spark, path) == []
    assert batches.publish(df, path, "b", lambda r, f: r.write.json(f))
    assert spark.read.json(batches.published(spark, path)).count() == 1
