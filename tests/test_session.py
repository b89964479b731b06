"""Staged tables: what they cost on disk after they are written."""

from pathlib import Path

from wiretally import session


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_staging_leaves_no_shuffle_files(spark):
    before, kept = _shuffle_files(spark), spark.conf.get(session.CLEANUP)
    out = session.stage(spark.range(5000).repartition(7, "id").groupBy("id").count())
    assert not _shuffle_files(spark) - before
    assert out.count() == 5000 and spark.conf.get(session.CLEANUP) == kept


def test_scratch_is_gone_afterwards(spark):
    folder = Path(session.checkpoint_folder(spark).removeprefix("file:"))
    with session.scratch(spark.range(100).repartition(3, "id")) as held:
        assert held.count() == 100 and list(folder.glob("scratch-*"))
    assert not list(folder.glob("scratch-*"))
