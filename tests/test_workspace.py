import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from crossweave.workspace import CLEANUP_SETTING, Stored, Workspace, has_rows


def _shuffle_files(spark) -> list[str]:
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return [f for d in manager.localDirs() for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")]


def test_tables_live_as_long_as_the_workspace(spark):
    with Workspace(spark) as ws:
        table = ws.save(spark.range(5), "numbers")
        folder = table.path.removeprefix("file:").replace("//", "/")
        assert os.path.isdir(folder)
        assert table.rows == table.df.count() == 5
    assert not os.path.exists(folder)


@pytest.mark.parametrize("condition", ["false", "id > 20"])
def test_empty_tables(spark, ws, condition):
    table = ws.save(spark.range(10).where(condition).groupBy("id").count(), "none")
    assert table.rows == 0 and not has_rows(table.df)


def test_views_are_bounded_by_their_table(spark, ws):
    table = ws.save(spark.range(10), "numbers")
    assert table.view(table.df.where("id < 3")).rows == 10
    assert Stored(spark.range(4)).rows == 4


def test_a_write_leaves_no_shuffle_files(spark, ws):
    """Disks hold the shuffles of one write at a time, and the session's setting is left as it was."""
    before = spark.conf.get(CLEANUP_SETTING)
    left = len(_shuffle_files(spark))
    table = ws.save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    deadline = time.time() + 20
    while len(_shuffle_files(spark)) > left and time.time() < deadline:
        time.sleep(0.1)
    assert len(_shuffle_files(spark)) <= left
    assert table.rows == table.df.count() == 7
    assert spark.conf.get(CLEANUP_SETTING) == before
