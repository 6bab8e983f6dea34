"""Intermediate tables in the cluster's shared checkpoint folder.

Tables read more than once, and the rounds of iterative jobs, are written as
Parquet and read back.  That cuts the lineage, survives the loss of executors,
and gives the planner real sizes, so it broadcasts only what is small.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cached_property
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes made inside drop their shuffle files when they end, so that a disk holds those of one
    write at a time.  What was written is read back from its own files."""
    before = spark.conf.get(CLEANUP_SETTING, "false")
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_SETTING, before)


@dataclass
class Stored:
    """A written table with its row count, taken while writing or from the file footers."""

    df: DataFrame
    path: str | None = None
    parent: "Stored | None" = field(default=None, repr=False)
    observed: Observation | None = field(default=None, repr=False)

    @cached_property
    def rows(self) -> int:
        """Row count; for a view of another table, that table's count as a bound."""
        if self.parent is not None:
            return self.parent.rows
        if self.observed is not None:
            return self.observed.get["rows"]
        return self.df.count()

    def view(self, df: DataFrame) -> "Stored":
        """A filter or projection of this table, which has no more rows than it."""
        return Stored(df, self.path, self)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for local masters."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="crossweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return shared_folder(spark)


class Workspace:
    """One run's intermediate tables; deleted by ``close``, or else when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/run-{uuid4().hex}"
        self._count = 0
        path, files = self._hadoop()
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _hadoop(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> Stored:
        self._count += 1
        path = f"{self.root}/{self._count:03d}-{name}"
        observed = Observation()
        counted = df.observe(observed, F.count(F.lit(1)).alias("rows"))
        with shuffles_dropped(self.spark):
            counted.write.option("compression", "zstd").parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        return Stored(written, path, observed=observed)

    def close(self) -> None:
        path, files = self._hadoop()
        files.delete(path, True)

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def has_rows(df: DataFrame) -> bool:
    return not df.select(F.lit(1)).isEmpty()
