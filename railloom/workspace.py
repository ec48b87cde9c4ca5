"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset and all runs on this machine, a fresh one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="railloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers of a session that was started elsewhere import this package."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *paths])
    return spark


#: Workspaces of this driver that are not closed.
_opened: list[Workspace] = []


def opened() -> int:
    """How many workspaces are open; ``close_opened`` takes the number to go back to."""
    return len(_opened)


def close_opened(since: int) -> None:
    """Delete the tables of all workspaces opened since; for callers that have written what was made of them."""
    for workspace in _opened[since:]:
        workspace.close()


class Workspace:
    """Tables of one query run: written once, read back, removed when the session ends.

    A written table cuts lineage and survives the loss of any executor.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = importable(spark)
        self.root = f"{shared_dir(spark)}/railloom/{label}-{uuid.uuid4().hex}"
        self._path(self.root).getFileSystem(self._conf()).deleteOnExit(self._path(self.root))
        _opened.append(self)

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def table(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Write ``df`` under ``name`` and return the table read back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        path = self._path(f"{self.root}/{name}")
        path.getFileSystem(self._conf()).delete(path, True)

    def close(self) -> None:
        """Delete all tables of this run, for callers that have written its result elsewhere."""
        self._path(self.root).getFileSystem(self._conf()).delete(self._path(self.root), True)
        if self in _opened:
            _opened.remove(self)
