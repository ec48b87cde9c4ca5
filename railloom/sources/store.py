"""Index tables on disk: written with a manifest, read back while they are fresh and fit the stops, built again if not."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def flag(text: str | None, default: bool) -> bool:
    """A yes or no from an environment; anything else is the default."""
    word = (text or "").strip().lower()
    return True if word in _TRUE else False if word in _FALSE else default


def whole(text: str | None, default: int) -> int:
    """A whole number from an environment, or the default."""
    try:
        return int((text or "").strip())
    except ValueError:
        return default


def positive(text: str | None, default: float) -> float:
    """A number above zero from an environment, or the default."""
    try:
        value = float((text or "").strip())
    except ValueError:
        return default
    return value if value > 0 else default


def choose_path(variable: str, configured: str | None, fallback: str, exists: Callable[[str], bool], environ: Mapping[str, str] = os.environ) -> str | None:
    """Where an index lies: as the environment says, else as configured, else the fallback if there is one."""
    return environ.get(variable, "").strip() or (configured or "").strip() or (fallback if exists(fallback) else None)


def digest(stops: DataFrame) -> str:
    """One value for a set of stop ids, whatever their order."""
    row = stops.select(F.xxhash64("stop_id").alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1_000_000_007))).alias("s")).first()
    return f"{row.n}:{row.x}:{row.s}"


class IndexStore:
    """Tables under one folder that driver and executors share.

    The manifest is written last, so a run that is cut short leaves tables that are not taken up.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def save(self, name: str, table: DataFrame, stops: DataFrame, parameters: str = "") -> DataFrame:
        """Write an index table and its manifest, and return it read back."""
        path = f"{self.root}/{name}"
        table.write.mode("overwrite").parquet(f"{path}/data")
        manifest = [(VERSION, time.time(), digest(stops), parameters)]
        self.spark.createDataFrame(manifest, "version int, written double, stops string, parameters string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
        return self.spark.read.schema(table.schema).parquet(f"{path}/data")

    def load(self, name: str, stops: DataFrame, parameters: str = "", max_age: float | None = None) -> DataFrame | None:
        """The table, if it is there, made for these stops and parameters and not older than ``max_age`` seconds."""
        path = f"{self.root}/{name}"
        if not self.exists(f"{path}/manifest/_SUCCESS"):
            return None
        m = self.spark.read.parquet(f"{path}/manifest").first()
        if m is None or m.version != VERSION or m.parameters != parameters or m.stops != digest(stops):
            return None
        if max_age is not None and time.time() - m.written > max_age:
            return None
        return self.spark.read.parquet(f"{path}/data")

    def ensure(self, name: str, build: Callable[[], DataFrame], stops: DataFrame, parameters: str = "", max_age: float | None = None) -> DataFrame:
        """The table as stored, or built and stored."""
        found = self.load(name, stops, parameters, max_age)
        return found if found is not None else self.save(name, build(), stops, parameters)

    def resume(self, name: str, keys: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], stops: DataFrame, parameters: str = "", parts: int = 8) -> DataFrame:
        """``work`` on ``keys`` part by part, each stored as it is done; a run that starts again goes on with the parts left."""
        made = None
        for i in range(parts):
            own = keys.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i)
            done = self.ensure(f"{name}/part_{i}", lambda own=own: work(own), stops, f"{parameters}|{parts}")
            made = done if made is None else made.unionByName(done)
        return made


def first_of(sources: Sequence[tuple[str, Callable[[], DataFrame | None]]]) -> tuple[str, DataFrame]:
    """The first source that gives a table, by name: a fresh cache, the tables themselves, a stale cache, a mock."""
    failed = []
    for name, read in sources:
        try:
            found = read()
        except Exception as e:  # noqa: BLE001  a source that cannot be read is passed over, and named if all are
            failed.append(f"{name}: {e}")
            continue
        if found is not None:
            return name, found
    raise ValueError("no source has a network: " + "; ".join(failed))


def mock_network(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(stop times, stops) of a network of three stops and two trips."""
    times = [("T1", 0, 1000, 1, 3), ("T1", 1, 1050, 2, 3), ("T2", 1, 1060, 1, 2), ("T2", 2, 1100, 2, 2)]
    places = [(0, "A", 48.8566, 2.3522), (1, "B", 48.8570, 2.3530), (2, "C", 48.8574, 2.3540)]
    return spark.createDataFrame(times, "trip_id string, k int, t long, seq int, route_type int"), spark.createDataFrame(places, "k int, stop_id string, lat double, lon double")
