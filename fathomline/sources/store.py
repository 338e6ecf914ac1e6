"""Tables in shared storage: intermediate results, and versions that are complete or not there at all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SET_BY_US: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where it is unset, a temporary one, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _SET_BY_US.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="fathomline-"))
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew where it has fewer partitions than the cluster has cores: a file of one row group is one
    task, however much is done with each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Versions:
    """Numbered versions of a table under a folder.  A version is written aside and then renamed, so that
    readers see whole versions only; the highest serves.  One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def write(self, df: DataFrame, keep: int | None = None) -> int:
        """The number of the new version; of the earlier ones the newest ``keep`` stay, or all."""
        held = self.numbers()
        number = (held[-1] if held else 0) + 1
        aside = f"{self.root}/_writing-{uuid.uuid4().hex}"
        df.write.parquet(aside)
        if not self._fs.rename(self._path(aside), self._path(f"{self.root}/v{number}")):
            raise OSError(f"version {number} of {self.root} could not be put in place")
        for old in held[: max(0, len(held) - keep)] if keep is not None else ():
            self.drop(old)
        return number

    def read(self, number: int | None = None) -> DataFrame | None:
        held = self.numbers()
        number = number if number is not None else held[-1] if held else None
        return self.spark.read.parquet(f"{self.root}/v{number}") if number in held else None

    def drop(self, number: int) -> None:
        self._fs.delete(self._path(f"{self.root}/v{number}"), True)


class DailyLog:
    """Events as JSON lines, a folder a day, for stats and hooks: rows with ts in seconds are appended; days
    past their time are dropped whole and the rest of the oldest day is left out on reading."""

    def __init__(self, spark: SparkSession, root: str, schema: str, days: int = 30):
        self.spark, self.root, self.schema, self.days = spark, root.rstrip("/"), schema, days
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def append(self, events: DataFrame) -> None:
        events.withColumn("day", F.floor(F.col("ts") / 86_400)).write.mode("append").partitionBy("day").json(self.root)

    def prune(self, now: int) -> list[int]:
        """The days that were dropped: those wholly older than the time kept."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        old = sorted(int(n[4:]) for n in names if n.startswith("day=") and (int(n[4:]) + 1) * 86_400 <= now - self.days * 86_400)
        for day in old:
            self._fs.delete(self._path(f"{self.root}/day={day}"), True)
        return old

    def read(self, now: int | None = None, since: int | None = None) -> DataFrame:
        """Events of the time kept before ``now``, or since a time; broken lines are left out."""
        if not self._fs.exists(self._path(self.root)):
            return self.spark.createDataFrame([], self.schema)
        since = since if since is not None else now - self.days * 86_400 if now is not None else 0
        held = self.spark.read.schema(f"{self.schema}, day long").option("mode", "DROPMALFORMED").json(self.root)
        return held.where((F.col("day") >= since // 86_400) & (F.col("ts") >= since)).drop("day")
