"""Intermediate tables in the folder that all machines share.

The folder is ``spark.checkpoint.dir`` of the session.  Only a local session, in which driver and
executors are one process, may leave it unset and then gets a temporary directory.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, purpose: str) -> str:
    """The name of a fresh folder in the shared directory."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = _local_folder()
    run = f"{spark.sparkContext.applicationId}-{os.urandom(6).hex()}"
    return f"{shared.rstrip('/')}/{purpose}-{run}"


#: Whether Spark deletes the shuffle files of a query when it has ended.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Up to which size Spark broadcasts a side of a join, by its files and once measured.
_BROADCAST = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def joined_in_tasks(spark: SparkSession):
    """What is written within this context joins in tasks only.

    A side that is broadcast is built on the driver and stays there until the driver collects its garbage; a step of many
    small joins fills the driver's memory with them, whatever the size of its input."""
    return _settings(spark, dict.fromkeys(_BROADCAST, "-1"))


def stored(df: DataFrame, path: str, *partitions: str) -> DataFrame:
    """Write ``df`` once and read it back: later steps, and retries after a lost executor, start
    from the files.  What was shuffled to make them is deleted then, not when the driver next collects garbage."""
    spark = df.sparkSession
    with _settings(spark, {_CLEANED: "true"}):
        writer = df.write.mode("errorifexists").option("compression", "zstd")
        if partitions:
            writer = writer.partitionBy(*partitions)
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str) -> tuple:
    """The path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    target, files = _at(spark, path)
    files.delete(target, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if it is not there."""
    target, files = _at(spark, path)
    return [x.getPath().getName() for x in files.listStatus(target)] if files.exists(target) else []


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder or file within one file system; the target must not be there."""
    source, files = _at(spark, source)
    if not files.rename(source, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not move {source.toString()} to {target}")


def noted(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, all of it or nothing."""
    target, files = _at(spark, f"{path}.new")
    stream = files.create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    moved(spark, f"{path}.new", path)


def note(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    target, files = _at(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return spark._jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A").next()
    finally:
        stream.close()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="estatescope-")
