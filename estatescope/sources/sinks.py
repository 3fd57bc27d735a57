"""Table sinks: append, replace, refresh by server, and an error log."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from estatescope.sources.schemas import SILVER
from estatescope.workspace import listed, moved, note, noted, removed

#: A server's rows are written by at most so many tasks, one file each.
FILES_PER_SERVER = 32


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def refresh(df: DataFrame, path: str, server_ids: Sequence[int] | None = None) -> None:
    """Full refresh, or replace only the given servers' rows and leave the rest alone.

    The table is partitioned by server.  New rows are first written to a folder of their own, then a marker says
    which servers' folders they replace, then the folders change places one by one.  A run that dies before the
    marker has changed nothing; after it, the next refresh (or :func:`recover`) ends what was begun.  Either way the
    table is that of before or that of after, never a mixture that stays.
    """
    spark, staging = df.sparkSession, f"{path}/{_STAGING}"
    recover(spark, path)
    wanted = df if server_ids is None else df.filter(F.col("server_id").isin(list(server_ids)))
    _by_server(wanted).write.mode("overwrite").partitionBy("server_id").parquet(staging)
    fresh = [x for x in listed(spark, staging) if x.startswith("server_id=")]
    there = [x for x in listed(spark, path) if x.startswith("server_id=")]
    old = there if server_ids is None else [x for x in there if x in {f"server_id={s}" for s in server_ids}]
    # Servers without fresh rows lose their folder; an empty one keeps the schema should none be left.
    if not fresh and not set(there) - set(old):
        empty = f"server_id={server_ids[0] if server_ids else 0}"
        spark.createDataFrame([], df.drop("server_id").schema).write.parquet(f"{staging}/{empty}")
        fresh = [empty]
    noted(spark, f"{path}/{_MARKER}", json.dumps({"old": old, "fresh": fresh}))
    recover(spark, path)


#: Names that readers of a table pass over.
_STAGING, _MARKER = "_staging", "_refresh"


def recover(spark: SparkSession, path: str) -> bool:
    """End a refresh that has written its marker, undo one that has not; whether one was ended.

    Each step can be repeated: a fresh folder that is no longer in the staging folder is in its place."""
    staging, marker = f"{path}/{_STAGING}", note(spark, f"{path}/{_MARKER}")
    if marker is not None:
        plan = json.loads(marker)
        waiting = set(listed(spark, staging))
        for name in plan["old"]:
            if name in waiting or name not in plan["fresh"]:
                removed(spark, f"{path}/{name}")
        for name in plan["fresh"]:
            if name in waiting:
                removed(spark, f"{path}/{name}")
                moved(spark, f"{staging}/{name}", f"{path}/{name}")
        removed(spark, f"{path}/{_MARKER}")
    removed(spark, staging)
    return marker is not None


def add_missing(df: DataFrame, path: str, on: Sequence[str]) -> None:
    """Add the rows whose key the table does not have yet; the table is made if it is not there."""
    try:
        known = df.sparkSession.read.schema(df.schema).parquet(path).select(*on)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return replace(df, path)
    append(df.join(known, list(on), "left_anti"), path)


def _by_server(df: DataFrame) -> DataFrame:
    """A server's rows in a few tasks instead of in all, and a large server not in one."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(FILES_PER_SERVER))
    return df.repartition("server_id", salt)


def clear(spark: SparkSession, path: str, name: str) -> None:
    """Empty one inventory table."""
    spark.createDataFrame([], SILVER[name]).write.mode("overwrite").parquet(path)


ERRORS = "dt timestamp, message string, command string"


def failure(error: Exception, name: str, now: datetime) -> tuple:
    """A row of the error log, with the whole message: Spark tells the cause at the end."""
    return now, f"{type(error).__name__}: {error}", name


class StoredTables(dict):
    """Tables by name; asking for one that could not be made names the cause."""

    def __missing__(self, name: str) -> DataFrame:
        raise LookupError(f"needs {name}, which failed or is not there")


def collect_all(spark: SparkSession, jobs: dict[str, Callable[[dict[str, DataFrame]], DataFrame]],
                root: str, write: Callable[[DataFrame, str], None] = replace,
                made: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Run and store each job in order; a failing one is logged and the rest go on.

    A job is given the tables stored so far (and those ``made`` before) and reads those, so nothing is
    computed twice.  Returns the stored tables and the error rows of this run, which are also
    appended to ``<root>/exec_errors``.
    """
    tables = StoredTables(made or {})
    failures, now = [], datetime.now()
    for name, job in jobs.items():
        try:
            write(job(tables), f"{root}/{name}")
            tables[name] = spark.read.parquet(f"{root}/{name}")
        except Exception as error:  # any failing unit is logged, none stops the others
            failures.append(failure(error, name, now))
    errors = spark.createDataFrame(failures, ERRORS)
    if failures:
        append(errors, f"{root}/exec_errors")
    return tables, errors
