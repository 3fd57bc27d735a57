"""Loading only what has changed since the run before.

A database is known by a fingerprint of everything its tables are made from: all its snapshot rows, whatever their order, and
what the inventory says of it and its server.  ``loaded`` keeps the fingerprints of the last run that ended well.
Databases with the same fingerprint are left out of the snapshot tables, and their stored rows are taken over.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from estatescope.sources.sinks import recover, refresh

DB = ["server_id", "database_id"]
#: Inventory tables whose rows come from one database each.
PER_DATABASE = ("database_files", "objects", "columns", "index_usage", "sequences")
#: What the collectors of these ask the inventory for.
_DATABASE = ["database_name", "state_desc", "primary_replica", "edition"]
_SERVER = ["server_name", "version"]

Tables = dict[str, DataFrame]


def fingerprints(b: Tables, s: Tables, mode: str) -> DataFrame:
    """(server_id, database_id, fingerprint) of every database of the inventory: one union, one aggregate."""
    def rows(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
        return df.select(*DB, F.xxhash64(F.lit(name), *[F.col(f"`{c}`") for c in columns]).alias("_h"))

    named = s["databases"].select(*DB, *_DATABASE).join(s["servers"].select("server_id", *_SERVER), "server_id")
    inputs = [rows(named.withColumn("_mode", F.lit(mode)), "", [*_DATABASE, *_SERVER, "_mode"])]
    inputs += [rows(df, name, df.columns) for name, df in b.items() if "database_id" in df.columns]
    parts: list[Column] = [F.count(F.lit(1)), F.bit_xor("_h"), F.sum(F.pmod("_h", F.lit((1 << 31) - 1)))]
    every = reduce(DataFrame.unionByName, inputs).groupBy(*DB).agg(F.concat_ws(":", *parts).alias("fingerprint"))
    return every.join(s["databases"].select(*DB), DB, "left_semi")


class Changes(NamedTuple):
    """Databases to load, those whose stored rows stay, and the servers of the former and of those that are gone."""

    now: DataFrame
    changed: DataFrame
    same: DataFrame
    servers: list[int]


def changes(spark: SparkSession, now: DataFrame, path: str) -> Changes:
    """Compare fingerprints with those stored in ``path``; none stored: all have changed."""
    try:
        recover(spark, path)
        before = spark.read.parquet(path).select(*DB, F.col("fingerprint").alias("_before"))
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        before = now.select(*DB, F.col("fingerprint").alias("_before")).limit(0)
    both = now.join(before, DB, "full_outer")
    equal = F.col("fingerprint").eqNullSafe(F.col("_before"))
    servers = [r[0] for r in both.filter(~equal).select("server_id").distinct().collect()]
    return Changes(now, both.filter(~equal & F.col("fingerprint").isNotNull()).select(*DB),
                   both.filter(equal).select(*DB), sorted(servers))


def only(b: Tables, changed: DataFrame) -> Tables:
    """Snapshot tables without the rows of other databases; tables of whole servers as they are."""
    return {name: df.join(changed, DB, "left_semi") if "database_id" in df.columns else df for name, df in b.items()}


def merge(found: Changes) -> Callable[[DataFrame, str], None]:
    """A writer: fresh rows of changed databases beside the stored rows of the same servers' other ones.

    Servers without a change are not touched; databases that are gone lose their rows."""
    def write(df: DataFrame, path: str) -> None:
        if not found.servers:
            return
        fresh = df.join(found.changed, DB, "left_semi")
        recover(df.sparkSession, path)
        try:
            stored = df.sparkSession.read.schema(df.schema).parquet(path)
            rows = fresh.unionByName(stored.filter(F.col("server_id").isin(found.servers)).join(found.same, DB, "left_semi"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = fresh
        refresh(rows, path, found.servers)

    return write
