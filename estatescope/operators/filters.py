"""Row filters and column projections shared by the collectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from estatescope.functions.fixed_values import SYSTEM_DATABASES
from estatescope.functions.scalars import like_ci


def any_like(c: Column, patterns: Sequence[str]) -> Column:
    return like_ci(c, *patterns)


def eligible_databases(databases: DataFrame, exclude: Sequence[str] = SYSTEM_DATABASES,
                       skip_warehouse: bool = True) -> DataFrame:
    """Databases worth reading: online, with this server as primary, not excluded by name."""
    home = F.coalesce(F.col("primary_replica"), F.col("server_name"))
    keep = (F.lower("state_desc") == "online") & (F.lower("server_name") == F.lower(home))
    if exclude:
        keep = keep & ~F.lower("database_name").isin([e.lower() for e in exclude])
    if skip_warehouse:
        keep = keep & (F.lower(F.coalesce("edition", F.lit(""))) != "datawarehouse")
    return databases.filter(keep)


def union_versions(*frames: DataFrame) -> DataFrame:
    """Rows of snapshots taken from different versions; columns one lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def only_for(column: Column, family: Column, families: Sequence[str]) -> Column:
    """The value where the row's version family has such a field, otherwise NULL."""
    return F.when(family.isin(list(families)), column)


def with_extras(df: DataFrame, extras: DataFrame, on: Sequence[str]) -> DataFrame:
    """All columns of ``df`` plus those of ``extras`` it does not have yet (inner join)."""
    new = [c for c in extras.columns if c not in df.columns]
    return df.join(extras.select(*on, *new), list(on))


def rows_not_in(c: Column, values: Sequence[str]) -> Column:
    """NOT IN a list, without case; NULL is not kept, as in SQL."""
    return ~F.upper(c).isin([v.upper() for v in values])
