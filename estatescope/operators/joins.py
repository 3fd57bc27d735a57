"""Join shapes.  No side is ever hinted: Spark broadcasts a side whose size, by its files or once
measured, is below its threshold, and splits skewed partitions otherwise.  Everything that can shrink a side
(filter, aggregate, top-1) happens before the join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def rollup_left(left: DataFrame, right: DataFrame, on: Sequence[str], **aggs: Column) -> DataFrame:
    """Every left row with aggregates of its right rows (NULL where there are none).

    The right side is aggregated first, with map-side partial sums, so the join
    meets at most one right row per key and a hot key costs one row per task.
    """
    totals = right.groupBy(*on).agg(*[c.alias(name) for name, c in aggs.items()])
    return left.join(totals, list(on), "left")


def rollup_union(left: DataFrame, on: Sequence[str], *inputs: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """Every left row with sums over the rows of several inputs (NULL where an input has no rows).

    Each input is a DataFrame and its measures: a value per row, whose sum is wanted.  All inputs are rows of one
    union and one aggregate, summed up in the task that reads them, so the rows of any number of inputs
    move once, one per key and task, where a rollup and a join for each would move every key once per input.
    """
    rows = [df.select(*on, *[value.alias(name) for name, value in values.items()]) for df, values in inputs]
    names = [name for _, values in inputs for name in values]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return left.join(every.groupBy(*on).agg(*[F.sum(n).alias(n) for n in names]), list(on), "left")


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column],
                    n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group.  ``order`` must be total for a stable result.

    Spark limits each group inside every map task before the shuffle, so a hot
    group sends at most ``n`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def left_first(left: DataFrame, right: DataFrame, on: Sequence[str],
               order: Sequence[Column]) -> DataFrame:
    """Left join to the first right row of each key."""
    return left.join(first_per_group(right, on, order), list(on), "left")


def left_lookup(left: DataFrame, right: DataFrame, on: Sequence[str], present: Column,
                scatter_by: Sequence[str]) -> DataFrame:
    """Left join to one row per key, where many left rows have no key at all.

    Rows for which ``present`` does not hold cannot match.  They would all share one key
    (NULL or a placeholder) and meet in one task, so they are scattered by ``scatter_by``.
    """
    nowhere = F.pmod(F.xxhash64(*scatter_by), F.lit(1_000_003)) + 1
    keyed = left.withColumn("_scatter", F.when(present, F.lit(0)).otherwise(nowhere))
    return (keyed.join(right.withColumn("_scatter", F.lit(0).cast("long")),
                       [*on, "_scatter"], "left").drop("_scatter"))


def left_where(left: DataFrame, right: DataFrame, on: Sequence[str], condition: Column) -> DataFrame:
    """Left join with an extra condition on the right side, applied before the join."""
    return left.join(right.filter(condition), list(on), "left")


def disjunctive_join(left: DataFrame, right: DataFrame, right_kind: Column, right_key: Column,
                     left_keys: dict[str, str], same: Sequence[str] = (),
                     how: str = "left") -> DataFrame:
    """Join on one of several left columns; which one, the right row's kind says.

    ``left_keys`` maps each kind to the left column it refers to; ``same`` names
    columns that must be equal as well.  The OR becomes an equi-join on
    (column, key): a left row is repeated once per column that some kind refers to, a right row
    has one pair.  Keys keep their type where all have the same one.
    """
    targets = list(dict.fromkeys(left_keys.values()))
    types = {left.schema[c].dataType.simpleString() for c in targets}
    types |= {right.select(right_key.alias("k")).schema["k"].dataType.simpleString()}
    kept = types.pop() if len(types) == 1 else "string"

    def keyed(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(i).alias("_kind"), F.col(c).cast(kept).alias("_key"))
                          for i, c in enumerate(targets)])
        return df.select("*", F.inline(pairs))

    kind = F.lit(None).cast("int")
    for value, column in left_keys.items():
        kind = F.when(right_kind.cast("string") == value, F.lit(targets.index(column))).otherwise(kind)
    build = right.select("*", kind.alias("_kind"), right_key.cast(kept).alias("_key"))
    on = [*same, "_kind", "_key"]
    if how == "inner":
        return keyed(left).join(build, on).drop("_kind", "_key")
    if how != "left":
        raise ValueError("how must be 'inner' or 'left'")
    # Find the partners of each distinct key set, then attach them, so that a left row
    # without any partner stays exactly once.
    columns = [*same, *dict.fromkeys(left_keys.values())]
    partners = (keyed(left.select(*columns).distinct()).join(build, on).drop("_kind", "_key")
                .withColumnsRenamed({c: f"_p_{c}" for c in columns}))
    matched = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in columns]
    return left.join(partners, matched, "left").drop(*[f"_p_{c}" for c in columns])


def update_from(target: DataFrame, source: DataFrame, on: Sequence[str],
                columns: Sequence[str]) -> DataFrame:
    """Rows of ``target`` with ``columns`` taken from the matching source row.

    A matched row takes the source values even where they are NULL; others keep theirs.
    ``source`` must hold one row per key.
    """
    fresh = source.select(*on, F.lit(True).alias("_matched"),
                          *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(fresh, list(on), "left")
    replaced = {c: F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(
        F.col(c) if c in target.columns else F.lit(None)) for c in columns}
    order = [*target.columns, *[c for c in columns if c not in target.columns]]
    return joined.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in order])


def not_loaded(df: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not among ``done`` (NULL keys in ``done`` are ignored)."""
    return df.join(done.select(*on).dropna(), list(on), "left_anti")
