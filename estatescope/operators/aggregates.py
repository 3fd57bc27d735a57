"""Aggregations.  All combine on the map side first; only one row per group and task is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from estatescope.functions.fixed_values import SIZE_LIMITS


def flag(condition: Column) -> Column:
    """1 for a row that satisfies the condition, else 0: what a count of such rows adds up."""
    return F.when(condition, 1).otherwise(0)


def count_if(condition: Column) -> Column:
    """Rows that satisfy the condition; NULL (not 0) when there are no rows at all."""
    return F.sum(flag(condition))


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


def row_count() -> Column:
    """Number of rows; NULL after a left join to nothing."""
    return F.sum(F.lit(1))


def size_classes(rows: Column, among: Column | None = None,
                 limits: tuple[int, int, int] = SIZE_LIMITS) -> dict[str, Column]:
    """Flags of Empty, Small, Medium, Large and VeryLarge rows.

    Empty is NULL or 0; each class ends at its limit, inclusive.
    """
    small, medium, large = limits
    among = F.lit(True) if among is None else among
    return {
        "empty": flag(among & (F.coalesce(rows, F.lit(0)) == 0)),
        "small": flag(among & rows.between(1, small)),
        "medium": flag(among & rows.between(small + 1, medium)),
        "large": flag(among & rows.between(medium + 1, large)),
        "very_large": flag(among & (rows > large)),
    }


def size_buckets(rows: Column, among: Column | None = None,
                 limits: tuple[int, int, int] = SIZE_LIMITS) -> dict[str, Column]:
    """The counts of the size classes as aggregate columns."""
    return {name: F.sum(value) for name, value in size_classes(rows, among, limits).items()}


def ordered_names(order: Column, name: Column, when: Column | None = None) -> Column:
    """Aggregate: array of names by (order, name); NULL if there are none.

    For lists whose length the model bounds, such as the columns of one index.
    """
    item = F.struct(order.alias("at"), name.alias("name"))
    item = item if when is None else F.when(when, item)
    names = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["name"])
    return F.when(F.count(item) > 0, names)


def distinct_names(df: DataFrame, by: Sequence[str], name: str, count: str, listed: str) -> DataFrame:
    """Per group: number of rows and the distinct names, comma-joined in order.

    Two steps: rows are first counted per (group, name), so what reaches the
    group is one row per name however many rows it has.
    """
    per_name = df.groupBy(*by, name).agg(F.count(F.lit(1)).alias("_n"))
    return per_name.groupBy(*by).agg(
        F.sum("_n").alias(count),
        F.array_join(F.sort_array(F.collect_list(name)), ",").alias(listed))


def sequence_gap(sequences: DataFrame, values: DataFrame, on: Sequence[str],
                 current: str, value: str) -> DataFrame:
    """Largest existing value, next one in use above the current, and the gap to it.

    ``sequences`` holds one row per key.  Values are reduced in one pass.  The
    current value rides along with each value through the join, so that both
    extremes come from the same aggregate.
    """
    totals = (values.join(sequences.select(*on, F.col(current).alias("_current")), list(on))
              .groupBy(*on)
              .agg(F.max(value).alias("max_existing"),
                   F.min(F.when(F.col(value) > F.col("_current"), F.col(value)))
                   .alias("next_in_use")))
    behind = F.when(F.col(current) < F.col("max_existing"), 1).otherwise(0)
    return (sequences.join(totals, list(on), "left")
            .withColumn("is_max", behind)
            .withColumn("is_behind", behind == 1)
            .withColumn("gap", F.col("next_in_use") - F.col(current)))
