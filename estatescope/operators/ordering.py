"""Sorted results with large columns: the order is found from the small ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def order_then_attach(df: DataFrame, order: Sequence[Column | str],
                      attach: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` in order, with what ``attach`` adds to its rows.

    The sort moves only the columns of ``df``.  Each row then knows its part and its place in it, ``attach`` may
    join it to anything, and one direct exchange by part, without sampling, brings the finished rows into place.
    """
    # A sort has at most as many parts as shuffles have partitions.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.orderBy(*order).withColumns({
        "_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    return (attach(placed).repartitionById(parts, F.col("_part"))
            .sortWithinPartitions("_place").drop("_part", "_place"))
