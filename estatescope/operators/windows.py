"""Shares of a total and top-N lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from estatescope.operators.joins import first_per_group


def share_of_total(df: DataFrame, by: Sequence[str], **shares: tuple[Column, Column]) -> DataFrame:
    """Add ``100 * part / sum(whole)`` per group for each ``name=(part, whole)``.

    Totals are aggregated and joined back rather than computed by an unordered
    window, which would move a whole group into one task.  Division by a zero total gives NULL.
    """
    totals = df.groupBy(*by).agg(
        *[F.sum(whole).alias(f"_total_{name}") for name, (_, whole) in shares.items()])
    joined = df.join(totals, list(by))
    out = joined.select(
        *df.columns,
        *[F.try_divide(F.lit(100.0) * part, F.col(f"_total_{name}").cast("double")).alias(name)
          for name, (part, _) in shares.items()])
    return out


def top_n_per_group(df: DataFrame, by: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows per group; give a tie-break as the last order column."""
    return first_per_group(df, by, order, n)
