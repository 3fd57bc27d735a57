"""Texts by content: every different text is stored once, under a 128-bit key of it.

Objects, findings and rules carry the key.  A search or a flag reads each different text once, however many objects have it,
and the text itself is attached last, so no join, aggregate or sort before that moves one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from estatescope.operators.joins import left_lookup

KEY, TEXT = "text_key", "routine_definition"


def text_key(text: Column) -> Column:
    """16 bytes; NULL for NULL."""
    return F.unhex(F.md5(text))


def text_store(*columns: tuple[DataFrame, str]) -> DataFrame:
    """(text_key, routine_definition): the different texts of some columns.

    Copies meet in the task that reads them before anything moves."""
    rows = reduce(DataFrame.unionByName, [df.select(F.col(c).cast("string").alias(TEXT)) for df, c in columns])
    return (rows.filter(F.col(TEXT).isNotNull()).select(text_key(F.col(TEXT)).alias(KEY), TEXT)
            .groupBy(KEY).agg(F.first(TEXT).alias(TEXT)))


def load_texts(b: dict[str, DataFrame]) -> DataFrame:
    """The store of all routine, view, check and foreign-key texts of a snapshot."""
    return text_store((b["routines"], "definition"), (b["views"], "definition"),
                      (b["check_constraints"], "definition"),
                      (b["foreign_keys"], "delete_referential_action_desc"))


def with_texts(df: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows with their text in place of its key; rows without a key (most objects have no text) are scattered."""
    others = [c for c in df.columns if c != KEY]
    return left_lookup(df, texts, [KEY], F.col(KEY).isNotNull(), others[:4]).select(*others, TEXT)
