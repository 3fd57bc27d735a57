"""Compatibility rules.

Routine rules are flags on the objects view and column rules flags on the columns
view: each is computed in one pass over the text or the columns, and a rule's table is a
filter on its flag.  The two reference rules look for names in the text.  Tables of routines carry the key of the
text; ``with_texts`` attaches it last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from estatescope.functions import fixed_values as fv
from estatescope.functions.scalars import kind_description, like_ci, name_key, text_flag
from estatescope.operators.aggregates import flag
from estatescope.operators.joins import left_lookup
from estatescope.operators.matching import SUFFIXES, all_matches
from estatescope.sources.texts import KEY, TEXT

DB = ["server_id", "database_id"]
NAMED = [*DB, "schema_key", "object_key"]

_ROUTINE = [*DB, "database_name", "xtype", "schema_name", "object_name", KEY]
_COLUMN = [*DB, "database_name", "table_schema", "table_catalog", "table_name", "column_name",
           "ordinal_position", "is_nullable", "collation_name", "character_maximum_length",
           "data_type"]


_FOUND_IN = [*NAMED, "database_name", "xtype", "schema_name", "object_name"]


def reference_hits(objects_view: DataFrame, texts: DataFrame, linked_servers: DataFrame,
                   databases: DataFrame, mode: str = "reference",
                   suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Routines (with the key of their text) and the linked servers and databases their text names.

    Both kinds of names are searched in one pass over the different texts, each of them once for all servers; a
    routine is then given the names of its own server among those that its text holds.  ``reference`` keeps
    one name per routine and kind (the first) and then drops it if it is the routine's own database;
    ``intended`` keeps every name but that.
    """
    names = linked_servers.select(
        "server_id", F.lit("server").alias("refers_to"), F.col("linked_server").alias("name")
    ).unionByName(databases.select(
        "server_id", F.lit("database").alias("refers_to"), F.col("database_name").alias("name")))
    names = (names.groupBy("server_id", "refers_to", name_key(F.col("name")).alias("_name"))
             .agg(F.min("name").alias("name")))
    held = all_matches(texts, names.select("_name").distinct(), [KEY], TEXT, "_name", suffixes)
    hits = (objects_view.filter(F.col(KEY).isNotNull()).select(*_FOUND_IN, KEY)
            .join(held, KEY).join(names, ["server_id", "_name"]).drop("_name"))
    if mode == "reference":
        hits = hits.groupBy(*_FOUND_IN, KEY, "refers_to").agg(F.min("name").alias("name"))
    own = ((F.col("refers_to") == "database")
           & (name_key(F.col("name")) == name_key(F.col("database_name"))))
    return hits.filter(~own)


def cross_server_hits(hits: DataFrame) -> DataFrame:
    return (hits.filter(F.col("refers_to") == "server").drop("refers_to")
            .withColumnRenamed("name", "linked_server"))


def cross_database_hits(hits: DataFrame) -> DataFrame:
    return (hits.filter(F.col("refers_to") == "database").drop("refers_to")
            .withColumnRenamed("name", "x_database_name"))


def routine_findings(objects_view: DataFrame, texts: DataFrame, xml_pattern: str = fv.FOR_XML_PATTERN,
                     cursor_pattern: str = fv.CURSOR_PATTERN) -> DataFrame:
    """Every object with its three text and kind flags; the patterns are those of LIKE, without case.

    Each different text is tested once; only the keys of those that match come to the objects."""
    flags = {"uses_for_xml": xml_pattern, "uses_cursor": cursor_pattern}
    matching = (texts.select(KEY, *[text_flag(F.col(TEXT), p).alias(n) for n, p in flags.items()])
                .filter(" + ".join(flags) + " > 0"))
    found = left_lookup(objects_view, matching, [KEY], F.col(KEY).isNotNull(), NAMED)
    return found.select(
        *NAMED, *_ROUTINE[2:], kind_description(F.col("xtype")).alias("type_desc"),
        "sql_data_access", *[F.coalesce(n, F.lit(0)).alias(n) for n in flags],
        F.when(F.col("xtype").isin(fv.INCOMPATIBLE_KINDS), 1).otherwise(0)
        .alias("incompatible_type"))


def incompatible_routine_types(findings: DataFrame) -> DataFrame:
    """Objects with a text whose kind has no counterpart."""
    return (findings.filter((F.col("incompatible_type") == 1)
                            & F.col(KEY).isNotNull())
            .select(*_ROUTINE, "type_desc"))


def incompatible_routines(findings: DataFrame) -> DataFrame:
    """Routines whose text uses an unsupported construct."""
    return (findings.filter((F.col("uses_for_xml") == 1) | (F.col("uses_cursor") == 1))
            .select(*_ROUTINE, "uses_for_xml", "uses_cursor", "incompatible_type"))


def _column_flags(mode: str) -> dict[str, Column]:
    kind = F.lower("data_type")
    computed = F.coalesce("is_computed", F.lit(False))
    if mode == "reference":
        large = kind.isin(fv.LARGE_TEXT_TYPES)
    else:
        large = kind.isin(fv.LARGE_TEXT_TYPES_INTENDED)
    flags = {
        "incompatible_column": kind.isin(fv.INCOMPATIBLE_TYPES),
        "computed_column": computed,
        "large_text_column": large | computed,
        "invalid_default": like_ci(F.col("column_default"), fv.CALL_DEFAULT_PATTERN),
    }
    return {n: flag(c) for n, c in flags.items()}


def column_findings(columns_view: DataFrame, mode: str = "reference") -> DataFrame:
    """Every column with its four flags."""
    return columns_view.select(
        *_COLUMN, F.col("row_count").alias("table_row_count"), "column_default",
        *[c.alias(n) for n, c in _column_flags(mode).items()])


def column_counts(columns: DataFrame, objects_view: DataFrame, mode: str = "reference") -> DataFrame:
    """Every object that has columns with the sums of its columns' four flags.

    These are the findings by object; columns are added up under their object's name before that is looked up, so that
    the join moves and sorts objects, not columns.  Objects of one name count the columns of it once each."""
    counted = columns.groupBy(*NAMED).agg(*[F.sum(c).alias(n) for n, c in _column_flags(mode).items()])
    return objects_view.select(*NAMED).join(counted, NAMED)


def _columns_where(findings: DataFrame, flag: str) -> DataFrame:
    return findings.filter(F.col(flag) == 1).select(*_COLUMN, "table_row_count")


def incompatible_columns(findings: DataFrame) -> DataFrame:
    return _columns_where(findings, "incompatible_column")


def computed_columns(findings: DataFrame) -> DataFrame:
    return _columns_where(findings, "computed_column")


def large_text_columns(findings: DataFrame) -> DataFrame:
    return _columns_where(findings, "large_text_column")


def invalid_defaults(findings: DataFrame) -> DataFrame:
    return (findings.filter(F.col("invalid_default") == 1)
            .select(*[c for c in _COLUMN if c not in ("collation_name",
                                                      "character_maximum_length")],
                    "column_default"))
