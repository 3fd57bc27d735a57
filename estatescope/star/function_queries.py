"""Every column function on the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from estatescope.functions import fixed_values as fv
from estatescope.functions.scalars import (
    bytes_to_gb, clock_text, column_count, datetime_text, default_literal, format_type,
    in_string_count, int_date, is_key, kind_description, major_version, pages_to_mb, percent_used,
    regex_match, seconds_between, split_long_text, text_flag, thousands,
)
from estatescope.functions.schedule import frequency_name, schedule_description, unit_name
from estatescope.sources.collectors import _SCHEDULE_CODES
from estatescope.star.bronze import Star, _pick
from estatescope.star.registry import query, read


@query("in_string_count", """
    SELECT doc_id, ((length(rtrim(text, ' ')) - length(rtrim(replace(lower(text), 'en', ''), ' '))) // 2)
      ::BIGINT AS n FROM documents""")
def in_string_count_query(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", in_string_count(F.col("text"), "EN")
                                              .alias("n"))


@query("column_count", """
    SELECT p_partkey, CASE WHEN p_size > 5 THEN len(string_split(p_name, ' '))
      + (CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) END AS n FROM part""")
def column_count_query(spark: SparkSession, d: str) -> DataFrame:
    cols = F.when(F.col("p_size") > 5, F.split("p_name", " "))
    included = F.when(F.col("p_size") % 2 == 0, F.array("p_type"))
    return read(spark, d, "part").select("p_partkey", column_count(cols, included).alias("n"))


@query("regex_match", """
    SELECT doc_id, regexp_matches(text, '(?i)TH[a-z]+ION') AS hit FROM documents""")
def regex_query(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(
        "doc_id", regex_match("TH[a-z]+ION", F.col("text")).alias("hit"))


_TYPE_NAMES = ["nvarchar", "ntext", "decimal(9,2)", "varbinary(4)", "bit", "uniqueidentifier",
               "date", "xml", "Numeric", "money"]


@query("default_literal", """
    SELECT l_orderkey, l_partkey, (CASE l_partkey % 10 WHEN 0 THEN '''''' WHEN 1 THEN ''''''
             WHEN 2 THEN '0' WHEN 3 THEN '0x' WHEN 4 THEN '0'
             WHEN 5 THEN '''00000000-0000-0000-0000-000000000000''' WHEN 6 THEN '''01/01/1999'''
             WHEN 7 THEN '''''' ELSE '0' END) AS literal FROM lineitem""")
def default_literal_query(spark: SparkSession, d: str) -> DataFrame:
    kind = _pick(_TYPE_NAMES, F.col("l_partkey") % 10)
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey",
                                             default_literal(kind).alias("literal"))


@query("schedule_description", "SELECT event_id, schedule_dscr FROM x_schedule_text")
def schedule_query(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).schedules.select(
        F.col("schedule_id").alias("event_id"),
        schedule_description(*[F.col(c) for c in _SCHEDULE_CODES]).alias("schedule_dscr"))


@query("format_type", """
    SELECT l_orderkey, l_partkey, (CASE l_partkey % 7
        WHEN 0 THEN (CASE WHEN l_quantity % 3 = 0 THEN 'varchar (max)'
          ELSE 'varchar (' || l_quantity::BIGINT || ')' END)
        WHEN 1 THEN (CASE WHEN l_quantity % 3 = 0 THEN 'nvarchar (max)'
          ELSE 'nvarchar (' || (l_quantity::BIGINT // 2) || ')' END)
        WHEN 2 THEN (CASE WHEN l_quantity % 3 = 0 THEN 'char (max)'
          ELSE 'char (' || l_quantity::BIGINT || ')' END)
        WHEN 3 THEN 'decimal (' || (l_linenumber + 9) || ',' || l_linenumber || ')'
        WHEN 4 THEN 'varbinary(8)' WHEN 5 THEN 'int' ELSE 'Numeric (' || (l_linenumber + 9) || ','
          || l_linenumber || ')' END) AS data_type FROM lineitem""")
def format_type_query(spark: SparkSession, d: str) -> DataFrame:
    name = _pick(["varchar", "nvarchar", "char", "decimal", "timestamp", "int", "Numeric"],
                 F.col("l_partkey") % 7)
    length = F.when(F.col("l_quantity") % 3 == 0, -1).otherwise(F.col("l_quantity").cast("int"))
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey",
        format_type(name, length, F.col("l_linenumber") + 9, F.col("l_linenumber"))
        .alias("data_type"))


_KIND_CODES = [*fv.KIND_DESCRIPTIONS, "ZZ"]


@query("kind_description", "SELECT doc_id, (CASE doc_id % 26 " + " ".join(
    f"WHEN {i} THEN '{text}'" for i, text in enumerate(fv.KIND_DESCRIPTIONS.values()))
    + " END) AS description FROM documents")
def kind_query(spark: SparkSession, d: str) -> DataFrame:
    code = F.rpad(F.lower(_pick(_KIND_CODES, F.col("doc_id") % 26)), 2, " ")
    return read(spark, d, "documents").select("doc_id", kind_description(code)
                                              .alias("description"))


@query("frequency_and_units", """
    SELECT event_id, CASE freq_type WHEN 1 THEN 'Once' WHEN 4 THEN 'Daily' WHEN 8 THEN 'Weekly'
             WHEN 16 THEN 'Monthly' WHEN 32 THEN 'Monthly relative' END AS frequency,
           CASE freq_type WHEN 1 THEN 'Once' WHEN 4 THEN 'Daily' WHEN 8 THEN 'Weekly'
             WHEN 16 THEN 'Monthly' WHEN 32 THEN 'Monthly relative'
             WHEN 64 THEN 'Execute when SQL Server Agent starts' END AS intended_frequency,
           CASE subday WHEN 1 THEN 'At the specified time' WHEN 2 THEN 'Seconds'
             WHEN 4 THEN 'Minutes' WHEN 8 THEN 'Hours' END AS units
    FROM x_schedule""")
def frequency_query(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("freq_type")
    return Star(spark, d).schedules.select(
        F.col("schedule_id").alias("event_id"), frequency_name(kind).alias("frequency"),
        frequency_name(kind, "intended").alias("intended_frequency"),
        unit_name(F.col("freq_subday_type")).alias("units"))


@query("encoded_dates", """
    SELECT event_id, strptime(start_date::VARCHAR, '%Y%m%d')::DATE::VARCHAR AS day,
           lpad(hh::VARCHAR, 2, '0') || ':' || lpad(mm::VARCHAR, 2, '0') || ':00' AS clock,
           strftime(ts, '%b ') || lpad(day(ts)::VARCHAR, 2, ' ') || strftime(ts, ' %Y ')
             || lpad(strftime(ts, '%-I'), 2, ' ') || strftime(ts, ':%M%p') AS created
    FROM x_schedule""")
def encoded_dates(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).schedules.select(
        F.col("schedule_id").alias("event_id"),
        F.date_format(int_date(F.col("active_start_date")), "yyyy-MM-dd").alias("day"),
        clock_text(F.col("active_start_time")).alias("clock"),
        datetime_text(F.col("date_created")).alias("created"))


@query("major_version", "SELECT doc_id, substr(text, 22, 4) AS version FROM documents")
def major_version_query(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", major_version(F.col("text"))
                                              .alias("version"))


@query("thousands", """
    SELECT o_orderkey, format('{:,}', floor(o_totalprice * 100)::BIGINT) AS shown FROM orders""")
def thousands_query(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(
        "o_orderkey", thousands(F.floor(F.col("o_totalprice") * 100).cast("long")).alias("shown"))


@query("is_key", """
    SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN 0
      WHEN 'c' || l_linenumber IN ('c1', 'c' || (l_partkey % 5)) THEN 1 ELSE 0 END AS is_key
    FROM lineitem""")
def is_key_query(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("l_linenumber")
    keys = F.when(number % 3 != 0, F.array(
        F.lit("c1"), F.concat(F.lit("C"), (F.col("l_partkey") % 5).cast("string"))))
    name = F.concat(F.lit("C"), number.cast("string"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", is_key(name, keys)
                                             .alias("is_key"))


@query("unit_conversions", """
    SELECT l_orderkey, l_partkey, (p // 128)::BIGINT AS mb, (p * 1000000) // 1073741824 AS gb,
           ((200 * q + p) // (2 * p))::DOUBLE AS percent
    FROM (SELECT l_orderkey, l_partkey, floor(l_extendedprice)::BIGINT AS p,
            floor(l_quantity)::BIGINT * 100 AS q FROM lineitem)""")
def unit_conversions(spark: SparkSession, d: str) -> DataFrame:
    price, quantity = F.col("p"), F.col("q")
    return (read(spark, d, "lineitem")
            .select("l_orderkey", "l_partkey", F.floor("l_extendedprice").cast("long").alias("p"),
                    (F.floor("l_quantity").cast("long") * 100).alias("q"))
            .select("l_orderkey", "l_partkey", pages_to_mb(price).alias("mb"),
                    bytes_to_gb(price * 1000000).alias("gb"),
                    percent_used(quantity, price, 2).cast("double").alias("percent")))


@query("day_names", """
    SELECT event_id, (CASE event_id % 7 WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday'
      WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday'
      ELSE 'Saturday' END) AS day FROM events""")
def day_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        "event_id", _pick(fv.WEEK_DAYS, F.col("event_id") % 7).alias("day"))


@query("seconds_between", """
    SELECT event_id, date_diff('second', ts, TIMESTAMP '2030-01-01') AS seconds FROM events""")
def seconds_query(spark: SparkSession, d: str) -> DataFrame:
    end = F.lit("2030-01-01").cast("timestamp")
    return read(spark, d, "events").select(
        "event_id", seconds_between(F.col("ts").cast("timestamp"), end).alias("seconds"))


@query("string_functions", """
    SELECT doc_id, coalesce(nullif(lang, 'en'), '?') AS lang, left(text, 3) AS head,
           right(text, 3) AS tail, reverse(text) AS back, length(text) AS n,
           instr(text, 'on')::INTEGER AS at, replace(source, 'src', 's') AS source,
           substr(source, 1, 1) || '-' || substr(source, 3) AS stuffed,
           (doc_id & 6)::BIGINT AS bits, CAST(doc_id AS VARCHAR) AS id_text
    FROM documents""")
def string_functions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(
        "doc_id", F.coalesce(F.nullif("lang", F.lit("en")), F.lit("?")).alias("lang"),
        F.left("text", F.lit(3)).alias("head"), F.right("text", F.lit(3)).alias("tail"),
        F.reverse("text").alias("back"), F.length("text").alias("n"),
        F.instr("text", "on").alias("at"), F.replace("source", F.lit("src"), F.lit("s"))
        .alias("source"), F.overlay("source", F.lit("-"), 2, 1).alias("stuffed"),
        F.col("doc_id").bitwiseAND(6).alias("bits"), F.col("doc_id").cast("string")
        .alias("id_text"))


@query("split_long_text", """
    SELECT doc_id, text AS joined, true AS all_fit, length(text) > 400 AS is_split,
           array_to_string(list_transform(
             regexp_extract_all(text, '(?s)(.{1,400}\\z|.{0,399}\\n|.{400})'),
             lambda p: length(p)), ',') AS cuts FROM documents""")
def split_query(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_long_text(F.col("text"), 400)
    return (Star(spark, d).table("documents").select("doc_id", pieces.alias("pieces"))
            .select("doc_id", F.array_join("pieces", "").alias("joined"),
                    F.forall("pieces", lambda p: F.length(p) <= 400).alias("all_fit"),
                    (F.size("pieces") > 1).alias("is_split"),
                    F.array_join(F.transform("pieces", F.length), ",").alias("cuts")))


@query("text_flags", """
    SELECT doc_id, CASE WHEN text ILIKE '%en%la%' THEN 1 ELSE 0 END AS first_flag,
           CASE WHEN text ILIKE '%the%ion%' THEN 1 ELSE 0 END AS second_flag FROM documents""")
def text_flags(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return Star(spark, d).table("documents").select(
        "doc_id", text_flag(text, "%en%LA%").alias("first_flag"),
        text_flag(text, "%the%ion%").alias("second_flag"))
