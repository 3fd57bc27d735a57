"""Column functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from estatescope.functions import (
    clock_text, column_count, datetime_text, default_literal, format_type, in_string_count, int_date,
    is_key, kind_description, like_ci, percent_used, schedule_description, split_long_text, text_flag, thousands,
    whole_div,
)


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


SCHEDULES = [
    ((8, 34, 1, 0, 0, 1, 0, 0, 90000, 0), "Every 1 week(s) on Monday, Friday at 09:00"),
    ((4, 1, 4, 5, 0, 0, 0, 0, 0, 235959),
     "Every day every 5 minute(s) between 00:00 and 23:59"),
    ((1, 0, 0, 0, 0, 0, 20240131, 0, 93005, 0), "Once on 20240131 at 9:30"),
    ((8, 0, 1, 0, 0, 2, 0, 0, 230100, 0), "Every 2 week(s) on at 23:01"),
    ((8, 127, 2, 10, 0, 1, 0, 0, 80000, 90000),
     "Every 1 week(s) on Sunday, Monday, Tuesday, Wednesday, Thursday, Friday, Saturday "
     "every 10 second(s) between 08:00 and 09:00"),
    ((16, 15, 8, 2, 0, 3, 0, 0, 0, 120000),
     "Every 3 months(s) on day 15 of that month every 2 hour(s) between 00:00 and 12:00"),
    ((32, 2, 1, 0, 4, 1, 0, 0, 100, 0),
     "Every 1 months(s) on the third Monday of that month at 00:01"),
    ((32, 10, 1, 0, 16, 1, 0, 0, 0, 0),
     "Every 1 months(s) on the last weekend day of that month at 00:00"),
    ((32, 11, 1, 0, 16, 1, 0, 0, 0, 0), None),
    ((64, 0, 0, 0, 0, 0, 0, 0, 0, 0), "When the agent starts"),
    ((128, 0, 0, 0, 0, 0, 0, 0, 0, 0), "When the processors are idle"),
    ((2, 1, 1, 0, 0, 0, 0, 0, 0, 0), None),
    ((4, 1, 16, 0, 0, 0, 0, 0, 0, 0), None),
    ((None, 1, 1, 0, 0, 0, 0, 0, 0, 0), None),
]


def test_schedule_description(spark):
    names = [f"c{i}" for i in range(10)]
    got = values(spark, [s for s, _ in SCHEDULES], ", ".join(f"{n} int" for n in names),
                 schedule_description(*map(F.col, names)))
    assert got == [text for _, text in SCHEDULES]


@pytest.mark.parametrize("name, literal", [
    ("nvarchar", "''"), ("ntext", "''"), ("decimal(9,2)", "0"), ("varbinary(4)", "0x"),
    ("bit", "0"), ("uniqueidentifier", "'00000000-0000-0000-0000-000000000000'"),
    ("date", "'01/01/1999'"), ("xml", "''"), ("BIGINT", "0")])
def test_default_literal(spark, name, literal):
    assert values(spark, [(name,)], "t string", default_literal(F.col("t"))) == [literal]


def test_format_type(spark):
    rows = [("varchar", -1, 0, 0), ("nvarchar", 40, 0, 0), ("char", 10, 0, 0),
            ("decimal", 9, 18, 2), ("timestamp", 8, 0, 0), ("int", 4, 10, 0)]
    got = values(spark, rows, "n string, l int, p int, s int",
                 format_type(*map(F.col, "nlps")))
    assert got == ["varchar (max)", "nvarchar (20)", "char (10)", "decimal (18,2)",
                   "varbinary(8)", "int"]


def test_counts_and_keys(spark):
    assert values(spark, [("aXaxa", "a"), ("aaa", "aa"), ("x", ""), (None, "a"), ("ab  ", "b")],
                  "s string, t string", in_string_count(F.col("s"), F.col("t"))) == [
        3, 1, None, None, 1]
    keys = F.array(F.lit("Id"), F.lit("Id2"))
    assert values(spark, [("Id",), ("ID2",), ("d2",)], "c string", is_key(F.col("c"), keys)) == [
        1, 1, 0]
    none = F.lit(None).cast("array<string>")
    assert values(spark, [("x",)], "c string", is_key(F.col("c"), none)) == [0]
    assert values(spark, [(["a", "b"], ["c"]), (["a"], None), (None, ["c"])],
                  "k array<string>, i array<string>",
                  column_count(F.col("k"), F.col("i"))) == [3, 1, None]


def test_numbers_and_dates(spark):
    assert values(spark, [(-7, 2), (7, 2)], "a int, b int",
                  whole_div(F.col("a"), F.col("b"))) == [-3, 3]
    assert [str(v) for v in values(spark, [(1, 3), (1, 0)], "a long, b long",
                                   percent_used(F.col("a"), F.col("b"), 2))] == ["33.00", "None"]
    assert values(spark, [(1234567,), (None,)], "a long", thousands(F.col("a"))) == [
        "1,234,567", None]
    assert values(spark, [(93005,), (None,)], "a int", clock_text(F.col("a"))) == [
        "09:30:05", None]
    assert [str(v) for v in values(spark, [(20240131,), (0,), (20241399,)], "a int",
                                   int_date(F.col("a")))] == [
        "2024-01-31 00:00:00", "None", "None"]
    assert values(spark, [("2024-01-05 15:07:00",)], "t string",
                  datetime_text(F.col("t").cast("timestamp"))) == ["Jan  5 2024  3:07PM"]
    assert values(spark, [("fn",), ("F ",), ("??",)], "k string",
                  kind_description(F.col("k"))) == [
        "Scalar function", "FOREIGN KEY constraint", None]


def brute_force_pieces(text, n):
    pieces = []
    while text:
        if len(text) <= n:
            cut = len(text)
        else:
            cut = text[:n].rfind("\n") + 1 or n
        pieces.append(text[:cut])
        text = text[cut:]
    return pieces


@pytest.mark.parametrize("text", [
    "short", "a\n" * 50, "x" * 95, "one\n" + "y" * 60 + "\nlast line\n", "é😀\n" * 30, ""])
def test_split_long_text(spark, text):
    got = values(spark, [(text,)], "t string", split_long_text(F.col("t"), 20))[0]
    assert got == brute_force_pieces(text, 20)


PATTERNS = ["%for xml%", "%declare%cursor%", "a%b%", "%a%b", "a%b%c", "a%b", "%a_c%b%", "%a.c%(b)%", "%%a%%b%%", "a\\%%b%c%", "", "%",
            "%\u00e9%[x]%", "ab%b%", "%ab%b"]
LIKE_TEXTS = ["", "ab", "abb", "aXb", "declare c\ncursor for", "for  xml", "FOR XML", "a\nb\nc", "abc", "axcb", "a.c(b)", "cba", "a%bc", "bab",
              "\u00c9 [X]", "x\U0001f600abb"]


def test_like_with_several_parts_is_like(spark):
    rows = spark.createDataFrame([(t,) for t in [*LIKE_TEXTS, None]], "t string").select(
        "t", *[like_ci(F.col("t"), p).alias(f"got{i}") for i, p in enumerate(PATTERNS)],
        *[F.lower("t").like(p).alias(f"want{i}") for i, p in enumerate(PATTERNS)]).collect()
    for r in rows:
        assert [r[f"got{i}"] for i in range(len(PATTERNS))] == [r[f"want{i}"] for i in range(len(PATTERNS))], r.t


def test_like_does_not_try_every_pair_of_places(spark):
    import time
    text = F.repeat(F.lit("en the "), 3_000)
    started = time.time()
    assert values(spark, [(1,)], "n int", text_flag(F.concat(text, F.col("n").cast("string")), "%EN%the%ion%")) == [0]
    assert time.time() - started < 30
