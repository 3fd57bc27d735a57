"""Column -> Column functions.  All are built-in expressions; none needs Python workers."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column, functions as F

from estatescope.functions import fixed_values as fv


def whole_div(a: Column, b: Column | int) -> Column:
    """Whole-number division that drops the fraction."""
    return F.call_function("div", a, F.lit(b))


def name_key(c: Column) -> Column:
    """Comparison form of an identifier: no case, no trailing blanks."""
    return F.lower(F.rtrim(c))


def kind_code(c: Column) -> Column:
    """Object kind as stored by us: the source pads it to two characters and mixes case."""
    return F.upper(F.rtrim(c))


def _like(c: Column, pattern: str) -> Column:
    """LIKE in a time that grows with the text only.

    Spark turns a pattern of several parts into a regular expression that tries every place of a part with every place
    of the next one.  The first place of each is as good as any, so each is looked for once, behind the one before.
    """
    first, *between, last = *pattern.split("%"), *([] if "%" in pattern else [""])
    between = [p for p in between if p]
    if not between or "\\" in pattern or len(between) == 1 and not first and not last:
        return c.like(pattern)  # one part, a prefix and a suffix, or escapes

    def part(p: str) -> str:
        return "".join("." if x == "_" else x if x.isalnum() else f"\\x{{{ord(x):x}}}" for x in p)

    found = "".join(f"(?>.*?{part(p)})" for p in between)
    return c.rlike(rf"(?s)\A{part(first)}{found}" + (rf".*{part(last)}\z" if last else ""))


def like_ci(c: Column, *patterns: str) -> Column:
    """LIKE any of the patterns, without case; NULL text stays NULL."""
    return reduce(lambda a, b: a | b, [_like(F.lower(c), p.lower()) for p in patterns])


def text_flag(c: Column, pattern: str) -> Column:
    """1 if the text matches, otherwise 0, also for NULL."""
    return F.when(like_ci(c, pattern), 1).otherwise(0)


def in_string_count(text: Column, term: Column | str) -> Column:
    """How often ``term`` occurs in ``text`` (case-insensitive, not overlapping).

    NULL for an empty term.  Trailing blanks do not count towards a length.
    """
    term = F.lower(F.lit(term) if isinstance(term, str) else term)
    text = F.lower(text)
    removed = F.length(F.rtrim(text)) - F.length(F.rtrim(F.replace(text, term, F.lit(""))))
    return whole_div(removed, F.nullif(F.length(F.rtrim(term)), F.lit(0)))


def column_count(cols: Column, included: Column) -> Column:
    """Columns of an index: key plus included.  NULL when there are no key columns at all."""
    return F.when(cols.isNotNull(), F.size(cols) + F.coalesce(F.size(included), F.lit(0)))


def is_key(column_name: Column, key_columns: Column) -> Column:
    """1 if the name is one of the key columns (compared without case), else 0."""
    lowered = F.transform(key_columns, lambda k: F.lower(k))
    return F.when(F.array_contains(lowered, F.lower(column_name)), 1).otherwise(0)


def regex_match(pattern: str, text: Column) -> Column:
    """Case-insensitive search; true, false, or NULL for NULL text and for a pattern that is none."""
    whole = "(?i)" + pattern
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(whole)
    except Py4JJavaError:
        return F.lit(None).cast("boolean")
    return text.rlike(whole)


def default_literal(type_name: Column) -> Column:
    """SQL literal for an empty value of the type; the first matching family decides."""
    t = F.lower(type_name)
    return (
        F.when(t.contains("char") | t.contains("text"), fv.EMPTY_TEXT_LITERAL)
        .when(t.startswith("decimal") | t.startswith("numeric"), fv.EMPTY_NUMBER_LITERAL)
        .when(t.startswith("varbinary"), fv.EMPTY_BINARY_LITERAL)
        .when(t.isin(fv.NUMBER_TYPES), fv.EMPTY_NUMBER_LITERAL)
        .when(t == "uniqueidentifier", fv.EMPTY_GUID_LITERAL)
        .when(t.isin(fv.DATE_TYPES), fv.EMPTY_DATE_LITERAL)
        .otherwise(fv.EMPTY_TEXT_LITERAL)
    )


def format_type(name: Column, max_length: Column, precision: Column, scale: Column) -> Column:
    """Type as text, e.g. ``varchar (20)``; lengths of the n-types are in bytes, so halved."""
    t = F.lower(name)
    wide = t.isin("nvarchar", "nchar")
    sized = wide | t.isin("varchar", "char", "varbinary")
    shown = F.when(wide, whole_div(max_length, 2)).otherwise(max_length)
    return (
        F.when(sized & (max_length == -1), F.concat(name, F.lit(" (max)")))
        .when(sized, F.concat(name, F.lit(" ("), shown.cast("string"), F.lit(")")))
        .when(
            t.isin("numeric", "decimal"),
            F.concat(name, F.lit(" ("), precision.cast("string"), F.lit(","),
                     scale.cast("string"), F.lit(")")),
        )
        .when(t.isin("timestamp", "rowversion"), F.lit("varbinary(8)"))
        .otherwise(name)
    )


def kind_description(kind: Column) -> Column:
    """Description of an object kind code; NULL if unknown."""
    pairs = [F.lit(x) for item in fv.KIND_DESCRIPTIONS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), kind_code(kind))


def int_date(c: Column) -> Column:
    """20240131 -> timestamp; NULL if it is not a date."""
    return F.try_to_timestamp(F.lpad(c.cast("string"), 8, "0"), F.lit("yyyyMMdd"))


def clock_text(c: Column) -> Column:
    """Clock time held as the number hhmmss -> ``HH:MM:SS``."""
    digits = F.lpad(c.cast("string"), 6, "0")
    return F.concat(F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2),
                    F.lit(":"), F.substring(digits, 5, 2))


def datetime_text(c: Column) -> Column:
    """Platform text of a date and time, e.g. ``Jan  5 2024  3:07PM``."""
    return F.concat(
        F.date_format(c, "MMM "), F.lpad(F.date_format(c, "d"), 2, " "),
        F.date_format(c, " yyyy "), F.lpad(F.date_format(c, "h"), 2, " "),
        F.date_format(c, ":mma"))


def major_version(version: Column) -> Column:
    return F.substring(version, 22, 4)


def thousands(c: Column) -> Column:
    """1234567 -> ``1,234,567``; NULL stays NULL."""
    return F.format_number(c, 0)


def pages_to_mb(pages: Column) -> Column:
    """Whole megabytes in a number of 8 KB pages."""
    return whole_div(pages, 128)


def bytes_to_gb(n: Column) -> Column:
    return whole_div(n, 1024 ** 3)


def percent_used(part: Column, whole: Column, scale: int) -> Column:
    """Share as a percentage, rounded *before* the factor 100; NULL when whole is 0."""
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return (share.cast(f"decimal(18,{scale})") * F.lit(100)).cast(f"decimal(18,{scale})")


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", F.date_trunc("second", start), F.date_trunc("second", end))


def split_long_text(text: Column, n: int = 4000) -> Column:
    """Array of pieces of at most ``n`` characters, cut at the last line end that fits.

    A line longer than ``n`` is itself cut every ``n`` characters.  Joining the
    pieces gives the text back, because each keeps its line end.
    """
    # One pass of the regex engine: as many whole lines as fit, else n characters.
    return F.regexp_extract_all(
        text, F.lit(r"(?s)(.{1,%d}(?:(?<=\n)|\z)|.{%d})" % (n, n)), F.lit(1))
