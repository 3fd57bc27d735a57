"""CSV files in splits, also where values hold line ends.

Whether a line end stands in a value is known from the quotes in front of it: inside quotes their number is odd.  Files are read
in splits by line; each split's parity is one bit, the parities in front of a split are added up over the splits of its
file, and in a split over its lines.  A record begins at a line with an even number of quotes in front of it.
Records that cross a border of splits are the only ones put together outside of their split.

Quotes must be used as in RFC 4180: a value with quotes is quoted, its quotes are doubled.  A file that has single quotes
in bare values has to be read as a whole (``read_snapshot(..., multi_line=True)``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from estatescope.workspace import stored, work_folder

_CHUNK = ["_file", "_start"]


def _odd(total: Column) -> Column:
    return F.coalesce(total, F.lit(0)) % 2


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the start of their split, their place in it and whether their quotes are odd."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return (spark.read.option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("_file"),
                    F.col("_metadata.file_block_start").alias("_start"),
                    F.monotonically_increasing_id().alias("_line"), (quotes % 2).alias("_quotes")))


def open_splits(lines: DataFrame) -> DataFrame:
    """Per split whether its first line (``_open``) and the first one behind it (``_open_end``) stand inside quotes."""
    chunks = lines.groupBy(*_CHUNK).agg(F.sum("_quotes").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    opened = chunks.withColumn("_open", _odd(F.sum("_n").over(before)))
    return opened.select(*_CHUNK, "_open", _odd(F.col("_open") + F.col("_n")).alias("_open_end"))


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(record): every record of the files below ``path``, line ends in values included; blank ones are left out."""
    lines = csv_lines(spark, path)
    # One row per split, written so that its size is known and the lines need not move to meet it.
    splits = stored(open_splits(lines), f"{work_folder(spark, 'csv-splits')}/splits")
    chunk = Window.partitionBy(*_CHUNK)
    so_far = chunk.orderBy("_line")
    begins = _odd(F.col("_open") + F.coalesce(
        F.sum("_quotes").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) == 0
    numbered = (lines.join(splits, _CHUNK).withColumn("_begins", begins.cast("int"))
                .withColumn("_record", F.sum("_begins").over(so_far.rowsBetween(Window.unboundedPreceding, 0))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "value"))), lambda x: x["value"]), "\n")
    parts = (numbered.groupBy(*_CHUNK, "_record").agg(joined.alias("record"), F.first("_open_end").alias("_open_end"))
             .withColumn("_last", F.max("_record").over(chunk))
             # 0 goes on from the split before; the last one goes on in the next split if that begins inside quotes.
             .withColumn("_cut", (F.col("_open_end") == 1) & (F.col("_record") == F.col("_last"))))
    whole = parts.filter("_record > 0 AND NOT _cut")
    cut = parts.filter("_record = 0 OR _cut")
    in_file = Window.partitionBy("_file").orderBy("_start", "_record")
    mended = (cut.withColumn("_group", F.sum((F.col("_record") > 0).cast("int")).over(in_file))
              .groupBy("_file", "_group")
              .agg(F.array_sort(F.collect_list(F.struct("_start", "_record", "record"))).alias("_parts"))
              .select("_file", F.col("_parts")[0]["_start"].alias("_start"), F.col("_parts")[0]["_record"].alias("_record"),
                      F.array_join(F.transform("_parts", lambda x: x["record"]), "\n").alias("record")))
    records = whole.select("_file", "_start", "_record", "record").unionByName(mended)
    if header:
        records = records.filter("NOT (_start = 0 AND _record = 1)")
    return records.select(F.regexp_replace("record", "\r$", "").alias("record")).filter("record <> ''")


def read_csv(spark: SparkSession, path: str, schema: str, reject: str) -> DataFrame:
    """The rows of CSV files with a header; a record that does not fit the schema keeps its text in ``reject``."""
    options = {"columnNameOfCorruptRecord": reject, "mode": "PERMISSIVE", "escape": '"'}
    parsed = F.from_csv("record", f"{schema}, {reject} string", options)
    return csv_records(spark, path).select(parsed.alias("_row")).select("_row.*")
