"""Snapshot reader: one directory per catalog view."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from estatescope.sources.csv_records import read_csv
from estatescope.sources.schemas import BRONZE
from estatescope.workspace import removed

FORMATS = ("parquet", "orc", "csv", "json")
REJECT = "_rejected"


def read_snapshot(spark: SparkSession, path: str, name: str, fmt: str = "parquet",
                  multi_line: bool | None = None) -> DataFrame:
    """The snapshot table ``name`` below ``path``, with its declared schema.

    Values of CSV files may hold line ends, and the files are read in splits all the same (``csv_records.py``, which
    looks through the files once before).  ``multi_line=True`` reads each file in one task, for files that do
    not double their quotes; ``False`` reads splits without that look, for files that hold no line ends in values.

    In CSV and JSON, rows that do not fit the schema keep their raw text in
    ``_rejected`` (see :func:`split_rejected`) instead of failing the job.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    schema, folder = BRONZE[name], f"{path.rstrip('/')}/{name}"
    if fmt == "csv" and multi_line is None:
        return read_csv(spark, folder, schema, REJECT)
    reader = spark.read
    if fmt in ("csv", "json"):
        schema += f", {REJECT} string"
        reader = reader.option("columnNameOfCorruptRecord", REJECT).option("mode", "PERMISSIVE")
    if fmt == "csv":
        reader = reader.option("header", "true").option("multiLine", multi_line).option("escape", '"')
    return reader.schema(schema).format(fmt).load(folder)


def read_all(spark: SparkSession, path: str, fmt: str = "parquet",
             missing: list[str] | None = None) -> dict[str, DataFrame]:
    """All snapshot tables, keyed by name; of CSV the borders of records are looked up, else nothing is read yet.

    A view without a directory has no rows: older server generations lack some.  Their names
    are added to ``missing``.
    """
    tables = {}
    for name in BRONZE:
        try:
            tables[name] = read_snapshot(spark, path, name, fmt)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            tables[name] = spark.createDataFrame([], BRONZE[name])
            if missing is not None:
                missing.append(name)
    return tables


def split_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected texts) of a CSV or JSON snapshot.

    Rejected are rows that did not parse and rows that do not say which server they
    are from.
    """
    data, bad = [c for c in df.columns if c != REJECT], _is_bad(df)
    return df.filter(~bad).select(*data), df.filter(bad).select(_raw(data).alias(REJECT))


def _is_bad(df: DataFrame) -> Column:
    unknown = F.col("server_id").isNull() if "server_id" in df.columns else F.lit(False)
    return F.col(REJECT).isNotNull() | unknown


def _raw(data: list[str]) -> Column:
    return F.coalesce(REJECT, F.to_json(F.struct(*data)))


def land(spark: SparkSession, path: str, fmt: str, out: str, missing: list[str] | None = None,
         ) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """All snapshot tables without the rows that do not fit, and how many of those each table had.

    CSV and JSON are parsed once: each table is written below ``<out>/landed`` and read from there.  The rows that
    do not fit are counted while it is written and kept below ``<out>/rejected``, one folder per table, as they came.
    Parquet and ORC have no such rows and are read where they are.
    """
    tables, rejected = read_all(spark, path, fmt, missing), {}
    if fmt not in ("csv", "json"):
        return tables, rejected
    for name, df in tables.items():
        if REJECT not in df.columns:  # no folder
            continue
        at, seen = f"{out}/landed/{name}", Observation()
        data = [c for c in df.columns if c != REJECT]
        bad = _is_bad(df)
        rows = df.select(*data, F.when(bad, _raw(data)).alias(REJECT), bad.cast("int").alias("_bad")).observe(
            seen, F.sum("_bad").alias("rejected"))
        rows.write.mode("overwrite").partitionBy("_bad").parquet(at)
        stored = spark.read.schema(f"{BRONZE[name]}, {REJECT} string, _bad int").parquet(at)
        tables[name] = stored.filter("_bad = 0").select(*data)
        rejected[name] = seen.get["rejected"] or 0
        if rejected[name]:
            stored.filter("_bad = 1").select(REJECT).write.mode("overwrite").parquet(f"{out}/rejected/{name}")
        else:
            removed(spark, f"{out}/rejected/{name}")
    return tables, {name: n for name, n in rejected.items() if n}


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Cast to a declared schema by name; absent columns become NULL, bad values NULL too."""
    schema = StructType.fromDDL(ddl)
    present = {c.lower() for c in df.columns}
    return df.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name.lower() in present
         else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields])
