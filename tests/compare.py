"""Compare the registered queries with their SQL in DuckDB, row for row."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else a short account of the difference."""
    result = con.execute(sql)
    names, want = bag([c[0] for c in result.description], result.fetchall())
    got_names, got = bag(spark_df.columns, spark_df.collect())
    if names != got_names:
        return f"columns {got_names} instead of {names}"
    if got != want:
        return (f"{sum(got.values())} rows instead of {sum(want.values())}; "
                f"extra {list((got - want).items())[:2]} missing {list((want - got).items())[:2]}")
    return None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from estatescope import build_session

    path, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("COMPARE_MEMORY", "8g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(path), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, path)
            if name in sql:
                text = difference(df, con, sql[name])
            else:
                text = f"(no SQL) {len(df.collect())} rows"
        except Exception as error:
            text = f"{type(error).__name__}: {str(error)[:600]}"
        bad += text is not None and not text.startswith("(no SQL)")
        print(f"{name:34} {time.time() - start:6.2f}s {'ok' if text is None else text[:900]}",
              flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
