"""Gold views: inventory tables with names and rollups.

``s`` is the dictionary of silver tables.  Every rollup aggregates its table once per
key before the join, and the rollups of one view share their key, so they need one exchange per
table and none between the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from estatescope.functions import fixed_values as fv
from estatescope.functions.scalars import (
    column_count, is_key, like_ci, major_version, name_key, thousands,
)
from estatescope.operators.aggregates import count_if, flag, row_count, size_classes
from estatescope.operators.filters import with_extras
from estatescope.operators.joins import left_first, left_where, rollup_left, rollup_union

DB = ["server_id", "database_id"]
NAMED = [*DB, "schema_key", "object_key"]
Tables = dict[str, DataFrame]


def _names(s: Tables) -> DataFrame:
    """Server and database names by id."""
    return (s["databases"].select(*DB, "database_name")
            .join(s["servers"].select("server_id", "server_name"), "server_id"))


def not_system(name: Column | str = "database_name") -> Column:
    return ~F.lower(name).isin(fv.SYSTEM_DATABASES)


def _index_measures(mode: str) -> dict[str, Column]:
    """What the rows of the index table add up to."""
    stored = "%column store%" if mode == "reference" else "%columnstore%"
    empty = F.array().cast("array<string>")
    return {
        "indexes": F.lit(1),
        "index_data_size": F.col("data_size"),
        "index_used_size": F.col("used_size"),
        "unique_indexes": flag(F.coalesce("is_unique", F.lit(False))),
        "included_column_indexes": flag(F.size(F.coalesce("included", empty)) > 0),
        "filtered_indexes": flag(F.coalesce("filter_definition", F.lit("")) != ""),
        "column_stores": flag(
            like_ci(F.coalesce("data_compression_desc", F.lit("")), stored)),
    }


def index_usage_view(s: Tables) -> DataFrame:
    """Indexes (in-row data only) with names, row count of the object, and column count."""
    rows = s["objects"].select(*NAMED, "row_count")
    iu = s["index_usage"].filter(F.col("allocation_desc") == "IN_ROW_DATA")
    return (with_extras(iu, _names(s), DB)
            .join(rows, NAMED, "left")
            .withColumn("col_count", column_count(F.col("cols"), F.col("included"))))


def databases_view(s: Tables, mode: str = "reference") -> DataFrame:
    """Databases with file, object, column and index rollups; sums are NULL where nothing exists.

    The four rollups are one union and one aggregate; only files are first added up per filegroup, to count these."""
    is_table = F.col("xtype") == "U"
    data_file = F.col("filegroup_name").isNotNull()
    groups = s["database_files"].groupBy(*DB, "filegroup_name").agg(
        F.count(F.lit(1)).alias("_files"), F.sum("total_mbs").alias("_mbs"))
    own = s["linked_servers"].filter(
        name_key(F.col("linked_server")) == name_key(F.col("server_name"))).select(
        "server_id", "datasource", "location")
    base = (s["servers"].select("server_id", "server_name")
            .join(s["databases"].drop("data_mb", "log_mb"), "server_id")
            .join(own, "server_id", "left"))
    df = rollup_union(
        base, DB,
        (groups, {"files": F.col("_files"), "file_groups": flag(data_file),
                  "data_mb": F.when(data_file, F.col("_mbs")).otherwise(0),
                  "log_mb": F.when(~data_file, F.col("_mbs")).otherwise(0)}),
        (s["objects"], {"rows": F.col("row_count"), "tables": flag(is_table),
                        **size_classes(F.col("row_count"), is_table),
                        "views": flag(F.col("xtype") == "V"), "procs": flag(F.col("xtype") == "P"),
                        "functions": flag(F.col("xtype").isin("TF", "FN"))}),
        (s["columns"], {"columns": F.lit(1)}),
        (s["index_usage"], _index_measures(mode)))
    return df.withColumn("data_mb_s", thousands(F.col("data_mb")))


def database_files_view(s: Tables) -> DataFrame:
    return with_extras(s["database_files"], _names(s), DB)


def database_objects_view(s: Tables, mode: str = "reference",
                          index_view: DataFrame | None = None) -> DataFrame:
    """Objects outside the system databases, with assumed key, index and column rollups.

    The assumed key is the unique index with the smallest id.  Key and rollup come
    from one aggregate over the index view.
    """
    index_view = index_usage_view(s) if index_view is None else index_view
    key = F.min(F.when(F.col("is_unique"), F.struct(
        "index_id", "index_name", "index_type", "data_space", "data_compression_desc", "writes",
        "reads", "cols")))
    df = with_extras(s["objects"], _names(s).filter(not_system()), DB)
    df = rollup_left(df, index_view, NAMED, _key=key, **{n: F.sum(v) for n, v in _index_measures(mode).items()})
    df = rollup_left(
        df, s["columns"], NAMED, _columns=F.count(F.lit(1)),
        has_identity=count_if(F.coalesce("is_identity", F.lit(False))),
        computed_columns=count_if(F.coalesce("is_computed", F.lit(False))),
        blob_columns=count_if(F.coalesce("character_maximum_length", F.lit(0)) == -1))
    kept = [c for c in df.columns if not c.startswith("_")]
    return df.select(
        *kept, thousands(F.col("row_count")).alias("row_count_s"),
        F.coalesce("_columns", F.lit(0)).alias("columns_count"),
        F.coalesce("_key.index_name", F.lit("")).alias("pk"),
        F.coalesce("_key.index_type", F.lit("")).alias("pk_type"),
        F.coalesce("_key.writes", F.lit(0)).alias("writes"),
        F.coalesce("_key.reads", F.lit(0)).alias("reads"),
        F.col("_key.index_name").alias("pk_name"), F.col("_key.cols").alias("pk_cols"))


def columns_view(s: Tables, objects_view: DataFrame | None = None,
                 mode: str = "reference") -> DataFrame:
    """Columns with their object's kind and row count, and whether they are in the assumed key."""
    objects_view = database_objects_view(s, mode) if objects_view is None else objects_view
    owner = objects_view.select(*NAMED, "server_name", "database_name", "xtype", "row_count",
                                "row_count_s", "pk_name", "pk_cols")
    blank = F.lit("")
    return (s["columns"].join(owner, NAMED)
            .withColumn("column_default", F.coalesce("column_default", blank))
            .withColumn("collation_name", F.coalesce("collation_name", blank))
            .withColumn("is_key", is_key(F.col("column_name"), F.col("pk_cols"))))


def _with_server(s: Tables, table: str, *columns: str) -> DataFrame:
    return with_extras(s[table], s["servers"].select("server_id", *columns), ["server_id"])


def availability_groups_view(s: Tables) -> DataFrame:
    return _with_server(s, "availability_groups", "server_name", "description", "version")


def cluster_nodes_view(s: Tables) -> DataFrame:
    return _with_server(s, "cluster_nodes", "server_name")


def jobs_view(s: Tables) -> DataFrame:
    """Every server with its jobs; a server without jobs appears once."""
    return (s["servers"].select("server_id", "server_name",
                                F.col("description").alias("server_description"))
            .join(s["jobs"], "server_id", "left"))


def top_sql_view(s: Tables) -> DataFrame:
    return with_extras(s["top_sql"], _names(s), DB)


def top_wait_view(s: Tables) -> DataFrame:
    return _with_server(s, "top_wait", "server_name")


def volumes_view(s: Tables) -> DataFrame:
    return _with_server(s, "volumes", "server_name", "description")


def servers_view(s: Tables, databases: DataFrame | None = None, mode: str = "reference",
                 service: str = fv.ENGINE_SERVICE) -> DataFrame:
    """Servers with service, node, rollups of all they hold, top wait and top procedure."""
    databases = databases_view(s, mode) if databases is None else databases
    on = ["server_id"]
    primary = F.col("is_primary_server").cast("int")
    df = s["servers"].withColumn("major_version", major_version(F.col("version")))
    df = left_where(df, s["services"].select(*on, "servicename", "service_account",
                                             "last_startup_time"),
                    on, F.lower("servicename") == service.lower())
    df = left_where(df, s["cluster_nodes"].select(*on, "node_name", "is_current_owner"),
                    on, F.col("is_current_owner"))
    df = rollup_left(df, databases, on, databases=row_count(), data_mb=F.sum("data_mb"),
                     log_mb=F.sum("log_mb"), cached_size_mbs=F.sum("cached_size_mbs"),
                     cpu_time=F.sum("cpu_time"))
    df = rollup_left(df, s["availability_groups"], on, availability_groups=row_count(),
                     primary_availability_groups=F.sum(primary),
                     replica_availability_groups=F.sum(1 - primary))
    df = rollup_left(df, s["volumes"], on, volumes=row_count(), total_gb=F.sum("total_gb"),
                     available_gb=F.sum("available_gb"))
    df = rollup_left(df, s["jobs"], on, jobs=row_count())
    df = rollup_left(df, s["linked_servers"], on, linked_servers=row_count())
    df = left_first(df, s["top_wait"].select(*on, F.col("wait_type").alias("top_wait"),
                                             F.col("wait_time_ms").alias("_wait")),
                    on, [F.desc("_wait"), F.asc("top_wait")])
    df = left_first(df, s["top_sql"].select(*on, F.col("sp_name").alias("top_sql"),
                                            F.col("total_worker_time").alias("_work")),
                    on, [F.desc("_work"), F.asc("top_sql")])
    own = s["linked_servers"].filter(
        name_key(F.col("linked_server")) == name_key(F.col("server_name"))).select(
        *on, "provider_name", "datasource", "location", "provider_string")
    return (df.join(own, on, "left")
            .drop("_wait", "_work", "servicename", "is_current_owner"))
