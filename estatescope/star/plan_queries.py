"""Every view, rule and report on the inventory of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from estatescope.plans import reports, rules, views
from estatescope.plans.assessment import evaluate, gold_jobs, rule_jobs
from estatescope.sources.texts import with_texts
from estatescope.star.inventory import StarInventory
from estatescope.star.registry import SQL, query
from estatescope.workspace import stored, work_folder

_ROLLUP = ["indexes", "index_data_size", "index_used_size", "unique_indexes",
           "included_column_indexes", "filtered_indexes", "column_stores"]
_ROLLUP_SQL = ", ".join(_ROLLUP)


def _text(df: DataFrame, *lists: str) -> DataFrame:
    for name in lists:
        df = df.withColumn(name, F.array_join(name, ", "))
    return df


# ------------------------------------------------------------------------------ views


@query("view_index_usage", """
    SELECT server_name, database_name, schema_name AS table_schema, object_name AS table_name,
           index_id, index_name, row_count, cols, included, col_count, data_size, writes, reads
    FROM x_index_view""")
def view_index_usage(spark: SparkSession, d: str) -> DataFrame:
    return _text(views.index_usage_view(StarInventory(spark, d)).select(
        "server_name", "database_name", "table_schema", "table_name", "index_id", "index_name",
        "row_count", "cols", "included", "col_count", "data_size", "writes", "reads"),
        "cols", "included")


_DATABASES = ["files", "file_groups", "data_mb", "log_mb", "data_mb_s", "rows", "tables", "empty",
              "small", "medium", "large", "very_large", "views", "procs", "functions", "columns"]


@query("view_databases", "SELECT server_name, database_name, "
       + ", ".join(f'"{c}"' for c in _DATABASES) + f", {_ROLLUP_SQL} FROM x_databases_view")
def view_databases(spark: SparkSession, d: str) -> DataFrame:
    return views.databases_view(StarInventory(spark, d)).select(
        "server_name", "database_name", *_DATABASES, *_ROLLUP)


@query("view_database_files", """
    SELECT server_name, f.database_name, file_id, s_name AS file_name, pages::INTEGER AS total_mbs,
           filegroup_name
    FROM x_files f JOIN x_server USING (server_id)""")
def view_database_files(spark: SparkSession, d: str) -> DataFrame:
    return views.database_files_view(StarInventory(spark, d)).select(
        "server_name", "database_name", "file_id", "file_name", "total_mbs", "filegroup_name")


@query("view_database_objects", f"""
    SELECT server_name, database_name, schema_name, object_name, xtype, row_count, row_count_s,
           row_length, definition AS routine_definition, columns_count, has_identity,
           computed_columns, blob_columns, coalesce(pk_name, '') AS pk,
           coalesce(pk_type, '') AS pk_type, writes, reads, pk_cols, {_ROLLUP_SQL}
    FROM x_objects_view""")
def view_database_objects(spark: SparkSession, d: str) -> DataFrame:
    s = StarInventory(spark, d)
    return _text(with_texts(views.database_objects_view(s), s["texts"]).select(
        "server_name", "database_name", "schema_name", "object_name", "xtype", "row_count",
        "row_count_s", "row_length", "routine_definition", "columns_count", "has_identity",
        "computed_columns", "blob_columns", "pk", "pk_type", "writes", "reads", "pk_cols",
        *_ROLLUP), "pk_cols")


_COLUMNS_SQL = """
    SELECT server_name, database_name, schema_name AS table_schema, object_name AS table_name,
           column_name, ordinal_position, coalesce(column_default, '') AS column_default,
           data_type, is_computed, is_identity, xtype, row_count, is_key, pk_name, pk_cols
    FROM x_columns_view"""


@query("view_columns", _COLUMNS_SQL)
def view_columns(spark: SparkSession, d: str) -> DataFrame:
    return _text(views.columns_view(StarInventory(spark, d)).select(
        "server_name", "database_name", "table_schema", "table_name", "column_name",
        "ordinal_position", "column_default", "data_type", "is_computed", "is_identity", "xtype",
        "row_count", "is_key", "pk_name", "pk_cols"), "pk_cols")


@query("view_availability_groups", """
    SELECT server_name, description, version, g.* FROM x_groups g JOIN x_server USING (server_id)""")
def view_availability_groups(spark: SparkSession, d: str) -> DataFrame:
    return views.availability_groups_view(StarInventory(spark, d))


@query("view_cluster_nodes", """
    SELECT server_id, server_name, database_name AS node_name,
           CASE WHEN server_id > 0 THEN database_id % 2 END AS status,
           CASE WHEN server_id > 0 THEN 'up' END AS status_description,
           CASE WHEN server_id > 0 THEN database_id < 5 END AS is_current_owner FROM x_db""")
def view_cluster_nodes(spark: SparkSession, d: str) -> DataFrame:
    return views.cluster_nodes_view(StarInventory(spark, d))


@query("view_jobs", """
    SELECT server_name, description AS server_description, j.job_name, j.schedule_dscr, j.owner,
           j.frequency, j.units, j.run_time
    FROM x_server s LEFT JOIN (SELECT * EXCLUDE (description) FROM x_jobs) j USING (server_id)""")
def view_jobs(spark: SparkSession, d: str) -> DataFrame:
    return views.jobs_view(StarInventory(spark, d)).select(
        "server_name", "server_description", "job_name", "schedule_dscr", "owner", "frequency",
        "units", "run_time")


@query("view_top_sql", """
    SELECT server_name, t.database_name, sp_name, total_worker_time, avg_worker_time,
           execution_count, calls_per_second, total_elapsed_time, avg_elapsed_time
    FROM x_top_sql t JOIN x_server USING (server_id)""")
def view_top_sql(spark: SparkSession, d: str) -> DataFrame:
    return views.top_sql_view(StarInventory(spark, d)).select(
        "server_name", "database_name", "sp_name", "total_worker_time", "avg_worker_time",
        "execution_count", "calls_per_second", "total_elapsed_time", "avg_elapsed_time")


@query("view_top_wait", """
    SELECT server_name, t.* FROM x_top_wait t JOIN x_server USING (server_id)""")
def view_top_wait(spark: SparkSession, d: str) -> DataFrame:
    return views.top_wait_view(StarInventory(spark, d))


@query("view_volumes", """
    SELECT server_name, description, volume_mount_point, total_gb, available_gb
    FROM x_volumes JOIN x_server USING (server_id)""")
def view_volumes(spark: SparkSession, d: str) -> DataFrame:
    return views.volumes_view(StarInventory(spark, d)).select(
        "server_name", "description", "volume_mount_point", "total_gb", "available_gb")


_SERVERS_SQL = """
    SELECT server_id, s.server_name, substr(version, 22, 4) AS major_version,
           'svc_click' AS service_account,
           CASE WHEN server_id > 0 THEN 'NATION_' || server_id END AS node_name, databases,
           data_mb, log_mb, cached_size_mbs, cpu_time, availability_groups,
           primary_availability_groups, replica_availability_groups, volumes, total_gb,
           available_gb, jobs, linked_servers, top_wait, top_sql
    FROM x_server s
    LEFT JOIN (SELECT server_id, count(*) AS databases, sum(data_mb)::BIGINT AS data_mb,
        sum(log_mb)::BIGINT AS log_mb, sum(database_id)::BIGINT AS cached_size_mbs,
        sum(database_id * 10)::BIGINT AS cpu_time FROM x_databases_view GROUP BY ALL)
      USING (server_id)
    LEFT JOIN (SELECT server_id, count(*) AS availability_groups,
        sum(is_primary_server::INTEGER)::BIGINT AS primary_availability_groups,
        sum(1 - is_primary_server::INTEGER)::BIGINT AS replica_availability_groups
        FROM x_groups GROUP BY ALL) USING (server_id)
    LEFT JOIN (SELECT server_id, count(*) AS volumes, sum(total_gb)::BIGINT AS total_gb,
        sum(available_gb)::BIGINT AS available_gb FROM x_volumes GROUP BY ALL) USING (server_id)
    LEFT JOIN (SELECT server_id, count(*) AS jobs FROM x_jobs GROUP BY ALL) USING (server_id)
    LEFT JOIN (SELECT server_id, count(*) AS linked_servers FROM x_linked GROUP BY ALL)
      USING (server_id)
    LEFT JOIN (SELECT server_id, wait_type AS top_wait FROM x_top_wait
      QUALIFY row_number() OVER (PARTITION BY server_id
        ORDER BY wait_time_ms DESC, wait_type) = 1) USING (server_id)
    LEFT JOIN (SELECT server_id, sp_name AS top_sql FROM x_top_sql
      QUALIFY row_number() OVER (PARTITION BY server_id
        ORDER BY total_worker_time DESC, sp_name) = 1) USING (server_id)"""


@query("view_servers", _SERVERS_SQL)
def view_servers(spark: SparkSession, d: str) -> DataFrame:
    return views.servers_view(StarInventory(spark, d), service="CLICK").select(
        "server_id", "server_name", "major_version", "service_account", "node_name", "databases",
        "data_mb", "log_mb", "cached_size_mbs", "cpu_time", "availability_groups",
        "primary_availability_groups", "replica_availability_groups", "volumes", "total_gb",
        "available_gb", "jobs", "linked_servers", "top_wait", "top_sql")


# ------------------------------------------------------------------------------ rules


def _gold(spark: SparkSession, d: str, mode: str = "reference", kept: tuple[str, ...] = (),
          loaded: tuple[str, ...] = ()):
    """Inventory and gold tables; of the inventory those in ``loaded`` are stored first, of gold those in ``kept``."""
    s = StarInventory(spark, d)
    folder = work_folder(spark, "gold") if kept or loaded else ""
    for name in loaded:
        setattr(s, name, stored(s[name], f"{folder}/loaded/{name}"))
    return s, evaluate(gold_jobs(s, mode), {name: f"{folder}/{name}" for name in kept})


def _rules(spark: SparkSession, d: str, mode: str = "reference"):
    s, g = _gold(spark, d, mode)
    return evaluate(rule_jobs(g, s))


_ROUTINE_SQL = "server_id, database_id, database_name, schema_name, object_name, xtype"


def _routine(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("server_id", "database_id", "database_name", "schema_name", "object_name",
                     "xtype", "routine_definition", *extra)


@query("rule_cross_server_routines", f"""
    SELECT {_ROUTINE_SQL}, definition AS routine_definition, linked_server FROM x_xserver""")
def rule_cross_server(spark: SparkSession, d: str) -> DataFrame:
    return _routine(_rules(spark, d)["cross_server_routines"], "linked_server")


@query("rule_cross_server_routines_intended", """
    SELECT DISTINCT server_id, database_id, schema_name, object_name, linked_server
    FROM x_objects
    JOIN (SELECT server_id, min(linked_server) AS linked_server FROM x_linked
      WHERE linked_server <> '' GROUP BY server_id, lower(linked_server)) USING (server_id)
    WHERE contains(lower(definition), lower(linked_server) || '.')
      OR contains(lower(definition), lower(linked_server) || '].')""")
def rule_cross_server_intended(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d, "intended")[1]["cross_server_hits"].select(
        "server_id", "database_id", "schema_name", "object_name", "linked_server")


@query("rule_cross_database_routines", f"""
    SELECT {_ROUTINE_SQL}, definition AS routine_definition, x_database_name FROM x_xdatabase""")
def rule_cross_database(spark: SparkSession, d: str) -> DataFrame:
    return _routine(_rules(spark, d)["cross_database_routines"], "x_database_name")


@query("rule_cross_database_routines_intended", """
    SELECT o.server_id, o.database_id, schema_name, object_name, d.database_name AS x_database_name
    FROM x_objects o JOIN x_db d ON d.server_id = o.server_id AND d.database_id <> o.database_id
    WHERE contains(lower(definition), lower(d.database_name) || '.')
      OR contains(lower(definition), lower(d.database_name) || '].')""")
def rule_cross_database_intended(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d, "intended")[1]["cross_database_hits"].select(
        "server_id", "database_id", "schema_name", "object_name", "x_database_name")


@query("rule_incompatible_routine_types", f"""
    SELECT {_ROUTINE_SQL}, definition AS routine_definition, type_desc FROM x_routines
    WHERE incompatible_type = 1 AND definition IS NOT NULL""")
def rule_routine_types(spark: SparkSession, d: str) -> DataFrame:
    return _routine(_rules(spark, d)["incompatible_routine_types"], "type_desc")


@query("rule_incompatible_routines", f"""
    SELECT {_ROUTINE_SQL}, definition AS routine_definition, uses_for_xml, uses_cursor,
           incompatible_type FROM x_routines WHERE uses_for_xml = 1 OR uses_cursor = 1""")
def rule_routines(spark: SparkSession, d: str) -> DataFrame:
    return _routine(_rules(spark, d)["incompatible_routines"], "uses_for_xml", "uses_cursor",
                    "incompatible_type")


_COLUMN_SQL = """SELECT server_id, database_id, database_name, schema_name AS table_schema,
           object_name AS table_name, column_name, ordinal_position, data_type"""


def _column_rule(spark: SparkSession, d: str, rule, *extra: str) -> DataFrame:
    s = StarInventory(spark, d)
    findings = rules.column_findings(views.columns_view(s))
    return rule(findings).select(
        "server_id", "database_id", "database_name", "table_schema", "table_name", "column_name",
        "ordinal_position", "data_type", *extra)


@query("rule_incompatible_columns", f"""{_COLUMN_SQL}, row_count AS table_row_count
    FROM x_column_flags WHERE incompatible_column = 1""")
def rule_incompatible_columns(spark: SparkSession, d: str) -> DataFrame:
    return _column_rule(spark, d, rules.incompatible_columns, "table_row_count")


@query("rule_computed_columns", f"""{_COLUMN_SQL}, row_count AS table_row_count
    FROM x_column_flags WHERE computed_column = 1""")
def rule_computed_columns(spark: SparkSession, d: str) -> DataFrame:
    return _column_rule(spark, d, rules.computed_columns, "table_row_count")


@query("rule_large_text_columns", f"""{_COLUMN_SQL}, row_count AS table_row_count
    FROM x_column_flags WHERE large_text_column = 1""")
def rule_large_text_columns(spark: SparkSession, d: str) -> DataFrame:
    return _column_rule(spark, d, rules.large_text_columns, "table_row_count")


@query("rule_large_text_columns_intended", """
    SELECT server_id, database_id, column_name, ordinal_position, data_type FROM x_columns
    WHERE data_type IN ('text', 'nvarchar (max)') OR is_computed""")
def rule_large_text_intended(spark: SparkSession, d: str) -> DataFrame:
    findings = rules.column_findings(views.columns_view(StarInventory(spark, d)), "intended")
    return rules.large_text_columns(findings).select(
        "server_id", "database_id", "column_name", "ordinal_position", "data_type")


@query("rule_invalid_defaults", f"""{_COLUMN_SQL}, column_default
    FROM x_column_flags WHERE invalid_default = 1""")
def rule_invalid_defaults(spark: SparkSession, d: str) -> DataFrame:
    return _column_rule(spark, d, rules.invalid_defaults, "column_default")


# ---------------------------------------------------------------------------- reports


@query("report_instance", f"""
    SELECT server_name AS ServerName, major_version AS MajorVersion,
           linked_servers AS LinkedServers, databases AS Databases, data_mb AS DataMB,
           log_mb AS LogMB, cached_size_mbs AS CachedSizeMbs, cpu_time AS CPUTime,
           availability_groups AS AvailabilityGroups, volumes AS Volumes, total_gb AS TotalGB,
           available_gb AS AvailableGB, jobs AS Jobs, top_wait, top_sql AS TopSql
    FROM ({_SERVERS_SQL})""")
def report_instance(spark: SparkSession, d: str) -> DataFrame:
    return reports.instance_report(_gold(spark, d)[1]).select(
        "ServerName", "MajorVersion", "LinkedServers", "Databases", "DataMB", "LogMB",
        "CachedSizeMbs", "CPUTime", "AvailabilityGroups", "Volumes", "TotalGB", "AvailableGB",
        "Jobs", "top_wait", "TopSql")


@query("report_jobs", """
    SELECT job_name AS Job_Name, x_job.enabled AS Enabled, schedule_dscr AS ScheduleDscr,
           c.role || '_' || c.turn AS Step_Name,
           'NATION_' || (x_job.conv_id % 25) AS Database_Name, c.text AS Command
    FROM x_job JOIN conversations c USING (conv_id)
    LEFT JOIN x_job_schedule ON user_id = conv_id""")
def report_jobs(spark: SparkSession, d: str) -> DataFrame:
    return reports.jobs_report(StarInventory(spark, d))


@query("report_wait_stats", """
    SELECT wait_type, percent_total_waits, percent_total_signal_waits,
           percent_total_resource_waits FROM x_top_wait""")
def report_wait_stats(spark: SparkSession, d: str) -> DataFrame:
    return reports.wait_report(_gold(spark, d)[1])


@query("report_top_sql", """
    SELECT database_name AS DatabaseName, sp_name AS SPName,
           total_worker_time AS TotalWorkerTime, execution_count, avg_worker_time AS AvgWorkerTime
    FROM x_top_sql""")
def report_top_sql(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_sql_report(_gold(spark, d)[1])


@query("report_databases", """
    SELECT d.database_name AS "DatabaseName", coalesce(data_mb, 0) AS "DataMB",
           coalesce(files, 0) AS "Files", coalesce("tables", 0) AS "Tables",
           coalesce(empty, 0) AS "Empty", coalesce(small, 0) AS "Small",
           coalesce(medium, 0) AS "Medium", coalesce(large, 0) AS "Large",
           coalesce(very_large, 0) AS "VeryLarge", coalesce("columns", 0) AS "Columns",
           coalesce("rows", 0) AS "Rows", coalesce("views", 0) AS "Views",
           coalesce(procs, 0) AS "Procs", coalesce(functions, 0) AS "Functions",
           coalesce(indexes, 0) AS "Indexes", coalesce(column_stores, 0) AS "ColumnStores",
           coalesce(unique_indexes, 0) AS "UniqueIndexes",
           coalesce(included_column_indexes, 0) AS "IncludedColumnIndexes",
           coalesce(f.large_text, 0) AS "LargeTextColumns", coalesce(f.invalid, 0)
             AS "IncompatibleDefaults",
           coalesce(filtered_indexes, 0) AS "FilteredIndexes",
           coalesce(f.computed, 0) AS "ComputedColumns", coalesce(xs.n, 0) AS "XServerRoutines",
           coalesce(xs.list, '') AS "LinkedServers", coalesce(xo.n, 0) AS "XOutRoutines",
           coalesce(xo.list, '') AS "XOutDbs", coalesce(xi.n, 0) AS "XInRoutines",
           coalesce(xi.list, '') AS "XInDbs", coalesce(r.xml, 0) AS "UsesForXML",
           coalesce(r.cursors, 0) AS "UsesCursor", coalesce(f.incompatible, 0)
             AS "IncompatibleColumns",
           coalesce(r.kinds, 0) AS "IncompatibleRoutinesByType", coalesce(q.n, 0) AS "Sequences"
    FROM x_databases_view d
    LEFT JOIN (SELECT database_id, sum(incompatible_column)::BIGINT AS incompatible,
        sum(computed_column)::BIGINT AS computed, sum(large_text_column)::BIGINT AS large_text,
        sum(invalid_default)::BIGINT AS invalid FROM x_column_flags GROUP BY ALL) f
      USING (database_id)
    LEFT JOIN (SELECT database_id, sum(uses_for_xml)::BIGINT AS xml,
        sum(uses_cursor)::BIGINT AS cursors,
        sum(CASE WHEN incompatible_type = 1 AND definition IS NOT NULL THEN 1 ELSE 0 END)::BIGINT
          AS kinds FROM x_routines GROUP BY ALL) r USING (database_id)
    LEFT JOIN (SELECT database_id, sum(c)::BIGINT AS n,
        string_agg(linked_server, ',' ORDER BY linked_server) AS list
      FROM (SELECT database_id, linked_server, count(*) AS c FROM x_xserver GROUP BY ALL)
      GROUP BY ALL) xs USING (database_id)
    LEFT JOIN (SELECT database_id, sum(c)::BIGINT AS n,
        string_agg(x_database_name, ',' ORDER BY x_database_name) AS list
      FROM (SELECT database_id, x_database_name, count(*) AS c FROM x_xdatabase GROUP BY ALL)
      GROUP BY ALL) xo USING (database_id)
    LEFT JOIN (SELECT server_id, x_database_name, sum(c)::BIGINT AS n,
        string_agg(database_name, ',' ORDER BY database_name) AS list
      FROM (SELECT server_id, x_database_name, database_name, count(*) AS c FROM x_xdatabase
        GROUP BY ALL) GROUP BY ALL) xi
      ON xi.server_id = d.server_id AND xi.x_database_name = d.database_name
    LEFT JOIN (SELECT database_id, count(*) AS n FROM x_sequences GROUP BY ALL) q
      USING (database_id)""")
def report_databases(spark: SparkSession, d: str) -> DataFrame:
    s, g = _gold(spark, d, kept=("reference_hits",), loaded=("linked_servers", "texts"))
    return reports.databases_report(g, s)


@query("report_tables", """
    SELECT database_name AS DatabaseName, schema_name AS SchemaName, object_name AS ObjectName,
           row_count AS RowCount, row_length AS RowLength, coalesce(pk_name, '') AS PK,
           coalesce(pk_type, '') AS PKType, writes, reads, coalesce(pk_cols, '') AS PKCols,
           indexes AS Indexes, index_data_size AS Index_data_size,
           index_used_size AS Index_used_size, column_stores AS ColumnStores,
           columns_count AS ColumnsCount, has_identity AS HasIdentity,
           computed_columns AS ComputedColumns, unique_indexes AS UniqueIndexes,
           included_column_indexes AS IncludedColumnIndexes, filtered_indexes AS FilteredIndexes,
           blob_columns AS BlobColumns
    FROM x_objects_view WHERE xtype = 'U'""")
def report_tables(spark: SparkSession, d: str) -> DataFrame:
    return reports.tables_report(_gold(spark, d)[1])


def _columns_report_sql(type_comment: str) -> str:
    return f"""
    SELECT database_name AS DatabaseName, schema_name AS SchemaName, object_name AS TableName,
           ordinal_position AS ORDINAL_POSITION, column_name AS COLUMN_NAME,
           coalesce(column_default, '') AS COLUMN_DEFAULT, is_nullable AS IS_NULLABLE,
           data_type AS DATA_TYPE, max_length AS CHARACTER_MAXIMUM_LENGTH, '' AS COLLATION_NAME,
           is_computed, is_identity, xtype AS Xtype, is_key AS isKey,
           CASE WHEN is_computed THEN 'Is Computed' {type_comment}
             WHEN column_default LIKE '%()%' THEN 'Incompatible Default'
             WHEN max_length = -1 THEN 'Cant be Column Compressed' ELSE '' END AS Comment
    FROM x_columns_view"""


@query("report_columns", _columns_report_sql(""))
def report_columns(spark: SparkSession, d: str) -> DataFrame:
    return reports.columns_report(_gold(spark, d)[1])


@query("report_columns_intended", _columns_report_sql(
    "WHEN data_type IN ('xml', 'geography') THEN 'Incompatible Type'"))
def report_columns_intended(spark: SparkSession, d: str) -> DataFrame:
    return reports.columns_report(_gold(spark, d)[1], "intended")


@query("report_indexes", """
    SELECT database_name AS DatabaseName, schema_name AS table_schema, object_name AS table_name,
           coalesce(index_name, '') AS index_name, 'PRIMARY' AS data_space, allocation_desc,
           'USER_TABLE' AS object_type, index_type, is_disabled, '/data/f' AS database_file,
           size_mbs, used_size, data_size, writes, reads, index_id, 80 AS fill_factor,
           coalesce(cols, '') AS columns, is_unique, coalesce(included, '') AS included,
           coalesce(filter_definition, '') AS filter_definition,
           compression AS data_compression_desc
    FROM x_indexes""")
def report_indexes(spark: SparkSession, d: str) -> DataFrame:
    return reports.indexes_report(StarInventory(spark, d))


@query("report_routines", """
    SELECT r.database_name AS DatabaseName, r.schema_name AS SchemaName, r.xtype AS Xtype,
           type_desc AS TypeDesc, r.object_name AS ObjectName,
           coalesce(sql_data_access, '') AS SQL_DATA_ACCESS,
           coalesce(linked_server, '') AS LinkedServers,
           coalesce(x_database_name, '') AS XOutDbs, uses_for_xml AS UsesForXML,
           uses_cursor AS UsesCursor, incompatible_type AS IncompatibleType,
           r.definition AS ROUTINE_DEFINITION
    FROM x_routines r
    LEFT JOIN x_xserver s USING (database_id, schema_name, object_name)
    LEFT JOIN x_xdatabase x USING (database_id, schema_name, object_name)
    WHERE r.xtype <> 'U'""")
def report_routines(spark: SparkSession, d: str) -> DataFrame:
    return reports.routines_report(*reversed(_gold(spark, d)))


@query("report_sequences", """
    SELECT database_name AS DatabaseName, sequence_name AS SequenceName,
           parent_table AS ParentTable, parent_column AS ParentColumn FROM x_sequences""")
def report_sequences(spark: SparkSession, d: str) -> DataFrame:
    return reports.sequences_report(StarInventory(spark, d))


@query("report_linked_servers", """
    SELECT server_name AS ServerName, linked_server AS LinkedServer,
           provider_name AS providername, datasource FROM x_linked""")
def report_linked_servers(spark: SparkSession, d: str) -> DataFrame:
    return reports.linked_servers_report(StarInventory(spark, d))


@query("rule_incompatible_routines_by_pattern", f"""
    SELECT {_ROUTINE_SQL}, definition AS routine_definition,
           CASE WHEN definition ILIKE '%en%the%ion%' THEN 1 ELSE 0 END AS uses_for_xml,
           CASE WHEN definition ILIKE '%que%de%la%' THEN 1 ELSE 0 END AS uses_cursor, incompatible_type
    FROM x_routines WHERE definition ILIKE '%en%the%ion%' OR definition ILIKE '%que%de%la%'""")
def rule_routines_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    """The same rule with patterns of the caller, which these texts do hold."""
    s, g = _gold(spark, d)
    found = rules.routine_findings(g["objects_view"], s["texts"], "%EN%the%ion%", "%que%de%la%")
    return _routine(with_texts(rules.incompatible_routines(found), s["texts"]), "uses_for_xml", "uses_cursor",
                    "incompatible_type")


_BUNDLE = ["instance", "jobs", "wait_stats", "top_sql", "databases", "tables", "columns", "indexes", "routines",
           "sequences", "linked_servers"]


@query("report_bundle", " UNION ALL ".join(
    f"SELECT '{n}' AS report, count(*) AS rows FROM ({SQL[f'report_{n}']})" for n in _BUNDLE))
def report_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of the whole bundle; the reports' content is compared one by one."""
    s, g = _gold(spark, d, kept=("reference_hits", "routine_findings", "objects_view"), loaded=("linked_servers", "texts"))
    bundle = reports.reports(g, s)
    counts = [bundle[n].agg(F.lit(n).alias("report"), F.count("*").alias("rows"))
              for n in _BUNDLE]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out
