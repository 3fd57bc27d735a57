"""Every collector and sink on the star tables seen as snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from estatescope.sources import collectors as c
from estatescope.sources import sinks
from estatescope.sources.schemas import SILVER
from estatescope.sources.snapshot import conform, read_snapshot
from estatescope.sources.texts import load_texts, with_texts
from estatescope.star.bronze import AS_OF, Star
from estatescope.star.registry import query, read
from estatescope.workspace import work_folder


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _databases(star: Star) -> DataFrame:
    """The few database fields the collectors of objects, columns, files and indexes ask for."""
    none = F.lit(None).cast("string")
    named = star.databases.select("server_id", "database_id", F.col("name").alias("database_name"),
                                  "state_desc", none.alias("primary_replica"),
                                  none.alias("edition"))
    return c.with_server_name(named, star.servers)


@query("load_servers", """
    SELECT s.server_id, s.server_name, s.description, s.version,
           CASE WHEN server_id > 0 THEN '6.' || server_id END AS windows_release,
           '2020-01-01' AS created, 'Enterprise' AS edition,
           cpus AS logical_cpu_count, 2 AS hyperthread_ratio, cpus // 2 AS physical_cpu_count,
           memory // 1024 AS physical_memory_mb,
           CASE WHEN server_id > 0 THEN 'HYPERVISOR' END AS vm_type, 1 AS governor_functions
    FROM x_server s
    JOIN (SELECT server_id, count(*)::INTEGER AS cpus FROM x_db GROUP BY ALL) USING (server_id)
    JOIN (SELECT server_id, sum(floor(abs(c_acctbal))::BIGINT)::BIGINT AS memory FROM x_cust
      GROUP BY ALL) USING (server_id)""")
def load_servers(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return c.load_servers(star.servers, star.server_properties).select(
        "server_id", "server_name", "description", "version", "windows_release",
        F.date_format("created_date", "yyyy-MM-dd").alias("created"), "edition",
        "logical_cpu_count", "hyperthread_ratio", "physical_cpu_count", "physical_memory_mb",
        "vm_type", "governor_functions")


@query("load_linked_servers", "SELECT * FROM x_linked")
def load_linked_servers(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return c.load_linked_servers(star.servers, star.sysservers).drop("location", "provider_string")


@query("load_services", """
    SELECT DISTINCT (user_id % 5)::INTEGER AS server_id, event_type AS servicename,
           'svc_' || event_type AS service_account, 2 AS startup_type, 'N' AS is_clustered
    FROM events""")
def load_services(spark: SparkSession, d: str) -> DataFrame:
    return c.load_services(Star(spark, d).services).select(
        "server_id", "servicename", "service_account", "startup_type", "is_clustered")


@query("load_cluster_nodes", """
    SELECT server_id, database_name AS node_name,
           CASE WHEN server_id > 0 THEN database_id % 2 END AS status,
           CASE WHEN server_id > 0 THEN 'up' END AS status_description,
           CASE WHEN server_id > 0 THEN database_id < 5 END AS is_current_owner FROM x_db""")
def load_cluster_nodes(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return c.load_cluster_nodes(star.cluster_nodes, star.servers)


@query("load_availability_groups", "SELECT * FROM x_groups")
def load_availability_groups(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    servers = star.servers.withColumn("edition", F.lit("Enterprise"))
    return c.load_availability_groups(
        star.availability_groups, star.availability_replicas, star.availability_group_states,
        star.availability_replica_states, servers)


@query("load_sys_configurations", """
    SELECT server_id, server_name, database_name AS name, database_id::VARCHAR AS value,
           (database_id * 2)::VARCHAR AS value_in_use, '0' AS minimum, '100' AS maximum,
           'about ' || database_name AS description, database_id % 2 = 0 AS is_dynamic,
           database_id % 3 = 0 AS is_advanced FROM x_db""")
def load_sys_configurations(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return c.load_sys_configurations(star.servers, star.configurations)


@query("load_databases", """
    SELECT x_db.server_id, x_db.database_id, x_db.database_name,
           log_kb AS log_size_kb, log_kb // 3 AS log_used_kb,
           ((200 * (log_kb // 3) + log_kb) // (2 * log_kb)) || '.00' AS log_used_percentage,
           data_mb, log_mb,
           CASE WHEN server_id = 0 THEN 0 ELSE coalesce(buffers, 0) * 8 // 1024 END
             AS cached_size_mbs,
           CASE WHEN server_id > 0 THEN cpu END AS cpu_time,
           CASE WHEN server_id = 0 THEN 0 ELSE cpu * 11 // 1048576 END AS io_mbs,
           -1 AS target_recovery_time_in_seconds,
           CASE WHEN server_id > 0 AND member THEN database_name END AS availability_group,
           CASE WHEN server_id > 0 AND member THEN primary_replica END AS primary_replica,
           CASE WHEN server_id > 0 AND member THEN
             CASE WHEN first % 4 = 0 THEN 3 ELSE first % 4 END END AS local_replica_role,
           CASE WHEN server_id > 0 AND member THEN CASE WHEN s_acctbal > 5000 THEN 2 ELSE 0 END
             END AS synchronization_state,
           CASE WHEN server_id > 0 AND member THEN s_acctbal > 5000 END AS is_suspended,
           CASE WHEN server_id > 0 AND member THEN true END AS is_joined,
           CASE WHEN database_id >= 5 THEN 'NATION_' || (database_id - 5) END
             AS source_database_name,
           'login_' || (database_id % 3) AS owner,
           CASE WHEN database_id % 2 = 0 THEN 'SYNCHRONIZED' END AS mirroring_state_desc,
           database_id % 2 = 0 AS is_cdc_enabled, database_id % 2 = 0 AS is_encrypted,
           CASE WHEN server_id > 1 THEN 'DISABLED' END AS delayed_durability_desc,
           CASE WHEN server_id > 0 THEN 'NONE' END AS containment_desc,
           NULL::VARCHAR AS edition
    FROM x_db
    LEFT JOIN (SELECT database_id, sum(pages)::BIGINT AS log_kb,
        sum(CASE WHEN s_acctbal >= 0 THEN pages // 128 END)::BIGINT AS data_mb,
        sum(CASE WHEN s_acctbal < 0 THEN pages // 128 END)::BIGINT AS log_mb,
        min(s_name) AS primary_replica, min(s_suppkey) AS first, min(s_suppkey) % 3 > 0 AS member
      FROM x_supp GROUP BY ALL) USING (database_id)
    LEFT JOIN (SELECT database_id, count(*) AS buffers, sum(price)::BIGINT AS cpu FROM x_work
      GROUP BY ALL) USING (database_id)
    LEFT JOIN supplier ON s_suppkey = first""")
def load_databases(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    names = ["servers", "databases", "performance_counters", "master_files", "buffer_descriptors",
             "query_stats", "virtual_file_stats", "logins", "database_mirroring",
             "database_service_objectives", "availability_groups", "availability_group_states",
             "availability_replicas", "availability_replica_states",
             "availability_db_cluster_states", "availability_db_replica_states"]
    return c.load_databases({n: star[n] for n in names}).select(
        "server_id", "database_id", "database_name", "log_size_kb", "log_used_kb",
        "log_used_percentage", "data_mb", "log_mb", "cached_size_mbs", "cpu_time", "io_mbs",
        "target_recovery_time_in_seconds", "availability_group", "primary_replica",
        "local_replica_role", "synchronization_state", "is_suspended", "is_joined",
        "source_database_name", "owner", "mirroring_state_desc", "is_cdc_enabled",
        "is_encrypted", "delayed_durability_desc", "containment_desc", "edition")


@query("load_top_sql", "SELECT * EXCLUDE (database_name) FROM x_top_sql")
def load_top_sql(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return c.load_top_sql(star.procedures, star.procedure_stats, star.schemas, _as_of(),
                          databases=star.databases)


@query("load_top_wait", "SELECT * FROM x_top_wait")
def load_top_wait(spark: SparkSession, d: str) -> DataFrame:
    return c.load_top_wait(Star(spark, d).wait_stats)


@query("load_top_wait_intended", """
    SELECT * FROM (SELECT server_id, wait_type, wait_time AS wait_time_ms,
           100.0::DOUBLE * wait_time / (sum(wait_time) OVER w)::DOUBLE AS percent_total_waits,
           100.0::DOUBLE * (wait_time - signal) / (sum(wait_time) OVER w)::DOUBLE
             AS percent_total_resource_waits
    FROM x_waits WHERE wait_time > 0 AND wait_type NOT LIKE 'error_1'
      AND wait_type NOT IN ('click_3', 'view_7', 'error_8')
    WINDOW w AS (PARTITION BY server_id))
    QUALIFY row_number() OVER (PARTITION BY server_id
      ORDER BY percent_total_resource_waits DESC, wait_type) <= 40""")
def load_top_wait_intended(spark: SparkSession, d: str) -> DataFrame:
    ignore = ["ERROR_1", "CLICK_3", "VIEW_7", "ERROR_8"]
    return c.load_top_wait(Star(spark, d).wait_stats, ignore, mode="intended").select(
        "server_id", "wait_type", "wait_time_ms", "percent_total_waits",
        "percent_total_resource_waits")


@query("load_volumes", "SELECT * FROM x_volumes")
def load_volumes(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return (c.load_volumes(star.master_files, star.volume_stats, star.servers)
            .withColumn("percentage_free", F.col("percentage_free").cast("double")))


@query("load_jobs", "SELECT * FROM x_jobs")
def load_jobs(spark: SparkSession, d: str) -> DataFrame:
    s = Star(spark, d)
    jobs = c.load_jobs(s.jobs, s.jobsteps, s.jobschedules, s.schedules, s.operators, s.logins)
    start = F.date_format("active_start_date", "yyyyMMdd").cast("long")
    return jobs.withColumn("start_date", start).drop("active_start_date", "active_end_date")


@query("load_job_steps", """
    SELECT x_job.server_id, x_job.job_id, job_name, schedule_dscr, x_job.enabled,
           c.turn::INTEGER AS step_id, c.role || '_' || c.turn AS step_name,
           'NATION_' || (x_job.conv_id % 25) AS database_name, c.text AS command
    FROM x_job JOIN conversations c USING (conv_id)
    LEFT JOIN x_job_schedule ON user_id = conv_id""")
def load_job_steps(spark: SparkSession, d: str) -> DataFrame:
    s = Star(spark, d)
    return c.load_job_steps(s.jobs, s.jobsteps, s.jobschedules, s.schedules, s.jobs)


@query("load_database_files", """
    SELECT server_id, database_id, file_id, s_name AS file_name, '/data/' || s_name
             AS physical_name, ((200 * pages + 128) // 256) // 100 AS total_mbs,
           ((200 * (pages - pages // 2) + 128) // 256) // 100 AS available_mbs, filegroup_name
    FROM x_files""")
def load_database_files(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return c.load_database_files(star.database_files, star.data_spaces, _databases(star))


@query("load_database_objects", """
    WITH cols AS (SELECT object_id, l_partkey, min(l_linenumber) = 1 AS replicated
        FROM x_line GROUP BY ALL),
      per_table AS (SELECT object_id, sum(CASE WHEN l_partkey % 8 IN (2, 3)
          THEN CASE WHEN l_partkey % 3 = 0 THEN -1 ELSE 40 END ELSE 8 END)::BIGINT AS row_length,
        count(*) AS col_count, sum(CASE WHEN replicated THEN 1 ELSE 0 END)::BIGINT AS repl_columns
        FROM cols GROUP BY ALL),
      first_int AS (SELECT object_id, 'c' || min(l_partkey) AS parent_column FROM cols
        WHERE l_partkey % 8 IN (0, 1) AND l_partkey % 11 > 0 GROUP BY ALL)
    SELECT server_id, database_id, x_cust.object_id, object_name, schema_name, 'U' AS xtype,
           row_count, row_length, coalesce(col_count, 0) AS col_count, repl_columns,
           NULL::VARCHAR AS sql_data_access, NULL::VARCHAR AS routine_definition,
           c_acctbal < 0 AS is_mspublished, NULL::BOOLEAN AS is_disabled,
           NULL::BIGINT AS start_value, NULL::BIGINT AS current_value,
           NULL::VARCHAR AS parent_table, NULL::VARCHAR AS parent_column
    FROM x_cust
    LEFT JOIN (SELECT object_id, sum(cents)::BIGINT AS row_count FROM x_ord WHERE index_id < 2
      GROUP BY ALL) USING (object_id)
    LEFT JOIN per_table USING (object_id)
    UNION ALL
    SELECT server_id, database_id, 2000000000 + object_id, object_name || '_seq', schema_name,
           'SO', NULL, NULL, 0, NULL, NULL, NULL, false, NULL, 1, object_id * 10, object_name,
           parent_column
    FROM x_cust LEFT JOIN first_int USING (object_id) WHERE server_id > 0
    UNION ALL
    SELECT server_id, database_id, 1000000000 + doc_id, object_name, schema_name, xtype, NULL,
           NULL, 0, NULL, CASE WHEN xtype = 'V' THEN 'READS' WHEN xtype IN ('F', 'C') THEN NULL
             ELSE 'MODIFIES' END,
           CASE xtype WHEN 'F' THEN upper(schema_name) || '_ACTION'
             WHEN 'C' THEN '(x > ' || doc_id || ')' ELSE definition END,
           false, CASE xtype WHEN 'F' THEN doc_id % 4 = 0 WHEN 'C' THEN doc_id % 3 = 0 END,
           NULL, NULL, NULL, NULL
    FROM x_doc""")
def load_database_objects(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    return with_texts(c.load_database_objects(star, _databases(star)), load_texts(star)).select(
        "server_id", "database_id", "object_id", "object_name", "schema_name", "xtype",
        "row_count", "row_length", "col_count", "repl_columns", "sql_data_access",
        "routine_definition", "is_mspublished", "is_disabled", "start_value", "current_value",
        "parent_table", "parent_column")


_COLUMN_SQL = """
    SELECT server_id, database_id, database_name AS table_catalog, schema_name AS table_schema,
           object_name AS table_name, object_id,
           'c' || l_partkey || (CASE WHEN l_partkey % 11 = 0 THEN '_old' ELSE '' END)
             AS column_name, l_partkey AS ordinal_position,
           CASE l_partkey % 5 WHEN 0 THEN '(getdate())' WHEN 1 THEN '((0))' END AS column_default,
           l_partkey % 2 = 0 AS is_nullable,
           (CASE l_partkey % 8 WHEN 0 THEN 'int' WHEN 1 THEN 'bigint'
             WHEN 2 THEN CASE WHEN l_partkey % 3 = 0 THEN 'nvarchar (max)' ELSE 'nvarchar (20)' END
             WHEN 3 THEN CASE WHEN l_partkey % 3 = 0 THEN 'varchar (max)' ELSE 'varchar (40)' END
             WHEN 4 THEN 'decimal (18,2)' WHEN 5 THEN 'xml' WHEN 6 THEN 'text'
             ELSE 'varbinary(8)' END) AS data_type,
           CASE WHEN l_partkey % 8 IN (2, 3) THEN CASE WHEN l_partkey % 3 = 0 THEN -1 ELSE 40 END
             ELSE 8 END AS character_maximum_length,
           CASE WHEN l_partkey % 8 IN (2, 3) THEN 'Latin1' END AS collation_name,
           min(l_discount) >= 0.09 AS is_computed, max(l_linenumber) = 7 AS is_identity
    FROM x_line GROUP BY ALL"""


def _columns(spark: SparkSession, d: str, mode: str) -> DataFrame:
    star = Star(spark, d)
    tables = star.tables.join(star.schemas.withColumnRenamed("name", "schema"),
                              ["server_id", "database_id", "schema_id"])
    objects = tables.select(
        "server_id", "database_id", "object_id", F.lower("schema").alias("schema_key"),
        F.lower("name").alias("object_key"))
    return c.load_columns(star, _databases(star), objects, mode=mode).drop(
        "schema_key", "object_key")


@query("load_columns", f"""
    SELECT * FROM ({_COLUMN_SQL})
    UNION ALL SELECT * REPLACE ('phone' AS data_type) FROM ({_COLUMN_SQL})
      WHERE data_type LIKE 'varchar%'""")
def load_columns(spark: SparkSession, d: str) -> DataFrame:
    return _columns(spark, d, "reference")


@query("load_columns_intended", _COLUMN_SQL)
def load_columns_intended(spark: SparkSession, d: str) -> DataFrame:
    return _columns(spark, d, "intended")


def _index_sql(mode: str) -> str:
    reference = mode == "reference"
    size = "sum(p // 128)" if reference else "sum(p) // 128"
    per_file = "coalesce(files, 1)" if reference else "1"
    per_unit = "units * coalesce(files, 1)" if reference else "1"
    return f"""
    WITH units AS (
      SELECT object_id, index_id, o_orderkey, pages AS p, 'IN_ROW_DATA' AS allocation_desc,
             o_orderpriority FROM x_ord
      UNION ALL SELECT object_id, index_id, o_orderkey, pages, 'LOB_DATA', o_orderpriority
        FROM x_ord WHERE o_orderpriority = '2-HIGH'
      UNION ALL SELECT object_id, index_id, o_orderkey, pages, 'ROW_OVERFLOW_DATA',
        o_orderpriority FROM x_ord WHERE o_orderpriority = '3-MEDIUM'),
    space AS (
      SELECT object_id, index_id, allocation_desc, CASE o_orderpriority
          WHEN '1-URGENT' THEN 'COLUMNSTORE' WHEN '2-HIGH' THEN 'PAGE' ELSE 'NONE' END
          AS data_compression_desc,
        ({size})::BIGINT AS size_mbs, ({size.replace("p", "p // 2")})::BIGINT AS used_size,
        ({size.replace("p", "p // 3")})::BIGINT AS data_size, count(*) AS units
      FROM units GROUP BY ALL),
    idx AS (
      SELECT server_id, database_id, object_id, object_name, schema_name, index_id, o_orderstatus,
             max(o_orderpriority = '1-URGENT') AS is_unique, count(*) AS n, sum(pages) AS p,
             min(o_orderpriority) AS low
      FROM x_ord GROUP BY ALL),
    lists AS (
      SELECT object_id, index_id, string_agg(name, ', ' ORDER BY l_linenumber, name)
          FILTER (l_returnflag <> 'R') AS cols,
        string_agg(name, ', ' ORDER BY l_linenumber, name) FILTER (l_returnflag = 'R') AS included
      FROM (SELECT *, 'c' || l_partkey || (CASE WHEN l_partkey % 11 = 0 THEN '_old' ELSE '' END)
        AS name FROM x_line) GROUP BY ALL)
    SELECT idx.server_id, idx.database_id, object_id, 'PRIMARY' AS data_space, allocation_desc,
           schema_name AS table_schema, object_name AS table_name,
           CASE index_id WHEN 0 THEN 'HEAP' WHEN 1 THEN 'CLUSTERED' ELSE 'NONCLUSTERED' END
             AS index_type,
           CASE WHEN index_id > 0 THEN 'ix_' || o_orderstatus END AS index_name, is_unique,
           n > 5 AS is_disabled, '/data/' || first_file AS database_file,
           size_mbs * {per_file} AS size_mbs, used_size * {per_file} AS used_size,
           data_size * {per_file} AS data_size,
           CASE WHEN n <= 5 THEN (p // 100)::BIGINT * {per_unit} END AS writes,
           CASE WHEN n <= 5 THEN (n + p // 1000 + CASE WHEN n % 2 = 0 THEN n ELSE 0 END)::BIGINT
             * {per_unit} END AS reads,
           index_id, (n * 5)::INTEGER AS fill_factor, data_compression_desc, cols, included,
           CASE WHEN low = '5-LOW' THEN '(x > 1)' END AS filter_definition
    FROM idx JOIN space USING (object_id, index_id) LEFT JOIN lists USING (object_id, index_id)
    LEFT JOIN (SELECT database_id, min(s_name) AS first_file, count(*) AS files FROM x_supp
      WHERE s_acctbal >= 0 GROUP BY ALL) f ON f.database_id = idx.database_id"""


def _index_usage(spark: SparkSession, d: str, mode: str) -> DataFrame:
    star = Star(spark, d)
    tables = star.tables.join(star.schemas.withColumnRenamed("name", "schema"),
                              ["server_id", "database_id", "schema_id"])
    objects = tables.select(
        "server_id", "database_id", "object_id", F.lit("U").alias("xtype"),
        F.lower("schema").alias("schema_key"), F.lower("name").alias("object_key"))
    out = c.load_index_usage(star, _databases(star), objects, mode)
    return (out.withColumn("cols", F.array_join("cols", ", "))
            .withColumn("included", F.array_join("included", ", "))
            .drop("schema_key", "object_key", "object_type"))


@query("load_index_usage", _index_sql("reference"))
def load_index_usage(spark: SparkSession, d: str) -> DataFrame:
    return _index_usage(spark, d, "reference")


@query("load_index_usage_intended", _index_sql("intended"))
def load_index_usage_intended(spark: SparkSession, d: str) -> DataFrame:
    return _index_usage(spark, d, "intended")


@query("load_sequences", """
    SELECT server_id, database_id, schema_name || '.' || object_name || '_seq' AS sequence_name,
           object_id * 10 AS current_value, schema_name || '.' || object_name AS parent_table,
           'id' AS parent_column, top AS max_existing, next AS next_in_use,
           CASE WHEN object_id * 10 < top THEN 1 ELSE 0 END AS is_max,
           next - object_id * 10 AS gap
    FROM x_cust LEFT JOIN (SELECT object_id, max(o_orderkey) AS top,
        min(CASE WHEN o_orderkey > object_id * 10 THEN o_orderkey END) AS next
      FROM x_ord GROUP BY ALL) USING (object_id)""")
def load_sequences(spark: SparkSession, d: str) -> DataFrame:
    star = Star(spark, d)
    seq = F.concat("c_name", F.lit("_seq"))
    objects = star._customers.select(
        "server_id", "database_id", F.lit("SO").alias("xtype"), seq.alias("object_name"),
        F.col("c_mktsegment").alias("schema_name"), (F.col("c_custkey") * 10)
        .alias("current_value"), F.col("c_mktsegment").alias("parent_schema"),
        F.col("c_name").alias("parent_table"), F.lit("id").alias("parent_column"),
        F.lower("c_mktsegment").alias("schema_key"), F.lower(seq).alias("object_key"))
    return c.load_sequences(objects, star.sequence_parent_values).drop("is_behind")


# ------------------------------------------------------------------ reading and writing


@query("read_snapshot", """
    SELECT (user_id % 5)::INTEGER AS server_id, event_type || '_' || user_id AS wait_type,
           floor(value)::BIGINT AS wait_time_ms FROM events""")
def read_snapshot_query(spark: SparkSession, d: str) -> DataFrame:
    """Write a snapshot table as JSON and read it back with its declared schema."""
    folder = work_folder(spark, "snapshot")
    value = F.floor("value").cast("long")
    waits = read(spark, d, "events").select(
        (F.col("user_id") % 5).cast("int").alias("server_id"),
        F.concat("event_type", F.lit("_"), F.col("user_id").cast("string")).alias("wait_type"),
        value.alias("wait_time_ms"))
    conform(waits, "server_id int, wait_type string, wait_time_ms bigint").write.json(
        f"{folder}/wait_stats")
    return read_snapshot(spark, folder, "wait_stats", "json").select(
        "server_id", "wait_type", "wait_time_ms")


@query("append_rows", """
    SELECT o_orderstatus, 2 * count(*) AS orders FROM orders GROUP BY ALL""")
def append_rows(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark, "append")
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    sinks.append(orders, folder)
    sinks.append(orders, folder)
    return spark.read.parquet(folder).groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


@query("replace_table", """
    SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def replace_table(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark, "replace")
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    sinks.replace(orders, folder)
    sinks.replace(orders.filter("o_orderstatus <> 'P'"), folder)
    return spark.read.parquet(folder).groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


@query("refresh_by_server", """
    SELECT server_id, count(*) AS rows, max(version) AS version FROM (
      SELECT (o_custkey % 5)::INTEGER AS server_id,
             CASE WHEN o_custkey % 5 = 2 THEN 'new' ELSE 'old' END AS version
      FROM orders WHERE o_custkey % 5 <> 3) GROUP BY ALL""")
def refresh_by_server(spark: SparkSession, d: str) -> DataFrame:
    """Load all servers, then refresh two of them, one of which has no rows any more."""
    folder = work_folder(spark, "refresh")
    orders = read(spark, d, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 5).cast("int").alias("server_id"))
    sinks.refresh(orders.withColumn("version", F.lit("old")), folder)
    fresh = orders.filter("server_id <> 3").withColumn("version", F.lit("new"))
    sinks.refresh(fresh, folder, server_ids=[2, 3])
    return spark.read.parquet(folder).groupBy("server_id").agg(
        F.count("*").alias("rows"), F.max("version").alias("version"))


@query("clear_inventory", """
    SELECT 'cleared' AS step, 0 AS rows UNION ALL SELECT 'loaded', count(*) FROM events""")
def clear_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Load an inventory table, empty it, and load it again elsewhere."""
    cleared, loaded = work_folder(spark, "cleared"), work_folder(spark, "loaded")
    waits = conform(read(spark, d, "events").withColumnRenamed("event_type", "wait_type"),
                    SILVER["top_wait"])
    sinks.replace(waits, cleared)
    sinks.clear(spark, cleared, "top_wait")
    sinks.replace(waits, loaded)

    def counted(step: str, folder: str) -> DataFrame:
        return spark.read.parquet(folder).agg(F.lit(step).alias("step"),
                                              F.count("*").alias("rows"))

    return counted("cleared", cleared).unionByName(counted("loaded", loaded))


@query("collect_with_error_log", """
    SELECT 'part' AS name, count(*) AS rows FROM part
    UNION ALL SELECT 'error: broken', 1
    UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def collect_with_error_log(spark: SparkSession, d: str) -> DataFrame:
    """Three loads of which one fails: the others are stored, the failure is logged."""
    folder = work_folder(spark, "collect")
    tables, errors = sinks.collect_all(spark, {
        "part": lambda _: read(spark, d, "part"),
        "broken": lambda _: read_snapshot(spark, d, "part", "unknown format"),
        "supplier": lambda _: read(spark, d, "supplier")}, folder)
    out = errors.select(F.concat(F.lit("error: "), "command").alias("name"),
                        F.lit(1).cast("long").alias("rows"))
    for name, df in tables.items():
        out = out.unionByName(df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")))
    return out
