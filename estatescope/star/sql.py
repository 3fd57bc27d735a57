"""Shared pieces of the comparison SQL: star tables seen as snapshots, inventory and views."""

from __future__ import annotations

import re

PIECES: dict[str, str] = {}

# ------------------------------------------------------------------ star as snapshot
PIECES["x_db"] = """
    SELECT n_regionkey AS server_id, n_nationkey AS database_id, n_name AS database_name,
           r_name AS server_name
    FROM nation JOIN region ON r_regionkey = n_regionkey"""
PIECES["x_server"] = """
    SELECT r_regionkey AS server_id, r_name AS server_name, 'Server ' || r_name AS description,
           'Microsoft SQL Server ' || (CASE r_regionkey WHEN 0 THEN '2008' WHEN 1 THEN '2012'
             WHEN 2 THEN '2016' WHEN 3 THEN '2017' ELSE '2019' END) || ' (RTM)' AS version
    FROM region"""
PIECES["x_cust"] = """
    SELECT server_id, database_id, database_name, c_custkey AS object_id, c_name AS object_name,
           c_mktsegment AS schema_name, c_acctbal
    FROM customer JOIN x_db ON database_id = c_nationkey"""
PIECES["x_ord"] = """
    SELECT server_id, database_id, database_name, object_id, object_name, schema_name,
           (CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END)::BIGINT AS index_id,
           o_orderkey, o_orderpriority, o_orderstatus, floor(o_totalprice)::BIGINT AS pages,
           floor(o_totalprice * 100)::BIGINT AS cents
    FROM orders JOIN x_cust ON object_id = o_custkey"""
PIECES["x_line"] = """
    SELECT x_ord.*, l_partkey, l_linenumber, l_discount, l_returnflag
    FROM lineitem JOIN x_ord ON o_orderkey = l_orderkey"""
PIECES["x_supp"] = """
    SELECT server_id, database_id, database_name, s_suppkey, s_name, s_acctbal,
           floor(abs(s_acctbal))::BIGINT AS pages
    FROM supplier JOIN x_db ON database_id = s_nationkey"""
PIECES["x_work"] = """
    SELECT server_id, database_id, database_name, l_partkey, l_shipdate,
           floor(l_extendedprice)::BIGINT AS price
    FROM lineitem JOIN x_supp ON l_suppkey = s_suppkey"""
PIECES["x_doc"] = """
    SELECT server_id, database_id, database_name, doc_id, 'doc_' || doc_id AS object_name,
           lang AS schema_name,
           (CASE doc_id % 7 WHEN 0 THEN 'P' WHEN 1 THEN 'V' WHEN 2 THEN 'FN' WHEN 3 THEN 'IF'
             WHEN 4 THEN 'TF' WHEN 5 THEN 'F' ELSE 'C' END) AS xtype,
           text || chr(10) || 'NATION_' || ((doc_id % 25 + 5 * (doc_id % 4)) % 25) || '.t'
             || chr(10) || 'nation_' || ((doc_id % 25 + 5 * (doc_id % 3)) % 25) || '.t'
             AS definition
    FROM documents JOIN x_db ON database_id = doc_id % 25"""
PIECES["x_linked"] = """
    SELECT DISTINCT server_id, server_name,
           unnest(regexp_extract_all(text, '(\\w+)\\.', 1)) AS linked_server,
           'ODBC' AS provider_name, text AS datasource
    FROM benchmark JOIN x_server ON server_id = item_id % 5"""
PIECES["x_waits"] = """
    SELECT (user_id % 5)::INTEGER AS server_id, event_type || '_' || user_id AS wait_type,
           sum(floor(value)::BIGINT)::BIGINT AS wait_time,
           max(floor(value)::BIGINT) AS max_wait_time,
           (sum(floor(value)::BIGINT) // 3)::BIGINT AS signal
    FROM events GROUP BY ALL"""
PIECES["x_schedule"] = """
    SELECT event_id, (user_id % 5)::INTEGER AS server_id, user_id, event_type, ts,
           (1 << (event_id % 8)::INTEGER)::INTEGER AS freq_type, event_id % 128 AS ivl,
           (1 << (event_id % 5)::INTEGER)::INTEGER AS subday, event_id % 60 AS subday_ivl,
           (1 << (event_id % 6)::INTEGER)::INTEGER AS relative, event_id % 5 + 1 AS recurrence,
           20240101 + event_id % 28 AS start_date, event_id % 24 AS hh, event_id % 60 AS mm
    FROM events"""
PIECES["x_schedule_text"] = """
    SELECT *, CASE freq_type
        WHEN 1 THEN 'Once on ' || start_date || ' at ' || hh || ':' || lpad(mm::VARCHAR, 2, '0')
        WHEN 64 THEN 'When the agent starts'
        WHEN 128 THEN 'When the processors are idle'
        ELSE (CASE freq_type
          WHEN 4 THEN 'Every day '
          WHEN 8 THEN 'Every ' || recurrence || ' week(s) on ' || (
            CASE WHEN ivl % 128 = 0 THEN '' ELSE array_to_string([
              CASE WHEN ivl & 1 > 0 THEN 'Sunday' END, CASE WHEN ivl & 2 > 0 THEN 'Monday' END,
              CASE WHEN ivl & 4 > 0 THEN 'Tuesday' END,
              CASE WHEN ivl & 8 > 0 THEN 'Wednesday' END,
              CASE WHEN ivl & 16 > 0 THEN 'Thursday' END,
              CASE WHEN ivl & 32 > 0 THEN 'Friday' END,
              CASE WHEN ivl & 64 > 0 THEN 'Saturday' END], ', ') || ' ' END)
          WHEN 16 THEN 'Every ' || recurrence || ' months(s) on day ' || ivl || ' of that month '
          WHEN 32 THEN 'Every ' || recurrence || ' months(s) on the ' || (CASE relative
              WHEN 1 THEN 'first ' WHEN 2 THEN 'second ' WHEN 4 THEN 'third '
              WHEN 8 THEN 'fourth ' WHEN 16 THEN 'last ' END)
            || (CASE ivl WHEN 1 THEN 'Sunday' WHEN 2 THEN 'Monday' WHEN 3 THEN 'Tuesday'
              WHEN 4 THEN 'Wednesday' WHEN 5 THEN 'Thursday' WHEN 6 THEN 'Friday'
              WHEN 7 THEN 'Saturday' WHEN 8 THEN 'day' WHEN 9 THEN 'week day'
              WHEN 10 THEN 'weekend day' END) || ' of that month ' END)
          || (CASE subday
            WHEN 1 THEN 'at ' || lpad(hh::VARCHAR, 2, '0') || ':' || lpad(mm::VARCHAR, 2, '0')
            WHEN 2 THEN 'every ' || subday_ivl || ' second(s)'
            WHEN 4 THEN 'every ' || subday_ivl || ' minute(s)'
            WHEN 8 THEN 'every ' || subday_ivl || ' hour(s)' END)
          || (CASE WHEN subday = 1 THEN '' ELSE ' between ' || lpad(hh::VARCHAR, 2, '0') || ':'
            || lpad(mm::VARCHAR, 2, '0') || ' and 23:59' END)
        END AS schedule_dscr
    FROM x_schedule"""
PIECES["x_job_schedule"] = """
    SELECT * FROM x_schedule_text
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1"""
PIECES["x_job"] = """
    SELECT conv_id, (conv_id % 5)::INTEGER AS server_id, 'j' || conv_id AS job_id,
           'job_' || conv_id AS job_name, min(role) AS description, conv_id % 2 = 0 AS enabled
    FROM conversations GROUP BY conv_id"""

# ------------------------------------------------------------------------- inventory
PIECES["x_objects"] = """
    SELECT server_id, database_id, database_name, server_name, object_id, object_name,
           schema_name, 'U' AS xtype, row_count, length(object_name)::BIGINT AS row_length,
           NULL::VARCHAR AS sql_data_access, NULL::VARCHAR AS definition
    FROM x_cust
    JOIN x_server USING (server_id)
    LEFT JOIN (SELECT object_id, sum(cents)::BIGINT AS row_count FROM x_ord GROUP BY ALL)
      USING (object_id)
    UNION ALL
    SELECT server_id, database_id, database_name, server_name, doc_id, object_name, schema_name,
           xtype, NULL, NULL, 'MODIFIES', definition
    FROM x_doc JOIN x_server USING (server_id)"""
PIECES["x_columns"] = """
    SELECT server_id, database_id, database_name, object_id, object_name, schema_name,
           'C' || (l_partkey % 50) AS column_name, l_linenumber::BIGINT AS ordinal_position,
           CASE WHEN l_discount = 0.08 THEN '(getdate())' WHEN l_discount > 0.02 THEN '((0))' END
             AS column_default,
           l_partkey % 2 = 0 AS is_nullable,
           (CASE l_partkey % 8 WHEN 0 THEN 'int' WHEN 1 THEN 'varchar (20)'
             WHEN 2 THEN 'varchar(max)' WHEN 3 THEN 'nvarchar (max)' WHEN 4 THEN 'text'
             WHEN 5 THEN 'xml' WHEN 6 THEN 'geography' ELSE 'decimal (18,2)' END) AS data_type,
           CASE WHEN l_partkey % 8 IN (2, 3) THEN -1 ELSE 8 END AS max_length,
           l_discount = 0.1 AS is_computed,
           l_linenumber = 1 AND l_returnflag = 'A' AS is_identity
    FROM x_line"""
PIECES["x_indexes"] = """
    SELECT server_id, database_id, database_name, object_id, object_name, schema_name,
           CASE WHEN o_orderstatus = 'P' THEN 'LOB_DATA' ELSE 'IN_ROW_DATA' END AS allocation_desc,
           CASE WHEN o_orderstatus = 'O' THEN 'HEAP' ELSE 'CLUSTERED' END AS index_type,
           CASE WHEN o_orderstatus <> 'O' THEN 'ix_' || o_orderkey END AS index_name,
           o_orderpriority = '1-URGENT' AS is_unique, o_orderpriority = '5-LOW' AS is_disabled,
           pages AS size_mbs, pages // 2 AS used_size, pages AS data_size,
           o_orderkey % 1000 AS writes, o_orderkey % 777 AS reads, o_orderkey AS index_id,
           CASE WHEN o_orderstatus = 'F' THEN 'COLUMN STORE' ELSE 'NONE' END AS compression,
           CASE WHEN o_orderstatus <> 'O' THEN 'c' || (o_orderkey % 50) || ', c'
             || (o_orderkey % 7) END AS cols,
           CASE WHEN o_orderpriority = '2-HIGH' THEN 'c1' END AS included,
           CASE WHEN o_orderpriority = '3-MEDIUM' THEN '(x > 1)' END AS filter_definition
    FROM x_ord"""
PIECES["x_files"] = """
    SELECT server_id, database_id, database_name, s_suppkey::INTEGER AS file_id, s_name, pages,
           CASE WHEN s_acctbal >= 0 THEN 'PRIMARY' END AS filegroup_name
    FROM x_supp"""
PIECES["x_sequences"] = """
    SELECT server_id, database_id, database_name,
           schema_name || '.' || object_name || '_seq' AS sequence_name,
           schema_name || '.' || object_name AS parent_table, 'id' AS parent_column
    FROM x_ord GROUP BY ALL"""
PIECES["x_jobs"] = """
    SELECT x_job.server_id, x_job.job_id, job_name, description, x_job.enabled AS is_enabled,
           schedule_dscr, s_name AS operator, s_acctbal > 0 AS operator_enabled,
           lower(s_name) || '@example.org' AS operator_email_address,
           CASE WHEN conv_id % 4 < 3 THEN 'login_' || (conv_id % 4) END AS owner,
           st.role || '_' || st.turn AS start_step_name, event_id IS NOT NULL AS is_scheduled,
           event_type AS schedule_name,
           CASE freq_type WHEN 1 THEN 'Once' WHEN 4 THEN 'Daily' WHEN 8 THEN 'Weekly'
             WHEN 16 THEN 'Monthly' WHEN 32 THEN 'Monthly relative' END AS frequency,
           CASE subday WHEN 1 THEN 'At the specified time' WHEN 2 THEN 'Seconds'
             WHEN 4 THEN 'Minutes' WHEN 8 THEN 'Hours' END AS units,
           start_date, lpad(hh::VARCHAR, 2, '0') || ':' || lpad(mm::VARCHAR, 2, '0') || ':'
             || lpad(mm::VARCHAR, 2, '0') AS run_time,
           strftime(ts, '%b ') || lpad(day(ts)::VARCHAR, 2, ' ') || strftime(ts, ' %Y ')
             || lpad(strftime(ts, '%-I'), 2, ' ') || strftime(ts, ':%M%p') AS created_date
    FROM x_job
    LEFT JOIN (SELECT conv_id AS c, role, turn FROM conversations) st
      ON st.c = conv_id AND st.turn = conv_id % 3
    LEFT JOIN x_job_schedule ON x_job_schedule.user_id = conv_id
    LEFT JOIN supplier ON s_suppkey = conv_id % 10"""
PIECES["x_top_sql"] = """
    SELECT server_id, database_id, database_name, 'dbo.' || p_name || ' ' || l_partkey AS sp_name,
           sum(price)::BIGINT AS total_worker_time, count(*) AS execution_count,
           (sum(price) // count(*))::BIGINT AS avg_worker_time,
           (sum(price) // 7)::BIGINT AS total_elapsed_time,
           ((sum(price) // 7) // count(*))::BIGINT AS avg_elapsed_time,
           count(*) // date_diff('second', max(l_shipdate), TIMESTAMP '2030-01-01')
             AS calls_per_second,
           max(l_shipdate) AS cached_time
    FROM x_work JOIN part ON p_partkey = l_partkey
    GROUP BY server_id, database_id, database_name, p_name, l_partkey
    QUALIFY row_number() OVER (PARTITION BY server_id, database_id
      ORDER BY total_worker_time DESC, sp_name, l_partkey) <= 10"""
PIECES["x_top_wait"] = """
    SELECT * FROM (
      SELECT server_id, wait_type, max_wait_time AS wait_time_ms, signal AS signal_wait_time_ms,
           wait_time - signal AS resource_wait_time_ms,
           100.0::DOUBLE * wait_time / (sum(wait_time) OVER w)::DOUBLE AS percent_total_waits,
           100.0::DOUBLE * signal / (sum(signal) OVER w)::DOUBLE AS percent_total_signal_waits,
           100.0::DOUBLE * (wait_time - signal) / (sum(wait_time) OVER w)::DOUBLE
             AS percent_total_resource_waits
      FROM x_waits WHERE wait_time > 0
      WINDOW w AS (PARTITION BY server_id))
    QUALIFY row_number() OVER (PARTITION BY server_id
      ORDER BY percent_total_resource_waits DESC, wait_type) <= 40"""
PIECES["x_groups"] = """
    SELECT server_id, database_name AS availability_group, s_name AS replica_server_name,
           s_name = min(s_name) OVER (PARTITION BY database_id) AS is_primary_server,
           (s_suppkey % 3)::INTEGER AS readable_secondary, (s_suppkey % 2)::INTEGER AS synchronous,
           'AUTOMATIC' AS failover_mode_desc, 'HEALTHY' AS synchronization_health_desc
    FROM x_supp WHERE server_id > 0"""
PIECES["x_volumes"] = """
    SELECT DISTINCT server_id, (CASE s_suppkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'D'
             WHEN 2 THEN 'E' ELSE 'F' END) || ':\\' AS volume_mount_point,
           (s_suppkey % 4 + 1) * 100 AS total_gb,
           (((s_suppkey % 4 + 1) * 107374182400) // (database_id % 5 + 2) - 1) // 1073741824
             AS available_gb,
           ((2000 * (((s_suppkey % 4 + 1) * 107374182400) // (database_id % 5 + 2) - 1)
              + (s_suppkey % 4 + 1) * 107374182400)
             // (2 * (s_suppkey % 4 + 1) * 107374182400))::DOUBLE / 10 AS percentage_free
    FROM x_supp"""

# ----------------------------------------------------------------------------- views
_INDEX_ROLLUP = """count(*) AS indexes, sum(data_size)::BIGINT AS index_data_size,
           sum(used_size)::BIGINT AS index_used_size,
           sum(CASE WHEN is_unique THEN 1 ELSE 0 END)::BIGINT AS unique_indexes,
           sum(CASE WHEN included <> '' THEN 1 ELSE 0 END)::BIGINT AS included_column_indexes,
           sum(CASE WHEN filter_definition <> '' THEN 1 ELSE 0 END)::BIGINT AS filtered_indexes,
           sum(CASE WHEN compression LIKE '%COLUMN STORE%' THEN 1 ELSE 0 END)::BIGINT
             AS column_stores"""
PIECES["x_databases_view"] = f"""
    SELECT x_db.*, files, file_groups, data_mb, log_mb, format('{{:,}}', data_mb) AS data_mb_s,
           "rows", "tables", empty, small, medium, large, very_large, "views", procs, functions,
           "columns", indexes, index_data_size, index_used_size, unique_indexes,
           included_column_indexes, filtered_indexes, column_stores
    FROM x_db
    LEFT JOIN (SELECT database_id, count(*) AS files,
           count(DISTINCT filegroup_name) AS file_groups,
           sum(CASE WHEN filegroup_name IS NOT NULL THEN pages ELSE 0 END)::BIGINT AS data_mb,
           sum(CASE WHEN filegroup_name IS NULL THEN pages ELSE 0 END)::BIGINT AS log_mb
         FROM x_files GROUP BY ALL) USING (database_id)
    LEFT JOIN (SELECT database_id, sum(row_count)::BIGINT AS "rows",
           sum(CASE WHEN xtype = 'U' THEN 1 ELSE 0 END)::BIGINT AS "tables",
           sum(CASE WHEN xtype = 'U' AND coalesce(row_count, 0) = 0 THEN 1 ELSE 0 END)::BIGINT
             AS empty,
           sum(CASE WHEN xtype = 'U' AND row_count BETWEEN 1 AND 6000000 THEN 1 ELSE 0 END)::BIGINT
             AS small,
           sum(CASE WHEN xtype = 'U' AND row_count BETWEEN 6000001 AND 60000000
             THEN 1 ELSE 0 END)::BIGINT AS medium,
           sum(CASE WHEN xtype = 'U' AND row_count BETWEEN 60000001 AND 1000000000
             THEN 1 ELSE 0 END)::BIGINT AS large,
           sum(CASE WHEN xtype = 'U' AND row_count > 1000000000 THEN 1 ELSE 0 END)::BIGINT
             AS very_large,
           sum(CASE WHEN xtype = 'V' THEN 1 ELSE 0 END)::BIGINT AS "views",
           sum(CASE WHEN xtype = 'P' THEN 1 ELSE 0 END)::BIGINT AS procs,
           sum(CASE WHEN xtype IN ('TF', 'FN') THEN 1 ELSE 0 END)::BIGINT AS functions
         FROM x_objects GROUP BY ALL) USING (database_id)
    LEFT JOIN (SELECT database_id, count(*) AS "columns" FROM x_columns GROUP BY ALL)
      USING (database_id)
    LEFT JOIN (SELECT database_id, {_INDEX_ROLLUP} FROM x_indexes GROUP BY ALL)
      USING (database_id)"""
PIECES["x_index_view"] = """
    SELECT x_indexes.*, server_name, row_count,
           len(string_split(cols, ', ')) + coalesce(len(string_split(included, ', ')), 0)
             AS col_count
    FROM x_indexes
    JOIN x_server USING (server_id)
    LEFT JOIN (SELECT database_id, schema_name, object_name, row_count FROM x_objects)
      USING (database_id, schema_name, object_name)
    WHERE allocation_desc = 'IN_ROW_DATA'"""
PIECES["x_objects_view"] = f"""
    SELECT o.*, format('{{:,}}', row_count) AS row_count_s,
           coalesce(columns_count, 0) AS columns_count, has_identity,
           computed_columns, blob_columns, pk_name, pk_type, coalesce(k.writes, 0) AS writes,
           coalesce(k.reads, 0) AS reads, pk_cols, indexes, index_data_size, index_used_size,
           unique_indexes, included_column_indexes, filtered_indexes, column_stores
    FROM x_objects o
    LEFT JOIN (SELECT database_id, schema_name, object_name, index_name AS pk_name,
             index_type AS pk_type, writes, reads, cols AS pk_cols
           FROM x_index_view WHERE is_unique
           QUALIFY row_number() OVER (PARTITION BY database_id, schema_name, object_name
             ORDER BY index_id) = 1) k USING (database_id, schema_name, object_name)
    LEFT JOIN (SELECT database_id, schema_name, object_name, {_INDEX_ROLLUP}
           FROM x_index_view GROUP BY ALL) USING (database_id, schema_name, object_name)
    LEFT JOIN (SELECT database_id, schema_name, object_name, count(*) AS columns_count,
             sum(CASE WHEN is_identity THEN 1 ELSE 0 END)::BIGINT AS has_identity,
             sum(CASE WHEN is_computed THEN 1 ELSE 0 END)::BIGINT AS computed_columns,
             sum(CASE WHEN max_length = -1 THEN 1 ELSE 0 END)::BIGINT AS blob_columns
           FROM x_columns GROUP BY ALL) USING (database_id, schema_name, object_name)"""
PIECES["x_columns_view"] = """
    SELECT c.*, v.server_name, v.xtype, v.row_count, v.row_count_s, v.pk_name, v.pk_cols,
           CASE WHEN list_contains(string_split(v.pk_cols, ', '), lower(column_name))
             THEN 1 ELSE 0 END AS is_key
    FROM x_columns c JOIN x_objects_view v USING (database_id, schema_name, object_name)"""
PIECES["x_xserver"] = """
    SELECT database_id, server_id, database_name, schema_name, object_name, xtype, definition,
           min(linked_server) AS linked_server
    FROM x_objects JOIN x_linked USING (server_id)
    WHERE linked_server <> '' AND (contains(lower(definition), lower(linked_server) || '.')
      OR contains(lower(definition), lower(linked_server) || '].'))
    GROUP BY ALL"""
PIECES["x_xdatabase"] = """
    SELECT * FROM (
      SELECT o.database_id, o.server_id, o.database_name, schema_name, object_name, xtype,
             definition, min(d.database_name) AS x_database_name
      FROM x_objects o JOIN x_db d USING (server_id)
      WHERE contains(lower(definition), lower(d.database_name) || '.')
        OR contains(lower(definition), lower(d.database_name) || '].')
      GROUP BY ALL)
    WHERE x_database_name <> database_name"""
PIECES["x_routines"] = """
    SELECT *, CASE WHEN definition ILIKE '%for xml%' THEN 1 ELSE 0 END AS uses_for_xml,
           CASE WHEN definition ILIKE '%declare%cursor%' THEN 1 ELSE 0 END AS uses_cursor,
           CASE WHEN xtype IN ('TR', 'TT', 'X', 'UQ', 'AF', 'FS', 'FT', 'IT', 'F') THEN 1 ELSE 0
             END AS incompatible_type,
           CASE xtype WHEN 'P' THEN 'Stored procedure' WHEN 'V' THEN 'View'
             WHEN 'FN' THEN 'Scalar function' WHEN 'IF' THEN 'In-lined table-function'
             WHEN 'TF' THEN 'Table function' WHEN 'F' THEN 'FOREIGN KEY constraint'
             WHEN 'C' THEN 'CHECK constraint' WHEN 'U' THEN 'User table' END AS type_desc
    FROM x_objects"""
PIECES["x_column_flags"] = """
    SELECT *, CASE WHEN data_type IN ('xml', 'geography') THEN 1 ELSE 0 END AS incompatible_column,
           CASE WHEN is_computed THEN 1 ELSE 0 END AS computed_column,
           CASE WHEN data_type IN ('text', 'varchar(max)') OR is_computed THEN 1 ELSE 0 END
             AS large_text_column,
           CASE WHEN column_default LIKE '%()%' THEN 1 ELSE 0 END AS invalid_default
    FROM x_columns_view"""

_NAME = re.compile(r"\bx_[a-z_]+\b")


def expand(sql: str) -> str:
    """The query with a WITH clause of the pieces it uses, in dependency order."""
    used: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in PIECES and name not in used:
                visit(PIECES[name])
                if name not in used:
                    used.append(name)

    visit(sql)
    sql = sql.strip()
    if not used:
        return sql
    pieces = ",\n".join(f"{name} AS ({PIECES[name]})" for name in used)
    if sql.startswith("WITH "):
        return f"WITH {pieces},\n{sql[5:]}"
    return f"WITH {pieces}\n{sql}"
