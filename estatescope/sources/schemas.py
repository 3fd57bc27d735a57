"""Explicit schemas of the snapshot (bronze) and inventory (silver) tables, as DDL.

Every snapshot table carries ``server_id``, the per-database ones ``database_id`` too.
Nothing is ever inferred.
"""

from __future__ import annotations

_FLAGS = ["is_auto_create_stats_on", "is_auto_update_stats_on", "is_auto_update_stats_async_on",
          "is_parameterization_forced", "is_read_committed_snapshot_on", "is_auto_close_on",
          "is_auto_shrink_on", "is_published", "is_subscribed", "is_read_only", "is_cdc_enabled",
          "is_broker_enabled", "is_memory_optimized_elevate_to_snapshot_on", "is_encrypted"]

_MIRRORING = ["mirroring_state_desc", "mirroring_role_desc", "mirroring_safety_level_desc",
              "mirroring_partner_name", "mirroring_partner_instance", "mirroring_witness_name",
              "mirroring_witness_state_desc"]

DATABASE_FLAGS = _FLAGS
MIRRORING_FIELDS = [*_MIRRORING, "mirroring_connection_timeout", "mirroring_redo_queue"]

_SERVER = "server_id int, "
_DB = "server_id int, database_id int, "

BRONZE = {
    "servers": _SERVER + "server_name string, description string, version string, is_active boolean",
    "server_properties": _SERVER + (
        "server_name string, windows_release string, create_date timestamp, version string, "
        "edition string, product_level string, collation string, cpu_count int, "
        "hyperthread_ratio int, memory_kb bigint, vm_type string, build string, governor_enabled int"),
    "sysservers": _SERVER + (
        "srvname string, providername string, datasource string, location string, "
        "providerstring string"),
    "services": _SERVER + (
        "servicename string, startup_type int, startup_type_desc string, status int, "
        "status_desc string, process_id int, last_startup_time timestamp, service_account string, "
        "filename string, is_clustered string, cluster_nodename string"),
    "cluster_nodes": _SERVER + (
        "node_name string, status int, status_description string, is_current_owner boolean"),
    "availability_groups": _SERVER + "group_id string, name string",
    "availability_replicas": _SERVER + (
        "replica_id string, group_id string, replica_server_name string, "
        "secondary_role_allow_connections int, availability_mode int, failover_mode_desc string"),
    "availability_group_states": _SERVER + "group_id string, primary_replica string",
    "availability_replica_states": _SERVER + (
        "replica_id string, role int, is_local boolean, synchronization_health_desc string"),
    "availability_db_cluster_states": _SERVER + (
        "replica_id string, group_database_id string, database_name string, "
        "is_database_joined boolean"),
    "availability_db_replica_states": _SERVER + (
        "replica_id string, group_database_id string, synchronization_state int, "
        "is_suspended boolean"),
    "configurations": _SERVER + (
        "name string, value string, value_in_use string, minimum string, maximum string, "
        "description string, is_dynamic boolean, is_advanced boolean"),
    "databases": _DB + (
        "name string, recovery_model_desc string, compatibility_level string, "
        "page_verify_option_desc string, snapshot_isolation_state_desc string, state_desc string, "
        "create_date timestamp, collation_name string, source_database_id int, owner_sid string, "
        "containment_desc string, delayed_durability_desc string, "
        + ", ".join(f"{f} boolean" for f in _FLAGS)),
    "performance_counters": _SERVER + "instance_name string, counter_name string, cntr_value bigint",
    "master_files": _DB + "file_id int, type_desc string, size bigint",
    "buffer_descriptors": _DB.rstrip(", "),
    "query_stats": _SERVER + "dbid int, total_worker_time bigint",
    "virtual_file_stats": _DB + "num_of_bytes_read bigint, num_of_bytes_written bigint",
    "logins": _SERVER + "sid string, loginname string",
    "database_mirroring": _DB + (
        ", ".join(f"{f} string" for f in _MIRRORING)
        + ", mirroring_connection_timeout int, mirroring_redo_queue int"),
    "database_service_objectives": _DB + (
        "edition string, service_objective string, elastic_pool_name string"),
    "objects": _DB + (
        "object_id bigint, name string, schema_id int, type string, type_desc string, "
        "parent_object_id bigint, create_date timestamp"),
    "schemas": _DB + "schema_id int, name string",
    "tables": _DB + "object_id bigint, name string, schema_id int, is_published boolean, type string",
    "columns": _DB + (
        "object_id bigint, column_id bigint, name string, system_type_id int, user_type_id int, "
        "max_length int, precision int, scale int, is_nullable boolean, is_replicated boolean, "
        "is_computed boolean, is_identity boolean, collation_name string, default_object_id bigint"),
    "types": _DB + "system_type_id int, user_type_id int, name string",
    "default_constraints": _DB + "object_id bigint, definition string",
    "routines": _DB + "schema string, name string, sql_data_access string, definition string",
    "views": _DB + "schema string, name string, definition string",
    "check_constraints": _DB + "name string, is_disabled boolean, definition string",
    "foreign_keys": _DB + (
        "name string, is_disabled boolean, delete_referential_action_desc string"),
    "sequences": _DB + "object_id bigint, name string, start_value bigint, current_value bigint",
    "sequence_parent_values": _DB + "schema string, sequence_name string, value bigint",
    "indexes": _DB + (
        "object_id bigint, index_id bigint, name string, type_desc string, is_unique boolean, "
        "is_disabled boolean, filter_definition string, fill_factor int, data_space_id int"),
    "index_columns": _DB + (
        "object_id bigint, index_id bigint, column_id bigint, key_ordinal int, "
        "index_column_id int, is_included_column boolean"),
    "partitions": _DB + (
        "object_id bigint, index_id bigint, partition_id bigint, hobt_id bigint, rows bigint, "
        "data_compression_desc string"),
    "allocation_units": _DB + (
        "type int, type_desc string, container_id bigint, total_pages bigint, used_pages bigint, "
        "data_pages bigint, data_space_id int"),
    "data_spaces": _DB + "data_space_id int, name string",
    "filegroups": _DB + "data_space_id int",
    "database_files": _DB + (
        "data_space_id int, file_id int, name string, physical_name string, size bigint, "
        "space_used bigint"),
    "index_usage_stats": _DB + (
        "object_id bigint, index_id bigint, user_seeks bigint, user_scans bigint, "
        "user_lookups bigint, user_updates bigint"),
    "procedures": _DB + "object_id bigint, schema_id int, name string",
    "procedure_stats": _DB + (
        "object_id bigint, total_worker_time bigint, execution_count bigint, "
        "total_elapsed_time bigint, cached_time timestamp"),
    "wait_stats": _SERVER + (
        "wait_type string, wait_time_ms bigint, max_wait_time_ms bigint, "
        "signal_wait_time_ms bigint"),
    "volume_stats": _DB + (
        "file_id int, volume_mount_point string, total_bytes bigint, available_bytes bigint"),
    "jobs": _SERVER + (
        "job_id string, name string, description string, enabled boolean, start_step_id int, "
        "owner_sid string, notify_email_operator_id int"),
    "jobsteps": _SERVER + (
        "job_id string, step_id int, step_name string, database_name string, command string"),
    "jobschedules": _SERVER + "job_id string, schedule_id bigint, next_run_time int",
    "schedules": _SERVER + (
        "schedule_id bigint, schedule_uid string, name string, freq_type int, freq_interval int, "
        "freq_subday_type int, freq_subday_interval int, freq_relative_interval int, "
        "freq_recurrence_factor int, active_start_date int, active_end_date int, "
        "active_start_time int, active_end_time int, date_created timestamp"),
    "operators": _SERVER + "id int, name string, enabled boolean, email_address string",
}

# The name columns *_key are the comparison form (no case) that joins use.
_KEYS = ", schema_key string, object_key string"

SILVER = {
    "servers": _SERVER + (
        "server_name string, description string, windows_release string, created_date timestamp, "
        "version string, edition string, product_level string, collation string, "
        "logical_cpu_count int, hyperthread_ratio int, physical_cpu_count int, "
        "physical_memory_mb bigint, vm_type string, build string, governor_functions int, "
        "is_active boolean"),
    "jobs": _SERVER + (
        "job_id string, job_name string, description string, is_enabled boolean, "
        "schedule_dscr string, operator string, operator_enabled boolean, "
        "operator_email_address string, owner string, start_step_name string, "
        "is_scheduled boolean, schedule_name string, frequency string, units string, "
        "active_start_date timestamp, active_end_date timestamp, run_time string, "
        "created_date string"),
    "databases": _DB + (
        "database_name string, recovery_model string, log_size_kb bigint, log_used_kb bigint, "
        "log_used_percentage string, compatibility_level string, page_verify_option string, "
        "snapshot_isolation_state_desc string, target_recovery_time_in_seconds int, "
        "data_mb bigint, log_mb bigint, state_desc string, create_date timestamp, "
        "collation string, cached_size_mbs bigint, cpu_time bigint, io_mbs bigint, "
        "delayed_durability_desc string, containment_desc string, availability_group string, "
        "primary_replica string, local_replica_role int, synchronization_state int, "
        "is_suspended boolean, is_joined boolean, source_database_name string, owner string, "
        "edition string, service_objective string, elastic_pool_name string, "
        + ", ".join(f"{f} boolean" for f in _FLAGS) + ", "
        + ", ".join(f"{f} string" for f in _MIRRORING)
        + ", mirroring_connection_timeout int, mirroring_redo_queue int"),
    "objects": _DB + (
        "object_id bigint, object_name string, schema_name string, xtype string, "
        "row_count bigint, row_length bigint, col_count bigint, repl_columns bigint, "
        "has_cr_dt boolean, sql_data_access string, text_key binary, "
        "is_mspublished boolean, is_rplpublished boolean, is_rplsubscribed boolean, "
        "is_disabled boolean, parent_object_id bigint, start_value bigint, current_value bigint, "
        "parent_schema string, parent_table string, parent_column string, crdate timestamp"
        + _KEYS),
    "texts": "text_key binary, routine_definition string",
    "index_usage": _DB + (
        "object_id bigint, data_space string, allocation_desc string, table_schema string, "
        "object_type string, table_name string, index_type string, index_name string, "
        "is_unique boolean, is_disabled boolean, database_file string, size_mbs bigint, "
        "used_size bigint, data_size bigint, writes bigint, reads bigint, index_id bigint, "
        "fill_factor int, data_compression_desc string, cols array<string>, "
        "included array<string>, filter_definition string" + _KEYS),
    "database_files": _DB + (
        "file_id int, file_name string, physical_name string, total_mbs int, available_mbs int, "
        "filegroup_name string"),
    "columns": _DB + (
        "object_id bigint, table_catalog string, table_schema string, table_name string, "
        "column_name string, ordinal_position bigint, column_default string, "
        "is_nullable boolean, data_type string, character_maximum_length int, "
        "collation_name string, is_computed boolean, is_identity boolean" + _KEYS),
    "availability_groups": _SERVER + (
        "availability_group string, replica_server_name string, is_primary_server boolean, "
        "readable_secondary int, synchronous int, failover_mode_desc string, "
        "synchronization_health_desc string"),
    "cluster_nodes": BRONZE["cluster_nodes"],
    "top_sql": _DB + (
        "sp_name string, total_worker_time bigint, avg_worker_time bigint, "
        "execution_count bigint, calls_per_second bigint, total_elapsed_time bigint, "
        "avg_elapsed_time bigint, cached_time timestamp"),
    "top_wait": _SERVER + (
        "wait_type string, wait_time_ms bigint, signal_wait_time_ms bigint, "
        "resource_wait_time_ms bigint, percent_total_waits double, "
        "percent_total_signal_waits double, percent_total_resource_waits double"),
    "volumes": _SERVER + (
        "volume_mount_point string, total_gb bigint, available_gb bigint, "
        "percentage_free decimal(9,2)"),
    "services": BRONZE["services"],
    "job_steps": _SERVER + (
        "job_id string, job_name string, schedule_dscr string, enabled boolean, step_id int, "
        "step_name string, database_name string, command string"),
    "sequences": _DB + (
        "sequence_name string, current_value bigint, parent_table string, parent_column string, "
        "max_existing bigint, next_in_use bigint, is_max int, is_behind boolean, gap bigint"),
    "sys_configurations": _SERVER + (
        "server_name string, name string, value string, value_in_use string, minimum string, "
        "maximum string, description string, is_dynamic boolean, is_advanced boolean"),
    "linked_servers": _SERVER + (
        "server_name string, linked_server string, provider_name string, datasource string, "
        "location string, provider_string string"),
    "exec_errors": "dt timestamp, message string, command string",
}
