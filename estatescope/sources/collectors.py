"""Snapshot tables -> inventory tables, for all servers and databases in one plan.

Each collector takes and returns DataFrames.  ``mode="reference"`` keeps the
visible peculiarities of the published computation, ``mode="intended"`` computes
what was meant; see the README for the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from estatescope.functions import fixed_values as fv
from estatescope.functions.scalars import (
    bytes_to_gb, clock_text, datetime_text, format_type, int_date, kind_code, like_ci,
    major_version, name_key, pages_to_mb, percent_used, seconds_between, whole_div,
)
from estatescope.functions.schedule import frequency_name, schedule_description, unit_name
from estatescope.operators.aggregates import ordered_names, sequence_gap
from estatescope.operators.filters import any_like, eligible_databases, only_for, rows_not_in
from estatescope.operators.joins import (
    disjunctive_join, first_per_group, left_lookup, left_where, not_loaded, rollup_left, update_from,
)
from estatescope.operators.windows import share_of_total, top_n_per_group
from estatescope.sources.schemas import DATABASE_FLAGS, MIRRORING_FIELDS
from estatescope.sources.texts import text_key

DB = ["server_id", "database_id"]
OBJ = [*DB, "object_id"]
IDX = [*OBJ, "index_id"]
NAMED = [*DB, "schema_key", "object_key"]

__all__ = [
    "load_availability_groups", "load_cluster_nodes", "load_columns", "load_database_files",
    "load_database_objects", "load_databases", "load_index_usage", "load_job_steps", "load_jobs",
    "load_linked_servers", "load_sequences", "load_servers", "load_services",
    "load_sys_configurations", "load_top_sql", "load_top_wait", "load_volumes", "version_family",
]


def version_family(version: Column) -> Column:
    """Server generation: 2000, 2005, 2008, 2012, azure or latest."""
    v = F.coalesce(version, F.lit(fv.UNKNOWN_VERSION))
    known = [F.when(like_ci(v, pattern), name) for name, pattern in fv.GENERATIONS.items()]
    return F.coalesce(*known, F.lit("latest"))


# ---------------------------------------------------------------- server level

def load_servers(servers: DataFrame, props: DataFrame) -> DataFrame:
    """Servers with their properties; what a generation does not report is NULL.

    Only servers with a property row (matched by name) change.
    """
    known = servers.select(name_key(F.col("server_name")).alias("_name"),
                           version_family(F.col("version")).alias("_family"),
                           like_ci(F.col("version"), fv.CLOUD_PATTERN).alias("_azure"))
    family = F.when(F.coalesce("_azure", F.lit(False)), "azure").otherwise(F.col("_family"))
    since_2005 = ["2005", "2008", "2012", "latest"]
    newest = ["2012", "latest"]
    fresh = (
        props.withColumn("_name", name_key(F.col("server_name"))).drop("server_name", "server_id")
        .withColumnRenamed("version", "_version")
        .join(known, "_name").withColumn("_f", family)
        .select(
            "_name",
            only_for(F.col("windows_release"), F.col("_f"), newest).alias("windows_release"),
            only_for(F.col("create_date"), F.col("_f"), since_2005).alias("created_date"),
            F.col("_version").alias("version"), "edition", "product_level", "collation",
            only_for(F.col("cpu_count"), F.col("_f"), since_2005).alias("logical_cpu_count"),
            only_for(F.col("hyperthread_ratio"), F.col("_f"), since_2005)
            .alias("hyperthread_ratio"),
            only_for(whole_div(F.col("cpu_count"), F.nullif("hyperthread_ratio", F.lit(0))),
                     F.col("_f"), since_2005).cast("int").alias("physical_cpu_count"),
            only_for(whole_div(F.col("memory_kb"), 1024), F.col("_f"), since_2005)
            .alias("physical_memory_mb"),
            only_for(F.col("vm_type"), F.col("_f"), newest).alias("vm_type"),
            "build",
            only_for(F.col("governor_enabled"), F.col("_f"), ["2008", *newest])
            .alias("governor_functions")))
    target = servers.withColumn("_name", name_key(F.col("server_name")))
    columns = [c for c in fresh.columns if c != "_name"]
    return update_from(target, fresh, ["_name"], columns).drop("_name")


def load_linked_servers(servers: DataFrame, sysservers: DataFrame) -> DataFrame:
    """Linked servers by server; every one once."""
    return (sysservers.join(servers.select("server_id", "server_name"), "server_id")
            .select("server_id", "server_name", F.col("srvname").alias("linked_server"),
                    F.col("providername").alias("provider_name"), "datasource", "location",
                    F.col("providerstring").alias("provider_string"))
            .distinct())


def load_services(services: DataFrame) -> DataFrame:
    return services.distinct()


def load_cluster_nodes(nodes: DataFrame, servers: DataFrame) -> DataFrame:
    """Distinct cluster nodes; the 2008 generation reports names only."""
    years = servers.select("server_id", major_version(F.col("version")).alias("_year"))
    old = F.coalesce(F.col("_year").isin("2008"), F.lit(False))
    return (nodes.join(years, "server_id")
            .select("server_id", "node_name",
                    *[F.when(~old, F.col(c)).alias(c)
                      for c in ("status", "status_description", "is_current_owner")])
            .distinct())


def load_availability_groups(groups: DataFrame, replicas: DataFrame, group_states: DataFrame,
                             replica_states: DataFrame, servers: DataFrame) -> DataFrame:
    """Replicas of each availability group, on servers whose generation has them."""
    able = servers.filter(any_like(F.col("version"), fv.GROUP_VERSIONS)
                          & ~like_ci(F.col("edition"), fv.CLOUD_PATTERN)).select("server_id")
    group, replica = ["server_id", "group_id"], ["server_id", "replica_id"]
    primary = F.coalesce(
        F.lower("primary_replica") == F.lower("replica_server_name"), F.lit(False))
    return (groups.join(able, "server_id").join(replicas, group)
            .join(group_states, group)
            .join(replica_states.select(*replica, "synchronization_health_desc"), replica)
            .select("server_id", F.col("name").alias("availability_group"), "replica_server_name",
                    primary.alias("is_primary_server"),
                    F.col("secondary_role_allow_connections").alias("readable_secondary"),
                    F.col("availability_mode").alias("synchronous"), "failover_mode_desc",
                    "synchronization_health_desc"))


def load_sys_configurations(servers: DataFrame, configurations: DataFrame) -> DataFrame:
    return (configurations.join(servers.select("server_id", "server_name"), "server_id")
            .select("server_id", "server_name", "name", "value", "value_in_use", "minimum",
                    "maximum", "description", "is_dynamic", "is_advanced"))


def load_top_wait(waits: DataFrame, ignore: list[str] = fv.IGNORED_WAITS, n: int = 40,
                  mode: str = "reference") -> DataFrame:
    """Waits that matter, their shares of the server's total, and the ``n`` largest.

    Ordered by the share of resource waits.  In ``reference`` mode the stored wait
    time is the longest single wait.
    """
    kept = (waits.filter((F.col("wait_time_ms") > 0) & rows_not_in(F.col("wait_type"), ignore))
            .withColumn("resource_wait_time_ms",
                        F.col("wait_time_ms") - F.col("signal_wait_time_ms")))
    total, signal = F.col("wait_time_ms"), F.col("signal_wait_time_ms")
    shared = share_of_total(
        kept, ["server_id"],
        percent_total_waits=(total, total),
        percent_total_signal_waits=(signal, signal),
        percent_total_resource_waits=(F.col("resource_wait_time_ms"), total))
    shown = F.col("max_wait_time_ms" if mode == "reference" else "wait_time_ms")
    return (top_n_per_group(shared, ["server_id"], n,
                            F.desc("percent_total_resource_waits"), F.asc("wait_type"))
            .select("server_id", "wait_type", shown.alias("wait_time_ms"), "signal_wait_time_ms",
                    "resource_wait_time_ms", "percent_total_waits", "percent_total_signal_waits",
                    "percent_total_resource_waits"))


def load_volumes(files: DataFrame, volume_stats: DataFrame, servers: DataFrame) -> DataFrame:
    """Distinct volumes that hold database files, with sizes in whole GB."""
    able = servers.filter(any_like(F.col("version"), fv.VOLUME_VERSIONS)
                          & ~like_ci(F.col("version"), fv.GENERATIONS["azure"])).select("server_id")
    # A file is one row per key, so a semi join is enough and multiplies nothing.
    held = volume_stats.join(files.select(*DB, "file_id"), [*DB, "file_id"], "left_semi")
    return (held.join(able, "server_id")
            .select("server_id", "volume_mount_point",
                    bytes_to_gb(F.col("total_bytes")).alias("total_gb"),
                    bytes_to_gb(F.col("available_bytes")).alias("available_gb"),
                    percent_used(F.col("available_bytes"), F.col("total_bytes"), 3)
                    .cast("decimal(9,2)").alias("percentage_free"))
            .distinct())


# ------------------------------------------------------------------------ jobs

_SCHEDULE_CODES = [
    "freq_type", "freq_interval", "freq_subday_type", "freq_subday_interval",
    "freq_relative_interval", "freq_recurrence_factor", "active_start_date", "active_end_date",
    "active_start_time", "active_end_time",
]


def _job_schedules(jobschedules: DataFrame, schedules: DataFrame) -> DataFrame:
    """The first schedule (smallest id) of each job, with its text."""
    first = first_per_group(jobschedules, ["server_id", "job_id"],
                            [F.asc("schedule_id"), F.asc("next_run_time")])
    text = schedule_description(*[F.col(c) for c in _SCHEDULE_CODES])
    described = schedules.select(
        "server_id", "schedule_id", "schedule_uid", F.col("name").alias("schedule_name"),
        *_SCHEDULE_CODES, "date_created", text.alias("schedule_dscr"))
    return first.join(described, ["server_id", "schedule_id"], "left")


def load_jobs(jobs: DataFrame, steps: DataFrame, jobschedules: DataFrame, schedules: DataFrame,
              operators: DataFrame, logins: DataFrame, mode: str = "reference") -> DataFrame:
    """Jobs with start step, schedule, operator and owner."""
    start_steps = steps.select("server_id", "job_id", F.col("step_id").alias("start_step_id"),
                               F.col("step_name").alias("start_step_name"))
    staff = operators.select("server_id", F.col("id").alias("notify_email_operator_id"),
                             F.col("name").alias("operator"),
                             F.col("enabled").alias("operator_enabled"),
                             F.col("email_address").alias("operator_email_address"))
    owners = logins.select("server_id", F.col("sid").alias("owner_sid"),
                           F.col("loginname").alias("owner"))
    df = (jobs.join(start_steps, ["server_id", "job_id", "start_step_id"], "left")
          .join(_job_schedules(jobschedules, schedules), ["server_id", "job_id"], "left"))
    df = left_lookup(df, staff, ["server_id", "notify_email_operator_id"],
                     F.col("notify_email_operator_id").isNotNull(), ["job_id"])
    return (
        df.join(owners, ["server_id", "owner_sid"], "left")
        .select("server_id", "job_id", F.col("name").alias("job_name"), "description",
                F.col("enabled").alias("is_enabled"), "schedule_dscr", "operator",
                "operator_enabled", "operator_email_address", "owner", "start_step_name",
                F.col("schedule_uid").isNotNull().alias("is_scheduled"), "schedule_name",
                frequency_name(F.col("freq_type"), mode).alias("frequency"),
                unit_name(F.col("freq_subday_type")).alias("units"),
                int_date(F.col("active_start_date")).alias("active_start_date"),
                int_date(F.col("active_end_date")).alias("active_end_date"),
                clock_text(F.col("next_run_time")).alias("run_time"),
                datetime_text(F.col("date_created")).alias("created_date"))
        .distinct())


def load_job_steps(jobs: DataFrame, steps: DataFrame, jobschedules: DataFrame,
                   schedules: DataFrame, loaded_jobs: DataFrame) -> DataFrame:
    """Steps of every loaded job (one row without step for a job that has none)."""
    loaded = loaded_jobs.select("server_id", "job_id")
    return (
        jobs.join(loaded, ["server_id", "job_id"])
        .join(steps, ["server_id", "job_id"], "left")
        .join(_job_schedules(jobschedules, schedules)
              .select("server_id", "job_id", "schedule_dscr"), ["server_id", "job_id"], "left")
        .select("server_id", "job_id", F.col("name").alias("job_name"), "schedule_dscr", "enabled",
                "step_id", "step_name", "database_name", "command"))


# -------------------------------------------------------------- database level

def load_databases(b: dict[str, DataFrame]) -> DataFrame:
    """One row per database, whatever generation its server is.

    All generations go through the same joins; a field the generation lacks is blanked
    afterwards.  Needs silver ``servers`` and the snapshot tables.
    """
    families = b["servers"].select("server_id", version_family(F.col("version")).alias("_f"))

    def counter(pattern: str, name: str) -> DataFrame:
        return (b["performance_counters"].filter(like_ci(F.col("counter_name"), pattern))
                .select("server_id", name_key(F.col("instance_name")).alias("_db"),
                        F.col("cntr_value").alias(name)))

    sizes = counter("log file(s) size (kb)%", "log_size_kb")
    used = counter("log file(s) used size (kb)%", "log_used_kb")
    is_rows = F.lower("type_desc") == "rows"
    is_log = F.lower("type_desc") == "log"
    mb = pages_to_mb(F.col("size"))
    groups = _database_groups(b)
    sources = b["databases"].select("server_id", F.col("database_id").alias("source_database_id"),
                                    F.col("name").alias("source_database_name"))
    owners = b["logins"].select("server_id", F.col("sid").alias("owner_sid"),
                                F.col("loginname").alias("owner"))
    work = b["query_stats"].withColumnRenamed("dbid", "database_id")

    df = b["databases"].withColumn("_db", name_key(F.col("name"))).join(families, "server_id")
    df = df.join(used, ["server_id", "_db"], "left")
    df = left_where(df, sizes, ["server_id", "_db"], F.col("log_size_kb") > 0)
    df = rollup_left(df, b["master_files"], DB,
                     data_mb=F.sum(F.when(is_rows, mb)), log_mb=F.sum(F.when(is_log, mb)))
    df = rollup_left(df, b["buffer_descriptors"], DB, _buffers=F.count(F.lit(1)))
    df = rollup_left(df, work, DB, cpu_time=F.sum("total_worker_time"))
    df = rollup_left(df, b["virtual_file_stats"], DB, io_mbs=whole_div(
        F.sum(F.col("num_of_bytes_read") + F.col("num_of_bytes_written")), 1048576))
    df = (df.join(groups, ["server_id", "_db"], "left")
          .join(sources, ["server_id", "source_database_id"], "left")
          .join(owners, ["server_id", "owner_sid"], "left")
          .join(b["database_mirroring"], DB, "left")
          .join(b["database_service_objectives"], DB, "left"))

    f = F.col("_f")
    on_premises = ["2005", "2008", "2012", "latest"]
    measured = ["2012", "latest"]
    any_named = [*on_premises, "azure"]

    def field(c: Column | str, families: list[str], name: str | None = None) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        out = only_for(c, f, families)
        return out.alias(name) if name else out

    def zero_on(c: Column, zero: list[str], name: str) -> Column:
        return F.when(f.isin(zero), F.lit(0)).otherwise(c).cast("long").alias(name)

    cached = whole_div(F.coalesce("_buffers", F.lit(0)) * 8, 1024)
    flag_families = {
        "is_cdc_enabled": ["2008", *measured, "azure"],
        "is_encrypted": ["2008", *measured, "azure"],
        "is_memory_optimized_elevate_to_snapshot_on": ["latest"],
    }
    return df.select(
        "server_id", "database_id", F.col("name").alias("database_name"),
        field("recovery_model_desc", any_named, "recovery_model"),
        field("log_size_kb", on_premises, "log_size_kb"),
        field("log_used_kb", on_premises, "log_used_kb"),
        field(percent_used(F.col("log_used_kb"), F.col("log_size_kb"), 2).cast("string"),
              on_premises, "log_used_percentage"),
        field("compatibility_level", any_named, "compatibility_level"),
        field("page_verify_option_desc", any_named, "page_verify_option"),
        field("snapshot_isolation_state_desc", any_named, "snapshot_isolation_state_desc"),
        F.when(f == "azure", 0).when(f != "2000", -1).alias("target_recovery_time_in_seconds"),
        zero_on(field("data_mb", on_premises), ["azure"], "data_mb"),
        zero_on(field("log_mb", on_premises), ["azure"], "log_mb"),
        field("state_desc", any_named, "state_desc"),
        field("create_date", any_named, "create_date"),
        field("collation_name", any_named, "collation"),
        zero_on(field(cached, measured), ["2005", "2008", "azure"], "cached_size_mbs"),
        zero_on(field("cpu_time", measured), ["azure"], "cpu_time"),
        zero_on(field("io_mbs", measured), ["2005", "2008", "azure"], "io_mbs"),
        field("delayed_durability_desc", ["latest"], "delayed_durability_desc"),
        field("containment_desc", [*measured, "azure"], "containment_desc"),
        *[field(c, measured, c) for c in (
            "availability_group", "primary_replica", "local_replica_role",
            "synchronization_state", "is_suspended", "is_joined")],
        field("source_database_name", on_premises, "source_database_name"),
        field("owner", on_premises, "owner"),
        *[field(c, ["azure"], c) for c in (
            "edition", "service_objective", "elastic_pool_name")],
        *[field(c, flag_families.get(c, any_named), c) for c in DATABASE_FLAGS],
        *[field(c, on_premises, c) for c in MIRRORING_FIELDS],
    )


def _database_groups(b: dict[str, DataFrame]) -> DataFrame:
    """Availability-group state of each replicated database on its local server."""
    group, replica = ["server_id", "group_id"], ["server_id", "replica_id"]
    local = b["availability_replica_states"].filter("is_local").select(
        *replica, F.coalesce("role", F.lit(3)).alias("local_replica_role"))
    states = b["availability_db_replica_states"].select(
        *replica, "group_database_id", "synchronization_state", "is_suspended")
    return (
        b["availability_groups"].select(*group, F.col("name").alias("availability_group"))
        .join(b["availability_group_states"], group, "left")
        .join(b["availability_replicas"].select(*group, "replica_id"), group)
        .join(local, replica)
        .join(b["availability_db_cluster_states"], replica)
        .join(states, [*replica, "group_database_id"], "left")
        .select("server_id", name_key(F.col("database_name")).alias("_db"), "availability_group",
                F.col("primary_replica"), "local_replica_role",
                F.coalesce("synchronization_state", F.lit(0)).alias("synchronization_state"),
                F.coalesce("is_suspended", F.lit(False)).alias("is_suspended"),
                F.coalesce("is_database_joined", F.lit(False)).alias("is_joined")))


def with_server_name(databases: DataFrame, servers: DataFrame) -> DataFrame:
    return databases.join(servers.select("server_id", "server_name"), "server_id")


def _only(df: DataFrame, databases: DataFrame) -> DataFrame:
    """Rows of the given databases only."""
    return df.join(databases.select(*DB), DB, "left_semi")


def load_top_sql(procs: DataFrame, stats: DataFrame, schemas: DataFrame, as_of: Column,
                 n: int = 10, databases: DataFrame | None = None) -> DataFrame:
    """The ``n`` procedures of each database with most worker time.

    ``as_of`` is the time of the snapshot.  ``databases`` limits to online ones.
    """
    if databases is not None:
        stats = _only(stats, databases.filter(F.lower("state_desc") == "online"))
    named = (procs.join(schemas.select(*DB, "schema_id", F.col("name").alias("_schema")),
                        [*DB, "schema_id"])
             .select(*OBJ, F.concat("_schema", F.lit("."), "name").alias("sp_name")))
    # Rank before naming would drop procedures without a name too late, so join first.
    return top_sql(stats.join(named, OBJ), as_of, n)


def top_sql(named_stats: DataFrame, as_of: Column, n: int = 10) -> DataFrame:
    """The ``n`` procedures of each database with most worker time, of statistics that have their ``sp_name``.

    The ranking keeps n rows per database and task."""
    top = top_n_per_group(named_stats, DB, n,
                          F.desc("total_worker_time"), F.asc("sp_name"), F.asc("object_id"))
    calls, age = F.col("execution_count"), seconds_between(F.col("cached_time"), as_of)
    per_call = F.nullif(calls, F.lit(0))
    return top.select(
        *DB, "sp_name", "total_worker_time",
        whole_div(F.col("total_worker_time"), per_call).alias("avg_worker_time"),
        "execution_count",
        F.when(age > 0, whole_div(calls, F.nullif(age, F.lit(0)))).otherwise(F.lit(0))
        .cast("long").alias("calls_per_second"),
        "total_elapsed_time",
        F.when(calls > 0, whole_div(F.col("total_elapsed_time"), per_call)).otherwise(F.lit(0))
        .cast("long").alias("avg_elapsed_time"),
        "cached_time")


def load_database_files(files: DataFrame, spaces: DataFrame, databases: DataFrame) -> DataFrame:
    """Files with size and free space in MB.  ``databases`` must carry ``server_name``."""
    eligible = eligible_databases(databases, exclude=(), skip_warehouse=True)

    def mb(c: Column) -> Column:
        # 128 pages to the MB, rounded to two digits and kept as a whole number.
        return (c.cast("decimal(19,0)") / F.lit(128)).cast("decimal(10,2)").cast("int")

    return (_only(files, eligible)
            .join(spaces.select(*DB, "data_space_id", F.col("name").alias("filegroup_name")),
                  [*DB, "data_space_id"], "left")
            .select(*DB, "file_id", F.col("name").alias("file_name"), "physical_name",
                    mb(F.col("size")).alias("total_mbs"),
                    mb(F.col("size") - F.col("space_used")).alias("available_mbs"),
                    "filegroup_name"))


def load_database_objects(b: dict[str, DataFrame], databases: DataFrame,
                          mode: str = "reference") -> DataFrame:
    """Objects with row count, column rollup, the key of their text and sequence values.

    ``databases`` is the silver table with ``server_name``.  Data-warehouse databases and the
    generations without sequences lack the fields they do not have.
    """
    eligible = (eligible_databases(databases, ("reportservertempdb", "model", "tempdb"), False)
                .join(b["servers"].select("server_id", version_family(F.col("version"))
                                          .alias("_f")), "server_id")
                .select(*DB, (F.lower(F.coalesce("edition", F.lit(""))) == "datawarehouse")
                        .alias("_warehouse"), "_f"))
    schemas = b["schemas"].select(*DB, "schema_id", F.col("name").alias("schema_name"))
    has_sequences = ~F.col("_warehouse") & ~F.col("_f").isin("2008", "azure")
    kinds = [k for k in fv.OBJECT_KINDS if k != "SO"]
    objects = (
        b["objects"].withColumn("xtype", kind_code(F.col("type")))
        .filter(F.col("xtype").isin(fv.OBJECT_KINDS) & ~like_ci(F.col("name"), "syncobj%"))
        .join(eligible, DB)
        .filter(F.col("xtype").isin(kinds) | has_sequences)
        .join(schemas, [*DB, "schema_id"])
        .withColumn("schema_key", name_key(F.col("schema_name")))
        .withColumn("object_key", name_key(F.col("name"))))

    # Everything known by object id: one row per object on the right of each join.
    is_table = F.col("xtype") == "U"
    has_columns = F.col("xtype").isin("U", "V")
    length = F.col("max_length") if mode == "reference" else F.when(
        F.col("max_length") != -1, F.col("max_length"))

    def named(n: str) -> Column:
        return F.sum(F.when(F.lower("name") == n, 1).otherwise(0))

    published = b["tables"].select(*OBJ, F.col("is_published").alias("_published"))
    sequences = b["sequences"].select(*OBJ, "start_value", "current_value")
    df = rollup_left(objects, b["partitions"].filter(F.col("index_id") < 2), OBJ,
                     _rows=F.sum("rows"))
    df = rollup_left(
        df, b["columns"], OBJ, _length=F.sum(length), _columns=F.count(F.lit(1)),
        _replicated=F.sum(F.when(F.col("is_replicated"), 1).otherwise(0)),
        _created=named("datecreated"), _rv=named("rv"), _source=named("sourcerv"))
    df = df.join(published, OBJ, "left").join(sequences, OBJ, "left")

    # A sequence's table carries its name without "_seq".
    is_sequence = F.col("xtype") == "SO"
    df = df.withColumn("_parent_key", F.when(
        is_sequence, F.replace("object_key", F.lit("_seq"), F.lit(""))))
    df = left_lookup(df, _sequence_parents(b), [*DB, "_parent_key"], is_sequence, ["object_id"])

    # Texts by name: the four sources hold disjoint kinds, so one join serves all.  It moves keys of
    # texts, never a text (``texts.py``).
    df = (df.withColumn("_source_kind", F.when(F.col("xtype").isin("P", "FN", "IF", "TF"), "R")
                        .when(F.col("xtype").isin("V", "C", "F"), F.col("xtype")))
          .withColumn("_text_schema", F.when(F.col("_source_kind").isin("R", "V"),
                                             F.col("schema_key")).otherwise(""))
          .join(_text_keys(b), [*DB, "_source_kind", "_text_schema", "object_key"], "left"))

    rows = F.when(is_table, F.col("_rows"))
    return df.select(
        *OBJ, F.col("name").alias("object_name"), "schema_name", "xtype",
        F.when(F.col("_warehouse"), F.coalesce(rows, F.lit(0))).otherwise(rows).alias("row_count"),
        F.when(has_columns, F.col("_length")).alias("row_length"),
        F.when(has_columns, F.coalesce("_columns", F.lit(0))).otherwise(0).alias("col_count"),
        F.when(has_columns, F.col("_replicated")).alias("repl_columns"),
        F.when(has_columns, F.col("_created") > 0).alias("has_cr_dt"),
        F.when(F.col("xtype") == "V", "READS").otherwise(F.col("_text.access")).alias("sql_data_access"),
        F.col("_text.text_key").alias("text_key"),
        F.coalesce("_published", F.lit(False)).alias("is_mspublished"),
        F.when(has_columns, F.col("_rv") > 0).alias("is_rplpublished"),
        F.when(has_columns, F.col("_source") > 0).alias("is_rplsubscribed"),
        F.col("_text.disabled").alias("is_disabled"), "parent_object_id",
        F.when(F.col("xtype") == "SO", F.col("start_value")).alias("start_value"),
        F.when(F.col("xtype") == "SO", F.col("current_value")).alias("current_value"),
        "parent_schema", "parent_table", "parent_column", F.col("create_date").alias("crdate"),
        "schema_key", "object_key")


def _text_keys(b: dict[str, DataFrame]) -> DataFrame:
    """Routine, view, check and foreign-key texts by name: one row per name.

    Checks and foreign keys are known without their schema, so several may have one name: the one with the least
    text key counts."""
    none = F.lit(None)

    def rows(df: DataFrame, kind: str, schema: Column, definition: str, access: Column,
             disabled: Column) -> DataFrame:
        return df.select(*DB, F.lit(kind).alias("_source_kind"), schema.alias("_text_schema"),
                         name_key(F.col("name")).alias("object_key"),
                         F.struct(text_key(F.col(definition)).alias("text_key"), access.cast("string").alias("access"),
                                  disabled.cast("boolean").alias("disabled")).alias("_text"))

    schema = name_key(F.col("schema"))
    every = (
        rows(b["routines"], "R", schema, "definition", F.col("sql_data_access"), none)
        .unionByName(rows(b["views"], "V", schema, "definition", none, none))
        .unionByName(rows(b["check_constraints"], "C", F.lit(""), "definition", none,
                          F.col("is_disabled")))
        .unionByName(rows(b["foreign_keys"], "F", F.lit(""), "delete_referential_action_desc",
                          none, F.col("is_disabled"))))
    return every.groupBy(*DB, "_source_kind", "_text_schema", "object_key").agg(F.min("_text").alias("_text"))


def _sequence_parents(b: dict[str, DataFrame]) -> DataFrame:
    """Table name -> first table of that name (by schema) and its first integer column."""
    columns = (b["columns"].filter(F.col("system_type_id").isin(fv.SEQUENCE_TYPE_IDS)
                                   & ~like_ci(F.col("name"), "%old"))
               .groupBy(*OBJ)
               .agg(F.min(F.struct("column_id", "name")).alias("_first")))
    schemas = b["schemas"].select(*DB, "schema_id", F.col("name").alias("parent_schema"))
    tables = (b["tables"].withColumn("_parent_key", name_key(F.col("name")))
              .join(schemas, [*DB, "schema_id"]))
    first = first_per_group(tables, [*DB, "_parent_key"],
                            [F.asc("parent_schema"), F.asc("object_id")])
    return (first.join(columns, OBJ, "left")
            .select(*DB, "_parent_key", "parent_schema", F.col("name").alias("parent_table"),
                    F.col("_first.name").alias("parent_column")))


def load_columns(b: dict[str, DataFrame], databases: DataFrame, objects: DataFrame,
                 done: DataFrame | None = None, mode: str = "reference") -> DataFrame:
    """Table columns with their type as text, and the id of their object.

    ``done`` holds databases loaded before.  Types are matched by the system type in
    ``reference`` mode (alias types repeat a column), by the user type in ``intended``.
    """
    eligible = eligible_databases(databases, skip_warehouse=False)
    if done is not None:
        eligible = not_loaded(eligible, done, DB)
    catalog = eligible.select(*DB, F.col("database_name").alias("table_catalog"))
    schemas = b["schemas"].select(*DB, "schema_id", F.col("name").alias("table_schema"))
    loaded = objects.select(*NAMED, F.col("object_id").alias("_loaded_id"))
    # The loaded object is looked up once for each table, before its columns come in.
    tables = (b["tables"].filter(kind_code(F.col("type")) == "U")
              .join(catalog, DB).join(schemas, [*DB, "schema_id"])
              .select(*OBJ, "table_catalog", "table_schema", F.col("name").alias("table_name"),
                      name_key(F.col("table_schema")).alias("schema_key"),
                      name_key(F.col("name")).alias("object_key"))
              .join(loaded, NAMED, "left"))
    types = b["types"].filter(F.lower("name") != "sysname").withColumnRenamed("name", "_type")
    type_id = "system_type_id" if mode == "reference" else "user_type_id"
    defaults = b["default_constraints"].select(
        *DB, F.col("object_id").alias("default_object_id"),
        F.col("definition").alias("column_default"))
    # Most columns have no default (0), so that join must not gather them.
    typed = tables.join(b["columns"], OBJ).join(types.select(*DB, type_id, "_type"),
                                                [*DB, type_id])
    has_default = F.coalesce("default_object_id", F.lit(0)) != 0
    return (
        left_lookup(typed, defaults, [*DB, "default_object_id"], has_default,
                    ["object_id", "column_id"])
        .select(*DB, F.col("_loaded_id").alias("object_id"), "table_catalog", "table_schema",
                "table_name", F.col("name").alias("column_name"),
                F.col("column_id").alias("ordinal_position"), "column_default", "is_nullable",
                format_type(F.col("_type"), F.col("max_length"), F.col("precision"),
                            F.col("scale")).alias("data_type"),
                F.col("max_length").alias("character_maximum_length"), "collation_name",
                "is_computed", "is_identity", "schema_key", "object_key"))


def load_index_usage(b: dict[str, DataFrame], databases: DataFrame, objects: DataFrame,
                     mode: str = "reference") -> DataFrame:
    """Indexes with sizes, usage, and ordered key and included columns.

    Space is summed per index before anything is joined to it.  In
    ``reference`` mode sizes count once per file of the filegroup, are cut to whole MB
    per allocation unit, and usage counts once per unit and file; in ``intended`` mode
    each counts once.  Both come from the same sums and counts.
    """
    eligible = eligible_databases(databases, skip_warehouse=True)
    schemas = b["schemas"].select(*DB, "schema_id", F.col("name").alias("table_schema"))
    tables = objects.filter(F.col("xtype") == "U").select(*NAMED, F.col("object_id").alias("_id"))
    # The loaded object is looked up once for each owner, before indexes and their lists come in.
    owners = (b["objects"].filter(F.col("type_desc").isin("USER_TABLE", "VIEW"))
              .join(eligible.select(*DB), DB, "left_semi")
              .join(schemas, [*DB, "schema_id"])
              .select(*OBJ, "table_schema", F.col("type_desc").alias("object_type"),
                      F.col("name").alias("table_name"),
                      name_key(F.col("table_schema")).alias("schema_key"),
                      name_key(F.col("name")).alias("object_key"))
              .join(tables, NAMED, "left"))
    indexes = b["indexes"].withColumnsRenamed({"name": "index_name", "type_desc": "index_type"})

    names = b["columns"].select(*OBJ, "column_id", "name")
    included = F.col("is_included_column")
    lists = (b["index_columns"].join(names, [*OBJ, "column_id"])
             .groupBy(*IDX)
             .agg(ordered_names(F.col("key_ordinal"), F.col("name"), ~included).alias("cols"),
                  ordered_names(F.col("index_column_id"), F.col("name"), included)
                  .alias("included")))

    spaces = b["data_spaces"].select(*DB, "data_space_id", F.col("name").alias("data_space"))
    units = b["allocation_units"].join(spaces, [*DB, "data_space_id"], "left").select(
        *DB, "type", F.col("type_desc").alias("allocation_desc"), "container_id", "data_space",
        "total_pages", "used_pages", "data_pages")
    parts = disjunctive_join(
        b["partitions"].select(*IDX, "partition_id", "hobt_id", "data_compression_desc"), units,
        F.col("type"), F.col("container_id"),
        {"1": "hobt_id", "3": "hobt_id", "2": "partition_id"}, DB)
    exact = mode != "reference"

    def mb(pages: str) -> Column:
        return (whole_div(F.sum(pages), 128) if exact else F.sum(pages_to_mb(F.col(pages))))

    space = (parts.groupBy(*IDX, "data_space", "allocation_desc", "data_compression_desc")
             .agg(mb("total_pages").alias("size_mbs"), mb("used_pages").alias("used_size"),
                  mb("data_pages").alias("data_size"), F.count(F.lit(1)).alias("_units")))

    files = (b["filegroups"].join(b["database_files"], [*DB, "data_space_id"])
             .groupBy(*DB, "data_space_id")
             .agg(F.min("physical_name").alias("database_file"),
                  F.count(F.lit(1)).alias("_files")))
    usage = b["index_usage_stats"].select(
        *IDX, F.coalesce("user_updates", F.lit(0)).alias("_writes"),
        (F.coalesce("user_seeks", F.lit(0)) + F.coalesce("user_scans", F.lit(0))
         + F.coalesce("user_lookups", F.lit(0))).alias("_reads"))

    df = (indexes.join(owners, OBJ)
          .join(files, [*DB, "data_space_id"], "left")
          .join(usage, IDX, "left")
          .join(lists, IDX, "left")
          .join(space, IDX, "left"))
    per_file = F.lit(1) if exact else F.coalesce("_files", F.lit(1))
    per_unit = F.lit(1) if exact else F.coalesce("_units", F.lit(1)) * per_file
    in_use = ~F.col("is_disabled")
    return (
        df.select(*DB, F.col("_id").alias("object_id"), "data_space", "allocation_desc",
                "table_schema", "object_type", "table_name", "index_type", "index_name",
                "is_unique", "is_disabled", "database_file",
                *[(F.col(c) * per_file).alias(c) for c in ("size_mbs", "used_size", "data_size")],
                F.when(in_use, F.col("_writes") * per_unit).alias("writes"),
                F.when(in_use, F.col("_reads") * per_unit).alias("reads"),
                "index_id", "fill_factor", "data_compression_desc", "cols", "included",
                "filter_definition", "schema_key", "object_key"))


def load_sequences(objects: DataFrame, values: DataFrame) -> DataFrame:
    """Sequences with a known parent column: largest value in it, next used one, and the gap."""
    sequences = (
        objects.filter((F.col("xtype") == "SO") & F.col("parent_column").isNotNull())
        .select(*NAMED, F.concat("schema_name", F.lit("."), "object_name").alias("sequence_name"),
                "current_value",
                F.concat("parent_schema", F.lit("."), "parent_table").alias("parent_table"),
                "parent_column"))
    keyed = values.select(*DB, name_key(F.col("schema")).alias("schema_key"),
                          name_key(F.col("sequence_name")).alias("object_key"), "value")
    return (sequence_gap(sequences, keyed, NAMED, "current_value", "value")
            .select(*DB, "sequence_name", "current_value", "parent_table", "parent_column",
                    "max_existing", "next_in_use", "is_max", "is_behind", "gap"))
