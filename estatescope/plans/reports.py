"""The eleven reports.  Column headings are those users of the assessment know.

Reports are sorted at the very end and only here.  ``g`` is the dictionary of gold tables
(see :mod:`estatescope.plans.assessment`), ``s`` that of the inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from estatescope.functions import fixed_values as fv
from estatescope.functions.scalars import like_ci, name_key
from estatescope.operators.aggregates import flag
from estatescope.operators.joins import left_lookup, rollup_union
from estatescope.operators.ordering import order_then_attach
from estatescope.plans.views import not_system
from estatescope.sources.texts import with_texts

DB = ["server_id", "database_id"]
NAMED = [*DB, "schema_key", "object_key"]
Tables = dict[str, DataFrame]


def _headed(**columns: Column | str) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).alias(h) for h, c in columns.items()]


def _zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0))


def _blank(name: str) -> Column:
    return F.coalesce(name, F.lit(""))


def _listed(name: str) -> Column:
    return F.coalesce(F.array_join(name, ", "), F.lit(""))


def instance_report(g: Tables) -> DataFrame:
    return g["servers_view"].select(*_headed(
        ServerName="server_name", WindowsRelease="windows_release", CreatedDate="created_date",
        Version="version", Edition="edition", ProductLevel="product_level",
        Collation="collation", LogicalCPUCount="logical_cpu_count",
        HyperthreadRatio="hyperthread_ratio", PhysicalCPUCount="physical_cpu_count",
        PhysicalMemoryMB="physical_memory_mb", VMType="vm_type", Build="build",
        resource_governor_enabled_functions="governor_functions", MajorVersion="major_version",
        service_account="service_account", last_startup_time="last_startup_time",
        LinkedServers="linked_servers", Databases="databases", DataMB="data_mb", LogMB="log_mb",
        CachedSizeMbs="cached_size_mbs", CPUTime="cpu_time",
        AvailabilityGroups="availability_groups", Volumes="volumes", TotalGB="total_gb",
        AvailableGB="available_gb", Jobs="jobs", top_wait="top_wait", TopSql="top_sql",
        providername="provider_name"))


def jobs_report(s: Tables) -> DataFrame:
    return s["job_steps"].select(*_headed(
        Job_Name="job_name", Enabled="enabled", ScheduleDscr="schedule_dscr",
        Step_Name="step_name", Database_Name="database_name", Command="command"))


def wait_report(g: Tables) -> DataFrame:
    return (g["top_wait_view"]
            .select("server_name", "wait_type", "percent_total_waits",
                    "percent_total_signal_waits", "percent_total_resource_waits")
            .orderBy(F.desc("percent_total_waits"), "wait_type", "server_name")
            .drop("server_name"))


def top_sql_report(g: Tables) -> DataFrame:
    return (g["top_sql_view"].select(*_headed(
        DatabaseName="database_name", SPName="sp_name", TotalWorkerTime="total_worker_time",
        execution_count="execution_count", AvgWorkerTime="avg_worker_time"))
        .orderBy(F.desc("TotalWorkerTime"), "DatabaseName", "SPName"))


def _named_by(hits: DataFrame, by: list[str]) -> DataFrame:
    """Per group: number of references to servers and databases, and their distinct names.

    ``tempdb`` is not reported as a called database.  Rows are counted per name first.
    """
    per_name = hits.groupBy(*by, "refers_to", "name").agg(F.count(F.lit(1)).alias("_n"))
    server = F.col("refers_to") == "server"
    called = (F.col("refers_to") == "database") & (name_key(F.col("name")) != "tempdb")

    def listed(condition: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(condition, F.col("name")))), ",")

    return per_name.groupBy(*by).agg(
        F.sum(F.when(server, F.col("_n"))).alias("_xs"), listed(server).alias("_xs_list"),
        F.sum(F.when(called, F.col("_n"))).alias("_xo"), listed(called).alias("_xo_list"))


def _references(hits: DataFrame, databases: DataFrame) -> DataFrame:
    """Per database: what its routines refer to, and which databases refer to it, as counts and lists of names.

    A reference is a row of the database that has it and, once its name is looked up, one of the database that it
    names, so both directions are counted per name and then listed by the same two aggregates.
    """
    server, database = F.col("refers_to") == "server", F.col("refers_to") == "database"
    named = databases.groupBy("server_id", name_key(F.col("database_name")).alias("_name")).agg(
        F.collect_list("database_id").alias("_targets"))
    known = left_lookup(hits.withColumn("_name", F.when(database, name_key(F.col("name")))), named,
                        ["server_id", "_name"], database, ["database_id", "object_key"])
    kind = F.when(server, "xs").when(database & (F.col("_name") != "tempdb"), "xo")
    out = F.array(F.struct("database_id", kind.alias("_kind"), F.col("name").alias("_ref")))
    into = F.transform("_targets", lambda t: F.struct(
        t.alias("database_id"), F.lit("xi").alias("_kind"), F.col("database_name").alias("_ref")))
    rows = known.select("server_id", F.inline(F.concat(out, F.coalesce(into, F.array().cast(
        "array<struct<database_id:int,_kind:string,_ref:string>>"))))).filter("_kind IS NOT NULL")
    per_name = rows.groupBy(*DB, "_kind", "_ref").agg(F.count(F.lit(1)).alias("_n"))

    def both(kind: str) -> list[Column]:
        mine = F.col("_kind") == kind
        return [F.sum(F.when(mine, F.col("_n"))).alias(f"_{kind}"),
                F.array_join(F.sort_array(F.collect_list(F.when(mine, F.col("_ref")))), ",").alias(f"_{kind}_list")]

    return per_name.groupBy(*DB).agg(*both("xs"), *both("xo"), *both("xi"))


def databases_report(g: Tables, s: Tables) -> DataFrame:
    """One row per user database: sizes, classes, objects, findings and references."""
    found = (F.col("incompatible_type") == 1) & F.col("text_key").isNotNull()
    df = rollup_union(
        g["databases_view"].filter(not_system()), DB,
        (g["column_counts"], {"_incompatible": F.col("incompatible_column"), "_computed": F.col("computed_column"),
                                "_large": F.col("large_text_column"), "_defaults": F.col("invalid_default")}),
        (g["routine_findings"], {"_xml": F.col("uses_for_xml"), "_cursor": F.col("uses_cursor"), "_kinds": flag(found)}),
        (s["sequences"], {"_sequences": F.lit(1)}))
    df = df.join(_references(g["reference_hits"], s["databases"]), DB, "left")

    return df.orderBy("database_name", *DB).select(*_headed(
        DatabaseName="database_name", DataMB=_zero("data_mb"), Files=_zero("files"),
        Tables=_zero("tables"), Empty=_zero("empty"), Small=_zero("small"),
        Medium=_zero("medium"), Large=_zero("large"), VeryLarge=_zero("very_large"),
        Columns=_zero("columns"), Rows=_zero("rows"), Views=_zero("views"),
        Procs=_zero("procs"), Functions=_zero("functions"), Indexes=_zero("indexes"),
        ColumnStores=_zero("column_stores"), UniqueIndexes=_zero("unique_indexes"),
        IncludedColumnIndexes=_zero("included_column_indexes"),
        LargeTextColumns=_zero("_large"), IncompatibleDefaults=_zero("_defaults"),
        FilteredIndexes=_zero("filtered_indexes"), ComputedColumns=_zero("_computed"),
        XServerRoutines=_zero("_xs"), LinkedServers=_blank("_xs_list"),
        XOutRoutines=_zero("_xo"), XOutDbs=_blank("_xo_list"), XInRoutines=_zero("_xi"),
        XInDbs=_blank("_xi_list"), UsesForXML=_zero("_xml"), UsesCursor=_zero("_cursor"),
        IncompatibleColumns=_zero("_incompatible"), IncompatibleRoutinesByType=_zero("_kinds"),
        Sequences=_zero("_sequences")))


def tables_report(g: Tables) -> DataFrame:
    return (g["objects_view"].filter(F.col("xtype") == "U").select(*_headed(
        DatabaseName="database_name", SchemaName="schema_name", ObjectName="object_name",
        RowCount="row_count", RowLength="row_length", PK="pk", PKType="pk_type", writes="writes",
        reads="reads", PKCols=_listed("pk_cols"), Indexes="indexes",
        Index_data_size="index_data_size", Index_used_size="index_used_size",
        ColumnStores="column_stores", ColumnsCount="columns_count", HasIdentity="has_identity",
        ComputedColumns="computed_columns", UniqueIndexes="unique_indexes",
        IncludedColumnIndexes="included_column_indexes", FilteredIndexes="filtered_indexes",
        BlobColumns="blob_columns"))
        .orderBy("DatabaseName", "SchemaName", "ObjectName"))


def columns_report(g: Tables, mode: str = "reference") -> DataFrame:
    """Columns with one comment each.

    The type comment tests the object's kind in ``reference`` mode (and so never
    appears), the column's type in ``intended``.
    """
    tested = F.lower("xtype" if mode == "reference" else "data_type")
    comment = (
        F.when(F.col("is_computed"), "Is Computed")
        .when(tested.isin(fv.INCOMPATIBLE_TYPES), "Incompatible Type")
        .when(like_ci(F.col("column_default"), fv.CALL_DEFAULT_PATTERN), "Incompatible Default")
        .when(F.col("character_maximum_length") == -1, "Cant be Column Compressed")
        .otherwise(""))
    return (g["columns_view"].select(*_headed(
        DatabaseName="database_name", SchemaName="table_schema", TableName="table_name",
        ORDINAL_POSITION="ordinal_position", COLUMN_NAME="column_name",
        COLUMN_DEFAULT="column_default", IS_NULLABLE="is_nullable", DATA_TYPE="data_type",
        CHARACTER_MAXIMUM_LENGTH="character_maximum_length", COLLATION_NAME="collation_name",
        is_computed="is_computed", is_identity="is_identity", Xtype="xtype", isKey="is_key",
        Comment=comment))
        .orderBy("DatabaseName", "SchemaName", "TableName", "ORDINAL_POSITION", "COLUMN_NAME"))


def indexes_report(s: Tables) -> DataFrame:
    named = s["index_usage"].join(s["databases"].select(*DB, "database_name"), DB)
    return (named.select(*_headed(
        DatabaseName="database_name", table_schema="table_schema", table_name="table_name",
        index_name=_blank("index_name"), data_space="data_space",
        allocation_desc="allocation_desc", object_type="object_type", index_type="index_type",
        is_disabled="is_disabled", database_file="database_file", size_mbs="size_mbs",
        used_size="used_size", data_size="data_size", writes="writes", reads="reads",
        index_id="index_id", fill_factor="fill_factor", columns=_listed("cols"),
        is_unique="is_unique", included=_listed("included"),
        filter_definition=_blank("filter_definition"),
        data_compression_desc="data_compression_desc"))
        .orderBy("DatabaseName", "table_schema", "table_name", "index_name", "data_space",
                 "allocation_desc"))


def routines_report(g: Tables, s: Tables) -> DataFrame:
    """Every object but tables, with the servers and databases its text names; texts come in when all is sorted."""
    rows = (
        g["routine_findings"].filter(F.col("xtype") != "U")
        .join(_named_by(g["reference_hits"], NAMED), NAMED, "left")
        .select(*_headed(
            DatabaseName="database_name", SchemaName="schema_name", Xtype="xtype",
            TypeDesc="type_desc", ObjectName="object_name",
            SQL_DATA_ACCESS=_blank("sql_data_access"), LinkedServers=_blank("_xs_list"),
            XOutDbs=_blank("_xo_list"), UsesForXML="uses_for_xml", UsesCursor="uses_cursor",
            IncompatibleType="incompatible_type"), "text_key"))
    order = ["DatabaseName", "SchemaName", "Xtype", "TypeDesc", "ObjectName"]
    return order_then_attach(rows, order, lambda df: with_texts(df, s["texts"])).withColumnRenamed(
        "routine_definition", "ROUTINE_DEFINITION")


def sequences_report(s: Tables) -> DataFrame:
    return (s["sequences"].join(s["databases"].select(*DB, "database_name"), DB)
            .select(*_headed(DatabaseName="database_name", SequenceName="sequence_name",
                             ParentTable="parent_table", ParentColumn="parent_column")))


def linked_servers_report(s: Tables) -> DataFrame:
    return s["linked_servers"].select(*_headed(
        ServerName="server_name", LinkedServer="linked_server", providername="provider_name",
        datasource="datasource"))


def report_jobs(g: Tables, s: Tables, mode: str = "reference") -> dict[str, Callable[[], DataFrame]]:
    """What makes each report, in output order."""
    return {
        "instance": lambda: instance_report(g),
        "jobs": lambda: jobs_report(s),
        "wait_stats": lambda: wait_report(g),
        "top_sql": lambda: top_sql_report(g),
        "databases": lambda: databases_report(g, s),
        "tables": lambda: tables_report(g),
        "columns": lambda: columns_report(g, mode),
        "indexes": lambda: indexes_report(s),
        "routines": lambda: routines_report(g, s),
        "sequences": lambda: sequences_report(s),
        "linked_servers": lambda: linked_servers_report(s),
    }


def reports(g: Tables, s: Tables, mode: str = "reference") -> dict[str, DataFrame]:
    """All reports in output order."""
    return {name: job() for name, job in report_jobs(g, s, mode).items()}
