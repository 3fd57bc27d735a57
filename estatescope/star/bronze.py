"""Star-schema tables seen as catalog snapshots.

A region plays the server, a nation the database, a customer a table (and its
sequence), orders the partitions of its indexes, order lines their columns, a
supplier a file, a document a routine, events waits and schedules, conversations jobs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from estatescope.functions.scalars import whole_div

DB = ["server_id", "database_id"]
ROUTINE_IDS = 1_000_000_000
SEQUENCE_IDS = 2_000_000_000
GIB = 1024 ** 3
AS_OF = "2030-01-01 00:00:00"
YEARS = ["2008", "2012", "2016", "2017", "2019"]
KINDS = ["P ", "v ", "FN", "IF", "TF", "F ", "C "]
TYPES = [(231, 231, "nvarchar"), (231, 256, "sysname"), (167, 167, "varchar"),
         (167, 300, "phone"), (56, 56, "int"), (127, 127, "bigint"), (106, 106, "decimal"),
         (241, 241, "xml"), (35, 35, "text"), (189, 189, "timestamp")]
COLUMN_TYPE_IDS = [56, 127, 231, 167, 106, 241, 35, 189]


def _whole(c: str | Column) -> Column:
    return F.floor(c).cast("long")


def _pick(values: list, position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), position.cast("int") + 1)


class Star:
    """Snapshot tables of one data directory, by name, each built when asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._tables[name]

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def all(self) -> dict[str, DataFrame]:
        names = [n for n, v in vars(Star).items() if isinstance(v, cached_property)]
        return {n: self[n] for n in names if not n.startswith("_")}

    # ------------------------------------------------------------ shared pieces

    @cached_property
    def _nations(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_regionkey").alias("server_id"), F.col("n_nationkey").alias("database_id"),
            F.col("n_name").alias("nation"))

    @cached_property
    def _customers(self) -> DataFrame:
        return (self.table("customer").withColumnRenamed("c_nationkey", "database_id")
                .join(self._nations, "database_id")
                .withColumn("schema_id", F.ascii("c_mktsegment")))

    @cached_property
    def _suppliers(self) -> DataFrame:
        return (self.table("supplier").withColumnRenamed("s_nationkey", "database_id")
                .join(self._nations, "database_id")
                .withColumn("pages", _whole(F.abs("s_acctbal"))))

    @cached_property
    def _orders(self) -> DataFrame:
        index_id = F.when(F.col("o_orderstatus") == "O", 0).when(
            F.col("o_orderstatus") == "F", 1).otherwise(2)
        return (self.table("orders")
                .join(self._customers.select(*DB, "c_custkey", "c_name", "c_mktsegment"),
                      F.col("o_custkey") == F.col("c_custkey"))
                .select(*DB, F.col("o_custkey").alias("object_id"),
                        index_id.cast("long").alias("index_id"), "o_orderkey", "o_orderpriority",
                        _whole("o_totalprice").alias("pages"),
                        _whole(F.col("o_totalprice") * 100).alias("cents"),
                        "c_name", "c_mktsegment", "o_orderstatus"))

    @cached_property
    def _lines(self) -> DataFrame:
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("column_id"),
            "l_linenumber", "l_discount", "l_returnflag")
        return self._orders.select(*DB, "object_id", "index_id", "o_orderkey", "c_name", "c_mktsegment").join(
            lines, "o_orderkey")

    @cached_property
    def _work(self) -> DataFrame:
        """Order lines by the database of their supplier."""
        return (self.table("lineitem")
                .join(self._suppliers.select(*DB, "s_suppkey"),
                      F.col("l_suppkey") == F.col("s_suppkey"))
                .select(*DB, "l_partkey", "l_shipdate", _whole("l_extendedprice").alias("price")))

    @cached_property
    def _documents(self) -> DataFrame:
        """Documents as routines; each is given two calls into databases of its server."""
        home = F.col("doc_id") % 25
        call = F.lit("\nNATION_").cast("string")

        def target(step: int) -> Column:
            return ((home + 5 * (F.col("doc_id") % step)) % 25).cast("string")

        text = F.concat("text", call, target(4), F.lit(".t"), F.lower(call), target(3),
                        F.lit(".t"))
        return (self.table("documents")
                .select("doc_id", "lang", text.alias("definition"),
                        home.cast("int").alias("database_id"),
                        _pick(KINDS, F.col("doc_id") % 7).alias("type"),
                        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
                        (F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1)))
                        .alias("schema_id"))
                .join(self._nations, "database_id"))

    # ------------------------------------------------------------------ servers

    @cached_property
    def servers(self) -> DataFrame:
        version = F.concat(F.lit("Microsoft SQL Server "), _pick(YEARS, F.col("r_regionkey")),
                           F.lit(" (RTM)"))
        return self.table("region").select(
            F.col("r_regionkey").alias("server_id"), F.col("r_name").alias("server_name"),
            F.concat(F.lit("Server "), "r_name").alias("description"), version.alias("version"),
            F.lit(True).alias("is_active"))

    @cached_property
    def server_properties(self) -> DataFrame:
        memory = self._customers.groupBy("server_id").agg(
            F.sum(_whole(F.abs("c_acctbal"))).alias("memory_kb"))
        cpus = self._nations.groupBy("server_id").agg(F.count("*").cast("int").alias("cpu_count"))
        return (self.servers.join(memory, "server_id").join(cpus, "server_id")
                .select("server_id", "server_name",
                        F.concat(F.lit("6."), F.col("server_id").cast("string"))
                        .alias("windows_release"),
                        F.lit("2020-01-01").cast("timestamp").alias("create_date"), "version",
                        F.lit("Enterprise").alias("edition"), F.lit("RTM").alias("product_level"),
                        F.lit("Latin1").alias("collation"), "cpu_count",
                        F.lit(2).alias("hyperthread_ratio"), "memory_kb",
                        F.lit("HYPERVISOR").alias("vm_type"), F.lit("1.0").alias("build"),
                        F.lit(1).alias("governor_enabled")))

    @cached_property
    def sysservers(self) -> DataFrame:
        names = F.regexp_extract_all("text", F.lit(r"(\w+)\."), F.lit(1))
        return self.table("benchmark").select(
            (F.col("item_id") % 5).cast("int").alias("server_id"), F.explode(names).alias("srvname"),
            F.lit("ODBC").alias("providername"), F.col("text").alias("datasource"),
            F.lit(None).cast("string").alias("location"),
            F.lit(None).cast("string").alias("providerstring"))

    @cached_property
    def services(self) -> DataFrame:
        none = F.lit(None)
        return self.table("events").select(
            (F.col("user_id") % 5).cast("int").alias("server_id"),
            F.col("event_type").alias("servicename"), F.lit(2).alias("startup_type"),
            F.lit("Automatic").alias("startup_type_desc"), F.lit(4).alias("status"),
            F.lit("Running").alias("status_desc"), none.cast("int").alias("process_id"),
            none.cast("timestamp").alias("last_startup_time"),
            F.concat(F.lit("svc_"), "event_type").alias("service_account"),
            none.cast("string").alias("filename"), F.lit("N").alias("is_clustered"),
            none.cast("string").alias("cluster_nodename"))

    @cached_property
    def cluster_nodes(self) -> DataFrame:
        return self._nations.select(
            "server_id", F.col("nation").alias("node_name"),
            (F.col("database_id") % 2).alias("status"), F.lit("up").alias("status_description"),
            (F.col("database_id") < 5).alias("is_current_owner"))

    @cached_property
    def configurations(self) -> DataFrame:
        key = F.col("database_id")
        return self._nations.select(
            "server_id", F.col("nation").alias("name"), key.cast("string").alias("value"),
            (key * 2).cast("string").alias("value_in_use"), F.lit("0").alias("minimum"),
            F.lit("100").alias("maximum"), F.concat(F.lit("about "), "nation")
            .alias("description"), (key % 2 == 0).alias("is_dynamic"),
            (key % 3 == 0).alias("is_advanced"))

    @cached_property
    def availability_groups(self) -> DataFrame:
        return self._nations.select("server_id", self._id("g", "database_id").alias("group_id"),
                                    F.col("nation").alias("name"))

    @staticmethod
    def _id(prefix: str, column: str) -> Column:
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    @cached_property
    def availability_replicas(self) -> DataFrame:
        return self._suppliers.select(
            "server_id", self._id("r", "s_suppkey").alias("replica_id"),
            self._id("g", "database_id").alias("group_id"),
            F.col("s_name").alias("replica_server_name"),
            (F.col("s_suppkey") % 3).cast("int").alias("secondary_role_allow_connections"),
            (F.col("s_suppkey") % 2).cast("int").alias("availability_mode"),
            F.lit("AUTOMATIC").alias("failover_mode_desc"))

    @cached_property
    def availability_group_states(self) -> DataFrame:
        return (self._suppliers.groupBy(*DB).agg(F.min("s_name").alias("primary_replica"))
                .select("server_id", self._id("g", "database_id").alias("group_id"),
                        "primary_replica"))

    @cached_property
    def availability_replica_states(self) -> DataFrame:
        return self._suppliers.select(
            "server_id", self._id("r", "s_suppkey").alias("replica_id"),
            F.when(F.col("s_suppkey") % 4 > 0, (F.col("s_suppkey") % 4)).cast("int")
            .alias("role"),
            (F.col("s_suppkey") % 3 > 0).alias("is_local"),
            F.lit("HEALTHY").alias("synchronization_health_desc"))

    @cached_property
    def availability_db_cluster_states(self) -> DataFrame:
        return (self._suppliers.groupBy(*DB, "nation").agg(F.min("s_suppkey").alias("first"))
                .select("server_id", self._id("r", "first").alias("replica_id"),
                        self._id("d", "database_id").alias("group_database_id"),
                        F.col("nation").alias("database_name"),
                        F.lit(True).alias("is_database_joined")))

    @cached_property
    def availability_db_replica_states(self) -> DataFrame:
        # No rows for every other replica, so that the defaults show.
        return self._suppliers.filter(F.col("s_acctbal") > 5000).select(
            "server_id", self._id("r", "s_suppkey").alias("replica_id"),
            self._id("d", "database_id").alias("group_database_id"),
            F.lit(2).alias("synchronization_state"), F.lit(True).alias("is_suspended"))

    @cached_property
    def wait_stats(self) -> DataFrame:
        value = _whole("value")
        return (self.table("events")
                .groupBy((F.col("user_id") % 5).cast("int").alias("server_id"),
                         F.concat("event_type", F.lit("_"), F.col("user_id").cast("string"))
                         .alias("wait_type"))
                .agg(F.sum(value).alias("wait_time_ms"), F.max(value).alias("max_wait_time_ms"),
                     whole_div(F.sum(value), 3).alias("signal_wait_time_ms")))

    @cached_property
    def volume_stats(self) -> DataFrame:
        drive = F.col("s_suppkey") % 4
        total = (drive + 1) * 100 * GIB
        free = whole_div(total, F.col("database_id") % 5 + 2) - 1
        return self._suppliers.select(
            *DB, F.col("s_suppkey").cast("int").alias("file_id"),
            F.concat(_pick(["C", "D", "E", "F"], drive), F.lit(":\\"))
            .alias("volume_mount_point"),
            total.alias("total_bytes"), free.alias("available_bytes"))

    # --------------------------------------------------------------------- jobs

    @cached_property
    def jobs(self) -> DataFrame:
        conv = F.col("conv_id")
        return (self.table("conversations").groupBy("conv_id").agg(F.min("role").alias("role"))
                .select((conv % 5).cast("int").alias("server_id"),
                        self._id("j", "conv_id").alias("job_id"),
                        self._id("job_", "conv_id").alias("name"), F.col("role")
                        .alias("description"), (conv % 2 == 0).alias("enabled"),
                        (conv % 3).cast("int").alias("start_step_id"),
                        F.concat(F.lit("s"), (conv % 4).cast("string")).alias("owner_sid"),
                        (conv % 10).cast("int").alias("notify_email_operator_id")))

    @cached_property
    def jobsteps(self) -> DataFrame:
        conv = F.col("conv_id")
        return self.table("conversations").select(
            (conv % 5).cast("int").alias("server_id"), self._id("j", "conv_id").alias("job_id"),
            F.col("turn").cast("int").alias("step_id"),
            F.concat("role", F.lit("_"), F.col("turn").cast("string")).alias("step_name"),
            F.concat(F.lit("NATION_"), (conv % 25).cast("string")).alias("database_name"),
            F.col("text").alias("command"))

    @cached_property
    def jobschedules(self) -> DataFrame:
        e = F.col("event_id")
        clock = (e % 24) * 10000 + (e % 60) * 100 + e % 60
        return self.table("events").select(
            (F.col("user_id") % 5).cast("int").alias("server_id"),
            self._id("j", "user_id").alias("job_id"), e.alias("schedule_id"),
            clock.cast("int").alias("next_run_time"))

    @cached_property
    def schedules(self) -> DataFrame:
        e = F.col("event_id")

        def number(c: Column) -> Column:
            return c.cast("int")

        return self.table("events").select(
            number(F.col("user_id") % 5).alias("server_id"), e.alias("schedule_id"),
            self._id("u", "event_id").alias("schedule_uid"), F.col("event_type").alias("name"),
            _pick([1, 2, 4, 8, 16, 32, 64, 128], e % 8).alias("freq_type"),
            number(e % 128).alias("freq_interval"),
            _pick([1, 2, 4, 8, 16], e % 5).alias("freq_subday_type"),
            number(e % 60).alias("freq_subday_interval"),
            _pick([1, 2, 4, 8, 16, 32], e % 6).alias("freq_relative_interval"),
            number(e % 5 + 1).alias("freq_recurrence_factor"),
            number(20240101 + e % 28).alias("active_start_date"),
            F.lit(20991231).alias("active_end_date"),
            number((e % 24) * 10000 + (e % 60) * 100).alias("active_start_time"),
            F.lit(235959).alias("active_end_time"), F.col("ts").cast("timestamp").alias("date_created"))

    @cached_property
    def operators(self) -> DataFrame:
        return self.table("supplier").select(
            (F.col("s_suppkey") % 5).cast("int").alias("server_id"),
            F.col("s_suppkey").cast("int").alias("id"), F.col("s_name").alias("name"),
            (F.col("s_acctbal") > 0).alias("enabled"),
            F.concat(F.lower("s_name"), F.lit("@example.org")).alias("email_address"))

    @cached_property
    def logins(self) -> DataFrame:
        who = (F.col("database_id") % 3).cast("string")
        return self._nations.select(
            "server_id", F.concat(F.lit("s"), who).alias("sid"),
            F.concat(F.lit("login_"), who).alias("loginname")).distinct()

    # ---------------------------------------------------------------- databases

    @cached_property
    def databases(self) -> DataFrame:
        key = F.col("database_id")
        flags = ["is_auto_create_stats_on", "is_auto_update_stats_on",
                 "is_auto_update_stats_async_on", "is_parameterization_forced",
                 "is_read_committed_snapshot_on", "is_auto_close_on", "is_auto_shrink_on",
                 "is_published", "is_subscribed", "is_read_only", "is_cdc_enabled",
                 "is_broker_enabled", "is_memory_optimized_elevate_to_snapshot_on",
                 "is_encrypted"]
        return self._nations.select(
            *DB, F.col("nation").alias("name"), F.lit("SIMPLE").alias("recovery_model_desc"),
            (key % 4 + 100).cast("string").alias("compatibility_level"),
            F.lit("CHECKSUM").alias("page_verify_option_desc"),
            F.lit("OFF").alias("snapshot_isolation_state_desc"),
            F.lit("ONLINE").alias("state_desc"),
            F.lit("2020-01-01").cast("timestamp").alias("create_date"),
            F.lit("Latin1").alias("collation_name"),
            F.when(key >= 5, key - 5).alias("source_database_id"),
            F.concat(F.lit("s"), (key % 3).cast("string")).alias("owner_sid"),
            F.lit("NONE").alias("containment_desc"),
            F.lit("DISABLED").alias("delayed_durability_desc"),
            *[(key % 2 == 0).alias(f) for f in flags])

    @cached_property
    def performance_counters(self) -> DataFrame:
        sums = self._suppliers.groupBy("server_id", "nation").agg(F.sum("pages").alias("kb"))
        rows = F.array(
            F.struct(F.lit("Log File(s) Size (KB)").alias("counter_name"),
                     F.col("kb").alias("cntr_value")),
            F.struct(F.lit("Log File(s) Used Size (KB)").alias("counter_name"),
                     whole_div(F.col("kb"), 3).alias("cntr_value")))
        return sums.select("server_id", F.col("nation").alias("instance_name"), F.inline(rows))

    @cached_property
    def master_files(self) -> DataFrame:
        return self._suppliers.select(
            *DB, F.col("s_suppkey").cast("int").alias("file_id"),
            F.when(F.col("s_acctbal") < 0, "LOG").otherwise("ROWS").alias("type_desc"),
            F.col("pages").alias("size"))

    @cached_property
    def buffer_descriptors(self) -> DataFrame:
        return self._work.select(*DB)

    @cached_property
    def query_stats(self) -> DataFrame:
        return self._work.select("server_id", F.col("database_id").alias("dbid"),
                                 F.col("price").alias("total_worker_time"))

    @cached_property
    def virtual_file_stats(self) -> DataFrame:
        return self._work.select(*DB, (F.col("price") * 10).alias("num_of_bytes_read"),
                                 F.col("price").alias("num_of_bytes_written"))

    @cached_property
    def database_mirroring(self) -> DataFrame:
        none = F.lit(None)
        return self._nations.select(
            *DB, F.when(F.col("database_id") % 2 == 0, "SYNCHRONIZED")
            .alias("mirroring_state_desc"), F.lit("PRINCIPAL").alias("mirroring_role_desc"),
            F.lit("FULL").alias("mirroring_safety_level_desc"),
            F.col("nation").alias("mirroring_partner_name"),
            none.cast("string").alias("mirroring_partner_instance"),
            none.cast("string").alias("mirroring_witness_name"),
            none.cast("string").alias("mirroring_witness_state_desc"),
            F.lit(10).alias("mirroring_connection_timeout"),
            F.col("database_id").alias("mirroring_redo_queue"))

    @cached_property
    def database_service_objectives(self) -> DataFrame:
        return self._nations.select(
            *DB, F.lit("Standard").alias("edition"), F.lit("S0").alias("service_objective"),
            F.lit("pool").alias("elastic_pool_name"))

    @cached_property
    def database_files(self) -> DataFrame:
        return self._suppliers.select(
            *DB, F.when(F.col("s_acctbal") < 0, 0).otherwise(1).alias("data_space_id"),
            F.col("s_suppkey").cast("int").alias("file_id"), F.col("s_name").alias("name"),
            F.concat(F.lit("/data/"), "s_name").alias("physical_name"),
            F.col("pages").alias("size"), whole_div(F.col("pages"), 2).alias("space_used"))

    @cached_property
    def data_spaces(self) -> DataFrame:
        return self._nations.select(*DB, F.lit(1).alias("data_space_id"),
                                    F.lit("PRIMARY").alias("name"))

    @cached_property
    def filegroups(self) -> DataFrame:
        return self._nations.select(*DB, F.lit(1).alias("data_space_id"))

    @cached_property
    def procedures(self) -> DataFrame:
        return (self._work.select(*DB, "l_partkey").distinct()
                .join(self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"),
                      "l_partkey")
                .select(*DB, F.col("l_partkey").alias("object_id"), F.lit(1).alias("schema_id"),
                        F.concat("p_name", F.lit(" "), F.col("l_partkey").cast("string"))
                        .alias("name")))

    @cached_property
    def procedure_stats(self) -> DataFrame:
        return (self._work.groupBy(*DB, F.col("l_partkey").alias("object_id"))
                .agg(F.sum("price").alias("total_worker_time"),
                     F.count("*").alias("execution_count"),
                     whole_div(F.sum("price"), 7).alias("total_elapsed_time"),
                     F.max(F.col("l_shipdate").cast("timestamp")).alias("cached_time")))

    # ------------------------------------------------------------------ objects

    @cached_property
    def objects(self) -> DataFrame:
        none, root = F.lit(None).cast("timestamp"), F.lit(0).cast("long")
        tables = self._customers.select(
            *DB, F.col("c_custkey").alias("object_id"), F.col("c_name").alias("name"),
            "schema_id", F.lit("U ").alias("type"), F.lit("USER_TABLE").alias("type_desc"))
        sequences = self._customers.select(
            *DB, (F.col("c_custkey") + SEQUENCE_IDS).alias("object_id"),
            F.concat("c_name", F.lit("_seq")).alias("name"), "schema_id",
            F.lit("SO").alias("type"), F.lit("SEQUENCE_OBJECT").alias("type_desc"))
        routines = self._documents.select(
            *DB, (F.col("doc_id") + ROUTINE_IDS).alias("object_id"), "name", "schema_id", "type",
            F.lit("ROUTINE").alias("type_desc"))
        return (tables.unionByName(sequences).unionByName(routines)
                .withColumn("parent_object_id", root).withColumn("create_date", none))

    @cached_property
    def schemas(self) -> DataFrame:
        return (self._customers.select(*DB, "schema_id", F.col("c_mktsegment").alias("name"))
                .unionByName(self._documents.select(*DB, "schema_id",
                                                    F.col("lang").alias("name")))
                .distinct()
                .unionByName(self._nations.select(*DB, F.lit(1).alias("schema_id"),
                                                  F.lit("dbo").alias("name"))))

    @cached_property
    def tables(self) -> DataFrame:
        return self._customers.select(
            *DB, F.col("c_custkey").alias("object_id"), F.col("c_name").alias("name"),
            "schema_id", (F.col("c_acctbal") < 0).alias("is_published"), F.lit("U ").alias("type"))

    @cached_property
    def columns(self) -> DataFrame:
        part = F.col("column_id")
        text_type = part % 8 == 2
        short_type = part % 8 == 3
        return (
            self._lines.groupBy(*DB, "object_id", "column_id")
            .agg(F.min("l_discount").alias("low"), F.min("l_linenumber").alias("first"),
                 F.max("l_linenumber").alias("last"))
            .select(*DB, "object_id", "column_id",
                    F.concat(F.lit("c"), part.cast("string"),
                             F.when(part % 11 == 0, "_old").otherwise("")).alias("name"),
                    _pick(COLUMN_TYPE_IDS, part % 8).alias("system_type_id"),
                    _pick(COLUMN_TYPE_IDS, part % 8).alias("user_type_id"),
                    F.when((text_type | short_type) & (part % 3 == 0), -1)
                    .when(text_type | short_type, 40).otherwise(8).alias("max_length"),
                    F.lit(18).alias("precision"), F.lit(2).alias("scale"),
                    (part % 2 == 0).alias("is_nullable"),
                    (F.col("first") == 1).alias("is_replicated"),
                    (F.col("low") >= 0.09).alias("is_computed"),
                    (F.col("last") == 7).alias("is_identity"),
                    F.when(text_type | short_type, "Latin1").alias("collation_name"),
                    F.when(part % 5 < 2, part % 5 + 1).otherwise(0).alias("default_object_id")))

    @cached_property
    def types(self) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(s).alias("system_type_id"), F.lit(u)
                                  .alias("user_type_id"), F.lit(n).alias("name"))
                         for s, u, n in TYPES])
        return self._nations.select(*DB, F.inline(rows))

    @cached_property
    def default_constraints(self) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(i).cast("long").alias("object_id"), F.lit(d)
                                  .alias("definition"))
                         for i, d in ((1, "(getdate())"), (2, "((0))"))])
        return self._nations.select(*DB, F.inline(rows))

    def _docs_of(self, *kinds: str) -> DataFrame:
        return self._documents.filter(F.trim("type").isin(*kinds))

    @cached_property
    def routines(self) -> DataFrame:
        return self._docs_of("P", "FN", "IF", "TF").select(
            *DB, F.col("lang").alias("schema"), "name",
            F.lit("MODIFIES").alias("sql_data_access"), "definition")

    @cached_property
    def views(self) -> DataFrame:
        return self._docs_of("v").select(*DB, F.col("lang").alias("schema"), "name", "definition")

    @cached_property
    def check_constraints(self) -> DataFrame:
        return self._docs_of("C").select(
            *DB, "name", (F.col("doc_id") % 3 == 0).alias("is_disabled"),
            F.concat(F.lit("(x > "), F.col("doc_id").cast("string"), F.lit(")"))
            .alias("definition"))

    @cached_property
    def foreign_keys(self) -> DataFrame:
        return self._docs_of("F").select(
            *DB, "name", (F.col("doc_id") % 4 == 0).alias("is_disabled"),
            F.concat(F.upper("lang"), F.lit("_ACTION")).alias("delete_referential_action_desc"))

    @cached_property
    def sequences(self) -> DataFrame:
        return self._customers.select(
            *DB, (F.col("c_custkey") + SEQUENCE_IDS).alias("object_id"),
            F.concat("c_name", F.lit("_seq")).alias("name"), F.lit(1).cast("long")
            .alias("start_value"), (F.col("c_custkey") * 10).alias("current_value"))

    @cached_property
    def sequence_parent_values(self) -> DataFrame:
        return self._orders.select(
            *DB, F.col("c_mktsegment").alias("schema"),
            F.concat("c_name", F.lit("_seq")).alias("sequence_name"),
            F.col("o_orderkey").alias("value"))

    # ------------------------------------------------------------------ indexes

    @cached_property
    def indexes(self) -> DataFrame:
        priority = F.col("o_orderpriority")
        return (
            self._orders.groupBy(*DB, "object_id", "index_id", "o_orderstatus")
            .agg(F.max(priority == "1-URGENT").alias("is_unique"),
                 F.count("*").alias("n"), F.min(priority).alias("low"))
            .select(*DB, "object_id", "index_id",
                    F.when(F.col("index_id") > 0, F.concat(F.lit("ix_"), "o_orderstatus"))
                    .alias("name"),
                    _pick(["HEAP", "CLUSTERED", "NONCLUSTERED"], F.col("index_id"))
                    .alias("type_desc"),
                    "is_unique", (F.col("n") > 5).alias("is_disabled"),
                    F.when(F.col("low") == "5-LOW", "(x > 1)").alias("filter_definition"),
                    (F.col("n") * 5).cast("int").alias("fill_factor"),
                    F.lit(1).alias("data_space_id")))

    @cached_property
    def index_columns(self) -> DataFrame:
        return self._lines.select(
            *DB, "object_id", "index_id", "column_id", F.col("l_linenumber").alias("key_ordinal"),
            F.col("l_linenumber").alias("index_column_id"),
            (F.col("l_returnflag") == "R").alias("is_included_column"))

    @cached_property
    def partitions(self) -> DataFrame:
        compression = F.when(F.col("o_orderpriority") == "1-URGENT", "COLUMNSTORE").when(
            F.col("o_orderpriority") == "2-HIGH", "PAGE").otherwise("NONE")
        return self._orders.select(
            *DB, "object_id", "index_id", F.col("o_orderkey").alias("partition_id"),
            (F.col("o_orderkey") + ROUTINE_IDS).alias("hobt_id"), F.col("cents").alias("rows"),
            compression.alias("data_compression_desc"))

    @cached_property
    def allocation_units(self) -> DataFrame:
        key, priority = F.col("o_orderkey"), F.col("o_orderpriority")

        def unit(kind: int, desc: str, container: Column) -> Column:
            return F.struct(F.lit(kind).alias("type"), F.lit(desc).alias("type_desc"),
                            container.alias("container_id"))

        rows = F.array(
            unit(1, "IN_ROW_DATA", key + ROUTINE_IDS),
            F.when(priority == "2-HIGH", unit(2, "LOB_DATA", key)),
            F.when(priority == "3-MEDIUM", unit(3, "ROW_OVERFLOW_DATA", key + ROUTINE_IDS)))
        return (self._orders
                .select(*DB, "pages", F.inline(F.filter(rows, lambda u: u.isNotNull())))
                .select(*DB, "type", "type_desc", "container_id",
                        F.col("pages").alias("total_pages"),
                        whole_div(F.col("pages"), 2).alias("used_pages"),
                        whole_div(F.col("pages"), 3).alias("data_pages"),
                        F.lit(1).alias("data_space_id")))

    @cached_property
    def index_usage_stats(self) -> DataFrame:
        return (self._orders.groupBy(*DB, "object_id", "index_id")
                .agg(F.count("*").alias("n"), F.sum("pages").alias("p"))
                .select(*DB, "object_id", "index_id", F.col("n").alias("user_seeks"),
                        whole_div(F.col("p"), 1000).alias("user_scans"),
                        F.when(F.col("n") % 2 == 0, F.col("n")).alias("user_lookups"),
                        whole_div(F.col("p"), 100).alias("user_updates")))
