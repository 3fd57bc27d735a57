"""The hand-written estate through inventory, views, rules and reports, in both modes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from estate import EMPTY, MYSALES, NEW, OLD, SALES
from estatescope.plans.assessment import evaluate, gold_jobs, inventory_jobs, rule_jobs
from estatescope.plans.reports import reports
from estatescope.sources.schemas import SILVER
from estatescope.sources.sinks import collect_all
from estatescope.sources.texts import with_texts

AS_OF = dt.datetime(2024, 1, 1, 0, 0, 2)


class Layers:
    """The layers of one mode; inventory and gold are stored like in a real run."""

    def __init__(self, spark, estate, mode, folder):
        self.s, failed = collect_all(spark, inventory_jobs(estate, F.lit(AS_OF), mode),
                                     f"{folder}/inventory")
        self.g, more = collect_all(spark, gold_jobs(self.s, mode), f"{folder}/gold")
        assert not failed.union(more).collect()
        self.r = evaluate(rule_jobs(self.g, self.s)).all()
        self.out = reports(self.g, self.s, mode)


@pytest.fixture(scope="module")
def ref(spark, estate, tmp_path_factory):
    return Layers(spark, estate, "reference", tmp_path_factory.mktemp("reference"))


@pytest.fixture(scope="module")
def meant(spark, estate, tmp_path_factory):
    return Layers(spark, estate, "intended", tmp_path_factory.mktemp("intended"))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def one(df, *columns):
    (row,) = rows(df, *columns)
    return row


def test_inventory_has_the_declared_schemas(ref):
    from pyspark.sql.types import StructType
    for name, df in ref.s.items():
        declared = {f.name: f.dataType for f in StructType.fromDDL(SILVER[name])}
        assert {f.name: f.dataType for f in df.schema} == declared, name


def test_servers_by_generation(ref):
    assert rows(ref.s["servers"], "server_id", "windows_release", "physical_cpu_count",
                "physical_memory_mb", "vm_type", "governor_functions", "edition") == [
        (NEW, "6.3", 4, 2048, "NONE", 1, "Enterprise"),
        (OLD, None, 4, 2048, None, 1, "Enterprise")]


def test_server_lists(ref):
    assert rows(ref.s["linked_servers"], "server_id", "linked_server") == [
        (NEW, "LNK1"), (NEW, "SRV1"), (OLD, "LNK1"), (OLD, "SRV2")]
    assert ref.s["services"].count() == 2
    assert rows(ref.s["cluster_nodes"], "server_id", "status", "is_current_owner") == [
        (NEW, 0, True), (OLD, None, None)]
    assert rows(ref.s["availability_groups"], "replica_server_name", "is_primary_server") == [
        ("SRV9", False), ("srv1", True)]
    assert one(ref.s["sys_configurations"], "server_name", "name", "value") == (
        "SRV1", "max memory", "100")


def test_databases_by_generation(ref):
    sales = ref.s["databases"].filter((F.col("database_id") == SALES))
    new, old = sales.filter(F.col("server_id") == NEW), sales.filter(F.col("server_id") == OLD)
    fields = ["log_size_kb", "log_used_kb", "log_used_percentage", "data_mb", "log_mb",
              "cached_size_mbs", "cpu_time", "io_mbs", "availability_group",
              "local_replica_role", "synchronization_state", "is_joined", "owner",
              "delayed_durability_desc", "is_cdc_enabled", "target_recovery_time_in_seconds"]
    assert one(new, *fields) == (3, 1, "33.00", 3, 1, 2, 7, 2, "AG1", 3, 0, True, "sa",
                                 "DISABLED", True, -1)
    assert one(old, *fields) == (3, 1, "33.00", None, None, 0, None, 0, None, None, None, None,
                                 None, None, None, -1)
    stage = ref.s["databases"].filter((F.col("database_name") == "Stage"))
    assert one(stage, "log_size_kb", "source_database_name") == (None, "Sales")


def test_objects(ref, meant):
    table = F.col("object_name") == "Orders"
    assert one(ref.s["objects"].filter(table), "xtype", "row_count", "row_length", "col_count",
               "repl_columns", "has_cr_dt", "is_rplpublished", "is_rplsubscribed") == (
        "U", 10, 4 * 9 + 16 * 2 - 4 + 20, 16, 1, True, True, False)
    assert one(meant.s["objects"].filter(table), "row_length") == (4 * 9 + 16 * 2 + 20,)
    by_name = {r.object_name: r for r in with_texts(ref.s["objects"], ref.s["texts"]).collect()}
    assert "syncobj_1" not in by_name and "trg" not in by_name
    assert by_name["fk"].routine_definition == "NO_ACTION" and by_name["fk"].is_disabled
    assert by_name["ck"].routine_definition == "(x > 1)" and not by_name["ck"].is_disabled
    assert by_name["vw"].sql_data_access == "READS"
    assert by_name["linked"].sql_data_access == "MODIFIES"
    assert (by_name["Orders_seq"].parent_table, by_name["Orders_seq"].parent_column) == (
        "Orders", "Id")
    assert by_name["lost_seq"].parent_table is None
    assert by_name["far"].server_id == OLD
    assert by_name["T1"].row_count == 0 and by_name["T0"].row_count is None


def test_columns_and_alias_types(ref, meant):
    name = F.col("column_name") == "phone"
    assert rows(ref.s["columns"].filter(name), "data_type") == [("phone",), ("varchar (20)",)]
    assert rows(meant.s["columns"].filter(name), "data_type") == [("phone",)]
    assert rows(meant.s["columns"].filter(F.col("column_name").startswith("long")),
                "data_type") == [("nvarchar (max)",), ("varchar (max)",)]


def test_columns_skip_loaded_databases(estate, ref):
    from estatescope.sources.collectors import load_columns, with_server_name
    named = with_server_name(ref.s["databases"], ref.s["servers"])
    done = ref.s["columns"].select("server_id", "database_id").distinct()
    assert load_columns(estate, named, ref.s["objects"], done).count() == 0


def test_index_rollup(ref, meant):
    two = F.col("index_id") == 2
    fields = ["size_mbs", "used_size", "writes", "reads", "cols", "included", "database_file"]
    assert one(ref.s["index_usage"].filter(two), *fields) == (
        0, 0, 5 * 4, 7 * 4, ["Id", "Id2"], ["DateCreated"], "/data/f1")
    assert one(meant.s["index_usage"].filter(two), *fields) == (
        1, 1, 5, 7, ["Id", "Id2"], ["DateCreated"], "/data/f1")
    heap = F.col("index_id") == 0
    assert one(ref.s["index_usage"].filter(heap), "allocation_desc", "size_mbs", "cols") == (
        "LOB_DATA", 4, None)
    three = F.col("index_id") == 3
    assert one(ref.s["index_usage"].filter(three), "allocation_desc", "size_mbs", "writes") == (
        None, None, None)


def test_waits(ref, meant):
    fields = ["wait_type", "wait_time_ms", "percent_total_waits", "percent_total_signal_waits",
              "percent_total_resource_waits"]
    assert rows(ref.s["top_wait"], *fields) == [
        ("A", 30, 50.0, 25.0, 40.0), ("B", 20, 30.0, 75.0, 0.0), ("C", 10, 20.0, 0.0, 20.0)]
    assert rows(meant.s["top_wait"], "wait_type", "wait_time_ms") == [
        ("A", 50), ("B", 30), ("C", 20)]


def test_top_procedures(ref):
    top = rows(ref.s["top_sql"], "sp_name", "total_worker_time", "avg_worker_time",
               "calls_per_second", "avg_elapsed_time")
    assert len(top) == 10
    assert top[-1] == ("dbo.p11", 1200, None, 0, 0)
    assert top[0] == ("dbo.p02", 300, 42, 3, 7)


def test_files_volumes_sequences(ref):
    assert rows(ref.s["database_files"], "file_name", "total_mbs", "available_mbs",
                "filegroup_name") == [
        ("f1", 10, 9, "PRIMARY"), ("f2", 1, 0, "PRIMARY"), ("log", 2, 2, None)]
    total, available, free = one(ref.s["volumes"], "total_gb", "available_gb", "percentage_free")
    assert (total, available, str(free)) == (10, 2, "30.00")
    assert one(ref.s["sequences"], "sequence_name", "max_existing", "next_in_use", "gap",
               "is_max", "is_behind") == ("dbo.Orders_seq", 20, 11, 1, 1, True)


def test_jobs(ref, meant):
    jobs = {r.job_name: r for r in ref.s["jobs"].collect()}
    assert jobs["job 0"].schedule_dscr == "Once on 20240131 at 9:30"
    assert jobs["job 0"].run_time == "09:30:05"
    assert jobs["job 0"].created_date == "Jan  5 2024  3:07PM"
    assert jobs["job 2"].schedule_dscr == "Every 1 week(s) on Monday, Friday at 09:00"
    assert jobs["job 7"].schedule_dscr is None and jobs["job 7"].schedule_name == "s7"
    assert jobs["no schedule"].is_scheduled is False
    assert jobs["job 5"].frequency is None
    meant_jobs = {r.job_name: r for r in meant.s["jobs"].collect()}
    assert meant_jobs["job 5"].frequency == "Execute when SQL Server Agent starts"
    steps = rows(ref.s["job_steps"], "job_name", "step_id")
    assert ("job 0", 1) in steps and ("no schedule", None) in steps and len(steps) == 9


def test_database_view_keeps_nothing_as_null(ref):
    empty = ref.g["databases_view"].filter(F.col("database_id") == EMPTY)
    assert one(empty, "tables", "rows", "indexes", "files", "columns") == (None,) * 5
    sales = ref.g["databases_view"].filter(
        (F.col("database_id") == SALES) & (F.col("server_id") == NEW))
    assert one(sales, "tables", "empty", "small", "medium", "large", "very_large") == (
        9, 2, 2, 2, 2, 1)


def test_assumed_key_and_key_columns(ref, meant):
    orders = ref.g["objects_view"].filter(F.col("object_name") == "Orders")
    assert one(orders, "pk", "pk_cols", "unique_indexes", "has_identity", "blob_columns") == (
        "ix_two", ["Id", "Id2"], 1, 1, 5)
    # The column of an alias type counts twice only in reference mode.
    orders = meant.g["objects_view"].filter(F.col("object_name") == "Orders")
    assert one(orders, "blob_columns") == (4,)
    keys = {r.column_name: r.is_key for r in ref.g["columns_view"].collect()}
    assert (keys["Id"], keys["Id2"], keys["d2"]) == (1, 1, 0)


def test_cross_server_rule(ref):
    assert rows(ref.r["cross_server_routines"], "object_name", "linked_server") == [
        ("linked", "LNK1"), ("linked2", "LNK1")]


def test_cross_database_rule(ref, meant):
    found = rows(ref.r["cross_database_routines"], "object_name", "x_database_name")
    # to_both keeps only the first name, its own database, and is lost; the substring
    # "Sales." of "MySales." is found, but "MySales" comes first.
    assert found == [("to_mysales", "MySales"), ("to_stage", "Stage")]
    found = rows(meant.r["cross_database_routines"], "object_name", "x_database_name")
    assert found == [("to_both", "Stage"), ("to_mysales", "MySales"), ("to_mysales", "Sales"),
                     ("to_stage", "Stage")]


def test_routine_rules(spark, ref):
    assert rows(ref.r["incompatible_routine_types"], "object_name", "type_desc") == [
        ("fk", "FOREIGN KEY constraint")]
    assert rows(ref.r["incompatible_routines"], "object_name", "uses_for_xml", "uses_cursor") == [
        ("cursor_user", 0, 1), ("xml_user", 1, 0)]
    from estatescope.plans.rules import incompatible_routine_types, routine_findings
    extra = ref.g["objects_view"].filter(F.col("object_name") == "xml_user").withColumn(
        "xtype", F.lit("TR"))
    assert one(incompatible_routine_types(routine_findings(extra, ref.s["texts"])), "type_desc") == (
        "SQL DML Trigger",)


def test_column_rules(ref, meant):
    def names(layer, rule):
        return sorted({r.column_name for r in layer.r[rule].collect()})

    assert names(ref, "incompatible_columns") == ["doc", "geo", "pic"]
    assert names(ref, "computed_columns") == ["sum"]
    assert names(ref, "large_text_columns") == ["note", "sum"]
    assert names(meant, "large_text_columns") == ["long1", "long2", "note", "sum"]
    assert names(ref, "invalid_defaults") == ["made"]


def test_database_report(ref):
    got = {}
    for r in ref.out["databases"].collect():
        got.setdefault(r.DatabaseName, []).append(r)
    assert sorted(got) == ["Empty1", "Gone", "MySales", "Sales", "Stage"]
    assert len(got["Sales"]) == 2
    empty = got["Empty1"][0]
    assert (empty.Tables, empty.DataMB, empty.XOutDbs, empty.Rows) == (0, 0, "", 0)
    sales = max(got["Sales"], key=lambda r: r.Tables)
    assert (sales.Tables, sales.XServerRoutines, sales.LinkedServers) == (9, 2, "LNK1")
    assert (sales.XOutRoutines, sales.XOutDbs, sales.XInRoutines) == (1, "Stage", 0)
    stage = got["Stage"][0]
    assert (stage.XInRoutines, stage.XInDbs, stage.XOutDbs) == (1, "Sales", "MySales")
    assert (stage.UsesForXML, stage.UsesCursor, stage.IncompatibleRoutinesByType) == (1, 1, 1)
    assert (stage.Functions, stage.Views, stage.Procs) == (2, 1, 1)
    mine = got["MySales"][0]
    assert (mine.IncompatibleColumns, mine.ComputedColumns, mine.LargeTextColumns,
            mine.IncompatibleDefaults, mine.Sequences) == (3, 1, 2, 1, 1)
    assert (mine.DataMB, mine.Files, mine.XInRoutines, mine.XInDbs) == (11, 3, 1, "Stage")


def test_report_counts_equal_the_rule_tables(ref):
    total = ref.out["databases"].agg(
        *[F.sum(c) for c in ("IncompatibleColumns", "ComputedColumns", "LargeTextColumns",
                             "IncompatibleDefaults", "XServerRoutines", "XOutRoutines",
                             "IncompatibleRoutinesByType")]).first()
    assert tuple(total) == tuple(ref.r[n].count() for n in (
        "incompatible_columns", "computed_columns", "large_text_columns", "invalid_defaults",
        "cross_server_routines", "cross_database_routines", "incompatible_routine_types"))


def test_other_reports(ref, meant):
    assert list(ref.out) == ["instance", "jobs", "wait_stats", "top_sql", "databases", "tables",
                             "columns", "indexes", "routines", "sequences", "linked_servers"]
    server = {r.ServerName: r for r in ref.out["instance"].collect()}["SRV1"]
    assert (server.MajorVersion, server.Databases, server.LinkedServers, server.TotalGB) == (
        "2019", 6, 2, 10)
    assert (server.top_wait, server.TopSql, server.providername, server.Jobs) == (
        "A", "dbo.p11", "OWN", 9)
    assert (server.AvailabilityGroups, server.service_account) == (2, "svc")
    comments = {r.COLUMN_NAME: r.Comment for r in ref.out["columns"].collect()}
    assert comments["sum"] == "Is Computed" and comments["made"] == "Incompatible Default"
    assert comments["geo"] == "Cant be Column Compressed" and comments["Id"] == ""
    comments = {r.COLUMN_NAME: r.Comment for r in meant.out["columns"].collect()}
    assert comments["geo"] == "Incompatible Type"
    routines = {r.ObjectName: r for r in ref.out["routines"].collect()}
    assert routines["linked"].LinkedServers == "LNK1"
    assert routines["to_stage"].XOutDbs == "Stage"
    assert routines["fk"].IncompatibleType == 1
    assert "Orders" not in routines
    tables = {r.ObjectName: r for r in ref.out["tables"].collect()}
    assert tables["Orders"].PKCols == "Id, Id2" and tables["T8"].RowCount == 1_000_000_001
    assert ref.out["indexes"].count() == 3
    assert one(ref.out["sequences"], "DatabaseName", "SequenceName", "ParentColumn") == (
        "MySales", "dbo.Orders_seq", "Id")
    assert [r.wait_type for r in ref.out["wait_stats"].collect()] == ["A", "B", "C"]
    assert ref.out["jobs"].count() == 9


def test_column_store_flag(ref, meant):
    mine = F.col("database_id") == MYSALES
    assert one(ref.g["databases_view"].filter(mine), "column_stores") == (0,)
    assert one(meant.g["databases_view"].filter(mine), "column_stores") == (1,)


def test_names_do_not_cross_servers(ref):
    far = ref.g["cross_database_hits"].filter(F.col("server_id") == OLD)
    assert far.count() == 0
