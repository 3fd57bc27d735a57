"""A hand-written estate: two servers, four user databases, and a row for every case that matters."""

from __future__ import annotations

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from estatescope.sources.schemas import BRONZE

NEW, OLD = 1, 2
MASTER, TEMPDB, SALES, STAGE, MYSALES, EMPTY = 1, 2, 5, 6, 7, 8
SIZES = [None, 0, 1, 6_000_000, 6_000_001, 60_000_000, 60_000_001, 1_000_000_000, 1_000_000_001]
SCHEDULES = [(1, 20240131), (4, 0), (8, 0), (16, 0), (32, 0), (64, 0), (128, 0), (3, 0)]

FOR_XML = "select 1 FOR XML PATH"
CURSOR = "DECLARE c\nCURSOR for select 1"
ONLY_CURSOR = "close cursor c"


def _rows() -> dict[str, list[dict]]:
    t: dict[str, list[dict]] = {name: [] for name in BRONZE}

    def add(view: str, /, **values):
        t[view].append(values)

    for server, name, version in ((NEW, "SRV1", "Microsoft SQL Server 2019 (RTM) on Windows"),
                                  (OLD, "SRV2", "Microsoft SQL Server 2008 (SP4)")):
        add("servers", server_id=server, server_name=name, version=version, is_active=True)
        add("server_properties", server_id=server, server_name=name.lower(), version=version,
            edition="Enterprise", windows_release="6.3", cpu_count=8, hyperthread_ratio=2,
            memory_kb=2_097_152, vm_type="NONE", build="15.0", governor_enabled=1,
            create_date=dt.datetime(2020, 1, 1))
        # Linked servers: own entry, and LNK1 twice.
        add("sysservers", server_id=server, srvname=name, providername="OWN")
        add("sysservers", server_id=server, srvname="LNK1", providername="ODBC")
        add("sysservers", server_id=server, srvname="LNK1", providername="ODBC")
        add("cluster_nodes", server_id=server, node_name="n1", status=0,
            status_description="up", is_current_owner=True)
    add("services", server_id=NEW, servicename="SQL Server (MSSQLSERVER)", service_account="svc")
    add("services", server_id=NEW, servicename="SQL Server (MSSQLSERVER)", service_account="svc")
    add("services", server_id=NEW, servicename="Agent", service_account="agent")
    add("configurations", server_id=NEW, name="max memory", value="100")

    for db, name in ((MASTER, "master"), (TEMPDB, "tempdb"), (SALES, "Sales"), (STAGE, "Stage"),
                     (MYSALES, "MySales"), (EMPTY, "Empty1")):
        add("databases", server_id=NEW, database_id=db, name=name, state_desc="ONLINE",
            owner_sid="sa", source_database_id=SALES if db == STAGE else None,
            is_encrypted=True, is_cdc_enabled=True, delayed_durability_desc="DISABLED")
    add("databases", server_id=OLD, database_id=SALES, name="Sales", state_desc="ONLINE",
        is_encrypted=True, delayed_durability_desc="DISABLED")
    add("databases", server_id=OLD, database_id=STAGE, name="Gone", state_desc="OFFLINE")
    add("logins", server_id=NEW, sid="sa", loginname="sa")
    for server in (NEW, OLD):
        add("performance_counters", server_id=server, instance_name="sales",
            counter_name="Log File(s) Used Size (KB)      ", cntr_value=1)
        add("performance_counters", server_id=server, instance_name="Sales",
            counter_name="Log File(s) Size (KB)", cntr_value=3)
    add("performance_counters", server_id=NEW, instance_name="Stage",
        counter_name="Log File(s) Size (KB)", cntr_value=0)
    for i, (kind, size) in enumerate((("ROWS", 300), ("ROWS", 255), ("LOG", 128))):
        add("master_files", server_id=NEW, database_id=SALES, file_id=i, type_desc=kind, size=size)
    for _ in range(300):
        add("buffer_descriptors", server_id=NEW, database_id=SALES)
    add("query_stats", server_id=NEW, dbid=SALES, total_worker_time=7)
    add("virtual_file_stats", server_id=NEW, database_id=SALES, num_of_bytes_read=2_000_000,
        num_of_bytes_written=200_000)

    dbs = [(NEW, d) for d in (MASTER, TEMPDB, SALES, STAGE, MYSALES, EMPTY)] + [(OLD, SALES)]
    for server, db in dbs:
        add("schemas", server_id=server, database_id=db, schema_id=1, name="dbo")
        add("filegroups", server_id=server, database_id=db, data_space_id=1)
        add("data_spaces", server_id=server, database_id=db, data_space_id=1, name="PRIMARY")
        for s, u, name in ((56, 56, "int"), (167, 167, "varchar"), (167, 300, "phone"),
                           (231, 231, "nvarchar"), (231, 256, "sysname"), (35, 35, "text"),
                           (130, 130, "geography"), (241, 241, "xml"), (34, 34, "image")):
            add("types", server_id=server, database_id=db, system_type_id=s, user_type_id=u,
                name=name)

    def obj(db, id_, name, kind, server=NEW, **more):
        desc = {"U": "USER_TABLE", "V": "VIEW"}.get(kind.strip().upper(), "OTHER")
        add("objects", server_id=server, database_id=db, object_id=id_, name=name, schema_id=1,
            type=kind, type_desc=desc, **more)
        if kind.strip().upper() == "U":
            add("tables", server_id=server, database_id=db, object_id=id_, name=name, schema_id=1,
                is_published=False, type=kind)

    def routine(db, id_, name, kind, text, server=NEW):
        obj(db, id_, name, kind, server)
        add("routines", server_id=server, database_id=db, schema="DBO", name=name.upper(),
            sql_data_access="MODIFIES", definition=text)

    # Size classes.
    for i, rows in enumerate(SIZES):
        obj(SALES, 100 + i, f"T{i}", "u ")
        if rows is not None:
            add("partitions", server_id=NEW, database_id=SALES, object_id=100 + i, index_id=1,
                partition_id=1000 + i, hobt_id=2000 + i, rows=rows)
        # Rows of a secondary index do not count.
        add("partitions", server_id=NEW, database_id=SALES, object_id=100 + i, index_id=7,
            partition_id=3000 + i, hobt_id=4000 + i, rows=5)
    obj(SALES, 150, "syncobj_1", "V ")

    # Routines: other servers, other databases, constructs.
    routine(SALES, 201, "linked", "P ", "select * from Lnk1.x.dbo.t")
    routine(SALES, 202, "linked2", "P ", "select * from [LNK1].x.dbo.t")
    routine(SALES, 203, "to_stage", "P ", "select * from stage.dbo.t")
    routine(SALES, 204, "to_both", "P ", "select * from Sales.dbo.t, [Stage].dbo.t")
    routine(STAGE, 205, "to_mysales", "FN", "select * from MySales.dbo.t")
    routine(STAGE, 206, "xml_user", "IF", FOR_XML)
    routine(STAGE, 207, "cursor_user", "TF", CURSOR)
    routine(STAGE, 208, "no_cursor", "P ", ONLY_CURSOR)
    routine(SALES, 209, "far", "P ", "select * from stage.dbo.t", server=OLD)
    obj(STAGE, 210, "fk", "F ")
    add("foreign_keys", server_id=NEW, database_id=STAGE, name="FK", is_disabled=True,
        delete_referential_action_desc="NO_ACTION")
    obj(STAGE, 211, "ck", "C ")
    add("check_constraints", server_id=NEW, database_id=STAGE, name="ck", is_disabled=False,
        definition="(x > 1)")
    obj(STAGE, 212, "trg", "TR")
    obj(STAGE, 213, "vw", "V ")
    add("views", server_id=NEW, database_id=STAGE, schema="dbo", name="vw", definition="select 1")

    # A table with every kind of column, its indexes and its sequence.
    obj(MYSALES, 300, "Orders", "U ")
    add("partitions", server_id=NEW, database_id=MYSALES, object_id=300, index_id=0,
        partition_id=50, hobt_id=50, rows=10)
    columns = [("Id", 56, 4, dict(is_identity=True)), ("Id2", 56, 4, {}), ("d2", 56, 4, {}),
               ("geo", 130, -1, {}), ("doc", 241, -1, {}), ("pic", 34, 16, {}),
               ("note", 35, 16, {}), ("long1", 167, -1, {}), ("long2", 231, -1, {}),
               ("phone", 167, 20, {}), ("sum", 56, 4, dict(is_computed=True)),
               ("made", 56, 4, dict(default_object_id=901)),
               ("zero", 56, 4, dict(default_object_id=902)), ("DateCreated", 56, 4, {}),
               ("rv", 56, 4, dict(is_replicated=True)), ("id_OLD", 56, 4, {})]
    for i, (name, kind, length, more) in enumerate(columns):
        user = 300 if name == "phone" else kind
        add("columns", server_id=NEW, database_id=MYSALES, object_id=300, column_id=i + 1,
            name=name, system_type_id=kind, user_type_id=user, max_length=length, precision=10,
            scale=0, **{"is_nullable": True, "is_replicated": False, "is_computed": False,
                        "is_identity": False, **more})
    add("default_constraints", server_id=NEW, database_id=MYSALES, object_id=901,
        definition="(getdate())")
    add("default_constraints", server_id=NEW, database_id=MYSALES, object_id=902,
        definition="((0))")
    for index, name, unique in ((0, None, False), (3, "ix_three", True), (2, "ix_two", True)):
        add("indexes", server_id=NEW, database_id=MYSALES, object_id=300, index_id=index,
            name=name, type_desc="HEAP" if index == 0 else "NONCLUSTERED", is_unique=unique,
            is_disabled=False, fill_factor=80, data_space_id=1)
    # ix_two: two partitions of 127 pages; the filegroup has two files.
    for part in (61, 62):
        add("partitions", server_id=NEW, database_id=MYSALES, object_id=300, index_id=2,
            partition_id=part, hobt_id=part + 100, rows=5, data_compression_desc="COLUMNSTORE")
        add("allocation_units", server_id=NEW, database_id=MYSALES, type=1,
            type_desc="IN_ROW_DATA", container_id=part + 100, total_pages=127, used_pages=127,
            data_pages=127, data_space_id=1)
    # A unit of kind 2 goes by partition id; its number is also a hobt id, which must not match.
    add("allocation_units", server_id=NEW, database_id=MYSALES, type=2, type_desc="LOB_DATA",
        container_id=50, total_pages=256, used_pages=128, data_pages=128, data_space_id=1)
    for file_id, size in ((1, 1280), (2, 128)):
        add("database_files", server_id=NEW, database_id=MYSALES, data_space_id=1,
            file_id=file_id, name=f"f{file_id}", physical_name=f"/data/f{file_id}", size=size,
            space_used=100)
    add("database_files", server_id=NEW, database_id=MYSALES, data_space_id=0, file_id=3,
        name="log", physical_name="/data/log", size=256, space_used=0)
    add("index_usage_stats", server_id=NEW, database_id=MYSALES, object_id=300, index_id=2,
        user_seeks=3, user_scans=4, user_updates=5)
    for at, (column, extra) in enumerate(((2, False), (1, False), (14, True))):
        add("index_columns", server_id=NEW, database_id=MYSALES, object_id=300, index_id=2,
            column_id=column, key_ordinal=2 - at, index_column_id=at, is_included_column=extra)
    for i, (name, current) in enumerate((("Orders_seq", 10), ("lost_seq", 1))):
        obj(MYSALES, 400 + i, name, "SO")
        add("sequences", server_id=NEW, database_id=MYSALES, object_id=400 + i, name=name,
            start_value=1, current_value=current)
    for value in [*range(1, 13), 20]:
        add("sequence_parent_values", server_id=NEW, database_id=MYSALES, schema="dbo",
            sequence_name="Orders_seq", value=value)

    # Waits: one ignored, one zero, three that count.
    for kind, wait, top, signal in (("CHKPT", 1000, 9, 1), ("IDLE", 0, 0, 0), ("A", 50, 30, 10),
                                    ("B", 30, 20, 30), ("C", 20, 10, 0)):
        add("wait_stats", server_id=NEW, wait_type=kind, wait_time_ms=wait, max_wait_time_ms=top,
            signal_wait_time_ms=signal)

    gib = 1024 ** 3
    for file_id in (0, 1):
        add("volume_stats", server_id=NEW, database_id=SALES, file_id=file_id,
            volume_mount_point="C:\\", total_bytes=10 * gib, available_bytes=3 * gib - 1)

    # Procedures: twelve with statistics, one of them never run.
    for i in range(12):
        add("procedures", server_id=NEW, database_id=SALES, object_id=500 + i, schema_id=1,
            name=f"p{i:02}")
        add("procedure_stats", server_id=NEW, database_id=SALES, object_id=500 + i,
            total_worker_time=100 * (i + 1), execution_count=0 if i == 11 else 7,
            total_elapsed_time=50, cached_time=dt.datetime(2024, 1, 1))

    # Jobs: one per schedule code; the last has two schedules, of which the first counts.
    for i, (code, start) in enumerate(SCHEDULES):
        job = f"job-{i}"
        add("jobs", server_id=NEW, job_id=job, name=f"job {i}", enabled=True, start_step_id=1,
            owner_sid="sa", notify_email_operator_id=1)
        add("jobsteps", server_id=NEW, job_id=job, step_id=1, step_name="first", command="go")
        add("jobschedules", server_id=NEW, job_id=job, schedule_id=i, next_run_time=93005)
        add("schedules", server_id=NEW, schedule_id=i, schedule_uid=f"u{i}", name=f"s{i}",
            freq_type=code, freq_interval=10 if code == 32 else 34, freq_subday_type=1,
            freq_subday_interval=0, freq_relative_interval=16, freq_recurrence_factor=1,
            active_start_date=start or 20240201, active_end_date=99991231,
            active_start_time=93005 if code == 1 else 90000, active_end_time=235959,
            date_created=dt.datetime(2024, 1, 5, 15, 7))
    add("jobschedules", server_id=NEW, job_id="job-7", schedule_id=99, next_run_time=1)
    add("jobs", server_id=NEW, job_id="job-x", name="no schedule", enabled=False, start_step_id=1)
    add("operators", server_id=NEW, id=1, name="ops", enabled=True, email_address="ops@x")

    # An availability group; Sales is its database.
    add("availability_groups", server_id=NEW, group_id="g", name="AG1")
    add("availability_group_states", server_id=NEW, group_id="g", primary_replica="SRV1")
    for replica, name, local in (("r1", "srv1", True), ("r2", "SRV9", False)):
        add("availability_replicas", server_id=NEW, replica_id=replica, group_id="g",
            replica_server_name=name)
        add("availability_replica_states", server_id=NEW, replica_id=replica, is_local=local)
    add("availability_db_cluster_states", server_id=NEW, replica_id="r1", group_database_id="d",
        database_name="SALES", is_database_joined=True)
    return t


def write_snapshot(path: str) -> None:
    """One parquet file per catalog view."""
    for name, rows in _rows().items():
        schema = to_arrow_schema(StructType.fromDDL(BRONZE[name]))
        os.makedirs(f"{path}/{name}")
        pq.write_table(pa.Table.from_pylist(rows, schema), f"{path}/{name}/part.parquet")
