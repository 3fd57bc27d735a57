"""Every server generation with all its snapshot fields filled: what each reports, by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from estatescope.sources import collectors as c
from estatescope.sources.schemas import BRONZE

VERSIONS = {1: ("2000", "Microsoft SQL Server  2000 - 8.00"), 2: ("2005", "Microsoft SQL Server 2005 - 9.00"),
            3: ("2008", "Microsoft SQL Server 2008 R2"), 4: ("2012", "Microsoft SQL Server 2012 (SP1)"),
            5: ("latest", "Microsoft SQL Server 2019 (RTM) on Windows"), 6: ("azure", "Microsoft SQL Azure (RTM)"),
            7: ("2000", None)}
VERSIONS[1] = ("2000", "Microsoft SQL Server 2000 - 8.00")


def _value(field):
    return {"string": "x", "int": 3, "bigint": 3, "boolean": True, "timestamp": dt.datetime(2020, 1, 1)}.get(
        field.dataType.simpleString())


def _table(spark, name, rows):
    """Rows of a snapshot table, every field that is not given filled."""
    schema = StructType.fromDDL(BRONZE[name])
    return spark.createDataFrame([tuple(r.get(f.name, _value(f)) for f in schema) for r in rows], schema)


@pytest.fixture(scope="module")
def snapshot(spark):
    ids = list(VERSIONS)
    b = {name: _table(spark, name, []) for name in BRONZE}
    rows = {
        "servers": [{"server_name": f"S{i}", "version": VERSIONS[i][1]} for i in ids],
        "server_properties": [{"server_name": f"s{i}", "version": VERSIONS[i][1], "cpu_count": 8, "hyperthread_ratio": 2,
                               "memory_kb": 4096} for i in ids],
        "databases": [{"database_id": 5, "name": "Db", "owner_sid": "sa", "source_database_id": 5} for _ in ids],
        "logins": [{"sid": "sa", "loginname": "owner"} for _ in ids],
        "performance_counters": [
            {"counter_name": n, "instance_name": "db", "cntr_value": v} for _ in ids
            for n, v in (("Log File(s) Size (KB)", 8), ("Log File(s) Used Size (KB)", 2))],
        "master_files": [{"database_id": 5, "type_desc": k, "size": 256} for _ in ids for k in ("ROWS", "LOG")],
        "buffer_descriptors": [{"database_id": 5} for _ in ids for _ in range(256)],
        "query_stats": [{"dbid": 5, "total_worker_time": 9} for _ in ids],
        "virtual_file_stats": [{"database_id": 5, "num_of_bytes_read": 1 << 20, "num_of_bytes_written": 1 << 20}
                               for _ in ids],
        "database_mirroring": [{"database_id": 5} for _ in ids],
        "database_service_objectives": [{"database_id": 5, "edition": "Premium"} for _ in ids],
        "availability_groups": [{"group_id": "g", "name": "AG"} for _ in ids],
        "availability_group_states": [{"group_id": "g", "primary_replica": "P"} for _ in ids],
        "availability_replicas": [{"group_id": "g", "replica_id": "r"} for _ in ids],
        "availability_replica_states": [{"replica_id": "r", "is_local": True, "role": 1} for _ in ids],
        "availability_db_cluster_states": [{"replica_id": "r", "group_database_id": "d", "database_name": "DB",
                                            "is_database_joined": True} for _ in ids],
        "availability_db_replica_states": [{"replica_id": "r", "group_database_id": "d", "synchronization_state": 2,
                                            "is_suspended": False} for _ in ids],
    }
    for name, found in rows.items():
        each = len(found) // len(ids)
        b[name] = _table(spark, name, [{**r, "server_id": ids[i // each]} for i, r in enumerate(found)])
    return b


def test_generations_are_told_by_their_version(snapshot):
    got = {r.server_id: r.f for r in snapshot["servers"].select(
        "server_id", c.version_family(F.col("version")).alias("f")).collect()}
    assert got == {i: family for i, (family, _) in VERSIONS.items()}


# Fields of a server that a generation reports; the others are NULL.
_SERVER = {
    "2000": {}, "2005": {"created_date", "logical_cpu_count", "hyperthread_ratio", "physical_cpu_count", "physical_memory_mb"},
}
_SERVER["2008"] = _SERVER["2005"] | {"governor_functions"}
_SERVER["2012"] = _SERVER["latest"] = _SERVER["2008"] | {"windows_release", "vm_type"}
_SERVER["azure"] = {}


def test_servers_of_every_generation(snapshot):
    rows = {r.server_id: r for r in c.load_servers(snapshot["servers"], snapshot["server_properties"]).collect()}
    told = _SERVER["latest"]
    for i, (family, version) in VERSIONS.items():
        assert {f for f in told if rows[i][f] is not None} == set(_SERVER[family]), family
        assert (rows[i].edition, rows[i].collation, rows[i].build, rows[i].version) == ("x", "x", "x", version)
    assert (rows[2].physical_cpu_count, rows[2].physical_memory_mb) == (4, 4)


# Values of a database by generation: (recovery model, log size, log used %, data MB, cached, CPU, IO, recovery time).
_DATABASE = {
    "2000": (None, None, None, None, None, None, None, None),
    "2005": ("x", 8, "25.00", 2, 0, None, 0, -1),
    "2008": ("x", 8, "25.00", 2, 0, None, 0, -1),
    "2012": ("x", 8, "25.00", 2, 2, 9, 2, -1),
    "latest": ("x", 8, "25.00", 2, 2, 9, 2, -1),
    "azure": ("x", None, None, 0, 0, 0, 0, 0),
}
# Fields that only some generations have.
_SOME = {
    "is_cdc_enabled": {"2008", "2012", "latest", "azure"}, "is_encrypted": {"2008", "2012", "latest", "azure"},
    "is_memory_optimized_elevate_to_snapshot_on": {"latest"}, "delayed_durability_desc": {"latest"},
    "containment_desc": {"2012", "latest", "azure"}, "availability_group": {"2012", "latest"},
    "primary_replica": {"2012", "latest"}, "local_replica_role": {"2012", "latest"}, "is_joined": {"2012", "latest"},
    "owner": {"2005", "2008", "2012", "latest"}, "source_database_name": {"2005", "2008", "2012", "latest"},
    "mirroring_state_desc": {"2005", "2008", "2012", "latest"}, "edition": {"azure"}, "service_objective": {"azure"},
    "elastic_pool_name": {"azure"}, "is_read_only": {"2005", "2008", "2012", "latest", "azure"},
    "page_verify_option": {"2005", "2008", "2012", "latest", "azure"},
    "state_desc": {"2005", "2008", "2012", "latest", "azure"}, "create_date": {"2005", "2008", "2012", "latest", "azure"},
}


def test_databases_of_every_generation(snapshot):
    rows = {r.server_id: r for r in c.load_databases(snapshot).collect()}
    assert len(rows) == len(VERSIONS)
    for i, (family, _) in VERSIONS.items():
        r = rows[i]
        assert (r.recovery_model, r.log_size_kb, r.log_used_percentage, r.data_mb, r.cached_size_mbs, r.cpu_time, r.io_mbs,
                r.target_recovery_time_in_seconds) == _DATABASE[family], family
        assert {f for f in _SOME if r[f] is not None} == {f for f, has in _SOME.items() if family in has}, family
        assert r.database_name == "Db"
    assert (rows[5].availability_group, rows[5].primary_replica, rows[5].local_replica_role,
            rows[5].synchronization_state, rows[5].is_suspended) == ("AG", "P", 1, 2, False)


def test_objects_of_warehouses_and_cloud_databases(spark, snapshot):
    """A warehouse table without partitions has 0 rows, elsewhere NULL; sequences come from 2012 on, not from
    warehouses and not from the cloud."""
    ids = [3, 4, 5, 6]
    databases = spark.createDataFrame(
        [(i, 5 + w, f"Db{w}", "ONLINE", None, "DataWarehouse" if w else None, f"S{i}") for i in ids for w in (0, 1)],
        "server_id int, database_id int, database_name string, state_desc string, primary_replica string, edition string, "
        "server_name string")
    each = [(i, 5 + w) for i in ids for w in (0, 1)]
    b = dict(snapshot)
    b["schemas"] = _table(spark, "schemas", [{"server_id": i, "database_id": d, "schema_id": 1, "name": "dbo"} for i, d in each])
    b["objects"] = _table(spark, "objects", [
        {"server_id": i, "database_id": d, "object_id": n, "name": name, "schema_id": 1, "type": kind}
        for i, d in each for n, name, kind in ((1, "T", "U "), (2, "Seq_seq", "SO"))])
    got = {(r.server_id, r.database_id, r.object_name): r for r in c.load_database_objects(b, databases).collect()}
    tables = {k[:2]: r.row_count for k, r in got.items() if k[2] == "T"}
    assert tables == {(i, d): 0 if d == 6 else None for i, d in each}
    assert {k[:2] for k in got if k[2] == "Seq_seq"} == {(4, 5), (5, 5)}
