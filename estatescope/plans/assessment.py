"""The whole assessment: snapshots -> inventory -> gold -> reports.

Every layer is a dictionary of jobs.  A job takes the tables of its layer made so far,
so the same definitions run lazily (:func:`evaluate`) or stored one by one
(:func:`estatescope.sources.sinks.collect_all`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from estatescope.plans import rules, views
from estatescope.plans.reports import report_jobs
from estatescope.plans.resume import PER_DATABASE, changes, fingerprints, merge, only
from estatescope.sources import collectors as c
from estatescope.sources.sinks import ERRORS, add_missing, append, collect_all, failure, refresh, replace
from estatescope.sources.snapshot import land
from estatescope.sources.texts import KEY, TEXT, load_texts, with_texts
from estatescope.workspace import stored, work_folder

Tables = dict[str, DataFrame]
Jobs = dict[str, Callable[[Tables], DataFrame]]


def inventory_jobs(b: Tables, as_of: Column | None = None, mode: str = "reference",
                   done: DataFrame | None = None) -> Jobs:
    """Jobs of the silver tables, from the snapshot tables ``b``; of databases in ``done`` no columns are loaded."""
    as_of = F.current_timestamp() if as_of is None else as_of

    def known(s: Tables) -> Tables:
        return {**b, "servers": s["servers"]}

    def named(s: Tables) -> DataFrame:
        return c.with_server_name(s["databases"], s["servers"])

    return {
        "servers": lambda s: c.load_servers(b["servers"], b["server_properties"]),
        "linked_servers": lambda s: c.load_linked_servers(s["servers"], b["sysservers"]),
        "services": lambda s: c.load_services(b["services"]),
        "cluster_nodes": lambda s: c.load_cluster_nodes(b["cluster_nodes"], s["servers"]),
        "availability_groups": lambda s: c.load_availability_groups(
            b["availability_groups"], b["availability_replicas"], b["availability_group_states"],
            b["availability_replica_states"], s["servers"]),
        "sys_configurations": lambda s: c.load_sys_configurations(
            s["servers"], b["configurations"]),
        "databases": lambda s: c.load_databases(known(s)),
        "top_sql": lambda s: c.load_top_sql(
            b["procedures"], b["procedure_stats"], b["schemas"], as_of,
            databases=s["databases"]),
        "top_wait": lambda s: c.load_top_wait(b["wait_stats"], mode=mode),
        "volumes": lambda s: c.load_volumes(b["master_files"], b["volume_stats"], s["servers"]),
        "jobs": lambda s: c.load_jobs(b["jobs"], b["jobsteps"], b["jobschedules"],
                                      b["schedules"], b["operators"], b["logins"], mode),
        "job_steps": lambda s: c.load_job_steps(b["jobs"], b["jobsteps"], b["jobschedules"],
                                                b["schedules"], s["jobs"]),
        "database_files": lambda s: c.load_database_files(
            b["database_files"], b["data_spaces"], named(s)),
        "texts": lambda s: load_texts(b),
        "objects": lambda s: c.load_database_objects(known(s), named(s), mode),
        "columns": lambda s: c.load_columns(b, named(s), s["objects"], done, mode),
        "index_usage": lambda s: c.load_index_usage(b, named(s), s["objects"], mode),
        "sequences": lambda s: c.load_sequences(s["objects"], b["sequence_parent_values"]),
    }


def gold_jobs(s: Tables, mode: str = "reference") -> Jobs:
    """Jobs of the views and findings, from the silver tables ``s``."""
    return {
        "index_view": lambda g: views.index_usage_view(s),
        "databases_view": lambda g: views.databases_view(s, mode),
        "objects_view": lambda g: views.database_objects_view(s, mode, g["index_view"]),
        "columns_view": lambda g: views.columns_view(s, g["objects_view"], mode),
        "servers_view": lambda g: views.servers_view(s, g["databases_view"], mode),
        "top_sql_view": lambda g: views.top_sql_view(s),
        "top_wait_view": lambda g: views.top_wait_view(s),
        "database_files_view": lambda g: views.database_files_view(s),
        "availability_groups_view": lambda g: views.availability_groups_view(s),
        "cluster_nodes_view": lambda g: views.cluster_nodes_view(s),
        "jobs_view": lambda g: views.jobs_view(s),
        "volumes_view": lambda g: views.volumes_view(s),
        "routine_findings": lambda g: rules.routine_findings(g["objects_view"], s["texts"]),
        "column_findings": lambda g: rules.column_findings(g["columns_view"], mode),
        "column_counts": lambda g: rules.column_counts(s["columns"], g["objects_view"], mode),
        "reference_hits": lambda g: rules.reference_hits(
            g["objects_view"], s["texts"], s["linked_servers"], s["databases"], mode),
        "cross_server_hits": lambda g: rules.cross_server_hits(g["reference_hits"]),
        "cross_database_hits": lambda g: rules.cross_database_hits(g["reference_hits"]),
    }


def rule_jobs(g: Tables, s: Tables) -> Jobs:
    """The eight rule tables, as filters on the findings; those of routines with the text."""
    return {
        "cross_server_routines": lambda _: with_texts(
            g["cross_server_hits"].drop("schema_key", "object_key"), s["texts"]),
        "cross_database_routines": lambda _: with_texts(
            g["cross_database_hits"].drop("schema_key", "object_key"), s["texts"]),
        "incompatible_routine_types": lambda _: with_texts(
            rules.incompatible_routine_types(g["routine_findings"]), s["texts"]),
        "incompatible_routines": lambda _: with_texts(
            rules.incompatible_routines(g["routine_findings"]), s["texts"]),
        "incompatible_columns": lambda _: rules.incompatible_columns(g["column_findings"]),
        "computed_columns": lambda _: rules.computed_columns(g["column_findings"]),
        "large_text_columns": lambda _: rules.large_text_columns(g["column_findings"]),
        "invalid_defaults": lambda _: rules.invalid_defaults(g["column_findings"]),
    }


class _Evaluated(dict):
    """Tables of a layer, each built when first asked for."""

    def __init__(self, jobs: Jobs, kept: dict[str, str]):
        super().__init__()
        self._jobs, self._kept = jobs, kept

    def __missing__(self, name: str) -> DataFrame:
        df = self._jobs[name](self)
        self[name] = stored(df, self._kept[name]) if name in self._kept else df
        return self[name]

    def all(self) -> Tables:
        return {name: self[name] for name in self._jobs}


def evaluate(jobs: Jobs, kept: dict[str, str] | None = None) -> _Evaluated:
    """The tables of a layer as unevaluated DataFrames; those named in ``kept`` are written to the folder given there
    when they are first asked for, so that what several others read is computed once."""
    return _Evaluated(jobs, kept or {})


def run_assessment(spark: SparkSession, snapshot: str, out: str, fmt: str = "parquet",
                   as_of: Column | None = None, mode: str = "reference",
                   server_ids: Sequence[int] | None = None, resume: bool = False) -> tuple[Tables, DataFrame]:
    """Load a snapshot, store every layer below ``out``, return the reports and the errors.

    A table is written before the next one reads it.  That cuts the lineage with files that
    outlive an executor, and evaluates shared views once instead of once per report.  Tables are
    partitioned by server; with ``server_ids`` only those servers' rows are loaded and replaced, and
    the reports cover all.  With ``resume`` databases that are as they were in the last run that ended well are not
    loaded again (``resume.py``): the tables are those of a full load.  A table that fails is logged and left out, and so is, with that
    cause, whatever needs it; all other reports are written, too, and returned in their order.  Rows of CSV and JSON
    that do not fit go to ``<out>/rejected`` and into the log, not into the tables.
    """
    def write(df: DataFrame, path: str) -> None:
        if "server_id" in df.columns:
            refresh(df, path, server_ids)
        elif server_ids is not None and df.columns == [KEY, TEXT]:  # the other servers' texts stay
            add_missing(df, path, [KEY])
        else:
            replace(df, path)

    missing: list[str] = []
    b, rejected = land(spark, snapshot, fmt, out, missing)
    jobs, inventory = inventory_jobs(b, as_of, mode), f"{out}/inventory"
    if not resume:
        s, errors = collect_all(spark, jobs, inventory, write)
    else:
        first = {name: job for name, job in jobs.items() if name not in PER_DATABASE}
        s, errors = collect_all(spark, first, inventory, write)
        if "databases" in s and "servers" in s:
            at = f"{out}/loaded"
            now = stored(fingerprints(b, s, mode), f"{work_folder(spark, 'fingerprints')}/now")
            found = changes(spark, now, at)
            few = inventory_jobs(only(b, found.changed), as_of, mode, found.same)
            s, more = collect_all(spark, {n: few[n] for n in few if n in PER_DATABASE}, inventory, merge(found), s)
            errors = errors.unionByName(more)
            if errors.isEmpty() and found.servers:
                refresh(found.now, at)
    g, more = collect_all(spark, gold_jobs(s, mode), f"{out}/gold", write)
    _, rest = collect_all(spark, rule_jobs(g, s), f"{out}/rules", write)
    made, now = {}, datetime.now()
    failures = [(now, f"no folder {snapshot}/{name}: read as empty", f"snapshot {name}") for name in missing]
    failures += [(now, f"{n} rows do not fit the schema: {out}/rejected/{name}", f"snapshot {name}")
                 for name, n in rejected.items()]
    for name, job in report_jobs(g, s, mode).items():
        try:
            report = job()
            replace(report, f"{out}/reports/{name}")
            made[name] = report
        except Exception as error:  # the reports that do not need a failed table are still made
            failures.append(failure(error, f"report {name}", now))
    missed = spark.createDataFrame(failures, ERRORS)
    if failures:
        append(missed, f"{out}/reports/exec_errors")
    return made, errors.unionByName(more).unionByName(rest).unionByName(missed)
