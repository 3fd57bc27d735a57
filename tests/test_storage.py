"""Snapshot reading, sinks, and the stored assessment."""

import csv

import pytest
from pyspark.sql import functions as F

from estatescope.plans.assessment import run_assessment
from estatescope.sources import sinks
from estatescope.sources.schemas import BRONZE
from estatescope.sources.snapshot import REJECT, read_all, read_snapshot, split_rejected


def test_refresh_replaces_only_the_given_servers(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(s, "old") for s in (1, 2, 3)], "server_id int, v string")
    sinks.refresh(old, path)
    fresh = spark.createDataFrame([(1, "new"), (2, "new")], "server_id int, v string")
    sinks.refresh(fresh, path, server_ids=[2, 3])
    got = {(r.server_id, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "old"), (2, "new")}
    sinks.refresh(fresh, path)
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_snapshot_formats(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(1, "A", 5, 4, None), (2, "B", None, 1, 1)],
                                 "server_id int, wait_type string, wait_time_ms bigint, "
                                 "max_wait_time_ms bigint, signal_wait_time_ms bigint")
    writer = rows.write.option("header", "true") if fmt == "csv" else rows.write
    writer.format(fmt).save(str(tmp_path / "wait_stats"))
    got = read_snapshot(spark, str(tmp_path), "wait_stats", fmt).select(*rows.columns)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in rows.collect()}


def test_bad_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "wait_stats").mkdir()
    (tmp_path / "wait_stats" / "a.json").write_text(
        '{"server_id": 1, "wait_type": "A"}\n{"server_id": "no number"}\n')
    good, bad = split_rejected(read_snapshot(spark, str(tmp_path), "wait_stats", "json"))
    assert [r.wait_type for r in good.collect()] == ["A"]
    assert "no number" in bad.first()[0]


@pytest.mark.parametrize("name, column", [("jobsteps", "command"), ("jobs", "description"), ("servers", "description")])
def test_csv_values_hold_line_ends(spark, tmp_path, name, column):
    value = 'first line\nsecond, "quoted" line\n\nlast'
    empty = spark.createDataFrame([], BRONZE[name])
    fields = {f: value if f == column else "1" if f == "server_id" else "" for f in empty.columns}
    (tmp_path / name).mkdir()
    with open(tmp_path / name / "a.csv", "w", newline="") as file:
        writer = csv.DictWriter(file, fields)
        writer.writeheader()
        writer.writerows([fields, fields])
    good, bad = split_rejected(read_all(spark, str(tmp_path), "csv")[name])
    assert [r[column] for r in good.collect()] == [value, value] and bad.isEmpty()


def _csv_with_line_ends(folder, rows, seed=1):
    """Quoted values with line ends, quotes and commas; some records are longer than a split."""
    import random
    rng = random.Random(seed)
    # Read as a whole, values of a file with CRLF between its records lose their CRs; in splits they keep them.
    value = lambda: "".join(rng.choices(
        ["x", ",", "\n", "\n" if part == 1 else "\r\n", '"', '""', " ", "text\n", "é"], k=rng.randint(0, 80)))
    empty = BRONZE["jobsteps"]
    names = [c.strip().split()[0] for c in empty.split(",")]
    folder.mkdir(parents=True)
    for part in range(3):
        with open(folder / f"{part}.csv", "w", newline="", encoding="utf-8") as file:
            writer = csv.DictWriter(file, names, lineterminator="\r\n" if part == 1 else "\n")
            writer.writeheader()
            for i in range(rows):
                command = value() if i % 31 else value() * 40
                writer.writerow({n: "" for n in names} | {"server_id": part, "step_id": i, "command": command or "c"})


def test_csv_with_line_ends_is_read_in_splits(spark, tmp_path):
    """Splits far smaller than the files, so that their borders fall anywhere: into values, onto quotes and line ends."""
    from estatescope.sources.csv_records import csv_lines
    _csv_with_line_ends(tmp_path / "jobsteps", 100)
    sizes = {"spark.sql.files.maxPartitionBytes": "911", "spark.sql.files.openCostInBytes": "0",
             "spark.sql.files.minPartitionNum": "1"}
    whole = read_snapshot(spark, str(tmp_path), "jobsteps", "csv", multi_line=True).collect()
    old = {k: spark.conf.get(k, None) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        assert csv_lines(spark, str(tmp_path / "jobsteps")).rdd.getNumPartitions() > 30
        split = read_snapshot(spark, str(tmp_path), "jobsteps", "csv").collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(split) == 300 and not any(r[REJECT] for r in split)
    assert sorted(map(repr, split)) == sorted(map(repr, whole))
    assert sorted(map(repr, read_snapshot(spark, str(tmp_path), "jobsteps", "csv").collect())) == sorted(map(repr, whole))


def test_quotes_on_the_borders_of_splits(spark, tmp_path):
    from estatescope.sources.csv_records import csv_records
    text = 'h\n"a\nb"\nc\n"d\n\n"\n"e""\n""f"\n"""\n"""\n\ng\n'
    want = ['"a\nb"', "c", '"d\n\n"', '"e""\n""f"', '"""\n"""', "g"]
    (tmp_path / "t.csv").write_text(text)
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    try:
        for size in (2, 5):
            for k, v in zip(keys, [str(size), "0", "1"], strict=True):
                spark.conf.set(k, v)
            got = sorted(r.record for r in csv_records(spark, str(tmp_path / "t.csv")).collect())
            assert got == sorted(want), size
    finally:
        spark.conf.set(keys[0], "32m")
        for k in keys[1:]:
            spark.conf.unset(k)


AS_OF = "2024-01-01 00:00:02"


@pytest.fixture(scope="module")
def plain_run(spark, snapshot_path, tmp_path_factory):
    """(folder, reports, errors) of an assessment of the Parquet snapshot."""
    out = str(tmp_path_factory.mktemp("assessment"))
    return out, *run_assessment(spark, snapshot_path, out, as_of=F.lit(AS_OF).cast("timestamp"))


def _write_as(estate, folder, fmt, names):
    for name in names:
        estate[name].coalesce(1).write.option("header", "true").option("escape", '"').option(
            "ignoreNullFields", "false").format(fmt).save(f"{folder}/{name}")


BAD = {"csv": "first\nno number" + "," * 200 + "\n", "json": '{"server_id": "no number"}\n{"job_id": "lost"}\n'}


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_rows_that_do_not_fit_are_counted_and_kept(spark, estate, tmp_path, fmt):
    from estatescope.sources.snapshot import land
    _write_as(estate, tmp_path / "snap", fmt, ["jobs", "jobsteps"])
    (tmp_path / "snap" / "jobs" / f"zz.{fmt}").write_text(BAD[fmt])
    n = BAD[fmt].count("\n") - (fmt == "csv")
    tables, rejected = land(spark, str(tmp_path / "snap"), fmt, str(tmp_path / "out"))
    assert rejected == {"jobs": n}
    kept = spark.read.parquet(f"{tmp_path}/out/rejected/jobs").collect()
    assert len(kept) == n and any("no number" in r[0] for r in kept)
    for name in ("jobs", "jobsteps"):
        assert sorted(map(repr, tables[name].collect())) == sorted(map(repr, estate[name].select(
            *tables[name].columns).collect())), name
    (tmp_path / "snap" / "jobs" / f"zz.{fmt}").unlink()
    tables, rejected = land(spark, str(tmp_path / "snap"), fmt, str(tmp_path / "out"))
    assert not rejected and tables["jobs"].count() == estate["jobs"].count()
    assert not (tmp_path / "out" / "rejected" / "jobs").exists()


def test_assessment_of_csv_with_bad_rows(spark, estate, plain_run, tmp_path):
    """The reports are those of the Parquet snapshot; the bad row is in the log and kept."""
    names = ["servers", "server_properties", "sysservers", "jobs", "jobsteps", "jobschedules", "schedules",
             "operators", "logins"]  # what these reports read
    _write_as(estate, tmp_path / "snap", "csv", names)
    (tmp_path / "snap" / "jobs" / "zz.csv").write_text(BAD["csv"])
    out = str(tmp_path / "out")
    reports, errors = run_assessment(spark, f"{tmp_path}/snap", out, "csv", F.lit(AS_OF).cast("timestamp"))
    log = {r.command: r.message for r in errors.collect()}
    assert log["snapshot jobs"] == f"1 rows do not fit the schema: {out}/rejected/jobs"
    assert {c.split()[0] for c in log} == {"snapshot"}
    for name in ("jobs", "linked_servers"):
        assert sorted(map(repr, reports[name].collect())) == sorted(map(repr, plain_run[1][name].collect())), name


def _crash(monkeypatch, name, after):
    """The nth call of a storage step fails, as if the driver had died there."""
    step, calls = getattr(sinks, name), []

    def failing(*args):
        calls.append(args)
        if len(calls) > after:
            raise RuntimeError("died")
        return step(*args)

    monkeypatch.setattr(sinks, name, failing)


@pytest.mark.parametrize("step, after", [("noted", 0), ("moved", 1), ("moved", 2), ("removed", 3)])
def test_refresh_that_dies_is_ended_or_undone(spark, tmp_path, monkeypatch, step, after):
    path = str(tmp_path / "t")
    frame = lambda v, *servers: spark.createDataFrame([(s, v) for s in servers], "server_id int, v string")
    read = lambda: {(r.server_id, r.v) for r in spark.read.parquet(path).collect()}
    sinks.refresh(frame("old", 1, 2, 3, 4), path)
    with monkeypatch.context() as patch:
        _crash(patch, step, after)
        try:
            sinks.refresh(frame("new", 2, 3), path, server_ids=[2, 3, 4])
        except RuntimeError:
            pass
    sinks.recover(spark, path)
    new = {(1, "old"), (2, "new"), (3, "new")}
    assert read() in ({(s, "old") for s in (1, 2, 3, 4)}, new)
    sinks.refresh(frame("new", 2, 3), path, server_ids=[2, 3, 4])  # the rerun
    assert read() == new


def test_refresh_of_the_last_servers_keeps_the_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda *servers: spark.createDataFrame([(s, "v") for s in servers], "server_id int, v string")
    sinks.refresh(frame(1), path)
    sinks.refresh(frame(), path, server_ids=[1])
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["v", "server_id"]
    sinks.refresh(frame(7), path)
    assert [r.server_id for r in spark.read.parquet(path).collect()] == [7]


def test_missing_texts_are_added_once(spark, tmp_path):
    rows = lambda *k: spark.createDataFrame([(x, f"text {x}") for x in k], "k int, t string")
    for part in ((1, 2), (2, 3), (3,)):
        sinks.add_missing(rows(*part), str(tmp_path / "t"), ["k"])
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]


def test_missing_views_are_empty(spark, tmp_path):
    assert read_all(spark, str(tmp_path))["indexes"].count() == 0


def test_failing_job_is_logged_and_the_rest_go_on(spark, tmp_path):
    df = spark.range(3)
    tables, errors = sinks.collect_all(spark, {
        "first": lambda t: df, "bad": lambda t: t["absent"],
        "last": lambda t: t["first"].filter("id > 0")}, str(tmp_path))
    assert {n: t.count() for n, t in tables.items()} == {"first": 3, "last": 2}
    assert [r.command for r in errors.collect()] == ["bad"]
    assert spark.read.parquet(f"{tmp_path}/exec_errors").count() == 1


def test_stored_assessment(spark, plain_run):
    out, reports, errors = plain_run
    assert {r.command.split()[0] for r in errors.collect()} <= {"snapshot"}  # views that the estate lacks
    assert reports["databases"].count() == 6
    first = [r.DatabaseName for r in reports["databases"].collect()]
    assert first == sorted(first)
    assert spark.read.parquet(f"{out}/rules/cross_server_routines").count() == 2
    assert spark.read.parquet(f"{out}/reports/databases").count() == 6


def test_reports_survive_a_failed_table(spark, snapshot_path, tmp_path, monkeypatch):
    """Jobs are read from a broken function; what does not need them is still reported."""
    from estatescope.sources import collectors
    monkeypatch.setattr(collectors, "load_jobs", lambda *a, **k: 1 / 0)
    reports, errors = run_assessment(spark, snapshot_path, str(tmp_path / "out"))
    log = {r.command: r.message for r in errors.collect() if not r.command.startswith("snapshot")}
    assert log["jobs"].startswith("ZeroDivisionError")
    assert "needs jobs, which failed" in log["job_steps"] and "needs job_steps" in log["report jobs"]
    assert "jobs" not in reports and reports["databases"].count() == 6


def test_assessment_refreshes_one_server(spark, snapshot_path, plain_run):
    out, as_of = plain_run[0], F.lit(AS_OF).cast("timestamp")
    before = spark.read.parquet(f"{out}/gold/databases_view").groupBy("server_id").count().collect()
    server = before[0].server_id
    reports, _ = run_assessment(spark, snapshot_path, out, as_of=as_of, server_ids=[server])
    after = spark.read.parquet(f"{out}/gold/databases_view").groupBy("server_id").count().collect()
    assert sorted(map(tuple, before)) == sorted(map(tuple, after))
    assert reports["databases"].count() == 6
    for view in ("database_files_view", "availability_groups_view", "cluster_nodes_view", "jobs_view", "volumes_view"):
        assert spark.read.parquet(f"{out}/gold/{view}").columns


def test_resumed_run_loads_only_changed_databases(spark, snapshot_path, tmp_path, monkeypatch):
    """A first resumed run loads all; after a change of one database the tables are those of a full load."""
    from estatescope.plans import resume
    from estatescope.plans.assessment import inventory_jobs
    from estatescope.sources.snapshot import read_all as read_snapshots
    out = str(tmp_path / "out")

    def load(b):
        """The inventory part of a resumed run; the databases that it loaded."""
        jobs = inventory_jobs(b, F.lit(AS_OF).cast("timestamp"))
        s, errors = sinks.collect_all(spark, {n: jobs[n] for n in ("servers", "databases")}, f"{out}/inventory")
        now = resume.fingerprints(b, s, "reference").cache()
        found = resume.changes(spark, now, f"{out}/loaded")
        few = inventory_jobs(resume.only(b, found.changed), F.lit(AS_OF).cast("timestamp"), done=found.same)
        s, more = sinks.collect_all(spark, {n: few[n] for n in resume.PER_DATABASE}, f"{out}/inventory",
                                    resume.merge(found), s)
        assert errors.isEmpty() and more.isEmpty()
        loaded = {tuple(r) for r in found.changed.collect()}
        if found.servers:
            sinks.refresh(found.now, f"{out}/loaded")
        return s, loaded

    def full(b):
        from estatescope.plans.assessment import evaluate
        return evaluate(inventory_jobs(b, F.lit(AS_OF).cast("timestamp")))

    def same(s, b):
        want = full(b)
        for name in resume.PER_DATABASE:
            columns = want[name].columns
            assert sorted(map(repr, s[name].select(*columns).collect())) == \
                sorted(map(repr, want[name].collect())), name

    b = read_snapshots(spark, snapshot_path)
    s, loaded = load(b)
    every = {(r.server_id, r.database_id) for r in s["databases"].collect()}
    assert loaded == every
    _, loaded = load(b)
    assert loaded == set()
    key = next(iter(sorted({(r.server_id, r.database_id) for r in s["columns"].collect()})))
    here = (F.col("server_id") == key[0]) & (F.col("database_id") == key[1])
    changed = b | {"columns": b["columns"].withColumn("name", F.when(here, F.concat("name", F.lit("_x"))).otherwise(F.col("name")))}
    s, loaded = load(changed)
    assert loaded == {key}
    same(s, changed)
    gone = changed | {"databases": changed["databases"].filter(~here)}
    s, loaded = load(gone)
    assert loaded == set() and not s["objects"].filter(here).count() and s["objects"].count()


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    """What was shuffled to make a table is deleted when it is written, and not kept until the driver collects garbage."""
    import glob
    import os
    import time
    from estatescope.workspace import stored

    def shuffled():
        local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in local for f in glob.glob(f"{d}/**/shuffle_*", recursive=True) if os.path.getsize(f)}

    before = shuffled()
    rows = spark.range(100_000).groupBy(F.xxhash64("id").alias("k")).agg(F.max("id").alias("m"))
    out = stored(rows, str(tmp_path / "table"))
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert out.count() == 100_000
