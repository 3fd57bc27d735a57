"""Shapes of the physical plans."""

import pytest
from pyspark.sql import functions as F

from estatescope.star import all_queries

SF = "/root/testdata/sf0.001"

# The plans of the largest inputs: no product of two tables, and no broadcast that was not
# decided from a size (an explicit hint would show up as one on shuffled input).
CHECKED = ["first_match", "all_matches_before_suffix", "reference_tokens", "disjunctive_join",
           "disjunctive_left_join", "rollup_left", "left_first", "share_of_total", "sequence_gap",
           "load_index_usage", "load_database_objects", "load_columns", "load_databases",
           "report_databases", "report_routines", "view_database_objects"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_products(spark, name):
    text = plan(all_queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "NestedLoop" not in text


@pytest.mark.parametrize("name", ["top_10_per_group", "left_first", "load_top_sql",
                                  "load_top_wait", "first_schedule_per_job"])
def test_groups_are_limited_before_the_shuffle(spark, name):
    assert plan(all_queries()[name](spark, SF)).count("WindowGroupLimit") >= 2


def test_shares_use_no_unordered_window(spark):
    assert "Window " not in plan(all_queries()["share_of_total"](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(all_queries()["replace_table"](spark, SF))
    assert "PushedFilters" in text
    text = plan(all_queries()["rollup_left"](spark, SF))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus" not in text


def test_unused_rollups_disappear(spark):
    """A report that needs no index rollup does not read the indexes."""
    from estatescope.plans.views import columns_view
    from estatescope.star.inventory import StarInventory
    view = columns_view(StarInventory(spark, SF)).select("database_name", "column_name")
    assert "o_orderstatus" not in plan(view.filter(F.col("data_type") == "xml"))


def test_no_python_in_any_plan(spark):
    for name in CHECKED:
        text = plan(all_queries()[name](spark, SF))
        assert "Python" not in text and "Pandas" not in text, name


def shuffles(df):
    return [x for x in plan(df).splitlines() if "Exchange " in x and "BroadcastExchange" not in x]


def test_the_database_report_moves_each_input_once(spark):
    assert len(shuffles(all_queries()["report_databases"](spark, SF))) <= 20


def test_texts_do_not_move_before_they_are_attached(spark):
    """Objects, findings and references are made of keys; only the store of texts itself is shuffled by key."""
    from estatescope.plans.assessment import evaluate, gold_jobs
    from estatescope.star.inventory import StarInventory
    from estatescope.workspace import stored, work_folder
    s = StarInventory(spark, SF)
    s.texts = stored(s.texts, f"{work_folder(spark, 'texts')}/store")
    g = evaluate(gold_jobs(s))
    for name in ("objects_view", "routine_findings", "columns_view"):
        text = plan(g[name])
        assert "Exchange" in text
        moved = [x for x in text.splitlines() if "Exchange " in x and "routine_definition" in x]
        assert not moved, name
    # Below an exchange of the search stand pieces of texts; a whole one only where a name has to be looked up in it.
    for line in shuffles(g["reference_hits"]):
        assert "routine_definition" not in line


@pytest.mark.parametrize("name", ["load_columns", "load_columns_intended", "load_index_usage", "load_index_usage_intended"])
def test_columns_and_indexes_are_not_moved_by_name(spark, name):
    """Names are looked up where there is one row per table: no exchange by name stands above the columns."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        lines = plan(all_queries()[name](spark, SF)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

    def depth(line):
        return next(i for i, x in enumerate(line) if x.isalpha() or x == "*")

    by_name = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x and "object_key" in x]
    assert by_name
    for i in by_name:
        below = []
        for line in lines[i + 1:]:
            if depth(line) <= depth(lines[i]):
                break
            below.append(line)
        assert not [x for x in below if "l_partkey" in x]


def below_exchanges(df):
    """Each shuffle of a plan with the lines of what it shuffles."""
    lines = plan(df).splitlines()

    def depth(line):
        return next(i for i, x in enumerate(line) if x.isalpha() or x == "*")

    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            yield line, lines[i + 1:end]


def test_the_database_report_adds_columns_up_before_it_moves_them(spark):
    """Order lines stand for columns: they are shuffled by their order, then only sums of them are."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        moved = list(below_exchanges(all_queries()["report_databases"](spark, SF)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    of_columns = [(line, below) for line, below in moved if any("lineitem.parquet" in x for x in below)]
    assert of_columns
    for line, below in of_columns:
        assert "l_orderkey" in line or "o_orderkey" in line or "HashAggregate" in below[0], line


def test_sequences_reduce_the_orders_before_the_join(spark):
    from estatescope.star.inventory import StarInventory
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = list(below_exchanges(StarInventory(spark, SF).sequences))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    of_orders = [below for _, below in moved if any("orders.parquet" in x for x in below)]
    assert of_orders and all("HashAggregate" in below[0] for below in of_orders)


@pytest.mark.parametrize("mode", ["reference", "intended"])
def test_counts_of_columns_are_the_sums_of_their_findings(spark, mode):
    """With unknown objects, columns without a key, and two objects of one name."""
    from estatescope.plans.rules import column_counts, column_findings
    from estatescope.plans.views import columns_view
    named = "server_id int, database_id int, schema_key string, object_key string"
    flags = ["incompatible_column", "computed_column", "large_text_column", "invalid_default"]
    columns = spark.createDataFrame(
        [(1, 1, "s", "a", "XML", None, None), (1, 1, "s", "a", "varchar(max)", True, "(getdate())"),
         (1, 1, "s", "twice", "nvarchar (max)", False, "((0))"), (1, 2, "s", "a", "text", None, "(f())"),
         (1, 2, "s", "unknown", "xml", True, "(f())"), (1, 2, None, "a", "xml", True, "(f())")],
        f"{named}, data_type string, is_computed boolean, column_default string").selectExpr(
        "*", "'' table_schema", "'' table_catalog", "'' table_name", "'c' column_name", "1L ordinal_position",
        "true is_nullable", "'' collation_name", "8 character_maximum_length")
    objects = spark.createDataFrame(
        [(1, 1, "s", "a"), (1, 1, "s", "twice"), (1, 1, "s", "twice"), (1, 2, "s", "a"), (1, 2, None, "a"),
         (1, 2, "s", "empty")], named).selectExpr(
        "*", "'d' database_name", "'S' server_name", "'U' xtype", "1L row_count", "'1' row_count_s",
        "'k' pk_name", "array('c') pk_cols")
    findings = column_findings(columns_view({"columns": columns}, objects), mode)

    def sums(df):
        return sorted(map(tuple, df.groupBy("server_id", "database_id").agg(
            *[F.sum(f).alias(f) for f in flags]).collect()))

    want = sums(findings)
    assert len(want) == 2
    assert sums(column_counts(columns, objects, mode)) == want


def test_the_inventory_reads_the_order_lines_of_procedures_once(spark):
    from estatescope.star.inventory import StarInventory
    assert plan(StarInventory(spark, SF).top_sql).count("lineitem.parquet") == 1


def test_the_bundle_reads_every_text_from_the_store(spark, monkeypatch):
    """Texts are sorted out once and stored, not again by each table that searches them."""
    from estatescope.star import plan_queries
    seen = {}

    def kept(jobs, kept=None):
        seen["texts"] = jobs["index_view"].__closure__[0].cell_contents["texts"]
        raise InterruptedError

    monkeypatch.setattr(plan_queries, "evaluate", kept)
    with pytest.raises(InterruptedError):
        all_queries()["report_bundle"](spark, SF)
    assert "documents.parquet" not in plan(seen["texts"]) and seen["texts"].count() == 200
