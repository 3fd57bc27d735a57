"""Every generic operator on the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from estatescope.functions.scalars import name_key, whole_div
from estatescope.operators.aggregates import (
    count_if, distinct_names, ordered_names, row_count, sequence_gap, size_buckets, sum_if,
)
from estatescope.operators.filters import (
    any_like, eligible_databases, rows_not_in, union_versions, with_extras,
)
from estatescope.operators.joins import (
    disjunctive_join, first_per_group, left_first, left_where, not_loaded, rollup_left, update_from,
)
from estatescope.operators.matching import all_matches, first_match, reference_tokens
from estatescope.operators.windows import share_of_total, top_n_per_group
from estatescope.star.bronze import Star
from estatescope.star.registry import query, read

# ----------------------------------------------------- projection, filter, predicate


@query("project_constants", """
    SELECT 1 AS server_id, o_custkey AS database_id, o_orderkey AS object_id FROM orders""")
def project_constants(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(
        F.lit(1).alias("server_id"), F.col("o_custkey").alias("database_id"),
        F.col("o_orderkey").alias("object_id"))


@query("all_columns_plus", """
    SELECT s_suppkey, s_name, s_nationkey, s_acctbal, n_name, n_regionkey
    FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def all_columns_plus(spark: SparkSession, d: str) -> DataFrame:
    nations = read(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return with_extras(read(spark, d, "supplier"), nations, ["s_nationkey"])


@query("union_versions", """
    SELECT event_id, event_type, user_id, value FROM events WHERE event_type <> 'error'
    UNION ALL SELECT event_id, event_type, NULL, value FROM events WHERE event_type = 'error'""")
def versions_query(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    return union_versions(events.filter("event_type <> 'error'"),
                          events.filter("event_type = 'error'").drop("user_id"))


@query("in_and_not_in", """
    SELECT p_partkey, p_type FROM part
    WHERE upper(p_type) IN ('ECONOMY', 'SMALL', 'LARGE') AND p_brand NOT IN ('Brand#1', 'Brand#2')""")
def in_and_not_in(spark: SparkSession, d: str) -> DataFrame:
    return (read(spark, d, "part")
            .filter(F.upper("p_type").isin("ECONOMY", "SMALL", "LARGE")
                    & rows_not_in(F.col("p_brand"), ["Brand#1", "Brand#2"]))
            .select("p_partkey", "p_type"))


@query("like_any", """
    SELECT doc_id FROM documents
    WHERE text ILIKE '%tion%' OR text ILIKE '%worth%' OR text ILIKE '%license%'""")
def like_any(spark: SparkSession, d: str) -> DataFrame:
    return (read(spark, d, "documents")
            .filter(any_like(F.col("text"), ["%tion%", "%worth%", "%license%"])).select("doc_id"))


@query("like_multi_wildcard", "SELECT doc_id FROM documents WHERE text ILIKE '%en%la%'")
def like_multi_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return (read(spark, d, "documents").filter(any_like(F.col("text"), ["%en%la%"]))
            .select("doc_id"))


@query("not_like", """
    SELECT c_custkey, c_name FROM customer
    WHERE NOT c_name ILIKE 'customer#0000000%' AND NOT c_name LIKE '%9'""")
def not_like(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("c_name")
    return (read(spark, d, "customer")
            .filter(~any_like(name, ["customer#0000000%"]) & ~name.like("%9"))
            .select("c_custkey", "c_name"))


@query("between_bucket", """
    SELECT o_custkey, count(*) AS orders FROM orders GROUP BY ALL HAVING count(*) BETWEEN 6 AND 12""")
def between_bucket(spark: SparkSession, d: str) -> DataFrame:
    return (read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
            .filter(F.col("orders").between(6, 12)))


@query("null_tests", """
    SELECT c_custkey, o.n IS NULL AS no_orders, coalesce(o.low, '') <> '' AS has_priority
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS low
      FROM orders GROUP BY ALL) o ON o_custkey = c_custkey""")
def null_tests(spark: SparkSession, d: str) -> DataFrame:
    customers = read(spark, d, "customer").select("c_custkey")
    orders = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return (rollup_left(customers, orders, ["c_custkey"], n=F.count("*"),
                        low=F.min("o_orderpriority"))
            .select("c_custkey", F.col("n").isNull().alias("no_orders"),
                    (F.coalesce("low", F.lit("")) != "").alias("has_priority")))


@query("eligible_databases", """
    SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
    WHERE n_nationkey % 3 > 0 AND n_nationkey % 7 <> 1 AND n_name <> 'NATION_4'
      AND n_nationkey % 11 <> 2""")
def eligible_query(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey")
    regions = read(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    databases = read(spark, d, "nation").join(regions, "n_regionkey").select(
        "n_nationkey", F.col("n_name").alias("database_name"), F.col("r_name")
        .alias("server_name"), F.when(key % 3 > 0, "ONLINE").otherwise("OFFLINE")
        .alias("state_desc"), F.when(key % 7 == 1, "ELSEWHERE").alias("primary_replica"),
        F.when(key % 11 == 2, "DataWarehouse").alias("edition"))
    return eligible_databases(databases, exclude=["nation_4"]).select("n_nationkey")


# ------------------------------------------------------------------------------ joins


@query("inner_join", """
    SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey""")
def inner_join(spark: SparkSession, d: str) -> DataFrame:
    regions = read(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return (read(spark, d, "nation").join(regions, "n_regionkey")
            .select("n_nationkey", "n_name", "r_name"))


@query("left_join", """
    SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")
def left_join(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return (read(spark, d, "customer").join(orders, "c_custkey", "left")
            .select("c_custkey", "c_name", "o_orderkey"))


@query("composite_name_join", """
    SELECT c_custkey, suppliers FROM customer
    LEFT JOIN (SELECT s_nationkey, lower(s_name) AS name, count(*) AS suppliers
      FROM supplier GROUP BY ALL)
      ON s_nationkey = c_nationkey AND replace(name, 'supplier', 'customer') = lower(c_name)""")
def composite_name_join(spark: SparkSession, d: str) -> DataFrame:
    suppliers = read(spark, d, "supplier").select(
        F.col("s_nationkey").alias("c_nationkey"),
        F.replace(F.lower("s_name"), F.lit("supplier"), F.lit("customer")).alias("name_key"))
    customers = read(spark, d, "customer").withColumn("name_key", name_key(F.col("c_name")))
    return (rollup_left(customers, suppliers, ["c_nationkey", "name_key"], suppliers=F.count("*"))
            .select("c_custkey", "suppliers"))


@query("left_join_literal_condition", """
    SELECT n_nationkey, s_suppkey FROM nation
    LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0""")
def left_join_literal_condition(spark: SparkSession, d: str) -> DataFrame:
    suppliers = read(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return (left_where(read(spark, d, "nation"), suppliers, ["n_nationkey"],
                       F.col("s_acctbal") < 0)
            .select("n_nationkey", "s_suppkey"))


@query("self_join", """
    SELECT a.o_orderkey, b.o_orderdate::DATE::VARCHAR AS source_date
    FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey - 1000""")
def self_join(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    source = orders.select(F.col("o_orderkey").alias("source_key"),
                           F.date_format("o_orderdate", "yyyy-MM-dd").alias("source_date"))
    return (orders.withColumn("source_key", F.col("o_orderkey") - 1000)
            .join(source, "source_key", "left").select("o_orderkey", "source_date"))


@query("rollup_left", """
    SELECT c_custkey, total, orders, urgent FROM customer
    LEFT JOIN (SELECT o_custkey, sum(floor(o_totalprice)::BIGINT)::BIGINT AS total,
        count(*) AS orders,
        sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS urgent
      FROM orders GROUP BY ALL) ON o_custkey = c_custkey""")
def rollup_query(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return rollup_left(
        read(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"],
        total=F.sum(F.floor("o_totalprice").cast("long")), orders=row_count(),
        urgent=count_if(F.col("o_orderpriority") == "1-URGENT"))


@query("left_first", """
    SELECT c_custkey, o_orderkey AS first_order, o_totalprice FROM customer
    LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
      ORDER BY o_totalprice DESC, o_orderkey) = 1) ON o_custkey = c_custkey""")
def left_first_query(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"),
        "o_totalprice")
    return left_first(read(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"],
                      [F.desc("o_totalprice"), F.asc("first_order")])


@query("first_schedule_per_job", """
    SELECT user_id, min(event_id) AS event_id FROM events GROUP BY ALL""")
def first_schedule_per_job(spark: SparkSession, d: str) -> DataFrame:
    return first_per_group(read(spark, d, "events").select("user_id", "event_id"), ["user_id"],
                           [F.asc("event_id")])


def _units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return (read(spark, d, "orders").select("o_orderkey", "o_custkey"),
            read(spark, d, "lineitem").select("l_returnflag", "l_partkey", "l_orderkey"))


@query("disjunctive_join", """
    SELECT o_orderkey, count(*) AS pairs FROM (SELECT o_orderkey FROM orders JOIN lineitem
        ON l_returnflag IN ('A', 'R') AND l_partkey = o_custkey
      UNION ALL SELECT o_orderkey FROM orders JOIN lineitem
        ON l_returnflag = 'N' AND l_orderkey = o_orderkey) GROUP BY ALL""")
def disjunctive_query(spark: SparkSession, d: str) -> DataFrame:
    left, right = _units(spark, d)
    key = F.when(F.col("l_returnflag") == "N", F.col("l_orderkey")).otherwise(F.col("l_partkey"))
    pairs = disjunctive_join(left, right, F.col("l_returnflag"), key,
                             {"A": "o_custkey", "R": "o_custkey", "N": "o_orderkey"}, how="inner")
    return pairs.groupBy("o_orderkey").agg(F.count("*").alias("pairs"))


@query("disjunctive_left_join", """
    SELECT c_custkey, count(s_suppkey) AS partners, count(*) AS kept
    FROM customer LEFT JOIN supplier
      ON (s_acctbal < 5000 AND s_suppkey = c_custkey)
      OR (s_acctbal >= 5000 AND s_suppkey = c_nationkey)
    GROUP BY ALL""")
def disjunctive_left_query(spark: SparkSession, d: str) -> DataFrame:
    suppliers = read(spark, d, "supplier")
    kind = F.when(F.col("s_acctbal") < 5000, "own").otherwise("nation")
    joined = disjunctive_join(
        read(spark, d, "customer").select("c_custkey", "c_nationkey"), suppliers, kind,
        F.col("s_suppkey"), {"own": "c_custkey", "nation": "c_nationkey"})
    return joined.groupBy("c_custkey").agg(F.count("s_suppkey").alias("partners"),
                                           F.count("*").alias("kept"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).table("documents")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("text").alias("term"))


def _sentence_ends(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"(\w+)\."), F.lit(1))
    return read(spark, d, "benchmark").select(F.explode(words).alias("term")).distinct()


@query("first_match", """
    SELECT doc_id, min(term) AS term FROM documents
    JOIN (SELECT min(text) AS term FROM benchmark WHERE text <> '' GROUP BY lower(text)) ON contains(lower(text), lower(term)) GROUP BY ALL""")
def first_match_query(spark: SparkSession, d: str) -> DataFrame:
    return first_match(_documents(spark, d), _items(spark, d), ["doc_id"], "text", "term", [""])


@query("all_matches", """
    SELECT DISTINCT doc_id, term FROM documents
    JOIN (SELECT min(text) AS term FROM benchmark WHERE text <> '' GROUP BY lower(text)) ON contains(lower(text), lower(term))""")
def all_matches_query(spark: SparkSession, d: str) -> DataFrame:
    return all_matches(_documents(spark, d), _items(spark, d), ["doc_id"], "text", "term", [""])


_ENDS = """(SELECT min(term) AS term FROM (SELECT unnest(regexp_extract_all(text, '(\\w+)\\.', 1))
      AS term FROM benchmark) WHERE term <> '' GROUP BY lower(term))"""


@query("all_matches_before_suffix", f"""
    SELECT DISTINCT doc_id, term FROM documents JOIN {_ENDS}
      ON contains(lower(text), lower(term) || '.') OR contains(lower(text), lower(term) || '].')""")
def all_matches_before_suffix(spark: SparkSession, d: str) -> DataFrame:
    return all_matches(_documents(spark, d), _sentence_ends(spark, d), ["doc_id"], "text", "term")


@query("first_match_before_suffix", f"""
    SELECT doc_id, min(term) AS term FROM documents JOIN {_ENDS}
      ON contains(lower(text), lower(term) || '.') OR contains(lower(text), lower(term) || '].')
    GROUP BY ALL""")
def first_match_before_suffix(spark: SparkSession, d: str) -> DataFrame:
    return first_match(_documents(spark, d), _sentence_ends(spark, d), ["doc_id"], "text", "term")


@query("reference_tokens", f"""
    WITH d AS (SELECT doc_id, lower(text) || ' [srv-' || source || '].x' AS t FROM documents),
    terms AS (SELECT term FROM {_ENDS} UNION SELECT 'SRV-' || source FROM documents)
    SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(list_concat(
        regexp_extract_all(t, '([\\pL\\pN_@#$]+)\\.', 1),
        regexp_extract_all(t, '\\[([^\\[\\]]+)\\]\\.', 1))) AS token FROM d)
    JOIN terms ON token = lower(term)""")
def reference_tokens_query(spark: SparkSession, d: str) -> DataFrame:
    """Words at the ends of sentences, and a bracketed name with a hyphen in every text."""
    docs = _documents(spark, d)
    texts = docs.select("doc_id", F.concat("text", F.lit(" [srv-"), "source", F.lit("].x")).alias("text"))
    terms = _sentence_ends(spark, d).union(
        docs.select(F.concat(F.lit("SRV-"), "source").alias("term")).distinct())
    return reference_tokens(texts, terms, ["doc_id"], "text", "term")


@query("not_loaded", """
    SELECT c_custkey FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def not_loaded_query(spark: SparkSession, d: str) -> DataFrame:
    done = (read(spark, d, "orders").filter("o_orderstatus = 'F'")
            .withColumnRenamed("o_custkey", "c_custkey"))
    return not_loaded(read(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@query("parent_by_derived_name", """
    SELECT c_custkey, s_suppkey FROM customer
    JOIN supplier ON replace(lower(c_name), 'customer', '') = replace(lower(s_name), 'supplier', '')""")
def parent_by_derived_name(spark: SparkSession, d: str) -> DataFrame:
    def key(name: str, word: str):
        return F.replace(name_key(F.col(name)), F.lit(word), F.lit("")).alias("key")

    customers = read(spark, d, "customer").select("c_custkey", key("c_name", "customer"))
    suppliers = read(spark, d, "supplier").select("s_suppkey", key("s_name", "supplier"))
    return customers.join(suppliers, "key").select("c_custkey", "s_suppkey")


@query("joined_table_function", """
    SELECT DISTINCT p_brand, (floor(l_extendedprice)::BIGINT // 10000)::BIGINT AS price_class
    FROM lineitem JOIN part ON p_partkey = l_partkey""")
def joined_table_function(spark: SparkSession, d: str) -> DataFrame:
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return (read(spark, d, "lineitem").join(parts, "l_partkey")
            .select("p_brand", whole_div(F.floor("l_extendedprice"), 10000).alias("price_class"))
            .distinct())


@query("update_from", """
    SELECT c_custkey, CASE WHEN n IS NULL THEN c_name ELSE low END AS c_name,
           CASE WHEN n IS NULL THEN NULL ELSE n END AS orders
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n,
      min(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS low
      FROM orders GROUP BY ALL) ON o_custkey = c_custkey""")
def update_query(spark: SparkSession, d: str) -> DataFrame:
    fresh = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("orders"),
        F.min(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("c_name"))
    return update_from(read(spark, d, "customer").select("c_custkey", "c_name"), fresh,
                       ["c_custkey"], ["c_name", "orders"])


# ------------------------------------------------------------------------ aggregation


@query("group_by_sum_min_count", """
    SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS quantity,
           min(l_partkey) AS first_part, count(*) AS lines
    FROM lineitem GROUP BY ALL""")
def group_by_sum_min_count(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
        F.min("l_partkey").alias("first_part"), F.count("*").alias("lines"))


@query("row_counts_per_key", """
    SELECT n_nationkey, n AS suppliers, coalesce(n, 0) AS shown FROM nation
    LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL)
      ON s_nationkey = n_nationkey""")
def row_counts_per_key(spark: SparkSession, d: str) -> DataFrame:
    suppliers = read(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return (rollup_left(read(spark, d, "nation").select("n_nationkey"), suppliers,
                        ["n_nationkey"], suppliers=row_count())
            .withColumn("shown", F.coalesce("suppliers", F.lit(0))))


@query("conditional_counts", """
    SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS final,
           sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open
    FROM orders GROUP BY ALL""")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(
        count_if(status == "F").alias("final"), count_if(status == "O").alias("open"))


@query("conditional_sums", """
    SELECT s_nationkey, sum(CASE WHEN s_acctbal >= 0 THEN floor(s_acctbal)::BIGINT ELSE 0 END)::BIGINT
             AS data_mb,
           sum(CASE WHEN s_acctbal < 0 THEN floor(-s_acctbal)::BIGINT ELSE 0 END)::BIGINT AS log_mb
    FROM supplier GROUP BY ALL""")
def conditional_sums(spark: SparkSession, d: str) -> DataFrame:
    balance = F.col("s_acctbal")
    return read(spark, d, "supplier").groupBy("s_nationkey").agg(
        sum_if(balance >= 0, F.floor(balance).cast("long")).alias("data_mb"),
        sum_if(balance < 0, F.floor(-balance).cast("long")).alias("log_mb"))


@query("count_distinct", """
    SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL""")
def count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_suppkey").alias("suppliers"))


@query("size_buckets", """
    SELECT c_nationkey, sum(CASE WHEN coalesce(n, 0) = 0 THEN 1 ELSE 0 END)::BIGINT AS empty,
           sum(CASE WHEN n BETWEEN 1 AND 6 THEN 1 ELSE 0 END)::BIGINT AS small,
           sum(CASE WHEN n BETWEEN 7 AND 12 THEN 1 ELSE 0 END)::BIGINT AS medium,
           sum(CASE WHEN n BETWEEN 13 AND 18 THEN 1 ELSE 0 END)::BIGINT AS large,
           sum(CASE WHEN n > 18 THEN 1 ELSE 0 END)::BIGINT AS very_large
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL)
      ON o_custkey = c_custkey GROUP BY ALL""")
def size_buckets_query(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    counted = rollup_left(read(spark, d, "customer").select("c_custkey", "c_nationkey"), orders,
                          ["c_custkey"], n=F.count("*"))
    buckets = size_buckets(F.col("n"), limits=(6, 12, 18))
    return counted.groupBy("c_nationkey").agg(*[c.alias(n) for n, c in buckets.items()])


@query("ordered_names", """
    SELECT l_orderkey, string_agg('c' || l_partkey, ', ' ORDER BY l_linenumber, 'c' || l_partkey)
             FILTER (l_returnflag <> 'R') AS cols,
           string_agg('c' || l_partkey, ', ' ORDER BY l_linenumber, 'c' || l_partkey)
             FILTER (l_returnflag = 'R') AS included
    FROM lineitem GROUP BY ALL""")
def ordered_names_query(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("c"), F.col("l_partkey").cast("string"))
    at, extra = F.col("l_linenumber"), F.col("l_returnflag") == "R"
    lists = read(spark, d, "lineitem").groupBy("l_orderkey").agg(
        ordered_names(at, name, ~extra).alias("cols"),
        ordered_names(at, name, extra).alias("included"))
    return lists.select("l_orderkey", F.array_join("cols", ", ").alias("cols"),
                        F.array_join("included", ", ").alias("included"))


@query("distinct_names", """
    SELECT user_id, sum(n)::BIGINT AS events, string_agg(event_type, ',' ORDER BY event_type) AS types
    FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def distinct_names_query(spark: SparkSession, d: str) -> DataFrame:
    return distinct_names(read(spark, d, "events"), ["user_id"], "event_type", "events", "types")


@query("sequence_gap", """
    SELECT l_linenumber, 7000::BIGINT AS current, max(l_orderkey) AS max_existing,
           min(CASE WHEN l_orderkey > 7000 THEN l_orderkey END) AS next_in_use,
           CASE WHEN 7000 < max(l_orderkey) THEN 1 ELSE 0 END AS is_max,
           7000 < max(l_orderkey) AS is_behind,
           min(CASE WHEN l_orderkey > 7000 THEN l_orderkey END) - 7000 AS gap
    FROM lineitem GROUP BY ALL""")
def sequence_gap_query(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select("l_linenumber", "l_orderkey")
    sequences = (lines.select("l_linenumber").distinct()
                 .withColumn("current", F.lit(7000).cast("long")))
    return sequence_gap(sequences, lines, ["l_linenumber"], "current", "l_orderkey")


@query("distinct_rows", "SELECT DISTINCT event_type, user_id FROM events")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_type", "user_id").distinct()


@query("two_level_aggregate", """
    SELECT source, sum(n)::BIGINT AS documents, string_agg(lang, ',' ORDER BY lang) AS langs
    FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source""")
def two_level_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return distinct_names(read(spark, d, "documents"), ["source"], "lang", "documents", "langs")


@query("flag_rollup", """
    SELECT source, sum(CASE WHEN text ILIKE '%en%la%' THEN 1 ELSE 0 END)::BIGINT AS first_flag,
           sum(CASE WHEN text ILIKE '%the%ion%' THEN 1 ELSE 0 END)::BIGINT AS second_flag
    FROM documents GROUP BY ALL""")
def flag_rollup(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return read(spark, d, "documents").groupBy("source").agg(
        count_if(any_like(text, ["%en%la%"])).alias("first_flag"),
        count_if(any_like(text, ["%the%ion%"])).alias("second_flag"))


# ---------------------------------------------------------------- shares, top-n, order


@query("share_of_total", """
    SELECT event_id, 100.0::DOUBLE * floor(value) / (sum(floor(value)::BIGINT)
             OVER (PARTITION BY event_type))::DOUBLE AS share,
           100.0::DOUBLE * (floor(value) - floor(value)::BIGINT // 3) / (sum(floor(value)::BIGINT)
             OVER (PARTITION BY event_type))::DOUBLE AS mixed_share,
           100.0::DOUBLE * (floor(value)::BIGINT // 3) / (sum(floor(value)::BIGINT // 3)
             OVER (PARTITION BY event_type))::DOUBLE AS signal_share
    FROM events""")
def share_query(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("v")
    events = read(spark, d, "events").select(
        "event_id", "event_type", F.floor("value").cast("long").alias("v"))
    signal = whole_div(value, 3)
    return share_of_total(events, ["event_type"], share=(value, value),
                          mixed_share=(value - signal, value),
                          signal_share=(signal, signal)).drop("event_type", "v")


@query("top_10_per_group", """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_suppkey
      ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 10""")
def top_10_per_group(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return top_n_per_group(lines, ["l_suppkey"], 10, F.desc("l_extendedprice"), F.asc("l_orderkey"),
                           F.asc("l_linenumber"), F.asc("l_partkey"))


@query("top_40_by_share", """
    SELECT * FROM (SELECT event_type, event_id, 100.0::DOUBLE * floor(value)
        / (sum(floor(value)::BIGINT) OVER (PARTITION BY event_type))::DOUBLE AS share FROM events)
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY share DESC, event_id) <= 40""")
def top_40_by_share(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select(
        "event_type", "event_id", F.floor("value").cast("long").alias("v"))
    shares = share_of_total(events, ["event_type"], share=(F.col("v"), F.col("v"))).drop("v")
    return top_n_per_group(shares, ["event_type"], 40, F.desc("share"), F.asc("event_id"))


@query("top_1_per_group", """
    SELECT s_nationkey, s_name, s_acctbal FROM supplier
    QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1""")
def top_1_per_group(spark: SparkSession, d: str) -> DataFrame:
    return (first_per_group(read(spark, d, "supplier"), ["s_nationkey"],
                            [F.desc("s_acctbal"), F.asc("s_suppkey")])
            .select("s_nationkey", "s_name", "s_acctbal"))


@query("order_by_output", """
    SELECT c_nationkey, c_mktsegment, c_name FROM customer ORDER BY 1, 2, 3""")
def order_by_output(spark: SparkSession, d: str) -> DataFrame:
    return (read(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_name")
            .orderBy("c_nationkey", "c_mktsegment", "c_name"))
