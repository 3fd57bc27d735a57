"""Operators against brute force, on small and on skewed inputs."""

import random

import pytest
from pyspark.sql import functions as F

from estatescope.operators.aggregates import distinct_names, ordered_names, sequence_gap, size_buckets
from estatescope.operators.joins import (
    disjunctive_join, first_per_group, left_first, left_lookup, not_loaded, rollup_left,
    update_from,
)
from estatescope.operators.matching import all_matches, first_match, reference_tokens
from estatescope.operators.windows import share_of_total


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def contains_pairs(texts, terms, suffixes):
    spelled = {}
    for t in terms:
        if t:
            spelled[t.lower()] = min(t, spelled.get(t.lower(), t))
    return sorted({(i, shown) for i, text in enumerate(texts) if text is not None
                   for term, shown in spelled.items()
                   if any(term + s in text.lower() for s in suffixes)}, key=repr)


def test_long_terms_anywhere_equal_brute_force(spark):
    """Terms with and without blanks, around the length of the parts, in texts of several pieces."""
    rng = random.Random(11)
    words = ["Alpha", "beta", "γάμμα", "de", "x", "twelve-chars", ""]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in [5, 30, 200, 3000] * 6] + [None, "", " "]
    terms = [t[s:s + rng.randint(1, 40)] for t in texts[:24] for s in (0, len(t) // 3, len(t) // 2)]
    terms += [" alpha", "Alpha ", " ", "twelve-chars", "x" * 9, "de twelve", "a twelve-char"]
    left = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = all_matches(left, spark.createDataFrame([(t,) for t in terms], "term string"), ["id"], "text", "term", [""])
    assert rows(got, "id", "term") == contains_pairs(texts, terms, [""])


@pytest.mark.parametrize("suffixes", [(".", "]."), ("",), (".",), ("->", ":"), ("", ".")])
def test_matches_equal_brute_force(spark, suffixes):
    rng = random.Random(3)
    alphabet = ["a", "b", ".", "]", "[", "-", ">", ":", "é", "😀", "\n", "B"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
             for _ in range(60)] + [None]
    terms = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5)))
             for _ in range(40)] + ["", None, "host.b", "Ab", "aB"]
    left = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    right = spark.createDataFrame([(t,) for t in terms], "term string")
    want = contains_pairs(texts, terms, suffixes)
    got = all_matches(left, right, ["id"], "text", "term", suffixes)
    assert rows(got, "id", "term") == want
    first = {}
    for i, term in want:
        first[i] = min(term, first.get(i, term))
    assert rows(first_match(left, right, ["id"], "text", "term", suffixes), "id", "term") == \
        sorted(first.items(), key=repr)


def test_matches_stay_within_their_scope(spark):
    texts = spark.createDataFrame([(1, 1, "db1.x"), (2, 2, "db1.x db2.x")],
                                  "server int, id int, text string")
    terms = spark.createDataFrame([(1, "DB1"), (2, "db2")], "server int, term string")
    got = all_matches(texts, terms, ["id"], "text", "term", scope=["server"])
    assert rows(got, "id", "term") == [(1, "DB1"), (2, "db2")]


def test_no_terms_no_matches(spark):
    texts = spark.createDataFrame([(1, "a.b")], "id int, text string")
    none = spark.createDataFrame([], "term string")
    assert all_matches(texts, none, ["id"], "text", "term").count() == 0


def test_a_suffix_must_not_overlap_itself(spark):
    texts = spark.createDataFrame([(1, "a...")], "id int, text string")
    with pytest.raises(ValueError):
        all_matches(texts, texts.withColumn("term", F.col("text")), ["id"], "text", "term", ["aa"])


def test_identifiers_are_a_subset_of_substrings(spark):
    texts = spark.createDataFrame([(1, "select MyDb.x"), (2, "[Db].y and Db.z")],
                                  "id int, text string")
    terms = spark.createDataFrame([("Db",), ("MyDb",)], "term string")
    exact = rows(reference_tokens(texts, terms, ["id"], "text", "term"), "id", "term")
    loose = rows(all_matches(texts, terms, ["id"], "text", "term"), "id", "term")
    assert exact == [(1, "MyDb"), (2, "Db")]
    assert loose == [(1, "Db"), (1, "MyDb"), (2, "Db")]


def test_hot_term_and_hot_group(spark):
    """A third of the texts name one term; one server holds most of them."""
    texts = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, "x hot.t").otherwise(
            F.concat(F.lit("y t"), F.col("id"), F.lit(".z"))).alias("text"))
    terms = spark.range(4000).select(F.concat(F.lit("t"), F.col("id")).alias("term")).union(
        spark.createDataFrame([("hot",)], "term string"))
    # Force the shuffled join that large term tables get.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = first_match(texts, terms, ["id"], "text", "term")
        by_term = {r.term: r.n for r in got.groupBy("term").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert by_term == {"hot": 2000, **{f"t{i}": 1 for i in range(4000) if i % 3}}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_disjunctive_join(spark, how):
    rng = random.Random(5)
    left = [(i, rng.choice([None, 1, 2, 3, 9]), rng.choice([None, 1, 2, 8])) for i in range(30)]
    left += left[:3]
    right = [(rng.choice("abc"), rng.randint(1, 4), j) for j in range(20)]
    want = []
    for lrow in left:
        hits = [r[2] for r in right if (r[0] in "ab" and lrow[1] == r[1])
                or (r[0] == "c" and lrow[2] == r[1])]
        want += [(lrow[0], j) for j in hits] or ([(lrow[0], None)] if how == "left" else [])
    got = disjunctive_join(
        spark.createDataFrame(left, "id int, p int, q int"),
        spark.createDataFrame(right, "kind string, key int, j int"),
        F.col("kind"), F.col("key"), {"a": "p", "b": "p", "c": "q"}, how=how)
    assert rows(got, "id", "j") == sorted(want, key=repr)


def test_rollup_left_keeps_every_left_row(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 5), (1, 6)], "k int, v int")
    got = rollup_left(left, right, ["k"], total=F.sum("v"), n=F.count("*"))
    assert rows(got, "k", "total", "n") == [(1, 11, 2), (2, None, None)]


def test_left_lookup_scatters_rows_without_key(spark):
    left = spark.createDataFrame([(i, 7 if i < 3 else None if i < 6 else 0) for i in range(10)],
                                 "id int, k int")
    right = spark.createDataFrame([(7, "seven"), (0, "never")], "k int, v string")
    got = left_lookup(left, right, ["k"], F.coalesce("k", F.lit(0)) != 0, ["id"])
    assert rows(got, "id", "v") == sorted(
        [(i, "seven" if i < 3 else None) for i in range(10)], key=repr)


def test_firsts(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (2, 9)], "k int, v int")
    assert rows(first_per_group(df, ["k"], [F.asc("v")]), "k", "v") == [(1, 2), (2, 9)]
    left = spark.createDataFrame([(1,), (3,)], "k int")
    assert rows(left_first(left, df, ["k"], [F.desc("v")]), "k", "v") == [(1, 3), (3, None)]


def test_update_from_takes_nulls_of_matched_rows(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    source = spark.createDataFrame([(1, "z"), (2, None)], "k int, v string")
    assert rows(update_from(target, source, ["k"], ["v"]), "k", "v") == [
        (1, "z"), (2, None), (3, "c")]


def test_not_loaded_ignores_null_keys(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    done = spark.createDataFrame([(2,), (None,)], "k int")
    assert rows(not_loaded(df, done, ["k"]), "k") == [(1,)]


def test_size_classes_add_up(spark):
    df = spark.createDataFrame([(v,) for v in (None, 0, 1, 6, 7, 12, 13, 18, 19)], "n int")
    got = df.agg(*[c.alias(k) for k, c in size_buckets(F.col("n"), limits=(6, 12, 18)).items()])
    assert tuple(got.first()) == (2, 2, 2, 2, 1)


def test_lists(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "z"), (1, 2, "a"), (2, 1, "q")],
                               "k int, at int, n string")
    got = df.groupBy("k").agg(
        ordered_names(F.col("at"), F.col("n"), F.col("k") == 1).alias("names"))
    assert rows(got, "k", "names") == [(1, ["z", "a", "b"]), (2, None)]
    listed = distinct_names(df.union(df), ["k"], "n", "count", "names")
    assert rows(listed, "k", "count", "names") == [(1, 6, "a,b,z"), (2, 2, "q")]


def test_sequence_gap(spark):
    sequences = spark.createDataFrame([("a", 10), ("b", 30), ("c", 1)], "s string, cur long")
    used = [(s, v) for s in "ab" for v in [*range(1, 13), 20]]
    values = spark.createDataFrame(used, "s string, v long")
    got = sequence_gap(sequences, values, ["s"], "cur", "v")
    assert rows(got, "s", "max_existing", "next_in_use", "gap", "is_max") == [
        ("a", 20, 11, 1, 1), ("b", 20, None, None, 0), ("c", None, None, None, 0)]


def test_shares_add_up_per_group(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") + 1).alias("v"))
    got = share_of_total(df, ["g"], share=(F.col("v"), F.col("v")))
    for total, in got.groupBy("g").agg(F.sum("share")).select("sum(share)").collect():
        assert total == pytest.approx(100)


def test_a_stretch_is_at_most_eight_rows_however_many_lengths_the_terms_have(spark):
    from estatescope.operators import matching
    texts = spark.createDataFrame([(1, f"select {'x' * 300}tail. and [{'y' * 40}]. end")], "k int, _text string")
    rows = matching._with_keys(texts, ["k"], ".", ["", "]"])
    assert rows.count() == 8 * 3  # two stretches before a dot, one of them also before "]."
    assert rows.agg(F.max(F.length("_stem"))).first()[0] == matching.REACH
    assert rows.filter("_stem IS NOT NULL").count() == 3
    terms = spark.createDataFrame([("x" * n,) for n in range(1, 120)], "t string")
    got = matching.all_matches(texts.withColumnRenamed("_text", "d"), terms, ["k"], "d", "t")
    assert got.count() == 0
    terms = spark.createDataFrame([("x" * n + "tail",) for n in range(0, 300, 7)] + [("x" * 301 + "tail",), ("il",)], "t string")
    assert matching.all_matches(texts.withColumnRenamed("_text", "d"), terms, ["k"], "d", "t").count() == 44


def test_names_with_marks_long_names_and_names_of_other_servers(spark):
    from estatescope.operators.matching import all_matches, first_match
    long = "n" * 150
    texts = spark.createDataFrame(
        [(1, "a", f"exec [host.domain].db.dbo.p; use {long}.t"), (2, "a", "x..y"), (1, "b", "HOST.DOMAIN. sales."),
         (2, "b", f"{long}n.t domain."), (1, "c", None)], "s int, k string, d string")
    terms = spark.createDataFrame(
        [(1, "host.domain"), (1, "Domain"), (1, long), (1, "db"), (2, "x."), (2, long), (2, "sales"), (1, ""), (2, None)],
        "s int, t string")
    got = {tuple(r) for r in all_matches(texts, terms, ["s", "k"], "d", "t", scope=["s"]).collect()}
    assert got == {(1, "a", "host.domain"), (1, "a", "Domain"), (1, "a", "db"), (1, "a", long), (2, "a", "x."),
                   (1, "b", "host.domain"), (1, "b", "Domain"), (2, "b", long)}
    first = {tuple(r) for r in first_match(texts, terms, ["s", "k"], "d", "t", scope=["s"]).collect()}
    assert first == {(1, "a", "Domain"), (2, "a", "x."), (1, "b", "Domain"), (2, "b", long)}


def test_matches_before_suffixes_equal_brute_force(spark):
    from estatescope.operators.matching import all_matches
    rng = random.Random(8)
    word = lambda a, n: "".join(rng.choices(a, k=n))
    texts = [(i, word("ab.]B ", rng.randint(0, 60))) for i in range(300)]
    terms = sorted({word("ab.]", rng.randint(1, 14)) for _ in range(150)})
    got = {tuple(r) for r in all_matches(
        spark.createDataFrame(texts, "k int, d string"), spark.createDataFrame([(t,) for t in terms], "t string"),
        ["k"], "d", "t").collect()}
    assert got == {(k, t) for k, d in texts for t in terms if f"{t}." in d.lower() or f"{t}]." in d.lower()}


def test_order_then_attach_keeps_the_order_and_sorts_no_text(spark):
    from estatescope.operators.ordering import order_then_attach
    from estatescope.sources.texts import text_key, text_store, with_texts
    rows = spark.range(5000).select(
        (F.xxhash64("id") % 700).alias("a"), F.col("id").alias("b"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("text "), (F.col("id") % 50).cast("string"))).alias("t"))
    store = text_store((rows, "t"))
    assert store.count() == 50 - 0 and store.filter("text_key IS NULL").isEmpty()
    slim = rows.select("a", "b", text_key(F.col("t")).alias("text_key"))
    out = order_then_attach(slim.repartition(5), ["a", F.desc("b")], lambda df: with_texts(df, store))
    got = [tuple(r) for r in out.collect()]
    want = sorted(((r.a, r.b, r.t) for r in rows.collect()), key=lambda x: (x[0], -x[1]))
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    ranged = [x for x in plan.splitlines() if "rangepartitioning" in x]
    assert ranged and not any("routine_definition" in x for x in ranged)
