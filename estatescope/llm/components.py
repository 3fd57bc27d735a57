"""Connected components of a table of links, by alternating joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F

from estatescope.workspace import removed, stored


def connected(links: DataFrame, folder: str) -> DataFrame:
    """(node, root): the least node that each linked node reaches.  ``links`` has columns a and b.

    Large-star and small-star steps: every node hangs its larger neighbours below its least
    neighbour, then its smaller ones.  Both keep components together and shrink paths at least by
    half, so a few rounds suffice; a node with many neighbours is a minimum over its rows, which
    combines before the shuffle, and a join that can be split.  Each round is a written table; the last
    one is that which changes nothing, so links that are stars already take one.
    """
    spark = links.sparkSession
    edges = stored(_ordered(links.select("a", "b")), f"{folder}/links-0")
    last, turn = _signature(edges), 0
    while True:
        turn += 1
        now = stored(_small_star(_large_star(edges)), f"{folder}/links-{turn}")
        signature = _signature(now)
        removed(spark, f"{folder}/links-{turn - 1}")
        if signature == last:
            break
        edges, last = now, signature
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _signature(links: DataFrame) -> Row:
    return links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, the larger end first."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    linked = both.where("b > a").join(least, "a")
    return linked.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b") \
        .union(least.select("a", F.col("m").alias("b"))).distinct()
