"""Mixing sources to target weights (7): a multivariate-hypergeometric splitting tree.

Each source is a stream of words, its documents in a fixed arbitrary order, cut into blocks of ``BLOCK`` words.
Its target says how many words the mix takes: whole passes over all blocks, and in the last pass the
first blocks of a fixed permutation, the last of them cut, so that the words taken are the target,
rounded.  The drawn blocks of all sources are dealt to output shards by a tree: at each node the counts per source
are split between the two halves of the shards by a multivariate hypergeometric draw (the split a
random deal would give), down to exact quotas per shard and source.  Each shard then takes the next
blocks of each source's permutation, as many as its quota says, disjoint by construction, and is shuffled by itself.

Only one row per source (its size) reaches the driver, which computes targets and quotas; blocks and
documents stay distributed.  Where a document lies in its source's stream is a running sum in two
steps, over buckets and within them, so a source with a third of all rows is not one task.

Null, empty and blank texts have size 0 and nothing of them is taken; null is a source of its own, the last one.
Repeated rows are documents of their own; an empty table gives an empty table; only the
named columns are read, so others may have any name.  Equal input gives equal output in every run.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from estatescope.llm.registry import query, read
from estatescope.llm.sharding import _running
from estatescope.llm.texts import packed
from estatescope.workspace import stored, work_folder

#: Words of a block, output shards, and the most often that a source is taken.
BLOCK, SHARDS, MOST = 1024, 64, 3
#: Weights of the sources by code point of their names, repeating; null comes last.
WEIGHTS = (5, 2, 1)
SEED = 20240
#: The table of sources is sent to all tasks if it has at most so many rows (under 10 MB).
BROADCAST_SOURCES = 10_000


def tie_of(doc_id: Column, text: Column) -> Column:
    """An arbitrary fixed order of documents."""
    return F.xxhash64(doc_id.cast("string"), F.coalesce(text.cast("string"), F.lit("")))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, spot): words of each document and its bucket in the source's order."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        tie_of(F.col(doc_id), F.col(text)).alias("tie")).withColumn(
            "spot", F.shiftrightunsigned("tie", 64 - 12))


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS,
            most: int = MOST) -> dict[str | None, float]:
    """Words that the mix takes of each source: shares by weight of all words, at most ``most`` times a
    source's own, the excess shared by weight among the others until none is above."""
    names = sorted((s for s, _ in sizes), key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    size, free, capped = dict(sizes), dict.fromkeys(names), {}
    total = sum(size.values())
    while free:
        left, shared = total - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if Fraction(left * weight[s], shared) > most * size[s]]
        if not over:
            break
        for s in over:
            capped[s] = most * size[s]
            del free[s]
    left, shared = total - sum(capped.values()), sum(weight[s] for s in free)
    return {s: float(capped[s]) if s in capped else left * weight[s] / shared for s in names}


class Draw:
    """What is drawn of one source: whole passes and a part of a last one, in numbers of blocks."""

    def __init__(self, size: int, target: float, block: int, seed: int):
        words = round(target)
        self.blocks = -(-size // block) if size else 0
        self.passes, self.rest = divmod(words, size) if size else (0, 0)
        rng = np.random.default_rng(seed)
        # x -> (step * x + shift) modulo blocks is a permutation: step has no divisor with blocks.
        self.step, self.shift = 1, int(rng.integers(self.blocks)) if self.blocks else 0
        if self.blocks > 2:
            self.step = int(rng.integers(1, self.blocks))
            while math.gcd(self.step, self.blocks) != 1:
                self.step = self.step % self.blocks + 1
        self.inverse = pow(self.step, -1, self.blocks) if self.blocks > 1 else 0
        # The last pass takes the first ranks; the stream's short last block may be among them.
        self.drawn, self.cut = 0, 0
        if self.rest:
            short = size - (self.blocks - 1) * block
            short_rank = self.inverse * (self.blocks - 1 - self.shift) % self.blocks

            def words_in(ranks: int) -> int:
                return ranks * block - (block - short) * (short_rank < ranks)

            self.drawn = -(-self.rest // block)
            self.drawn += words_in(self.drawn) < self.rest
            self.cut = self.rest - words_in(self.drawn - 1)  # words of the last drawn block

    @property
    def total(self) -> int:
        """Blocks drawn in all passes."""
        return self.passes * self.blocks + self.drawn


def split_quotas(counts: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources: blocks of each source for each shard; shards differ by one block at most.

    At each node of the tree the left half draws its number of blocks from all that are there."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(counts)), np.int64)

    def split(counts: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = counts
            return
        middle, total = (first + last) // 2, int(counts.sum())
        draw = total * (middle - first) // (last - first)
        left = _hypergeometric(rng, counts, draw)
        split(left, first, middle)
        split(counts - left, middle, last)

    split(np.asarray(counts, np.int64), 0, shards)
    return out


def _hypergeometric(rng: np.random.Generator, counts: np.ndarray, draw: int) -> np.ndarray:
    """Multivariate: one colour after the other; beyond the sampler's range by its normal limit."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, have in enumerate(counts.tolist()):
        others = rest - have
        if rest < 1_000_000_000:
            n = int(rng.hypergeometric(have, others, draw)) if have and draw else 0
        else:
            mean = draw * have / rest
            n = round(rng.normal(mean, math.sqrt(max(mean * (others / rest) * (rest - draw) / (rest - 1), 0))))
        out[i] = min(max(n, draw - others, 0), have, draw)
        draw, rest = draw - int(out[i]), others
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK,
        shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, tie, source, at, size, source_size, target, row) and segments (row, pass, start, end, shard,
    place): words start..end of a document, taken in that pass into that shard, at a place by which the shard is
    ordered.  ``row`` stands for the document in both."""
    spark = docs.sparkSession
    folder = work_folder(spark, "mixing")
    rows = stored(sized(docs, doc_id, text, source), f"{folder}/sizes")
    totals = [(r.source, r.n) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    goal = targets(totals, weights, most)
    draws = {s: Draw(n, goal[s], block, seed + i) for i, (s, n) in enumerate(
        sorted(totals, key=lambda x: (x[0] is None, x[0] or "")))}
    quotas = split_quotas(np.array([d.total for d in draws.values()], np.int64), shards, seed)
    upto = np.cumsum(quotas, axis=0)

    table = spark.createDataFrame(
        [(s, dict(totals)[s], goal[s], d.blocks, d.passes, d.drawn, d.cut, d.inverse, d.shift,
          [int(x) for x in upto[:, i]]) for i, (s, d) in enumerate(draws.items())],
        "source string, source_size bigint, target double, blocks bigint, passes bigint, drawn bigint, "
        "cut bigint, inverse bigint, shift bigint, upto array<bigint>")
    placed = _running(F.col("size"), ["source_key"], "spot", ["tie"],
                      rows.withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))),
                      "at")
    table = table.withColumnRenamed("source", "_source")
    placed = placed.join(F.broadcast(table) if len(totals) <= BROADCAST_SOURCES else table,
                         F.col("source").eqNullSafe(F.col("_source")))
    placed = stored(placed.drop("_source", "source_key").withColumn(
        "row", F.concat_ws(":", "at", "tie", F.xxhash64("source"))), f"{folder}/placed")

    # The blocks that a document lies in, and the ranks of those blocks in the permutation.
    parts = placed.where("size > 0").select("*", F.explode(F.sequence(
        F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("block"))
    begin = F.col("block") * block
    parts = parts.withColumn("rank", F.expr(
        "cast(pmod(cast(inverse AS decimal(38, 0)) * (block - shift), blocks) AS bigint)")) \
        .withColumn("rank", F.when(F.col("blocks") <= 1, F.lit(0)).otherwise(F.col("rank")))
    parts = parts.withColumn("low", F.greatest("at", begin)) \
        .withColumn("high", F.least(F.col("at") + F.col("size"), begin + block))
    # A block is drawn if the quota of some shard reaches its number among the blocks of all passes.
    taken = parts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("pass")) \
        .withColumn("number", F.col("pass") * F.col("blocks") + F.col("rank")) \
        .withColumn("shard", F.size(F.filter("upto", lambda x: x <= F.col("number")))).where(F.col("shard") < shards)
    cut = (F.col("pass") == F.col("passes")) & (F.col("rank") == F.col("drawn") - 1)
    taken = taken.withColumn("high", F.when(cut, F.least("high", begin + F.col("cut"))).otherwise(F.col("high"))) \
        .where("low < high")
    segments = taken.select(
        "row", "doc_id", "pass", (F.col("low") - F.col("at")).alias("start"), (F.col("high") - F.col("at")).alias("end"),
        "shard", F.xxhash64("source", "number", F.lit(seed)).alias("place"))
    return placed.select("doc_id", "tie", "source", "at", "size", "source_size", "target", "row"), segments


def taken_words(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards): words of each document in the mix, repeats counted, and
    shard:words of every shard that has some, comma-joined."""
    words = segments.groupBy("row", "shard").agg(F.sum(F.col("end") - F.col("start")).alias("words")).groupBy("row").agg(
        F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("parts"))
    listed = F.array_join(F.transform("parts", lambda x: F.concat_ws(":", x["shard"], x["words"])), ",")
    return documents.join(words, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce(listed, F.lit("")).alias("shards"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    **options) -> DataFrame:
    """The mix as rows of ``docs``: a document once for each pass that takes it, and for the last pass the
    stretch of its text that is taken (all of it, unchanged, where all its words are).

    One partition a shard, shuffled by the places of the blocks; a document is where its first words are."""
    documents, segments = mix(docs, doc_id, text, source, **options)
    shards = options.get("shards", SHARDS)
    # Documents that are equal in id, text and source are told apart by counting them on both sides.
    def counted(key: list[Column], order: str | Column) -> Column:
        return F.row_number().over(Window.partitionBy(*key).orderBy(order))

    key = [F.col("tie"), F.xxhash64("source")]
    numbered = documents.select("row", "size", "tie", F.xxhash64("source").alias("of"),
                                counted(key, "at").alias("number"))
    spans = segments.groupBy("row", "pass").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"),
        F.sum(F.col("end") - F.col("start")).alias("_words"),
        F.min(F.struct("start", "shard", "place")).alias("_first"))
    spans = spans.join(numbered, "row").select(
        F.col("tie").alias("_tie"), F.col("of").alias("_of"), F.col("number").alias("_number"),
        "_spans", (F.col("_words") == F.col("size")).alias("_whole"),
        F.col("_first.shard").alias("_shard"), F.col("_first.place").alias("_place"))
    own = packed(docs, _tie=tie_of(F.col(doc_id), F.col(text)), _of=F.xxhash64(F.col(source).cast("string")),
                 _text=F.col(text).cast("string"))
    own = own.withColumn("_number", counted([F.col("_tie"), F.col("_of")], F.col("_tie")))
    taken = own.join(spans, ["_tie", "_of", "_number"])
    cut = F.when(F.col("_whole"), F.col("_text")).otherwise(_stretches(F.col("_text"), F.col("_spans")))
    dealt = taken.select(F.col("row").withField(f"`{text}`", cut).alias("row"), "_shard", "_place")
    return dealt.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_place").select("row.*")


def _stretches(text: Column, spans: Column) -> Column:
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.flatten(F.transform(
        spans, lambda x: F.slice(words, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), " ")


@query("op7_mixing")
def op7_mixing(spark: SparkSession, path: str) -> DataFrame:
    return taken_words(*mix(read(spark, path, "documents")))
