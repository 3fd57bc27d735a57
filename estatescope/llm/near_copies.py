"""Near-duplicates of the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash first, then an exact prefix-filter join for what it leaves.  Each set has the fingerprint of its shingles; the trie of
the fingerprints is joined with itself (``simhash.links``), and every node is compared with the least one of its
fingerprint's component.  Fingerprints within four bits hold the closest copies, not all of 0.8, and not only those, so
each pair is checked as whole sets, and all other pairs are looked for by prefixes.

The prefix-filter join: all shingles have one order, rarest first: by their count in a count-min sketch that is merged
from all partitions, then by hash.  Any order is exact; this one keeps passages that many texts share out of the prefixes.
Two sets of n >= m shingles that are similar enough share one of the first n - ceil(0.8 n) + 1 of the larger set and the first
m - ceil(8/9 m) + 1 of the smaller one, and the shingle that they share first has enough members behind it on both sides
(size and position filter).

Equal sets are one node, so copies never become pairs.  Its pairs are made in three steps, and what SimHash or an earlier step has
linked is no pair of a later one:

1. every node with the centre of the largest bucket (nodes that share a shingle of their prefixes) that it is in; the centre is
   the member in which the shared shingle stands first, the least edited one of a family;
2. nodes with the centres of their other buckets, where the two are not linked already;
3. in buckets that are not yet one component, the members outside the centre's component with all others, under the filters.

Before sets are compared a parity bitmap of each (every shingle flips one bit) bounds their difference from below; only
pairs that it does not rule out are compared as whole sets.  No pair that is similar enough is lost, none that is not is linked.

Words are those of SimHash (ASCII lower case, parted by white space); a text of fewer than five words is one shingle;
null, empty and blank texts have none and are copies of each other.  Repeated rows are documents of their own; only
the two named columns are read, so others may have any name.  An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from estatescope.llm.components import connected
from estatescope.llm.simhash import fingerprint_of, first_rows, links, tie_of
from estatescope.llm.texts import mixed, pieces, word_hashes
from estatescope.workspace import joined_in_tasks, removed, stored, work_folder

SHINGLE, PERCENT, SEED = 5, 80, 42
#: Cells of a row of the sketch of counts (two rows), and bits of a bitmap.
BITS, BITMAP = 22, 1024
_ROWS, _PAGE = 2, 1 << 14
#: Names that a task remembers, to send a node once.
REMEMBERED = 1 << 17


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    k = min(size, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mixed(out ^ hashes[i:i + n], i + 1)
    return np.unique(out)


def name_of(values: np.ndarray) -> int:
    """The node of a set: 0 for the empty one."""
    return xxhash.xxh64_intdigest(values.tobytes(), SEED) if len(values) else 0


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), tie_of(text).alias("tie"),
                       F.col(text).cast("string").alias("text"))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    whole = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole.view(np.int64)))


def _names(found: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([name_of(x) for x in found], np.uint64).view(np.int64))


# The order of the shingles

def _cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(values, 2001 + row) >> np.uint64(64 - bits)).astype(np.int64)


class Counted:
    """How often a partition has hit each cell."""

    def __init__(self, bits: int):
        self.bits, self.counts = bits, np.zeros(_ROWS << bits, np.uint32)

    def add(self, values: np.ndarray) -> None:
        for row in range(_ROWS):
            cell, n = np.unique(_cells(values, row, self.bits) + (row << self.bits), return_counts=True)
            self.counts[cell] += n.astype(np.uint32)

    def pages(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(page, places, counts up to 255) of the cells that were hit; places as numbers, or of many as a mask."""
        for page in range(0, len(self.counts), _PAGE):
            part = self.counts[page:page + _PAGE]
            hit = np.flatnonzero(part)
            if len(hit):
                places = hit.astype(np.uint16) if 2 * len(hit) < _PAGE // 8 else np.packbits(part > 0)
                yield page // _PAGE, places.tobytes(), np.minimum(part[hit], 255).astype(np.uint8).tobytes()


def _merged(pages: DataFrame, bits: int) -> np.ndarray:
    """The counts of all partitions, in steps of a quarter of a doubling: one byte a cell.

    The driver gets at most 16 KB, compressed, for each of a fixed number of pages."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, counts = None, np.zeros(_PAGE, np.int64)

        def finished() -> pa.RecordBatch:
            steps = np.where(counts > 0, 4 * np.log2(np.maximum(counts, 1)) + 1, 0).astype(np.uint8)
            return pa.RecordBatch.from_arrays(
                [pa.array([page], pa.int32()), pa.array([zlib.compress(steps.tobytes(), 1)], pa.binary())], ["page", "steps"])

        for batch in batches:
            for p, places, hits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p != page:
                    if page is not None:
                        yield finished()
                    page, counts = p, np.zeros(_PAGE, np.int64)
                mask = len(places) == _PAGE // 8
                at = np.flatnonzero(np.unpackbits(np.frombuffer(places, np.uint8))) if mask else \
                    np.frombuffer(places, np.uint16)
                counts[at] += np.frombuffer(hits, np.uint8)
        if page is not None:
            yield finished()

    done = pages.repartition("page").sortWithinPartitions("page").mapInArrow(merge, "page int, steps binary")
    out = np.zeros(_ROWS << bits, np.uint8)
    for page, steps in done.toLocalIterator():
        out[page * _PAGE:(page + 1) * _PAGE] = np.frombuffer(zlib.decompress(steps), np.uint8)
    return out


def ordered(values: np.ndarray, steps: np.ndarray, bits: int) -> np.ndarray:
    """Rarest first; the order of any two shingles is the same in every set."""
    rank = np.minimum(*[steps[_cells(values, row, bits) + (row << bits)] for row in range(_ROWS)])
    return values[np.lexsort((values, rank))]


def probe_length(n: int, percent: int) -> int:
    """Of the larger of two similar sets so many of its first shingles hold the first common one."""
    return n - -(-percent * n // 100) + 1 if n else 0


def index_length(n: int | Column, percent: int):
    """The same of the smaller one."""
    if isinstance(n, Column):
        return n - F.ceil(n * (2 * percent) / (100 + percent)) + 1
    return n - -(-2 * percent * n // (100 + percent)) + 1


def bitmap(values: np.ndarray) -> bytes:
    """Bit i is the parity of the shingles that fall to it: each one in just one of two sets changes at most one bit."""
    return np.packbits(np.bincount((values >> np.uint64(20)).astype(np.int64) % BITMAP, minlength=BITMAP) & 1).tobytes()


def described(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
              bits: int = BITS) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, tie, name, n), n the number of different shingles; and the merged sketch."""
    rows = _rows(docs, doc_id, text)
    key = rows.schema["doc_id"].dataType.simpleString()
    names = ["kind", "doc_id", "tie", "name", "n", "page", "places", "counts"]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, id_type = Counted(bits), None
        for piece in pieces(batches, "text"):
            found = [shingles(t, size) for t in piece.column("text").to_pylist()]
            counted.add(np.concatenate(found))
            m, id_type = len(found), piece.column("doc_id").type
            yield pa.RecordBatch.from_arrays([
                pa.array(["doc"] * m), piece.column("doc_id"), piece.column("tie"), _names(found),
                pa.array([len(x) for x in found], pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()),
                pa.nulls(m, pa.binary())], names)
        for page, places, counts in counted.pages() if id_type else ():
            yield pa.RecordBatch.from_arrays([
                pa.array(["page"]), pa.nulls(1, id_type), *[pa.nulls(1, pa.int64())] * 3, pa.array([page], pa.int32()),
                pa.array([places], pa.binary()), pa.array([counts], pa.binary())], names)

    both = stored(rows.mapInArrow(scan, f"kind string, doc_id {key}, tie bigint, name bigint, n bigint, page int, "
                                        "places binary, counts binary"), f"{folder}/described", "kind")
    return (both.where("kind = 'doc'").select("doc_id", "tie", "name", "n"),
            _merged(both.where("kind = 'page'").select("page", "places", "counts"), bits))


def _nodes(docs: DataFrame, sent: Broadcast, doc_id: str, text: str, size: int, percent: int, bits: int) -> DataFrame:
    """(name, n, fp, prefix, bits): one row of every different set but the empty one; fp is its SimHash fingerprint."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in pieces(batches, "text"):
            if len(seen) > REMEMBERED:
                seen.clear()
            found = []
            for t in piece.column("text").to_pylist():
                values = shingles(t, size)
                name = name_of(values)
                if name and name not in seen:
                    seen.add(name)
                    found.append(values)
            prefixes = [ordered(x, sent.value, bits)[:probe_length(len(x), percent)] for x in found]
            yield pa.RecordBatch.from_arrays(
                [_names(found), pa.array([len(x) for x in found], pa.int64()),
                 pa.array(np.array([fingerprint_of(x) for x in found], np.uint64).view(np.int64)), _lists(prefixes),
                 pa.array([bitmap(x) for x in found], pa.binary())], ["name", "n", "fp", "prefix", "bits"])

    return _rows(docs, doc_id, text).select("text").mapInArrow(
        scan, "name bigint, n bigint, fp bigint, prefix array<bigint>, bits binary").dropDuplicates(["name"])


# Comparing

def _possible(pairs: DataFrame, bits_of: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps do not rule them out."""
    side = lambda s: bits_of.select(
        F.col("name").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                    for c in ("bits_a", "bits_b"))
            differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            both = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            good = pa.array((100 + percent) * differ <= (100 - percent) * both)
            yield batch.select(["a", "b"]).filter(good)

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(judge, "a bigint, b bigint")


def _sets(docs: DataFrame, marked: DataFrame, names: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(name, shingles) of some names, each from one of its documents."""
    one = marked.join(names, "name", "left_semi").groupBy("name").agg(
        F.min(F.struct("doc_id", "tie")).alias("x")).select(F.col("x.doc_id").alias("id"), F.col("x.tie").alias("own"))
    rows = _rows(docs, doc_id, text)
    rows = rows.join(one, rows["doc_id"].eqNullSafe(one["id"]) & (rows["tie"] == one["own"]), "left_semi").select("text")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            found = [shingles(t, size) for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([_names(found), _lists(found)], ["name", "shingles"])

    return rows.mapInArrow(scan, "name bigint, shingles array<bigint>").dropDuplicates(["name"])


class Comparison:
    """Exact similarity of pairs of nodes."""

    def __init__(self, docs: DataFrame, marked: DataFrame, nodes: DataFrame, folder: str, percent: int, where: tuple):
        self.docs, self.marked, self.bits = docs, marked, nodes.select("name", "n", "bits")
        self.folder, self.percent, self.where, self.made = folder, percent, where, 0

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets are similar enough, as a written table."""
        spark, self.made = self.docs.sparkSession, self.made + 1
        at = f"{self.folder}/compared-{self.made}"
        possible = stored(_possible(pairs, self.bits, self.percent), f"{at}/possible")
        if possible.isEmpty():
            return possible
        names = possible.select(F.col("a").alias("name")).union(possible.select("b")).distinct()
        sets = stored(_sets(self.docs, self.marked, names, *self.where), f"{at}/sets")
        side = lambda s: sets.select(F.col("name").alias(s), F.col("shingles").alias(f"set_{s}"))
        both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        either = F.size("set_a") + F.size("set_b") - both
        found = stored(possible.join(side("a"), "a").join(side("b"), "b").where(
            100 * both >= self.percent * either).select("a", "b"), f"{at}/found")
        removed(spark, f"{at}/possible")
        removed(spark, f"{at}/sets")
        return found


def _by_fingerprint(nodes: DataFrame, folder: str) -> DataFrame:
    """Pairs of each node (a) and the least one (b) of its fingerprint's component: stars, whichever of them are kept."""
    least = stored(nodes.groupBy("fp").agg(F.min("name").alias("least")), f"{folder}/fingerprints")
    roots = connected(links(least.select("fp"), f"{folder}/simhash"), f"{folder}/simhash")
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("least").alias("b"))
    return nodes.select(F.col("name").alias("a"), "fp").join(rooted.select("fp", "root"), "fp").join(
        first, "root").where("a <> b").select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) that no links connect yet."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _with_links(roots: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """The roots when there are more links: a node and its root stand for all the links that led there."""
    if links.isEmpty():
        return roots
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return connected(known.union(links.select("a", "b")), folder)


def _remaining(met: DataFrame, centres: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of buckets that are not one component: members outside the centre's component with all others."""
    rooted = met.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn(
        "root", F.coalesce("root", "name"))
    first = centres.select("token", F.col("centre").alias("name")).join(
        roots.withColumnRenamed("node", "name"), "name", "left").select(
        "token", F.col("name").alias("centre"), F.coalesce("root", "name").alias("first"))
    members = rooted.join(first, "token").where("name <> centre").select(
        "token", "pos", "name", "n", "root", (F.col("root") != F.col("first")).alias("outside"))
    open_ = members.groupBy("token").agg(F.bool_or("outside").alias("o"), F.count("*").alias("c")).where("o AND c > 1")
    members = members.join(open_.select("token"), "token", "left_semi")
    side = lambda s, rows: rows.select("token", *[F.col(c).alias(f"{c}_{s}") for c in (
        "pos", "name", "n", "root", "outside")])
    x = side("x", members.where("outside")).join(side("y", members), "token")
    less = F.expr("n_x < n_y OR n_x = n_y AND name_x < name_y")
    enough = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) * (100 + percent)         >= percent * (F.col("n_x") + F.col("n_y"))
    return x.where("root_x <> root_y AND (NOT outside_y OR name_x < name_y)").where(
        enough & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))).where(
        F.when(less, F.col("pos_x") < index_length(F.col("n_x"), percent))
        .otherwise(F.col("pos_y") < index_length(F.col("n_y"), percent))).select(
        F.least("name_x", "name_y").alias("a"), F.greatest("name_x", "name_y").alias("b")).distinct()


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
               percent: int = PERCENT, bits: int = BITS) -> DataFrame:
    """(doc_id, tie, root): root is the same for documents that links connect."""
    with joined_in_tasks(docs.sparkSession):
        return _components(docs, doc_id, text, size, percent, bits)


def _components(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, bits: int) -> DataFrame:
    spark = docs.sparkSession
    folder = work_folder(spark, "near-copies")
    marked, steps = described(docs, folder, doc_id, text, size, bits)
    sent = spark.sparkContext.broadcast(steps)
    nodes = stored(_nodes(docs, sent, doc_id, text, size, percent, bits), f"{folder}/nodes")
    sent.destroy()
    entries = nodes.select("name", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = stored(entries.groupBy("token").count().where("count > 1").select("token"), f"{folder}/shared")
    met = stored(entries.join(shared, "token", "left_semi"), f"{folder}/met")
    removed(spark, f"{folder}/shared")
    centres = stored(met.groupBy("token").agg(
        F.count("*").alias("members"), F.min(F.struct("pos", "name")).alias("x")).select(
        "token", "members", F.col("x.name").alias("centre")), f"{folder}/centres")
    compare = Comparison(docs, marked, nodes, folder, percent, (doc_id, text, size))

    stars = stored(met.select("token", "name").join(centres, "token").where("name <> centre").groupBy(
        "name", "centre").agg(F.max("members").alias("members")), f"{folder}/stars")
    first = stars.groupBy("name").agg(F.max(F.struct("members", "centre")).alias("x")).select(
        F.col("name").alias("a"), F.col("x.centre").alias("b"))
    near = compare.similar(_by_fingerprint(nodes, folder))
    roots = near.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = _with_links(roots, compare.similar(_apart(first, roots)), f"{folder}/linked")
    other = stars.select(F.least("name", "centre").alias("a"), F.greatest("name", "centre").alias("b"))
    roots = _with_links(roots, compare.similar(_apart(other, roots).distinct()), f"{folder}/first")
    removed(spark, f"{folder}/stars")

    rest = stored(_remaining(met, centres, roots, percent), f"{folder}/rest")
    if not rest.isEmpty():
        roots = _with_links(roots, compare.similar(rest), f"{folder}/second")
    for table in ("nodes", "centres", "met", "rest"):
        removed(spark, f"{folder}/{table}")
    return marked.join(roots.withColumnRenamed("node", "name"), "name", "left").select(
        "doc_id", "tie", F.coalesce("root", "name").alias("root"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` of each component: that of the least doc_id (null ids last; equal ids: by text)."""
    with joined_in_tasks(docs.sparkSession):
        return first_rows(docs, components(docs, doc_id, text, **options), doc_id, text)
