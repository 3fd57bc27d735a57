"""SimHash near-duplicates (3): a binary trie joined with itself.

Each text becomes 64 bits: bit i is set if more than half of its shingles' hashes have it set.  Two
fingerprints link when at most ``ERRORS`` bits differ.  Links are found by walking pairs of trie nodes
from the top: the bits in which the two paths differ are added up, and a pair is left as soon as its
sum exceeds the budget; what the two leaves of a surviving pair differ in is then at most the budget.

So that the walk can be dealt out, the trie is kept in one rotation of the bits more than there may be errors
(five): of five blocks at least one is free of errors, so in that rotation a pair shares its first 12 or
13 levels and meets below one node.  Such a node is a task of its own; a node with more than ``LEAF`` fingerprints
is walked further down by joins of nodes (eight levels at a time) until its pairs are small, so a hot node
becomes many tasks.  Equal fingerprints are one leaf, and each task reduces its links to a forest, so
copies never become pairs.

Null, empty and blank texts have fingerprint zero and link like any other.  Repeated rows are documents of
their own and share a component; an empty table gives an empty table; null ids never
name a component unless all are null; only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from estatescope.llm.components import connected
from estatescope.llm.registry import query, read
from estatescope.llm.texts import packed, pieces
from estatescope.workspace import stored, work_folder

SHINGLE, ERRORS, SEED = 4, 4, 42
#: A node with more fingerprints is walked down by joins before its members meet in a task.
LEAF = 2048


def blocks(errors: int) -> list[tuple[int, int]]:
    """Where each rotation starts and how many levels its error-free block has: one block more than errors."""
    if not 0 <= errors < 64:
        raise ValueError("errors must be 0 to 63")
    size, more = divmod(64, errors + 1)
    ends = [size * (i + 1) + min(i + 1, more) for i in range(errors + 1)]
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


def _depths(errors: int) -> list[int]:
    """The levels at which nodes are joined, from that of the largest block on."""
    return [*range(blocks(errors)[0][1], 64, 8), 64]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    first, last = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    counts, xxh = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), 1 << 16):
        hashes = np.array([xxh(joined[s:e], SEED) for s, e in zip(
            first[at:at + (1 << 16)], last[at:at + (1 << 16)], strict=True)], np.uint64)
        counts += _ones(hashes)
    return _majority(counts, len(first))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 bits the number of hashes that have it set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > n))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of a text that is given by the hashes of its shingles."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += _ones(hashes[at:at + (1 << 16)])
    return _majority(counts, len(hashes))


def tie_of(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 size: int = SHINGLE) -> DataFrame:
    """(doc_id, tie, fp): fp is the fingerprint's 64 bits as a signed number, tie a hash of the text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), tie_of(text).alias("tie"),
                       F.col(text).cast("string").alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            found = np.array([fingerprint(t, size) for t in piece.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("tie"), pa.array(found.view(np.int64))],
                ["doc_id", "tie", "fp"])

    return rows.mapInArrow(scan, f"doc_id {key}, tie bigint, fp bigint")


def _top(value: Column | str, bits: int) -> Column:
    """The first bits of a 64-bit number: the trie node at that depth."""
    return F.shiftrightunsigned(value, 64 - bits) if bits < 64 else F.col(value)


def _members(values: DataFrame, errors: int) -> DataFrame:
    """Each fingerprint in each rotation, with the depth of the rotation's free block and its node."""
    turned = [F.struct(F.lit(r).alias("turn"), F.lit(d).alias("depth"), (
        F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s)) if s else F.col("fp")).alias("v"))
        for r, (s, d) in enumerate(blocks(errors))]
    out = values.select(F.explode(F.array(*turned)).alias("x")).select("x.*")
    depths = {d for _, d in blocks(errors)}  # one, or two
    return out.withColumn("node", F.coalesce(*[F.when(F.col("depth") == d, _top("v", d)) for d in sorted(depths)]))


def _tasks(values: DataFrame, folder: str, leaf: int, errors: int) -> DataFrame:
    """(turn, depth, a, b, err, v): the members of each pair of nodes that is small enough."""
    members, depths = _members(values, errors), _depths(errors)
    crowded = stored(members.groupBy("turn", "depth", "node").agg(F.count("*").alias("n"))
                     .where(F.col("n") > leaf), f"{folder}/crowded")
    node = F.col("node")
    small = members.join(crowded.select("turn", "node"), ["turn", "node"], "left_anti").select(
        "turn", "depth", node.alias("a"), node.alias("b"), F.lit(0).alias("err"), "v")
    if crowded.isEmpty():
        return small
    # Fewer members: only those below crowded nodes take part in the joins.
    below = stored(members.join(crowded.select("turn", "node"), ["turn", "node"], "left_semi"),
                   f"{folder}/below")
    pairs = crowded.select("turn", node.alias("a"), node.alias("b"), F.lit(0).alias("err"))
    for level, depth in enumerate(depths[1:]):
        parent = node if level == 0 else _top("v", depths[level])
        children = below.groupBy("turn", parent.alias("parent"), _top("v", depth).alias("child")) \
            .agg(F.count("*").alias("n"))
        side = lambda s: children.select(
            "turn", F.col("parent").alias(s), F.col("child").alias(f"{s}2"), F.col("n").alias(f"n{s}"))
        differing = F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))  # over the whole path
        met = pairs.join(side("a"), ["turn", "a"]).join(side("b"), ["turn", "b"]) \
            .where((F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2"))) \
            .where(differing <= errors)
        members_of_pair = F.when(F.col("a2") == F.col("b2"), F.col("na")).otherwise(F.col("na") + F.col("nb"))
        met = stored(met.select("turn", F.col("a2").alias("a"), F.col("b2").alias("b"),
                                differing.cast("int").alias("err"), members_of_pair.alias("n")),
                     f"{folder}/pairs-{depth}")
        ready = met.where((F.col("n") <= leaf) | F.lit(depth == 64))
        ends = ready.withColumn("at", F.explode(F.array_distinct(F.array("a", "b"))))
        small = small.union(below.withColumn("at", _top("v", depth)).join(ends, ["turn", "at"]).select(
            "turn", F.lit(depth), "a", "b", "err", "v"))
        pairs = met.where((F.col("n") > leaf) & F.lit(depth < 64)).drop("n")
        if pairs.isEmpty():
            break
    return small


def walked(values: np.ndarray, starts: np.ndarray, splits: np.ndarray, ends: np.ndarray,
           err: np.ndarray, depth: int, budget: int = ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``values`` (sorted within each task) that differ in at most ``budget`` bits.

    A task is the range start..end; with a split inside it is the pair of the nodes before and after
    the split, else the pair of a node with itself.  Node pairs are taken from a stack, level by level."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    ones: dict[int, np.ndarray] = {}
    self_pair = splits >= ends
    stack = [(depth, starts, np.where(self_pair, ends, splits),
              np.where(self_pair, starts, splits), ends, err)]
    while stack:
        d, a, a_end, b, b_end, e = stack.pop()
        live = (a < a_end) & (b < b_end) & (e <= budget)
        a, a_end, b, b_end, e = a[live], a_end[live], b[live], b_end[live], e[live]
        if len(a) > 200_000:
            half = len(a) // 2
            stack += [(d, *[x[:half] for x in (a, a_end, b, b_end, e)]),
                      (d, *[x[half:] for x in (a, a_end, b, b_end, e)])]
            continue
        size = (a_end - a) * (b_end - b)
        near = e + (64 - d) <= budget  # whatever follows, these leaves all link
        if near.any():
            for left, right, right_end in ((a, b, b_end), (b, a, a_end)):
                n = (right_end - right)[near]
                found.append((np.repeat(left[near], n), _ranges(right[near], n)))
        small = ~near & ((size <= 32) | (d >= 64))
        if small.any():
            n = size[small]
            within = _ranges(np.zeros(len(n), np.int64), n)
            width = np.repeat((b_end - b)[small], n)
            i, j = np.repeat(a[small], n) + within // width, np.repeat(b[small], n) + within % width
            one = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            found.append((i[one], j[one]))
        rest = ~near & ~small
        if rest.any():
            a, a_end, b, b_end, e = a[rest], a_end[rest], b[rest], b_end[rest], e[rest]
            if d not in ones:
                ones[d] = np.concatenate([[0], np.cumsum(values >> np.uint64(63 - d) & np.uint64(1))]).astype(np.int64)
            a_mid, b_mid = (end - (ones[d][end] - ones[d][at]) for at, end in ((a, a_end), (b, b_end)))
            other = a != b
            stack.append((d + 1, *[np.concatenate(x) for x in zip(
                (a, a_mid, b, b_mid, e), (a_mid, a_end, b_mid, b_end, e),
                (a, a_mid, b_mid, b_end, e + 1),
                (a_mid[other], a_end[other], b[other], b_mid[other], e[other] + 1), strict=True)]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    shift = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - shift, sizes)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least place it reaches over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _task_batches(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[np.ndarray]:
    """Whole tasks, about ``rows`` rows at a time, of an input in which tasks stand together."""
    held: list[np.ndarray] = []
    kind = [("turn", "i4"), ("depth", "i4"), ("a", "i8"), ("b", "i8"), ("err", "i4"), ("v", "u8")]
    for batch in batches:
        table = np.empty(batch.num_rows, kind)
        for name, _ in kind:
            table[name] = batch.column(name).to_numpy(zero_copy_only=False).view(
                np.uint64) if name == "v" else batch.column(name).to_numpy(zero_copy_only=False)
        held.append(table)
        if sum(map(len, held)) >= rows:
            whole = np.concatenate(held)
            border = np.flatnonzero(_task_starts(whole))[-1]
            if border:
                yield whole[:border]
            held = [whole[border:]]
    if held:
        yield np.concatenate(held)


def _task_starts(t: np.ndarray) -> np.ndarray:
    new = np.ones(len(t), bool)
    same = np.logical_and.reduce([t[c][1:] == t[c][:-1] for c in ("turn", "depth", "a", "b")])
    new[1:] = ~same
    return new


def links(values: DataFrame, folder: str, leaf: int = LEAF, errors: int = ERRORS) -> DataFrame:
    """(a, b): links between different fingerprints that connect the same ones as all links do."""
    tasks = _tasks(values, folder, leaf, errors)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _task_batches(batches, 4 * leaf):
            for depth in np.unique(whole["depth"]):
                t = whole[whole["depth"] == depth]
                if not len(t):
                    continue
                starts = np.flatnonzero(_task_starts(t))
                ends = np.concatenate([starts[1:], [len(t)]])
                # Unsigned order within a task; of two nodes the one of the first member leads.
                task = np.repeat(np.arange(len(starts)), ends - starts)
                t = t[np.lexsort((t["v"], task))]
                v = t["v"]
                second = (v >> np.uint64(64 - int(depth))) != (v[starts] >> np.uint64(64 - int(depth)))[task]
                splits = ends - np.bincount(task, second, len(starts)).astype(np.int64)
                pair = t["a"][starts] != t["b"][starts]
                i, j = walked(v, starts, np.where(pair, splits, ends), ends,
                              t["err"][starts].astype(np.int64), int(depth), errors)
                root = forest(len(v), i, j)
                own = np.flatnonzero(root != np.arange(len(v)))
                shift = np.array([blocks(errors)[r][0] for r in t["turn"][own]], np.uint64)
                back = lambda x: (x >> shift | x << (np.uint64(64) - shift) % np.uint64(64)).view(np.int64)  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(back(v[own])), pa.array(back(v[root[own]]))], ["a", "b"])

    key = ["turn", "depth", "a", "b"]
    dealt = tasks.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(walk, "a bigint, b bigint").distinct()


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
               errors: int = ERRORS, leaf: int = LEAF) -> DataFrame:
    """(doc_id, tie, fp, root, component_id): the least doc_id that each document reaches over links; root is
    the component's own name, a fingerprint."""
    folder = work_folder(docs.sparkSession, "simhash")
    marked = stored(fingerprints(docs, doc_id, text, size), f"{folder}/fingerprints")
    leaves = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/leaves")
    roots = connected(links(leaves.select("fp"), folder, leaf, errors), folder)
    rooted = leaves.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(rooted.join(named, "root").select("fp", "root", "component_id"), f"{folder}/classes")
    return marked.join(classes, "fp").select("doc_id", "tie", "fp", "root", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` of each component: that of the least doc_id (null ids last; equal ids: by text)."""
    return first_rows(docs, components(docs, doc_id, text, **options), doc_id, text)


def first_rows(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of ``docs`` of each root of ``found`` (doc_id, tie, root)."""
    first = found.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("x")).select("x.doc_id", "x.tie")
    first = stored(first, work_folder(docs.sparkSession, "representatives"))
    repeated = found.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = stored(repeated, work_folder(docs.sparkSession, "repeated-rows"))
    own = packed(docs, id=F.col(doc_id), own_tie=tie_of(text))

    def beside(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(keys, rows["id"].eqNullSafe(keys["doc_id"]) & (rows["own_tie"] == keys["tie"]), how)

    kept = beside(own, first, "left_semi")
    once = beside(kept, repeated, "left_anti")
    again = beside(kept, repeated, "left_semi").dropDuplicates(["id", "own_tie"])
    return once.union(again).select("row.*")


@query("op3_simhash")
def op3_simhash(spark: SparkSession, path: str) -> DataFrame:
    found = components(read(spark, path, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
