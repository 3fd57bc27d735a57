"""Ranked lexical search (12): a dual-tree search for the k best documents of every item.

1. Postings: per document its number of terms and the frequencies of those terms that items ask for; from them N, L and
   the documents of each term.
2. Leaves: documents of a task in batches of ``LEAF``, alike ones together, each posting with its impact (what the
   document adds to a score per unit of the term's weight) and each batch with its coordinate maxima.
3. First bounds: of every item the leaf with the highest bound (weights times maxima) is scored; the kth of those
   scores is a lower bound of the item's kth score over all documents.
4. Search: a hierarchy over the items and one over the leaves that a task holds, every node with its coordinate maxima, are
   walked together from the top.  A pair of nodes whose bound is below the weakest kth score of the node's items is
   left with all below it; leaf batches that remain are scored exactly against the items that remain, and raise
   their kth scores.  A bound never understates a score and equal scores are kept, so nothing is lost.
5. Each task sends at most k documents an item; the k best of all are numbered.

All numbers are integers; bounds are sums of doubles with a margin above their rounding.  Items are taken in blocks whose
texts and whose dense weights have a bounded size; equal texts are one item until the end, so a common one costs no more
than another.  Null, empty and blank texts have no terms: such documents have no rank and such items no rows.  Every row of
documents is a document of its own, every row of items an item of its own; equal scores rank by ascending doc_id, nulls
last.  Long texts are read in stretches.  Empty tables give an empty table; only the named columns are read, so others may
have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from estatescope.llm.registry import query, read
from estatescope.llm.texts import pieces
from estatescope.workspace import removed, stored, work_folder

TOP, LEAF, FANOUT = 20, 32, 8
#: Bytes of item texts in a block, cells of its dense weights, documents sorted at once, postings searched at once.
BLOCK_BYTES, CELLS, SORTED, SEARCHED = 4 << 20, 4 << 20, 1 << 12, 1 << 19
STRETCH = 1 << 20
#: Bounds are raised by this share, far above the rounding of sums of doubles.
MARGIN = 1 + 1e-9
_EXACT = float(1 << 53)

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BORDER = re.compile(rb"[^0-9a-z\x80-\xff]")


def stretches(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, about a megabyte at a time; only A-Z become lower case."""
    data, start = (text or "").encode().lower(), 0
    while start < len(data):
        border = _BORDER.search(data, start + STRETCH) if len(data) - start > STRETCH else None
        end = border.start() if border else len(data)
        yield _TERM.findall(data, start, end)
        start = end


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df.astype(np.float64) + 1))).astype(np.int64)


def size_term(n: int, documents: int, terms: int) -> int:
    """m of a document with n terms."""
    return 100 - 25 + (25 * n * documents) // terms


# Items

class Items(NamedTuple):
    """Different texts of a block: (item, term) counts, sorted by item; ``terms`` numbers the block's terms."""

    terms: dict[bytes, int]
    item: np.ndarray
    term: np.ndarray
    count: np.ndarray
    keys: list[str]


def _blocks(texts: DataFrame) -> Iterator[Items]:
    """The different item texts (key, text), a bounded number of bytes and cells at a time."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total // BLOCK_BYTES
    for part in range(parts):
        chosen = texts if parts == 1 else texts.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
        held: list[tuple[str, Counter]] = []
        known: set[bytes] = set()
        for row in chosen.sort("key").toLocalIterator():
            counts: Counter = Counter()
            for words in stretches(row["text"]):
                counts.update(words)
            if not counts:
                continue
            if held and (len(held) + 1) * len(known | counts.keys()) > CELLS:
                yield _items(held)
                held, known = [], set()
            held.append((row["key"], counts))
            known |= counts.keys()
        if held:
            yield _items(held)


def _items(held: list[tuple[str, Counter]]) -> Items:
    terms: dict[bytes, int] = {}
    rows = [(i, terms.setdefault(t, len(terms)), c) for i, (_, counts) in enumerate(held) for t, c in counts.items()]
    item, term, count = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    return Items(terms, item, term, count, [k for k, _ in held])


class ItemTree:
    """Dense weights of a block's items and, level by level, the coordinate maxima of groups of alike items."""

    def __init__(self, items: Items, weight: np.ndarray):
        n, value = len(items.keys), items.count * weight[items.term]
        dense = np.zeros((n, len(items.terms)), np.int64)
        dense[items.item, items.term] = value
        # Alike items stand together: by the term that weighs most, then the next two.
        best = np.lexsort((items.term, -value, items.item))
        nth = np.arange(len(best)) - np.searchsorted(items.item[best], items.item[best])
        tops = np.full((3, n), -1)
        for i in range(3):
            tops[i, items.item[best][nth == i]] = items.term[best][nth == i]
        self.order = np.lexsort(tops[::-1])
        self.dense = dense[self.order]
        self.levels = [self.dense.astype(np.float64)]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FANOUT), axis=0))
        # Scores stay below the sum of an item's weights times the highest impact.
        self.exact = bool(dense.sum(axis=1, dtype=np.float64).max(initial=0) * 1e6 < _EXACT)

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        below = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return below[below < len(self.levels[level - 1])]

    def scores(self, items: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """(items, documents) of exact scores; ``values`` is (terms, documents)."""
        if self.exact:
            return (self.levels[0][np.ix_(items, terms)] @ values.astype(np.float64)).astype(np.int64)
        return self.dense[np.ix_(items, terms)] @ values

    def weakest(self, bounds: np.ndarray) -> list[np.ndarray]:
        """Per level and node the lowest of its items' kth scores."""
        out = [bounds]
        while len(out[-1]) > 1:
            out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), FANOUT)))
        return out


# Documents

def _postings(docs: DataFrame, sent, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, counts) of the documents that have a term."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for piece in pieces(batches, "text"):
            kept, sizes, found = [], [], []
            for i, t in enumerate(piece.column("text")):
                n, counts = 0, Counter()
                for words in stretches(t.as_py()):
                    n += len(words)
                    counts.update(map(number, words))
                counts.pop(None, None)
                if n:
                    kept.append(i)
                    sizes.append(n)
                    found.append(counts)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in found])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array([t for c in found for t in c], pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array([x for c in found for x in c.values()], pa.int64()))],
                ["doc_id", "n", "terms", "counts"])

    return rows.mapInArrow(scan, f"doc_id {key}, n bigint, terms array<int>, counts array<bigint>")


def _statistics(postings: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the documents of each of the block's terms."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
            n += batch.num_rows
            total += int(batch.column("n").to_numpy().sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], held])), pa.array(np.concatenate([[total, n], df[held]]))],
            ["term", "x"])

    rows = postings.select("n", "terms").mapInArrow(count, "term bigint, x bigint") \
        .groupBy("term").agg(F.sum("x").alias("x")).collect()  # at most one row per term of the block
    found = {r["term"]: r["x"] for r in rows}
    df = np.zeros(terms, np.int64)
    for term, x in found.items():
        if term >= 0:
            df[term] = x
    return found.get(-1, 0), found.get(-2, 0), df


_LEAF = "leaf bigint, doc_ids array<{key}>, sizes array<int>, terms array<int>, impacts array<int>, " \
    "top_terms array<int>, top_impacts array<int>"


def _leaves(postings: DataFrame, sent, documents: int, length: int) -> DataFrame:
    """Batches of documents with their impacts and the coordinate maxima of each batch."""
    key = postings.schema["doc_id"].dataType

    def impacts(n: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
        m = np.array([size_term(int(x), documents, length) for x in n], np.int64)
        return (10**9 * count) // (1000 * count + 12 * np.repeat(m, size))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, weight = 0, sent.value
        part = TaskContext.get().partitionId() << 32
        for batch in _gathered(batches, SORTED, "terms"):
            table = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column("terms")), 0))
            n, size = table.column("n").to_numpy(), pa.compute.list_value_length(table.column("terms")).to_numpy()
            if not len(n):
                continue
            term = table.column("terms").flatten().to_numpy().astype(np.int64)
            value = impacts(n, size, table.column("counts").flatten().to_numpy())
            starts = np.concatenate([[0], np.cumsum(size)])
            doc = np.repeat(np.arange(len(n)), size)
            # Documents that owe most to the same terms stand together.
            best = np.lexsort((term, -(weight[term] * value), doc))
            nth = np.arange(len(best)) - starts[doc[best]]
            tops = np.full((3, len(n)), -1)
            for i in range(3):
                tops[i, doc[best][nth == i]] = term[best][nth == i]
            order = np.lexsort(tops[::-1])
            ids = table.column("doc_id").take(pa.array(order))
            size = size[order]
            at = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in order])
            term, value = term[at], value[at]
            first = np.arange(0, len(n), LEAF)
            bounds = np.concatenate([first, [len(n)]]).astype(np.int32)
            cut = np.concatenate([[0], np.cumsum(size)])[bounds].astype(np.int32)
            top_terms, top_values = [], []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                by = np.lexsort((value[s:e], term[s:e]))
                last = np.flatnonzero(np.diff(term[s:e][by], append=-1))
                top_terms.append(term[s:e][by][last])
                top_values.append(value[s:e][by][last])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in top_terms])]).astype(np.int32)
            lists = [(bounds, ids), (bounds, pa.array(size.astype(np.int32))), (cut, pa.array(term.astype(np.int32))),
                     (cut, pa.array(value.astype(np.int32))), (offsets, pa.array(np.concatenate(top_terms).astype(np.int32))),
                     (offsets, pa.array(np.concatenate(top_values).astype(np.int32)))]
            arrays = [pa.ListArray.from_arrays(pa.array(o), v) for o, v in lists]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part + made + np.arange(len(first))), *arrays],
                ["leaf", "doc_ids", "sizes", "terms", "impacts", "top_terms", "top_impacts"])
            made += len(first)

    return postings.mapInArrow(build, _LEAF.format(key=key.simpleString()))


def _gathered(batches: Iterable[pa.RecordBatch], rows: int, lists: str) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows and, but for a single row, some SEARCHED list members."""
    held: list[pa.RecordBatch] = []
    count = members = 0
    for whole in batches:
        step = 64
        for at in range(0, whole.num_rows, step):
            part = whole.slice(at, step)
            held.append(part)
            count += part.num_rows
            members += int(pa.compute.sum(pa.compute.list_value_length(part.column(lists))).as_py() or 0)
            if count >= rows or members >= SEARCHED:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, count, members = [], 0, 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# Search

class Best:
    """The k best documents of every item so far, and the lower bounds of the kth scores."""

    def __init__(self, bounds: np.ndarray, top: int):
        self.bounds, self.top = bounds.copy(), top
        self.scores = np.zeros((len(bounds), top), np.int64)
        self.rows: list[tuple[np.ndarray, np.ndarray, list]] = []
        self.held = 0

    def add(self, items: np.ndarray, scores: np.ndarray, ids: list) -> None:
        enough = (scores >= self.bounds[items][:, None]) & (scores > 0)
        if not enough.any():
            return
        row, column = np.nonzero(enough)
        self.rows.append((items[row], scores[row, column], [ids[c] for c in column.tolist()]))
        self.held += len(row)
        some = np.unique(row)
        both = np.concatenate([self.scores[items[some]], scores[some]], axis=1)
        both.sort(axis=1)
        self.scores[items[some]] = both[:, -self.top:]
        self.bounds[items[some]] = np.maximum(self.bounds[items[some]], both[:, -self.top])
        if self.held > 4 * self.top * len(self.bounds) + (1 << 16):
            self.cut()

    def cut(self) -> None:
        """Keep the k best of each item: highest scores, then least ids, nulls last."""
        if not self.rows:
            return
        found = sorted(((i, -s, d is None, d) for a, b, ids in self.rows
                        for i, s, d in zip(a.tolist(), b.tolist(), ids, strict=True)
                        if s >= self.bounds[i]), key=lambda x: (x[0], x[1], x[2], 0 if x[2] else x[3]))
        kept, last, n = [], -1, 0
        for i, s, _, d in found:
            n = n + 1 if i == last else 1
            last = i
            if n <= self.top:
                kept.append((i, -s, d))
        self.rows = [(np.array([x[0] for x in kept], np.int64), np.array([x[1] for x in kept], np.int64),
                      [x[2] for x in kept])] if kept else []
        self.held = len(kept)


class Walk:
    """One dual-tree walk over the leaves that a task holds at once."""

    def __init__(self, tree: ItemTree, batch: pa.RecordBatch, best: Best):
        self.tree, self.best, self.batch = tree, best, batch
        dense = np.zeros((batch.num_rows, tree.dense.shape[1]))
        sizes = pa.compute.list_value_length(batch.column("top_terms")).to_numpy()
        dense[np.repeat(np.arange(batch.num_rows), sizes), batch.column("top_terms").flatten().to_numpy()] = \
            batch.column("top_impacts").flatten().to_numpy()
        self.levels = [dense * MARGIN]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FANOUT), axis=0))
        self.pairs = self.scored = 0

    def run(self) -> None:
        top = len(self.tree.levels) - 1
        self._visit(top, np.arange(len(self.tree.levels[top])), len(self.levels) - 1, 0)

    def _visit(self, level: int, nodes: np.ndarray, height: int, node: int) -> None:
        """Item nodes of one level against one node of documents."""
        at = self.levels[height][node]
        terms = np.flatnonzero(at)
        bounds = self.tree.levels[level][np.ix_(nodes, terms)] @ at[terms]
        self.pairs += len(nodes)
        weakest = self.tree.weakest(self.best.bounds)[level][nodes]
        open_ = bounds >= np.maximum(weakest, 1)
        nodes = nodes[open_]
        if not len(nodes):
            return
        if not height and not level:
            self._score(nodes, node)
        elif not height:
            self._visit(level - 1, self.tree.children(level, nodes), 0, node)
        else:
            if level:
                nodes, level = self.tree.children(level, nodes), level - 1
            below = np.arange(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[height - 1])))
            # The most promising documents first: they raise the kth scores that prune the others.
            most = self.tree.levels[level][nodes].max(axis=0)
            for child in below[np.argsort(-(self.levels[height - 1][below] @ most), kind="stable")].tolist():
                self._visit(level, nodes, height - 1, child)

    def _score(self, items: np.ndarray, leaf: int) -> None:
        self.scored += len(items)
        term, value, size = (self.batch.column(c)[leaf].values.to_numpy() for c in ("terms", "impacts", "sizes"))
        known, place = np.unique(term, return_inverse=True)
        values = np.zeros((len(known), len(size)), np.int64)
        values[place, np.repeat(np.arange(len(size)), size)] = value
        self.best.add(items, self.tree.scores(items, known, values), self.batch.column("doc_ids")[leaf].as_py())


def _searched(leaves: DataFrame, sent, top: int) -> DataFrame:
    """(item, doc_id, score): of each task the k best documents of every item that can be among all's."""
    key = leaves.schema["doc_ids"].dataType.elementType

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, bounds = sent.value
        best = Best(bounds, top)
        for batch in _gathered(batches, max(1, CELLS // tree.dense.shape[1]), "terms"):
            Walk(tree, batch, best).run()
        best.cut()
        for item, score, ids in best.rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(ids, _arrow(key)), pa.array(score, pa.int64())],
                ["item", "doc_id", "score"])

    return leaves.mapInArrow(search, f"item bigint, doc_id {key.simpleString()}, score bigint")


def _arrow(spark_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(spark_type)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _first_bounds(leaves: DataFrame, tree: ItemTree, top: int) -> np.ndarray:
    """Of every item a lower bound of its kth score: the kth one in the leaf that promises most."""
    spark = leaves.sparkSession
    none = np.zeros(len(tree.dense), np.int64)
    sent = spark.sparkContext.broadcast(tree)

    def promise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        highest, chosen = np.zeros(len(sent.value.dense)), np.full(len(sent.value.dense), -1)
        for batch in _gathered(batches, max(1, CELLS // sent.value.dense.shape[1]), "top_terms"):
            dense = np.zeros((batch.num_rows, sent.value.dense.shape[1]))
            sizes = pa.compute.list_value_length(batch.column("top_terms")).to_numpy()
            dense[np.repeat(np.arange(batch.num_rows), sizes), batch.column("top_terms").flatten().to_numpy()] = \
                batch.column("top_impacts").flatten().to_numpy()
            bounds = sent.value.levels[0] @ dense.T
            at = bounds.argmax(axis=1)
            bound = bounds[np.arange(len(at)), at]
            better = bound > highest
            highest[better], chosen[better] = bound[better], batch.column("leaf").to_numpy()[at[better]]
        held = np.flatnonzero(highest)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array(highest[held]), pa.array(chosen[held])], ["item", "bound", "leaf"])

    best = leaves.select("leaf", "top_terms", "top_impacts").mapInArrow(
        promise, "item bigint, bound double, leaf bigint").groupBy("item").agg(F.max_by("leaf", "bound").alias("leaf"))
    scored = _searched(leaves.join(best.select("leaf").distinct(), "leaf", "left_semi"),
                       spark.sparkContext.broadcast((tree, none)), top)
    kth = _ranked(scored, top).where(F.col("rank") == top).select("item", "score").collect()  # one row per item
    out = none.copy()
    for row in kth:
        out[row["item"]] = row["score"]
    return out


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of ``items`` the ``top`` documents with the highest score above 0."""
    spark = docs.sparkSession
    folder = work_folder(spark, "ranked-search")
    # A key tells texts apart whatever their case is, so that rows of one text share one search.
    asked = stored(items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
                   .where("text IS NOT NULL").withColumn("key", F.sha2("text", 256)), f"{folder}/items")
    texts = asked.select("key", "text").dropDuplicates(["key"])
    key = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    result = None
    for number, block in enumerate(_blocks(texts)):
        at = f"{folder}/{number}"
        postings = stored(_postings(docs, spark.sparkContext.broadcast(block.terms), doc_id, text), f"{at}/postings")
        documents, length, df = _statistics(postings, len(block.terms))
        if not documents:
            break
        weight = weights(df, documents)
        leaves = stored(_leaves(postings, spark.sparkContext.broadcast(weight), documents, length), f"{at}/leaves")
        removed(spark, f"{at}/postings")
        tree = ItemTree(block, weight)
        bounds = _first_bounds(leaves, tree, top)
        found = stored(_ranked(_searched(leaves, spark.sparkContext.broadcast((tree, bounds)), top), top),
                       f"{at}/found")
        removed(spark, f"{at}/leaves")
        names = spark.createDataFrame([(i, block.keys[k]) for i, k in enumerate(tree.order.tolist())],
                                      "item bigint, key string")
        part = found.join(names, "item").select("key", "rank", "doc_id", "score")
        result = part if result is None else result.union(part)
    if result is None:
        result = spark.createDataFrame([], f"key string, rank int, doc_id {key}, score bigint")
    return asked.select("item_id", "key").join(result, "key").select("item_id", "rank", "doc_id", "score")


_TERMS = ("unnest(list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> ''))")


@query("op12_ranked_search", f"""
WITH t AS (SELECT r, doc_id, {_TERMS} AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT r, doc_id, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM d),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tf, s GROUP BY term, nn),
q AS (SELECT i, item_id, term, count(*) AS qf FROM (
        SELECT i, item_id, {_TERMS} AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark))
      GROUP BY ALL),
scores AS (SELECT i, item_id, r, tf.doc_id,
    sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (r), s GROUP BY i, item_id, r, tf.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {TOP}""")
def op12_ranked_search(spark: SparkSession, path: str) -> DataFrame:
    return ranked(read(spark, path, "documents"), read(spark, path, "benchmark"))
