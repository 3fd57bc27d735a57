"""Vector code compression (13): product codes whose codebooks are fitted by ball k-means in integers.

A vector is cut into equal parts, each part position has a codebook of at most 256 entries.  An entry's ball holds the parts
assigned to it in the round before; its radius is the distance of the farthest one.  In a task, for all the vectors that it
holds at once:

- entries whose distance is at most twice an entry's radius are its neighbours; no other entry can win one of its parts;
- a part nearer to its entry than half the way to the nearest neighbour is in the stable core and keeps its entry;
- the others lie in rings between half distances to the neighbours, in order: a part in the kth ring is compared with the
  first k neighbours only.

All distances are whole numbers, so these bounds are exact, ties included: an entry at just twice the distance is compared, and
the lowest index among equals wins.  Sums and counts of the parts are added up by Spark; what a round leaves behind are at
most 256 entries per position.  The assignments are a written table that the next round reads and that is then deleted.

Null vectors and vectors with null or non-finite components are dropped.  Components are held to +-2^25 after scaling, so that
distances stay within 64 bits.  The number of components is that of the vector with the least id; vectors of another length are
dropped, too, and a length that the parts do not divide is filled up with zeros.  Repeated rows are vectors of their own; ids
may repeat (equal ids are ordered by their vectors) or be null (last).  Fewer vectors than entries: fewer entries.  An empty table
gives an empty table.  Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from estatescope.llm.registry import query, read
from estatescope.workspace import removed, stored, work_folder

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that a task compares at once, and the greatest scaled component.
CHUNK, LARGEST = 1 << 14, 1 << 25


class Books(NamedTuple):
    """Codebooks of all positions (position, entry, component) and the squared distances between entries."""

    entries: np.ndarray
    between: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Books:
        between = np.stack([squared(book, book) for book in entries]) if len(entries) else np.zeros((0, 0, 0), np.int64)
        return cls(entries, between)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(parts, entries) squared distances, exact: by a product of doubles where those hold all sums."""
    high = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * high * high * parts.shape[1] < 1 << 53:
        a, b = parts.astype(np.float64), entries.astype(np.float64)
        out = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
        return out.astype(np.int64)
    out = np.zeros((len(parts), len(entries)), np.int64)
    for x, y in zip(parts.T, entries.T, strict=True):
        out += (x[:, None] - y) ** 2
    return out


def to_own(parts: np.ndarray, entries: np.ndarray, own: np.ndarray) -> np.ndarray:
    return ((parts - entries[own]) ** 2).sum(axis=1)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part, from all entries: the first assignment."""
    chosen, best = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), 4096):
        distance = squared(parts[at:at + 4096], entries)
        chosen[at:at + 4096] = distance.argmin(axis=1)  # the lowest index among equals
        best[at:at + 4096] = distance[np.arange(len(distance)), chosen[at:at + 4096]]
    return chosen, best


def ball_step(parts: np.ndarray, entries: np.ndarray, between: np.ndarray,
              own: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """The next entry and squared distance of parts that belong to entry ``own``, and what it took to find them."""
    distance = to_own(parts, entries, own)
    chosen, best = own.copy(), distance.copy()
    counts = {"parts": len(parts), "stable": 0, "compared": 0}
    order = np.argsort(own, kind="stable")
    balls, begin = np.unique(own[order], return_index=True)
    for ball, members in zip(balls.tolist(), np.split(order, begin[1:]), strict=True):
        away = between[ball].copy()
        away[ball] = np.iinfo(np.int64).max
        radius = int(distance[members].max())
        neighbours = np.flatnonzero(away <= 4 * radius)
        if not len(neighbours):
            counts["stable"] += len(members)
            continue
        neighbours = neighbours[np.argsort(away[neighbours], kind="stable")]
        # The ring of a part: how many neighbours are at most at twice its distance.
        ring = np.searchsorted(away[neighbours], 4 * distance[members], "right")
        counts["stable"] += int((ring == 0).sum())
        outer = np.argsort(ring, kind="stable")
        members, ring = members[outer], ring[outer]
        # Rings of 1, 2, 3-4, 5-8, ... neighbours are compared together, each with its last one's candidates.
        limit, start = 1, int(np.searchsorted(ring, 0, "right"))
        while start < len(members):
            end = int(np.searchsorted(ring, limit, "right"))
            if end > start:
                some, near = members[start:end], neighbours[:int(ring[end - 1])]
                counts["compared"] += len(some) * len(near)
                found = squared(parts[some], entries[near])
                least = found.min(axis=1)
                index = np.where(found == least[:, None], near, ENTRIES).min(axis=1)
                better = (least < best[some]) | ((least == best[some]) & (index < chosen[some]))
                chosen[some[better]], best[some[better]] = index[better], least[better]
            start, limit = end, 2 * limit
    return chosen, best, counts


# Tables: vec_id, label, parts (scaled components, int32 little-endian), own (one byte per position)

def _vectors(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """Usable vectors with scaled components."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda c: F.greatest(F.lit(-LARGEST), F.least(
        F.lit(LARGEST), F.floor(c.cast("double") * SCALE))).cast("int"))
    return df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
                     F.when(x.isNotNull() & finite, scaled).alias("x")).where("x IS NOT NULL")


def _parts(column: pa.Array, positions: int, width: int) -> np.ndarray:
    """(vectors, positions, components) of an array column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = flat.reshape(len(column), flat.size // max(1, len(column)))
    if flat.shape[1] < positions * width:
        flat = np.pad(flat, ((0, 0), (0, positions * width - flat.shape[1])))
    return flat.reshape(len(flat), positions, width)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _assigned(vectors: DataFrame, sent, first: bool) -> DataFrame:
    """The vectors with their entries (``own``) and the error under the codebooks that are sent."""
    fields = [f for f in vectors.schema if f.name not in ("own", "error")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", own binary, error bigint"

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        positions, _, width = books.entries.shape
        for batch in _chunks(batches):
            parts = _parts(batch.column("x"), positions, width)
            own = np.zeros((len(parts), positions), np.uint8)
            if not first:
                own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(-1, positions)
            now, error = np.zeros_like(own), np.zeros(len(parts), np.int64)
            for p in range(positions):
                x, entries = np.ascontiguousarray(parts[:, p]), books.entries[p]
                if first:
                    chosen, best = nearest(x, entries)
                else:
                    chosen, best, _ = ball_step(x, entries, books.between[p], own[:, p].astype(np.int64))
                now[:, p] = chosen
                error += best
            codes = pa.array([row.tobytes() for row in now], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in fields], codes, pa.array(error)], [*[f.name for f in fields], "own", "error"])

    return vectors.mapInArrow(assign, schema)


def _moved(assigned: DataFrame, books: Books) -> Books:
    """Entries as the floored means of their parts; unused ones stay."""
    positions, entries, width = books.entries.shape
    if not width:
        return books

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((positions * entries, width), np.int64)
        counts = np.zeros(positions * entries, np.int64)
        for batch in _chunks(batches):
            parts = _parts(batch.column("x"), positions, width)
            own = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint8).reshape(-1, positions)
            slot = own + np.arange(positions) * entries
            counts += np.bincount(slot.ravel(), minlength=len(counts))
            for p in range(positions):
                order = np.argsort(slot[:, p], kind="stable")
                used, at = np.unique(slot[order, p], return_index=True)
                sums[used] += np.add.reduceat(parts[order, p], at, axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))],
            ["slot", "n", "sums"])

    partial = assigned.select("x", "own").mapInArrow(add, "slot bigint, n bigint, sums array<bigint>")
    wide = F.col("sums").cast("array<decimal(38,0)>")
    rows = partial.withColumn("sums", wide).groupBy("slot").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect()
    moved = books.entries.reshape(-1, width).copy()  # the rows collected are at most positions x entries
    for row in rows:
        moved[row["slot"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return Books.of(moved.reshape(books.entries.shape))


def compressed(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
               positions: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """(vec_id, label, x, own, error) of every usable vector, ``own`` one byte per position, and the final codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code of one byte has 1 to 256 entries")
    spark = df.sparkSession
    folder = work_folder(spark, "vector-codes")
    now = stored(_vectors(df, vec_id, vector, label), f"{folder}/vectors")
    seeds = now.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(1).collect()
    if not seeds:
        return now.select("*", F.lit(b"").alias("own"), F.lit(0).cast("long").alias("error")), \
            Books.of(np.zeros((positions, 0, 0), np.int64))
    length = len(seeds[0]["x"])
    now = now.where(F.size("x") == length)
    seeds = now.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    width = -(-length // positions)
    first = np.zeros((len(seeds), positions * width), np.int64)
    first[:, :length] = [s["x"] for s in seeds]
    books = Books.of(np.ascontiguousarray(first.reshape(len(seeds), positions, width).transpose(1, 0, 2)))
    for turn in range(rounds + 1):
        now = stored(_assigned(now, spark.sparkContext.broadcast(books), turn == 0), f"{folder}/{turn}")
        removed(spark, f"{folder}/{turn - 1}" if turn else f"{folder}/vectors")
        if turn < rounds:
            books = _moved(now, books)
    return now, books


def with_label_error(codes: DataFrame) -> DataFrame:
    """The errors of equal labels (nulls together) added up, as ``label_error`` beside every row."""
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, codes["label"].eqNullSafe(sums["_label"])).drop("_label")


@query("op13_vector_codes")
def op13_vector_codes(spark: SparkSession, path: str) -> DataFrame:
    codes, books = compressed(read(spark, path, "embeddings"))
    return with_label_error(codes).select(
        "vec_id", F.lower(F.hex("own")).alias("code"), "error", "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"))
