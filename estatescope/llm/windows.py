"""Removing what stands under repeated windows, for windows of words or of bytes.

1. Every window has an anchor, the lowest hash of the short stretches in it.  Each partition sketches
   its anchors (``sketch``); the merged sketch goes to the tasks.
2. A second pass sends on only the anchors that can be repeated, each with what its own unit needs to
   tell the windows around it apart.  Texts without such an anchor are finished here.
3. Anchors that are equal meet in a task, whole groups at a time, and the unit finds the windows that
   occur twice.  The windows of an anchor with more than ``GROUP`` places are counted one by one instead,
   by sums that combine before the shuffle, so no group outgrows a task.
4. The spans come back to the texts that sent anchors, and the unit cuts them out.

A result depends on the text and on the corpus, so spans are kept per text (``text_key``, a 128-bit
hash of it) and copies share them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from estatescope.llm import sketch
from estatescope.llm.texts import pieces
from estatescope.workspace import stored, work_folder

#: Anchors with more places than this are counted window by window.
GROUP = 20_000
#: About so many bytes of payload are compared at a time.
BATCH_BYTES = 8 << 20


class Runs(NamedTuple):
    """Anchors of a piece: its row, the anchor's hash, its place in the text, and the first and last of
    the windows that chose it; ``origin`` is where the row's text begins in the units of the piece."""

    row: np.ndarray
    anchor: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray


class Unit(Protocol):
    length: int
    columns: str

    def runs(self, piece: pa.RecordBatch) -> Runs: ...
    def payload(self, some: np.ndarray) -> list[bytes]: ...
    def found(self, anchor: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray,
              payload: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]: ...
    def digests(self, anchor: int, windows: int, payload: bytes) -> list[bytes]: ...
    def cut(self, text: str | None, starts: np.ndarray, ends: np.ndarray) -> dict: ...


def runs_of(places: np.ndarray, valid: np.ndarray, bounds: np.ndarray, hashes: np.ndarray) -> Runs:
    """Neighbouring windows with one place joined.  ``bounds``: where each text begins, and the end."""
    windows = np.flatnonzero(valid)
    chosen = places[windows]
    new = np.ones(len(windows), bool)
    new[1:] = chosen[1:] != chosen[:-1]
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(windows)]])[:len(begin)] - 1
    first, last, place = windows[begin], windows[end], chosen[begin]
    row = np.searchsorted(bounds, place, "right") - 1
    origin = bounds[row]
    return Runs(row, hashes[place], place - origin, first - origin, last - origin)


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole anchors, about BATCH_BYTES at a time, of an input sorted by anchor."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            held.append(part)
            size += part.get_total_buffer_size() if part.num_rows == batch.num_rows else part.nbytes
            if size >= BATCH_BYTES:
                table = pa.Table.from_batches(held)
                anchor = table.column("anchor").to_numpy()
                border = int(np.searchsorted(anchor, anchor[-1]))
                if border:
                    yield table.slice(0, border)
                rest = table.slice(border)
                held, size = rest.to_batches(), rest.nbytes
    if held:
        yield pa.Table.from_batches(held)


_MARK = "text_key binary, anchor bigint, place bigint, first bigint, last bigint, payload binary"
_SPAN = "text_key binary, start bigint, end bigint"


def cut_repeats(docs: DataFrame, unit: Unit, doc_id: str = "doc_id", text: str = "text",
                bits: int = sketch.BITS, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """(doc_id, the unit's columns): each text without what stands under a repeated window.

    ``with_text`` adds the kept text itself as ``kept``."""
    spark = docs.sparkSession
    folder = work_folder(spark, "windows")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = sketch.Gathered(bits)
        for piece in pieces(batches, "text"):
            gathered.add(unit.runs(piece).anchor)
        yield from gathered.pages()

    sent = spark.sparkContext.broadcast(
        sketch.merged(rows.select("text").mapInArrow(sketched, sketch.PAGES), bits))

    result = unit.columns + (", kept string" if with_text else "")
    names = [c.split()[0] for c in result.split(", ")]

    def results(column: list[str | None], spans: list) -> list[pa.Array]:
        found = [unit.cut(t, s, e) for t, (s, e) in zip(column, spans, strict=True)]
        types = {"bigint": pa.int64(), "string": pa.string()}
        return [pa.array([f[n] for f in found], types[c.split()[1]])
                for n, c in zip(names, result.split(", "), strict=True)]

    none = np.zeros(0, np.int64)

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            runs = unit.runs(piece)
            some = np.flatnonzero(sketch.repeated(sent.value, runs.anchor, bits))
            texts = piece.column("text").to_pylist()
            keys = pa.array([xxhash.xxh3_128_digest(t or "") for t in texts], pa.binary())
            open_rows = np.zeros(piece.num_rows, bool)
            open_rows[runs.row[some]] = True
            n, m = piece.num_rows, len(some)
            at = pa.array(runs.row[some])
            done = results([None if o else t for t, o in zip(texts, open_rows, strict=True)], [(none, none)] * n)
            done = [pa.concat_arrays([x, pa.nulls(m, x.type)]) for x in done]
            numbers = [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x[some].astype(np.int64) if x.dtype
                       != np.uint64 else x[some].view(np.int64))]) for x in runs[1:]]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.where(open_rows, "open", "done"), np.full(m, "mark")]), pa.string()),
                pa.concat_arrays([piece.column("doc_id"), pa.nulls(m, piece.column("doc_id").type)]),
                pa.concat_arrays([pa.array([t if o else None for t, o in zip(texts, open_rows, strict=True)],
                                           pa.string()), pa.nulls(m, pa.string())]),
                *done, pa.concat_arrays([keys, keys.take(at)]), *numbers,
                pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(unit.payload(some), pa.binary())])],
                ["kind", "doc_id", "text", *names, "text_key", "anchor", "place", "first", "last", "payload"])

    scanned = stored(rows.mapInArrow(
        marked, f"kind string, doc_id {id_type}, text string, {result}, {_MARK}"), f"{folder}/scanned", "kind")
    marks = scanned.where("kind = 'mark'").select(*[c.split()[0] for c in _MARK.split(", ")])
    crowded = stored(marks.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > group)
                     .select("anchor"), f"{folder}/crowded")
    spans = _compared(marks.join(crowded, "anchor", "left_anti"), unit)
    if not crowded.isEmpty():
        spans = spans.union(_counted(marks.join(crowded, "anchor", "left_semi"), unit, folder))
    per_text = spans.groupBy("text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            found = [(np.array([x["start"] for x in s or []], np.int64), np.array([x["end"] for x in s or []], np.int64))
                     for s in piece.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *results(piece.column("text").to_pylist(), found)], ["doc_id", *names])

    opened = scanned.where("kind = 'open'").select("doc_id", "text", "text_key") \
        .join(per_text, "text_key", "left").select("doc_id", "text", "spans")
    return scanned.where("kind = 'done'").select("doc_id", *names).union(
        opened.mapInArrow(finished, f"doc_id {id_type}, {result}"))


def _compared(marks: DataFrame, unit: Unit) -> DataFrame:
    """Spans of the windows that occur twice, from groups of equal anchors."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            table = table.combine_chunks()
            anchor, place, first, last = (table.column(c).to_numpy() for c in ("anchor", "place", "first", "last"))
            which, start, end = unit.found(anchor, place, first, last, table.column("payload").to_pylist())
            keys = table.column("text_key").combine_chunks().take(pa.array(which))
            yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(end)], ["text_key", "start", "end"])

    return marks.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, _SPAN)


def _counted(marks: DataFrame, unit: Unit, folder: str) -> DataFrame:
    """The same for crowded anchors: every window is a row and is counted under its hash.

    Places with the same payload are one class, summed up first: inside a passage that very many texts
    share all places are alike, only at its borders they differ."""
    kind = F.unhex(F.md5(F.concat("payload", F.encode(F.concat_ws(
        ":", "anchor", F.col("place") - F.col("first"), F.col("last") - F.col("first")), "utf-8"))))
    rows = marks.withColumn("class", kind)
    classes = rows.groupBy("class").agg(
        F.count("*").alias("copies"), F.first("anchor").alias("anchor"), F.first("payload").alias("payload"),
        F.first(F.col("last") - F.col("first")).alias("steps"))

    def single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [unit.digests(a, n + 1, p) for a, n, p in zip(*[
                    part.column(c).to_pylist() for c in ("anchor", "steps", "payload")], strict=True)]
                row = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for x in found for d in x], pa.binary()),
                     *[part.column(c).take(row) for c in ("class", "copies")],
                     pa.array([i for x in found for i in range(len(x))], pa.int32())],
                    ["window", "class", "copies", "number"])

    windows = stored(classes.select("class", "copies", "anchor", "payload", "steps").mapInArrow(
        single, "window binary, class binary, copies bigint, number int"), f"{folder}/single")
    twice = stored(windows.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").drop("n"),
                   f"{folder}/twice")
    hits = stored(windows.join(twice, "window", "left_semi").groupBy("class").agg(
        F.min("number").alias("low"), F.max("number").alias("high")), f"{folder}/hits")
    # The windows of a class overlap, so its repeated ones are one span.
    return rows.select("text_key", "first", "class").join(hits, "class").select(
        "text_key", (F.col("first") + F.col("low")).alias("start"),
        (F.col("first") + F.col("high") + unit.length).alias("end"))
