"""Benchmark decontamination (2) by winnowing.

Every text is fingerprinted by the lowest hash of its k-grams of words in each sliding window, so
that two texts that share a span of ``length`` words or more always share a fingerprint inside it.
Fingerprints of documents and benchmark items are joined and each hit is extended word by word to
both sides; a run of ``length`` equal words or more is contamination.  Items of fewer words than
``length`` are one span of their own length and are fingerprinted with windows to suit it.

Words: lower case for A-Z, of digits, letters and everything beyond ASCII.  A fingerprint brings the
words around it along (as many as a span can reach), so no text is shuffled.  The benchmark also
sets bits in a filter of fixed size that is sent to the tasks: most document fingerprints are found
there to match nothing and are never shuffled; as the benchmark grows more pass it, and the join decides.

Null texts and texts without words have no words, no hits and are clean; an item without words is
never found.  Results depend on the text alone, so repeated rows get equal rows; an empty table gives
an empty table or no hits; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from estatescope.llm.registry import query, read
from estatescope.llm.simhash import tie_of
from estatescope.llm.texts import Prefix, flat, lowest, mixed, packed, pieces, word_spans
from estatescope.workspace import stored, work_folder

#: A span of so many words is contamination; the k-grams that are hashed have at most GRAM words.
LENGTH, GRAM = 10, 4
#: Bits of the filter that the benchmark fills: 2^26 bits are 8 MB, however large the benchmark is.
FILTER_BITS = 26
_PAGE = 1 << 15


def _word_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    table[0x80:] = True
    return table


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return data + 32 * ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8)


def _fingerprints(grams: np.ndarray, counts: np.ndarray, length: int, k: int
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Text and word number of each chosen k-gram.  ``grams`` of all word positions, ``counts`` words
    before each text."""
    width = length - k + 1
    places = lowest(grams, width)
    text = np.searchsorted(counts, np.arange(len(places)), "right") - 1
    whole = np.arange(len(places)) + length <= counts[text + 1]
    places = np.unique(places[whole])
    return np.searchsorted(counts, places, "right") - 1, places


def _scan(piece: pa.RecordBatch, lengths: list[int], accept, only_own_length: bool):
    """Chosen k-grams of the texts of a piece: (row, length, hash, position, words before, gram, words
    after), the words joined by blanks, and the number of words of each row."""
    data, at = flat(piece.column("text"))
    data = lowered(data)
    starts, ends, counts = word_spans(data, at, _word_table())
    n_words = np.diff(counts)
    rows = []
    if not len(starts):
        return n_words, rows
    word_hash = mixed(Prefix(data).of(starts, ends))
    raw, joined = data.tobytes(), Prefix(word_hash)
    for length in lengths:
        k = min(GRAM, length)
        if len(starts) < length:
            continue
        grams = mixed(joined.grams(k), length)
        text, place = _fingerprints(grams, counts, length, k)
        good = accept(grams[place])
        if only_own_length:
            good &= np.minimum(n_words[text], LENGTH) == length
        around = length - k
        for t, p in zip(text[good], place[good], strict=True):
            low, high = max(counts[t], p - around), min(counts[t + 1], p + k + around)
            words = [raw[s:e] for s, e in zip(starts[low:high], ends[low:high], strict=True)]
            cut = p - low
            rows.append((t, length, int(grams[p].astype(np.int64)), int(p - counts[t]),
                         b" ".join(words[:cut]), b" ".join(words[cut:cut + k]),
                         b" ".join(words[cut + k:])))
    return n_words, rows


_MARK = "length int, hash bigint, position int, ahead string, gram string, behind string"


def _mark_arrays(rows: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    out = [pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)]
    return out[:3] + [x.cast(pa.string()) for x in out[3:]]


_NAMES = ["length", "hash", "position", "ahead", "gram", "behind"]


def item_marks(items: DataFrame) -> DataFrame:
    """Fingerprints of the benchmark's items (item_id, text)."""
    key = items.schema["item_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            _, rows = _scan(piece, list(range(1, LENGTH + 1)), lambda h: np.ones(len(h), bool), True)
            ids = piece.column("item_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *_mark_arrays(rows)], ["item_id", *_NAMES])

    return items.mapInArrow(scan, f"item_id {key}, {_MARK}")


def _filter_of(marks: DataFrame) -> np.ndarray:
    """A bit per hash modulo 2^FILTER_BITS: at most 2^FILTER_BITS / 8 bytes, whatever the input."""
    slot = F.expr(f"hash & {(1 << FILTER_BITS) - 1}")
    pages = marks.select(slot.alias("slot")).groupBy(F.expr(f"slot div {_PAGE}").alias("page")).agg(
        F.expr(f"bitmap_construct_agg(slot % {_PAGE})").alias("bits"))
    found = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for page, bits in pages.toLocalIterator():
        found[page * _PAGE // 8:page * _PAGE // 8 + len(bits)] = np.frombuffer(bits, np.uint8)
    return found


def find_contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id",
                       text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, tie, n_words, text_key), hit spans of word numbers (text_key, start, end) and items
    found (text_key, item_id).  ``text_key`` stands for the text, so copies are searched for once; ``tie`` is a hash
    of it that Spark computes."""
    spark = docs.sparkSession
    folder = work_folder(spark, "decontamination")
    item_rows = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    marks = stored(item_marks(item_rows), f"{folder}/items")
    lengths = sorted(r.length for r in marks.select("length").distinct().collect())  # 1 to LENGTH
    bits = spark.sparkContext.broadcast(_filter_of(marks))
    doc_rows = docs.select(F.col(doc_id).alias("doc_id"), tie_of(text).alias("tie"),
                           F.col(text).cast("string").alias("text"))
    key = doc_rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value

        def accept(hashes: np.ndarray) -> np.ndarray:
            slot = (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
            return (known[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

        for piece in pieces(batches, "text"):
            n_words, rows = _scan(piece, lengths, accept, False)
            keys = pa.array([xxhash.xxh3_128_digest(t or "") for t in piece.column("text").to_pylist()])
            n, m = piece.num_rows, len(rows)
            at = pa.array([r[0] for r in rows], pa.int64())
            empty = [pa.nulls(n, x.type) for x in _mark_arrays(rows)]
            columns = [
                pa.concat_arrays([piece.column("doc_id"), pa.nulls(m, piece.column("doc_id").type)]),
                pa.concat_arrays([piece.column("tie"), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.array(n_words, pa.int64()), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([keys, keys.take(at)]).cast(pa.binary()),
                *[pa.concat_arrays([a, b]) for a, b in zip(empty, _mark_arrays(rows), strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "n_words", "text_key", *_NAMES])

    scanned = doc_rows.mapInArrow(scan, f"doc_id {key}, tie bigint, n_words bigint, text_key binary, {_MARK}")
    scanned = stored(scanned.withColumn("kind", F.when(F.col("hash").isNull(), "text").otherwise("mark")),
                     f"{folder}/documents", "kind")
    texts = scanned.where("kind = 'text'").select("doc_id", "tie", "n_words", "text_key")
    found = scanned.where("kind = 'mark'").select("text_key", *_NAMES).distinct()

    # Items that agree in a fingerprint and all words around it are one class: one comparison.
    shape = ["length", "hash", "ahead", "gram", "behind"]
    classes = marks.select(*shape, "item_id").distinct()
    hits = extended(found, classes.select(*shape).distinct())
    spans = hits.select("text_key", "start", "end").distinct()
    items_found = hits.select("text_key", *[F.col(f"item_{c}").alias(c) for c in shape]).distinct() \
        .join(classes, shape).select("text_key", "item_id").distinct()
    return texts, spans, items_found


def _agreeing(one: str, other: str, backwards: bool):
    """How many words two contexts have in common, from the fingerprint outwards."""
    array = lambda c: F.filter(F.split(F.col(c), " "), lambda w: w != "")
    a, b = (F.reverse(array(c)) if backwards else array(c) for c in (one, other))
    both = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    differing = F.array_position(both, F.lit(False))
    return F.when(differing > 0, differing - 1).otherwise(F.size(both)).cast("int")


def extended(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Hits of document fingerprints: equal words to both sides of an equal k-gram; ``start``, ``end``."""
    item = classes.select("length", "hash", *[F.col(c).alias(f"item_{c}") for c in ("ahead", "gram", "behind")])
    both = found.join(item, ["length", "hash"]).where("gram = item_gram")
    gram = F.least(F.lit(GRAM), F.col("length"))
    both = both.select("*", _agreeing("ahead", "item_ahead", True).alias("left"),
                       _agreeing("behind", "item_behind", False).alias("right"), gram.alias("k"))
    return both.where("left + k + right >= length").select(
        "text_key", (F.col("position") - F.col("left")).alias("start"),
        (F.col("position") + F.col("k") + F.col("right")).alias("end"),
        F.col("length").alias("item_length"), F.col("hash").alias("item_hash"),
        "item_ahead", "item_gram", "item_behind")


def contamination(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """Per document: n_words, n_hit (words inside a shared span), items (ids as sorted strings)."""
    texts, spans, items_found = find_contamination(docs, items, **columns)
    # Covered words without lists: what a span adds beyond the furthest end before it.
    before = F.max("end").over(_running("text_key", "start", "end"))
    hit = spans.select("text_key", (F.col("end") - F.greatest(
        F.col("start"), F.least(F.col("end"), F.coalesce(before, F.lit(0))))).alias("new")) \
        .groupBy("text_key").agg(F.sum("new").cast("long").alias("n_hit"))
    named = items_found.groupBy("text_key").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    # Stored, so that the join below is a plain one, whose hot texts can be split.
    per_text = stored(hit.join(named, "text_key"), work_folder(docs.sparkSession, "hits"))
    return texts.join(per_text, "text_key", "left").select(
        "doc_id", "tie", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
          **columns: str) -> DataFrame:
    """The rows of ``docs`` that share no span with an item."""
    dirty = contamination(docs, items, doc_id=doc_id, text=text, **columns).where("n_hit > 0") \
        .select("doc_id", "tie").distinct()
    dirty = stored(dirty, work_folder(docs.sparkSession, "contaminated"))
    own = packed(docs, id=F.col(doc_id), tie=tie_of(text))
    same = own["id"].eqNullSafe(dirty["doc_id"]) & (own["tie"] == dirty["tie"])
    return own.join(dirty, same, "left_anti").select("row.*")


def _running(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


_WORDS = ("list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')")


@query("op2_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
b2 AS (SELECT item_id, w, least(len(w), {LENGTH}) AS n FROM b WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b2)),
doc_windows AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d CROSS JOIN (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM doc_windows JOIN item_windows USING (n, g)),
covered AS (SELECT r, count(DISTINCT j) AS n_hit
            FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)""")
def op2_decontamination(spark: SparkSession, path: str) -> DataFrame:
    found = contamination(read(spark, path, "documents"), read(spark, path, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
