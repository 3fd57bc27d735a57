"""BPE encoding and decoding (11): a priority queue of merge ranks over a doubly linked list of symbols.

A text is cut at the added tokens of the vocabulary, then into words by the byte-level pattern.  The bytes of a word are
a linked list; the queue holds (rank, place) of every neighbouring pair that the vocabulary merges.  The lowest rank,
leftmost first, is taken; an entry whose pair is no longer there is stale and skipped; a merge links the new symbol
to its neighbours and queues their pairs.  Decoding concatenates the vocabulary's byte strings and reads them as UTF-8,
each ill-formed part as U+FFFD; ids outside the vocabulary have no bytes.

Null and empty texts have no tokens and decode to an empty text.  Long texts are encoded stretch by stretch, cut in front
of white space, where words end whatever surrounds them; one word of n bytes costs some 150 n bytes in its task.  Repeated
rows are encoded for themselves; an empty table gives an empty table; only the two named columns are read, so others may have
any name.  ``ids`` is binary: little-endian unsigned 32-bit numbers (``token_ids`` makes arrays of them).
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import pre_tokenizers

from estatescope.llm.registry import query, read
from estatescope.llm.texts import pieces

#: The vocabulary that the registered query uses; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published pattern of byte-level words; L, N and S stand for letters, numbers and others.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{S}+|\s+(?!\S)|\s+"
#: Characters that are encoded at a time, words that are remembered, and the longest of these.
STRETCH, REMEMBERED, SHORT = 1 << 18, 1 << 18, 64
_CUT = regex.compile(r"(?<=\S)\s")


def alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary: Latin-1's own, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


def newer_characters() -> str:
    """Letters and numbers of the ``regex`` module that the encoding's own Unicode tables do not have yet."""
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    words = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    # An unknown character joins the mark before it, a letter or a number does not.
    ends = {end for _, (_, end) in words.pre_tokenize_str("".join(f"!{c}\n" for c in new))}
    return "".join(c for i, c in enumerate(new) if 3 * i + 1 not in ends)


def word_patterns(newer: str) -> Callable[[str], list[str]]:
    """The words of a text: the pattern in its ASCII form, with all characters, and without the newer ones among
    letters and numbers, each where the text needs no more."""
    def pattern(letters: str, numbers: str, others: str, space: str = r"\s", solid: str = r"\S") -> str:
        return PATTERN.replace(r"\s", space).replace(r"\S", solid).replace("{L}", letters).replace(
            "{N}", numbers).replace("{S}", others)

    ascii_only = re.compile(pattern("[A-Za-z]", "[0-9]", r"[^A-Za-z0-9 \t-\r]", r"[ \t-\r]", r"[^ \t-\r]")).findall
    plain = regex.compile(pattern(r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")).findall
    if not newer:
        return lambda text: ascii_only(text) if text.isascii() else plain(text)
    ranges: list[list[int]] = []
    for code in map(ord, newer):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    new = "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in ranges)
    careful = regex.compile(pattern(rf"[\p{{L}}--[{new}]]", rf"[\p{{N}}--[{new}]]",
                                    rf"(?:[^\s\p{{L}}\p{{N}}]|[{new}])"), regex.V1).findall
    beyond, is_new = re.compile(f"[^\0-{chr(ranges[0][0] - 1)}]").search, re.compile(f"[{new}]").search

    def words(text: str) -> list[str]:
        if text.isascii():
            return ascii_only(text)
        return careful(text) if beyond(text) and is_new(text) else plain(text)

    return words


class Vocabulary:
    """Merge ranks, byte strings and added tokens of a byte-level BPE file (JSON)."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, words = spec["model"], spec.get("pre_tokenizer") or {}
        if (model.get("type") != "BPE" or words.get("type") != "ByteLevel" or not words.get("use_regex", True)
                or words.get("add_prefix_space") or spec.get("normalizer") or model.get("dropout")
                or model.get("ignore_merges") or model.get("continuing_subword_prefix")
                or model.get("end_of_word_suffix")):
            raise ValueError("not a byte-level BPE vocabulary without normalizer, prefixes and dropout")
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that look at their neighbours are not supported")
        known, of = model["vocab"], alphabet()
        self.strings = {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
                        for t, i in [*known.items(), *((t["content"], t["id"]) for t in added)]}
        self.first = [known[c] for c, _ in sorted(of.items(), key=lambda x: x[1])]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.ranks: dict[tuple[int, int], int] = {}
        self.results = [known[a + b] for a, b in pairs]
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault((known[a], known[b]), rank)
        self.added = {t["content"]: t["id"] for t in added if t["content"]}


def merged(symbols: list[int], ranks: dict[tuple[int, int], int], results: list[int]) -> list[int]:
    """The symbols of one word after all merges.  An entry of the queue is the rank, and in its low bits the place."""
    n, known = len(symbols), ranks.get
    bits = 14 if n < 1 << 14 else 40
    queue = [r << bits | i for i, r in enumerate(map(known, zip(symbols, symbols[1:], strict=False))) if r is not None]
    heapify(queue)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        entry = heappop(queue)
        i = entry & (1 << bits) - 1
        a, j = symbols[i], after[i]
        if a < 0 or j >= n:
            continue
        rank = known((a, symbols[j]))
        if rank is None or rank != entry >> bits:
            continue  # stale: one of the two has been merged since
        a = symbols[i] = results[rank]
        symbols[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := known((a, symbols[k]))) is not None:
                heappush(queue, rank << bits | i)
        h = before[i]
        if h >= 0 and (rank := known((symbols[h], a))) is not None:
            heappush(queue, rank << bits | h)
    return [s for s in symbols if s >= 0]


class Encoder(dict):
    """Packed ids of a text.  As a mapping: of a word, remembered unless it is long.

    Two generations of words are remembered: when the younger one is full it takes the place of the older one."""

    def __init__(self, vocabulary: Vocabulary, newer: str):
        self.vocabulary, self.older = vocabulary, {}
        self.words = word_patterns(newer)
        marks = sorted(vocabulary.added, key=lambda t: (-len(t), t))
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None

    def __missing__(self, word: str) -> bytes:
        v = self.vocabulary
        found = self.older.get(word)
        if found is None:
            ids = merged([v.first[b] for b in word.encode()], v.ranks, v.results)
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= SHORT:
            self[word] = found
        return found

    def _stretches(self, text: str, start: int, end: int) -> Iterator[str]:
        while end - start > STRETCH:
            cut = _CUT.search(text, start + STRETCH, end)
            if not cut:
                break
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:end]

    def _plain(self, text: str, start: int, end: int) -> Iterator[bytes]:
        for stretch in self._stretches(text, start, end):
            yield b"".join(map(self.__getitem__, self.words(stretch)))
            if len(self) > REMEMBERED:
                self.older = dict(self)
                self.clear()

    def encode(self, text: str | None) -> bytes:
        text, out, start = text or "", [], 0
        for mark in self.marks.finditer(text) if self.marks else ():
            out += self._plain(text, start, mark.start())
            out.append(struct.pack("<I", self.vocabulary.added[mark.group()]))
            start = mark.end()
        out += self._plain(text, start, len(text))
        return b"".join(out)


def decode(ids: bytes | None, strings: dict[int, bytes]) -> str:
    numbers = np.frombuffer(ids or b"", "<u4").tolist()
    try:
        whole = b"".join(map(strings.__getitem__, numbers))
    except KeyError:
        whole = b"".join(strings.get(i, b"") for i in numbers)
    return whole.decode("utf-8", "replace")


def vocabulary_file(path: str | None) -> bytes:
    path = path or VOCABULARY
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path}: pass the path of a byte-level BPE vocabulary (JSON) as vocabulary=")
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def _vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(content)


@lru_cache(maxsize=2)
def _encoder(content: bytes, newer: str) -> Encoder:
    return Encoder(_vocabulary(content), newer)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids binary): the whole text's tokens, added tokens in the text as such."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((vocabulary_file(vocabulary), newer_characters()))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*sent.value)
        for piece in pieces(batches, "text"):
            ids = [encoder.encode(t.as_py()) for t in piece.column("text")]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return rows.mapInArrow(scan, f"doc_id {key}, ids binary")


def decoded(encodings: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of packed ids; null ids have no tokens."""
    spark = encodings.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary_file(vocabulary))
    rows = encodings.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    key = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _vocabulary(sent.value).strings
        for piece in pieces(batches, "ids"):
            texts = [decode(x.as_py(), strings) for x in piece.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return rows.mapInArrow(scan, f"doc_id {key}, ids binary, text string")


def token_ids(encodings: DataFrame, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, ids array<bigint>)."""
    rows = encodings.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    key = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "ids"):
            lists = [np.frombuffer(x.as_py() or b"", "<u4") for x in piece.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return rows.mapInArrow(scan, f"doc_id {key}, ids array<bigint>")


@query("op11_bpe")
def op11_bpe(spark: SparkSession, path: str) -> DataFrame:
    return decoded(encode(read(spark, path, "documents"))).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))
