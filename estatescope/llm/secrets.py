"""Secret scans (6): patterns, and strings that a tokenizer cannot shorten.

A vocabulary learned from prose needs few tokens for words and many for random strings.  Every
stretch of characters that keys are made of is encoded with the vocabulary; one with few characters
per token is reported as ``random``, unless it is a known digest, a UUID or a string of letters most of which
stand in words of the vocabulary.  Of a stretch that is not random as a whole (a path, a prefixed name) the
parts that are random are reported.  The known shapes (``assign``, ``access``, ``hex``) are always reported.  The operator returns
the spans themselves; the query derives counts and digests.

Null and empty texts have no spans.  Texts are scanned whole, in one pass each, repeated rows each by
themselves; an empty table gives an empty table; only the two named columns are read, so others
may have any name.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from estatescope.llm.registry import query, read
from estatescope.llm.texts import pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A random string has at most so many characters per token.
MOST_CHARS_PER_TOKEN = 2.2
#: Splits a candidate before byte pairs are merged: letters, digits, the rest.
PIECES = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"

# The shapes that are reported in any case, in the order of the digest.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a shorter run never matches in part: runs are maximal
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A key's characters, and those of them in parts of four or more.
LEAST, LEAST_LONG = 20, 16
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
                    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NUMBER = re.compile(r"[0-9_=+/-]+")
LETTERS = re.compile(r"[A-Za-z_=+/-]+[0-9]{0,4}")
#: Parts of a candidate, and the words of a part by its case changes.
PART = re.compile(r"[A-Za-z0-9]+")
WORD_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")

Span = tuple[str, int, int]


@cache
def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("keys", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def of_words(string: str, encode, most: float = MOST_CHARS_PER_TOKEN) -> bool:
    """Whether most letters stand in parts of four or more that the vocabulary knows as words."""
    parts = WORD_PART.findall(string)
    known = sum(len(w) for w in parts if len(w) >= 4 and len(w) > most * len(encode(w.lower())))
    return 2 * known > sum(map(len, parts))


def is_random(string: str, encode, most: float = MOST_CHARS_PER_TOKEN) -> bool:
    """Whether the vocabulary spends a token on ``most`` characters or fewer, and no known kind of
    string explains it."""
    if DIGEST.fullmatch(string) or NUMBER.fullmatch(string) or len(string) > most * len(encode(string)):
        return False
    return not (LETTERS.fullmatch(string) and (
        max(map(len, PART.findall(string)), default=0) < 4 or of_words(string, encode, most)))


def maximal_runs(scores: list[float]) -> list[tuple[int, int]]:
    """First and last place of the run with the highest sum, and then the same on both sides of it, in one pass.

    A new positive score is a run of its own; it takes in the run before it that began on a lower sum, and all between,
    as long as that ended on a lower sum, too.  Each run knows the nearest one before it that began lower."""
    runs: list[tuple[int, float, float, int]] = []  # first place, sum before it, sum after it, nearest that began lower
    last: list[int] = []
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        first, low = i, before
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][1] >= low:
                j = runs[j][3]
            if j < 0 or runs[j][2] >= total:
                break
            first, low = runs[j][0], runs[j][1]
            del runs[j:], last[j:]
        runs.append((first, low, total, j))
        last.append(i)
    return [(run[0], end) for run, end in zip(runs, last, strict=True)]


def random_stretches(string: str, encode, most: float = MOST_CHARS_PER_TOKEN) -> list[tuple[int, int]]:
    """Where ``string`` is random: all of it, or stretches of its parts between separators.

    A part counts what it lies below ``most`` characters per token; a stretch is the run of parts with the
    highest sum, and then the same on both sides of it.  Numbers, digests and UUIDs are not in a stretch."""
    uuids = [m.span() for m in UUID.finditer(string)]
    if not uuids and is_random(string, encode, most):
        return [(0, len(string))]
    runs: list[list[tuple[int, int, float]]] = [[]]
    uuid = 0
    for m in PART.finditer(string):
        part, (start, end) = m.group(), m.span()
        while uuid < len(uuids) and uuids[uuid][1] <= start:
            uuid += 1
        in_uuid = uuid < len(uuids) and uuids[uuid][0] <= start
        if in_uuid or NUMBER.fullmatch(part) or DIGEST.fullmatch(part):
            runs.append([])
        else:
            runs[-1].append((start, end, most * len(encode(part)) - (end - start)))
    out = []
    for run in runs:
        for i, j in maximal_runs([score for _, _, score in run]):
            start, end = run[i][0], run[j][1]
            # Short names in a row are no key: its parts alone must be long enough.
            long = sum(e - s for s, e, _ in run[i:j + 1] if e - s >= 4)
            if long >= LEAST_LONG and end - start >= LEAST and is_random(string[start:end], encode, most):
                out.append((start, end))
    return out


def known_shapes(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text)
             if m.end(2) - m.start(2) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)
              if m.end() - m.start() >= 16]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def spans_in(text: str, encode, most: float = MOST_CHARS_PER_TOKEN) -> list[Span]:
    """All spans by start and kind; what known shapes cover is cut out before random strings are looked for."""
    found = known_shapes(text)
    covered: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in found):
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    at = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while start < end:
            while at < len(covered) and covered[at][1] <= start:
                at += 1
            cut = covered[at] if at < len(covered) and covered[at][0] < end else [end, end]
            free = m if (start, cut[0]) == m.span() else CANDIDATE.fullmatch(text, start, max(start, cut[0]))
            if free:
                found += [("random", start + s, start + e) for s, e in random_stretches(free.group(), encode, most)]
            start = max(start, cut[1])
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 vocabulary: str = VOCABULARY,
                 most_chars_per_token: float = MOST_CHARS_PER_TOKEN) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): code points, end exclusive.

    ``vocabulary`` is a file of ranks on the driver; its content goes to the tasks (under 1 MB)."""
    spark = docs.sparkSession
    if not os.path.exists(vocabulary):
        raise FileNotFoundError(f"{vocabulary}: pass the path of a tiktoken vocabulary (ranks) as vocabulary=")
    with open(vocabulary, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks.value).encode_ordinary
        for piece in pieces(batches, "text"):
            found = [[{"kind": k, "start": s, "end": e}
                      for k, s, e in spans_in(t, encode, most_chars_per_token)] if t else []
                     for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(found, span_type)], ["doc_id", "spans"])

    return rows.mapInArrow(
        scan, f"doc_id {key}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined_spans(spans, kinds: list[str] | None = None):
    """kind:start:end, comma-joined, of the spans (of some kinds) in their order."""
    chosen = F.col(spans) if kinds is None else F.filter(
        spans, lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(
        ":", x["kind"], x["start"], x["end"])), ",")


def count_of(spans: str, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


@query("op6_secret_scans")
def op6_secret_scans(spark: SparkSession, path: str) -> DataFrame:
    found = find_secrets(read(spark, path, "documents"))
    base = KINDS[:3]
    return found.select(
        "doc_id", *[count_of("spans", k).alias(f"n_{k}") for k in base],
        F.sha2(joined_spans("spans", base), 256).alias("base_sha256"),
        joined_spans("spans").alias("spans"),
        count_of("spans", "random").alias("n_random"))
