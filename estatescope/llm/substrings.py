"""Substring deduplication (4): windows of words behind a count-min prefilter.

The merged sketches of all partitions overestimate how often a window occurs; only windows that may
be repeated are grouped exactly: by their anchor and by 64-bit hashes over the XXH64 hashes of all their words.  Every
word under a window that also starts elsewhere is removed; windows are judged on the input.

Null, empty and blank texts have no words and texts shorter than a window keep all.  Repeated rows are
copies, so their windows are repeated; an empty table gives an empty table; only the two named
columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from estatescope.llm import windows
from estatescope.llm.registry import query, read
from estatescope.llm.texts import Prefix, flat, lowest, merged_spans, mixed, word_hashes, word_spans

#: Words of a window, and of the stretches among which its anchor is chosen.
LENGTH, GRAM = 35, 8
#: Places of an anchor that a task compares at once: their window hashes take some 10 MB.
GROUP = 100_000


class Words:
    columns = "n_words bigint, n_removed bigint, kept_sha256 string"

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, min(gram, length)

    def runs(self, piece: pa.RecordBatch) -> windows.Runs:
        data, at = flat(piece.column("text"))
        _, _, counts = word_spans(data, at)
        words = [w for t in piece.column("text").to_pylist() if t for w in t.encode().split()]
        joined = Prefix(mixed(word_hashes(words)))
        grams = mixed(joined.grams(self.gram))
        places = lowest(grams, self.length - self.gram + 1)
        text = np.searchsorted(counts, np.arange(len(places)), "right") - 1
        valid = np.arange(len(places)) + self.length <= counts[text + 1]
        found = windows.runs_of(places, valid, counts, grams)
        self._windows, self._origin, self._found = mixed(joined.grams(self.length), 7), counts, found
        return found

    def payload(self, some: np.ndarray) -> list[bytes]:
        """The hashes of the windows of each chosen run of the last piece."""
        origin = self._origin[self._found.row[some]]
        first, last = origin + self._found.first[some], origin + self._found.last[some] + 1
        return [self._windows[s:e].tobytes() for s, e in zip(first, last, strict=True)]

    def found(self, anchor, place, first, last, payload):
        """Per run at most one span: its windows overlap, so those between two repeated ones are covered."""
        sizes = last - first + 1
        run = np.repeat(np.arange(len(first)), sizes)
        window = np.frombuffer(b"".join(payload), np.uint64)
        number = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        group = np.cumsum(np.concatenate([[False], anchor[1:] != anchor[:-1]]))[run] if len(run) else run
        order = np.lexsort((window, group))
        same = (window[order][1:] == window[order][:-1]) & (group[order][1:] == group[order][:-1])
        twice = np.zeros(len(run), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        which = np.unique(run[twice])
        low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), -1)
        np.minimum.at(low, run[twice], number[twice])
        np.maximum.at(high, run[twice], number[twice])
        return which, first[which] + low[which], first[which] + high[which] + self.length

    def digests(self, anchor: int, windows: int, payload: bytes) -> list[bytes]:
        front = anchor.to_bytes(8, "little", signed=True)
        return [front + payload[i:i + 8] for i in range(0, 8 * windows, 8)]

    def cut(self, text: str | None, starts: np.ndarray, ends: np.ndarray) -> dict:
        words = (text or "").encode().split()
        starts, ends = merged_spans(starts, ends)
        kept, at = [], 0
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            kept += words[at:s]
            at = e
        kept = b" ".join(kept + words[at:])
        return {"n_words": len(words), "n_removed": int((ends - starts).sum()),
                "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode()}


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP,
                   **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, with ``with_text=True`` also kept)."""
    return windows.cut_repeats(docs, Words(length, gram), group=group, **options)


@query("op4_substring_dedup", f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_extract_all(
    coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (
  SELECT r, i, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM d WHERE len(w) >= {LENGTH})),
twice AS (SELECT r, i FROM starts QUALIFY count(*) OVER (PARTITION BY g) > 1),
covered AS (SELECT DISTINCT r, unnest(range(i, i + {LENGTH})) AS j FROM twice),
gone AS (SELECT r, list(j) AS js FROM covered GROUP BY r),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d SEMI JOIN gone USING (r)),
rest AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS kept FROM words ANTI JOIN covered USING (r, j) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(js), 0) AS n_removed,
  sha256(CASE WHEN js IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN rest USING (r)""")
def op4_substring_dedup(spark: SparkSession, path: str) -> DataFrame:
    return remove_repeats(read(spark, path, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")
