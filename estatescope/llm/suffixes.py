"""Suffix-array deduplication (8): strings of bytes that occur twice, from sorted suffixes.

Where two texts share a string of ``LENGTH`` bytes, both have in it the same anchor (``windows``).  The
places of one anchor are put into two suffix orders: by what follows the anchor and, read backwards, by
what stands before it.  Suffixes are compared by prefix polynomial hashes: a binary search finds how far two of them agree, the byte
after that decides, and a merge sort needs a logarithmic number of such steps.  The
agreement of neighbours in the finished order is then verified byte by byte (a collision leads to
a sort by the bytes themselves).  Neighbours in both orders tell for every window whether another place
has the same bytes before and after the anchor.

Null and empty texts have no bytes and texts shorter than a window keep all.  Repeated rows are copies, so
their windows are repeated; an empty table gives an empty table; matches never cross texts; only
the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from estatescope.llm import windows
from estatescope.llm.registry import query, read
from estatescope.llm.texts import Prefix, flat, lowest, merged_spans, mixed

#: Bytes of a window, and of the stretches among which its anchor is chosen.
LENGTH, GRAM = 200, 32


class Suffixes:
    """Suffixes of a buffer: each begins at a place and goes on to its own end."""

    def __init__(self, data: np.ndarray, at: np.ndarray, end: np.ndarray):
        self.data, self.at, self.size, self.hash = data, at, end - at, Prefix(data)

    def agreement(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many bytes suffixes i and k have in common: binary search over equal hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[k])
        a, b = self.at[i], self.at[k]
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            equal = self.hash.of(a, a + middle) == self.hash.of(b, b + middle)
            low = np.where(open_ & equal, middle, low)
            high = np.where(open_ & ~equal, middle - 1, high)
        return low

    def before(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix k; equal ones keep the order of their numbers."""
        same = self.agreement(i, k)
        i_ends, k_ends = same >= self.size[i], same >= self.size[k]
        last = len(self.data) - 1
        x = self.data[np.minimum(self.at[i] + same, last)]
        y = self.data[np.minimum(self.at[k] + same, last)]
        return np.where(i_ends | k_ends, np.where(i_ends & k_ends, i < k, i_ends), x < y)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """The suffixes in order within each group; members of a group stand together.

        A merge sort of all groups at once: in each round every suffix finds by binary search how many
        members of the run beside its own go before it."""
        n = len(group)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, int)
        ends = np.concatenate([starts[1:], [n]])
        of = np.repeat(np.arange(len(starts)), ends - starts)
        start, end, order, width = starts[of], ends[of], np.arange(n), 1
        while width < (ends - starts).max(initial=0):
            place = np.arange(n) - start
            run = place // width
            low = np.minimum(start + (run ^ 1) * width, end)
            beside_start, beside_end = low, np.minimum(low + width, end)
            low, high = beside_start.copy(), beside_end.copy()
            active = np.flatnonzero(low < high)
            while len(active):
                middle = (low[active] + high[active]) // 2
                first = self.before(order[middle], order[active])
                low[active[first]] = middle[first] + 1
                high[active[~first]] = middle[~first]
                active = active[low[active] < high[active]]
            target = start + (run // 2) * 2 * width + place % width + (low - beside_start)
            merged = np.empty_like(order)
            merged[target] = order
            order, width = merged, width * 2
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order and how far each suffix agrees with the one before it (-1: none in its group)."""
        agree = np.full(len(order), -1)
        pairs = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1 if len(order) else order
        agree[pairs] = self.agreement(order[pairs - 1], order[pairs])
        if not self._verified(order[pairs - 1], order[pairs], agree[pairs]):
            raw = [self.data[a:a + s].tobytes() for a, s in zip(self.at, self.size, strict=True)]
            order = np.array(sorted(range(len(order)), key=lambda x: (group[x], raw[x], x)), int)
            for p in pairs:
                x, y = raw[order[p - 1]], raw[order[p]]
                m = min(len(x), len(y))
                agree[p] = next((c for c in range(m) if x[c] != y[c]), m)
        return order, agree

    def _verified(self, i: np.ndarray, k: np.ndarray, sizes: np.ndarray) -> bool:
        """Whether the bytes of all claimed agreements are equal."""
        for s in range(0, len(i), 4096):
            size = sizes[s:s + 4096]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            a, b = (np.repeat(self.at[x[s:s + 4096]], size) + step for x in (i, k))
            if not np.array_equal(self.data[a], self.data[b]):
                return False
        return True


class Bytes:
    columns = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, min(gram, length)

    def runs(self, piece: pa.RecordBatch) -> windows.Runs:
        data, at = flat(piece.column("text"))
        grams = mixed(Prefix(data).grams(self.gram))
        places = lowest(grams, self.length - self.gram + 1)
        valid = np.zeros(len(places), bool)
        for s, e in zip(at[:-1], at[1:], strict=True):
            valid[s:max(s, e - self.length + 1)] = True
        found = windows.runs_of(places, valid, at, grams)
        self._data, self._origin, self._found = data, at, found
        return found

    def payload(self, some: np.ndarray) -> list[bytes]:
        """The bytes under the windows of each chosen run of the last piece."""
        origin = self._origin[self._found.row[some]]
        first, last = origin + self._found.first[some], origin + self._found.last[some] + self.length
        return [self._data[s:e].tobytes() for s, e in zip(first, last, strict=True)]

    def found(self, anchor, place, first, last, payload):
        """Per run at most one span, from the first to the last of its repeated windows."""
        known: dict[tuple, int] = {}
        equal = np.fromiter((known.setdefault(key, i) for i, key in enumerate(zip(
            anchor.tolist(), (place - first).tolist(), payload, strict=True))), np.int64, len(payload))
        copies = np.bincount(equal, minlength=len(payload))
        low = np.where(copies[equal] > 1, 0, np.iinfo(np.int64).max)
        high = np.where(copies[equal] > 1, last - first, -1)

        # One of each kind goes on, if others with its anchor do.
        single = np.flatnonzero(copies > 0)
        alone = np.ones(len(single), bool)
        same = anchor[single][1:] == anchor[single][:-1]
        alone[1:][same], alone[:-1][same] = False, False
        single = single[~alone]
        if len(single):
            nearest, furthest = self._repeated(anchor[single], (place - first)[single], (last - first)[single],
                                               [payload[i] for i in single])
            hit = furthest >= nearest
            offset = (place - first)[single][hit]
            low[single[hit]] = np.minimum(low[single[hit]], offset - furthest[hit])
            high[single[hit]] = np.maximum(high[single[hit]], offset - nearest[hit])
        which = np.flatnonzero(high >= 0)
        return which, first[which] + low[which], first[which] + high[which] + self.length

    def _repeated(self, anchor, offset, steps, payload):
        """For each run the least and the greatest number of bytes before the anchor with which a window
        is repeated in another run (greatest < least: none is)."""
        n = len(anchor)
        sizes = np.fromiter(map(len, payload), np.int64, n)
        data = np.frombuffer(b"".join(payload), np.uint8)
        start = np.cumsum(sizes) - sizes
        group = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
        ahead = Suffixes(data, start + offset, start + sizes)
        behind = Suffixes(data[::-1], len(data) - start - offset, len(data) - start)
        right, right_agree = ahead.neighbours(ahead.sort(group), group)
        left, left_agree = behind.neighbours(behind.sort(group), group)
        least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        left_class = np.empty(n, np.int64)
        for before in range(int((offset - steps).min()), int(offset.max()) + 1):
            # In the order of what follows: runs of suffixes that agree in the window's rest.
            rest = np.cumsum(right_agree < self.length - before)
            usable = (offset[right] - steps[right] <= before) & (before <= offset[right])
            some, rest = right[usable], rest[usable]
            beside = np.zeros(len(some), bool)
            equal = rest[1:] == rest[:-1]
            beside[1:][equal], beside[:-1][equal] = True, True
            some, rest = some[beside], rest[beside]
            if not len(some):
                continue
            left_class[left] = np.cumsum(left_agree < before)
            key = rest * (n + 1) + left_class[some]
            order = np.argsort(key, kind="stable")
            equal = key[order][1:] == key[order][:-1]
            hit = np.zeros(len(some), bool)
            hit[order[1:][equal]] = hit[order[:-1][equal]] = True
            least[some[hit]] = np.minimum(least[some[hit]], before)
            most[some[hit]] = before
        return least, most

    def digests(self, anchor: int, windows: int, payload: bytes) -> list[bytes]:
        return [xxhash.xxh3_128_digest(payload[i:i + self.length]) for i in range(windows)]

    def cut(self, text: str | None, starts: np.ndarray, ends: np.ndarray) -> dict:
        data = (text or "").encode()
        starts, ends = merged_spans(starts, ends)
        kept, at = [], 0
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            kept.append(data[at:s])
            at = e
        kept = b"".join([*kept, data[at:]])
        return {"n_bytes": len(data), "n_removed": int((ends - starts).sum()), "n_spans": len(starts),
                "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode(errors="ignore")}


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, with ``with_text=True`` also kept)."""
    return windows.cut_repeats(docs, Bytes(length, gram), **options)


@query("op8_suffix_array_dedup")
def op8_suffix_array_dedup(spark: SparkSession, path: str) -> DataFrame:
    return remove_repeats(read(spark, path, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
