"""Whole texts as arrays: cutting Arrow batches, words, polynomial prefix hashes, local minima.

Everything here works on the concatenated UTF-8 bytes of a piece of a batch, so that numpy runs
over megabytes at once; borders between texts are kept apart by offsets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: A piece holds about so many bytes of text; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20
#: The white space that parts words: blank, tab, line feed, vertical tab, form feed, return.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Lower bits of a hash that give way to its place when the lowest one is looked for.
_PLACE_BITS = 26
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def spark_words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows as one column ``row`` beside computed keys: columns of the rows cannot clash with
    those of a join.  ``select("row.*")`` gives the rows back."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("row"), *[c.alias(name) for name, c in keys.items()])


def pieces(batches: Iterable[pa.RecordBatch], text: str,
           limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: none) and the offsets where each begins and the last one ends."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


@cache
def _blank_table() -> np.ndarray:
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def word_spans(data: np.ndarray, at: np.ndarray, table: np.ndarray | None = None,
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and for each text the number of words before it (and all).

    ``table`` tells which bytes belong to words (default: all but white space)."""
    inside = (_blank_table() if table is None else table)[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:], after[-1], after[:-1] = False, inside[:-1], False, inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


class _WordHashes(dict):
    """XXH64 of words; short ones are remembered, a bounded number at a time."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 64:
            if len(self) >= 1 << 17:
                self.clear()
            self[word] = found
        return found


_hashes = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, taken over its bytes one by one: no polynomial, so no words are known to collide."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), modulo 2^64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= 4 * PIECE_BYTES:
            _powers[int(base)] = known
    return known[:n]


class Prefix:
    """Polynomial prefix hashes of a sequence: the hash of any stretch in two look-ups."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(values)),
                  out=self.sums[1:])
        self.inverse = powers(_INVERSE, len(values) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self, k: int) -> np.ndarray:
        """The hash of every stretch of k members."""
        n = max(0, len(self.sums) - k)
        return (self.sums[k:k + n] - self.sums[:n]) * self.inverse[:n]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose result looks random in all bits."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """For every stretch of ``width`` values the place of its lowest one, the last among equals.

    The order is that of the upper bits and then of the place, so it depends only on what the
    stretch holds: equal stretches choose the same place in them.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(values) > 1 << _PLACE_BITS:
        step = (1 << _PLACE_BITS) - width
        return np.concatenate([lowest(values[s:s + step + width - 1], width) + s
                               for s in range(0, n, step)])
    low = np.uint64((1 << _PLACE_BITS) - 1)
    place = low - np.arange(len(values), dtype=np.uint64)
    keyed = (values & ~low) | place
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(values)] = keyed
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1:width - 1 + n])
    return (low - (least & low)).astype(np.int64)


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they overlap or touch, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.concatenate([first[1:], [True]])
    return starts[first], reach[last]
