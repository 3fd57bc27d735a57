"""Count-min sketches of anchors, merged from the sketches of all partitions.

An anchor is the place in a window that its content chooses (the lowest hash of a short stretch in
it).  Equal windows have equal anchors, so the number of places with an anchor's hash is at least
the number of places where the window starts: estimates of anchors overestimate windows, and neighbouring
windows share one anchor, which makes the sketch a fraction of what single windows would need.

A cell only tells none, one or more; ``DEPTH`` rows of 2^``bits`` cells take 2^(bits - 2) * DEPTH bytes
however large the input is.  A fuller sketch lets more windows pass, it never loses one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from estatescope.llm.texts import mixed

#: 2 rows of 2^26 cells: 32 MB.
BITS, DEPTH = 26, 2
_PAGE_BITS = 16


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(hashes, 1001 + row) >> np.uint64(64 - bits)).astype(np.int64)


class Gathered:
    """Cells that a partition has hit, kept as sorted distinct cells with a mark for more than once."""

    def __init__(self, bits: int):
        self.bits, self.once, self.fresh = bits, [np.zeros(0, np.int64)] * DEPTH, [[] for _ in range(DEPTH)]
        self.more = [np.zeros(0, np.int64)] * DEPTH
        self.waiting = 0

    def add(self, hashes: np.ndarray) -> None:
        for row in range(DEPTH):
            self.fresh[row].append(cells(hashes, row, self.bits))
        self.waiting += len(hashes)
        if self.waiting > 1 << 20:
            self.settle()

    def settle(self) -> None:
        for row in range(DEPTH):
            known = [self.once[row], self.more[row], self.more[row]]
            cell, n = np.unique(np.concatenate(known + self.fresh[row]), return_counts=True)
            self.once[row], self.more[row], self.fresh[row] = cell[n == 1], cell[n > 1], []
        self.waiting = 0

    def pages(self) -> Iterator[pa.RecordBatch]:
        """(page, once, more): 16-bit places of the cells in each page that was hit."""
        self.settle()
        pages, once, more = [], [], []
        for row in range(DEPTH):
            every = np.unique(np.concatenate([self.once[row], self.more[row]]) >> _PAGE_BITS)
            for out, found in ((once, self.once[row]), (more, self.more[row])):
                low = (found & ((1 << _PAGE_BITS) - 1)).astype(np.uint16)
                cuts = np.searchsorted(found, [every << _PAGE_BITS, (every + 1) << _PAGE_BITS])
                out += [low[s:e].tobytes() for s, e in cuts.T]
            pages += (every + (row << (self.bits - _PAGE_BITS))).tolist()
        for s in range(0, len(pages), 1024):
            yield pa.RecordBatch.from_arrays(
                [pa.array(pages[s:s + 1024], pa.int32()), pa.array(once[s:s + 1024], pa.binary()),
                 pa.array(more[s:s + 1024], pa.binary())], ["page", "once", "more"])


PAGES = "page int, once binary, more binary"


def merged(pages: DataFrame, bits: int) -> np.ndarray:
    """Which cells were hit more than once, one bit each, rows one after the other.

    Pages are merged where they meet; the driver gets the finished pages only, 8 KB for each of
    a fixed number."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, hit, again = None, None, None

        def finished() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([page], pa.int32()), pa.array([np.packbits(again).tobytes()], pa.binary())],
                ["page", "bits"])

        for batch in batches:
            for p, once, more in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p != page:
                    if page is not None:
                        yield finished()
                    page, hit, again = p, np.zeros(1 << _PAGE_BITS, bool), np.zeros(1 << _PAGE_BITS, bool)
                one, two = np.frombuffer(once, np.uint16), np.frombuffer(more, np.uint16)
                again[one[hit[one]]] = True
                again[two] = True
                hit[one] = True
                hit[two] = True
        if page is not None:
            yield finished()

    done = pages.repartition("page").sortWithinPartitions("page").mapInArrow(merge, "page int, bits binary")
    out, size = np.zeros(DEPTH << (bits - 3), np.uint8), 1 << (_PAGE_BITS - 3)
    for page, packed in done.toLocalIterator():
        out[page * size:(page + 1) * size] = np.frombuffer(packed, np.uint8)
    return out


def repeated(sketch: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether the estimate of each hash is more than one."""
    good = np.ones(len(hashes), bool)
    for row in range(DEPTH):
        at = cells(hashes, row, bits) + (row << bits)
        good &= (sketch[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return good
