"""Packing token pieces into fixed windows: best-fit decreasing over a segment tree.

Each task packs the documents of its own partition, so nothing is shuffled and a partition
wastes at most a few windows.  Overlong documents are first cut into full windows; the rest of
each goes, longest first, to the open window with the least remaining capacity that holds it.
A piece never moves between tasks, so a repeated task gives the same rows.

A null text is an empty one (its end id only); a null doc_id passes through; repeated rows are
packed as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strandweave.llm.common import batches, read_table
from strandweave.llm.segment_encoder import encoder

WINDOW, END_ID = 1024, 0
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class CapacityTree:
    """Open windows by remaining capacity; a segment tree of counts finds the tightest that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()  # leaves 0 .. window at least
        self.counts = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        node = self.size + capacity
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) with the smallest capacity of at least `least`."""
        counts, node = self.counts, self.size + least
        if not counts[node]:
            # Up to the first ancestor with an occupied right sibling, then down its left edge.
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        capacity = node - self.size
        while node:
            counts[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window, offset) of each length; every length is 1 to `window`.  Ties go in input order."""
    tree, n_windows = CapacityTree(window), 0
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if (found := tree.take(n)) is None:
            found = (window, n_windows)
            n_windows += 1
        capacity, window_id = found
        placed[i] = (window_id, window - capacity)
        if capacity > n:
            tree.add(capacity - n, window_id)
    return placed


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """PIECES for every document (columns doc_id, text) of `docs`.

    sequence_id is the partition's number times 2**33 plus the window's in it.
    """
    end = end_id.to_bytes(4, "little")

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        first = TaskContext.get().partitionId() << 33
        rows: list[list[int]] = [[] for _ in range(5)]
        full: list[int] = []
        tails: list[int] = []
        n = 0
        for part in parts:
            texts = part.column("text").to_pylist()
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(texts)):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for column, value in zip(rows, (doc_id, start, length, crc, total)):
                        column.append(value)
                    (full if length == window else tails).append(n)
                    n += 1
        sequence, offset = [0] * n, [0] * n
        for k, i in enumerate(full):
            sequence[i] = first + k
        lengths = [rows[2][i] for i in tails]
        for i, (k, at) in zip(tails, best_fit_decreasing(lengths, window)):
            sequence[i], offset[i] = first + len(full) + k, at
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        yield from batches({k: (v, pa.int64()) for k, v in zip(names, (*rows, sequence, offset))})

    return docs.select("doc_id", "text").mapInArrow(packed, PIECES)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: packs all `documents`."""
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
