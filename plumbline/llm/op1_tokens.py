"""Token-id output: best-fit-decreasing packing into id matrices.

Texts become ids of a lossless byte-level BPE, each followed by the end id.  A document longer
than a row is split into pieces of a whole row, the last one shorter; nothing is dropped.
Pieces are packed best-fit-decreasing within blocks of a bounded number of tokens, so a
task's memory is bounded, no row is shuffled, and a lost task is simply run again.  A block
fills all rows but its last few.

Result: one row per packed row: ``sequence_id`` (unique), ``n_tokens``, ``doc_ids`` and
``pieces`` in order, ``cu_seqlens`` (0, ends of the segments), ``input_ids`` and
``position_ids`` (little-endian unsigned 16-bit, padded with the end id and 0 to the row's
length; positions start again at 0 with each segment).  A null text counts as empty and takes
its end id; null and repeated ids are kept as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import load, struct
from plumbline.llm.tokens import byte_bpe, public, public_pattern

ROW_TOKENS = 2048
#: Tokens that are packed together; bounds a worker's memory.
BLOCK_TOKENS = 4 << 20

SCHEMA = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class CapacityTree:
    """Which free capacities open rows have: a segment tree over 0..size whose nodes count the rows below."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        k = free + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, row) of the row with the least free capacity that is at least ``need``."""
        k = need + self.leaves
        while not self.count[k]:  # up to the nearest right neighbour that holds something
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.leaves:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        free = k - self.leaves
        while k:
            self.count[k] -= 1
            k >>= 1
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of item numbers, each row's lengths adding up to ``size`` at most. Ties go by number."""
    tree, rows = CapacityTree(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            found = size, len(rows)
            rows.append([])
        free, row = found
        rows[row].append(i)
        if free > lengths[i]:
            tree.add(free - lengths[i], row)
    return rows


def pack(docs: DataFrame, vocabulary: str, pattern: str, size: int = ROW_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows of all documents; see the module."""
    schema = struct(SCHEMA)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, made = byte_bpe(vocabulary, pattern), TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, int, np.ndarray]] = []
        tokens = 0
        for part in parts:
            for key, body in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids = np.append(bpe.encode(body.as_py() or ""), np.uint16(bpe.end))
                held += [(key, k, ids[a : a + size]) for k, a in enumerate(range(0, len(ids), size))]
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS:
                    yield from _rows(held, size, bpe.end, made, schema)
                    made += len(held)
                    held, tokens = [], 0
        if held:
            yield from _rows(held, size, bpe.end, made, schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _rows(held: list, size: int, end: int, first: int, schema) -> Iterator[pa.RecordBatch]:
    """The packed rows of a block, some 500 to a batch."""
    packed = best_fit_decreasing([len(ids) for _, _, ids in held], size)
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    for a in range(0, len(packed), 500):
        out = []
        for k, items in enumerate(packed[a : a + 500], first + a):
            ends = np.cumsum([0, *(len(held[i][2]) for i in items)])
            row, place = np.full(size, end, "<u2"), np.zeros(size, "<u2")
            for i, b in zip(items, ends, strict=False):
                n = len(held[i][2])
                row[b : b + n] = held[i][2]
                place[b : b + n] = np.arange(n)
            out.append((k, int(ends[-1]), [held[i][0] for i in items], [held[i][1] for i in items], ends.tolist(), row.tobytes(), place.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), public("byte_bpe_50k.tiktoken"), public_pattern())
