"""Best-two-fit packing of documents into sequences.

Rows are filled greedily, the longest piece that fits first; then a row's shortest piece is
replaced by the two unpacked pieces that fill the widened gap best, if they fill it better.

A piece matters to the packing only by its length, so the plan is made for the histogram of
lengths: a filled row is repeated as often as the counts allow, which gives just the rows that
one-by-one packing gives.  The histogram has at most ``capacity`` entries, and each kind of
row uses up at least half of what is left of some length, so there are at most
capacity * log2(pieces) kinds.  Each piece then takes the slot of its rank among the pieces
of its length; ranks come from counts per (length, bucket) and a row number within a bucket,
so that a length that very many documents share is spread over many tasks.

Null texts count as empty; null and repeated ids are packed like any others, ties go by
(id, piece, checksum); an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import load, runs, struct, write_table
from plumbline.llm.tokens import public, word_bpe

CAPACITY = 2048
END_ID = 0
#: Rows that a rank bucket aims at, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 256
BLOCK_BYTES = 4 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of rows for ``counts[length]`` pieces: (how many rows, [(length, copies), ...] longest first)."""
    left = counts.astype(np.int64).copy()
    kinds = []

    def longest() -> np.ndarray:
        """For each room, the longest length in stock that fits it; 0 if none."""
        return np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))

    while True:
        fits = longest()
        if not fits[capacity]:
            return kinds
        used: dict[int, int] = {}
        gap = capacity
        while gap and (length := int(fits[gap])):
            copies = min(gap // length, int(left[length]))
            used[length] = copies
            left[length] -= copies
            gap -= copies * length
            if gap >= length:  # that length is used up
                fits = longest()
        if gap:
            smallest = min(used)
            room = gap + smallest
            fits = longest()
            one = np.flatnonzero(left[: room + 1] > 0)
            if len(one):
                two = fits[np.minimum(one, room - one)]
                alone = (two == one) & (left[one] < 2)
                two[alone] = fits[np.maximum(one[alone] - 1, 0)]
                both = np.where(two > 0, one + two, 0)
                best = int(len(both) - 1 - both[::-1].argmax())
                if both[best] > smallest:
                    used[smallest] -= 1
                    left[smallest] += 1
                    for length in (int(one[best]), int(two[best])):
                        used[length] = used.get(length, 0) + 1
                        left[length] -= 1
        kind = [(length, n) for length, n in sorted(used.items(), reverse=True) if n]
        times = 1 + min(int(left[length]) // n for length, n in kind)
        for length, n in kind:
            left[length] -= (times - 1) * n
        kinds.append((times, kind))


def slots(kinds: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of a length go by rank: from ``first`` on, ``copies`` to a row from row ``row`` on, the first at ``offset``."""
    taken = np.zeros(capacity + 1, np.int64)
    out, row = [], 0
    for times, kind in kinds:
        offset = 0
        for length, copies in kind:
            out.append((length, taken[length], copies, row, offset))
            taken[length] += times * copies
            offset += length * copies
        row += times
    table = np.array(sorted(out), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "copies", "row", "offset"), table.T.copy(), strict=True))


def place(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of the pieces of these lengths and ranks."""
    shift = 44  # ranks stay under 2^44
    at = np.searchsorted((table["length"] << shift) | table["first"], (length << shift) | rank, "right") - 1
    past, copies = rank - table["first"][at], table["copies"][at]
    return table["row"][at] + past // copies, table["offset"][at] + (past % copies) * length


def assign(pieces: DataFrame, capacity: int = CAPACITY, ties: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """``pieces`` (with ``length``, 1 to capacity) with ``sequence_id`` and ``offset``; its rows are read twice, so pass a written table."""
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # capacity rows at most
        counts[r["length"]] = r["count"]
    buckets = LEAST_BUCKETS
    while buckets * BUCKET_ROWS < counts.max():
        buckets *= 2
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity), capacity))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(*ties), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy(*ties)
    ranked = dealt.withColumn("place", F.row_number().over(own)).join(bases, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("base") + F.col("place") - 1).alias("rank"))
    schema = struct(", ".join([*(f"{n} {dict(pieces.dtypes)[n].replace('bigint', 'long')}" for n in pieces.columns), "sequence_id long", "offset long"]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                row, offset = place(table.value, np.asarray(part.column("length")).astype(np.int64), np.asarray(part.column("rank")).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(row), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of whole texts, each text with the end id; only longer ones are cut."""
    schema = struct(PIECES)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        end = np.array([end_id], "<u4")
        for part in parts:
            keys, column = part.column(0).to_pylist(), part.column(1)
            for first, last in runs(pc.binary_length(column).to_numpy(zero_copy_only=False), BLOCK_BYTES):
                ids, cuts = bpe.encode(column.slice(first, last - first))
                wide, rows = ids.astype("<u4"), []
                for key, a, b in zip(keys[first:last], cuts.tolist(), cuts[1:].tolist(), strict=False):
                    whole = np.concatenate([wide[a:b], end])
                    for k, at in enumerate(range(0, len(whole), capacity)):
                        cut = whole[at : at + capacity]
                        rows.append((key, k, at, len(cut), zlib.crc32(cut.tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    texts = F.coalesce(F.col(text), F.lit("")).alias("text")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), texts).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """All pieces of all documents with their sequence and place."""
    return assign(write_table(pieces_of(docs, vocabulary, capacity), "pieces"), capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), public("word_bpe_49k.json"))
