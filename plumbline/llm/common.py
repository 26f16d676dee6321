"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The shuffles of a written table are not needed once it is there; this takes their files away.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own; a cluster has to name one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="plumbline-")
        context.setCheckpointDir(found)
    return found


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage and is computed once.

    The files stay until ``drop_table`` or until the application's folder ``<shared>/<application id>`` is removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def again(df: DataFrame) -> DataFrame:
    """A table that ``write_table`` made, as a source of its own, for a join with itself."""
    return df.sparkSession.read.schema(df.schema).parquet(df._written)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``write_table`` made and nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(rows: DataFrame, kind: str, most: int) -> DataFrame:
    """At most ``most`` rows of each ``kind``, those of the smallest ``draw`` (a hash); rows equal in both count once.

    The rows that can be among them are found by a threshold first, from a histogram of the draws, so that no kind is sorted whole.
    """
    cell = F.shiftrightunsigned("draw", 48)
    levels = rows.groupBy(kind, F.floor(cell.cast("double") / 64).alias("level")).agg(F.approx_count_distinct("draw").alias("n"))
    upto = Window.partitionBy(kind).orderBy("level")
    least = levels.select(kind, "level", F.sum("n").over(upto).alias("n")).groupBy(kind).agg(F.min(F.when(F.col("n") >= 2 * most, F.col("level"))).alias("last"))
    last = least.where("last IS NOT NULL")
    found = rows.join(F.broadcast(last), kind, "left").where(F.col("last").isNull() | (F.floor(cell.cast("double") / 64) <= F.col("last"))).drop("last")
    rank = free_name(rows, "rank")
    own = Window.partitionBy(kind).orderBy(F.shiftrightunsigned("draw", 1), "draw")
    return found.dropDuplicates([kind, "draw"]).withColumn(rank, F.row_number().over(own)).where(F.col(rank) <= most).drop(rank)


def added(parts: DataFrame, pieces: int = 64) -> DataFrame:
    """Sums of arrays of numbers that tasks have cut into ``pieces``: ``piece, numbers`` (packed 64-bit numbers), a row for each piece."""
    schema = struct("piece long, numbers binary")

    def total(table: pa.Table) -> pa.Table:
        numbers = sum(np.frombuffer(x, np.int64) for x in table["numbers"].to_pylist())
        return pa.table({"piece": table["piece"][:1], "numbers": pa.array([numbers.tobytes()], pa.binary())})

    return parts.groupBy("piece").applyInArrow(total, schema)


def in_pieces(numbers: np.ndarray, pieces: int = 64) -> pa.RecordBatch:
    """An array of 64-bit numbers for ``added``."""
    cut = [x.astype(np.int64).tobytes() for x in np.array_split(numbers, pieces)]
    return pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int64()), pa.array(cut, pa.binary())], names=["piece", "numbers"])


#: Bits of a bitmap for each of its numbers, and the most it may have (16 MB); pieces in which it is put together.
BITS_EACH, MOST_BITS, BIT_PIECES = 16, 27, 64


def bitmap(numbers: DataFrame, many: int) -> np.ndarray:
    """Packed bits of the hashes of the ``many`` numbers in a column: ``in_bitmap`` tells numbers that can't be among them, whatever their count."""
    bits = min(MOST_BITS, max(16, (BITS_EACH * many).bit_length()))
    schema, size = struct("piece long, bits binary"), (1 << bits) // BIT_PIECES

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(1 << bits, bool)
        for part in parts:
            marked[np.asarray(part.column(0)).view(np.uint64) >> np.uint64(64 - bits)] = True
        packed = [np.packbits(marked[k * size : (k + 1) * size]).tobytes() for k in range(BIT_PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BIT_PIECES), pa.int64()), pa.array(packed, pa.binary())], names=["piece", "bits"])

    def either(table: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()])
        return pa.table({"piece": table["piece"][:1], "bits": pa.array([whole.tobytes()], pa.binary())})

    hashed = numbers.select(F.xxhash64(F.col(numbers.columns[0])).alias("hash"))
    found = hashed.mapInArrow(run, schema).groupBy("piece").applyInArrow(either, schema).collect()  # 2^MOST_BITS bits at most
    whole = b"".join(r["bits"] for r in sorted(found, key=lambda r: r["piece"]))
    return np.frombuffer(whole or bytes(1 << bits - 3), np.uint8)


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether hashes (``xxhash64(number)``) are marked in a bitmap."""
    cell = hashes.view(np.uint64) >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return bits[cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def in_bitmap(spark: SparkSession, bits: np.ndarray):
    """Column function: whether a number's hash is marked, given ``xxhash64(number)``."""
    held = spark.sparkContext.broadcast(bits)  # of a bounded size

    @F.pandas_udf(T.BooleanType())
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(marked(held.value, part.to_numpy()))

    return lambda number: told(F.xxhash64(number))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    held = {c.lower() for c in df.columns}
    while wanted.lower() in held:
        wanted += "_"
    return wanted


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def blocks(texts: Iterable[bytes], limit: int) -> Iterator[list[int]]:
    """Index runs of about ``limit`` bytes each (at least one text a run)."""
    run, held = [], 0
    for i, t in enumerate(texts):
        if run and held + len(t) > limit:
            yield run
            run, held = [], 0
        run.append(i)
        held += len(t)
    if run:
        yield run


def runs(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """(first, past the last) of runs of about ``limit`` in sum (at least one item a run)."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def struct(columns: str) -> T.StructType:
    """``"a long, b array<int>"`` as a schema, without a session."""
    kind = lambda k: T.ArrayType(_TYPES[k[6:-1]]) if k.startswith("array<") else _TYPES[k]
    return T.StructType([T.StructField(n, kind(k)) for n, k in (x.split() for x in columns.split(", "))])
