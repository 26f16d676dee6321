"""Incremental recount: a table of known counts, keyed by path, size and modification time.

An entry is used only if size and time both agree.  Entries without a file of that path go
when the table is refreshed, and the table is cut to the entries touched last when it grows
over its limit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSION = 3
KEYS = ("path", "size", "mtime")
COUNTS = ("total_lines", "code_lines", "comment_lines", "doc_lines", "blank_lines")
MOST, KEPT = 100_000, 75_000


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None where it is missing, unreadable or of another version."""
    try:
        held = spark.read.parquet(path)
    except AnalysisException:
        return None
    if not {*KEYS, *COUNTS, "version", "touched"} <= set(held.columns):
        return None
    return held.where(F.col("version") == VERSION)


def path_hash(path: str) -> int:
    """64-bit FNV-1a of a path's bytes; names a project's table, so it may never change."""
    found = 0xCBF29CE484222325
    for byte in path.encode("utf-8", "replace"):
        found = (found ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return found


def save(known: DataFrame, path: str) -> None:
    """Store the table in place of the one at ``path``, which it may have been made from.

    It is written beside it and then renamed, so a run that breaks off leaves the old one or the new one, never a part.
    """
    spark = known.sparkSession
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = held.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = lambda mark: held.suffix(f".{mark}.{uuid.uuid4().hex}")
    fresh, old = beside("tmp"), beside("old")
    try:
        known.write.parquet(fresh.toString())
        replaced = files.exists(held) and files.rename(held, old)
        if not files.rename(fresh, held):
            if replaced:
                files.rename(old, held)
            raise OSError(f"could not store {path}")
        files.delete(old, True)
    finally:
        files.delete(fresh, True)


def hits(files: DataFrame, known: DataFrame) -> DataFrame:
    """``files`` (path, size, mtime) whose entry is still good, with its counts."""
    return files.join(known.select(*KEYS, *COUNTS), list(KEYS))


def misses(files: DataFrame, known: DataFrame) -> DataFrame:
    """``files`` without a good entry."""
    return files.join(known.select(*KEYS), list(KEYS), "left_anti")


def hit_rate(files: DataFrame, known: DataFrame) -> DataFrame:
    """``hits, misses, rate`` in one pass; a rate of 0 where there are no files."""
    marked = files.join(known.select(*KEYS, F.lit(1).alias("good")).distinct(), list(KEYS), "left")
    n = F.count("good")
    return marked.agg(n.alias("hits"), (F.count(F.lit(1)) - n).alias("misses"), F.when(F.count(F.lit(1)) > 0, n / F.count(F.lit(1))).otherwise(0.0).alias("rate"))


def refresh(files: DataFrame, known: DataFrame | None, count: Callable[[DataFrame], DataFrame], now: int) -> DataFrame:
    """The new table: good entries touched now, recounted files, nothing else. ``count`` adds the counts to files."""
    columns = [*KEYS, *COUNTS]
    if known is None:
        fresh = count(files).select(*columns)
    else:
        fresh = hits(files, known).select(*columns).unionByName(count(misses(files, known)).select(*columns))
    return fresh.withColumns({"touched": F.lit(now).cast("long"), "version": F.lit(VERSION)})


def evict(known: DataFrame, most: int = MOST, kept: int = KEPT) -> DataFrame:
    """The ``kept`` entries touched last if there are over ``most``, else all; equal ones by path."""
    if known.limit(most + 1).count() <= most:
        return known
    return known.orderBy(F.col("touched").desc(), "path").limit(kept)


def newest_scopes(scopes: DataFrame, kept: int = 64) -> DataFrame:
    """The scopes (name, touched) used last."""
    return scopes.orderBy(F.col("touched").desc(), "name").limit(kept)


def latest(changes: DataFrame, key: str = "uri", order: str = "seq") -> DataFrame:
    """Open documents after all ``changes`` (uri, seq, kind, text): open and change set the text, close ends it."""
    own = F.max(F.struct(F.col(order), F.col("kind"), F.col("text")))
    return changes.groupBy(key).agg(own.alias("last")).where(F.col("last.kind") != "close").select(key, F.col(f"last.{order}").alias(order), F.col("last.text").alias("text"))


def running_rank(df: DataFrame, order: str) -> DataFrame:
    """Row numbers by a column, newest first, within each scope."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.col(order).desc(), "path")))
