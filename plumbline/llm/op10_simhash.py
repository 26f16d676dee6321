"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.  Two
fingerprints at three or fewer differing bits agree, up to one bit, in one of their two 32-bit
halves.  So each fingerprint is filed under both halves; for a search, its own halves and
those with one 0 bit set are looked up (of two halves that differ in one bit, one has it 0),
and whole distances are verified.

Halves that many fingerprints share are not joined pair by pair: their members are dealt into
blocks, pairs of blocks are compared bit-parallel in numpy, and only edges that span the
components found there come out.  Components then form by alternating large-star and
small-star steps on written tables.  Equal fingerprints are one node from the start.

A text of fewer words than a shingle is hashed whole; null texts and texts without words have
fingerprint zero, linked like any other.  Repeated rows repeat their results.  Rows with a
null id take the component of their fingerprint; a fingerprint that only such rows have gets
none (null) and links nothing.  Rows that share an id but not a text are nodes of one name.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from plumbline.llm.common import again, bitmap, drop_table, free_name, in_bitmap, load, struct, write_table

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: From so many members on a half is compared in blocks; members of a block.
HOT_MEMBERS, BLOCK_MEMBERS = 32, 4096
_COUNT_ROWS = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _COUNT_ROWS):
        counts += np.unpackbits(hashes[k : k + _COUNT_ROWS].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes)).view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column function text -> SimHash, as a signed 64-bit number."""
    for part in parts:
        yield pd.Series(np.array([fingerprint((t or "").encode("utf-8", "replace")) for t in part], np.uint64).view(np.int64))


def spanning(left: np.ndarray, right: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges (place in left, place in right) that connect what links of at most ``distance`` bits connect."""
    near = np.empty((len(left), len(right)), bool)
    for a in range(0, len(left), 256):
        near[a : a + 256] = np.bitwise_count(left[a : a + 256, None] ^ right) <= distance
    return span(near)


def span(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what the set cells of ``near`` connect."""
    fresh_left, fresh_right, edges = near.any(1), np.ones(near.shape[1], bool), []
    while fresh_left.any():
        first = int(fresh_left.argmax())
        wave = np.array([first])
        fresh_left[first] = False
        while len(wave):
            reached = near[wave]
            found = np.flatnonzero(reached.any(0) & fresh_right)
            if not len(found):
                break
            fresh_right[found] = False
            edges += zip(wave[reached[:, found].argmax(0)].tolist(), found.tolist(), strict=True)
            back = near[:, found]
            wave = np.flatnonzero(back.any(1) & fresh_left)
            fresh_left[wave] = False
            edges += zip(wave.tolist(), found[back[wave].argmax(1)].tolist(), strict=True)
    return edges


def links(nodes: DataFrame) -> DataFrame:
    """``a, b`` (a < b): edges that connect all ``nodes`` (fp, node; one row per fp) within the distance."""
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.shiftrightunsigned("fp", 32).alias("part")),
        F.struct(F.lit(1).alias("half"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("part")),
    )
    filed = write_table(nodes.select("fp", "node", F.explode(halves).alias("h")).select("h.half", "h.part", "fp", "node"), "filed")
    flips = F.explode(F.transform(_bits(0), lambda b: F.col("part").bitwiseOR(_one(b))))
    probes = filed.select("half", flips.alias("part"), "fp", "node", F.lit(False).alias("own"))
    search = filed.select("half", "part", "fp", "node", F.lit(True).alias("own")).unionByName(probes)

    crowded = write_table(filed.groupBy("half", "part").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > HOT_MEMBERS), "crowded")
    sparse = filed.join(crowded, ["half", "part"], "left_anti").select("half", "part", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= DISTANCE) & (~F.col("own") | (F.col("fp") < F.col("fp2")))
    pairs = search.join(sparse, ["half", "part"]).where(near).select(F.col("node").alias("x"), F.col("node2").alias("y"))
    if not crowded.isEmpty():
        pairs = pairs.unionByName(_crowded_links(filed, crowded))
    return _ordered(pairs)


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def _bits(value: int) -> Column:
    """Places of the bits of ``part`` that have this value."""
    return F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.getbit("part", b) == value)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _crowded_links(filed: DataFrame, crowded: DataFrame) -> DataFrame:
    """Spanning edges within the crowded halves, by pairs of blocks.

    Who else searches there follows from the crowded halves: those whose half has one bit less.
    """
    own = filed.join(crowded, ["half", "part"]).withColumn("own", F.lit(True))
    less = F.explode(F.transform(_bits(1), lambda b: F.col("part").bitwiseXOR(_one(b))))
    below = crowded.select("half", F.col("part").alias("sought"), "members", less.alias("part"))
    others = filed.join(below, ["half", "part"]).select("half", F.col("sought").alias("part"), "fp", "node", "members", F.lit(False).alias("own"))
    members = own.unionByName(others)
    searchers = members.groupBy("half", "part").agg(F.count(F.lit(1)).alias("searchers"))
    members = members.join(searchers, ["half", "part"])
    rows = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")  # blocks of the filed, and of all that search there
    cols = F.ceil(F.col("searchers") / BLOCK_MEMBERS).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("fp", "node"), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = members.select("half", "part", "fp", "node", deal(cols).alias("col"), every(rows).alias("row"), F.lit(True).alias("seeks"))
    right = members.where("own").select("half", "part", "fp", "node", deal(rows).alias("row"), every(cols).alias("col"), F.lit(False).alias("seeks"))

    def compare(table: pa.Table) -> pa.Table:
        fp, node = np.asarray(table["fp"]).view(np.uint64), np.asarray(table["node"])
        seeks = np.asarray(table["seeks"])
        x, y = node[seeks], node[~seeks]
        found = spanning(fp[seeks], fp[~seeks])
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"x": x[at[:, 0]], "y": y[at[:, 1]]})

    both = left.unionByName(right)
    return both.groupBy("half", "part", "row", "col").applyInArrow(compare, struct("x long, y long"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node each node of ``edges`` (a < b) reaches, for nodes that aren't roots themselves."""
    edges = write_table(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
        fresh = write_table(_ordered(small), "edges")
        drop_table(edges)
        edges = fresh
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of all edges; equal once a round changes nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row; see the module."""
    fps = write_table(docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    nodes = write_table(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    roots = components(links(nodes.where("node IS NOT NULL")))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", groups: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: one row of each component, that of the smallest id (null last).

    Rows are told apart by a number of their own, so a text that shares its id with another stays, and null ids are no exception.
    ``groups`` gives each row's component (``doc_id, component_id``).
    """
    row, own = free_name(docs, "row"), free_name(docs, "row_id")
    marked = write_table(docs.withColumn(row, F.monotonically_increasing_id()), "marked")
    found = groups(marked.select(F.col(row).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text").select(F.col("doc_id").alias(own), "component_id")
    ids = again(marked).select(F.col(row).alias(own), F.col(doc_id).cast("long").alias("id"))
    named = write_table(found.join(ids, own), "named")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", own)).alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    gone = again(named).join(first, "component_id").where(F.col(own) != F.col(f"least.{own}")).select(own)
    gone = write_table(gone, "gone")
    likely = in_bitmap(docs.sparkSession, bitmap(gone, gone.count()))(F.col(row))  # only rows that may go are shuffled
    kept = marked.withColumn(own, likely)
    asked = kept.where(F.col(own)).drop(own).join(gone, F.col(row) == F.col(own), "left_anti")
    return kept.where(~F.col(own)).drop(own).unionByName(asked).drop(row)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
