"""Language-model scoring by online logistic context mixing.

A text is the sequence of its tokens (white-space words, A-Z lowered, then one end).  Each token
is coded as a path of binary decisions down a Huffman tree over the frequent training tokens,
and each decision is predicted from hashed contexts that run across tokens: the last token, the
last two, the last four, and the last frequent one where it isn't the last (``mixing``).  Any other token takes the
path of an escape; which one it is has the mean of two probabilities, weighted by a learned
gate: its share of the escapes, and its spelling, byte by byte, by the same mixing over the last
one, two, four and six bytes.  All of these are distributions, so the score is a log
probability; divided by the bytes of the tokens, each with a space, it gives bits per byte.

All that is learned comes from all training tokens: counts of tokens, the tree, what is known of
each context (in buckets whose number grows with the corpus), weights, maps and gates.  An
occurrence in a training text is predicted from all others but not from itself, so that what a
second copy adds can be told; held-out texts are predicted from all, and change no other score.

Texts are cut and numbered in Arrow, in blocks of some megabytes, once, in a written table; a
block's partial sums come back by its number.

Null texts count as empty (one end token); repeated rows repeat their results (equal training
texts have equal scores unless a token context is so frequent that its bucket is divided by
blocks); a null id counts as empty text in the hold-out rule; other columns are ignored.  Without
any training token all counts are zero and every branch has probability one half.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.common import again, drop_table, load, runs, struct, write_table
from plumbline.llm.mixing import BUCKET, NONE, Code, Records, mix, mixed, pack, sums_of, unpack

#: Bounds of the tree, and the length from which on a token is listed by its digest.
VOCABULARY, LISTED_BYTES = 1 << 16, 64
#: The last token of so many is the nearest context.
FREQUENT = 512
#: Bytes of text in a block, and in what a task counts in one go (one text at least).
PORTION_BYTES = 4 << 20
EM_ROUNDS = 6
#: Words that are looked up in one go.
LOOKED_UP = 1 << 20
#: Bytes of text whose words are counted in one go, after they have been in portions.
COUNTED_BYTES = 1 << 25
START, LISTED, CLOSE = 0xFFFFFFFF, 1 << 31, 0x20

def tokens(text: str | None) -> list[bytes]:
    """The words of a text; the end is not among them."""
    return (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space alone


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of all texts of a string column without nulls: (number of each, distinct words, words of each text)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # ASCII letters and ASCII white space alone
    words, sizes = lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)
    full = np.asarray(pc.binary_length(words)) > 0  # white space at the ends makes empty ones
    if not full.all():
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sizes = np.bincount(owner[full], minlength=len(sizes))
        words = words.filter(pa.array(full))
    coded = words.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.cast(pa.binary()), sizes


def _remainder(key: int | None, modulus: int) -> int:
    return zlib.crc32(b"" if key is None else str(key).encode()) % modulus


def count_tokens(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    """Distinct tokens of ``docs`` (doc_id, text): ``word, c, n``, training and whole count; the end is an empty word.

    Counts of portions come together in buckets of the words' hashes, whose number grows with the text, in packs.
    """
    schema, counted = struct("bucket long, words binary, c binary, n binary"), struct("word binary, c long, n long")
    buckets = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // COUNTED_BYTES

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _portions(parts):
            at, words, sizes = cut(texts)
            training = np.repeat([_remainder(k, modulus) != held for k in keys], sizes)
            n, c = np.bincount(at, minlength=len(words)), np.bincount(at[training], minlength=len(words))
            ends = sum(_remainder(k, modulus) != held for k in keys)
            words, c, n = pa.concat_arrays([words, pa.array([b""], pa.binary())]), np.append(c, ends), np.append(n, len(keys))
            yield _rows([(to, packed, *(pack([x[at].astype("<u4")]) for x in (c, n))) for to, at, packed in _dealt(words, buckets)], schema)

    def total(table: pa.Table) -> pa.Table:
        parts = [unpack_words(x) for x in table["words"].to_pylist()]
        words = pa.concat_arrays(parts).dictionary_encode()
        sums = []
        for name in ("c", "n"):
            numbers = np.concatenate([unpack(x, [(len(p), "<u4")])[0] for p, x in zip(parts, table[name].to_pylist(), strict=True)])
            sums.append(pa.array(np.bincount(np.asarray(words.indices), weights=numbers, minlength=len(words.dictionary)).astype(np.int64)))
        return pa.table([words.dictionary, *sums], names=counted.names)

    return docs.mapInArrow(run, schema).groupBy("bucket").applyInArrow(total, counted)


def _portions(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts (null: empty) of a task's rows, in portions of about PORTION_BYTES."""
    keys, texts, held = [], [], 0
    for part in parts:
        column = pc.fill_null(part.column(1), "")
        for a, b in runs(np.asarray(pc.binary_length(column)).tolist(), PORTION_BYTES):
            keys += part.column(0).slice(a, b - a).to_pylist()
            texts.append(column.slice(a, b - a))
            held += pc.sum(pc.binary_length(texts[-1])).as_py()
            if held >= PORTION_BYTES:
                yield keys, pa.concat_arrays(texts)
                keys, texts, held = [], [], 0
                pa.default_memory_pool().release_unused()
    if keys:
        yield keys, pa.concat_arrays(texts)


def _listed(word: bytes) -> bytes:
    """What stands for a token in the list."""
    return word if len(word) <= LISTED_BYTES else b" " + hashlib.md5(word, usedforsecurity=False).hexdigest().encode()


def frequent(counts: DataFrame) -> tuple[Column, list[tuple[bytes, int]]]:
    """The condition on ``counts`` that frequent tokens meet, VOCABULARY at most, and these with their training counts, most frequent first.

    A threshold from a histogram, so that nothing is sorted in one task.  The end is always first.
    """
    level = F.floor(F.log2("c") * 16)
    room, least = VOCABULARY, None
    words = counts.where("c > 1 AND octet_length(word) > 0")
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # some hundred rows
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    listed = (F.octet_length("word") > 0) & ((F.col("c") > 1) & (level >= least) if least is not None else F.lit(False))
    name = F.when(F.octet_length("word") <= LISTED_BYTES, F.col("word")).otherwise(F.concat(F.lit(b" "), F.md5("word").cast("binary")))
    found = counts.where(listed).select(name.alias("word"), "c").toArrow()
    pairs = sorted(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True), key=lambda p: (-p[1], p[0]))
    return listed, pairs


@dataclass
class Numbers:
    """The frequent tokens' numbers (0 is the end, the last one an escape) and their parts of the base score."""

    place: dict[bytes, int]
    base: np.ndarray

    @property
    def escape(self) -> int:
        return len(self.base)


class Block:
    """Texts as numbers: their tokens, each text closed by an end, and what the base score needs."""

    def __init__(self, texts: pa.Array, held: list[bool], numbers: Numbers):
        at, coded, sizes = cut(texts)
        words, length = _listing(coded), np.asarray(pc.binary_length(coded)).astype(np.int64)
        ids = np.fromiter(map(numbers.place.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero((ids < 0) & (length > LISTED_BYTES)).tolist():
            ids[i] = numbers.place.get(_listed(words[i]), -1)
        rare = np.flatnonzero(ids < 0)
        self.cold = [words[i] for i in rare.tolist()]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.cold), np.uint64, len(self.cold))
        self.cold = _brief(self.cold, length[rare])
        ids[rare] = LISTED | (hashes & np.uint64(LISTED - 2)).astype(np.int64)  # never START
        cold = np.zeros(len(words), np.int64)
        cold[rare] = np.arange(len(rare))
        n = len(sizes)
        owner = np.repeat(np.arange(n), sizes)
        value = np.append(numbers.base, 0).take(np.minimum(ids, numbers.escape))
        self.sizes = sizes + 1
        self.bytes = np.bincount(owner, weights=length[at], minlength=n).astype(np.int64) + self.sizes
        self.base = np.bincount(owner, weights=value[at], minlength=n) + numbers.base[0]
        own = ids[at]
        self.held = np.array(held, np.uint8)
        rare = np.flatnonzero(own >= LISTED)
        self.cold_at, self.cold_owner = cold[at[rare]], owner[rare]
        self.ids = np.zeros(len(at) + n, np.int64)
        self.ids[np.arange(len(at)) + owner] = own  # an end, 0, after each text

    def body(self) -> bytes:
        return np.array([len(self.ids), len(self.held)], "<u8").tobytes() + pack([self.ids.astype("<u4"), self.sizes.astype("<u4"), self.held])


def _listing(words: pa.Array) -> list[bytes]:
    """``to_pylist``, in some tenth of its time."""
    return words.to_numpy(zero_copy_only=False).tolist() if isinstance(words, pa.Array) else words.to_numpy().tolist()


def _brief(words: list[bytes], length: np.ndarray) -> pa.Array:
    """What stands for tokens of these lengths, see ``_listed``."""
    words = list(words)
    for i in np.flatnonzero(length > LISTED_BYTES).tolist():
        words[i] = _listed(words[i])
    return pa.array(words, pa.binary())


def pack_words(words: pa.Array) -> bytes:
    n, (_, offsets, data) = len(words), words.buffers()
    if not n:
        return np.zeros(3, "<u8").tobytes()
    ends = np.frombuffer(offsets, "<i4")[words.offset : words.offset + n + 1]
    lengths = pack([np.diff(ends).astype("<u4")])
    data = data[int(ends[0]) : int(ends[-1])]
    return np.array([n, len(lengths), data.size], "<u8").tobytes() + lengths + pa.compress(data, "zstd", asbytes=True)


def unpack_words(data: bytes) -> pa.Array:
    n, size, many = np.frombuffer(data[:24], "<u8").tolist()
    if not n:
        return pa.array([], pa.binary())
    ends = np.cumsum(unpack(data[24 : 24 + size], [(n, "<u4")])[0])
    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype("<i4"))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.decompress(data[24 + size :], many, "zstd")])


def _dealt(words: pa.Array, buckets: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Words by buckets of their hashes: (bucket, places of its words, rising; these, packed)."""
    to = (np.fromiter(map(xxhash.xxh64_intdigest, _listing(words)), np.uint64, len(words)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to.astype(np.uint16) if buckets <= 1 << 16 else to, kind="stable")  # 16 bits are sorted by counting
    words, to = words.take(pa.array(order)), to[order]
    cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield int(to[a]), order[a:b], pack_words(words.slice(a, b - a))


def look_up(blocks: DataFrame, spelled: DataFrame, most: int) -> DataFrame:
    """``block, places, counts, spellings``: c and spelled of the ``cold`` words of ``blocks``, of which there are ``most`` at most, packed; some rows a block.

    Words come together in buckets of their hashes, whose number grows with theirs, in packs: a row for each block and bucket.
    """
    buckets = 1 + most // LOOKED_UP
    asked, told = struct("bucket long, block long, places binary, words binary"), struct("bucket long, words binary, c binary, spelled binary")
    out = struct("block long, places binary, counts binary, spellings binary")

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block, body in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                rows = [(to, block, pack([np.diff(at, prepend=0).astype("<u4")]), words) for to, at, words in _dealt(unpack_words(body.as_py()), buckets)]
                if rows:
                    yield _rows(rows, asked)

    def tell(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(parts):
            words = _listing(table["word"])
            c, spellings = np.asarray(table["c"]), np.asarray(table["spelled"])
            brief = _brief(words, np.fromiter(map(len, words), np.int64, len(words)))
            rows = [(to, packed, c[at].astype("<i8").tobytes(), spellings[at].astype("<f4").tobytes()) for to, at, packed in _dealt(brief, buckets)]
            yield _rows(rows, told)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        asks = [unpack_words(x) for x in left["words"].to_pylist()]
        if not asks:
            return out_of([])
        known = pa.concat_arrays([unpack_words(x) for x in right["words"].to_pylist()])
        at = np.asarray(pc.index_in(pa.concat_arrays(asks), value_set=known)).astype(np.int64)
        c, spellings = (np.concatenate([np.frombuffer(x, t) for x in right[k].to_pylist()]).take(at) for k, t in (("c", "<i8"), ("spelled", "<f4")))
        ends = np.cumsum([0, *map(len, asks)]).tolist()
        parts = zip(left["block"].to_pylist(), left["places"].to_pylist(), ends, ends[1:], strict=False)
        return out_of([(block, places, pack([c[a:b]]), spellings[a:b].tobytes()) for block, places, a, b in parts])

    def out_of(rows: list[tuple]) -> pa.Table:
        return pa.Table.from_batches([_rows(rows, out)])

    asks = blocks.select("block", "cold").mapInArrow(ask, asked)
    return asks.groupBy("bucket").cogroup(spelled.mapInArrow(tell, told).groupBy("bucket")).applyInArrow(answer, out)


def _rows(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    """A batch of long and binary columns."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema.names)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if f.dataType.simpleString() == "binary" else pa.int64()) for v, f in zip(columns, schema.fields, strict=True)], names=schema.names)


def _gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A task's rows, in tables of about twice PORTION_BYTES."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.nbytes
        if size >= 2 * PORTION_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


BLOCKS = "block long, ids array<long>, held array<boolean>, tokens array<long>, bytes array<long>, base array<double>, cold_at binary, cold_owner binary, cold binary, body binary"


def block_table(docs: DataFrame, numbers: Broadcast, modulus: int, held: int) -> DataFrame:
    """Blocks of the texts of ``docs`` (doc_id, text)."""
    schema = struct(BLOCKS)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for keys, texts in _portions(parts):
            told = [_remainder(k, modulus) == held for k in keys]
            block = Block(texts, told, numbers.value)
            packed = [x.astype("<u4").tobytes() for x in (block.cold_at, block.cold_owner)]
            values = [at, keys, told, block.sizes, block.bytes, block.base, *packed, pack_words(block.cold), block.body()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _ARROW, strict=True)], names=schema.names)
            at += 1

    return docs.mapInArrow(run, schema)


_LONGS = pa.list_(pa.int64())
_ARROW = (pa.int64(), _LONGS, pa.list_(pa.bool_()), _LONGS, _LONGS, pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def word_records(body: bytes, escape: int) -> Records:
    """Records of a block's tokens; owners are its texts."""
    n, m = np.frombuffer(body[:16], "<u8").tolist()
    ids, sizes, held = unpack(body[16:], [(n, "<u4"), (m, "<u4"), (m, "u1")])
    sizes, held = sizes.astype(np.int64), held.astype(bool)
    first = np.cumsum(sizes) - sizes
    back = []
    for k in range(1, 5):
        before = np.full(n, START, np.uint32)
        before[k:] = ids[:-k]
        for j in range(k):
            before[(first + j)[sizes > j]] = START
        back.append(before)
    more = (mix(back[2].astype(np.uint64) << np.uint64(32) | back[3]) >> np.uint64(48)).astype(np.uint16)
    common = (ids > 0) & (ids < FREQUENT)
    at = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(common, at, np.int32(-1)))
    before = np.concatenate([[-1], last[:-1]]).astype(np.int32)
    farther = (before >= np.repeat(first.astype(np.int32), sizes)) & (before < at - 1)
    near = np.where(farther, ids.take(np.maximum(before, 0)), np.uint32(NONE)).astype(np.uint16)
    symbol = np.minimum(ids, np.uint32(escape))
    return Records(symbol, np.repeat(held, sizes), near, back[0], back[1], more, np.repeat(np.arange(m), sizes))


def spelling_records(body: bytes) -> Records:
    """Records of the bytes of tokens, each closed by a space; owners are the tokens."""
    n, m = np.frombuffer(body[:16], "<u8").tolist()
    data, held = unpack(body[16:], [(n, "u1"), (m, "u1")])
    held, ends = held.astype(bool), np.flatnonzero(data == CLOSE)
    sizes = np.diff(ends, prepend=-1)
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)
    place = np.arange(n, dtype=np.int32) - np.repeat((ends + 1 - sizes).astype(np.int32), sizes)
    back = []
    for k in range(1, 7):  # narrow numbers: a block has a record a byte
        before = np.zeros(n, np.uint16)
        before[k:] = data[:-k] + np.uint16(1)
        before[place < k] = 0
        back.append(before)
    del place
    pair = lambda a, b: a * np.uint32(257) + b
    return Records(data.astype(np.int32), held[owner], back[0], pair(back[0], back[1]), pair(back[2], back[3]), pair(back[4], back[5]).astype(np.uint16), owner)


def spell(cold: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """A written table ``word, c, spelled`` of ``cold`` (word, c): log10 probability of each token's bytes, learned from those with c > 0, each once."""
    spark = cold.sparkSession
    schema = struct("block long, words array<binary>, counts array<long>, body binary")

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, words, counts, size = TaskContext.get().partitionId() << 40, [], [], 0

        def closed() -> pa.RecordBatch:
            data = b" ".join([*words, b""])
            held = (np.array(counts) == 0).astype(np.uint8)
            body = np.array([len(data), len(words)], "<u8").tobytes() + pack([np.frombuffer(data, np.uint8), held])
            kinds = (pa.int64(), pa.list_(pa.binary()), _LONGS, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((at, words, counts, body), kinds, strict=True)], names=schema.names)

        for part in parts:
            for word, c in zip(_listing(part.column(0)), part.column(1).to_pylist(), strict=True):
                words.append(word)
                counts.append(c)
                size += len(word) + 1
                if size >= PORTION_BYTES:
                    yield closed()
                    at, words, counts, size = at + 1, [], [], 0
        if words:
            yield closed()

    stream = write_table(cold.select("word", "c").mapInArrow(blocks, schema), "spellings")

    def bytes_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for part in parts:
            for body in part.column(0):
                r = spelling_records(body.as_py())
                total += np.bincount(r.symbol[~r.held], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])

    total = np.zeros(256, np.int64)
    for r in stream.select("body").mapInArrow(bytes_of, struct("byte long, n long")).groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        total[r["byte"]] = r["n"]
    found = mixed(stream.select("block", "body"), lambda _, body: spelling_records(body), Code.over(total), int(total.sum()), "bytes", bucket)
    out = struct("word binary, c long, spelled float")

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        words, counts = left["words"][0].as_py(), left["counts"][0].as_py()
        return pa.table([pa.array(words, pa.binary()), pa.array(counts, pa.int64()), pa.array(_sums(right, len(words)).astype(np.float32))], names=out.names)

    spelled = write_table(again(stream).select("block", "words", "counts").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(joined, out), "spelled")
    drop_table(stream)
    drop_table(found)
    return spelled


def _sums(parts: pa.Table, n: int) -> np.ndarray:
    return sums_of([x for x in parts["sums"].to_pylist() if x], n)


def gate_of(spelled: DataFrame, total: int) -> float:
    """How much an escape is what its share says: learned by expectation maximization over the ``total`` training escapes, each without itself.

    ``spelled`` (word, c, spelled) is a written table.
    """
    gate = 0.5 if total > 1 else 0.0
    for _ in range(EM_ROUNDS if gate else 0):
        share = gate * (F.col("c") - 1) / F.lit(total - 1)
        whole = share + (1 - gate) * F.pow(F.lit(10.0), F.greatest(F.col("spelled").cast("double"), F.lit(-300.0)))
        found = spelled.where("c > 0").agg(F.sum(F.col("c") * share / F.greatest(whole, F.lit(1e-300)))).first()[0]
        gate = min(0.999, max(0.0, (found or 0.0) / total))
    return gate


def escaped(c: np.ndarray, spelled: np.ndarray, told: np.ndarray, gate: float, total: int) -> np.ndarray:
    """log10 probability of escapes to be tokens of these counts and spellings; from all training escapes where ``told``, else from the others."""
    share = np.where(told, c / max(1, total), np.maximum(c - 1, 0) / max(1, total - 1))
    return np.log10(np.maximum(gate * share + (1 - gate) * 10 ** np.maximum(spelled, -300.0), 1e-300))


def score(docs: DataFrame, modulus: int = 7, held: int = 2, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Scores of all texts by a model of those whose crc32(id as text) mod ``modulus`` is not ``held``; see the module."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = write_table(count_tokens(base, modulus, held), "counts")
    ends = F.sum(F.when(F.octet_length("word") == 0, F.col("c")))
    sums = counts.agg(F.sum("c").alias("all"), F.count_if(F.col("c") > 0).alias("distinct"), ends.alias("ends"), F.sum("n").alias("whole")).first()
    in_all, in_ends = sums["all"] or 0, sums["ends"] or 0
    unit = math.log10(in_all + sums["distinct"] + 1)
    listed, pairs = frequent(counts)
    by_number = np.array([in_ends, *(c for _, c in pairs)], np.int64)
    place = {b"": 0} | {w: k for k, (w, _) in enumerate(pairs, 1)}
    numbers = spark.sparkContext.broadcast(Numbers(place, np.log10(by_number + 1.0) - unit))
    in_escapes = in_all - int(by_number.sum())

    cold = write_table(counts.where(~listed & (F.octet_length("word") > 0)).select("word", "c"), "cold")
    drop_table(counts)
    spelled = spell(cold, bucket)
    drop_table(cold)
    gate = gate_of(spelled, in_escapes)

    blocks = write_table(block_table(base, numbers, modulus, held), "blocks")
    numbers.destroy()
    escape = len(by_number)
    code = Code.over(np.append(by_number, in_escapes))
    found = mixed(blocks.select("block", "body"), lambda _, body: word_records(body, escape), code, in_all, "words", bucket)

    lines = look_up(blocks, spelled, (sums["whole"] or 0) - in_all + in_escapes)  # each held-out token, each escape at most
    kinds = {"places": "binary", "counts": "binary", "spellings": "binary"}
    back = lines.withColumn("sums", F.lit(None).cast("binary")).unionByName(found.withColumns({k: F.lit(None).cast(t) for k, t in kinds.items()}))
    out = struct("doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double")

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, held, size, n_bytes, base = (left[k][0].values for k in ("ids", "held", "tokens", "bytes", "base"))
        at, owner = (np.frombuffer(left[k][0].as_py(), "<u4").astype(np.int64) for k in ("cold_at", "cold_owner"))
        own = right.filter(pc.is_valid(right["places"]))
        by_place = np.zeros((2, sum(map(len, own["spellings"].to_pylist())) // 4))
        for places, many, spellings in zip(*(own[k].to_pylist() for k in kinds), strict=True):
            n = len(spellings) // 4
            to = np.cumsum(unpack(places, [(n, "<u4")])[0])
            by_place[0, to], by_place[1, to] = unpack(many, [(n, "<i8")])[0], np.frombuffer(spellings, "<f4")
        c, spellings = by_place.take(at, axis=1)
        add = lambda values: np.bincount(owner, weights=values, minlength=len(ids))
        told = held.to_numpy(zero_copy_only=False)[owner]
        words = _sums(right, len(ids)) + add(escaped(c, spellings, told, gate, in_escapes))
        known = np.asarray(size) - add(c == 0) if in_ends else np.zeros(len(ids))
        bases = np.asarray(base) + add(np.log10(c + 1) - unit)
        return pa.table([ids, held, size, pa.array(known.astype(np.int64)), n_bytes, pa.array(bases), pa.array(words)], names=out.names)

    whole = again(blocks).drop("body", "cold").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(joined, out)
    per_byte = -F.col("score") / math.log10(2) / F.col("n_bytes")
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(in_all).cast("long").alias("train_tokens"), "base_score", "score", per_byte.alias("bits_per_byte"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"))
