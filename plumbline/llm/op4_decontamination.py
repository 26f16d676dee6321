"""Benchmark decontamination by spaced-seed hashing.

Texts become words (white-space tokens, lower case, outer punctuation off).  Fixed masks pick
some of the positions of a run of words and hash those alone, so a seed still hits where the
other words were replaced.  Seeds of documents are looked up among the seeds of the benchmark;
around each hit the two texts are laid over each other and the stretches with at most one
replaced word to four equal ones are measured.  A document overlaps an item if one stretch has
at least half of the item's words equal or thirteen of them, and ten (or four fifths of a short
item); or if all stretches of six equal words and more, wherever they lie, have half of the item's
words (and ten) together; their equal words and lengths are added up, the first one gives the places.

Items of fewer than 18 words have lighter seeds too, and equal words count over the whole of the
item instead: as the texts lie, else over neighbouring places, for words put in or left out.

A benchmark of a bounded size is sent to all tasks, with its seeds sorted, so that documents
are not shuffled.  A larger one is joined: documents send the seeds that a bitmap of the
benchmark's seeds lets through to a hash join with these, and each pair found is verified.
Either way a document is read once, and the rows are the same.

Seeds that repeat within a text, however often, mark places in a bitmap of a text's length, and
places at which a text and an item agree in the same words are looked at once, so time and memory
are in proportion to the text.  Of stretches that are equally good the last one is given.

Null and empty texts and items, and items of fewer than five words, overlap nothing.  Repeated
rows repeat their results; null ids are kept as they are; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from plumbline.llm.common import again, blocks, free_name, load, struct, write_table

#: 1: the position counts, 0: it is ignored. Six of six to fourteen words; the light ones are for short items.
MASKS = ("111000111", "1101001011", "10110010101001", "1100101000110", "111111")
LIGHT_MASKS = ("111", "11011")
LEAST_WORDS, SHORT_WORDS = 5, 18
SHARE, ENOUGH, SHORT_SHARE, PENALTY = 0.5, 10, 0.8, 4
#: Equal words of one stretch that suffice in any item, and of a stretch that is added to others.
LONG_STRETCH, LEAST_STRETCH = 13, 6
HITS = 1 << 16
#: Pairs of seeds that are listed; more are marked in a bitmap. Places of a long item that are looked at one by one; of more, like ones once.
LISTED_PAIRS, MOST_PLACES = 1 << 20, 64
#: Bits of the bitmap of a joined benchmark's seeds, at most and for each seed, and how it is cut.
FILTER_BITS, SEED_BITS, FILTER_PARTS = 27, 16, 64
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 8 << 20
CACHE_WORDS, TEXT_BYTES = 400_000, 2 << 20

OVERLAPS = "doc_id long, item_id long, matched long, span long, item_words long, doc_start long, item_start long"

_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»“”‘’„…–—"
_FILTER_BITS = 20
with np.errstate(over="ignore"):
    _FACTORS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Words(dict):
    """token -> number; ``hashes[number]`` is the word's hash, 0 where nothing is left of the token."""

    def __init__(self):
        super().__init__()
        self.made: list[int] = []
        self.hashes = np.zeros(0, np.uint64)

    def __missing__(self, token: str) -> int:
        word = token.strip(_EDGES)
        self.made.append(xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) | 1 if word else 0)
        self[token] = at = len(self.made) - 1
        return at

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Hashes of the words of each text, in order."""
        if len(self) > CACHE_WORDS:
            self.clear()
            self.made, self.hashes = [], np.zeros(0, np.uint64)
        numbers, sizes = [], []
        for text in texts:
            tokens = text.lower().split()
            sizes.append(len(tokens))
            numbers += map(self.__getitem__, tokens)
        if len(self.hashes) < len(self.made):
            self.hashes = np.concatenate([self.hashes, np.array(self.made[len(self.hashes) :], np.uint64)])
        found = self.hashes[np.array(numbers, np.int64)]
        return [part[part != 0] for part in np.split(found, np.cumsum(sizes)[:-1])] if texts else []


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked words from each place on."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, on in enumerate(mask):
        if on == "1":
            total += words[j : j + n] * _FACTORS[j % 64]
    total ^= total >> np.uint64(29)
    return total * np.uint64(0xBF58476D1CE4E5B9)


class Benchmark:
    """Seeds of a block of items, sorted, by mask."""

    def __init__(self, items: list[tuple[int | None, str]], masks: tuple[str, ...] = MASKS):
        held = [(k, w) for (k, _), w in zip(items, Words().of([t for _, t in items]), strict=True) if len(w) >= LEAST_WORDS]
        self._fill([k for k, _ in held], [w for _, w in held], masks)

    @classmethod
    def of(cls, ids: list[int | None], words: list[np.ndarray]) -> Benchmark:
        """Items whose words are hashed already."""
        out = cls.__new__(cls)
        out._fill(ids, words, MASKS)
        return out

    def _fill(self, ids: list[int | None], words: list[np.ndarray], masks: tuple[str, ...]) -> None:
        self.ids, self.words = ids, words
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.sizes, half = sizes, np.ceil(sizes * SHARE)
        least = np.minimum(np.ceil(sizes * SHORT_SHARE - 1e-9), ENOUGH)
        self.need = np.maximum(half, least).astype(np.int64)  # of all stretches together
        self.need_one = np.maximum(np.minimum(half, LONG_STRETCH), least).astype(np.int64)
        self.short = sizes < SHORT_WORDS
        self.padded = np.zeros((len(sizes), SHORT_WORDS), np.uint64)  # of the short ones; no word is zero
        for i in np.flatnonzero(self.short):
            self.padded[i, : sizes[i]] = self.words[i]
        self.tables = []
        for mask in (*masks, *LIGHT_MASKS):
            own = [i for i in range(len(sizes)) if mask in masks or self.short[i]]
            found = [seeds(self.words[i], mask) for i in own]
            if not sum(map(len, found)):
                continue
            hashes = np.concatenate(found)
            item = np.repeat(own, [len(f) for f in found])
            at = np.concatenate([np.arange(len(f)) for f in found])
            order = np.argsort(hashes, kind="stable")
            likely = np.zeros(1 << _FILTER_BITS, bool)
            likely[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables.append((mask, hashes[order], item[order], at[order], likely))

    def overlaps(self, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, equal words, length, place here, place in the item) of the best stretch with each overlapping item, or of all together."""
        found = []
        for item, shift in self._places(words):
            short = self.short[item]
            found += self._short(words, item[short], shift[short]) if short.any() else []
            item, shift = item[~short], shift[~short]
            cuts = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
            for a, b in zip(cuts, cuts[1:], strict=False):
                found += self._long(int(item[a]), words, shift[a:b])
        return found

    def _places(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, shifts) at which seeds of the items lie on equal ones of a text; all of an item together, rising."""
        hits = []
        for k, (mask, hashes, _, _, likely) in enumerate(self.tables):
            own = seeds(words, mask)
            place = np.flatnonzero(likely[own >> np.uint64(64 - _FILTER_BITS)])
            low = np.searchsorted(hashes, own[place], "left")
            many = np.searchsorted(hashes, own[place], "right") - low
            kept = many > 0
            if kept.any():
                hits.append((k, place[kept], low[kept], many[kept]))
        if sum(int(many.sum()) for *_, many in hits) <= LISTED_PAIRS:
            pairs = []
            for k, place, low, many in hits:
                _, _, item, at, _ = self.tables[k]
                hit = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                pairs.append(item[hit].astype(np.int64) << 32 | (np.repeat(place, many) - at[hit] + (1 << 31)))
            if pairs:
                pair = np.unique(np.concatenate(pairs))
                yield pair >> 32, (pair & 0xFFFFFFFF) - (1 << 31)
            return
        # Seeds that repeat: each distinct one once, with all its places here and all those in an item.
        uses: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, place, low, many in hits:
            _, _, item, at, _ = self.tables[k]
            order = np.argsort(low, kind="stable")
            place, low, many = place[order], low[order], many[order]
            cuts = np.flatnonzero(np.diff(low, prepend=-1, append=-1))
            for a, b in zip(cuts, cuts[1:], strict=False):
                for j in range(int(low[a]), int(low[a] + many[a])):
                    uses.setdefault(int(item[j]), []).append((place[a:b], int(at[j])))
        for i in sorted(uses):
            n = len(self.words[i])
            marked = np.zeros(len(words) + n, bool)
            for place, at in uses[i]:
                marked[place - at + n] = True
            shift = np.flatnonzero(marked) - n
            yield np.full(len(shift), i), shift

    def _long(self, i: int, words: np.ndarray, shifts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The overlap with an item, if there is one: its best stretch, or all its stretches."""
        item, best, parts = self.words[i], (i, 0), []
        covered = np.zeros(len(item), bool)
        for shift in (shifts if len(shifts) <= MOST_PLACES else _unlike(item, words, shifts)).tolist():
            a, b = max(0, -shift), min(len(item), len(words) - shift)
            equal = item[a:b] == words[a + shift : b + shift]
            for matched, start, end in _stretches(equal):
                best = max(best, (i, matched, end - start, a + shift + start, a + start))
                if not covered[a + start : a + end].all():
                    parts.append((a + shift + start, a + start, end - start))
                    covered[a + start : a + end] |= equal[start:end]
        if best[1] >= self.need_one[i]:
            return [best]
        matched = int(covered.sum())
        return [(i, matched, sum(n for *_, n in parts), *min(parts)[:2])] if matched >= self.need[i] else []

    def _short(self, words: np.ndarray, item: np.ndarray, shift: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The overlaps with short items: equal words over the whole of an item, at one place or at neighbouring ones."""
        edge = np.full(SHORT_WORDS, 2, np.uint64)  # hashes are odd
        around, across = np.concatenate([edge, words, edge]), np.arange(SHORT_WORDS)
        equal = np.empty((len(item), SHORT_WORDS), bool)
        for k in range(0, len(item), HITS):
            equal[k : k + HITS] = self.padded[item[k : k + HITS]] == around[(shift[k : k + HITS] + SHORT_WORDS)[:, None] + across]
        count = equal.sum(1)
        enough = np.flatnonzero(count >= self.need[item])
        start = equal[enough].argmax(1)
        span = SHORT_WORDS - equal[enough][:, ::-1].argmax(1) - start
        columns = [item[enough], count[enough], span, shift[enough] + start, start]
        order = np.lexsort(columns[::-1])
        best = {row[0]: row for row in zip(*(c[order].tolist() for c in columns), strict=True)}  # the last, best one of each item stays
        # Places of one item at most a quarter of its words apart.
        drift = np.maximum(2, self.sizes[item] // 4)
        last = np.searchsorted(item << 32 | (shift + (1 << 31)), item << 32 | (shift + drift + (1 << 31)), "right")
        runs = equal & np.pad(equal, ((0, 0), (1, 0)))[:, :-1] | equal & np.pad(equal, ((0, 0), (0, 1)))[:, 1:]  # no words alone
        total = np.concatenate([[0], np.cumsum(runs.sum(1))])
        seen: set[tuple[int, bytes]] = set()
        for k in np.flatnonzero((last - np.arange(len(item)) > 1) & (total[last] - total[:-1] >= self.need[item]) & (count < self.need[item])).tolist():
            i = int(item[k])
            alike = i, np.diff(shift[k : last[k]]).tobytes() + runs[k : last[k]].tobytes()
            if alike in seen:
                continue
            seen.add(alike)
            part = _in_order(runs[k : last[k]])
            matched = int(part.any(0).sum())
            if matched >= self.need[i] and matched > best.get(i, (i, 0))[1]:
                row, col = np.nonzero(part)
                here = shift[k : last[k]][row] + col
                first = int(here.argmin())
                best[i] = (i, matched, int(here.max() - here.min()) + 1, int(here[first]), int(col[first]))
        return list(best.values())


def _unlike(item: np.ndarray, words: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The first and the last of the shifts at which the same words of an item are equal, of those with enough words."""
    n = len(item)
    edge = np.zeros(n, np.uint64)  # no word is zero
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, words, edge]), n)
    marks: dict[bytes, list[int]] = {}
    step = max(1, (1 << 20) // n)
    for k in range(0, len(shifts), step):
        part = shifts[k : k + step]
        equal = around[part + n] == item
        full = np.flatnonzero(equal.sum(1) >= LEAST_STRETCH)
        packed = np.packbits(equal[full], axis=1)
        rows, first = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_index=True)
        _, last = np.unique(packed[::-1].view(f"V{packed.shape[1]}").ravel(), return_index=True)
        for row, a, b in zip(rows.tolist(), part[full[first]].tolist(), part[full[len(full) - 1 - last]].tolist(), strict=True):
            marks[row] = [min(a, marks[row][0]), max(b, marks[row][1])] if row in marks else [a, b]
    return np.unique(np.array([x for pair in marks.values() for x in pair], np.int64))


def _in_order(runs: np.ndarray) -> np.ndarray:
    """Of the equal words at rising places, those of a way through the item on which the places only rise or only fall: the longer way."""
    ways = []
    for rows in (runs, runs[::-1]):
        score, back = np.zeros(len(rows), np.int64), np.zeros(rows.shape, np.int64)
        for j in range(rows.shape[1]):
            top = np.maximum.accumulate(score)
            reach = np.where(score == top, np.arange(len(rows)), 0)
            back[:, j] = np.maximum.accumulate(reach)
            score = top + rows[:, j]
        at, way = int(score.argmax()), np.zeros(rows.shape, bool)
        whole = int(score[at])
        for j in reversed(range(rows.shape[1])):
            way[at, j] = rows[at, j]
            at = back[at, j]
        ways.append((whole, way if rows is runs else way[::-1]))
    return max(ways, key=lambda w: w[0])[1]


def _stretches(equal: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(equal words, start, end) of the best stretch, if it has enough words, and of the best ones beside it."""
    todo = [(0, len(equal))]
    while todo:
        a, b = todo.pop()
        part = equal[a:b]
        if int(part.sum()) < LEAST_STRETCH:
            continue
        sums = np.concatenate([[0], np.cumsum(np.where(part, 1, -PENALTY))])
        end = int((sums - np.minimum.accumulate(sums)).argmax())
        start = int(sums[: end + 1].argmin())
        matched = int(part[start:end].sum())
        if matched >= LEAST_STRETCH:
            yield matched, a + start, a + end
            todo += [(a, a + start), (a + end, b)]


def _items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    return benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())


def small(benchmark: DataFrame) -> list[tuple[int | None, str]] | None:
    """The items, if their texts have BLOCK_BYTES at most."""
    base = _items(benchmark)
    if (base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BLOCK_BYTES:
        return None
    return sorted(((r["item_id"], r["text"]) for r in base.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _rows(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per overlapping pair of document and item; see the module."""
    spark, schema = docs.sparkSession, struct(OVERLAPS)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = small(benchmark)
    if items is None:
        return joined(base, benchmark).select(*schema.names)
    held = spark.sparkContext.broadcast(Benchmark(items))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, index = Words(), held.value
        for part in parts:
            keys, bodies, rows = part.column(0).to_pylist(), [b or "" for b in part.column(1).to_pylist()], []
            for block in blocks(bodies, TEXT_BYTES):
                for i, own in zip(block, words.of([bodies[i] for i in block]), strict=True):
                    rows += [(keys[i], index.ids[item], m, n, len(index.words[item]), at, start) for item, m, n, at, start in index.overlaps(own)]
            if rows:
                yield _rows(rows, schema.names)

    return base.mapInArrow(run, schema)


def all_seeds(words: np.ndarray) -> np.ndarray:
    """Distinct seeds of a text under all masks; of a short one also under the light ones. Masks don't share seeds."""
    masks = (*MASKS, *LIGHT_MASKS)
    found = [seeds(words, mask) * np.uint64(2 * k + 1) for k, mask in enumerate(masks)]
    return np.unique(np.concatenate(found))


def joined(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The overlaps of ``docs`` (doc_id, text) by a hash join of seeds, with the text's digest as ``digest``."""
    spark = docs.sparkSession
    pieces = struct("item long, item_id long, words binary, seeds array<long>")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, at = Words(), TaskContext.get().partitionId() << 40
        for part in parts:
            rows = []
            for key, own in zip(part.column(0).to_pylist(), words.of(part.column(1).to_pylist()), strict=True):
                if len(own) >= LEAST_WORDS:
                    masks = (*MASKS, *LIGHT_MASKS)
                    kept = [seeds(own, mask) * np.uint64(2 * k + 1) for k, mask in enumerate(masks) if mask in MASKS or len(own) < SHORT_WORDS]
                    rows.append((at, key, own.tobytes(), np.unique(np.concatenate(kept)).view(np.int64)))
                    at += 1
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=pieces.names)

    items = write_table(_items(benchmark).mapInArrow(cut, pieces), "items")
    total = items.agg(F.sum(F.size("seeds"))).first()[0] or 0
    bits = min(FILTER_BITS, max(16, (SEED_BITS * total).bit_length()))
    size = (1 << bits) // FILTER_PARTS  # bits of a part of the bitmap

    def marks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(1 << bits, bool)
        for part in parts:
            marked[np.asarray(part.column(0).flatten()).view(np.uint64) >> np.uint64(64 - bits)] = True
        packed = [np.packbits(marked[k * size : (k + 1) * size]).tobytes() for k in range(FILTER_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(FILTER_PARTS), pa.int64()), pa.array(packed, pa.binary())], names=["part", "bits"])

    either = struct("part long, bits binary")
    union = lambda t: pa.table({"part": t["part"][:1], "bits": pa.array([np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t["bits"].to_pylist()]).tobytes()], pa.binary())})
    found = items.select("seeds").mapInArrow(marks, either).groupBy("part").applyInArrow(union, either).collect()  # 2^FILTER_BITS bits at most
    held = spark.sparkContext.broadcast(b"".join(r["bits"] for r in sorted(found, key=lambda r: r["part"])))
    likely = struct("row long, doc_id long, digest binary, words binary, seeds array<long>")

    def sift(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, at = Words(), TaskContext.get().partitionId() << 40
        marked = np.frombuffer(held.value, np.uint8)
        for part in parts:
            keys, bodies, rows = part.column(0).to_pylist(), [b or "" for b in part.column(1).to_pylist()], []
            for block in blocks(bodies, TEXT_BYTES):
                for i, own in zip(block, words.of([bodies[i] for i in block]), strict=True):
                    hashes = all_seeds(own)
                    cell = hashes >> np.uint64(64 - bits)
                    hashes = hashes[marked[cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1] if len(marked) else hashes[:0]
                    if len(hashes):
                        rows.append((at, keys[i], hashlib.md5(bodies[i].encode("utf-8", "replace"), usedforsecurity=False).digest(), own.tobytes(), hashes.view(np.int64)))
                        at += 1
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=likely.names)

    sifted = write_table(docs.mapInArrow(sift, likely), "sifted")
    here = sifted.select("row", F.explode("seeds").alias("seed"))
    there = items.select("item", F.explode("seeds").alias("seed"))
    pairs = here.join(there, "seed").select("row", "item").distinct()
    both = pairs.join(again(sifted).select("row", "doc_id", "digest", "words"), "row").join(again(items).select("item", "item_id", F.col("words").alias("sought")), "item")
    out = struct(f"{OVERLAPS}, digest binary")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Benchmark] = {}
        for part in parts:
            rows = []
            for item, item_id, doc, digest, body, sought in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if item not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[item] = Benchmark.of([item_id], [np.frombuffer(sought, np.uint64)])
                index = known[item]
                rows += [(doc, item_id, m, n, len(index.words[0]), at, start, digest) for _, m, n, at, start in index.overlaps(np.frombuffer(body, np.uint64))]
            if rows:
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=out.names)

    return both.select("item", "item_id", "doc_id", "digest", "words", "sought").mapInArrow(verify, out)


def overlap_counter(spark: SparkSession, items: list[tuple[int | None, str]]):
    """Column function text -> how many of ``items`` it overlaps."""
    held = spark.sparkContext.broadcast(Benchmark(items))  # a block at most

    @F.pandas_udf(LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words()
        for part in parts:
            bodies, out = [b or "" for b in part], []
            for block in blocks(bodies, TEXT_BYTES):
                out += [len(held.value.overlaps(own)) for own in words.of([bodies[i] for i in block])]
            yield pd.Series(out, dtype="int64")

    return count


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text overlaps no benchmark item."""
    items = small(benchmark)
    if items is not None:
        return docs.where(overlap_counter(docs.sparkSession, items)(F.col(text)) == 0)
    found = joined(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text")), benchmark)
    digest = free_name(docs, "digest")
    gone = write_table(found.select(F.col("digest").alias(digest)).distinct(), "gone")
    return docs.join(gone, F.unhex(F.md5(F.col(text).cast("binary"))) == F.col(digest), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
