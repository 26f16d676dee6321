"""Online logistic mixing of hashed-context bit predictors over streams of symbols that lie in many blocks.

A symbol is a path of binary decisions through a Huffman tree.  Each decision is predicted by
the symbol's overall counts and by four hashed contexts: something near, and the last one, two
and four symbols.  A context's slot holds how often each branch was taken there; the log odds
of all are mixed by weights of a gate, which is chosen by how much the other three contexts
have seen and by whether something near is known, and the mix is refined by an adaptive probability map.  Weights and map are learned
online: a batch of decisions is predicted, then learned.  A training symbol is predicted from
the counts without itself, as if it came last; the others from all counts.

Every record (a symbol with its contexts) is sent to the bucket of its last symbol, so that a
bucket sees all that the corpus holds of its contexts, whatever document it stands in: the
number of buckets grows with the corpus, and with it all that is gathered.  Contexts that
would fill a bucket are divided by the symbol before it, and by the block where even that one
is too frequent; a share of a bucket's size is left in each part.  The layout follows from
counts of training records alone.  Equal records of a bucket are worked on once, in the order of
their hashes, so results depend neither on the partitioning nor on records that aren't
learned.

Records travel as packed columns, one row for each block and bucket.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import added, in_pieces, struct, write_table

#: Training records of a bucket, and bounds of the number of cells that are counted for the layout.
BUCKET, LEAST_CELLS, MOST_CELLS = 1 << 18, 1 << 12, 1 << 20
CONTEXTS = 4  # near, one, two and four symbols back
INPUTS = CONTEXTS + 2  # the overall counts and a constant
LEVELS = 4
GATES, MAP_STEPS = 2 * LEVELS**3, 33
#: ``near`` where there is none, and the length from which on planes are compressed apart.
NONE, SHORT_PLANE = 0xFFFF, 1024
START_WEIGHTS = (0.35, 0.0, 0.45, 0.3, 0.35, 0.4)
CLOSE, RATE, MAP_PRIOR = 0.4, 0.3, 30
BATCH = 4096  # records that are predicted before they are learned
PORTION = 1 << 18  # records that are dealt to buckets in one go
SEEN_BITS, LEAST_SLOTS, MOST_SLOTS = 21, 20, 23
LEAST_P = 1e-6

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x *= _K[0]
    x ^= x >> np.uint64(29)
    x *= _K[1]
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Code:
    """Huffman code: the decisions (2 x node + branch) of symbol s are those from ``begin[s]`` to ``begin[s + 1]``; ``odds``: log odds of a node's branches by all counts."""

    begin: np.ndarray
    path: np.ndarray
    odds: np.ndarray

    @staticmethod
    def over(counts: np.ndarray) -> Code:
        n = len(counts)
        heap = [(int(c) + 1, k) for k, c in enumerate(counts)]  # every symbol gets a path
        if n == 1:
            heap.append((1, 1))
        heapq.heapify(heap)
        fresh = len(heap)
        above: dict[int, tuple[int, int]] = {}
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            above[a[1]], above[b[1]] = (fresh, 0), (fresh, 1)
            heapq.heappush(heap, (a[0] + b[0], fresh))
            fresh += 1
        first = max(2, n)
        depth = np.zeros(fresh, np.int64)
        for k in range(fresh - 2, -1, -1):
            depth[k] = depth[above[k][0]] + 1
        begin = np.concatenate([[0], np.cumsum(depth[:n])])
        path = np.zeros(begin[-1], np.int32)
        up = np.array([above[k][0] if k in above else k for k in range(fresh)])
        side = np.array([above[k][1] if k in above else 0 for k in range(fresh)])
        at, left = np.arange(n), depth[:n].copy()
        while (going := np.flatnonzero(left)).size:
            left[going] -= 1
            place = begin[going] + left[going]
            path[place] = (up[at[going]] - first) * 2 + side[at[going]]
            at[going] = up[at[going]]
        held = np.bincount(path, weights=np.repeat(np.asarray(counts, float), depth[:n]), minlength=2 * (fresh - first)).reshape(-1, 2)
        return Code(begin, path, np.clip(np.log((held[:, 1] + CLOSE) / (held[:, 0] + CLOSE)), -9, 9).astype(np.float32))

    def paths(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each symbol's decisions, all decisions)."""
        first = self.begin.take(symbols)
        many = self.begin.take(symbols + 1) - first
        ends = np.cumsum(many)
        at = np.repeat(first - ends + many, many)
        at += np.arange(len(at))
        return many, self.path.take(at)

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``symbols``, node, branch) of all decisions."""
        many, path = self.paths(symbols)
        return np.repeat(np.arange(len(symbols)), many), path >> 1, path & 1


@dataclass
class Records:
    """Symbols with their contexts: ``near``, ``one`` (the symbol before), ``two`` (that before it), ``more`` (16 bits of those before these)."""

    symbol: np.ndarray
    held: np.ndarray  # not learned
    near: np.ndarray
    one: np.ndarray
    two: np.ndarray
    more: np.ndarray
    owner: np.ndarray  # whose probability it adds to; rising

    def take(self, at: np.ndarray | slice) -> Records:
        return Records(*(getattr(self, k)[at] for k in self.__dataclass_fields__))

    def rows(self) -> np.ndarray:
        """Bytes of all columns, a row each, so that dealing a record out touches one place."""
        out = np.empty(len(self.symbol), _ROW)
        out["symbol"] = (self.symbol.astype("<u4") << 1) | self.held
        for k, _ in (*_COLUMNS, ("owner", "")):
            out[k] = getattr(self, k)
        return out.view(np.uint8).reshape(-1, _ROW.itemsize)

    def pack(self) -> bytes:
        return Records.pack_rows(self.rows())

    @staticmethod
    def pack_rows(rows: np.ndarray) -> bytes:
        """Some of ``rows()``, which are changed."""
        owner = rows.view(_ROW)["owner"]
        owner[1:] = np.diff(owner, axis=0)
        return len(rows).to_bytes(4, "little") + _compressed([*np.ascontiguousarray(rows.T)], len(rows))

    @staticmethod
    def unpack(packs: list[bytes]) -> tuple[Records, np.ndarray]:
        """All records of several packs, and how many each has."""
        sizes = [int.from_bytes(p[:4], "little") for p in packs]
        kinds = ["<u4", *(t for _, t in _COLUMNS), "<u4"]
        found = [unpack(p[4:], [(n, t) for t in kinds]) for p, n in zip(packs, sizes, strict=True)]
        owner = np.concatenate([np.cumsum(x[-1].astype(np.int64)) for x in found])
        symbol, *rest = (np.concatenate(c) for c in list(zip(*found, strict=True))[:-1])
        return Records((symbol >> 1).astype(np.int64), (symbol & 1).astype(bool), *rest, owner), np.array(sizes)


_COLUMNS = (("near", "<u2"), ("one", "<u4"), ("two", "<u4"), ("more", "<u2"))
_ROW = np.dtype([("symbol", "<u4"), *_COLUMNS, ("owner", "<u4")])


def pack(columns: list[np.ndarray]) -> bytes:
    """Numbers by planes of bytes; each plane is compressed alone, as each has frequencies of its own, unless they are short."""
    planes = [p for c in columns for p in np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T] if len(columns[0]) else []
    return _compressed(planes, len(columns[0]))


def _compressed(planes: list[np.ndarray], n: int) -> bytes:
    if n < SHORT_PLANE:
        planes = [np.concatenate(planes)] if planes else []
    found = [pa.compress(np.ascontiguousarray(p), "zstd", asbytes=True) for p in planes]
    return np.array([len(f) for f in found], "<u4").tobytes() + b"".join(found)


def unpack(data: bytes, columns: list[tuple[int, str]]) -> list[np.ndarray]:
    """Columns of these lengths and types."""
    widths = [np.dtype(t).itemsize for _, t in columns]
    if not columns[0][0]:
        return [np.zeros(0, t) for _, t in columns]
    sizes = [n for (n, _), w in zip(columns, widths, strict=True) for _ in range(w)]
    if columns[0][0] < SHORT_PLANE:
        sizes = [sum(sizes)]
    ends = np.cumsum([4 * len(sizes), *np.frombuffer(data, "<u4", len(sizes))]).tolist()
    raw = np.concatenate([np.frombuffer(pa.decompress(data[a:b], n, "zstd"), np.uint8) for a, b, n in zip(ends, ends[1:], sizes, strict=False)])
    out, at = [], 0
    for (n, t), width in zip(columns, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + width * n].reshape(width, n).T).view(t).ravel())
        at += width * n
    return out


def _level(seen: np.ndarray) -> np.ndarray:
    """0, 1, 2-7, more."""
    return (seen > 0.5).view(np.uint8) + (seen > 1.5).view(np.uint8) + (seen > 7.5).view(np.uint8)


#: Records as ``Mixer._read`` has them.
_Read = tuple[np.ndarray, np.ndarray, list[tuple[slice, np.ndarray]]]


class Mixer:
    """What a bucket knows of its contexts, and the weights and map it has learned."""

    def __init__(self, code: Code):
        self.code = code
        self.weights = np.repeat(np.array(START_WEIGHTS, np.float32)[:, None], GATES, 1)
        self.seen = np.zeros((2, GATES * MAP_STEPS))
        self.batches = 0

    def log10s(self, r: Records) -> np.ndarray:
        """log10 probability of each record, learned and predicted as the module says."""
        one = mix(r.one.astype(np.uint64) + _K[2])
        two = mix(one + r.two.astype(np.uint64) * _K[3])
        four = mix(two + r.more.astype(np.uint64) * _K[4])
        near = mix(r.near.astype(np.uint64) + _K[1])
        keys, training, known = [near, one, two, four], ~r.held, r.near != NONE
        asks, alone = [known], [np.zeros(len(known), bool)]
        for key in keys[1:]:
            found = _shared(key, training, asks[-1] if len(asks) > 1 else np.ones(len(known), bool))
            asks.append(found[0])
            alone.append(found[1])
        ident = mix((near ^ r.symbol.astype(np.uint64)) * _K[2] ^ one)
        for key, own in zip(keys[1:], asks[1:], strict=True):  # a context that no other has tells nothing, so records that differ in it alone are equal
            ident ^= np.where(own, key, np.uint64(0))
        ident = mix(ident) >> np.uint64(1)
        ident |= r.held.astype(np.uint64) << np.uint64(63)  # training records come first
        first, inverse, many = _distinct(ident)
        n = int(training[first].sum())
        steps = [*_steps(0, n), *_steps(n, len(first))]
        kind = sum(own[first].astype(np.uint8) for own in asks[1:])
        kind = np.where(known[first], kind, 7 - kind)  # a batch in this order has all that a context is asked for in one stretch
        order = np.concatenate([np.zeros(0, np.int64), *(a + np.argsort(kind[a:b], kind="stable") for a, b in steps)])
        first = first[order]
        self.symbol = r.symbol[first]
        self.many = many[order].astype(np.float32)
        self.keys = [k[first] for k in keys]
        self.asks = [a[first] for a in asks]
        depth = np.diff(self.code.begin)[self.symbol[:n]]
        sizes = [min(MOST_SLOTS, max(LEAST_SLOTS, int(depth[own[:n]].sum()).bit_length())) for own in self.asks]
        self.tables = [(size, np.zeros(1 << size, np.complex64)) for size in sizes]  # branch 0 real, branch 1 imaginary: one look-up for both
        read = [self._count(a, b) for a, b in steps if b <= n]
        out = np.empty(len(first))
        for (a, b), found in zip(steps, read, strict=False):
            out[order[a:b]] = self._batch(a, b, found, True)
        del read
        other = np.flatnonzero(np.logical_or.reduce(alone))  # contexts of one training record tell the others something
        self._count_alone(keys, alone, r.symbol, other)
        for a, b in steps:
            if a >= n:
                out[order[a:b]] = self._batch(a, b, self._read(a, b), False)
        return out[inverse]

    def _read(self, a: int, b: int) -> _Read:
        """The records a to b: (number of each one's decisions, decisions, for each context the stretch of these it is asked for and their slots)."""
        many, path = self.code.paths(self.symbol[a:b])
        begin = np.concatenate([[0], np.cumsum(many)])
        node = (path >> 1).astype(np.uint64) * _K[3]
        places = []
        for key, asks, (size, _) in zip(self.keys, self.asks, self.tables, strict=True):
            own = np.flatnonzero(asks[a:b])
            x, y = (own[0], own[-1] + 1) if len(own) else (0, 0)
            at = slice(begin[x], begin[y])
            places.append((at, _slots(np.repeat(key[a + x : a + y], many[x:y]), node[at], size).astype(np.int32)))
        return many, path, places

    def _count(self, a: int, b: int) -> _Read:
        """Add the branches that the training records a to b take to what each context has seen; returns what was read, which is read but once."""
        many, path, places = found = self._read(a, b)
        branch, mass = path & 1, np.repeat(self.many[a:b], many)
        for (at, slots), (_, table) in zip(places, self.tables, strict=True):
            np.add.at(table.view(np.float32), ((slots << 1) | branch[at]).astype(np.int64), mass[at])
        return found

    def _count_alone(self, keys: list[np.ndarray], which: list[np.ndarray], symbol: np.ndarray, at: np.ndarray) -> None:
        """Add the branches that the records ``at`` take to what each context has seen, for the records that ``which`` holds for."""
        for a, b in _steps(0, len(at)):
            own = at[a:b]
            record, node, branch = self.code.decisions(symbol[own])
            for key, kept, (size, table) in zip(keys, which, self.tables, strict=True):
                if (kept := kept[own]).any():
                    x = np.flatnonzero(kept.take(record))
                    slots = _slots(key[own].take(record[x]), node[x].astype(np.uint64) * _K[3], size)
                    np.add.at(table.view(np.float32), (slots << 1) | branch[x], np.float32(1))

    def _batch(self, a: int, b: int, read: _Read, learn: bool) -> np.ndarray:
        many, path, places = read
        bit = (path & 1).astype(np.float32)
        rest = 1 - bit
        gate = np.zeros(len(path), np.uint8)  # 128 of them
        inputs = [(slice(None), self.code.odds.take(path >> 1)), (slice(None), np.float32(0.3))]
        for k, ((at, slots), (_, table)) in enumerate(zip(places, self.tables, strict=True)):
            found = table.take(slots)
            n0, n1 = found.real, found.imag
            if learn:  # each has been counted itself
                n0, n1 = n0 - rest[at], n1 - bit[at]
            gate[at] += np.uint8(LEVELS**3) if k == 0 else _level(n0 + n1) * np.uint8(LEVELS ** (k - 1))
            x = n1 + np.float32(CLOSE)
            x /= n0 + np.float32(CLOSE)
            inputs.append((at, np.clip(np.log(x, out=x), -9, 9, out=x)))
        gate = gate.astype(np.int64)
        mixed = np.zeros(len(path), np.float32)
        for weights, (at, x) in zip(self.weights, inputs, strict=True):
            mixed[at] += weights.take(gate[at]) * x
        np.clip(mixed, -12, 12, out=mixed)
        p = 1 / (1 + np.exp(-mixed))
        cell = gate * MAP_STEPS + np.rint((mixed + 12) * np.float32((MAP_STEPS - 1) / 24)).astype(np.int64)
        whole = self.seen[0] + self.seen[1] + MAP_PRIOR
        refined = (self.seen[1] / whole / 2).astype(np.float32).take(cell) + p * ((1 + MAP_PRIOR / whole) / 2).astype(np.float32).take(cell)
        taken = np.clip(np.abs(refined - rest), np.float32(LEAST_P), np.float32(1 - LEAST_P))
        out = np.add.reduceat(np.log10(taken).astype(np.float64), np.cumsum(many) - many)  # each has a decision
        if learn:
            mass = np.repeat(self.many[a:b], many)
            error = (bit - p) * mass
            step = RATE / np.sqrt(1 + self.batches / 8) / np.maximum(np.bincount(gate, weights=mass, minlength=GATES), 100)
            for weights, (at, x) in zip(self.weights, inputs, strict=True):
                weights += step * np.bincount(gate[at], weights=error[at] * x, minlength=GATES)
            self.seen[1] += (ones := np.bincount(cell, weights=mass * bit, minlength=GATES * MAP_STEPS))
            self.seen[0] += np.bincount(cell, weights=mass, minlength=GATES * MAP_STEPS) - ones
            self.batches += 1
        return out


def _distinct(ident: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the distinct numbers, rising: (a place of each, the place among them of each of ``ident``, how often each is there); ``np.unique`` sorts stably, which takes longer."""
    order = np.argsort(ident)
    found = ident[order]
    fresh = np.ones(len(ident), bool)
    np.not_equal(found[1:], found[:-1], out=fresh[1:])
    begin = np.flatnonzero(fresh)
    inverse = np.empty(len(ident), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return order[begin], inverse, np.diff(begin, append=len(ident))


def _shared(key: np.ndarray, training: np.ndarray, wider: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records whose context other ones have learned, and training records whose context only others have that don't learn (by cells of hashes, so a few more); ``wider``: the former of the context it is a part of."""
    cell = (key >> np.uint64(64 - SEEN_BITS)).view(np.int64)
    learned = np.bincount(cell[training], minlength=1 << SEEN_BITS).take(cell)
    told = np.zeros(1 << SEEN_BITS, bool)
    told[cell[~training]] = True
    asks = (learned > training) & wider
    return asks, training & ~asks & told.take(cell)


def _steps(first: int, end: int) -> Iterator[tuple[int, int]]:
    return ((a, min(end, a + BATCH)) for a in range(first, end, BATCH))


def _slots(key: np.ndarray, node: np.ndarray, size: int) -> np.ndarray:
    """Place in a table of 2^size, by the hashes of contexts and of nodes."""
    x = key ^ node
    x ^= x >> np.uint64(31)
    x *= _K[0]
    x >>= np.uint64(64 - size)
    return x.view(np.int64)


@dataclass
class Layout:
    """Buckets of the cells of the last symbol, and of those of the last two where a cell of the last one has too much."""

    first: np.ndarray  # -1: see second
    second: np.ndarray
    parts: np.ndarray  # buckets over which the blocks of a cell of the last two are dealt

    @staticmethod
    def cells(one: np.ndarray, two: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        a = mix(one.astype(np.uint64) + _K[4])
        b = mix(a + two.astype(np.uint64) * _K[2])
        return (a & np.uint64(n - 1)).astype(np.int64), (b & np.uint64(n - 1)).astype(np.int64)

    @staticmethod
    def of(counts: np.ndarray, bucket: int) -> Layout:
        """``counts``: 2 x cells, of the last symbol and of the last two."""
        fits = counts[0] <= bucket
        first = np.where(fits, (np.cumsum(np.where(fits, counts[0], 0)) - 1).clip(0) // bucket, -1)
        parts = np.maximum(1, -(-counts[1] // bucket))
        share = counts[0][~fits].sum() / max(1, counts[0].sum())  # of the records that need the second
        alone = parts > 1
        second = np.where(alone, 0, (np.cumsum(np.where(alone, 0, counts[1])) * share).astype(np.int64) // bucket)
        second[alone] = second.max(initial=0) + 1 + np.cumsum(parts[alone]) - parts[alone]
        return Layout(first, second + first.max(initial=-1) + 1, parts)

    def buckets(self, r: Records, block: int) -> np.ndarray:
        salt = int(mix(np.array([block], np.uint64))[0] >> np.uint64(8))
        out = np.empty(len(r.one), np.int32)
        for start in range(0, len(out), PORTION):
            a, b = Layout.cells(r.one[start : start + PORTION], r.two[start : start + PORTION], len(self.first))
            found = self.first[a]
            more = np.flatnonzero(found < 0)
            cell = b[more]
            found[more] = self.second[cell] + salt % self.parts[cell]
            out[start : start + PORTION] = found
        return out


def layout_of(stream: DataFrame, records: Callable[[int, bytes], Records], training: int, bucket: int = BUCKET) -> Layout:
    """Layout of the records in ``stream`` (block, body), of which ``training`` are learned."""
    cells = LEAST_CELLS
    while cells < min(MOST_CELLS, 64 * training // bucket):
        cells *= 2

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, cells), np.int64)
        for part in parts:
            for block, body in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                r = records(block, body.as_py())
                for start in range(0, len(r.one), PORTION):
                    own = slice(start, start + PORTION)
                    learned = ~r.held[own]
                    for k, cell in enumerate(Layout.cells(r.one[own][learned], r.two[own][learned], cells)):
                        total[k] += np.bincount(cell, minlength=cells)
        yield in_pieces(total.ravel())

    found = added(stream.mapInArrow(run, struct("piece long, numbers binary"))).collect()  # 2 x cells numbers
    counts = np.concatenate([np.frombuffer(r["numbers"], np.int64) for r in sorted(found, key=lambda r: r["piece"])]) if found else np.zeros(2 * cells, np.int64)
    return Layout.of(counts.reshape(2, cells), bucket)


def mixed(stream: DataFrame, records: Callable[[int, bytes], Records], code: Code, training: int, name: str, bucket: int = BUCKET) -> DataFrame:
    """A written table ``block, sums``: log10 probabilities of the records in ``stream`` (block, body), summed by owner (``sums_of`` reads them), a row per block and bucket."""
    spark = stream.sparkSession
    layout = spark.sparkContext.broadcast(layout_of(stream, records, training, bucket))  # of a bounded size
    shared = spark.sparkContext.broadcast(code)
    schema = struct("bucket long, block long, pack binary")

    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block, body in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                r = records(block, body.as_py())
                if not len(r.symbol):
                    continue
                to = layout.value.buckets(r, block)
                rows = r.rows()
                del r
                order = np.argsort(to.astype(np.uint16) if to.max() < 1 << 16 else to, kind="stable")  # 16 bits are sorted by counting
                to = to[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
                packs = [Records.pack_rows(rows.take(order[a:b], axis=0)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # no second copy of all rows
                to = to[cuts[:-1]].astype(np.int64)
                del rows, order
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(len(packs), block)), pa.array(packs, pa.binary())], names=schema.names)

    def work(table: pa.Table) -> pa.Table:
        blocks = np.asarray(table["block"])
        r, sizes = Records.unpack(table["pack"].to_pylist())
        del table
        pa.default_memory_pool().release_unused()
        found = Mixer(shared.value).log10s(r)
        fresh = np.diff(r.owner, prepend=-1) != 0
        begin = np.cumsum(sizes) - sizes
        fresh[begin] = True  # no pack is empty
        first = np.flatnonzero(fresh)
        owner, scores, sums = r.owner[first], np.add.reduceat(found, first).astype("<f4"), []
        cuts = np.searchsorted(first, [*begin, len(fresh)]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            sums.append((b - a).to_bytes(4, "little") + pack([np.diff(owner[a:b], prepend=0).astype("<u4"), scores[a:b]]))
        return pa.table({"block": blocks, "sums": pa.array(sums, pa.binary())})

    routed = stream.mapInArrow(route, schema)
    out = write_table(routed.groupBy("bucket").applyInArrow(work, struct("block long, sums binary")), name)
    layout.destroy()
    shared.destroy()
    return out


def sums_of(parts: list[bytes], n: int) -> np.ndarray:
    """Sums of a block's owners from all its ``sums``."""
    out = np.zeros(n)
    for part in parts:
        many = int.from_bytes(part[:4], "little")
        owner, score = unpack(part[4:], [(many, "<u4"), (many, "<f4")])
        out[np.cumsum(owner)] += score  # an owner is there once
    return out
