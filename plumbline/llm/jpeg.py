"""Baseline JPEG in numpy: a lossless byte container and a DC-only decoder.

Container: one payload byte per 8x8 block, as its DC level (quantizer 8, so every pixel of
the block equals the byte), 64 blocks a row, one restart interval a row, no AC terms.  Any
baseline decoder shows the same grey blocks.  A payload longer than one image's 8191 rows
goes on in a further image of the same stream.

Decoder: any baseline (SOF0) scan that interleaves all components.  Markers are parsed per
image; the Huffman symbols of all restart intervals of a whole batch are read in lock step,
AC terms are skipped, and the luminance DC levels form a thumbnail of one pixel per block.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ROW = 64
MOST_ROWS = 8191
IMAGE_BYTES = ROW * MOST_ROWS

# Zigzag-free quantizer, DC code lengths and symbols of the public JPEG standard (annex K.3.1).
DC_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
# One AC code, end of block, one bit long.
AC_BITS = [1] + [0] * 15
AC_SYMBOLS = [0]
QUANTIZER = 8


def _codes(bits: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in the canonical order."""
    out, code, k = [], 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lookup(bits: list[int], symbols: list[int]) -> np.ndarray:
    """16 peeked bits -> length << 8 | symbol; 0 where no code matches."""
    table = np.zeros(1 << 16, np.uint16)
    for symbol, code, length in _codes(bits, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference from -255: its bits followed by end of block, and how many."""
    huff = {s: (c, n) for s, c, n in _codes(DC_BITS, DC_SYMBOLS)}
    value, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = huff[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        value[d + 255] = ((code << size) | extra) << 1  # the AC code of one 0 bit
        length[d + 255] = n + size + 1
    return value, length


_VALUE, _LENGTH = _difference_codes()


def _header(rows: int) -> bytes:
    segment = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    return (
        b"\xff\xd8"
        + segment(0xDB, b"\x00" + bytes([QUANTIZER] * 64))
        + segment(0xC0, b"\x08" + (rows * 8).to_bytes(2, "big") + (ROW * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00")
        + segment(0xC4, b"\x00" + bytes(DC_BITS) + bytes(DC_SYMBOLS))
        + segment(0xC4, b"\x10" + bytes(AC_BITS) + bytes(AC_SYMBOLS))
        + segment(0xDD, ROW.to_bytes(2, "big"))
        + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return payload + bytes(-len(payload) % ROW if payload else ROW)


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each padded payload as a stream of one or more baseline images."""
    rows_of = [len(p) // ROW for p in payloads]
    level = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int64) - 128
    step = level.copy()
    step[:, 1:] -= level[:, :-1]
    value, length = _VALUE[step + 255], _LENGTH[step + 255]
    ends = np.cumsum(length, axis=1)
    row_bytes = (ends[:, -1] + 7) >> 3
    row_at = np.concatenate([[0], np.cumsum(row_bytes)])
    start = ends - length
    at = (row_at[:-1, None] + (start >> 3)).ravel()
    wide = (value << (24 - length - (start & 7))).ravel()
    total = int(row_at[-1])
    packed = np.zeros(total + 2, np.int64)
    for k, shift in enumerate((16, 8, 0)):
        packed += np.bincount(at + k, weights=(wide >> shift) & 255, minlength=total + 2)[: total + 2].astype(np.int64)
    packed[row_at[1:] - 1] |= (1 << (row_bytes * 8 - ends[:, -1])) - 1  # rows end in 1 bits
    packed = packed[:total].astype(np.uint8)

    # Room for a stuffed 0 after each FF and for a marker of two bytes after each row.
    grown = np.ones(total, np.int64) + (packed == 0xFF)
    grown[row_at[1:] - 1] += 2
    place = np.cumsum(grown) - grown
    out = np.zeros(int(grown.sum()), np.uint8)
    out[place] = packed
    row_end = place[row_at[1:] - 1] + grown[row_at[1:] - 1]
    out[row_end - 2] = 0xFF
    images, first = [], 0
    for rows in rows_of:
        stream = []
        for top in range(0, rows, MOST_ROWS):
            n = min(MOST_ROWS, rows - top)
            a, b = first + top, first + top + n
            out[row_end[a : b - 1] - 1] = 0xD0 + np.arange(n - 1) % 8
            begin = row_end[a - 1] if a else 0
            stream += [_header(n), out[begin : row_end[b - 1] - 2].tobytes(), b"\xff\xd9"]
        images.append(b"".join(stream))
        first += rows
    return images


def images_of(stream: bytes) -> list[tuple[int, int]]:
    """Where each image of a stream begins and ends: an image ends with an EOI that a further SOI or nothing follows (in coded bytes FF is never followed by D9)."""
    cuts, at = [0], 0
    while (at := stream.find(b"\xff\xd9\xff\xd8\xff", at)) >= 0:
        at += 2
        cuts.append(at)
    return list(zip(cuts, [*cuts[1:], len(stream)], strict=True))


@dataclass
class _Image:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantizer table
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # of each component: DC, AC
    steps: list[int] = field(default_factory=list)
    interval: int = 0
    data: np.ndarray | None = None
    cuts: np.ndarray | None = None


_TABLES: dict[bytes, np.ndarray] = {}


def _parse(stream: np.ndarray, at: int) -> tuple[_Image, int]:
    """The image whose SOI stands at ``at``, and the place after its EOI; ValueError where it isn't baseline."""
    image, quant, huff = _Image(), {}, {}
    raw = stream[at : at + 4096].tobytes() if len(stream) - at > 4096 else stream[at:].tobytes()
    whole = len(stream) - at <= 4096
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no SOI")
    k = 2
    while True:
        if k + 4 > len(raw) or (not whole and k + 2 + int.from_bytes(raw[k + 2 : k + 4], "big") > len(raw)):
            if whole:
                raise ValueError("cut short")
            raw, whole = stream[at:].tobytes(), True
            continue
        if raw[k] != 0xFF:
            raise ValueError("no marker")
        marker = raw[k + 1]
        if marker == 0xFF:
            k += 1
            continue
        size = int.from_bytes(raw[k + 2 : k + 4], "big")
        body = raw[k + 4 : k + 2 + size]
        k += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                key = bytes(body[1 : 17 + n])
                if key not in _TABLES:
                    if len(_TABLES) > 256:
                        _TABLES.clear()
                    _TABLES[key] = _lookup(list(key[:16]), list(key[16:]))
                huff[body[0]] = _TABLES[key]
                body = body[17 + n :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("not 8 bits")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            image.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            chosen = {body[1 + 2 * c]: body[2 + 2 * c] for c in range(body[0])}
            if not image.components or not image.width or not image.height or len(chosen) != len(image.components):
                raise ValueError("no interleaved scan")
            image.tables = [(huff[chosen[c[0]] >> 4], huff[16 | chosen[c[0]] & 15]) for c in image.components]
            image.steps = [quant[c[3]] for c in image.components]
            break
        elif marker == 0xD9:
            raise ValueError("no scan")
    # The coded bytes end at the first marker that is neither stuffing nor a restart.
    rest = stream[at + k :]
    marks = np.flatnonzero(rest[:-1] == 0xFF)
    after = rest[marks + 1]
    ends = np.flatnonzero((after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF))
    if not len(ends):
        raise ValueError("no end")
    end = int(marks[ends[0]])
    held, after = marks[: ends[0]], after[: ends[0]]
    keep = np.ones(end, bool)
    keep[held[after == 0] + 1] = False
    restarts = held[(after >= 0xD0) & (after <= 0xD7)]
    keep[restarts] = False
    keep[restarts + 1] = False
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    image.data = rest[:end][keep]
    image.cuts = np.concatenate([[0], kept_before[restarts]]).astype(np.int64)
    if rest[end + 1] != 0xD9:
        raise ValueError("more than one scan")
    return image, at + k + end + 2


def _layout(image: _Image) -> tuple[list[int], int, int]:
    """Component of each block of an MCU; MCUs across and down."""
    tall, broad = max(c[2] for c in image.components), max(c[1] for c in image.components)
    if len(image.components) == 1:
        return [0], -(-image.width // 8), -(-image.height // 8)
    order = [i for i, c in enumerate(image.components) for _ in range(c[1] * c[2])]
    return order, -(-image.width // (8 * broad)), -(-image.height // (8 * tall))


def decode(streams: list[bytes]) -> list[list[tuple[int, int, np.ndarray]] | None]:
    """For each stream its images' (width, height, luminance thumbnail); None where it isn't valid baseline JPEG."""
    parsed: list[list[_Image] | None] = []
    for s in streams:
        stream, at, images = np.frombuffer(s, np.uint8), 0, []
        try:
            while at < len(stream):
                image, at = _parse(stream, at)
                images.append(image)
            parsed.append(images or None)
        except (ValueError, KeyError, IndexError):
            parsed.append(None)
    groups: dict[tuple, list[_Image]] = {}
    for image in (x for xs in parsed if xs for x in xs):
        groups.setdefault((tuple(_layout(image)[0]), *(id(t) for pair in image.tables for t in pair)), []).append(image)
    levels: dict[int, np.ndarray | None] = {}
    for images in groups.values():
        for image, found in zip(images, _levels(images), strict=True):
            levels[id(image)] = found
    out: list[list[tuple[int, int, np.ndarray]] | None] = []
    for xs in parsed:
        if xs is None or any(levels[id(x)] is None for x in xs):
            out.append(None)
        else:
            out.append([(x.width, x.height, _thumbnail(x, levels[id(x)])) for x in xs])
    return out


def _levels(images: list[_Image]) -> list[np.ndarray | None]:
    """DC levels of all blocks in scan order, for images with the same tables and MCU layout."""
    order = _layout(images[0])[0]
    tables = images[0].tables
    data = np.concatenate([*(np.concatenate([x.data, np.full(8, 0xFF, np.uint8)]) for x in images)]).astype(np.uint32)
    data = np.concatenate([data, np.zeros(8, np.uint32)])
    words = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    pos, many, owner, sound, base = [], [], [], [], 0
    for i, x in enumerate(images):
        _, across, down = _layout(x)
        mcus = across * down
        each = x.interval or mcus
        lanes = -(-mcus // each)
        sound.append(lanes == len(x.cuts))
        cuts = x.cuts[:lanes] if sound[-1] else x.cuts[:0]
        pos.append(base + cuts)
        n = np.full(len(cuts), each, np.int64)
        if len(n):
            n[-1] = mcus - each * (lanes - 1)
        many.append(n)
        owner.append(np.full(len(cuts), i))
        base += len(x.data) + 8
    pos, many, owner = np.concatenate(pos) * 8, np.concatenate(many), np.concatenate(owner)
    first = np.concatenate([[0], np.cumsum(many * len(order))])
    out = np.zeros(int(first[-1]), np.int32)
    broken = np.zeros(len(images), bool)
    by_length = np.argsort(-many, kind="stable")
    lengths = -many[by_length]
    last = len(words) - 1
    pred = np.zeros((len(tables), len(pos)), np.int64)
    pos_sorted, first_sorted, owner_sorted = pos[by_length], first[:-1][by_length], owner[by_length]

    def peek(where: np.ndarray) -> np.ndarray:
        return (words[np.minimum(where >> 3, last)] >> (16 - (where & 7)).astype(np.uint32)) & 0xFFFF

    for m in range(int(many.max(initial=0))):
        live = int(np.searchsorted(lengths, -m, "left"))  # lanes with more than m MCUs
        at, told = pos_sorted[:live], owner_sorted[:live]
        for b, component in enumerate(order):
            dc, ac = tables[component]
            found = dc[peek(at)].astype(np.int64)
            broken[told[found == 0]] = True
            size = found & 255
            at = at + (found >> 8)
            extra = peek(at).astype(np.int64) >> (16 - size)
            at += size
            pred[component, :live] += np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
            out[first_sorted[:live] + m * len(order) + b] = pred[component, :live]
            lanes, k = None, np.ones(live, np.int64)  # skip the AC terms up to the end of the block
            here = at
            while len(here):
                found = ac[peek(here)].astype(np.int64)
                symbol = found & 255
                here = here + (found >> 8) + (symbol & 15)
                done = (symbol == 0) | (found == 0)
                k = np.where(symbol == 0, 64, k + (symbol >> 4) + 1)
                done |= k >= 64
                if done.all():
                    if lanes is None:
                        at = here
                    else:
                        at[lanes] = here
                    if (found == 0).any():
                        broken[(told if lanes is None else told[lanes])[found == 0]] = True
                    break
                if lanes is None:
                    lanes = np.arange(live)
                broken[told[lanes[found == 0]]] = True
                at[lanes[done]] = here[done]
                lanes, here, k = lanes[~done], here[~done], k[~done]
        pos_sorted[:live] = at
    results, lane = [], 0
    counts = np.bincount(owner, minlength=len(images)) if len(owner) else np.zeros(len(images), np.int64)
    for i in range(len(images)):
        a, b = lane, lane + int(counts[i])
        results.append(out[first[a] : first[b]] if sound[i] and not broken[i] else None)
        lane = b
    return results


def _thumbnail(image: _Image, level: np.ndarray) -> np.ndarray:
    """One luminance pixel per 8x8 block, rows by columns."""
    order, across, down = _layout(image)
    _, h, v, _ = image.components[0]
    if len(image.components) == 1:
        h = v = 1
    own = level.reshape(down, across, len(order))[:, :, : h * v].reshape(down, across, v, h)
    grid = own.transpose(0, 2, 1, 3).reshape(down * v, across * h)
    scale_h, scale_v = max(c[1] for c in image.components), max(c[2] for c in image.components)
    if len(image.components) > 1:
        grid = grid[: -(-image.height * v // (8 * scale_v)), : -(-image.width * h // (8 * scale_h))]
    return np.clip((grid * image.steps[0] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(grid: np.ndarray) -> int:
    """Difference hash: 8 rows of 9 pixels picked evenly, a bit where a pixel is brighter than its right neighbour."""
    rows = (np.arange(8) * grid.shape[0]) // 8
    cols = (np.arange(9) * grid.shape[1]) // 9
    small = grid[rows][:, cols].astype(np.int16)
    return int.from_bytes(np.packbits(small[:, :-1] > small[:, 1:]).tobytes(), "big")
