"""Media columns: byte payloads as baseline JPEG and features of JPEG columns.

``with_media`` works for any DataFrame: a null payload counts as empty, empty payloads are
one row of zero bytes, repeated rows repeat their results, other columns pass through and a
clash of names is settled in favour of the new columns.  No row depends on another.

Payloads are coded and read back image by image, some at a time, so a worker holds a text,
its stream and the arrays of a bounded block, however long the text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from plumbline.llm import jpeg
from plumbline.llm.common import blocks, free_name, load, struct

#: Payload bytes that are coded in one go; bounds a worker's memory.
BLOCK_BYTES = 1 << 20

FEATURES = "width int, height int, images int, thumb_hash string"
MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def folded(held: int, grid) -> int:
    """The hash of a stream's thumbnails so far with the next one; equal images don't cancel each other."""
    return held * 0x9E3779B97F4A7C15 + jpeg.thumbnail_hash(grid) & (1 << 64) - 1


def features(streams: list[bytes | None]) -> list[tuple[int, int, int, str] | None]:
    """Width, total height, number of images and thumbnail hash of each JPEG stream; None where it can't be read."""
    out: list[tuple[int, int, int, str] | None] = [None] * len(streams)
    cuts = [(jpeg.images_of(s) if len(s) > BLOCK_BYTES else [(0, len(s))]) if s else None for s in streams]
    pieces = [(i, streams[i][a:b]) for i, found in enumerate(cuts) if found for a, b in found]
    held: dict[int, list | None] = {}
    for run in blocks([p for _, p in pieces], BLOCK_BYTES):
        for (i, _), images in zip([pieces[k] for k in run], jpeg.decode([pieces[k][1] for k in run]), strict=True):
            sums = held.setdefault(i, [0, 0, 0, 0])
            if not images or sums is None:
                held[i] = None
                continue
            for width, height, grid in images:
                sums[:] = max(sums[0], width), sums[1] + height, sums[2] + 1, folded(sums[3], grid)
    for i, sums in held.items():
        if sums is not None:
            out[i] = (*sums[:3], f"{sums[3]:016x}")
    return out


@F.pandas_udf(struct(FEATURES))
def jpeg_features(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Column function: features of a binary column of JPEG streams; all null where a value is null or not baseline."""
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for part in parts:
        streams = [None if s is None else bytes(s) for s in part]
        yield pd.DataFrame([x or (None,) * 4 for x in features(streams)], columns=names).astype({"width": "Int32", "height": "Int32", "images": "Int32"})


def _coded(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts as images, in blocks: (text of each image, in order, its stream)."""
    pieces = []
    for i, text in enumerate(texts):
        payload = jpeg.pad((text or "").encode())
        pieces += [(i, payload[a : a + jpeg.IMAGE_BYTES]) for a in range(0, len(payload), jpeg.IMAGE_BYTES)]
    for run in blocks([p for _, p in pieces], BLOCK_BYTES):
        yield [pieces[k][0] for k in run], jpeg.encode([pieces[k][1] for k in run])


def _stored(texts: list[str | None]) -> list[tuple]:
    back, media = ([hashlib.sha256() for _ in texts] for _ in range(2))
    sizes, stored, images, tails, thumbs, height, width = ([0] * len(texts) for _ in range(7))
    for owners, streams in _coded(texts):
        for i, stream, ((wide, high, grid),) in zip(owners, streams, jpeg.decode(streams), strict=True):
            data = grid.tobytes()
            back[i].update(data)
            media[i].update(stream)
            sizes[i] += len(data)
            stored[i] += len(stream)
            images[i] += 1
            tails[i], thumbs[i], width[i] = zlib.crc32(data[-64:]), folded(thumbs[i], grid), wide
            height[i] += high
    rows = []
    for i, text in enumerate(texts):
        feature = f"{width[i]}x{height[i]}:{images[i]}:{thumbs[i]:016x}"
        rows.append((len((text or "").encode()), sizes[i], back[i].hexdigest(), tails[i], stored[i], media[i].hexdigest(), feature))
    return rows


@F.pandas_udf(BinaryType())
def to_jpeg(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column function: the JPEG stream that holds a text's padded UTF-8 bytes; a null counts as empty."""
    for part in parts:
        streams: list[list[bytes]] = [[] for _ in part]
        for owners, found in _coded(list(part)):
            for i, stream in zip(owners, found, strict=True):
                streams[i].append(stream)
        yield pd.Series([b"".join(s) for s in streams], dtype=object)


@F.pandas_udf(struct(MEDIA))
def media_digests(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Column function: what is read back from a text's JPEG stream, as digests, and its features."""
    names = [x.split()[0] for x in MEDIA.split(", ")]
    for part in parts:
        yield pd.DataFrame(_stored(list(part)), columns=names)


def with_media(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a ``media`` column, the JPEG stream of ``text``, and its features as a struct ``media_features``."""
    return df.withColumn("media", to_jpeg(F.col(text))).withColumn("media_features", jpeg_features(F.col("media")))


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, digests of the bytes read back, of the stored stream, and its feature."""
    held = free_name(df, "held")
    kept = df.select(F.col(doc_id).alias("doc_id"), media_digests(F.col(text)).alias(held))
    return kept.select("doc_id", f"{held}.*")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents"))
