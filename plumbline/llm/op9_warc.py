"""WARC derivatives: response records to linked metadata and plain-text conversion records.

``derive`` reads a binary column of WARC bytes (records one after another, plain or as gzip
members) and returns, per response record, a ``metadata`` and a ``conversion`` record as rows.
Both keep the identifier they refer to, the target, its date, the source's headers and its
digests; new identifiers are name-based on (source identifier, type), so a rerun gives the
same.  Bodies are taken out of their transfer coding (chunked) and content coding (gzip,
deflate) first; what breaks off or has another coding is taken as far as it can be read, and
an unknown charset as UTF-8.  Null, empty or broken bytes give no rows beyond those of the
records before the break; a record without a body gives an empty text.  Tags are found in one
pass, so the time is in proportion to a page.  Extra columns are ignored; the key column may be
null or repeat.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import load, struct

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
COLUMNS = (
    "key long, record_type string, record_id string, refers_to string, target_uri string, refers_to_date string, "
    "content_type string, source_headers string, source_payload_digest string, block_digest string, content_length long, block string"
)

_TITLE = re.compile(r"<title[^>]*>([^<]*)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*[\"']?([^\"'\s>]+)", re.I)
#: A comment's start, or a whole tag: its slash, name and rest.
_MARK = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9]*)?([^<>]*)>")
#: Elements whose content is no text, and those that begin a line.
HIDDEN = frozenset("script style noscript template svg head".split())
LINES = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li table tr article section nav header footer blockquote pre form main aside br hr".split())
#: In one expression: a whole comment, a whole hidden element, or a tag with its name.
_WHOLE = re.compile(rf"<!--.*?-->|<({'|'.join(sorted(HIDDEN))})(?![a-z0-9])[^<>]*>.*?</\1\s*>|</?([a-z][a-z0-9]*)?[^<>]*>", re.S | re.I)
_HIDES = re.compile(rf"<(?:{'|'.join(sorted(HIDDEN))})(?![a-z0-9])", re.I)
_ANCHOR = re.compile(r"<a(?![a-z0-9])([^<>]*)>", re.I)
#: Characters that the expression may look through for closing tags; other pages are walked tag by tag.
MOST_LOOKS = 1 << 22
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")
_CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]{1,15})[^\n]*\n")


def plain_text(page: str) -> str:
    """Visible text: no scripts, styles, heads or comments; a line per block; entities resolved; blanks collapsed.

    A hidden element or a comment that is never closed hides nothing.
    """
    page = page.replace("\x00", "")
    closed = page.rfind("-->") >= page.rfind("<!--") + 4 if "<!--" in page else True
    if closed and len(_HIDES.findall(page)) * len(page) <= MOST_LOOKS:
        return _tidy(_WHOLE.sub(lambda m: "\n" if m[2] and m[2].lower() in LINES else "", page))
    return _tidy(_walked(page))


def _tidy(body: str) -> str:
    return _LINES.sub("\n", _BLANK.sub(" ", entities.unescape(body))).strip()


def _walked(page: str) -> str:
    """What ``_WHOLE`` leaves, in one pass whatever is never closed."""
    closes = {name: [m.start() for m in re.finditer(f"</{name}\\s*>", page, re.I)] for name in HIDDEN}
    used = dict.fromkeys(HIDDEN, 0)
    last_comment = page.rfind("-->")
    parts, at, k = [], 0, 0
    while m := _MARK.search(page, k):
        k = m.end()
        if m[0] == "<!--":
            if k > last_comment:
                parts.append(page[at : m.start()])
                at = k
                continue
            end = page.find("-->", k) + 3
            parts.append(page[at : m.start()])
            at = k = end
            continue
        parts.append(page[at : m.start()])
        at, name = k, (m[2] or "").lower()
        if name in HIDDEN and not m[1]:
            held, i = closes[name], used[name]
            while i < len(held) and held[i] < k:
                i += 1
            used[name] = i
            if i < len(held):
                at = k = page.index(">", held[i]) + 1
        elif name in LINES:
            parts.append("\n")
    return "".join([*parts, page[at:]])


def links(page: str) -> list[str]:
    """Targets of the page's links, each once."""
    found = map(_HREF.search, _ANCHOR.findall(page))
    return list(dict.fromkeys(f[1] for f in found if f))


def unpacked(data: bytes) -> bytes:
    """The gzip members or the deflate stream in ``data``, as far as they can be read."""
    parts = []
    while data:
        found = b""
        for bits in (47, -15):  # gzip or zlib header, or none
            unpack = zlib.decompressobj(bits)
            try:
                found = unpack.decompress(data)
                break
            except zlib.error:
                found = b""
        parts.append(found)
        if not unpack.eof or data[:2] != b"\x1f\x8b":
            break
        data = unpack.unused_data
    return b"".join(parts)


def body_of(source: dict[str, str], payload: bytes) -> bytes:
    """The body of a response without its transfer and content codings."""
    if "chunked" in source.get("transfer-encoding", "").lower():
        parts, at = [], 0
        while (m := _CHUNK.match(payload, at)) and (n := int(m[1], 16)):
            parts.append(payload[m.end() : m.end() + n])
            at = m.end() + n
            at += 2 if payload[at : at + 2] == b"\r\n" else payload[at : at + 1] == b"\n"
        payload = b"".join(parts) if parts or _CHUNK.match(payload) else payload
    coding = source.get("content-encoding", "").lower()
    return (unpacked(payload) or payload) if "gzip" in coding or "deflate" in coding else payload


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each WARC record; ends at the first broken one."""
    if data[:2] == b"\x1f\x8b":
        data = unpacked(data)
    at = 0
    while (at := at + len(data[at : at + 4]) - len(data[at : at + 4].lstrip(b"\r\n"))) < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            return
        head = _headers(data[at:end].decode("utf-8", "replace").split(CRLF)[1:])
        size = head.get("content-length", "")
        if not re.fullmatch(r"[0-9]{1,18}", size) or end + 4 + int(size) > len(data):
            return
        yield head, data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)


def _headers(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def derived(head: dict[str, str], block: bytes) -> Iterator[tuple]:
    """The metadata and conversion rows (without key) of one response record."""
    if head.get("content-type", "").replace(" ", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        lines = top.decode("utf-8", "replace").split(CRLF)
        status, source = lines[0], _headers(lines[1:])
    else:
        status, source, payload = "", {}, block
    charset = re.search(r"charset=[\"']?([\w.:-]+)", source.get("content-type", ""))
    body = body_of(source, payload)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, ValueError):  # unknown, or no text coding
        page = body.decode("utf-8", "replace")
    source_id = head.get("warc-record-id", "")
    kept = json.dumps({"status": status, **source}, sort_keys=True, ensure_ascii=False)
    title = _TITLE.search(page)
    fields = [f"http-status: {status}", *(f"source-{k}: {v}" for k, v in sorted(source.items()))]
    if title:
        fields.append("title: " + _BLANK.sub(" ", entities.unescape(title[1])).replace("\n", " ").strip())
    fields += [f"outlink: {entities.unescape(x)}" for x in links(page)]
    for kind, media, text in (
        ("metadata", "application/warc-fields", "".join(f + CRLF for f in fields)),
        ("conversion", "text/plain; charset=utf-8", plain_text(page)),
    ):
        coded = text.encode("utf-8", "replace")
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"{source_id} {kind}")
        yield (
            kind, f"<urn:uuid:{name}>", source_id, head.get("warc-target-uri"), head.get("warc-date"), media, kept,
            head.get("warc-payload-digest") or digest(payload), digest(coded), len(coded), coded.decode(),
        )


def to_warc(row: dict) -> bytes:
    """A derived row as the bytes of a WARC/1.1 record."""
    block = row["block"].encode()
    named = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["refers_to_date"]),
        ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Refers-To-Date", row["refers_to_date"]),
        ("WARC-Source-Payload-Digest", row["source_payload_digest"]), ("WARC-Block-Digest", row["block_digest"]),
        ("Content-Type", row["content_type"]), ("Content-Length", str(len(block))),
    ]
    return "".join(["WARC/1.1" + CRLF, *(f"{k}: {v}{CRLF}" for k, v in named if v), CRLF]).encode() + block + b"\r\n\r\n"


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, warc``: each page as a response record. Nulls count as empty; identifiers hash (key, url)."""
    uri = F.coalesce(F.col(url), F.lit(""))
    name = F.sha2(F.concat_ws(" ", F.coalesce(F.col(key).cast("string"), F.lit("")), uri), 256)
    urn = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    http = F.concat(
        F.encode(F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2)), "UTF-8"), body
    )
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:uuid:"), urn, F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.sha2(body, 256), F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length(http).cast("string"), F.lit(CRLF * 2),
    )
    return pages.select(F.col(key).cast("long").alias("key"), F.concat(F.encode(head, "UTF-8"), http, F.lit(b"\r\n\r\n")).alias("warc"))


def derive(warcs: DataFrame, key: str = "key", warc: str = "warc") -> DataFrame:
    """The derived records of all response records; see the module."""
    schema = struct(COLUMNS)
    names = schema.names

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, held = [], 0
            for k, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                for head, block in records(data.as_py() or b""):
                    if head.get("warc-type") == "response":
                        rows += [(k, *x) for x in derived(head, block)]
                        held += len(block)
                if held > 8 << 20:
                    yield _batch(rows, names)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, names)

    return warcs.select(F.col(key).cast("long").alias("key"), F.col(warc).alias("warc")).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if n in ("key", "content_length") else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(load(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")
