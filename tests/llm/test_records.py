"""Media, licences and WARC derivatives."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

from plumbline.llm import jpeg, op5_media, op8_licenses, op9_warc


def slow_scan(stream: bytes) -> list[int]:
    """DC levels of a one-component baseline image, bit by bit, straight from the standard."""
    tables, quant, at, interval = {}, 1, 2, 0
    while True:
        marker, size = stream[at + 1], int.from_bytes(stream[at + 2 : at + 4], "big")
        body = stream[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quant = body[1]
        elif marker == 0xC4:
            code, k, codes = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]] = codes
        elif marker == 0xC0:
            blocks = (int.from_bytes(body[1:3], "big") // 8) * (int.from_bytes(body[3:5], "big") // 8)
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            break
    bits, levels, pred, held = iter(()), [], 0, None

    def segment():
        nonlocal at
        out = []
        while True:
            b = stream[at]
            if b == 0xFF:
                if stream[at + 1] == 0:
                    out.append(255)
                    at += 2
                    continue
                at += 2
                return out
            out.append(b)
            at += 1

    def symbol(codes):
        length = code = 0
        while True:
            code, length = code << 1 | next(bits), length + 1
            if (length, code) in codes:
                return codes[length, code]

    for n in range(blocks):
        if held is None or (interval and n % interval == 0):
            held, pred = segment(), 0
            bits = iter([b >> (7 - k) & 1 for b in held for k in range(8)])
        size = symbol(tables[0])
        value = 0
        for _ in range(size):
            value = value << 1 | next(bits)
        pred += value if not size or value >> (size - 1) else value - (1 << size) + 1
        levels.append(pred * quant // 8 + 128)
        k = 1
        while k < 64:
            s = symbol(tables[16])
            if s == 0:
                break
            for _ in range(s & 15):
                next(bits)
            k += (s >> 4) + 1
    return levels


PAYLOADS = [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 3, b"\xff\x00" * 100, random.Random(0).randbytes(5000)]


def test_jpeg_round_trip():
    padded = [jpeg.pad(p) for p in PAYLOADS]
    streams = jpeg.encode(padded)
    for p, s, images in zip(padded, streams, jpeg.decode(streams), strict=True):
        assert b"".join(g.tobytes() for _, _, g in images) == p
        assert bytes(slow_scan(s)) == p


def test_jpeg_of_many_images():
    payload = jpeg.pad(random.Random(1).randbytes(64 * jpeg.MOST_ROWS + 10))
    (images,) = jpeg.decode(jpeg.encode([payload]))
    assert len(images) == 2 and b"".join(g.tobytes() for _, _, g in images) == payload


def with_ac_terms(levels, width):
    """A baseline image with AC terms and no restart markers, coded bit by bit."""
    ac = [(0x00, "0"), (0x01, "10"), (0x12, "110"), (0xF0, "1110")]
    dc = {s: format(c, f"0{n}b") for s, c, n in jpeg._codes(jpeg.DC_BITS, jpeg.DC_SYMBOLS)}
    bits, pred, rng = "", 0, random.Random(2)
    for v in levels:
        d, pred = v - pred, v
        size = abs(d).bit_length()
        bits += dc[size] + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "")
        for _ in range(rng.randint(0, 3)):
            bits += rng.choice(["10" + "1", "110" + "01", "1110" + "10" + "0"])
        bits += "0"
    bits += "1" * (-len(bits) % 8)
    coded = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    segment = lambda m, b: bytes([255, m]) + (len(b) + 2).to_bytes(2, "big") + b
    counts = [sum(len(c) == n for _, c in ac) for n in range(1, 17)]
    rows = len(levels) // width
    return (
        b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + segment(0xDB, b"\0" + bytes([8] * 64)) + segment(0xC0, b"\x08" + (rows * 8).to_bytes(2, "big") + (width * 8).to_bytes(2, "big") + b"\x01\x01\x11\0")
        + segment(0xC4, b"\0" + bytes(jpeg.DC_BITS) + bytes(jpeg.DC_SYMBOLS)) + segment(0xC4, b"\x10" + bytes(counts) + bytes(s for s, _ in ac)) + segment(0xDA, b"\x01\x01\0\0\x3f\0") + coded + b"\xff\xd9"
    )


def test_long_texts_are_coded_in_blocks():
    """A text of several images takes memory for blocks of them, gives what it would give at once, and equal images leave a trace."""
    import hashlib
    import tracemalloc
    import zlib

    text = "".join(random.Random(2).choices("abcdefgh é", k=3 * jpeg.IMAGE_BYTES))
    padded = jpeg.pad(text.encode())
    (whole,) = jpeg.encode([padded])
    tracemalloc.start()
    (row,) = op5_media._stored([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row[:3] == (len(text.encode()), len(padded), hashlib.sha256(padded).hexdigest()) and row[3] == zlib.crc32(padded[-64:])
    assert row[4:6] == (len(whole), hashlib.sha256(whole).hexdigest())
    assert peak < 200e6
    (found,) = op5_media.features([whole])
    assert row[6] == f"{found[0]}x{found[1]}:{found[2]}:{found[3]}" and found[2] == len(jpeg.images_of(whole)) == 4
    same = jpeg.encode([bytes(range(255, -1, -1)) * (jpeg.IMAGE_BYTES // 128)])[0]
    assert op5_media.features([same])[0][2] == 2 and int(op5_media.features([same])[0][3], 16)


def test_jpeg_with_ac_terms():
    levels = [random.Random(k).randint(-128, 127) for k in range(6 * 5)]
    stream = with_ac_terms(levels, 6)
    (((width, height, grid),),) = jpeg.decode([stream])
    assert (width, height, grid.shape) == (48, 40, (5, 6))
    assert grid.ravel().tolist() == [v + 128 for v in levels] == slow_scan(stream)


def test_jpeg_junk():
    good = jpeg.encode([jpeg.pad(b"text")])[0]
    broken = [b"", b"junk", good[:30], good[:-2], good.replace(b"\xff\xc0", b"\xff\xc2")]
    assert jpeg.decode(broken)[1:] == [None] * 4
    assert op5_media.features([None, b"", b"x"]) == [None] * 3


def test_media_query(spark, docs, none):
    rows = op5_media.digests(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    expected = {}
    for key, text in texts:
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        expected.setdefault(key, set()).add((len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    for r in rows:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in expected[r["doc_id"]]
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in rows}) == len({r["payload_sha256"] for r in rows})
    assert op5_media.digests(none).count() == 0
    held = op5_media.with_media(docs).select("media_features.*", "sequence_id").collect()
    assert all(r["width"] == 512 and r["sequence_id"] == 3 for r in held)


LICENSES = [
    (1, "Copyright (c) 2020 A. Person\n\n" + next(b for n, b in op8_licenses.KNOWN if n == "ISC").replace("ISC License\n\nCopyright (c) <year> <owner>\n", "ISC LICENCE\n").replace("WARRANTIES", "Warranties"), "ISC"),
    (2, "prose\n  LICENSED UNDER the Apache Licence; version 2.0 !\nmore", "line"),
    (3, None, None),
    (4, "", None),
    (5, "?! ...", None),
    (6, "nothing known", None),
    (6, "nothing known", None),
    (None, "Released under the MIT License.", "MIT"),
]


def test_licenses(spark):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t, _ in LICENSES], "doc_id long, text string, line int, license string")
    rows = op8_licenses.scan(docs, op8_licenses.known_licenses(spark)).collect()
    whole = [r for r in rows if r["scope"] == "document"]
    assert len(whole) == len(LICENSES)
    by = {r["doc_id"]: r for r in whole}
    assert by[1]["license"] == "ISC" and by[None]["license"] == "MIT"
    assert all(by[k]["digest"] is None and by[k]["license"] is None for k in (3, 4, 5))
    assert by[6]["digest"] and by[6]["license"] is None
    assert {(r["doc_id"], r["line"], r["license"]) for r in rows if r["scope"] == "line"} == {(2, 2, "Apache-2.0"), (None, 1, "MIT")}
    assert op8_licenses.scan(docs.where("false"), op8_licenses.known_licenses(spark)).count() == 0


def test_licenses_same_as_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    columns = ["doc_id", "scope", "line", "license", "digest"]
    mine = sorted(map(str, (tuple(r[c] for c in columns) for r in op8_licenses.op8_licenses(spark, sf).collect())))
    ran = con.execute(op8_licenses.ORACLE)
    names = [d[0] for d in ran.description]
    assert mine == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in ran.fetchall())


PAGE = '<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><nav><a href="/x?a=1&amp;b=2">X</a></nav><p>One  <b>two</b><br>three &lt;4&gt;</p><script>var t="</p>";</script></body></html>'


def test_plain_text():
    assert op9_warc.plain_text(PAGE) == "X\nOne two\nthree <4>"
    assert op9_warc.plain_text("") == "" and op9_warc.plain_text("a < b") == "a < b"


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://e/x", PAGE, "k"), (2, None, None, "k"), (None, "http://e/y", "é", "k"), (1, "http://e/x", PAGE, "k")], "page_id long, url string, html string, key string")
    sources = op9_warc.responses(pages)
    rows = op9_warc.derive(sources).collect()
    assert len(rows) == 8
    read = {}
    for r in sources.collect():
        ((head, block),) = op9_warc.records(bytes(r["warc"]))
        assert int(head["content-length"]) == len(block)
        read[r["key"]] = head, block
    for r in rows:
        head, block = read[r["key"]]
        payload = block.split(b"\r\n\r\n", 1)[1]
        assert r["refers_to"] == head["warc-record-id"] and r["refers_to_date"] == head["warc-date"] and r["target_uri"] == head["warc-target-uri"]
        assert r["source_payload_digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
        assert r["block_digest"] == op9_warc.digest(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
        ((again, body),) = op9_warc.records(op9_warc.to_warc(r.asDict()))
        assert body == r["block"].encode() and again["warc-refers-to"] == r["refers_to"] and again["warc-type"] == r["record_type"]
    meta = next(r["block"] for r in rows if r["key"] == 1 and r["record_type"] == "metadata")
    assert "title: A & B\r\n" in meta and "outlink: /x?a=1&b=2\r\n" in meta and "http-status: HTTP/1.1 200 OK\r\n" in meta
    assert len({r["record_id"] for r in rows}) == 6  # the repeated page gives the same records
    assert op9_warc.derive(sources.where("false")).count() == 0


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_warc_streams(spark, pack):
    one = bytes(op9_warc.responses(spark.createDataFrame([(1, "u", "<p>a</p>")], "page_id long, url string, html string")).first()["warc"])
    both = pack(one) + pack(one)
    assert len(list(op9_warc.records(both))) == 2
    assert len(list(op9_warc.records(pack(one) + b"junk"))) == 1
    assert list(op9_warc.records(b"")) == [] and list(op9_warc.records(one[:-30])) == []
    df = spark.createDataFrame([(1, bytearray(both)), (2, None), (3, bytearray(b"junk"))], "key long, warc binary")
    assert op9_warc.derive(df).count() == 4


def test_thumbnails_differ():
    a, b = np.arange(64, dtype=np.uint8).reshape(8, 8), np.arange(64, dtype=np.uint8)[::-1].reshape(8, 8)
    assert jpeg.thumbnail_hash(a) != jpeg.thumbnail_hash(b)


def test_warc_bodies_as_they_come():
    """Codings are undone, bad charsets and lengths don't break a run, and time is in proportion to a page."""
    import gzip
    import time
    import zlib

    def response(http, body, size=None):
        block = b"HTTP/1.1 200 OK\r\n" + http + b"\r\n\r\n" + body
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/http\r\nContent-Length: " + (size or str(len(block)).encode()) + b"\r\n\r\n" + block + b"\r\n\r\n"

    def text(http, body):
        ((head, block),) = op9_warc.records(response(http, body))
        return [r[-1] for r in op9_warc.derived(head, block)][1]

    html = "<p>hello</p> é".encode()
    chunked = b"5;x=1\r\n" + html[:5] + b"\r\n" + f"{len(html) - 5:X}".encode() + b"\r\n" + html[5:] + b"\r\n0\r\n\r\n"
    want = "hello\né"
    assert text(b"X: y", html) == text(b"Transfer-Encoding: chunked", chunked) == want
    assert text(b"Content-Encoding: gzip", gzip.compress(html[:9]) + gzip.compress(html[9:])) == want
    assert text(b"Content-Encoding: deflate", zlib.compress(html)) == text(b"Content-Encoding: deflate", zlib.compress(html)[2:-4]) == want
    both = gzip.compress(html)
    assert text(b"Transfer-Encoding: Chunked\r\nContent-Encoding: GZIP", f"{len(both):x}\r\n".encode() + both + b"\r\n0\r\n\r\n") == want
    assert text(b"Transfer-Encoding: chunked", html) == text(b"Content-Encoding: br", html) == text(b"Content-Encoding: gzip", html) == want
    assert text(b"Content-Encoding: gzip", gzip.compress(html * 2000)[:-20]).startswith("hello")
    for charset in (b"undefined", b"nope", b"hex", b"idna", b"utf-8"):
        assert text(b"Content-Type: text/html; charset=" + charset, b"<p>a</p>b") == "a\nb"
    assert text(b"Content-Type: text/html; charset=latin-1", b"\xe9") == "é"
    for size in ("²".encode(), b"-1", b"", b"9" * 30, b"99999"):
        assert list(op9_warc.records(response(b"X: y", html, size) if size else b"WARC/1.1\r\n\r\nx")) == []
    began = time.time()
    for page in ("<svg>" * 200_000, "<!--" * 200_000, "<" * 500_000, "<a href=" * 200_000, "<script></script >" * 50_000, "<title>" * 100_000):
        op9_warc.plain_text(page)
        op9_warc.links(page)
    assert time.time() - began < 20


def test_plain_text_by_regular_expressions():
    """The one-pass text equals the plain way, for pages whose elements are closed."""
    import html
    import re

    rng = random.Random(3)

    def slow(page):
        body = re.sub(r"<!--.*?-->|<(script|style|noscript|template|svg|head)\b[^>]*>.*?</\1\s*>", "", page, flags=re.S | re.I)
        body = re.sub(r"</?(?:p|div|h[1-6]|li|br|td)\b[^>]*>", lambda m: "" if "td" in m[0] else "\n", body, flags=re.I)
        body = html.unescape(re.sub(r"<[^>]*>", "", body))
        return re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f\v\xa0]+", " ", body)).strip()

    parts = ["word ", "&amp; ", "<p>", "</p>", "<div class='x'>", "</DIV>", "<br/>", "<b>", "</b>", "<script>if (a < b) {}</script>", "<style>p {}</style >", "<!-- no <p> -->", "\n", "<td>", "<SVG x=1><g/></SVG>", "<h2>", "</h2>"]
    for _ in range(300):
        page = "".join(rng.choices(parts, k=30))
        assert op9_warc.plain_text(page) == slow(page)
        page = "".join(rng.choices([*parts, "<", ">", "<!--", "-->", "<svg", "<script>", "</ script>", "<p_x>", "<a-b>", "< b", "<!doctype x>"], k=30))
        if page.rfind("-->") >= page.rfind("<!--") + 4 or "<!--" not in page:
            assert op9_warc.plain_text(page) == op9_warc._tidy(op9_warc._walked(page))


def test_licenses_of_a_joined_table(spark, docs, monkeypatch):
    """op8: a table of digests too large to broadcast gives the same rows, with repeated and empty texts too."""
    text = op8_licenses.KNOWN[0][1]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(k, text) for k in range(2000, 2040)] + [(3000, f"x\n{text}\ny"), (3001, "")], "doc_id long, text string"))
    known = op8_licenses.known_licenses(spark)
    want = sorted(map(str, op8_licenses.scan(rows, known).collect()))
    monkeypatch.setattr(op8_licenses, "BROADCAST_ROWS", 0)
    assert sorted(map(str, op8_licenses.scan(rows, known).collect())) == want and len(want) > 100
