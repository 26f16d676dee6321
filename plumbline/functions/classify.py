"""Line classification: code, comment, documentation or blank, for whole files.

The rules keep state from line to line, so a file stays in one row.  Rather than folding over
lines one by one, a scan leaps from marker to marker with compiled patterns: lines without a
marker are only counted, in C.  ``line_counts`` is the Arrow-batched column function over
bytes; it takes any encoding, since all markers are ASCII.

Null content counts as empty (no lines).  A key without known markers falls back to the file's
``#!`` line, and else has no comments at all.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plumbline.functions.tables import PROSE, SHEBANGS, SYNTAX, Syntax

COUNTS = ("total_lines", "code_lines", "comment_lines", "doc_lines", "blank_lines")
_SCHEMA = StructType([StructField(n, LongType(), False) for n in COUNTS])
_BOM = b"\xef\xbb\xbf"
_SPACE = rb"[ \t\n\x0c\r]"
_BLANK = re.compile(rb"\n[ \t\x0c\r]*(?=\n)")  # patterns that begin with a line feed are found much faster than those at a line's start
_PROSE_MARK = re.compile(rb"^[ \t\x0c\r]*(?:<!--|```|~~~)", re.M)
_PROSE_INDENTED = re.compile(rb"^(?:    |\t)[^\n]*[^ \t\n\x0c\r]", re.M)
_SHEBANG_TAIL = re.compile(r"[0-9.]+$")


def shebang_of(data: bytes) -> str | None:
    """Key that a ``#!`` line implies."""
    if not data.startswith(b"#!"):
        return None
    try:
        words = data[2:].split(b"\n", 1)[0].decode().split()
    except UnicodeDecodeError:
        return None
    word = next((w for w in words if not w.startswith("-") and not w.endswith("env")), None)
    return word and SHEBANGS.get(_SHEBANG_TAIL.sub("", word.rsplit("/", 1)[-1]))


class _Scanner:
    """Patterns of one syntax, for texts with a line feed in front.

    ``opens`` finds the next block opener.  Outside of the blocks no line depends on another, so ``marked`` and ``documented``
    just count the lines that start as (documentation) comments, in the whole text, and what lies in blocks is taken off.
    """

    def __init__(self, syntax: Syntax):
        self.docs = [d.encode() for d in syntax.doc]
        self.closers = {s.encode(): e.encode() for s, e in syntax.blocks}
        union = lambda xs: "|".join(map(re.escape, xs)).encode()
        blank, marks = rb"[ \t\x0c\r]*", b"(?:" + union(syntax.line) + b")"
        anywhere, at_start = [s for s, e in syntax.blocks if s != e], [s for s, e in syntax.blocks if s == e]
        tokens = [union(anywhere)] * bool(anywhere) + [b"\n" + blank + b"(?:" + union(at_start) + b")"] * bool(at_start)
        self.opens = re.compile(b"|".join(tokens)) if tokens else None
        self.marked = re.compile(b"\n" + blank + marks) if syntax.line else None
        vague = set(syntax.doc) & set(syntax.line)  # then an indented comment is no documentation
        told = b"\n" + (b"" if vague else blank) + b"(?=" + marks + b")(?:" + union(syntax.doc) + b")"
        self.documented = re.compile(told) if syntax.line and syntax.doc else None
        self.only = syntax.blocks[0][0].encode() if len(syntax.blocks) == 1 and anywhere else None

    def opener(self, line: bytes) -> tuple[int, bytes] | None:
        """Earliest block opener of a trimmed line; of two at one place the one declared first."""
        if self.only:
            return line.find(self.only), self.only
        found = None
        for start, end in self.closers.items():
            at = line.find(start)
            if at >= 0 and (start != end or at == 0) and (found is None or at < found[0]):
                found = at, start
        return found

    def comments(self, data: bytes) -> tuple[int, int]:
        """(comment, documentation) lines of a text without its BOM and ``#!`` line."""
        data = b"\n" + data
        marked = len(self.marked.findall(data)) if self.marked else 0
        told = len(self.documented.findall(data)) if self.documented and marked else 0
        comment, doc = marked - told, told
        if not any(s in data for s in self.closers):
            return comment, doc
        at, size, search, find = 0, len(data), self.opens.search, data.find
        while hit := search(data, at):
            begin = data.rfind(b"\n", at, hit.end())  # the line feed in front of the opener's line
            stop = find(b"\n", hit.end())
            stop = size if stop < 0 else stop
            line = data[begin:stop].strip(b" \t\n\x0c\r")
            place, start = self.opener(line)
            closer, lines = self.closers[start], 1
            if line.find(closer, place + len(start)) < 0:
                shut, first = find(closer, stop), stop
                stop = size if shut < 0 else find(b"\n", shut)
                stop = size if stop < 0 else stop
                lines += _filled(data, first + 1, stop)
            if marked and (held := len(self.marked.findall(data, begin, stop))):
                held_doc = len(self.documented.findall(data, begin, stop)) if told else 0
                comment, doc = comment - held + held_doc, doc - held_doc
            if any(d in line for d in self.docs):
                doc += lines
            else:
                comment += lines
            at = stop
            if at >= size:
                break
        return comment, doc


def _filled(data: bytes, begin: int, end: int) -> int:
    """Lines of ``data[begin:end]`` that aren't blank."""
    if begin >= end:
        return 0
    part = data[begin:end]
    if part.endswith(b"\n"):
        part = part[:-1]
    return part.count(b"\n") + 1 - _blanks(part)


def _blanks(part: bytes) -> int:
    return len(_BLANK.findall(b"\n" + part + b"\n"))


@functools.cache
def _scanner(syntax: Syntax) -> _Scanner:
    return _Scanner(syntax)


def _prose(data: bytes, lines: int, blank: int) -> tuple[int, int, int]:
    """(code, comment, documentation) lines of a prose text."""
    code = comment = at = 0
    size, fenced = len(data), False
    while at < size:
        hit = _PROSE_MARK.search(data, at)
        stop = hit.start() if hit else size
        if fenced:
            code += _filled(data, at, stop)
        else:
            code += len(_PROSE_INDENTED.findall(data[at:stop]))
        if not hit:
            break
        if hit.group().endswith(b"<!--"):
            at = hit.start()
            while at < size:  # up to the line that ends the comment
                end = data.find(b"\n", at)
                end = size if end < 0 else end
                line = data[at:end].strip(b" \t\n\x0c\r")
                comment += bool(line)
                at = end + 1
                if line.endswith(b"-->"):
                    break
        else:
            fenced = not fenced
            code += 1
            end = data.find(b"\n", stop)
            at = size if end < 0 else end + 1
    return code, comment, lines - blank - code - comment


def count_lines(data: bytes, key: str | None) -> tuple[int, int, int, int, int]:
    """(total, code, comment, documentation, blank) lines of a file under a classification key."""
    if not data:
        return 0, 0, 0, 0, 0
    if key not in SYNTAX:
        key = shebang_of(data) or key
    if data.startswith(_BOM):
        data = data[3:]
        if not data:
            return 1, 0, 0, 0, 1
    lines = data.count(b"\n") + (not data.endswith(b"\n"))
    body = data[:-1] if data.endswith(b"\n") else data
    blank = _blanks(body)
    if key in PROSE:
        code, comment, doc = _prose(body, lines, blank)
        return lines, code, comment, doc, blank
    syntax = SYNTAX.get(key or "")
    if syntax is None:
        return lines, lines - blank, 0, 0, blank
    rest = body
    first = body.split(b"\n", 1)[0].strip(b" \t\n\x0c\r")
    if first.startswith(b"#!"):  # code, whatever the markers say
        cut = body.find(b"\n")
        rest = b"" if cut < 0 else body[cut + 1 :]
    comment, doc = _scanner(syntax).comments(rest)
    return lines, lines - blank - comment - doc, comment, doc, blank


@F.arrow_udf(_SCHEMA)
def _line_counts(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for content, key in parts:
        rows = (count_lines(c.as_py() or b"", k.as_py()) for c, k in zip(content, key, strict=True))  # one content at a time is a Python object
        counts = np.fromiter(rows, dtype=(np.int64, len(COUNTS)), count=len(content))
        yield pa.StructArray.from_arrays([pa.array(c) for c in counts.T], names=list(COUNTS))


def line_counts(content: Column, key: Column) -> Column:
    """Struct of the five counts for binary or string content under a classification key."""
    return _line_counts(content.cast("binary"), key)
