"""Line classification: hand-counted vectors, an independent line-by-line fold, and invariances."""

import random

import pytest

from plumbline.functions.classify import COUNTS, count_lines, line_counts, shebang_of
from plumbline.functions.tables import PROSE, SYNTAX

VECTORS = [  # content, key, (total, code, comment, doc, blank)
    (b"", "rs", (0, 0, 0, 0, 0)),
    (b"\n", "rs", (1, 0, 0, 0, 1)),
    (b"x", "rs", (1, 1, 0, 0, 0)),
    (b"fn main() {\n    // hi\n    /// doc\n\n}\n", "rs", (5, 2, 1, 1, 1)),
    (b"/* a\n\n b */\ncode /* x */\n", "rs", (4, 0, 3, 0, 1)),
    (b"/** a\n * b\n */\nint x;\n", "c", (4, 1, 0, 3, 0)),
    (b"/* open\nnever closed\n", "c", (2, 0, 2, 0, 0)),
    (b'def f():\n    """one line"""\n    x = """text\n    more"""\n', "py", (4, 3, 0, 1, 0)),
    (b'"""\nmodule\n"""\nimport x  # y\n# c\n', "py", (5, 1, 1, 3, 0)),
    (b"// Package doc\npackage x\n\tif a { // b\n\t// note\n", "go", (4, 2, 1, 1, 0)),
    (b"#!/bin/sh\n# c\n## d\necho\n", "sh", (4, 2, 1, 1, 0)),
    (b"#!/usr/bin/env python3 -u\n# c\nx\n", "bootstrap", (3, 2, 1, 0, 0)),
    (b"\xef\xbb\xbf// c\nx\n", "js", (2, 1, 1, 0, 0)),
    (b"a\r\n// b\r\n\r\n", "js", (3, 1, 1, 0, 1)),
    (b"lone\rcr", "js", (1, 1, 0, 0, 0)),
    (b"\xff\xfe// x\n// \xff\n", "js", (2, 1, 1, 0, 0)),
    (b"anything // x\n\n# y\n", "unknownext", (3, 2, 0, 0, 1)),
    (b"<!-- a\n b -->\n<p>\n", "html", (3, 1, 2, 0, 0)),
    (b"-- doc\nselect 1\n  -- plain\n", "sql", (3, 1, 1, 1, 0)),
    (b"# Title\n\n    code\n```\nx\n```\n<!-- c -->\n<!-- d\n e -->\nprose\n", "md", (10, 4, 3, 2, 1)),
    (b"\x0b\n", "rs", (1, 1, 0, 0, 0)),  # a vertical tab isn't blank
    (b"x" * 200_000 + b"\n", "rs", (1, 1, 0, 0, 0)),
]


@pytest.mark.parametrize("content, key, expected", VECTORS)
def test_vectors(content, key, expected):
    assert count_lines(content, key) == expected


def by_lines(data: bytes, key: str) -> tuple:
    """The rules one line at a time, for comparison."""
    white = b" \t\n\x0c\r"
    if key not in SYNTAX:
        key = shebang_of(data) or key
    lines = data.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    n = dict.fromkeys(("code", "comment", "doc", "blank"), 0)
    syntax = SYNTAX.get(key)
    block, fenced, noted = None, False, False
    for i, raw in enumerate(lines):
        if i == 0:
            raw = raw.removeprefix(b"\xef\xbb\xbf")
        line = raw.strip(white)
        if not line:
            n["blank"] += 1
        elif key in PROSE:
            noted |= line.startswith(b"<!--")
            if noted:
                n["comment"] += 1
                noted = not line.endswith(b"-->")
            elif line.startswith((b"```", b"~~~")):
                fenced = not fenced
                n["code"] += 1
            else:
                n["code" if fenced or raw.startswith((b"    ", b"\t")) else "doc"] += 1
        elif (i == 0 and line.startswith(b"#!")) or syntax is None:
            n["code"] += 1
        elif block:
            n["doc" if block[1] else "comment"] += 1
            if block[0] in line:
                block = None
        else:
            docs = [d.encode() for d in syntax.doc]
            spots = [(line.find(s.encode()), k, s, e) for k, (s, e) in enumerate(syntax.blocks)]
            spots = [x for x in spots if x[0] >= 0 and (x[2] != x[3] or x[0] == 0)]
            if spots:
                at, _, s, e = min(spots)
                told = any(d in line for d in docs)
                n["doc" if told else "comment"] += 1
                if e.encode() not in line[at + len(s) :]:
                    block = (e.encode(), told)
            elif line.startswith(tuple(m.encode() for m in syntax.line)):
                vague = set(syntax.doc) & set(syntax.line) and raw[:1] in (b" ", b"\t", b"\x0c", b"\r")
                n["doc" if line.startswith(tuple(docs)) and not vague else "comment"] += 1
            else:
                n["code"] += 1
    return len(lines), n["code"], n["comment"], n["doc"], n["blank"]


def test_random_files_agree_with_the_fold():
    rng = random.Random(7)
    for key in [*SYNTAX, "unknownext"]:
        syntax = SYNTAX.get(key)
        marks = ["", " ", "\t", "x", "  y = 1", "```", "~~~", "    z", "\r", "\x0c", "#!/bin/sh", "<!--", "-->"]
        if syntax:
            marks += [*syntax.line, *syntax.starts, *syntax.ends, *syntax.doc]
        for _ in range(60):
            text = "\n".join("".join(rng.choice(marks) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 12)))
            data = (rng.choice(["", "﻿"]) + text + rng.choice(["", "\n"])).encode()
            if not data:
                continue
            got = count_lines(data, key)
            assert got == by_lines(data, key), (key, data)
            assert sum(got[1:]) == got[0]


def test_column_function(spark):
    rows = [(bytearray(c), k) for c, k, _ in VECTORS] + [(None, "rs")]
    df = spark.createDataFrame(rows, "content binary, key string")
    from pyspark.sql import functions as F

    got = [tuple(r["n"][c] for c in COUNTS) for r in df.select(line_counts(F.col("content"), F.col("key")).alias("n")).collect()]
    assert got == [e for _, _, e in VECTORS] + [(0, 0, 0, 0, 0)]


def test_counts_in_a_plan_hold_one_text_at_a_time(spark):
    from pyspark.sql import functions as F
    from pyspark.util import PythonEvalType

    from plumbline.functions import classify

    assert classify._line_counts.evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF  # no column of Python objects beside the Arrow batch
    texts = [None, b"", b"// a\n\nx\n", "é\n".encode(), b"\xff\n# b", b"\xef\xbb\xbf"]
    rows = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate((t, k) for t in texts for k in ("rs", "md", None))], "i long, t binary, k string")
    got = rows.select("t", "k", classify.line_counts(F.col("t"), F.col("k")).alias("n")).select("t", "k", "n.*").collect()
    assert len(got) == 18
    for r in got:
        assert tuple(r[c] for c in classify.COUNTS) == classify.count_lines(bytes(r["t"] or b""), r["k"])
    assert rows.where("false").select(classify.line_counts(F.col("t"), F.col("k"))).count() == 0
