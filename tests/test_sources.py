"""Tree discovery, and the document stream."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators import incremental, selection
from plumbline.plans import views
from plumbline.sources import tree
from plumbline.streaming import documents


@pytest.fixture
def project(tmp_path):
    def put(path, data=b"x\n"):
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)

    put("src/main.rs", b"//! docs\n\nfn main() {\n    // go\n    run();\n}\n\n/// end\n")
    put("app/main.py", b'"""doc"""\n# c\nx = 1\n\ny = 2\nz = 3\n')
    put("app/__init__.py", b"")
    put("_gen/a.py")
    put("bad/bytes.rs", b"\xff\xfe\n")
    put("node_modules/dep/index.js")
    put("target/CACHEDIR.TAG")
    put("target/debug/gen.rs")
    put("build/real.go")
    put(".hidden/x.rs")
    put("logs/a.txt")
    put("logs/keep.txt")
    put(".gitignore", b"logs/*\n!logs/keep.txt\n/only_root.rs\n*.skip\n")
    put("only_root.rs")
    put("sub/only_root.rs")
    put("sub/a.skip")
    put("sub/.gitignore", b"!a.skip\n")
    os.symlink(tmp_path / "src", tmp_path / "linked")
    return tmp_path


def test_walk(project):
    found = sorted(p for p, _, _ in tree.walk(str(project)))
    assert found == ["_gen/a.py", "app/__init__.py", "app/main.py", "bad/bytes.rs", "build/real.go", "logs/keep.txt", "src/main.rs", "sub/a.skip", "sub/only_root.rs"]
    assert [p for p, _, _ in tree.walk(str(project / "src/main.rs"))] == ["main.rs"]
    assert "src/main.rs" not in {p for p, _, _ in tree.walk(str(project), ignore=("src",))}
    assert all("/" not in p for p, _, _ in tree.walk(str(project), max_depth=1))
    assert ".hidden/x.rs" in {p for p, _, _ in tree.walk(str(project), hidden=True)}


def test_ignore_files_from_outside(project, tmp_path_factory, monkeypatch):
    """Rules of folders above, of the repository and of the user count; own ignore files go before git's, deeper ones before others."""
    home = tmp_path_factory.mktemp("home")
    monkeypatch.setenv("HOME", str(home))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    root = project / "sub" / "deep"
    names = ["a.one", "b.two", "c.three", "d.four", "e.five", "in/f.one", "in/g.six", "keep.rs"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    listed = lambda **options: sorted(p for p, _, _ in tree.walk(str(root), **options))
    assert listed() == names
    (project / ".gitignore").write_text("*.one\n/sub/deep/b.two\n/deep/keep.rs\n")
    (project / "sub" / ".gitignore").write_text("!f.one\n/deep/keep.rs\n")
    (project / ".git" / "info").mkdir(parents=True)
    (project / ".git" / "info" / "exclude").write_text("*.three\n")
    (home / ".config" / "git").mkdir(parents=True)
    (home / ".config" / "git" / "ignore").write_text("*.four\n")
    assert listed() == ["e.five", "in/f.one", "in/g.six"]
    (project / ".ignore").write_text("*.five\n!keep.rs\n")
    assert listed() == ["in/f.one", "in/g.six", "keep.rs"]
    (home / "mine").write_text("*.six\n")
    (home / ".gitconfig").write_text("[core]\n  excludesFile = ~/mine\n")
    assert listed() == ["d.four", "in/f.one", "keep.rs"]
    assert listed(gitignore=False) == names
    (root / ".ignore").write_text("*.one\n")
    assert listed(gitignore=False) == [n for n in names if not n.endswith(".one")]


def test_large_trees_are_listed_by_tasks(spark, project, monkeypatch):
    """Folders beyond the planned ones are dealt out unlisted; the rows are the same."""
    tree.register(spark)
    rows = lambda: sorted(map(tuple, spark.read.format("source_tree").load(str(project)).collect()))
    want = rows()
    reader = tree._Reader({"path": str(project)})
    assert all(not p.folders for p in reader.partitions())
    monkeypatch.setattr(tree, "PLANNED_FOLDERS", 1)
    monkeypatch.setattr(tree, "FOLDER_PARTITIONS", 3)
    parts = reader.partitions()
    assert [len(p.folders) > 0 for p in parts] == [False, True, True, True]
    assert sorted(x for p in parts for x in reader.read(p)) == want == sorted((p, s, t, (project / p).read_bytes()) for p, s, t in tree.walk(str(project)))


def test_saved_counts(spark, tmp_path):
    """A table can be stored over the one that it was made from, and a failing run leaves the old one."""
    path = str(tmp_path / "cache" / f"{incremental.path_hash('/a/project'):016x}")
    assert incremental.path_hash("") == 0xCBF29CE484222325 and incremental.path_hash("a") == 0xAF63DC4C8601EC8C
    files = spark.createDataFrame([("a.rs", 2, 1), ("b.rs", 2, 1)], "path string, size long, mtime long")
    count = lambda f: f.withColumns({c: F.lit(1).cast("long") for c in incremental.COUNTS})
    incremental.save(incremental.refresh(files, None, count, 1), path)
    known = incremental.load(spark, path)
    incremental.save(incremental.refresh(files.where("path = 'a.rs'"), known, count, 2), path)
    assert [(r["path"], r["touched"]) for r in incremental.load(spark, path).collect()] == [("a.rs", 2)]
    broken = incremental.load(spark, path).withColumn("size", F.raise_error(F.lit("broken off")).cast("long"))
    with pytest.raises(Exception, match="broken off"):
        incremental.save(broken, path)
    assert incremental.load(spark, path).count() == 1 and os.listdir(tmp_path / "cache") == [os.path.basename(path)]


def test_data_source(spark, project):
    tree.register(spark)
    files = spark.read.format("source_tree").load(str(project))
    stats = {r["path"]: r for r in views.stats_of(files.select("path", "content", "size")).collect()}
    assert stats["app/__init__.py"]["total_lines"] == 0
    main = stats["src/main.rs"]
    assert [main[c] for c in ("total_lines", "code_lines", "comment_lines", "doc_lines", "blank_lines")] == [8, 3, 1, 2, 2]
    listed = spark.read.format("source_tree").option("content", "false").load(str(project))
    assert listed.where("content IS NOT NULL").count() == 0


def test_incremental_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("a.rs", 2, 1, "x\n"), ("b.rs", 2, 1, "//\n"), ("c.rs", 0, 1, "")], "path string, size long, mtime long, content string")

    def count(f):
        return views.stats_of(f).withColumnRenamed("file_size", "size").join(f.select("path", "mtime"), "path")

    assert incremental.load(spark, str(tmp_path / "none")) is None
    first = incremental.refresh(files, None, count, 1)
    first.write.parquet(str(tmp_path / "cache"))
    known = incremental.load(spark, str(tmp_path / "cache"))
    changed = files.withColumn("mtime", F.when(F.col("path") == "b.rs", 2).otherwise(F.col("mtime"))).where("path <> 'c.rs'")
    assert [r["path"] for r in incremental.misses(changed, known).collect()] == ["b.rs"]
    again = incremental.refresh(changed, known, count, 2)
    assert sorted(r["path"] for r in again.collect()) == ["a.rs", "b.rs"]
    assert tuple(incremental.hit_rate(files.where("false"), known).first()) == (0, 0, 0.0)


def test_admission_needs_a_listed_path(spark):
    files = spark.createDataFrame([("a.rs",), ("x.zzz",), ("y.zzz",), ("p.png",)], "path string")
    listed = spark.createDataFrame([("proj/x.zzz",), ("/w/proj/p.png",)], "path string")
    assert sorted(r["path"] for r in selection.admitted(files, listed, "/w/proj").collect()) == ["a.rs", "x.zzz"]


def test_parse_options():
    size = selection.parse_size
    assert [size(x) for x in ("10KB", "1.5 mb", "7", "3B", "-1", "x", "nan", "2GB")] == [10240, 1572864, 7, 3, None, None, None, 2 << 30]
    assert selection.parse_languages(" Rust, ,py ") == ["rust", "py"]


def test_document_stream(spark, tmp_path):
    source, out = tmp_path / "in", []
    events = [[("f/a.rs", 1, "open", "x\n// c\n"), ("f/b.py", 2, "change", "# y\n")], [("f/a.rs", 4, "close", None), ("f/a.rs", 3, "change", "late\n"), ("f/b.py", 5, "change", "a\nb\n")]]
    spark.createDataFrame(events[0], documents.EVENTS).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(documents.EVENTS).parquet(str(source))
    query = documents.publish(documents.recounts(stream), lambda df, _: out.extend(tuple(r) for r in df.collect()), str(tmp_path / "state"))
    try:
        query.processAllAvailable()
        spark.createDataFrame(events[1], documents.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(out[:2]) == [("f/a.rs", 1, True, 2, 1, 1, 0, 0), ("f/b.py", 2, True, 1, 0, 1, 0, 0)]
    assert sorted(out[2:]) == [("f/a.rs", 4, False, 0, 0, 0, 0, 0), ("f/b.py", 5, True, 2, 2, 0, 0, 0)]


def test_library_report(spark, project):
    import json

    from plumbline import api

    report = api.analyze(spark, str(project))
    try:
        assert sorted(r["path"] for r in report.stats.collect()) == ["_gen/a.py", "app/__init__.py", "app/main.py", "bad/bytes.rs", "build/real.go", "src/main.rs", "sub/only_root.rs"]
        assert report.totals.first()["files"] == 7
        assert {r["disposition"]: r["files"] for r in report.skipped.collect()} == {"unknown": 2}
        data = json.loads(report.json())
        assert data["basic"]["files"] == 7 and data["stats_by_extension"]["rs"]["files"] == 3 and data["complexity"]["functions"] == 1
        assert report.csv().splitlines()[0].startswith("Extension,") and "rs,3," in report.csv()
        assert "Total Files: 7" in report.text() and "<td>rs</td>" in report.html()
        logs = [json.loads(r["json"]) for r in report.sarif().collect()]
        assert logs[0]["version"] == "2.1.0" and any(x["ruleId"] == "HM000" for x in logs[0]["runs"][0]["results"])
    finally:
        report.release()
    only = api.analyze(spark, str(project), api.Options().with_extensions("RS"))
    assert only.totals.first()["files"] == 3
    listed = [r["path"] for r in api.list_files(spark, str(project)).collect()]
    assert listed == sorted(listed, key=lambda p: p.split("/")) and "app/__init__.py" in listed


def test_report_of_nothing(spark, tmp_path):
    import json

    from plumbline import api

    report = api.analyze(spark, str(tmp_path))
    data = json.loads(report.json())
    assert data["basic"]["files"] == 0 and 0 <= data["quality"]["overall"] <= 100
    assert report.csv().count("\n") == 1


def test_charts(spark):
    from plumbline.operators import reports

    pie = spark.createDataFrame([("rs", 3), ("py", 1)], "label string, value long")
    chart = reports.chart(pie, "Lines", "language")
    assert chart["data"]["labels"] == ["rs (75.0%)", "py (25.0%)"]
    assert chart["data"]["datasets"][0]["backgroundColor"] == ["#dea584", "#3776ab"]
    assert reports.colors(["a", "b"], "monochrome") == ["#333333", "#7f7f7f"]
    assert len(set(reports.colors(list("abcdefghijkl"), "pastel"))) == 10


def run_cli(spark, capsys, *argv):
    from plumbline import cli

    assert cli.main(list(argv), spark) == 0
    return capsys.readouterr().out


def test_command_line(spark, project, capsys, tmp_path):
    root = str(project)
    assert run_cli(spark, capsys, root, "-q") == "7 files, 18 lines\n"
    assert run_cli(spark, capsys, root, "--preset", "compact").startswith("7 files | 18 lines | ")
    assert run_cli(spark, capsys, root, "-e", "py", "-q") == "3 files, 7 lines\n"
    assert run_cli(spark, capsys, root, "--min-lines", "6", "-q") == "2 files, 14 lines\n"
    assert run_cli(spark, capsys, root, "--min-complexity", "1", "-q") == "1 files, 8 lines\n"
    assert run_cli(spark, capsys, root, "--ignore", "app,src", "-q") == "4 files, 4 lines\n"
    assert "app/main.py\n" in run_cli(spark, capsys, root, "-l")
    assert run_cli(spark, capsys, root, "-o", "markdown").splitlines()[2].startswith("| go |")
    assert run_cli(spark, capsys, root, "-o", "table", "--top", "1").count("\n") == 2
    text = run_cli(spark, capsys, root, "-f", "--explain", "--show-functions", "--show-time", "--show-size", "--show-ratios", "--show-complexity")
    assert "src/main.rs:3 main" in text and "Skipped as unknown: 2" in text and "Rust" in text
    run_cli(spark, capsys, root, "-o", "json", "--output-file", str(tmp_path / "out.json"))
    assert (tmp_path / "out.json").read_text().startswith("{")
    from plumbline import cli

    assert cli.main([str(tmp_path / "nowhere")], spark) == 2


def test_generated_corpus(spark):
    from plumbline.sources import corpus

    files = corpus.generate(spark, 200)
    wrong = views.stats_of(files).join(files.select("path", "expected_total", "expected_code"), "path").where("total_lines <> expected_total OR code_lines <> expected_code")
    assert wrong.count() == 0
    assert files.select(F.bit_xor(F.xxhash64("path", "content"))).first() == corpus.generate(spark, 200).repartition(7).select(F.bit_xor(F.xxhash64("path", "content"))).first()


def test_detector_results(spark, tmp_path):
    import json

    from plumbline.operators import advice
    from plumbline.sources import detector

    told = {"languages": [{"name": "Zork", "files": ["p/a.zzz", "p/b.rs"]}, {"name": "Rust", "files": ["p/c.rs"]}], "unknown_files": ["x"], "more": 1}
    (tmp_path / "out.json").write_text(json.dumps(told, indent=1))
    found = detector.read(spark, str(tmp_path / "out.json"))
    assert [tuple(r)[:2] for r in found.orderBy("position").collect()] == [("Zork", "p/a.zzz"), ("Zork", "p/b.rs"), ("Rust", "p/c.rs")]
    files = spark.createDataFrame([("p/a.zzz",), ("p/d.rs",), ("p/e.py",), ("p/f.unheard",)], "path string")
    names = {r["path"]: r["language"] for r in advice.detected_language(files, found, views.languages(spark)).collect()}
    assert names == {"p/a.zzz": "Zork", "p/d.rs": "Zork", "p/e.py": "Python", "p/f.unheard": None}
    assert sorted(r["path"] for r in selection.admitted(files, found, "p2").collect()) == ["p/a.zzz", "p/d.rs", "p/e.py"]
