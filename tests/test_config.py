"""Settings, presets, labels."""

import pytest

from plumbline import config


def test_defaults_and_partial_files(tmp_path):
    assert config.load(tmp_path / "none.toml") == config.Config()
    found = config.loads('default_max_depth = 3\ncustom_ignore_patterns = ["a", "b"]\n[lsp]\nmax_file_lines = 0\n')
    assert found.default_max_depth == 3 and found.custom_ignore_patterns == ("a", "b")
    assert found.lsp.max_file_lines == 0 and found.lsp.documented_from_lines == 200
    assert found.output_preferences.default_sort_by == "lines"


@pytest.mark.parametrize("text", ["wrong = 1", "[lsp]\nwrong = 1", "[nothing]\nx = 1"])
def test_unknown_settings_are_errors(text):
    with pytest.raises(ValueError):
        config.loads(text)


def test_presets():
    assert config.preset("COMPACT")["top_n"] == 10
    assert config.preset("none") == config.preset(None) == {}


def test_globs():
    import re

    from plumbline.functions.paths import glob_pattern

    hit = lambda g, p: bool(re.search(glob_pattern(g), p))
    assert hit("docs/", "docs/a.md") and hit("docs", "x/docs/a") and not hit("docs", "mydocs/a")
    assert hit("*.rs", "a/b.rs") and not hit("*.rs", "a/b.rst") and hit("src/*.rs", "src/a.rs") and not hit("src/*.rs", "x/src/a.rs")
    assert hit("a/**/z", "a/b/c/z") and hit("a/**/z", "a/z") and hit("x[0-9].py", "x3.py") and not hit("x[!0-9].py", "x3.py") and hit("*.{js,ts}", "q.ts")
    with pytest.raises(ValueError):
        glob_pattern("a[")


def test_noise_and_keys(spark):
    from pyspark.sql import functions as F

    from plumbline.functions import paths

    rows = [
        ("libs/billog/a.rs", "source"), ("log.d/a.rs", "source"), ("a/node_modules/x.js", "not_authored"), ("web/layout/a.ts", "source"), ("MyApp.xcodeproj/p.c", "not_authored"),
        ("output.rs", "source"), ("automation.py", "source"), ("api.generated.rs", "generated"), ("generated.rs", "source"), ("x.svg", "binary"), ("LICENSE", "boilerplate"),
        ("license.rs", "source"), ("COPYING.txt", "boilerplate"), ("a.tar.gz", "binary"), (".gitignore", "source"), ("Makefile", "source"), ("configure", "unknown"), ("x.edn", "unknown"),
    ]
    df = spark.createDataFrame(rows, "path string, expected string")
    got = df.select("path", "expected", paths.disposition(F.col("path")).alias("d")).where("d <> expected").collect()
    assert got == []
    script = spark.createDataFrame([("configure", "#!/usr/bin/env -S python3 -u\nx"), ("run", "#!/bin/sh"), ("x", "#!/usr/bin/unheardof"), ("y", "text")], "path string, content string")
    assert [r[0] for r in script.select(paths.shebang_key(F.col("content"))).collect()] == ["py", "sh", None, None]
    assert [r[0] for r in script.select(paths.disposition(F.col("path"), F.col("content"))).collect()] == ["source", "source", "unknown", "unknown"]
