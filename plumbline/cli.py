"""Command line: ``python -m plumbline [PATH] [options]``.

Options map onto ``api.Options`` and ``selection.Bounds``; what is printed comes from the
report's DataFrames, of which only rows per extension, language or finding are read.
"""

from __future__ import annotations

import argparse
import contextlib
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import api, config
from plumbline.functions import scores
from plumbline.functions.paths import sort_key
from plumbline.operators import complexity, findings, ranking, reports, selection

FORMATS = ["text", "json", "csv", "html", "sarif", "markdown", "table"]
NUMBERS = {"min-lines": int, "max-lines": int, "min-complexity": float, "max-complexity": float, "min-functions": int, "max-functions": int, "min-quality": float, "max-quality": float, "min-doc-ratio": float, "max-doc-ratio": float}
FLAGS = ["hidden", "asc", "no-gitignore", "show-complexity", "show-quality", "show-ratios", "show-size", "show-time", "show-functions", "high-complexity", "low-quality", "undocumented", "compact", "summary-only", "explain"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description="Count and analyze source code on Spark.")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-o", "--output", choices=FORMATS, default="text")
    p.add_argument("-f", "--files", action="store_true", help="list counted files")
    p.add_argument("-l", "--list", action="store_true", help="list what would be counted, without counting")
    p.add_argument("-d", "--depth", type=int)
    p.add_argument("-e", "--ext", default="")
    p.add_argument("-s", "--sort", choices=["lines", "files", "code", "docs"], default="lines")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--ignore", default="")
    p.add_argument("--only", default="")
    p.add_argument("--exclude", default="")
    p.add_argument("--min-size", default="")
    p.add_argument("--max-size", default="")
    p.add_argument("--top", type=int)
    p.add_argument("--preset")
    p.add_argument("--output-file")
    for name, kind in NUMBERS.items():
        p.add_argument(f"--{name}", type=kind)
    for name in FLAGS:
        p.add_argument(f"--{name}", action="store_true")
    return p


def options_of(args: argparse.Namespace) -> api.Options:
    """Engine options of parsed arguments; a size that can't be read sets no limit."""
    held = {n.replace("-", "_"): getattr(args, n.replace("-", "_")) for n in NUMBERS}
    held |= {"min_size": selection.parse_size(args.min_size), "max_size": selection.parse_size(args.max_size)}
    for name, values in selection.SHORTCUTS.items():
        held |= values if getattr(args, name) else {}
    bounds = selection.Bounds(**held, include=tuple(selection.parse_languages(args.only)), exclude=tuple(selection.parse_languages(args.exclude)))
    split = lambda text: tuple(x.strip() for x in text.split(",") if x.strip())
    return api.Options(extensions=split(args.ext), hidden=args.hidden, gitignore=not args.no_gitignore, max_depth=args.depth, ignore=split(args.ignore), bounds=bounds)


def with_preset(args: argparse.Namespace) -> argparse.Namespace:
    names = {"compact_output": "compact", "top_n": "top"}
    for name, value in config.preset(args.preset).items():
        if hasattr(args, names.get(name, name)):
            setattr(args, names.get(name, name), value)
    return args


def _lines(df: DataFrame) -> list[str]:
    return [r["line"] for r in df.collect()]


def render(report: api.Report, args: argparse.Namespace) -> str:
    """The report in the wanted format."""
    if args.output == "json":
        return report.json() + "\n"
    if args.output == "csv":
        return report.csv()
    if args.output == "html":
        return report.html()
    if args.output == "sarif":
        return "".join(r["json"] + "\n" for r in report.sarif().toLocalIterator())
    if args.output == "markdown":
        rows = _lines(reports.markdown_lines(report.by_extension).orderBy("key"))
        return "\n".join(["| Extension | Files | Lines | Code | Comments | Docs | Size |", "|---|---|---|---|---|---|---|", *rows]) + "\n"
    if args.output == "table":
        return "\n".join([" ".join(f"{n:<{-w}}" if w < 0 else f"{n:>{w}}" for n, w in reports.TABLE_WIDTHS), *_lines(reports.table_lines(report.by_extension, args.sort, args.top))]) + "\n"
    line = reports.summary_lines(report.totals).first()
    if args.quiet:
        return line["quiet"] + "\n"
    if args.summary_only or args.compact:
        out = [line["summary" if args.summary_only else "compact"]]
        if args.show_quality:
            out.append(f"Quality: {report.quality.first()['overall']:.1f}/100")
        return "\n".join(out) + "\n"
    return _text(report, args)


def _text(report: api.Report, args: argparse.Namespace) -> str:
    out = [report.text()]
    rows = ranking.language_order(report.by_language, args.sort, args.asc)
    rows = rows if args.top is None else ranking.top_per_category(report.by_language, args.top, reports.SORTS[args.sort])
    for r in rows.orderBy("category", "rank").collect():
        out.append(f"{r['category']:<8} {r['language']:<24} {r['files']:>8,} files {r['total_lines']:>12,} lines {r['code_lines']:>12,} code")
    if args.show_time:
        minutes = report.totals.select(scores.minutes(F.col("code_lines")).alias("m")).first()["m"]
        out.append(f"Writing time: {minutes:,.0f} minutes, {minutes / 60 / 8:.1f} days")
    if args.show_size:
        out.append(reports.summary_lines(report.totals).first()["sized"])
    if args.show_ratios:
        out += [f"- {r['insight']}" for r in findings.insights(report_ratios(report)).collect()]
    if args.show_complexity:
        h = report.health.first()
        out.append(f"Health {h['health']:.1f}, maintainability {h['maintainability']:.1f}, debt {h['debt']:.1f}%")
    if args.show_functions:
        worst = complexity.details(report.functions).orderBy(F.col("cyclomatic").desc(), "path", "start_line").limit(args.top or 10)
        out += [f"{r['path']}:{r['start_line']} {r['name']} cyclomatic {r['cyclomatic']} ({r['level']}) {'; '.join(r['concerns'])}" for r in worst.collect()]
    if args.files:
        listed = report.stats.select("path", "total_lines").orderBy(sort_key(F.col("path")))
        out += [f"{r['path']} {r['total_lines']}" for r in (listed if args.top is None else listed.limit(args.top)).toLocalIterator()]
    if args.explain:
        out += [f"Skipped as {r['disposition']}: {r['files']}" for r in report.skipped.orderBy("disposition").collect()]
    return "\n".join(out) + "\n"


def report_ratios(report: api.Report) -> DataFrame:
    from plumbline.operators import rollups

    return rollups.ratios(report.totals)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = with_preset(parser().parse_args(argv))
    if not Path(args.path).exists():
        print(f"no such path: {args.path}", file=sys.stderr)
        return 2
    session = spark or SparkSession.builder.appName("plumbline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    options = options_of(args)
    if args.list:  # written as they come, a partition at a time
        found = api.list_files(session, args.path, replace(options, bounds=selection.Bounds())).toLocalIterator()
        with open(args.output_file, "w") if args.output_file else contextlib.nullcontext(sys.stdout) as out:
            out.writelines(r["path"] + "\n" for r in found)
        return 0
    report = api.analyze(session, args.path, options)
    try:
        text = render(report, args)
    finally:
        report.release()
    if args.output_file:
        Path(args.output_file).write_text(text)
    else:
        sys.stdout.write(text)
    return 0
