"""Rule engines: rows of findings from file, extension and project statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scores
from plumbline.functions.paths import extension, to_uri

PROJECT_URI = "project://summary"

# Identifiers, names and descriptions of the rules, as logs list them.
RULES = [
    ("HM000", "Project Summary", "Provides an overview of project statistics"),
    ("HM001", "Large File", "Detects files that may be too large and should be split"),
    ("HM002", "Low Documentation", "Identifies files with insufficient documentation"),
    ("HM003", "Empty File", "Detects files with no code content"),
    ("HM101", "High Complexity", "Identifies functions or files with high cyclomatic complexity"),
    ("HM102", "High Cognitive Complexity", "Detects code that may be difficult to understand"),
    ("HM103", "Deep Nesting", "Identifies deeply nested code structures"),
    ("HM201", "Low Maintainability", "Detects code with low maintainability scores"),
    ("HM202", "Poor Code Health", "Identifies overall code health issues"),
    ("HM301", "Large Project", "Warns about projects that may benefit from modularization"),
    ("HM401", "Technical Debt Alert", "Highlights significant technical debt indicators"),
    ("HM402", "Quality Assessment Insights", "Provides overall code quality insights"),
]
SARIF_VERSION = "2.1.0"


def _rule(when: Column, rule: str, name: str, level: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("name"), F.lit(level).alias("level"), message.alias("message")))


def _rows(df: DataFrame, uri: Column, rules: list[Column]) -> DataFrame:
    found = df.select(uri.alias("uri"), F.explode(F.array_compact(F.array(*rules))).alias("f"))
    return found.select("f.rule", "f.name", "f.level", "f.message", "uri")


def _told(pattern: str, *values: Column) -> Column:
    return scores.told(pattern, *values)


def file_findings(stats: DataFrame) -> DataFrame:
    """``rule, name, level, message, uri`` of single files: large, undocumented, without code."""
    told = scores.ratio(F.col("doc_lines") + F.col("comment_lines"), F.col("total_lines"))
    rules = [
        _rule(F.col("total_lines") > 1000, "HM001", "Large File", "warning", _told("File has %d lines, consider breaking it into smaller modules", F.col("total_lines"))),
        _rule((told < 0.1) & (F.col("code_lines") > 50), "HM002", "Low Documentation", "info", _told("Documentation ratio is %.1f%%, consider adding more comments and documentation", told * 100)),
        _rule(F.col("code_lines") == 0, "HM003", "Empty File", "note", F.lit("File contains no code lines, consider removing if unused")),
    ]
    return _rows(stats, to_uri(F.col("path")), rules)


def complexity_findings(stats: DataFrame, by_extension: DataFrame) -> DataFrame:
    """Findings of files by what is known of their extension (ext, cyclomatic, cognitive, max_nesting)."""
    known = F.broadcast(by_extension.select(F.col("ext").alias("known_ext"), "cyclomatic", "cognitive", "max_nesting"))  # one row an extension
    joined = stats.join(known, F.coalesce(extension(F.col("path")), F.lit("unknown")) == F.col("known_ext"))
    rules = [
        _rule(F.col("cyclomatic") > 15, "HM101", "High Complexity", "warning", _told("Average cyclomatic complexity is %.1f, consider refactoring", F.col("cyclomatic"))),
        _rule(F.col("cognitive") > 20, "HM102", "High Cognitive Complexity", "warning", _told("Cognitive complexity is %.1f, may be difficult to understand", F.col("cognitive"))),
        _rule(F.col("max_nesting") > 5, "HM103", "Deep Nesting", "info", _told("Maximum nesting depth is %d, consider extracting nested logic", F.col("max_nesting"))),
    ]
    return _rows(joined, to_uri(F.col("path")), rules)


def health_findings(stats: DataFrame, project: DataFrame) -> DataFrame:
    """Findings that a poor project (one row: maintainability, health) brings to each of its files."""
    joined = stats.crossJoin(F.broadcast(project.select("maintainability", "health")))  # one row
    rules = [
        _rule(F.col("maintainability") < 50, "HM201", "Low Maintainability", "warning", _told("Maintainability index is %.1f/100, consider refactoring", F.col("maintainability"))),
        _rule(F.col("health") < 60, "HM202", "Poor Code Health", "info", _told("Code health score is %.1f/100, review code quality practices", F.col("health"))),
    ]
    return _rows(joined, to_uri(F.col("path")), rules)


def project_findings(totals: DataFrame) -> DataFrame:
    """Findings of the project's sums."""
    summary = _told("Project contains %d files with %d total lines (%d code, %d comments)", *(F.col(c) for c in ("files", "total_lines", "code_lines", "comment_lines")))
    rules = [
        _rule(F.lit(True), "HM000", "Project Summary", "note", summary),
        _rule(F.col("files") > 1000, "HM301", "Large Project", "info", _told("Project has %d files, consider modularization strategies", F.col("files"))),
    ]
    return _rows(totals, F.lit(PROJECT_URI), rules)


def assessment_findings(project: DataFrame) -> DataFrame:
    """Findings of whole-project assessments (files, functions, cyclomatic, health, maintainability, overall)."""
    c = F.col
    summary = _told("Project: %d files, %d functions, %.1f avg complexity, %.1f/100 quality score", c("files"), c("functions"), c("cyclomatic"), c("health"))
    debt = _told("Overall code health is %.1f/100. Consider prioritizing refactoring efforts", c("health"))
    insight = _told("Overall code quality: %.1f/100 (Maintainability: %.1f/100, Code Health: %.1f/100)", c("overall"), c("maintainability"), c("health"))
    found = [
        _rows(project, F.lit(PROJECT_URI), [_rule(F.lit(True), "HM000", "Comprehensive Project Summary", "note", summary)]),
        _rows(project, F.lit("project://technical-debt"), [_rule(c("health") < 70, "HM401", "Technical Debt Alert", "warning", debt)]),
        _rows(project, F.lit("project://quality-insights"), [_rule(F.lit(True), "HM402", "Quality Assessment Insights", "note", insight)]),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


def diagnostics(stats: DataFrame, max_lines: int = 800, min_doc_ratio: float = 0.05, documented_from: int = 200) -> DataFrame:
    """Editor diagnostics: ``path, code, message``; a limit of 0 turns its rule off."""
    told = F.col("doc_lines") + F.col("comment_lines")
    n = scores.grouped_number
    long = F.lit(max_lines > 0) & (F.col("total_lines") > max_lines)
    bare = F.lit(min_doc_ratio > 0) & (F.col("code_lines") >= documented_from) & (told < min_doc_ratio * F.col("code_lines"))
    messages = [
        F.when(long, F.struct(F.lit("long-file").alias("code"), F.concat(n(F.col("total_lines")), F.lit(f" lines, over the {max_lines:,} this project allows")).alias("message"))),
        F.when(
            bare,
            F.struct(
                F.lit("undocumented").alias("code"),
                F.concat(n(F.col("code_lines")), F.lit(" lines of code with "), n(told), F.lit(f" of documentation, under the {min_doc_ratio * 100:.0f}% this project asks for")).alias("message"),
            ),
        ),
    ]
    return stats.select("path", F.explode(F.array_compact(F.array(*messages))).alias("d")).select("path", "d.code", "d.message")


def lens(stats: DataFrame) -> DataFrame:
    """``path, title``: one line over each file (with ``language``), parts of zero left out."""
    n = scores.grouped_number
    parts = [F.concat(n(F.col("total_lines")), F.lit(" "), F.col("language"))]
    for column, label in (("code_lines", "code"), ("doc_lines", "doc"), ("comment_lines", "comment"), ("blank_lines", "blank")):
        parts.append(F.when(F.col(column) > 0, F.concat(n(F.col(column)), F.lit(f" {label}"))))
    return stats.select("path", F.concat_ws(" · ", *parts).alias("title"))


def insights(ratios: DataFrame, *kept: str) -> DataFrame:
    """``insight`` rows of each row of ratios, with the columns to keep."""
    c = F.col
    told = [
        F.when(c("code_ratio") > 0.8, "High code density - very efficient!").when(c("code_ratio") < 0.4, "Low code density - lots of documentation or comments"),
        F.when(c("comment_ratio") > 0.3, "Very well commented code").when(c("comment_ratio") < 0.05, "Could use more comments for clarity"),
        F.when(c("doc_ratio") > 0.2, "Excellent documentation coverage").when(c("doc_ratio") < 0.05, "Consider adding more documentation"),
        F.when(c("blank_ratio") > 0.4, "Very spacious code - lots of breathing room").when(c("blank_ratio") < 0.1, "Dense code - consider adding blank lines for readability"),
    ]
    return ratios.select(*kept, F.explode(F.array_compact(F.array(*told))).alias("insight"))


def sarif(findings: DataFrame, tool: str = "plumbline", version: str = "0.1.0") -> DataFrame:
    """``json``: one SARIF 2.1.0 log per partition of findings, each of a bounded number of results.

    A log is a document, so its results meet in one row; ``write`` splits by ``uri`` hash when there are many.
    """
    result = F.struct(
        F.col("rule").alias("ruleId"),
        F.when(F.col("level") == "info", "note").otherwise(F.col("level")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"),
    )
    # Logs of some 50,000 results: the shard is a hash of the finding and its row, so equal findings spread as well.
    shards = F.lit(max(1, -(-findings.count() // 50_000)))
    sharded = findings.select(F.pmod(F.xxhash64("uri", "rule", "message", F.monotonically_increasing_id()), shards).alias("shard"), result.alias("r"))
    logs = sharded.groupBy("shard").agg(F.array_sort(F.collect_list("r")).alias("results"))
    about = [F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.struct(F.lit(d).alias("text")).alias("shortDescription")) for i, n, d in RULES]
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.array(*about).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results").alias("results"))
    log = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs"))
    return logs.select(F.to_json(log).alias("json"))


def sarif_fault(log: Column) -> Column:
    """Why a SARIF log (a JSON string) is none that its readers accept; null if it is one."""
    at = lambda path: F.get_json_object(log, path)
    runs = F.from_json(at("$.runs"), "array<struct<tool: struct<driver: struct<name: string>>>>")
    nameless = F.exists(runs, lambda r: F.coalesce(r["tool"]["driver"]["name"], F.lit("")) == "")
    return (
        F.when(at("$").isNull(), "not valid JSON")
        .when(F.coalesce(at("$.version"), F.lit("")) != SARIF_VERSION, f"version must be {SARIF_VERSION}")
        .when(~F.coalesce(F.get_json_object(log, "$['$schema']"), F.lit("")).contains("sarif"), "missing $schema")
        .when(runs.isNull(), "missing runs array")
        .when(F.size(runs) == 0, "a log must contain at least one run")
        .when(nameless, "a run does not name the tool that produced it")
    )
