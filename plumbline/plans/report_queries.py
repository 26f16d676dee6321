"""Queries of the report sinks, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import api
from plumbline.functions import scores
from plumbline.operators import complexity, findings, incremental, ranking, reports, rollups
from plumbline.plans import views
from plumbline.plans.complexity_queries import ROWS, _rows
from plumbline.plans.file_queries import LINES, PIE, WITH, _sum_sql, query
from plumbline.plans.views import STATS_SQL, quoted

_SIZE = "CASE WHEN file_size < 1024 THEN CAST(file_size AS VARCHAR) || ' B' WHEN file_size < 1048576 THEN format('{:.1f} KB', file_size / 1024.0::DOUBLE) ELSE format('{:.1f} MB', file_size / 1048576.0::DOUBLE) END"
_CELLS = "key, " + ", ".join(f"format('{{:,}}', {c})" for c in ("files", "total_lines", "code_lines", "comment_lines", "doc_lines")) + f", {_SIZE}"


@query(f"{WITH} SELECT key, concat_ws(',', key, files, total_lines, code_lines, comment_lines, doc_lines, blank_lines, file_size) AS line FROM by_key")
def csv_report(spark, sf_dir):
    """Lines of the CSV report."""
    return reports.csv_lines(rollups.by_key(views.file_stats(spark, sf_dir)))


@query(f"{WITH} SELECT key, '| ' || concat_ws(' | ', {_CELLS}) || ' |' AS line FROM by_key")
def markdown_report(spark, sf_dir):
    """Lines of the Markdown report."""
    return reports.markdown_lines(rollups.by_key(views.file_stats(spark, sf_dir)))


@query(
    f"""{WITH}, cells AS (SELECT total_lines, key, {", ".join(f"format('{{:,}}', {c}) AS c{i}" for i, c in enumerate(("files", "total_lines", "code_lines", "comment_lines", "doc_lines")))}, {_SIZE} AS c5 FROM by_key)
SELECT concat_ws(' ', rpad(key, 12, ' '), lpad(c0, 8, ' '), lpad(c1, 10, ' '), lpad(c2, 10, ' '), lpad(c3, 12, ' '), lpad(c4, 10, ' '), lpad(c5, 12, ' ')) AS line FROM cells ORDER BY total_lines DESC, key LIMIT 5"""
)
def table_report(spark, sf_dir):
    """The leading lines of the table report."""
    return reports.table_lines(rollups.by_key(views.file_stats(spark, sf_dir)), most=5)


@query(
    f"""WITH {STATS_SQL}, w AS (SELECT count(*) AS files, {_sum_sql((*LINES, "file_size"))} FROM file_stats)
SELECT format('Summary: {{}} files, {{}} lines ({{}} code, {{}} comments)', files, total_lines, code_lines, comment_lines) AS summary, format('{{}} files | {{}} lines | {{}} code | {{}} comments', files, total_lines, code_lines, comment_lines) AS compact,
  format('{{}} files, {{}} lines', files, total_lines) AS quiet, format('{{}} files, {{}} lines, {{:.1f}} MB', files, total_lines, file_size / 1048576.0::DOUBLE) AS sized FROM w"""
)
def summary_report(spark, sf_dir):
    """The one-line reports."""
    return reports.summary_lines(rollups.totals(views.file_stats(spark, sf_dir)))


@query(
    f"""{WITH}, slices AS (WITH{PIE.format(v="total_lines", n=6)[1:]})
SELECT label, value, label || format(' ({{:.1f}}%)', CAST(value AS DOUBLE) / (SELECT sum(value) FROM slices) * 100) AS text FROM slices"""
)
def chart_report(spark, sf_dir):
    """Labels and values of the chart."""
    return reports.chart_lines(ranking.pie(rollups.by_key(views.file_stats(spark, sf_dir)), "total_lines", most=6))


@query(
    f"""{WITH}, {ROWS}, e AS (SELECT ext, count(*) AS functions, CAST(sum(cyclomatic) AS DOUBLE) / count(*) AS cyclomatic FROM rows GROUP BY ext)
SELECT key, concat_ws(',', key, files, total_lines, code_lines, comment_lines, doc_lines, blank_lines, file_size, coalesce(functions, 0), format('{{:.1f}}', coalesce(cyclomatic, 0.0::DOUBLE))) AS line FROM by_key LEFT JOIN e ON key = ext"""
)
def full_csv_report(spark, sf_dir):
    """CSV with functions."""
    return reports.full_csv_lines(rollups.by_key(views.file_stats(spark, sf_dir)), complexity.by_extension(_rows(spark, sf_dir)))


@query()
def project_report(spark, sf_dir):
    """The library's whole report of the decorated project, as one JSON row."""
    report = api.analyze(spark, views.files(spark, sf_dir))
    statistics = report.functions.agg(*complexity.statistics())
    return reports.json_report(report.totals, report.by_extension, rollups.ratios(report.totals), report.quality, statistics)


@query()
def sarif_report(spark, sf_dir):
    """Findings as SARIF logs."""
    return api.analyze(spark, views.files(spark, sf_dir)).sarif()


@query(
    f"""WITH {STATS_SQL}, m AS (SELECT count(*) AS discovered, count(*) FILTER (file_size % 7 <> 0) AS counted, CAST(coalesce(sum(file_size) FILTER (file_size % 7 <> 0), 0) AS BIGINT) AS bytes FROM file_stats)
SELECT discovered, counted, discovered - counted AS failed, bytes, counted / 4.0::DOUBLE AS files_per_second, bytes / 4.0::DOUBLE AS bytes_per_second, 10 + 0.001::DOUBLE * counted + bytes / (10.0::DOUBLE * 1024 * 1024) AS memory_estimate_mb FROM m"""
)
def run_counters(spark, sf_dir):
    """Run counters and rates of files of which some could not be read, for a run of four seconds."""
    files = views.files(spark, sf_dir)
    return reports.run_metrics(files.withColumn("content", F.when(F.col("size") % 7 != 0, F.col("content"))), 4.0)


LOGS = (
    '{"$schema": "https://x/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "t"}}}]}', '{"$schema": "https://x/sarif", "version": "2.0.0", "runs": []}',
    '{"version": "2.1.0", "runs": []}', '{"$schema": "sarif", "version": "2.1.0"}', '{"$schema": "sarif", "version": "2.1.0", "runs": []}',
    '{"$schema": "sarif", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "t"}}}, {"tool": {}}]}', "{}", "[",
)
FAULTS = (None, "version must be 2.1.0", "missing $schema", "missing runs array", "a log must contain at least one run", "a run does not name the tool that produced it", "version must be 2.1.0", "not valid JSON")


@query(f"SELECT doc_id, [{', '.join(map(quoted, FAULTS))}][doc_id % {len(LOGS)} + 1] AS fault FROM documents")
def sarif_faults(spark, sf_dir):
    """Why logs would not be accepted, for a log of some kind per document."""
    log = F.element_at(F.array(*map(F.lit, LOGS)), (F.col("doc_id") % len(LOGS) + 1).cast("int"))
    return views.load(spark, sf_dir, "documents").select("doc_id", findings.sarif_fault(log).alias("fault"))


@query(
    f"""WITH {STATS_SQL}, r AS (SELECT *, CASE WHEN total_lines = 0 THEN 0.0::DOUBLE ELSE CAST(doc_lines + comment_lines AS DOUBLE) / total_lines END AS told FROM file_stats),
f AS (SELECT 'HM001' AS rule, path FROM r WHERE total_lines > 1000 UNION ALL SELECT 'HM002', path FROM r WHERE told < 0.1::DOUBLE AND code_lines > 50 UNION ALL SELECT 'HM003', path FROM r WHERE code_lines = 0)
SELECT rule AS "ruleId", path AS uri, CAST(12 AS BIGINT) AS rules FROM f"""
)
def sarif_results(spark, sf_dir):
    """The results that valid SARIF logs hold, read back from their JSON, and how many rules their tool lists."""
    logs = findings.sarif(findings.file_findings(views.file_stats(spark, sf_dir)))
    runs = "struct<runs: array<struct<tool: struct<driver: struct<rules: array<struct<id: string>>>>, results: array<struct<ruleId: string, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>>>>>>>>>"
    run = logs.where(findings.sarif_fault(F.col("json")).isNull()).select(F.from_json("json", runs)["runs"][0].alias("run"))
    found = run.select(F.size("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("r"))
    return found.select("r.ruleId", F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"), "rules")


@query("SELECT event_type AS scope, CAST(event_id AS VARCHAR) AS path, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS rank FROM events")
def scope_ranks(spark, sf_dir):
    """Entries of each scope, the newest first."""
    rows = views.load(spark, sf_dir, "events").select(F.col("event_type").alias("scope"), F.col("event_id").cast("string").alias("path"), "ts")
    return incremental.running_rank(rows, "ts")


@query("SELECT CAST(user_id AS VARCHAR) AS name, max(event_id) AS touched FROM events GROUP BY user_id ORDER BY touched DESC, name LIMIT 64")
def newest_scopes(spark, sf_dir):
    """The scopes that were used last, as many as are kept."""
    return incremental.newest_scopes(views.load(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("name")).agg(F.max("event_id").alias("touched")))


@query("SELECT o_orderkey, format('{:.1f}', (o_orderkey % 401) / 4.0::DOUBLE + 0.01::DOUBLE) || '%' AS share FROM orders")
def percent_forms(spark, sf_dir):
    """Shares as they are shown."""
    return views.load(spark, sf_dir, "orders").select("o_orderkey", scores.percent((F.col("o_orderkey") % 401) / 4.0 + 0.01).alias("share"))
