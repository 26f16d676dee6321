"""Queries of labels, estimates, recommendations and merged complexity, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import advice, complexity, findings, rollups, selection
from plumbline.plans import views
from plumbline.plans.analyzer_queries import SAMPLES, files
from plumbline.plans.complexity_queries import ROWS, _rows
from plumbline.plans.file_queries import LISTING, QUALITY_SQL, WITH, _ratio, listing, query
from plumbline.plans.views import LANGUAGES_SQL, STATS_SQL, load, quoted

_case = lambda values, other, form="{}": "CASE key " + " ".join(f"WHEN {quoted(k)} THEN {form.format(v)}" for k, v in values.items()) + f" ELSE {form.format(other)} END"
_CLASSES = {e: name for name, exts in advice.COMPLEXITY_CLASS.items() for e in exts.split()}


@query(
    f"""{WITH}, g AS (SELECT key, code_lines, least(10.0::DOUBLE, {_case(advice.BASE_COMPLEXITY, advice.OTHER_COMPLEXITY, "{}::DOUBLE")} + CASE WHEN total_lines > 1000 THEN 2 WHEN total_lines > 500 THEN 1 ELSE 0 END +
  CASE WHEN CAST(comment_lines AS DOUBLE) / greatest(total_lines, 1) < 0.1::DOUBLE THEN 1 ELSE 0 END) AS complexity FROM by_key)
SELECT key, complexity, CAST(trunc(code_lines * {_case(advice.FUNCTION_DENSITY, advice.OTHER_DENSITY, "{}::DOUBLE")}) AS BIGINT) AS functions, 'complexity-' || {_case(_CLASSES, "low", "'{}'")} AS kind,
  'complexity-' || CASE WHEN complexity <= 2 THEN 'very-low' WHEN complexity <= 4 THEN 'low' WHEN complexity <= 6 THEN 'medium' WHEN complexity <= 8 THEN 'high' ELSE 'very-high' END AS level FROM g"""
)
def extension_estimates(spark, sf_dir):
    """Guesses and classes per extension."""
    return advice.estimates(rollups.by_key(views.file_stats(spark, sf_dir)))


@query(
    f"""WITH {STATS_SQL}, p AS (SELECT *, {_ratio("code_lines", "total_lines")} * 100 AS share FROM file_stats)
SELECT path, CASE WHEN total_lines <= 100 THEN 'Mild regret' WHEN total_lines <= 500 THEN 'Moderate regret' WHEN total_lines <= 2000 THEN 'High regret' ELSE 'Existential crisis' END AS regret,
  CASE WHEN share >= 80 AND share <= 100 THEN '🔥 Code machine' WHEN share >= 60 AND share <= 79.9::DOUBLE THEN '💪 Productive' WHEN share >= 40 AND share <= 59.9::DOUBLE THEN '📝 Documenter' WHEN share >= 20 AND share <= 39.9::DOUBLE THEN '💬 Commenter' ELSE '🌬️ Air enthusiast' END AS productivity,
  least(10.0::DOUBLE, 1 + least(total_lines / 100.0::DOUBLE, 5.0::DOUBLE) + CASE WHEN CAST(comment_lines AS DOUBLE) / greatest(total_lines, 1) < 0.1::DOUBLE THEN 1 ELSE 0 END + CASE WHEN CAST(code_lines AS DOUBLE) / greatest(total_lines, 1) > 0.8::DOUBLE THEN 1 ELSE 0 END) AS complexity
FROM p"""
)
def file_labels(spark, sf_dir):
    """Labels and guesses per file."""
    c = F.col
    return views.file_stats(spark, sf_dir).select(
        "path", advice.regret_level(c("total_lines")).alias("regret"), advice.productivity(c("total_lines"), c("code_lines")).alias("productivity"), advice.file_complexity(c("total_lines"), c("code_lines"), c("comment_lines")).alias("complexity")
    )


PROJECTS = f"""{ROWS}, projects AS (SELECT CAST(cyclomatic % 7 AS BIGINT) AS project, count(*) AS functions, CAST(sum(cyclomatic) AS DOUBLE) / count(*) AS cyclomatic, CAST(sum(cognitive) AS DOUBLE) / count(*) AS cognitive,
  CAST(sum(line_count) AS DOUBLE) / count(*) AS average_length, max(line_count) AS max_length, min(line_count) AS min_length, max(nesting_depth) AS max_nesting, CAST(sum(nesting_depth) AS DOUBLE) / count(*) AS average_nesting,
  CAST(sum(parameter_count) AS DOUBLE) / count(*) AS average_parameters, max(parameter_count) AS max_parameters, count(*) FILTER (cyclomatic BETWEEN 21 AND 50) AS high, count(*) FILTER (cyclomatic < 1 OR cyclomatic > 50) AS very_high FROM rows GROUP BY 1)"""


def _projects(spark, sf_dir):
    return _rows(spark, sf_dir).withColumn("project", F.col("cyclomatic") % 7).groupBy("project").agg(*complexity.statistics(), *complexity.distribution())


@query(
    f"""WITH {PROJECTS} SELECT count(*) AS reports, CAST(sum(functions) AS BIGINT) AS functions, round(sum(cyclomatic * functions) / sum(functions), 7) AS cyclomatic, round(sum(cognitive * functions) / sum(functions), 7) AS cognitive,
  round(sum(trunc(average_length * functions)) / sum(functions), 7) AS average_length, max(max_length) AS max_length, min(min_length) AS min_length, max(max_nesting) AS max_nesting, round(sum(average_nesting * functions) / sum(functions), 7) AS average_nesting,
  round(sum(trunc(average_parameters * functions)) / sum(functions), 7) AS average_parameters, max(max_parameters) AS max_parameters FROM projects"""
)
def merge_complexity(spark, sf_dir):
    """Several projects' function statistics as one."""
    merged = advice.merge_complexity(_projects(spark, sf_dir))
    means = ("cyclomatic", "cognitive", "average_length", "average_nesting", "average_parameters")
    return merged.withColumns({c: F.round(c, 7) for c in means})


@query(
    f"""WITH {PROJECTS} SELECT project, unnest(list_filter([CASE WHEN high + very_high > 0 THEN format('{{:.1f}}% of functions have high complexity', CAST(high + very_high AS DOUBLE) / functions * 100) END,
  CASE WHEN cyclomatic <= 3 THEN 'Excellent complexity management' WHEN cyclomatic <= 7 THEN 'Good complexity levels overall' ELSE 'Consider refactoring for better complexity' END,
  CASE WHEN average_length <= 20 THEN 'Functions are well-sized' WHEN average_length <= 40 THEN 'Function sizes are reasonable' ELSE 'Consider breaking down large functions' END,
  CASE WHEN max_nesting <= 3 THEN 'Good nesting depth control' ELSE 'Consider reducing nesting depth' END], lambda x: x IS NOT NULL)) AS insight FROM projects"""
)
def complexity_insights(spark, sf_dir):
    """What a project's function statistics say."""
    return advice.complexity_insights(_projects(spark, sf_dir), "project")


@query(
    """WITH p AS (SELECT o_orderkey % 12 AS average_complexity, o_custkey % 100 AS maintainability, o_orderkey % 50 AS coverage, o_custkey % 90 AS size_health, o_orderkey % 9 AS max_nesting, o_custkey % 60 AS debt, o_orderkey % 70 AS average_length, o_custkey % 11 AS cyclomatic FROM orders),
f AS (SELECT unnest(list_filter([CASE WHEN average_complexity > 10 THEN 'High Complexity Functions|High' END, CASE WHEN maintainability < 60 THEN 'Low Maintainability Index|High' END, CASE WHEN coverage < 25 THEN 'Low Documentation Coverage|Medium' END,
  CASE WHEN size_health < 70 THEN 'Large Functions Detected|Medium' END, CASE WHEN max_nesting > 5 THEN 'Deep Nesting Detected|Medium' END, CASE WHEN debt > 40 THEN 'High Technical Debt|High' END, CASE WHEN average_length > 50 THEN 'Long Functions|Low' END,
  CASE WHEN cyclomatic <= 5 THEN 'Good Code Complexity|Low' END], lambda x: x IS NOT NULL)) AS r FROM p)
SELECT split_part(r, '|', 1) AS title, split_part(r, '|', 2) AS priority, count(*) AS times FROM f GROUP BY 1, 2"""
)
def recommendations(spark, sf_dir):
    """Recommendations over many rows of statistics."""
    parts = "o_orderkey % 12 AS average_complexity, o_custkey % 100 AS maintainability, o_orderkey % 50 AS coverage, o_custkey % 90 AS size_health, o_orderkey % 9 AS max_nesting, o_custkey % 60 AS debt, o_orderkey % 70 AS average_length, o_custkey % 11 AS cyclomatic"
    rows = load(spark, sf_dir, "orders").selectExpr(*parts.split(", "))
    return advice.recommendations(rows).groupBy("title", "priority").agg(F.count(F.lit(1)).alias("times"))


@query(
    f"""WITH {ROWS}, c AS (SELECT count(*) FILTER (cyclomatic BETWEEN 6 AND 10) AS low, count(*) FILTER (cyclomatic BETWEEN 11 AND 20) AS medium, count(*) FILTER (cyclomatic BETWEEN 21 AND 50) AS high, count(*) FILTER (cyclomatic < 1 OR cyclomatic > 50) AS very_high FROM rows),
s(label, value) AS (SELECT 'Low Complexity (1-10)', low FROM c UNION ALL SELECT 'Medium Complexity (11-20)', medium FROM c UNION ALL SELECT 'High Complexity (21-50)', high FROM c UNION ALL SELECT 'Very High Complexity (50+)', very_high FROM c)
SELECT * FROM s WHERE value > 0"""
)
def pie_complexity(spark, sf_dir):
    """Slices by complexity class."""
    return advice.complexity_pie(_rows(spark, sf_dir).agg(*complexity.distribution()))


@query("SELECT 'Classes' AS label, count(*) AS value FROM documents UNION ALL SELECT 'Structs', count(*) FROM documents")
def pie_structures(spark, sf_dir):
    """Slices by kind of the structures that analyzers find: a file for each document in two languages, one with a struct, one with a class of its own."""
    found = [complexity.structures(complexity.analyze(files(spark, sf_dir, SAMPLES[x]))) for x in ("go", "matlab")]
    return advice.structure_pie(found[0].unionByName(found[1]).agg(*complexity.structure_counts()))


@query(
    """WITH s AS (SELECT CASE l_linenumber WHEN 1 THEN 'Classes' WHEN 2 THEN 'Interfaces' WHEN 3 THEN 'Traits' WHEN 4 THEN 'Enums' WHEN 5 THEN 'Structs' ELSE 'Modules' END AS label FROM lineitem)
SELECT label, count(*) AS value FROM s GROUP BY label"""
)
def pie_structure_kinds(spark, sf_dir):
    """Slices by kind of structure, over the kinds of a whole table."""
    kinds = ["Class", "Interface", "Trait", "Enum", "Struct", "Module"]
    kind = F.coalesce(F.get(F.array(*map(F.lit, kinds)), (F.col("l_linenumber") - 1).cast("int")), F.lit("Namespace"))
    rows = load(spark, sf_dir, "lineitem").select(kind.alias("kind"), (F.col("l_partkey") % 9).alias("method_count"))
    return advice.structure_pie(rows.agg(*complexity.structure_counts()))


@query(
    f"""WITH {LISTING}, {LANGUAGES_SQL}, e AS (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM listing),
d AS (SELECT ext, 'Detected ' || min(page_id) AS told FROM e WHERE page_id % 4 = 1 GROUP BY ext)
SELECT page_id, path, coalesce(told, language) AS language FROM e LEFT JOIN d ON e.ext = d.ext LEFT JOIN languages ON e.ext = lkey"""
)
def detected_languages(spark, sf_dir):
    """Languages by a detector's labels, else by the table."""
    files = listing(spark, sf_dir)
    detected = files.where("page_id % 4 = 1").select(F.concat(F.lit("Detected "), F.col("page_id").cast("string")).alias("name"), "path", F.col("page_id").alias("position"))
    told = advice.detected_language(files.select(F.concat_ws("|", F.col("page_id").cast("string"), "path").alias("path")), detected, views.languages(spark))
    return told.select(F.split_part("path", F.lit("|"), F.lit(1)).cast("long").alias("page_id"), F.split_part("path", F.lit("|"), F.lit(2)).alias("path"), "language")


_PAIRS = {
    "total_files": "CAST(files AS VARCHAR)", "total_lines": "CAST(total_lines AS VARCHAR)", "code_lines": "CAST(code_lines AS VARCHAR)", "languages": "CAST(languages AS VARCHAR)",
    "functions": "CAST(functions AS VARCHAR)", "avg_complexity": "format('{:.1f}', cyclomatic)", "quality_score": "format('{:.1f}', overall)",
    "quality_level": "CASE WHEN overall >= 80 THEN 'Excellent' WHEN overall >= 60 THEN 'Good' ELSE 'Needs Improvement' END",
    "complexity_level": "CASE WHEN cyclomatic <= 5 THEN 'Low' WHEN cyclomatic <= 10 THEN 'Medium' ELSE 'High' END",
}


@query(
    QUALITY_SQL.rsplit("\nSELECT ", 1)[0]
    + f""", {ROWS}, c AS (SELECT count(*) AS functions, CAST(sum(cyclomatic) AS DOUBLE) / count(*) AS cyclomatic FROM rows),
t AS (SELECT count(*) AS languages, sum(files) AS files, sum(total_lines) AS total_lines, sum(code_lines) AS code_lines FROM by_key)
"""
    + " UNION ALL ".join(f"SELECT '{name}' AS name, {value} AS value FROM t, c, final" for name, value in _PAIRS.items())
)
def summary_pairs(spark, sf_dir):
    """All pairs of the short summary."""
    stats = views.file_stats(spark, sf_dir)
    keyed = rollups.by_key(stats)
    totals = keyed.agg(*(F.sum(c).alias(c) for c in ("files", "total_lines", "code_lines")), F.count(F.lit(1)).alias("kinds"))
    statistics = _rows(spark, sf_dir).agg(*complexity.statistics())
    return advice.summary(totals, statistics, rollups.quality(stats), F.col("kinds"))


@query(f"WITH {STATS_SQL} SELECT path, total_lines FROM file_stats WHERE {_ratio('doc_lines', 'total_lines')} <= 0.1::DOUBLE")
def undocumented_files(spark, sf_dir):
    """The shortcut for files with little documentation."""
    bounds = selection.Bounds(**selection.SHORTCUTS["undocumented"])
    return selection.files_within(views.file_stats(spark, sf_dir), bounds).select("path", "total_lines")


_HEALTH = "WITH p AS (SELECT o_orderkey % 2000 AS files, o_custkey % 900 AS functions, CAST(o_orderkey % 37 AS DOUBLE) / 4 AS cyclomatic, CAST(o_custkey % 401 AS DOUBLE) / 4 AS health, CAST(o_orderkey % 397 AS DOUBLE) / 4 AS maintainability, CAST(o_custkey % 399 AS DOUBLE) / 4 AS overall FROM orders)"


@query(
    f"""{_HEALTH}, f AS (SELECT 'HM000' AS rule, 'note' AS level, 'project://summary' AS uri FROM p UNION ALL SELECT 'HM401', 'warning', 'project://technical-debt' FROM p WHERE health < 70
UNION ALL SELECT 'HM402', 'note', 'project://quality-insights' FROM p) SELECT rule, level, uri, count(*) AS times FROM f GROUP BY ALL"""
)
def assessment_findings(spark, sf_dir):
    """Findings of many project assessments, counted."""
    parts = ["o_orderkey % 2000 AS files", "o_custkey % 900 AS functions", "cast(o_orderkey % 37 AS DOUBLE) / 4 AS cyclomatic", "cast(o_custkey % 401 AS DOUBLE) / 4 AS health", "cast(o_orderkey % 397 AS DOUBLE) / 4 AS maintainability", "cast(o_custkey % 399 AS DOUBLE) / 4 AS overall"]
    rows = findings.assessment_findings(load(spark, sf_dir, "orders").selectExpr(*parts))
    return rows.groupBy("rule", "level", "uri").agg(F.count(F.lit(1)).alias("times"))
