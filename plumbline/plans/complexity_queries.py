"""Queries of the function metrics.

Queries that SQL can follow line by line run the analyzers (``analyzer_queries``); the statistics
here run on function rows made up from ``lineitem``, of files made up from ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import complexity, findings, selection
from plumbline.plans.file_queries import query
from plumbline.plans.views import load

CODE = {
    "rs": "pub fn f{i}(a: i32, b: &str) -> i32 {{", "py": "def f{i}(self, a, b):", "js": "function f{i}(a, b) {{", "go": "func (t *T) f{i}(a int) error {{", "c": "int f{i}(int a, char b) {{",
}

SHAPES = {"rs": "pub struct S {", "py": "class S(B):", "js": "export class S {", "go": "type S struct {", "c": "struct S {"}

ROWS = """rows AS (SELECT 'p' || (l_orderkey % 9800) || '.rs' AS path, CASE WHEN l_orderkey % 3 = 0 THEN 'py' ELSE 'rs' END AS ext, CAST(l_quantity * 2.4::DOUBLE AS BIGINT) AS line_count, l_partkey % 60 AS cyclomatic,
  l_suppkey % 30 AS cognitive, (l_linenumber + l_orderkey) % 11 AS nesting_depth, CAST(l_linenumber AS BIGINT) AS parameter_count, l_partkey % 8 AS return_path_count, l_orderkey % 2 = 0 AS has_recursion FROM lineitem)"""
STATS = """stats AS (SELECT 'p' || i || '.rs' AS path, (i % 30) * 100 AS total_lines, (i % 30) * 100 * (i % 10) // 10 AS code_lines, (i % 30) * 5 AS comment_lines, (i % 7) * (i % 30) AS doc_lines FROM (SELECT doc_id AS i FROM documents))"""
SCORE = "greatest(0.0::DOUBLE, 50 - line_count * 1.0::DOUBLE) + greatest(0.0::DOUBLE, 30 - cyclomatic * 2.0::DOUBLE) + greatest(0.0::DOUBLE, 30 - cognitive * 2.0::DOUBLE) + greatest(0.0::DOUBLE, 20 - parameter_count * 3.0::DOUBLE)"


def _rows(spark, sf_dir):
    c = F.col
    return load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), (c("l_orderkey") % 9800).cast("string"), F.lit(".rs")).alias("path"),
        F.when(c("l_orderkey") % 3 == 0, "py").otherwise("rs").alias("ext"),
        F.round(c("l_quantity") * 2.4, 0).cast("long").alias("line_count"),
        (c("l_partkey") % 60).alias("cyclomatic"),
        (c("l_suppkey") % 30).alias("cognitive"),
        ((c("l_linenumber") + c("l_orderkey")) % 11).alias("nesting_depth"),
        c("l_linenumber").cast("long").alias("parameter_count"),
        (c("l_partkey") % 8).alias("return_path_count"),
        (c("l_orderkey") % 2 == 0).alias("has_recursion"),
    )


def _stats(spark, sf_dir):
    return load(spark, sf_dir, "documents").selectExpr(
        "concat('p', doc_id, '.rs') AS path", "(doc_id % 30) * 100 AS total_lines", "((doc_id % 30) * 100 * (doc_id % 10)) div 10 AS code_lines", "(doc_id % 30) * 5 AS comment_lines",
        "(doc_id % 7) * (doc_id % 30) AS doc_lines",
    )


def _code_files(spark, sf_dir):
    """Decorated documents whose every fourth line opens a function and every following one closes it."""
    base = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    exts = list(CODE)
    heads = F.array(*(F.lit(h.replace("{i}", "").replace("{{", "{")) for h in CODE.values()))
    shapes = F.array(*map(F.lit, SHAPES.values()))
    k = (F.col("doc_id") % len(exts) + 1).cast("int")

    def line(x, i):
        return F.when(i % 12 == 8, F.element_at(shapes, k)).when(i % 4 == 0, F.element_at(heads, k)).when(i % 4 == 3, F.lit("}")).when(i % 4 == 1, F.concat(F.lit("    if (a && b) { return "), x, F.lit("; }"))).otherwise(F.concat(F.lit("    "), x))

    content = F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")
    path = F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, exts)), k))
    return base.select(path.alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("size"))


@query()
def function_rows(spark, sf_dir):
    """Functions of the decorated documents."""
    return complexity.functions(complexity.analyze(_code_files(spark, sf_dir), structures=False))


@query()
def structure_rows(spark, sf_dir):
    """Structures of the decorated documents."""
    return complexity.structures(complexity.analyze(_code_files(spark, sf_dir)))


@query()
def project_complexity(spark, sf_dir):
    """Statistics, distribution and health of the decorated project."""
    rows = complexity.functions(complexity.analyze(_code_files(spark, sf_dir), structures=False))
    return rows.agg(*complexity.statistics(), *complexity.distribution())


@query(
    f"""WITH {ROWS}, {STATS}, k AS (SELECT ext, CAST(sum(cyclomatic) AS DOUBLE) / count(*) AS cyclomatic, max(nesting_depth) AS max_nesting FROM rows GROUP BY ext), j AS (SELECT path, k.* FROM stats JOIN k ON ext = 'rs')
SELECT 'HM101' AS rule, 'High Complexity' AS name, 'warning' AS level, format('Average cyclomatic complexity is {{:.1f}}, consider refactoring', cyclomatic) AS message, path AS uri FROM j WHERE cyclomatic > 15
UNION ALL SELECT 'HM103', 'Deep Nesting', 'info', format('Maximum nesting depth is {{}}, consider extracting nested logic', max_nesting), path FROM j WHERE max_nesting > 5"""
)
def complexity_findings(spark, sf_dir):
    """Findings by what is known of an extension (its reported cognitive number stays 0, so that rule never holds)."""
    rows = _rows(spark, sf_dir)
    return findings.complexity_findings(_stats(spark, sf_dir), complexity.by_extension(rows))


@query(
    f"""WITH {ROWS} SELECT path, count(*) AS functions, CAST(sum(cyclomatic) AS DOUBLE) / count(*) AS cyclomatic, CAST(sum(cognitive) AS DOUBLE) / count(*) AS cognitive, CAST(sum(line_count) AS DOUBLE) / count(*) AS average_length,
  max(line_count) AS max_length, min(line_count) AS min_length, max(nesting_depth) AS max_nesting, CAST(sum(nesting_depth) AS DOUBLE) / count(*) AS average_nesting,
  CAST(sum(parameter_count) AS DOUBLE) / count(*) AS average_parameters, max(parameter_count) AS max_parameters FROM rows GROUP BY path"""
)
def file_complexity(spark, sf_dir):
    """Function statistics per file."""
    return _rows(spark, sf_dir).groupBy("path").agg(*complexity.statistics())


@query(
    f"""WITH {ROWS} SELECT ext, count(*) AS functions, CAST(sum(cyclomatic) AS DOUBLE) / count(*) AS cyclomatic, CAST(sum(line_count) AS DOUBLE) / count(*) AS average_length, max(nesting_depth) AS max_nesting,
  CAST(sum(nesting_depth) AS DOUBLE) / count(*) AS average_nesting, 0.0::DOUBLE AS cognitive, CAST(sum(cognitive) AS DOUBLE) / count(*) AS true_cognitive FROM rows GROUP BY ext"""
)
def extension_complexity(spark, sf_dir):
    """Function statistics per extension."""
    return complexity.by_extension(_rows(spark, sf_dir))


@query(
    f"""WITH {ROWS} SELECT count(*) FILTER (cyclomatic BETWEEN 1 AND 5) AS very_low, count(*) FILTER (cyclomatic BETWEEN 6 AND 10) AS low, count(*) FILTER (cyclomatic BETWEEN 11 AND 20) AS medium,
  count(*) FILTER (cyclomatic BETWEEN 21 AND 50) AS high, count(*) FILTER (cyclomatic < 1 OR cyclomatic > 50) AS very_high FROM rows"""
)
def complexity_distribution(spark, sf_dir):
    """Functions by cyclomatic class."""
    return _rows(spark, sf_dir).agg(*complexity.distribution())


@query(
    """WITH s AS (SELECT CASE l_linenumber WHEN 1 THEN 'Class' WHEN 2 THEN 'Interface' WHEN 3 THEN 'Trait' WHEN 4 THEN 'Enum' WHEN 5 THEN 'Struct' WHEN 6 THEN 'Module' ELSE 'Namespace' END AS kind, l_partkey % 9 AS method_count FROM lineitem)
SELECT count(*) AS structures, count(*) FILTER (kind = 'Class') AS classes, count(*) FILTER (kind = 'Interface') AS interfaces, count(*) FILTER (kind = 'Trait') AS traits, count(*) FILTER (kind = 'Enum') AS enums,
  count(*) FILTER (kind = 'Struct') AS structs, count(*) FILTER (kind IN ('Module', 'Namespace')) AS modules, CAST(sum(method_count) FILTER (kind = 'Class') AS DOUBLE) / count(*) FILTER (kind = 'Class') AS methods_per_class FROM s"""
)
def structure_distribution(spark, sf_dir):
    """Structures by kind."""
    kinds = ["Class", "Interface", "Trait", "Enum", "Struct", "Module"]
    kind = F.coalesce(F.get(F.array(*map(F.lit, kinds)), (F.col("l_linenumber") - 1).cast("int")), F.lit("Namespace"))
    return load(spark, sf_dir, "lineitem").select(kind.alias("kind"), (F.col("l_partkey") % 9).alias("method_count")).agg(*complexity.structure_counts())


@query(
    f"""WITH {ROWS} SELECT path, line_count, cyclomatic, cognitive, CASE WHEN cyclomatic BETWEEN 1 AND 5 THEN 'very_low' WHEN cyclomatic BETWEEN 6 AND 10 THEN 'low' WHEN cyclomatic BETWEEN 11 AND 20 THEN 'medium' WHEN cyclomatic BETWEEN 21 AND 50 THEN 'high' ELSE 'very_high' END AS level,
  array_to_string(list_filter([CASE WHEN line_count > 50 THEN 'Function is too long (>50 lines)' END, CASE WHEN cyclomatic > 10 THEN 'High cyclomatic complexity' END, CASE WHEN cognitive > 15 THEN 'High cognitive complexity' END,
  CASE WHEN parameter_count > 5 THEN 'Too many parameters' END, CASE WHEN nesting_depth > 4 THEN 'Deep nesting detected' END, CASE WHEN has_recursion THEN 'Contains recursion' END, CASE WHEN return_path_count > 5 THEN 'Multiple return paths' END], lambda x: x IS NOT NULL), '; ') AS concerns FROM rows"""
)
def function_details(spark, sf_dir):
    """Level and concerns of each function."""
    rows = complexity.details(_rows(spark, sf_dir))
    return rows.select("path", "line_count", "cyclomatic", "cognitive", "level", F.array_join("concerns", "; ").alias("concerns"))


@query(
    f"""WITH {ROWS}, {STATS}, s AS (SELECT path, count(*) AS n, sum({SCORE}) AS points FROM rows GROUP BY path)
SELECT stats.path AS path, round(CASE WHEN n > 0 THEN greatest(0.0::DOUBLE, greatest(0.0::DOUBLE, least(100.0::DOUBLE, points / n)) - CASE WHEN total_lines > 500 THEN least(25.0::DOUBLE, (total_lines - 500) / 100.0::DOUBLE * 0.5::DOUBLE) ELSE 0 END) ELSE 100.0::DOUBLE END, 6) AS maintainability
FROM stats LEFT JOIN s ON stats.path = s.path"""
)
def file_maintainability(spark, sf_dir):
    """Maintainability index per file."""
    return complexity.file_maintainability(_stats(spark, sf_dir), _rows(spark, sf_dir)).select("path", F.round("maintainability", 6).alias("maintainability"))


@query(
    f"""WITH {ROWS}, {STATS}, m AS (SELECT CAST(sum(line_count) AS DOUBLE) / count(*) AS line_count, CAST(sum(cyclomatic) AS DOUBLE) / count(*) AS cyclomatic, CAST(sum(cognitive) AS DOUBLE) / count(*) AS cognitive, CAST(sum(parameter_count) AS DOUBLE) / count(*) AS parameter_count FROM rows),
p AS (SELECT CAST(count(*) FILTER (total_lines > 500) AS DOUBLE) / count(*) * 10 + CAST(count(*) FILTER (total_lines > 1000) AS DOUBLE) / count(*) * 15 + CAST(count(*) FILTER (total_lines > 2000) AS DOUBLE) / count(*) * 20 AS penalty FROM stats)
SELECT round(greatest(0.0::DOUBLE, greatest(0.0::DOUBLE, least(100.0::DOUBLE, {SCORE})) - least(35.0::DOUBLE, penalty)), 6) AS maintainability FROM m, p"""
)
def project_maintainability(spark, sf_dir):
    """Maintainability index of the project."""
    return complexity.project_maintainability(_stats(spark, sf_dir), _rows(spark, sf_dir)).select(F.round("maintainability", 6).alias("maintainability"))


HEALTH = f"""sums AS (SELECT path, count(*) AS n, sum({SCORE}) AS points, sum(cyclomatic) AS sc, sum(line_count) AS sl, sum(nesting_depth) AS sn, sum(CASE WHEN line_count > 100 THEN 10.0::DOUBLE WHEN line_count > 50 THEN 5 ELSE 0 END) AS lng,
  sum(CASE WHEN nesting_depth > 8 THEN 15.0::DOUBLE WHEN nesting_depth > 5 THEN 10 ELSE 0 END) AS deep, sum(CASE WHEN cyclomatic > 20 THEN 20.0::DOUBLE WHEN cyclomatic > 10 THEN 10 WHEN cyclomatic > 5 THEN 5 ELSE 0 END +
  CASE WHEN line_count > 100 THEN 15.0::DOUBLE WHEN line_count > 50 THEN 10 ELSE 0 END + CASE WHEN nesting_depth > 5 THEN (nesting_depth - 5) * 5.0::DOUBLE ELSE 0 END) AS debt FROM rows GROUP BY path),
j AS (SELECT stats.*, n, points, sc, sl, sn, lng, deep, debt,
  CASE WHEN total_lines > 2000 THEN least((total_lines - 500) / 100.0::DOUBLE, 40.0::DOUBLE) WHEN total_lines > 1000 THEN least((total_lines - 500) / 150.0::DOUBLE, 25.0::DOUBLE) WHEN total_lines > 500 THEN least((total_lines - 500) / 200.0::DOUBLE, 15.0::DOUBLE) ELSE 0 END AS tiered,
  CAST(comment_lines + doc_lines AS DOUBLE) / greatest(code_lines, 1) AS told, CASE WHEN code_lines = 0 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, CAST(comment_lines + doc_lines AS DOUBLE) / code_lines * 100 * 5) END AS coverage,
  CAST(code_lines AS DOUBLE) / greatest(code_lines // 20, 1) AS unit, CAST(code_lines AS DOUBLE) / greatest(total_lines, 1) AS density FROM stats LEFT JOIN sums ON stats.path = sums.path),
h AS (SELECT path, coverage,
  CASE WHEN n > 0 THEN greatest(0.0::DOUBLE, greatest(0.0::DOUBLE, least(100.0::DOUBLE, points / n)) - tiered) ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, 85 - tiered + CASE WHEN told > 0.2::DOUBLE THEN 10 WHEN told < 0.05::DOUBLE THEN -15 ELSE 0 END - CASE WHEN code_lines < 10 THEN 20 ELSE 0 END)) END AS maintainability,
  CASE WHEN n > 0 THEN CAST(sc AS DOUBLE) / n ELSE 0 END AS average_complexity,
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN n > 0 THEN 100 - greatest(0.0::DOUBLE, (CAST(sl AS DOUBLE) / n - 20) * 2) - lng ELSE 75 - CASE WHEN unit > 50 THEN (unit - 50) * 0.5::DOUBLE WHEN unit < 5 THEN (5 - unit) * 2 ELSE 0 END - CASE WHEN total_lines > 500 THEN least((total_lines - 500) / 100.0::DOUBLE, 25.0::DOUBLE) ELSE 0 END END)) AS size_health,
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN n > 0 THEN 100 - greatest(0.0::DOUBLE, (CAST(sn AS DOUBLE) / n - 3) * 15) - deep ELSE 80 - CASE WHEN density > 0.8::DOUBLE THEN 20 WHEN density > 0.6::DOUBLE THEN 10 ELSE 0 END - CASE WHEN total_lines > 1000 THEN 15 ELSE 0 END END)) AS nesting_health,
  CASE WHEN n > 0 THEN least(100.0::DOUBLE, (debt + CASE WHEN coverage < 20 THEN 30 - coverage ELSE 0 END) / greatest(n * 50.0::DOUBLE, 1.0::DOUBLE) * 100) ELSE 0 END AS debt FROM j)"""


@query(
    f"""WITH {ROWS}, {STATS}, {HEALTH} SELECT path, round(maintainability, 7) AS maintainability, round(coverage, 7) AS coverage, round(average_complexity, 7) AS average_complexity, round(size_health, 7) AS size_health, round(nesting_health, 7) AS nesting_health, round(debt, 7) AS debt,
  round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, maintainability * 0.3::DOUBLE + coverage * 0.2::DOUBLE + (100 - least(100.0::DOUBLE, average_complexity * 10)) * 0.25::DOUBLE + size_health * 0.15::DOUBLE + nesting_health * 0.1::DOUBLE)), 7) AS health FROM h"""
)
def file_health(spark, sf_dir):
    """Health of each file by its functions."""
    h = complexity.file_health(_stats(spark, sf_dir), _rows(spark, sf_dir))
    return h.select("path", *(F.round(c, 7).alias(c) for c in ("maintainability", "coverage", "average_complexity", "size_health", "nesting_health", "debt", "health")))


@query(
    f"""WITH {ROWS}, {STATS}, i AS (SELECT path, max(cyclomatic) AS top, count(*) AS n FROM rows GROUP BY path)
SELECT stats.path AS path, total_lines FROM stats LEFT JOIN i ON stats.path = i.path WHERE coalesce(top, 0) >= 10 AND coalesce(n, 0) <= 158 AND total_lines >= 200"""
)
def files_by_complexity(spark, sf_dir):
    """Files inside limits on their functions, read from real function rows."""
    stats = _stats(spark, sf_dir).withColumn("file_size", F.col("total_lines") * 30)
    bounds = selection.Bounds(min_lines=200, min_complexity=10, max_functions=158)
    return selection.files_within(stats, bounds, _rows(spark, sf_dir)).select("path", "total_lines")
