"""Queries of the file operators on decorated driver tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import paths, scores
from plumbline.functions import tables as t
from plumbline.functions.classify import line_counts
from plumbline.operators import findings, incremental, ranking, rollups, selection
from plumbline.plans import views
from plumbline.plans.views import LANGUAGES_SQL, STATS_SQL, load, quoted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINES = ("total_lines", "code_lines", "comment_lines", "doc_lines", "blank_lines")
SUMS = (*LINES, "file_size")


def query(sql: str | None = None):
    """Register a query; whole numbers come out as long, so both engines agree on types."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")})

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _sum_sql(columns=SUMS) -> str:
    return ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in columns)


BY_KEY = f"by_key AS (SELECT key, count(*) AS files, {_sum_sql()} FROM file_stats GROUP BY key)"
NAMED = """named AS (SELECT by_key.*, coalesce(language, CASE WHEN key IN ('', 'no_ext') THEN 'Other (no extension)' ELSE '.' || key END) AS language,
  coalesce(category, 'data') AS category FROM by_key LEFT JOIN languages ON key = lkey)"""
BY_LANGUAGE = f"by_language AS (SELECT category, language, CAST(sum(files) AS BIGINT) AS files, {_sum_sql()} FROM named GROUP BY category, language)"
WITH = f"WITH {STATS_SQL}, {BY_KEY}"
WITH_LANGUAGE = f"{WITH}, {LANGUAGES_SQL}, {NAMED}, {BY_LANGUAGE}"


def _r2(x: str) -> str:
    return f"round(({x}) * 100) / 100"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0::DOUBLE END"


RATIOS = ", ".join(
    f"{_r2(_ratio(a, b))} AS {n}"
    for n, a, b in (
        ("code_ratio", "code_lines", "total_lines"),
        ("comment_ratio", "comment_lines", "total_lines"),
        ("doc_ratio", "doc_lines", "total_lines"),
        ("blank_ratio", "blank_lines", "total_lines"),
        ("comment_to_code", "comment_lines", "code_lines"),
        ("doc_to_code", "doc_lines", "code_lines"),
    )
)
_toward = lambda c, goal: f"least(1.0::DOUBLE, {c} / {goal}::DOUBLE)"
DOCUMENTATION = f"least(100.0::DOUBLE, 40 * {_toward('doc_ratio', 0.10)} + 30 * {_toward('comment_ratio', 0.15)} + 15 * {_toward('doc_to_code', 0.15)} + 15 * {_toward('comment_to_code', 0.20)})"
MAINTAINABILITY = f"40 * code_ratio + 25 * {_toward('comment_ratio', 0.15)} + 25 * {_toward('doc_ratio', 0.10)} + CASE WHEN blank_ratio - 0.3::DOUBLE <= 0 THEN 10.0::DOUBLE ELSE greatest(0.0::DOUBLE, 10 - 20 * (blank_ratio - 0.3::DOUBLE)) END"
READABILITY = f"70 * {_toward('comment_ratio', 0.15)} + CASE WHEN blank_ratio <= 0.15::DOUBLE THEN 30 * (blank_ratio / 0.15::DOUBLE) ELSE greatest(0.0::DOUBLE, 30 - 60 * (blank_ratio - 0.15::DOUBLE)) END"
LEVEL = "CASE WHEN trunc(overall) BETWEEN 90 AND 100 THEN 'Excellent' WHEN trunc(overall) BETWEEN 80 AND 89 THEN 'Good' WHEN trunc(overall) BETWEEN 70 AND 79 THEN 'Fair' WHEN trunc(overall) BETWEEN 60 AND 69 THEN 'Poor' ELSE 'Very Poor' END"


# ---- classification ---------------------------------------------------------------------


@query(f"WITH {STATS_SQL} SELECT * FROM file_stats")
def file_stats(spark, sf_dir):
    """Lines of each file by kind."""
    return views.file_stats(spark, sf_dir)


@query(f"WITH {STATS_SQL} SELECT path FROM file_stats WHERE code_lines + comment_lines + doc_lines + blank_lines <> total_lines")
def partition_errors(spark, sf_dir):
    """Files whose kinds don't add up: none."""
    return rollups.partition_errors(views.file_stats(spark, sf_dir))


@query(
    """SELECT page_id, CAST(len(parts) AS BIGINT) AS total_lines, CAST(len(list_filter(parts, lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) = '')) AS BIGINT) AS blank_lines,
  CAST(strlen(html) AS BIGINT) AS file_size
FROM (SELECT page_id, html, CASE WHEN html = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(html, '\\n$', ''), chr(10)) END AS parts FROM pages)"""
)
def page_lines(spark, sf_dir):
    """Web pages as markup files."""
    pages = load(spark, sf_dir, "pages")
    n = line_counts(F.col("html"), F.lit("html"))
    return pages.select("page_id", n.alias("n"), F.octet_length("html").cast("long").alias("file_size")).select("page_id", "n.total_lines", "n.blank_lines", "file_size")


@query(
    """WITH joined AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body, count(*) AS turns FROM conversations GROUP BY conv_id)
SELECT conv_id, turns, CAST(len(string_split(body, chr(10))) AS BIGINT) AS total_lines FROM joined"""
)
def conversation_lines(spark, sf_dir):
    """Ordered fragments of one file, put together and counted as prose."""
    parts = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("parts"), F.count(F.lit(1)).alias("turns"))
    body = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return parts.select("conv_id", "turns", line_counts(F.concat(body, F.lit("\n")), F.lit("md")).alias("n")).select("conv_id", "turns", "n.total_lines")


# ---- roll-ups ---------------------------------------------------------------------------


@query(f"{WITH} SELECT * FROM by_key")
def extension_rollup(spark, sf_dir):
    """Files and lines per extension."""
    return rollups.by_key(views.file_stats(spark, sf_dir))


@query(f"WITH {STATS_SQL} SELECT count(*) AS files, {_sum_sql()} FROM file_stats")
def project_totals(spark, sf_dir):
    """Files and lines of the project."""
    return rollups.totals(views.file_stats(spark, sf_dir))


@query(f"{WITH_LANGUAGE} SELECT * FROM by_language")
def language_rollup(spark, sf_dir):
    """Files and lines per category and language."""
    return rollups.by_language(views.file_stats(spark, sf_dir), views.languages(spark))


@query(
    f"""{WITH_LANGUAGE} SELECT category, language, CAST(CASE WHEN grouping(category) = 1 THEN 2 WHEN grouping(language) = 1 THEN 1 ELSE 0 END AS BIGINT) AS level,
  CAST(sum(files) AS BIGINT) AS files, {_sum_sql(LINES)} FROM named GROUP BY ROLLUP (category, language)"""
)
def category_rollup(spark, sf_dir):
    """Languages, categories and the whole in one roll-up."""
    return rollups.by_category(views.file_stats(spark, sf_dir), views.languages(spark))


@query(f"{WITH_LANGUAGE} SELECT language, CAST(sum(files) AS BIGINT) AS files, CAST(sum(total_lines) AS BIGINT) AS total_lines, string_agg(key, ',' ORDER BY key) AS keys FROM named GROUP BY language")
def language_extensions(spark, sf_dir):
    """Languages with the extensions they have here."""
    return rollups.language_extensions(views.file_stats(spark, sf_dir), views.languages(spark))


@query(
    f"""{WITH}, ends AS (SELECT max(file_size) AS top, min(file_size) AS low FROM file_stats)
SELECT CAST(sum(files) AS BIGINT) AS files, {_sum_sql()}, CAST(sum(total_lines) AS DOUBLE) / sum(files) AS average_lines, CAST(sum(file_size) AS DOUBLE) / sum(files) AS average_size,
  CAST(max(file_size // files) AS BIGINT) AS largest_size, CAST(min(file_size // files) AS BIGINT) AS smallest_size, CAST(any_value(top) AS BIGINT) AS true_largest, CAST(any_value(low) AS BIGINT) AS true_smallest
FROM by_key, ends"""
)
def basic_stats(spark, sf_dir):
    """Sums, means and extremes."""
    return rollups.basic(views.file_stats(spark, sf_dir))


@query(
    f"""{WITH} SELECT key, {", ".join(f"{_r2(f'CAST({c} AS DOUBLE) / (sum({c}) OVER ()) * 100')} AS {n}" for c, n in (("total_lines", "line_share"), ("files", "file_share"), ("file_size", "size_share")))}
FROM by_key"""
)
def distributions(spark, sf_dir):
    """Shares of lines, files and bytes."""
    return rollups.shares(views.file_stats(spark, sf_dir))


@query(f"{WITH} SELECT key, CAST(total_lines AS DOUBLE) / files AS lines_per_file, CAST(file_size AS DOUBLE) / files AS size_per_file, {RATIOS} FROM by_key")
def extension_ratios(spark, sf_dir):
    """Ratios per extension."""
    return rollups.key_ratios(views.file_stats(spark, sf_dir))


@query(f"WITH {STATS_SQL} SELECT path, {RATIOS} FROM file_stats")
def file_ratios(spark, sf_dir):
    """Ratios per file."""
    return rollups.ratios(views.file_stats(spark, sf_dir), "path")


QUALITY_SQL = f"""{WITH}, whole AS (SELECT {_sum_sql(LINES)} FROM by_key), r AS (SELECT {RATIOS} FROM whole), k AS (SELECT key, {RATIOS} FROM by_key),
even AS (SELECT CASE WHEN count(*) <= 1 THEN 100.0::DOUBLE ELSE (100 * ((0.2::DOUBLE - least(stddev_pop(comment_ratio), 0.2::DOUBLE)) / 0.2::DOUBLE) + 100 * ((0.2::DOUBLE - least(stddev_pop(doc_ratio), 0.2::DOUBLE)) / 0.2::DOUBLE)) / 2 END AS consistency FROM k),
scored AS (SELECT {DOCUMENTATION} AS documentation, {MAINTAINABILITY} AS maintainability, {READABILITY} AS readability, consistency FROM r, even),
final AS (SELECT *, documentation * 0.25::DOUBLE + maintainability * 0.35::DOUBLE + readability * 0.25::DOUBLE + consistency * 0.15::DOUBLE AS overall FROM scored)
SELECT {", ".join(f"round({c}, 6) AS {c}" for c in ("documentation", "maintainability", "readability", "consistency", "overall"))}, {LEVEL} AS level FROM final"""


@query(QUALITY_SQL)
def quality_scores(spark, sf_dir):
    """Project quality."""
    q = rollups.quality(views.file_stats(spark, sf_dir))
    return q.select(*(F.round(c, 6).alias(c) for c in q.columns[:-1]), "level")


@query(
    f"""WITH {STATS_SQL}, r AS (SELECT path, {RATIOS} FROM file_stats), scored AS (SELECT path, {DOCUMENTATION} AS documentation, {MAINTAINABILITY} AS maintainability, {READABILITY} AS readability FROM r),
final AS (SELECT *, documentation * 0.25::DOUBLE + maintainability * 0.35::DOUBLE + readability * 0.25::DOUBLE + 100.0::DOUBLE * 0.15::DOUBLE AS overall FROM scored)
SELECT path, round(documentation, 6) AS documentation, round(maintainability, 6) AS maintainability, round(readability, 6) AS readability, round(overall, 6) AS overall, {LEVEL} AS level FROM final"""
)
def file_quality(spark, sf_dir):
    """Quality of single files."""
    q = rollups.file_quality(views.file_stats(spark, sf_dir))
    return q.select("path", *(F.round(c, 6).alias(c) for c in ("documentation", "maintainability", "readability", "overall")), "level")


@query(
    f"""{WITH}, p AS (SELECT CAST(total_lines AS DOUBLE) / (sum(total_lines) OVER ()) AS p, count(*) OVER () AS n FROM by_key WHERE total_lines > 0)
SELECT CASE WHEN max(n) > 1 THEN round(-sum(p * ln(p)) / ln(max(n)), 9) ELSE 0.0::DOUBLE END AS diversity FROM p"""
)
def language_diversity(spark, sf_dir):
    """Normalized entropy of lines over extensions."""
    return rollups.diversity(views.file_stats(spark, sf_dir))


@query(
    f"""{WITH}, r AS (SELECT key, files, total_lines, file_size, {RATIOS} FROM by_key)
SELECT {", ".join(f"(SELECT key FROM r ORDER BY {m} DESC, key DESC LIMIT 1) AS {n}" for m, n in (("files", "most_files"), ("total_lines", "most_lines"), ("file_size", "largest"), ("doc_ratio + comment_ratio", "most_documented"), ("trunc(code_ratio * 1000)", "most_efficient")))}"""
)
def leading_extensions(spark, sf_dir):
    """Extension that leads each measure; of equal ones the greatest."""
    return rollups.leaders(views.file_stats(spark, sf_dir))


@query(
    f"""WITH {STATS_SQL}, reports AS (SELECT split_part(path, '/', 2) AS project, count(*) AS files, {_sum_sql()}, list(DISTINCT key) AS languages FROM file_stats GROUP BY 1),
whole AS (SELECT count(*) AS reports, CAST(sum(files) AS BIGINT) AS files, {_sum_sql()}, array_to_string(list_sort(list_distinct(flatten(list(languages)))), ',') AS languages FROM reports)
SELECT reports, files, {", ".join(SUMS)}, languages, {RATIOS} FROM whole"""
)
def merge_reports(spark, sf_dir):
    """The projects' reports merged into one."""
    stats = views.file_stats(spark, sf_dir).withColumn("project", F.split_part("path", F.lit("/"), F.lit(2)))
    reports = stats.groupBy("project").agg(*rollups.sums(), F.collect_set("key").alias("languages"))
    return rollups.merge(reports)


@query(
    f"""WITH {STATS_SQL}, m AS (SELECT split_part(path, '/', 2) AS project, count(*) AS n, sum(file_size) AS bytes, array_to_string(list_sort(list(DISTINCT key)), ',') AS found FROM file_stats GROUP BY 1)
SELECT project, n AS file_count_analyzed, CAST(bytes AS BIGINT) AS total_bytes_analyzed, found AS languages_detected, CAST(5 AS BIGINT) AS calculation_time_ms, '0.1.0' AS version, 'Complete' AS analysis_depth FROM m
UNION ALL SELECT 'all', count(*), CAST(sum(file_size) AS BIGINT), array_to_string(list_sort(list(DISTINCT key)), ','), CAST(5 * count(DISTINCT split_part(path, '/', 2)) AS BIGINT), '0.1.0', 'Complete' FROM file_stats"""
)
def report_metadata(spark, sf_dir):
    """What the projects' reports say of themselves, and their merged report."""
    stats = views.file_stats(spark, sf_dir).withColumn("project", F.split_part("path", F.lit("/"), F.lit(2)))
    own = rollups.metadata(stats, "project", milliseconds=5)
    both = own.unionByName(rollups.merge_metadata(own).withColumn("project", F.lit("all")))
    return both.withColumn("languages_detected", F.array_join("languages_detected", ","))


@query(f"WITH {STATS_SQL} SELECT path, CASE WHEN code_lines = 0 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, CAST(comment_lines + doc_lines AS DOUBLE) / code_lines * 100 * 5) END AS coverage, "
       "greatest(0.0::DOUBLE, least(25.0::DOUBLE, CASE WHEN total_lines > 2000 THEN 12 WHEN total_lines > 1000 THEN 8 WHEN total_lines > 500 THEN 5 ELSE 2 END + CASE WHEN CAST(code_lines AS DOUBLE) / greatest(total_lines, 1) > 0.8::DOUBLE THEN 3 ELSE 0 END + "
       "CASE WHEN CAST(comment_lines + doc_lines AS DOUBLE) / greatest(code_lines, 1) > 0.2::DOUBLE THEN -2 WHEN CAST(comment_lines + doc_lines AS DOUBLE) / greatest(code_lines, 1) < 0.05::DOUBLE THEN 2 ELSE 0 END)) AS duplication, "
       f"least(10.0::DOUBLE, 1 + CASE WHEN total_lines > 500 THEN 3.0::DOUBLE WHEN total_lines > 200 THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN {_ratio('code_lines', 'total_lines')} > 0.8::DOUBLE THEN 2 WHEN {_ratio('code_lines', 'total_lines')} > 0.6::DOUBLE THEN 1 ELSE 0 END + "
       f"CASE WHEN {_ratio('comment_lines', 'total_lines')} < 0.05::DOUBLE THEN 1.5::DOUBLE WHEN {_ratio('comment_lines', 'total_lines')} < 0.1::DOUBLE THEN 0.5::DOUBLE ELSE 0 END) AS risk, code_lines * 0.5::DOUBLE AS minutes FROM file_stats")  # fmt: skip
def file_estimates(spark, sf_dir):
    """Documentation coverage, duplication guess, risk and writing time."""
    c = F.col
    stats = views.file_stats(spark, sf_dir)
    return stats.select(
        "path",
        scores.documentation_coverage(c("code_lines"), c("comment_lines"), c("doc_lines")).alias("coverage"),
        scores.duplication_estimate(c("total_lines"), c("code_lines"), c("comment_lines"), c("doc_lines")).alias("duplication"),
        scores.file_risk(c("total_lines"), c("code_lines"), c("comment_lines")).alias("risk"),
        scores.minutes(c("code_lines")).alias("minutes"),
    )


@query(
    """WITH g AS (SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, sum(l_quantity) AS s, stddev_pop(l_quantity) AS d FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, n, round(s, 2) AS total, round(s / n, 4) AS mean, round(s / (sum(s) OVER ()), 6) AS share, round(d, 4) AS deviation FROM g"""
)
def lineitem_rollup(spark, sf_dir):
    """The roll-up on a bulk numeric table."""
    return rollups.numeric_groups(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query(
    """WITH g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS files, CAST(sum(o_totalprice) AS BIGINT) AS total_lines FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY total_lines DESC, o_orderstatus) AS rank FROM g)
SELECT o_orderpriority AS category, o_orderstatus AS language, files, total_lines, rank FROM r WHERE rank <= 2"""
)
def orders_top_per_group(spark, sf_dir):
    """Top-n per group on a bulk table."""
    g = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("language"))
    return ranking.top_per_category(g.agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("o_totalprice"), 0).cast("long").alias("total_lines")), 2)


# ---- order, top-k, pies, search ---------------------------------------------------------


@query(f"{WITH_LANGUAGE} SELECT category, language, files, total_lines, row_number() OVER (ORDER BY total_lines DESC, language) AS rank FROM by_language")
def languages_by_lines(spark, sf_dir):
    """Languages in falling order of lines."""
    rows = rollups.by_language(views.file_stats(spark, sf_dir), views.languages(spark))
    return ranking.language_order(rows, "lines").select("category", "language", "files", "total_lines", "rank")


@query(f"{WITH_LANGUAGE} SELECT category, language, files, total_lines, row_number() OVER (ORDER BY {_ratio('doc_lines', 'total_lines')}, language DESC) AS rank FROM by_language")
def languages_by_docs_ascending(spark, sf_dir):
    """Languages in rising order of documentation, which reverses the whole order."""
    rows = rollups.by_language(views.file_stats(spark, sf_dir), views.languages(spark))
    return ranking.language_order(rows, "docs", ascending=True).select("category", "language", "files", "total_lines", "rank")


@query(f"{WITH_LANGUAGE}, r AS (SELECT category, language, total_lines, row_number() OVER (PARTITION BY category ORDER BY total_lines DESC, language) AS rank FROM by_language) SELECT * FROM r WHERE rank <= 3")
def top_languages_per_category(spark, sf_dir):
    """Three leading languages of each category."""
    rows = rollups.by_language(views.file_stats(spark, sf_dir), views.languages(spark))
    return ranking.top_per_category(rows, 3).select("category", "language", "total_lines", "rank")


@query(f"WITH {views.FILES_SQL} SELECT path FROM files ORDER BY string_split(path, '/') LIMIT 20")
def first_paths(spark, sf_dir):
    """First files in path order; a listing reads no content."""
    return ranking.first_paths(views.files(spark, sf_dir).select("path"), 20)


@query(f"WITH {STATS_SQL} SELECT path, total_lines, code_lines, total_lines * 0.6::DOUBLE + code_lines * 0.4::DOUBLE AS score FROM file_stats ORDER BY score DESC, path LIMIT 15")
def top_files(spark, sf_dir):
    """Largest files by weighted lines."""
    return ranking.top_files(views.file_stats(spark, sf_dir), 15)


PIE = """, p AS (SELECT key, {v} AS value, CAST({v} AS DOUBLE) / (sum({v}) OVER ()) * 100 AS percent FROM by_key),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, key) AS rank FROM p WHERE percent >= 1.0)
SELECT CASE WHEN rank <= {n} THEN key ELSE 'Others' END AS label, CAST(sum(value) AS BIGINT) AS value FROM r GROUP BY 1 HAVING sum(value) > 0"""


@query(WITH + PIE.format(v="total_lines", n=6))
def pie_lines(spark, sf_dir):
    """Slices by lines, the rest as Others."""
    return ranking.pie(rollups.by_key(views.file_stats(spark, sf_dir)), "total_lines", most=6)


@query(WITH + PIE.format(v="files", n=10))
def pie_files(spark, sf_dir):
    """Slices by files."""
    return ranking.pie(rollups.by_key(views.file_stats(spark, sf_dir)), "files")


@query(
    f"""WITH {STATS_SQL}, w AS (SELECT {_sum_sql(LINES)} FROM file_stats), s(label, value) AS (SELECT 'Code Lines', code_lines FROM w UNION ALL SELECT 'Comment Lines', comment_lines FROM w
UNION ALL SELECT 'Documentation Lines', doc_lines FROM w UNION ALL SELECT 'Blank Lines', blank_lines FROM w) SELECT * FROM s WHERE value > 0"""
)
def pie_line_kinds(spark, sf_dir):
    """Slices by kind of line."""
    return ranking.line_pie(rollups.totals(views.file_stats(spark, sf_dir)))


@query(
    f"""WITH {STATS_SQL}, n AS (SELECT *, lower(split_part(path, '/', -1)) AS name FROM file_stats)
SELECT path, total_lines, code_lines, CASE WHEN name = 'f1' THEN 1.0::DOUBLE WHEN starts_with(name, 'f1') THEN 0.9::DOUBLE WHEN contains(name, 'f1') THEN 0.7::DOUBLE
  ELSE (CASE WHEN instr(name, 'f') = 0 THEN 0 WHEN instr(substr(name, instr(name, 'f') + 1), '1') = 0 THEN 1 ELSE 2 END) / 2.0::DOUBLE * 0.5::DOUBLE END AS relevance
FROM n WHERE contains(lower(path), 'f1')"""
)
def search_paths(spark, sf_dir):
    """Files whose path holds a word, with relevance."""
    return ranking.search_paths(views.file_stats(spark, sf_dir), "F1")


@query(f"WITH {STATS_SQL} SELECT path, total_lines, 'Extension: ' || key AS match, 0.8::DOUBLE AS relevance FROM file_stats WHERE contains(lower(key), 's')")
def search_extensions(spark, sf_dir):
    """Files by extension."""
    return ranking.search_extensions(views.file_stats(spark, sf_dir), "S")


@query(f"WITH {STATS_SQL} SELECT path, total_lines, 0.8::DOUBLE AS relevance FROM file_stats WHERE key IN ('rs', 'js', 'ts') AND 'let' = 'let'")
def search_content(spark, sf_dir):
    """Files that would hold a word by their kind."""
    return ranking.search_content(views.file_stats(spark, sf_dir), "let")


@query(f"WITH {STATS_SQL}, f AS (SELECT * FROM file_stats WHERE contains(lower(path), 'f1')) SELECT key, count(*) AS files, CAST(sum(total_lines) AS BIGINT) AS total_lines FROM f GROUP BY key")
def search_facets(spark, sf_dir):
    """Statistics and extensions of what a search found."""
    stats = views.file_stats(spark, sf_dir)
    results = ranking.search_paths(stats, "f1")
    found = ranking.found_files(stats, results)
    keyed = found.groupBy("key").agg(F.count(F.lit(1)).alias("files"), F.sum("total_lines").alias("total_lines"))
    return keyed.join(ranking.found_extensions(keyed, results), "key", "left_semi")


# ---- selection --------------------------------------------------------------------------

FOLDERS = ["src/app", "node_modules/dep", "build", "a/target/x", ".git", "web/dist", "lib.min", "docs", "pkg/__pycache__", "a/b/c/d", ".vscode", "My.xcodeproj", "vendor/bundle/g", "packages/core"]
NAMES = [
    "main.rs", "app.min.js", "api.pb.go", "logo.png", "LICENSE", "LICENSE.md", "license.rs", "Makefile", "x.generated.ts", "data.unknown", "notes.txt~", "package-lock.json",
    ".gitignore", "Dockerfile", "archive.tar.gz", "noext", "README", "Thumbs.db", "run.log", "Foo.PY", "s.scss", "a.b.svg", "..", "t_pb2.py", "k.jsonl",
]


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up paths, one a page."""
    pick = lambda xs, step: F.element_at(F.array(*map(F.lit, xs)), (F.expr(f"page_id div {step}") % len(xs) + 1).cast("int"))
    return load(spark, sf_dir, "pages").select("page_id", F.concat(pick(FOLDERS, 3), F.lit("/"), pick(NAMES, 1)).alias("path"))


def _sql_list(xs) -> str:
    return "([" + ", ".join(map(quoted, xs)) + "])"


LISTING = f"listing AS (SELECT page_id, {_sql_list(FOLDERS)}[(page_id // 3) % {len(FOLDERS)} + 1] || '/' || {_sql_list(NAMES)}[page_id % {len(NAMES)} + 1] AS path FROM pages)"
KEYED = f"""{LISTING}, named AS (SELECT *, split_part(path, '/', -1) AS name FROM listing),
ext AS (SELECT *, CASE WHEN name <> '..' AND regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^.+\\.([^.]*)$', 1) END AS extension FROM named),
keyed AS (SELECT *, coalesce(lower(extension), lower(regexp_replace(name, '^\\.', ''))) AS key FROM ext)"""
_in = lambda xs: "(" + ", ".join(map(quoted, xs)) + ")"
DISPOSED = f"""{KEYED}, disposed AS (SELECT *, CASE
  WHEN regexp_matches(path, {quoted("|".join([*t.OS_NOISE, *t.EDITOR_NOISE, *t.TEMPORARY_NOISE, *t.REPOSITORY_NOISE]))}) OR regexp_matches(path, {quoted(paths.BUILD_PATTERN)}) THEN 'not_authored'
  WHEN lower(extension) IN {_in(t.BINARY_EXTENSIONS)} THEN 'binary'
  WHEN lower(name) IN {_in(t.GENERATED_NAMES)} OR len(list_filter({_sql_list(t.GENERATED_SUFFIXES)}, lambda s: ends_with(lower(name), s))) > 0 OR regexp_matches(lower(name), '^.*\\.generated\\.[^.]*$') THEN 'generated'
  WHEN regexp_matches(lower(name), '^(?:{"|".join(t.BOILERPLATE_STEMS)})(?:\\.(?:{"|".join(t.BOILERPLATE_EXTENSIONS)}))?$') THEN 'boilerplate'
  WHEN key IN {_in(t.SYNTAX)} THEN 'source' ELSE 'unknown' END AS disposition FROM keyed)"""


@query(
    f"""WITH {KEYED} SELECT page_id, path, extension, key, CASE WHEN extension IS NOT NULL OR key IN {_in(t.SYNTAX)} THEN key ELSE 'no_ext' END AS extension_key,
  coalesce(lower(extension), 'unknown') AS complexity_key FROM keyed"""
)
def path_keys(spark, sf_dir):
    """The three keys of a path."""
    p = F.col("path")
    ext = paths.extension(p)
    return listing(spark, sf_dir).select(
        "page_id", "path", ext.alias("extension"), paths.classify_key(p).alias("key"), paths.extension_key(p).alias("extension_key"), F.coalesce(F.lower(ext), F.lit("unknown")).alias("complexity_key")
    )


@query(f"WITH {DISPOSED} SELECT page_id, path, disposition FROM disposed")
def file_disposition(spark, sf_dir):
    """What becomes of each path."""
    return selection.dispositions(listing(spark, sf_dir))


@query(f"WITH {DISPOSED} SELECT page_id, disposition NOT IN ('not_authored', 'binary', 'generated') AS included FROM disposed")
def included_paths(spark, sf_dir):
    """The older inclusion test."""
    return listing(spark, sf_dir).select("page_id", paths.should_include(F.col("path")).alias("included"))


@query(f"WITH {DISPOSED} SELECT disposition, count(*) AS files FROM disposed GROUP BY disposition")
def skip_counts(spark, sf_dir):
    """Files by what became of them."""
    return selection.skip_counts(listing(spark, sf_dir))


@query(
    f"""WITH {LISTING} SELECT page_id, regexp_matches(path, '(^|/)\\.') AS hidden, len(string_split(path, '/')) <= 2 AS shallow, regexp_matches(path, {quoted(paths.glob_pattern("docs/"))}) OR regexp_matches(path, {quoted(paths.glob_pattern("*.rs"))}) AS ignored,
  coalesce(lower(CASE WHEN regexp_matches(path, '[^/]\\.[^./]*$') THEN regexp_extract(path, '\\.([^./]*)$', 1) END) IN ('rs', 'py'), false) AS wanted FROM listing"""
)
def path_predicates(spark, sf_dir):
    """Hidden, depth, ignore globs and wanted extensions."""
    p = F.col("path")
    return listing(spark, sf_dir).select(
        "page_id",
        paths.is_hidden(p).alias("hidden"),
        paths.within_depth(p, 2).alias("shallow"),
        paths.is_ignored(p, ["docs/", "*.rs"]).alias("ignored"),
        paths.has_extension(p, ["RS", "py"]).alias("wanted"),
    )


@query(
    f"""WITH {DISPOSED}, detected AS (SELECT DISTINCT regexp_replace('root/' || path, '^(?:/x/root|root)/', '') AS listed FROM listing WHERE page_id % 2 = 0)
SELECT page_id, path, disposition FROM disposed WHERE disposition = 'source' OR (disposition = 'unknown' AND path IN (SELECT listed FROM detected))"""
)
def admitted_files(spark, sf_dir):
    """Sources, and unknown files that a detector lists."""
    files = listing(spark, sf_dir)
    detected = files.where("page_id % 2 = 0").select(F.concat(F.lit("root/"), F.col("path")).alias("path"))
    return selection.admitted(files, detected, "/x/root")


@query(
    f"""WITH {STATS_SQL} SELECT path, total_lines FROM file_stats WHERE total_lines >= 3 AND total_lines <= 40 AND file_size >= 100 AND key NOT IN ('md', 'sql')
AND {_ratio('doc_lines', 'total_lines')} <= 0.5::DOUBLE"""
)
def files_within_bounds(spark, sf_dir):
    """Files inside limits."""
    bounds = selection.Bounds(min_lines=3, max_lines=40, min_size=selection.parse_size("100B"), max_doc_ratio=0.5, exclude=("md", "sql"))
    return selection.files_within(views.file_stats(spark, sf_dir), bounds).select("path", "total_lines")


@query(
    f"""{WITH}, kept AS (SELECT * FROM by_key WHERE total_lines >= 100 AND key NOT IN ('md')) SELECT CAST(coalesce(sum(files), 0) AS BIGINT) AS files, {_sum_sql()},
  {", ".join(f"{_ratio(f'sum({c})', 'sum(total_lines)')} AS {c[:-6]}_share" for c in LINES[1:])} FROM kept"""
)
def extension_filter_totals(spark, sf_dir):
    """Limits on extension sums, and sums over what is left."""
    keyed = rollups.by_key(views.file_stats(spark, sf_dir))
    return selection.retotal(selection.keys_within(keyed, selection.Bounds(min_lines=100, exclude=("md",))))


PROJECTS = ["Cargo.toml", "src/lib.rs", "target/debug/gen.rs", "build/ok.go", "web/package.json", "web/dist/app.js", "web/src/dist/real.js", "net/App.sln", "net/bin/a.cs", "tools/bin/run.sh", "py/env/pyvenv.cfg", "py/env/lib/x.py", "py/venv/y.py", "c/out/CACHEDIR.TAG", "c/out/z.c"]
BUILD_SQL = f"""entries AS (SELECT 'p' || r.page_id || '/' || unnest({_sql_list(PROJECTS)}) AS path FROM pages r)"""


@query(
    f"""WITH {BUILD_SQL} SELECT path FROM entries WHERE NOT (contains(path, '/target/') OR contains(path, '/web/dist/') OR contains(path, '/net/bin/') OR contains(path, '/py/env/') OR contains(path, '/c/out/'))"""
)
def outside_build_folders(spark, sf_dir):
    """Files outside folders with evidence of being build output."""
    projects = F.explode(F.array(*map(F.lit, PROJECTS)))
    entries = load(spark, sf_dir, "pages").select(F.col("page_id"), projects.alias("p"))
    return selection.outside_build(entries.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("/"), F.col("p")).alias("path")))


# ---- text forms -------------------------------------------------------------------------


@query(
    f"""WITH {STATS_SQL}, w AS (SELECT path, file_size, file_size * 1500 AS big FROM file_stats)
SELECT path, regexp_replace(CASE WHEN big < 1024 THEN CAST(big AS VARCHAR) || ' B' WHEN big < 1048576 THEN format('{{:.1f}} KB', big / 1024.0::DOUBLE) WHEN big < 1073741824 THEN format('{{:.1f}} MB', big / 1048576.0::DOUBLE) ELSE format('{{:.1f}} GB', big / 1073741824.0::DOUBLE) END, '$', '') AS size_text,
  format('{{:,}}', big) AS grouped,
  CASE WHEN length(path) <= 12 THEN path ELSE CASE WHEN 12 - 3 - length(split_part(path, '/', -1)) - length(split_part(path, '/', 1)) > 0 THEN split_part(path, '/', 1) || '/.../' || split_part(path, '/', -1) ELSE '.../' || split_part(path, '/', -1) END END AS short,
  path AS uri, 'file:///' || path AS absolute_uri
FROM w"""
)
def text_forms(spark, sf_dir):
    """Sizes, grouped numbers, short paths and URIs."""
    p, big = F.col("path"), F.col("file_size") * 1500
    return views.file_stats(spark, sf_dir).select(
        "path", scores.human_size(big).alias("size_text"), scores.grouped_number(big).alias("grouped"), paths.shorten(p, 12).alias("short"), paths.to_uri(p).alias("uri"), paths.to_uri(F.concat(F.lit("\\"), p)).alias("absolute_uri")
    )


@query(
    r"""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html_text,
  replace(replace(replace(replace(replace(replace(replace(html, '\', '\\'), '''', '\'''), '"', '\"'), chr(10), '\n'), chr(13), '\r'), '<', '\u003c'), '>', '\u003e') AS script_text FROM pages"""
)
def escaped_text(spark, sf_dir):
    """Text for markup and for scripts."""
    html = F.col("html")
    return load(spark, sf_dir, "pages").select("page_id", scores.html_escaped(html).alias("html_text"), scores.script_escaped(html).alias("script_text"))


# ---- findings ---------------------------------------------------------------------------


@query(
    f"""WITH {STATS_SQL}, r AS (SELECT *, {_ratio('doc_lines + comment_lines', 'total_lines')} AS told FROM file_stats)
SELECT 'HM001' AS rule, 'Large File' AS name, 'warning' AS level, format('File has {{}} lines, consider breaking it into smaller modules', total_lines) AS message, path AS uri FROM r WHERE total_lines > 1000
UNION ALL SELECT 'HM002', 'Low Documentation', 'info', format('Documentation ratio is {{:.1f}}%, consider adding more comments and documentation', told * 100), path FROM r WHERE told < 0.1::DOUBLE AND code_lines > 50
UNION ALL SELECT 'HM003', 'Empty File', 'note', 'File contains no code lines, consider removing if unused', path FROM r WHERE code_lines = 0"""
)
def file_findings(spark, sf_dir):
    """Findings about single files."""
    return findings.file_findings(views.file_stats(spark, sf_dir))


@query(
    f"""WITH {STATS_SQL}, w AS (SELECT count(*) AS files, {_sum_sql(LINES)} FROM file_stats)
SELECT 'HM000' AS rule, 'Project Summary' AS name, 'note' AS level, format('Project contains {{}} files with {{}} total lines ({{}} code, {{}} comments)', files, total_lines, code_lines, comment_lines) AS message, 'project://summary' AS uri FROM w
UNION ALL SELECT 'HM301', 'Large Project', 'info', format('Project has {{}} files, consider modularization strategies', files), 'project://summary' FROM w WHERE files > 1000"""
)
def project_findings(spark, sf_dir):
    """Findings about the project."""
    return findings.project_findings(rollups.totals(views.file_stats(spark, sf_dir)))


@query(
    f"""WITH {STATS_SQL}, r AS (SELECT *, doc_lines + comment_lines AS told FROM file_stats)
SELECT path, 'long-file' AS code, format('{{:,}}', total_lines) || ' lines, over the 30 this project allows' AS message FROM r WHERE total_lines > 30
UNION ALL SELECT path, 'undocumented', format('{{:,}}', code_lines) || ' lines of code with ' || format('{{:,}}', told) || ' of documentation, under the 20% this project asks for' FROM r WHERE code_lines >= 5 AND told < 0.2::DOUBLE * code_lines"""
)
def editor_diagnostics(spark, sf_dir):
    """Diagnostics an editor shows."""
    return findings.diagnostics(views.file_stats(spark, sf_dir), 30, 0.2, 5)


@query(
    f"""{WITH}, {LANGUAGES_SQL} SELECT path, concat_ws(' · ', format('{{:,}}', total_lines) || ' ' || coalesce(language, '.' || key), CASE WHEN code_lines > 0 THEN format('{{:,}}', code_lines) || ' code' END,
  CASE WHEN doc_lines > 0 THEN format('{{:,}}', doc_lines) || ' doc' END, CASE WHEN comment_lines > 0 THEN format('{{:,}}', comment_lines) || ' comment' END, CASE WHEN blank_lines > 0 THEN format('{{:,}}', blank_lines) || ' blank' END) AS title
FROM file_stats LEFT JOIN languages ON key = lkey"""
)
def code_lenses(spark, sf_dir):
    """One line over each file."""
    return findings.lens(rollups.with_language(views.file_stats(spark, sf_dir), views.languages(spark)))


@query(
    f"""{WITH}, r AS (SELECT key, {RATIOS} FROM by_key), said AS (
SELECT key, unnest(list_filter([CASE WHEN code_ratio > 0.8::DOUBLE THEN 'High code density - very efficient!' WHEN code_ratio < 0.4::DOUBLE THEN 'Low code density - lots of documentation or comments' END,
 CASE WHEN comment_ratio > 0.3::DOUBLE THEN 'Very well commented code' WHEN comment_ratio < 0.05::DOUBLE THEN 'Could use more comments for clarity' END,
 CASE WHEN doc_ratio > 0.2::DOUBLE THEN 'Excellent documentation coverage' WHEN doc_ratio < 0.05::DOUBLE THEN 'Consider adding more documentation' END,
 CASE WHEN blank_ratio > 0.4::DOUBLE THEN 'Very spacious code - lots of breathing room' WHEN blank_ratio < 0.1::DOUBLE THEN 'Dense code - consider adding blank lines for readability' END], lambda x: x IS NOT NULL)) AS insight FROM r)
SELECT key, insight FROM said"""
)
def ratio_insights(spark, sf_dir):
    """What the ratios of each extension's files say."""
    return findings.insights(rollups.ratios(rollups.by_key(views.file_stats(spark, sf_dir)), "key"), "key")


# ---- incremental ------------------------------------------------------------------------

KNOWN_SQL = f"""{STATS_SQL}, numbered AS (SELECT *, CAST(regexp_extract(path, '/f([0-9]+)\\.', 1) AS BIGINT) AS n FROM file_stats),
current AS (SELECT path, file_size AS size, n * 1000 AS mtime FROM numbered),
known AS (SELECT path, CASE WHEN n % 5 = 0 THEN file_size + 1 ELSE file_size END AS size, CASE WHEN n % 7 = 0 THEN n * 1000 + 1 ELSE n * 1000 END AS mtime, total_lines, n AS touched FROM numbered WHERE n % 3 <> 0),
good AS (SELECT path, known.total_lines FROM current JOIN known USING (path, size, mtime))"""


def _known(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = F.regexp_extract("path", r"/f([0-9]+)\.", 1).cast("long")
    stats = views.file_stats(spark, sf_dir).withColumn("n", n)
    current = views.files(spark, sf_dir).select("path", F.col("size"), (n * 1000).alias("mtime"), "content")
    size = F.when(F.col("n") % 5 == 0, F.col("file_size") + 1).otherwise(F.col("file_size"))
    mtime = F.when(F.col("n") % 7 == 0, F.col("n") * 1000 + 1).otherwise(F.col("n") * 1000)
    return current, stats.where("n % 3 <> 0").select("path", size.alias("size"), mtime.alias("mtime"), *LINES, F.col("n").alias("touched"))


@query(f"WITH {KNOWN_SQL} SELECT path, total_lines FROM good")
def cache_hits(spark, sf_dir):
    """Files whose known counts are still good."""
    current, known = _known(spark, sf_dir)
    return incremental.hits(current, known).select("path", "total_lines")


@query(f"WITH {KNOWN_SQL} SELECT path FROM current WHERE path NOT IN (SELECT path FROM good)")
def cache_misses(spark, sf_dir):
    """Files to be counted again."""
    current, known = _known(spark, sf_dir)
    return incremental.misses(current, known).select("path")


@query(f"WITH {KNOWN_SQL} SELECT (SELECT count(*) FROM good) AS hits, count(*) - (SELECT count(*) FROM good) AS misses, (SELECT count(*) FROM good) / CAST(count(*) AS DOUBLE) AS rate FROM current")
def cache_hit_rate(spark, sf_dir):
    """Hits, misses and their rate."""
    return incremental.hit_rate(*_known(spark, sf_dir))


@query(f"WITH {KNOWN_SQL} SELECT path, total_lines, code_lines FROM file_stats")
def cache_refresh(spark, sf_dir):
    """The refreshed table equals a full count."""
    current, known = _known(spark, sf_dir)
    return incremental.refresh(current, known, lambda f: views.stats_of(f).withColumnRenamed("file_size", "size").join(f.select("path", "mtime"), "path"), 1).select("path", "total_lines", "code_lines")


@query(
    f"""WITH {KNOWN_SQL}, ranked AS (SELECT path, touched, row_number() OVER (ORDER BY touched DESC, path) AS rank, count(*) OVER () AS entries FROM known)
SELECT path, touched FROM ranked WHERE entries <= 150 OR rank <= 100"""
)
def cache_eviction(spark, sf_dir):
    """The entries that stay when the table is cut."""
    return incremental.evict(_known(spark, sf_dir)[1].select("path", "touched"), 150, 100)


@query(
    """WITH c AS (SELECT user_id AS uri, event_id AS seq, CASE event_type WHEN 'signup' THEN 'open' WHEN 'error' THEN 'close' ELSE 'change' END AS kind, props AS text FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY seq DESC) AS k FROM c) SELECT uri, seq, text FROM l WHERE k = 1 AND kind <> 'close'"""
)
def open_documents(spark, sf_dir):
    """Documents still open after a stream of events, with their last text."""
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "close").otherwise("change")
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("uri"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("props").alias("text"))
    return incremental.latest(events)
