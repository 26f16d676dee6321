"""Code-like file views of the driver tables, for Spark and as DuckDB SQL.

``documents`` holds prose, so each text is decorated: its extension follows from the id, and
each line gets a marker that follows from the id and the line's number.  Both engines build
the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import tables as t
from plumbline.functions.classify import line_counts
from plumbline.functions.paths import classify_key

EXTENSIONS = ["rs", "py", "js", "go", "c", "sh", "html", "md", "sql", "unknownext"]
PREFIXES = ["", "// ", "/// ", "/* ", "*/ ", "    ", None, "# "]  # None: the line is blanked


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content, size``: the decorated documents."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    prefixes = F.array(*(F.lit(p) for p in PREFIXES))

    def decorate(line, i):
        prefix = F.element_at(prefixes, ((F.col("doc_id") + i) % len(PREFIXES) + 1).cast("int"))
        return F.coalesce(F.concat(prefix, line), F.lit(""))

    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    path = F.concat(F.lit("src/"), F.col("source"), F.lit("/m"), (F.col("doc_id") % 7).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), ext)
    content = F.array_join(F.transform(F.split("text", "\n", -1), decorate), "\n")
    return docs.select(path.alias("path"), content.alias("content")).withColumn("size", F.octet_length("content").cast("long"))


def stats_of(files: DataFrame) -> DataFrame:
    """``path, key, total_lines, code_lines, comment_lines, doc_lines, blank_lines, file_size`` of ``files`` (path, content, size)."""
    keyed = files.select("path", classify_key(F.col("path")).alias("key"), "content", F.col("size").alias("file_size"))
    counted = keyed.select("path", "key", "file_size", line_counts(F.col("content"), F.col("key")).alias("n"))
    return counted.select("path", "key", *(F.col(f"n.{c}") for c in ("total_lines", "code_lines", "comment_lines", "doc_lines", "blank_lines")), "file_size")


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_of(files(spark, sf_dir))


def languages(spark: SparkSession) -> DataFrame:
    """``key, language, category`` of all registered keys."""
    return spark.createDataFrame([(k, *v) for k, v in sorted(t.LANGUAGE_OF.items())], "key string, language string, category string")


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return "([" + ", ".join(map(quoted, xs)) + "]::VARCHAR[])"


FILES_SQL = f"""files AS (
  SELECT 'src/' || source || '/m' || (doc_id % 7) || '/f' || doc_id || '.' || ext AS path, ext AS key, content, CAST(strlen(content) AS BIGINT) AS file_size
  FROM (
    SELECT doc_id, source, {_list(EXTENSIONS)}[doc_id % {len(EXTENSIONS)} + 1] AS ext,
      array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)),
        lambda l, i: coalesce({_list(PREFIXES)}[(doc_id + i - 1) % {len(PREFIXES)} + 1] || l, '')), chr(10)) AS content
    FROM documents
  )
)"""

_SYNTAX_ROWS = ",\n  ".join(
    f"({quoted(k)}, {_list(t.SYNTAX[k].line)}, {_list(s for s, _ in t.SYNTAX[k].blocks)}, {_list(e for _, e in t.SYNTAX[k].blocks)}, {_list(t.SYNTAX[k].doc)})"
    for k in EXTENSIONS
    if k in t.SYNTAX and k not in t.PROSE
)
_WHITE = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"

#: ``file_stats``: the same counts by a fold over lines, for DuckDB.
STATS_SQL = f"""{FILES_SQL},
syntaxes(skey, marks, starts, ends, docs) AS (VALUES {_SYNTAX_ROWS}),
cut AS (
  SELECT path, key, file_size, CASE WHEN content = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(content, '\\n$', ''), chr(10)) END AS parts,
    coalesce(marks, []::VARCHAR[]) AS marks, coalesce(starts, []::VARCHAR[]) AS starts, coalesce(ends, []::VARCHAR[]) AS ends, coalesce(docs, []::VARCHAR[]) AS docs
  FROM files LEFT JOIN syntaxes ON key = skey
),
lines AS (
  SELECT path, key, marks, starts, ends, docs, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS i FROM cut
),
trimmed AS (SELECT *, trim(raw, {_WHITE}) AS x, raw <> '' AND instr({_WHITE}, left(raw, 1)) > 0 AS indented FROM lines),
found AS (
  SELECT *, list_min(list_transform(starts, lambda s, k: CASE WHEN instr(x, s) = 0 OR (s = ends[k] AND instr(x, s) <> 1) THEN NULL ELSE instr(x, s) * 10 + k END)) AS hit
  FROM trimmed
),
told AS (
  SELECT *,
    hit IS NOT NULL AND instr(substr(x, hit // 10 + length(starts[hit % 10])), ends[hit % 10]) = 0 AS opens,
    len(list_filter(docs, lambda d: contains(x, d))) > 0 AS has_doc,
    len(list_filter(marks, lambda m: starts_with(x, m))) > 0 AS marked,
    len(list_filter(docs, lambda d: starts_with(x, d))) > 0 AND NOT (indented AND len(list_filter(docs, lambda d: list_contains(marks, d))) > 0) AS doc_marked
  FROM found
),
kinds AS (
  SELECT path, key, i, x, raw,
    CASE WHEN x = '' THEN 'blank' WHEN i = 1 AND starts_with(x, '#!') THEN 'code' WHEN opens THEN 'open' WHEN hit IS NOT NULL THEN CASE WHEN has_doc THEN 'doc' ELSE 'comment' END
      WHEN marked THEN CASE WHEN doc_marked THEN 'doc' ELSE 'comment' END ELSE 'code' END AS kind,
    CASE WHEN opens THEN ends[hit % 10] END AS fin, has_doc
  FROM told
),
folded AS (
  SELECT path, list_reduce(list({{'x': x, 'kind': kind, 'fin': fin, 'd': has_doc}} ORDER BY i),
    lambda a, l: {{
      'x': '', 'kind': CASE WHEN l.kind = 'blank' THEN a.kind || 'b' WHEN a.fin IS NOT NULL THEN a.kind || CASE WHEN a.d THEN 'd' ELSE 'c' END
        WHEN l.kind = 'open' THEN a.kind || CASE WHEN l.d THEN 'd' ELSE 'c' END WHEN l.kind = 'doc' THEN a.kind || 'd' WHEN l.kind = 'comment' THEN a.kind || 'c' ELSE a.kind || 'o' END,
      'fin': CASE WHEN l.kind = 'blank' THEN a.fin WHEN a.fin IS NOT NULL THEN CASE WHEN contains(l.x, a.fin) THEN NULL ELSE a.fin END WHEN l.kind = 'open' THEN l.fin END,
      'd': CASE WHEN l.kind = 'blank' OR a.fin IS NOT NULL THEN a.d ELSE l.d END }},
    {{'x': '', 'kind': '', 'fin': NULL::VARCHAR, 'd': false}}) AS s
  FROM kinds WHERE key <> 'md' GROUP BY path
  UNION ALL
  SELECT path, list_reduce(list({{'x': x, 'kind': raw, 'fin': NULL::VARCHAR, 'd': false}} ORDER BY i),
    lambda a, l: {{
      'x': CASE WHEN l.x = '' OR starts_with(l.x, '<!--') OR a.fin IS NOT NULL THEN a.x WHEN starts_with(l.x, '```') OR starts_with(l.x, '~~~') THEN CASE WHEN a.x = 'f' THEN '' ELSE 'f' END ELSE a.x END,
      'kind': a.kind || CASE WHEN l.x = '' THEN 'b' WHEN starts_with(l.x, '<!--') OR a.fin IS NOT NULL THEN 'c' WHEN starts_with(l.x, '```') OR starts_with(l.x, '~~~') THEN 'o'
        WHEN a.x = 'f' OR starts_with(l.kind, '    ') OR starts_with(l.kind, chr(9)) THEN 'o' ELSE 'd' END,
      'fin': CASE WHEN l.x = '' THEN a.fin WHEN (starts_with(l.x, '<!--') OR a.fin IS NOT NULL) AND NOT ends_with(l.x, '-->') THEN '-->' END,
      'd': false }},
    {{'x': '', 'kind': '', 'fin': NULL::VARCHAR, 'd': false}}) AS s
  FROM kinds WHERE key = 'md' GROUP BY path
),
file_stats AS (
  SELECT cut.path AS path, key, CAST(len(parts) AS BIGINT) AS total_lines,
    CAST(len(parts) - length(replace(coalesce(s.kind, ''), 'o', '')) AS BIGINT) AS code_lines,
    CAST(len(parts) - length(replace(coalesce(s.kind, ''), 'c', '')) AS BIGINT) AS comment_lines,
    CAST(len(parts) - length(replace(coalesce(s.kind, ''), 'd', '')) AS BIGINT) AS doc_lines,
    CAST(len(parts) - length(replace(coalesce(s.kind, ''), 'b', '')) AS BIGINT) AS blank_lines, file_size
  FROM cut LEFT JOIN folded ON cut.path = folded.path
)"""

_LANGUAGE_ROWS = ", ".join(f"({quoted(k)}, {quoted(language)}, {quoted(category)})" for k, (language, category) in sorted(t.LANGUAGE_OF.items()))
#: ``languages(lkey, language, category)``.
LANGUAGES_SQL = f"languages(lkey, language, category) AS (VALUES {_LANGUAGE_ROWS})"
