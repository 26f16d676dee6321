"""Report sinks: lines of text, CSV, Markdown, HTML, JSON and chart data from roll-ups.

A report has a row per extension or one per project, so its lines are rendered as columns and
ordered; what is written as one document is put together from those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scores

# Columns and texts of the formats.
CSV_HEADER = "Extension,Files,Total Lines,Code Lines,Comment Lines,Doc Lines,Blank Lines,Size (bytes)"
FULL_CSV_HEADER = "Extension,Files,Lines,Code,Comments,Docs,Blank,Size,Functions,Complexity"
TABLE_WIDTHS = [("Extension", -12), ("Files", 8), ("Lines", 10), ("Code", 10), ("Comments", 12), ("Docs", 10), ("Size", 12)]
PALETTES = {
    "default": "#007bff #28a745 #dc3545 #ffc107 #17a2b8 #6f42c1 #e83e8c #fd7e14 #20c997 #6c757d".split(),
    "pastel": "#ffb3ba #ffdfba #ffffba #baffc9 #bae1ff #d4baff #ffb3d4 #c9baff #baffe1 #ffc9ba".split(),
    "vibrant": "#ff6b6b #4ecdc4 #45b7d1 #96ceb4 #feca57 #ff9ff3 #54a0ff #5f27cd #00d2d3 #ff9f43".split(),
}
LANGUAGE_COLORS = {
    "rs": "#dea584", "py": "#3776ab", "js": "#f7df1e", "ts": "#3178c6", "html": "#e34f26", "css": "#1572b6", "java": "#ed8b00", "cpp": "#00599c", "go": "#00add8", "php": "#777bb4",
    "rb": "#cc342d", "swift": "#fa7343",
}
OTHER_COLOR = "#6c757d"
SORTS = {"files": "files", "lines": "total_lines", "code": "code_lines", "comments": "comment_lines", "docs": "doc_lines", "size": "file_size"}


def _ordered(keyed: DataFrame, sort: str | None, descending: bool = True) -> DataFrame:
    """Rows by a measure, equal ones by key; by key alone without one."""
    if sort is None:
        return keyed.orderBy("key")
    value = F.col(SORTS.get(sort, "total_lines"))
    return keyed.orderBy(value.desc() if descending else value.asc(), "key")


def csv_lines(keyed: DataFrame) -> DataFrame:
    """``key, line`` per extension, in the order of the header."""
    columns = ["key", "files", "total_lines", "code_lines", "comment_lines", "doc_lines", "blank_lines", "file_size"]
    return keyed.select("key", F.concat_ws(",", *(F.col(c).cast("string") for c in columns)).alias("line"))


def full_csv_lines(keyed: DataFrame, by_extension: DataFrame) -> DataFrame:
    """``key, line`` with functions and mean complexity; 0 where an extension has none."""
    known = by_extension.select(F.col("ext").alias("known_ext"), F.col("functions").alias("fn"), "cyclomatic")
    joined = keyed.join(known, F.col("key") == F.col("known_ext"), "left")
    columns = [F.col(c).cast("string") for c in ("key", "files", "total_lines", "code_lines", "comment_lines", "doc_lines", "blank_lines", "file_size")]
    more = [F.coalesce("fn", F.lit(0)).cast("string"), scores.one_decimal(F.coalesce("cyclomatic", F.lit(0.0)))]
    return joined.select("key", F.concat_ws(",", *columns, *more).alias("line"))


def _cells() -> list[Column]:
    n = scores.grouped_number
    return [F.col("key"), *(n(F.col(c)) for c in ("files", "total_lines", "code_lines", "comment_lines", "doc_lines")), scores.human_size(F.col("file_size"))]


def markdown_lines(keyed: DataFrame) -> DataFrame:
    """``key, line`` of a Markdown table."""
    return keyed.select("key", F.concat(F.lit("| "), F.concat_ws(" | ", *_cells()), F.lit(" |")).alias("line"))


def table_lines(keyed: DataFrame, sort: str = "lines", most: int | None = None) -> DataFrame:
    """``line`` of a table of fixed widths, the leading rows first."""
    pad = lambda c, w: F.when(F.char_length(c) >= abs(w), c).otherwise(F.rpad(c, -w, " ") if w < 0 else F.lpad(c, w, " "))
    rows = _ordered(keyed, sort)
    rows = rows if most is None else rows.limit(most)
    return rows.select(F.concat_ws(" ", *(pad(c, w) for c, (_, w) in zip(_cells(), TABLE_WIDTHS, strict=True))).alias("line"))


def summary_lines(totals: DataFrame) -> DataFrame:
    """One row of the short forms: summary, compact, quiet, with size."""
    c = F.col
    text = lambda pattern, *columns: F.format_string(pattern, *(c(x) for x in columns))
    return totals.select(
        text("Summary: %d files, %d lines (%d code, %d comments)", "files", "total_lines", "code_lines", "comment_lines").alias("summary"),
        text("%d files | %d lines | %d code | %d comments", "files", "total_lines", "code_lines", "comment_lines").alias("compact"),
        text("%d files, %d lines", "files", "total_lines").alias("quiet"),
        F.concat(text("%d files, %d lines, ", "files", "total_lines"), scores.told("%.1f MB", c("file_size") / (1024.0 * 1024.0))).alias("sized"),
    )


def text_report(totals: DataFrame, quality: DataFrame, functions: DataFrame | None = None) -> str:
    """The text report of a project: three rows of one are read."""
    t, q = totals.first(), quality.first()
    part = lambda c: f" ({t[c] / t['total_lines'] * 100:.1f}%)" if t["total_lines"] else ""
    lines = ["CODE STATISTICS", "═" * 50, f"Total Files: {t['files']:,}", f"Total Lines: {t['total_lines']:,}"]
    for name, c in (("Code", "code_lines"), ("Comment", "comment_lines"), ("Documentation", "doc_lines"), ("Blank", "blank_lines")):
        lines.append(f"{name} Lines: {t[c]:,}{part(c)}")
    lines.append(f"Total Size: {human_size(t['file_size'])}")
    f = functions.first() if functions is not None else None
    if f and f["functions"]:
        lines += ["", f"Functions: {f['functions']:,}", f"Avg Complexity: {f['cyclomatic']:.1f}", f"Max Nesting: {f['max_nesting']}"]
    lines += ["", "QUALITY SCORES", "─" * 30, f"Overall Quality: {q['overall']:.1f}/100", f"Documentation: {q['documentation']:.1f}/100"]
    return "\n".join([*lines, f"Maintainability: {q['maintainability']:.1f}/100", f"Readability: {q['readability']:.1f}/100", ""])


def human_size(size: int) -> str:
    value, units = float(size), ["B", "KB", "MB", "GB", "TB"]
    k = 0
    while value >= 1024 and k < len(units) - 1:
        value, k = value / 1024, k + 1
    return f"{size} B" if not k else f"{value:.1f} {units[k]}"


def _escaped(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = text.replace(a, b)
    return text


def html_report(totals: DataFrame, keyed: DataFrame, quality: DataFrame, title: str = "Code statistics") -> str:
    """A page with the totals, the scores and a row per extension."""
    t, q = totals.first(), quality.first()
    cards = [("Files", f"{t['files']:,}"), ("Lines", f"{t['total_lines']:,}"), ("Code", f"{t['code_lines']:,}"), ("Size", human_size(t["file_size"])), ("Quality", f"{q['overall']:.1f} ({q['level']})")]
    rows = "".join(
        f"<tr><td>{_escaped(r['key'])}</td>" + "".join(f"<td>{r[c]:,}</td>" for c in ("files", "total_lines", "code_lines", "comment_lines", "doc_lines", "blank_lines")) + "</tr>\n"
        for r in _ordered(keyed, "lines").collect()
    )
    top = "".join(f"<div class=card><b>{v}</b><span>{_escaped(n)}</span></div>" for n, v in cards)
    head = "<tr><th>Extension<th>Files<th>Lines<th>Code<th>Comments<th>Docs<th>Blank</tr>"
    style = "body{font-family:sans-serif;margin:2em}.card{display:inline-block;margin:1em}.card span{display:block}td,th{padding:.3em 1em;text-align:right}td:first-child,th:first-child{text-align:left}"
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{_escaped(title)}</title><style>{style}</style></head><body><h1>{_escaped(title)}</h1>{top}<table>{head}\n{rows}</table></body></html>\n"


def json_report(totals: DataFrame, keyed: DataFrame, ratios: DataFrame, quality: DataFrame, functions: DataFrame) -> DataFrame:
    """``json``: one nested row of everything; extensions are a map in order of key. A row per extension is gathered."""
    own = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct(*(c for c in keyed.columns if c != "key"))))))
    parts = [
        totals.select(F.struct("*").alias("basic")),
        keyed.agg(own.alias("stats_by_extension")),
        functions.select(F.struct("*").alias("complexity")),
        ratios.select(F.struct("*").alias("ratios")),
        quality.select(F.struct("*").alias("quality")),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(F.broadcast(part))  # rows of one
    return row.select(F.to_json(F.struct("*")).alias("json"))


def colors(labels: list[str], scheme: str = "default") -> list[str]:
    """A color per label: a palette in turn, greys, or by language."""
    if scheme == "monochrome":
        greys = [int(255 * (0.2 + 0.6 * i / max(1, len(labels)))) for i in range(len(labels))]
        return [f"#{g:02x}{g:02x}{g:02x}" for g in greys]
    if scheme == "language":
        return [LANGUAGE_COLORS.get(x, OTHER_COLOR) for x in labels]
    return [PALETTES[scheme][i % len(PALETTES[scheme])] for i in range(len(labels))]


def chart_lines(pie: DataFrame) -> DataFrame:
    """``label, value, text`` of slices, with their share of the shown whole, the largest first."""
    whole = pie.agg(F.sum("value").alias("whole"))
    text = F.concat("label", scores.told(" (%.1f%%)", F.col("value") / F.col("whole") * 100))
    return pie.crossJoin(F.broadcast(whole)).select("label", "value", text.alias("text"))


def chart(pie: DataFrame, title: str, scheme: str = "default") -> dict:
    """Chart configuration as plain data; at most a dozen slices are read."""
    rows = chart_lines(pie).orderBy(F.col("value").desc(), "label").collect()
    labels = [r["label"] for r in rows]
    sets = [{"data": [float(r["value"]) for r in rows], "backgroundColor": colors(labels, scheme), "borderWidth": 2, "borderColor": "#fff"}]
    plugins = {"title": {"display": True, "text": title}, "legend": {"position": "bottom", "labels": {"padding": 20, "usePointStyle": True}}}
    return {"type": "doughnut", "data": {"labels": [r["text"] for r in rows], "datasets": sets}, "options": {"responsive": True, "maintainAspectRatio": False, "plugins": plugins}}


def run_metrics(files: DataFrame, seconds: float) -> DataFrame:
    """One row of run counters of files (size, disposition, content): found, counted, failed, bytes, rates."""
    counted = F.count_if(F.col("content").isNotNull())
    size = F.coalesce(F.sum(F.when(F.col("content").isNotNull(), F.col("size"))), F.lit(0))
    rate = lambda x: x / F.lit(seconds) if seconds > 0 else F.lit(0.0)
    return files.agg(
        F.count(F.lit(1)).alias("discovered"), counted.alias("counted"), F.count_if(F.col("content").isNull()).alias("failed"), size.alias("bytes"), rate(counted).alias("files_per_second"),
        rate(size).alias("bytes_per_second"), (10 + 0.001 * counted + size / (10.0 * 1024 * 1024)).alias("memory_estimate_mb"),
    )
