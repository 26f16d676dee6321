"""Queries of the function analyzers, one per language, each with SQL that follows the file line by line.

Every line of a document's text becomes a function of four lines: its head, a statement that the
line's length picks, an assignment with that length, and its end.  The SQL knows for each
language on which lines such a function begins and ends, and counts branch words itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.operators import complexity
from plumbline.operators.analyzers.rules import BRANCHES
from plumbline.plans.file_queries import query
from plumbline.plans.views import load, quoted


@dataclass
class Sample:
    """Lines of a function ({j}: its number, {n}: the line's length) and what is to be found."""

    ext: str
    head: str
    statements: tuple[str, ...]
    value: str
    end: str
    first: int = 1  # first and last line that are measured
    last: int = 4
    count: int = 4  # lines it is said to have
    parameters: tuple[int, ...] = (2,)  # by statement
    top: tuple[str, ...] = field(default=())

    @property
    def lines(self) -> tuple[str, str]:
        return self.head, self.end


_MARKS = ("  a && b || c;", "  a ? b : c;", "  a;", "  while a;")
SAMPLES = {
    "rust": Sample("rs", "pub fn f{j}(a: i32, b: &str) -> i32 {", ("  if a && b || c;", "  match a;", "  a?;", "  a;"), "  let n = {n};", "}"),
    "python": Sample("py", "def f{j}(a, b):", ("    if g(a, b, c) and d:", "    while x or y:", "    x", "    for k in h(a):"), "    n = {n}", "", 2, 3, 2, (3, 0, 0, 1)),
    "javascript": Sample("js", "function f{j}(a, b) {", (*_MARKS, "  switch a;"), "  n = {n};", "}"),
    "java": Sample("java", "public int f{j}(int a, List<int, int> b) {", (*_MARKS, "  case a:"), "  n = {n};", "}"),
    "cpp": Sample("cpp", "int f{j}(int a, char b) {", _MARKS, "  n = {n};", "}"),
    "go": Sample("go", "func (t *T) f{j}(a int, b string) {", ("  if a && b;", "  defer a", "  go b", "  select a || c"), "  n = {n}", "}", parameters=(1,), top=("type T struct {", "  a int", "}")),
    "csharp": Sample("cs", "public int f{j}(int a, Map<int, int> b) {", (*_MARKS, "  lock a;"), "  n = {n};", "}"),
    "php": Sample("php", "public function f{j}($a, $b = ',') {", (*_MARKS, "  $a xor $b;"), "  $n = {n};", "}", top=("<?php",)),
    "ruby": Sample("rb", "def f{j}(a, b)", ("  a && b", "  c unless d", "  raise a", "  a"), "  n = {n}", "end"),
    "swift": Sample("swift", "func f{j}(a: Int, b: Map<Int, Int>) {", (*_MARKS, "  guard a"), "  let n = {n}", "}"),
    "kotlin": Sample("kt", "fun f{j}(a: Int, b: Map<Int, Int>) {", ("  a && b || c", "  a ?: b", "  when a", "  a!!"), "  val n = {n}", "}"),
    "dart": Sample("dart", "void f{j}(int a, Map<int, int> b) {", (*_MARKS, "  await a;"), "  n = {n};", "}"),
    "erlang": Sample("erl", "f{j}(A, B) ->", ("  A andalso B,", "  A orelse B,", "  A,", "  not A,"), "  N = {n},", "  ok."),
    "perl": Sample("pl", "sub f{j} {", ("  $a && $b;", "  die $a;", "  $a unless $b;", "  $a;"), "  my $n = {n};", "}", parameters=(0,)),
    "r": Sample("r", "f{j} <- function(a, b) {", ("  a && b", "  !a | b", "  a", "  repeat a"), "  n <- {n}", "}"),
    "matlab": Sample("m", "function x = f{j}(a, b)", ("  a && ~b;", "  any a;", "  a;", "  break;"), "  n = {n};", "end"),
    "elixir": Sample("ex", "def f{j}(a, b) do", ("  a && b", "  a |> b", "  a", "  not a"), "  n = {n}", "end", count=3),
    "julia": Sample("jl", "function f{j}(a, b)", ("  a && b", "  a ? b", "  a", "  !a"), "  n = {n}", "end", last=3, count=2),
    "lua": Sample("lua", "function f{j}(a, b)", ("  g = a and b", "  goto a", "  n = {n}", "  assert a"), "end", "end", count=3),
    "zig": Sample("zig", "pub fn f{j}(a: i32, b: i32) void {", ("  a and b;", "  try a;", "  a;", "  a orelse b;"), "  n = {n};", "}", count=3),
    "clojure": Sample("clj", "(defn f{j} [a b]", ("  (and a b)", "  (when a)", "  (str a)", "  (if-not a)"), "  (str {n})", "  )", count=3),
    "haskell": Sample("hs", "f{j} a b = g", ("  (a && b)", "  (not a)", "  a", "  (either a)"), "  {n}", "  c", count=3),
}


def files(spark, sf_dir, sample: Sample):
    """A file per document; see the module."""
    statement = lambda x: F.element_at(F.array(*map(F.lit, sample.statements)), (F.length(x) % len(sample.statements) + 1).cast("int"))
    filled = any("{" in s for s in sample.statements)
    lines = lambda x, j: [_filled(sample.head, x, j), _filled(statement(x), x, j) if filled else statement(x), _filled(sample.value, x, j), F.lit(sample.end)]
    text = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    body = F.flatten(F.transform(text, lambda x, j: F.array(*lines(x, j))))
    content = F.array_join(F.concat(F.array(*map(F.lit, sample.top)), body) if sample.top else body, "\n")
    path = F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(f".{sample.ext}"))
    return load(spark, sf_dir, "documents").select(path.alias("path"), content.alias("content"))


def _filled(line: str | Column, x, j):
    """The line with the function's number and the length; a fixed one has what stands between them put together."""
    if isinstance(line, str):
        parts = re.split(r"(\{[jn]\})", line)
        return F.concat(*({"{j}": j.cast("string"), "{n}": F.length(x).cast("string")}.get(p, F.lit(p)) for p in parts if p))
    return F.replace(F.replace(line, F.lit("{j}"), j.cast("string")), F.lit("{n}"), F.length(x).cast("string"))


def _sql(language: str) -> str:
    """Rows ``path, ext, name, start_line, end_line, line_count, cyclomatic, parameter_count``."""
    s = SAMPLES[language]
    fill = lambda line: f"replace(replace({quoted(line)}, '{{j}}', CAST(j AS VARCHAR)), '{{n}}', CAST(length(x) AS VARCHAR))"
    pick = f"[{', '.join(map(fill, s.statements))}][length(x) % {len(s.statements)} + 1]"
    parts = [fill(s.head), pick, fill(s.value), quoted(s.end)][s.first - 1 : s.last]
    words = "[" + ", ".join(map(quoted, BRANCHES[language])) + "]"
    whole = f"array_to_string([{', '.join(parts)}], chr(10))"
    top = len(s.top)
    parameters = f"[{', '.join(map(str, s.parameters))}][length(x) % {len(s.statements)} + 1]" if len(s.parameters) > 1 else str(s.parameters[0])
    return f"""SELECT 'src/f' || doc_id || '.{s.ext}' AS path, '{s.ext}' AS ext, 'f' || j AS name, CAST({top} + 4 * j + 1 AS BIGINT) AS start_line, CAST({top} + 4 * j + {s.last} AS BIGINT) AS end_line,
  CAST({s.count} AS BIGINT) AS line_count, CAST(1 + list_sum(list_transform({words}, lambda w: (length(whole) - length(replace(whole, w, ''))) // length(w))) AS BIGINT) AS cyclomatic,
  CAST({parameters} AS BIGINT) AS parameter_count
FROM (SELECT doc_id, x, j, {whole} AS whole FROM (SELECT doc_id, unnest(parts) AS x, unnest(range(len(parts))) AS j FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))"""


def _register(language: str) -> None:
    sample = SAMPLES[language]

    def run(spark, sf_dir):
        rows = complexity.functions(complexity.analyze(files(spark, sf_dir, sample), structures=False))
        return rows.select("path", "ext", "name", "start_line", "end_line", "line_count", "cyclomatic", "parameter_count")

    run.__name__ = f"functions_{language}"
    run.__doc__ = f"Functions that the analyzer of {language} finds in a file per document."
    query(_sql(language))(run)


for _language in SAMPLES:
    _register(_language)


@query("SELECT 'src/f' || doc_id || '.go' AS path, 'T' AS name, 'Struct' AS kind, CAST(3 AS BIGINT) AS line_count, CAST(1 AS BIGINT) AS properties, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS method_count FROM documents")
def struct_methods(spark, sf_dir):
    """Structures with the methods that name them as their receiver."""
    rows = complexity.structures(complexity.analyze(files(spark, sf_dir, SAMPLES["go"])))
    return rows.select("path", "name", "kind", "line_count", "properties", "method_count")


_THREE = ("rust", "java", "lua")


def _of_three(spark, sf_dir):
    rows = [complexity.functions(complexity.analyze(files(spark, sf_dir, SAMPLES[x]), structures=False)) for x in _THREE]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_ALL = "found AS (" + " UNION ALL ".join(map(_sql, _THREE)) + ")"


@query(
    f"""WITH {_ALL} SELECT count(*) AS functions, CAST(sum(cyclomatic) AS DOUBLE) / count(*) AS cyclomatic, CAST(sum(line_count) AS DOUBLE) / count(*) AS average_length, max(line_count) AS max_length,
  min(line_count) AS min_length, CAST(sum(parameter_count) AS DOUBLE) / count(*) AS average_parameters, count(*) FILTER (cyclomatic BETWEEN 1 AND 5) AS very_low, count(*) FILTER (cyclomatic > 5) AS higher FROM found"""
)
def extracted_statistics(spark, sf_dir):
    """Statistics and distribution of functions that the analyzers have found."""
    found = _of_three(spark, sf_dir).agg(*complexity.statistics(), *complexity.distribution())
    higher = F.col("low") + F.col("medium") + F.col("high") + F.col("very_high")
    return found.select("functions", "cyclomatic", "average_length", "max_length", "min_length", "average_parameters", "very_low", higher.alias("higher"))


@query(f"WITH {_ALL} SELECT ext, count(*) AS functions, CAST(sum(cyclomatic) AS DOUBLE) / count(*) AS cyclomatic, CAST(sum(line_count) AS DOUBLE) / count(*) AS average_length FROM found GROUP BY ext")
def extracted_by_extension(spark, sf_dir):
    """Functions that the analyzers have found, by extension."""
    return complexity.by_extension(_of_three(spark, sf_dir)).select("ext", "functions", "cyclomatic", "average_length")
