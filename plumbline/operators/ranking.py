"""Sorts, top-k, pie slices and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import scores
from plumbline.functions.paths import file_name, sort_key

# Words that a content search takes as code of a kind of file, and general ones.
CODE_WORDS = {
    "rs": "fn struct impl trait enum mod use pub let mut",
    "py": "def class import from if else for while try except",
    "js ts": "function class const let var if else for while try catch",
    "java": "public private class interface extends implements import package",
    "cpp cc cxx": "class struct namespace template public private protected",
}
GENERAL_WORDS = "main init config util helper test spec mock".split()


def language_order(rows: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    """``rank`` of language rows by a metric; equal ones by name, and ascending reverses the whole order."""
    value = {"files": F.col("files"), "lines": F.col("total_lines"), "code": F.col("code_lines"), "docs": scores.ratio(F.col("doc_lines"), F.col("total_lines"))}[metric]
    order = [value.asc(), F.col("language").desc()] if ascending else [value.desc(), F.col("language").asc()]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))  # one row a language


def top_per_category(rows: DataFrame, n: int, metric: str = "total_lines") -> DataFrame:
    """The n leading languages of each category."""
    order = Window.partitionBy("category").orderBy(F.col(metric).desc(), F.col("language").asc())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def first_paths(stats: DataFrame, n: int) -> DataFrame:
    """The first n files in path order; components compare, not characters."""
    return stats.orderBy(sort_key(F.col("path"))).limit(n)


def top_files(stats: DataFrame, n: int, total_weight: float = 0.6, code_weight: float = 0.4) -> DataFrame:
    """The n largest files by weighted lines; equal ones by path."""
    score = F.col("total_lines") * total_weight + F.col("code_lines") * code_weight
    return stats.select("path", "total_lines", "code_lines", score.alias("score")).orderBy(F.col("score").desc(), "path").limit(n)


def pie(keyed: DataFrame, value: str, least_percent: float = 1.0, most: int = 10) -> DataFrame:
    """``label, value``: the largest slices; slices under ``least_percent`` are left out, further ones are summed as Others."""
    whole = F.sum(value).over(Window.partitionBy())  # one row a key
    shown = keyed.select("key", F.col(value).alias("value"), (F.col(value) / whole * 100).alias("percent")).where(F.col("percent") >= least_percent)
    ranked = shown.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.col("value").desc(), "key")))
    label = F.when(F.col("rank") <= most, F.col("key")).otherwise("Others")
    return ranked.groupBy(label.alias("label")).agg(F.sum("value").alias("value")).where("value > 0")


def line_pie(totals: DataFrame) -> DataFrame:
    """``label, value`` of the kinds of lines that occur."""
    kinds = [("Code Lines", "code_lines"), ("Comment Lines", "comment_lines"), ("Documentation Lines", "doc_lines"), ("Blank Lines", "blank_lines")]
    slices = F.array(*(F.struct(F.lit(n).alias("label"), F.col(c).alias("value")) for n, c in kinds))
    return totals.select(F.explode(slices).alias("s")).select("s.*").where("value > 0")


def fuzzy(text: Column, pattern: str) -> Column:
    """Share of the pattern's characters found in order, greedily."""
    if not pattern:
        return F.lit(0.0)
    letters = F.array(*map(F.lit, pattern))
    found = F.aggregate(F.split(text, ""), F.lit(0), lambda n, c: n + F.when(c == F.get(letters, n), 1).otherwise(0))
    return found / float(len(pattern))


def search_paths(stats: DataFrame, query: str) -> DataFrame:
    """Files whose path holds the query, whatever the case, with a relevance; equal ones in path order."""
    q = query.lower()
    name = F.lower(file_name(F.col("path")))
    relevance = F.when(name == q, 1.0).when(name.startswith(q), 0.9).when(name.contains(q), 0.7).otherwise(fuzzy(name, q) * 0.5)
    return stats.where(F.lower("path").contains(q)).select("path", "total_lines", "code_lines", relevance.alias("relevance"))


def search_extensions(stats: DataFrame, query: str) -> DataFrame:
    """Files whose extension holds the query. The path tells its extension, so no join of files and extensions is needed."""
    from plumbline.functions.paths import extension

    ext = extension(F.col("path"))
    return stats.where(F.lower(ext).contains(query.lower())).select("path", "total_lines", F.concat(F.lit("Extension: "), ext).alias("match"), F.lit(0.8).alias("relevance"))


def search_content(stats: DataFrame, query: str) -> DataFrame:
    """Files that would hold the query by their kind (0.8) or by a general word in the path (0.6)."""
    q = query.lower()
    ext = F.element_at(F.split("path", r"\."), -1)
    kinds = [e for exts, words in CODE_WORDS.items() if q in words.split() for e in exts.split()]
    general = [w for w in GENERAL_WORDS if w in q]
    told = F.when(ext.isin(*kinds), 0.8) if kinds else F.when(F.lit(False), 0.8)
    if general:
        told = told.when(F.lower("path").rlike("|".join(general)), 0.6)
    return stats.select("path", "total_lines", told.otherwise(0.0).alias("relevance")).where("relevance > 0")


def found_files(stats: DataFrame, results: DataFrame) -> DataFrame:
    """Statistics of the files a search found."""
    return stats.join(results.select("path").distinct(), "path", "left_semi")


def found_extensions(keyed: DataFrame, results: DataFrame) -> DataFrame:
    """Extensions that occur among the found files."""
    from plumbline.functions.paths import extension

    present = results.select(extension(F.col("path")).alias("found_ext")).distinct()
    return keyed.select("key").join(present, F.col("key") == F.col("found_ext"), "left_semi")
