"""Roll-ups of file statistics: by key, language, category and project.

All of them are partial aggregations before the one shuffle on a small key; the lookup table
of languages has a fixed size and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import scores
from plumbline.functions.tables import NO_EXTENSION, NO_EXTENSION_NAME

LINES = ("total_lines", "code_lines", "comment_lines", "doc_lines", "blank_lines")
SUMS = (*LINES, "file_size")


def sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS)]


def by_key(stats: DataFrame, *keys: str) -> DataFrame:
    """Files and sums per key (``key`` unless named)."""
    return stats.groupBy(*(keys or ("key",))).agg(*sums())


def totals(stats: DataFrame) -> DataFrame:
    """One row of sums, also for no files."""
    return stats.agg(*sums())


def with_language(df: DataFrame, languages: DataFrame, key: str = "key") -> DataFrame:
    """Adds ``language`` and ``category``; unknown keys are named after themselves and count as data."""
    known = F.broadcast(languages.select(F.col("key").alias("known_key"), "language", "category"))
    named = F.when(F.col(key).isin("", NO_EXTENSION), NO_EXTENSION_NAME).otherwise(F.concat(F.lit("."), F.col(key)))
    joined = df.join(known, F.col(key) == F.col("known_key"), "left")
    return joined.drop("known_key").withColumns({"language": F.coalesce("language", named), "category": F.coalesce("category", F.lit("data"))})


def by_language(stats: DataFrame, languages: DataFrame) -> DataFrame:
    """Sums per (category, language). Keys are summed before the join, so the join sees one row a key."""
    keyed = with_language(by_key(stats), languages)
    return keyed.groupBy("category", "language").agg(F.sum("files").alias("files"), *(F.sum(c).alias(c) for c in SUMS))


def by_category(stats: DataFrame, languages: DataFrame) -> DataFrame:
    """Languages, categories and the grand total in one roll-up; ``level`` is 0, 1 or 2."""
    keyed = with_language(by_key(stats), languages)
    rolled = keyed.rollup("category", "language").agg(F.grouping_id().alias("g"), F.sum("files").alias("files"), *(F.sum(c).alias(c) for c in LINES))
    return rolled.withColumn("level", F.when(F.col("g") == 0, 0).when(F.col("g") == 1, 1).otherwise(2)).drop("g")


def language_extensions(stats: DataFrame, languages: DataFrame) -> DataFrame:
    """Per language name: sums, and its keys in order as one string."""
    keyed = with_language(by_key(stats), languages)
    return keyed.groupBy("language").agg(F.sum("files").alias("files"), F.sum("total_lines").alias("total_lines"), F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"))


def basic(stats: DataFrame) -> DataFrame:
    """Project row: sums, means (0 without files), sizes of the largest and smallest extension mean, and the true extremes."""
    keyed = by_key(stats).join(stats.groupBy(F.col("key").alias("k2")).agg(F.max("file_size").alias("top"), F.min("file_size").alias("low")), F.col("key") == F.col("k2"))
    mean_size = F.expr("file_size div files")
    all_files = F.coalesce(F.sum("files"), F.lit(0))
    mean = lambda c: scores.ratio(F.sum(c), all_files)
    return keyed.agg(
        all_files.alias("files"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS),
        F.coalesce(mean("total_lines"), F.lit(0.0)).alias("average_lines"),
        F.coalesce(mean("file_size"), F.lit(0.0)).alias("average_size"),
        F.coalesce(F.max(mean_size), F.lit(0)).alias("largest_size"),
        F.coalesce(F.min(mean_size), F.lit(0)).alias("smallest_size"),
        F.coalesce(F.max("top"), F.lit(0)).alias("true_largest"),
        F.coalesce(F.min("low"), F.lit(0)).alias("true_smallest"),
    )


def shares(stats: DataFrame) -> DataFrame:
    """Rounded percentages of lines, files and size per key; no rows where the whole is 0."""
    keyed = by_key(stats)
    whole = keyed.agg(*(F.sum(c).alias(f"all_{c}") for c in ("total_lines", "files", "file_size")))  # one row
    share = lambda c: scores.round2(scores.ratio(F.col(c), F.col(f"all_{c}")) * 100)
    return keyed.crossJoin(F.broadcast(whole)).select("key", share("total_lines").alias("line_share"), share("files").alias("file_share"), share("file_size").alias("size_share"))


def _ratio_columns() -> dict[str, Column]:
    return scores.ratios(*(F.col(c) for c in LINES))


def ratios(df: DataFrame, *kept: str) -> DataFrame:
    """The six rounded ratios of rows of sums."""
    return df.select(*kept, *(c.alias(n) for n, c in _ratio_columns().items()))


def key_ratios(stats: DataFrame) -> DataFrame:
    """Ratios per key with lines and bytes per file."""
    per = lambda c: F.col(c) / F.col("files")
    return ratios(by_key(stats).withColumns({"lines_per_file": per("total_lines"), "size_per_file": per("file_size")}), "key", "lines_per_file", "size_per_file")


def consistency(stats: DataFrame) -> DataFrame:
    """Evenness of comment and documentation ratios over keys; 100 for one key or none."""
    r = ratios(by_key(stats), "key")
    even = (scores.evenness(F.col("comment_ratio")) + scores.evenness(F.col("doc_ratio"))) / 2
    return r.agg(F.when(F.count(F.lit(1)) <= 1, 100.0).otherwise(even).alias("consistency"))


def quality(stats: DataFrame) -> DataFrame:
    """Project scores from its rounded ratios."""
    r = {n: F.col(n) for n in _ratio_columns()}
    whole = ratios(totals(stats)).crossJoin(F.broadcast(consistency(stats)))  # two rows of one
    scored = whole.select(
        scores.documentation(r).alias("documentation"), scores.maintainability(r).alias("maintainability"), scores.readability(r).alias("readability"), "consistency"
    )
    overall = scores.overall(*(F.col(c) for c in scored.columns))
    return scored.withColumn("overall", overall).withColumn("level", scores.quality_level(F.col("overall")))


def file_quality(stats: DataFrame) -> DataFrame:
    """Scores of single files; a single file is consistent with itself."""
    r = {n: F.col(n) for n in _ratio_columns()}
    scored = ratios(stats, "path").select("path", scores.documentation(r).alias("documentation"), scores.maintainability(r).alias("maintainability"), scores.readability(r).alias("readability"))
    overall = scores.overall(F.col("documentation"), F.col("maintainability"), F.col("readability"), F.lit(100.0))
    return scored.withColumn("overall", overall).withColumn("level", scores.quality_level(F.col("overall")))


def diversity(stats: DataFrame) -> DataFrame:
    """Normalized Shannon entropy of lines over keys, 0 for one key or none."""
    keyed = by_key(stats).where("total_lines > 0")
    whole = keyed.agg(F.sum("total_lines").alias("whole"), F.count(F.lit(1)).alias("n"))
    p = F.col("total_lines") / F.col("whole")
    summed = keyed.crossJoin(F.broadcast(whole)).agg((-F.sum(p * F.log(p))).alias("h"), F.max("n").alias("n"))
    return summed.select(F.when(F.col("n") > 1, F.round(F.col("h") / F.log(F.col("n")), 9)).otherwise(0.0).alias("diversity"))


def leaders(stats: DataFrame) -> DataFrame:
    """The key that leads each measure; of equal ones the greatest key."""
    r = key_ratios(stats).select(F.col("key").alias("k2"), "code_ratio", "comment_ratio", "doc_ratio")
    keyed = by_key(stats).join(r, F.col("key") == F.col("k2"))
    lead = lambda m: F.max(F.struct(m.alias("m"), F.col("key").alias("key")))["key"]
    return keyed.agg(
        lead(F.col("files")).alias("most_files"),
        lead(F.col("total_lines")).alias("most_lines"),
        lead(F.col("file_size")).alias("largest"),
        lead(F.col("doc_ratio") + F.col("comment_ratio")).alias("most_documented"),
        lead((F.col("code_ratio") * 1000).cast("long")).alias("most_efficient"),
    )


def partition_errors(stats: DataFrame) -> DataFrame:
    """Files whose categories don't add up to their lines; empty if all is well."""
    parts = F.col("code_lines") + F.col("comment_lines") + F.col("doc_lines") + F.col("blank_lines")
    return stats.where(parts != F.col("total_lines")).select("path")


def merge(reports: DataFrame) -> DataFrame:
    """One report of several (rows of sums with ``languages``, a list): sums, recomputed ratios, sorted union of languages.

    An empty list has no merged report, so no row comes out; of one report its sums come out as they are.
    """
    whole = reports.agg(F.sum("files").alias("files"), *(F.sum(c).alias(c) for c in SUMS), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("languages")))), ",").alias("languages"), F.count(F.lit(1)).alias("reports"))
    return ratios(whole.where("reports > 0"), "reports", "files", *SUMS, "languages")


def metadata(stats: DataFrame, *groups: str, milliseconds: int = 0, version: str = "0.1.0") -> DataFrame:
    """What a report says of itself (per group of files): files and bytes analyzed, extensions found, the time it took, version, depth."""
    found = stats.groupBy(*groups).agg(F.count(F.lit(1)).alias("file_count_analyzed"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes_analyzed"), F.array_sort(F.collect_set("key")).alias("languages_detected"))
    return found.withColumns({"calculation_time_ms": F.lit(milliseconds).cast("long"), "version": F.lit(version), "analysis_depth": F.lit("Complete")})


def merge_metadata(reports: DataFrame, version: str = "0.1.0") -> DataFrame:
    """The metadata of several reports in one row: sums, and the sorted union of what they found."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("file_count_analyzed", "total_bytes_analyzed", "calculation_time_ms")]
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_set("languages_detected")))).alias("languages_detected")
    return reports.agg(*sums, union).withColumns({"version": F.lit(version), "analysis_depth": F.lit("Complete")})


def numeric_groups(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The same roll-up on any numeric column: count, sum, mean, share of the whole, population deviation."""
    keyed = df.groupBy(*groups).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.stddev_pop(value).alias("d"))
    whole = Window.partitionBy()  # over one row a group
    share = F.col("s") / F.sum("s").over(whole)
    return keyed.select(*groups, "n", F.round("s", 2).alias("total"), F.round(F.col("s") / F.col("n"), 4).alias("mean"), F.round(share, 6).alias("share"), F.round("d", 4).alias("deviation"))
