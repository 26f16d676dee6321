"""Labels, estimates, recommendations and insights from statistics, and merged complexity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scores

# Guesses by extension, used where nothing was parsed.
BASE_COMPLEXITY = {
    "rs": 3.0, "cpp": 4.0, "cc": 4.0, "cxx": 4.0, "c": 4.0, "java": 3.5, "py": 2.5, "js": 3.0, "ts": 3.0, "go": 2.0, "rb": 2.5, "php": 3.5, "cs": 3.0, "swift": 3.0, "kt": 2.5, "html": 1.0,
    "css": 1.0, "scss": 1.0, "json": 0.5, "yaml": 0.5, "toml": 0.5, "md": 0.2,
}
OTHER_COMPLEXITY = 2.0
FUNCTION_DENSITY = {
    "rs": 0.05, "py": 0.08, "js": 0.06, "ts": 0.06, "java": 0.04, "cpp": 0.03, "cc": 0.03, "cxx": 0.03, "c": 0.03, "go": 0.06, "rb": 0.07, "php": 0.05, "cs": 0.04, "swift": 0.05, "kt": 0.05,
    "dart": 0.06, "erl": 0.04, "hrl": 0.04, "pl": 0.05, "pm": 0.05, "r": 0.07, "R": 0.07, "m": 0.04, "mlx": 0.04,
}
OTHER_DENSITY = 0.05
COMPLEXITY_CLASS = {
    "high": "cpp cc cxx c", "medium": "java cs php rs js ts swift", "low": "py rb go kt", "very-low": "html css scss json yaml toml md",
}


def _by_extension(ext: Column, values: dict, other) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), ext), F.lit(other))


def extension_complexity(ext: Column, total: Column, comment: Column) -> Column:
    """Guess from the kind of file, its size and its comments, at most 10."""
    size = F.when(total > 1000, 2.0).when(total > 500, 1.0).otherwise(0.0)
    bare = F.when(comment / F.greatest(total, F.lit(1)) < 0.1, 1.0).otherwise(0.0)
    return F.least(F.lit(10.0), _by_extension(ext, BASE_COMPLEXITY, OTHER_COMPLEXITY) + size + bare)


def extension_functions(ext: Column, code: Column) -> Column:
    """Guess of the number of functions."""
    return (code * _by_extension(ext, FUNCTION_DENSITY, OTHER_DENSITY)).cast("long")


def file_complexity(total: Column, code: Column, comment: Column) -> Column:
    """Guess from size, density and comments alone, at most 10."""
    whole = F.greatest(total, F.lit(1))
    bare = F.when(comment / whole < 0.1, 1.0).otherwise(0.0)
    dense = F.when(code / whole > 0.8, 1.0).otherwise(0.0)
    return F.least(F.lit(10.0), 1 + F.least(total / 100.0, F.lit(5.0)) + bare + dense)


def extension_class(ext: Column) -> Column:
    classes = {e: name for name, exts in COMPLEXITY_CLASS.items() for e in exts.split()}
    return F.concat(F.lit("complexity-"), _by_extension(ext, classes, "low"))


def score_class(score: Column) -> Column:
    name = F.when(score <= 2, "very-low").when(score <= 4, "low").when(score <= 6, "medium").when(score <= 8, "high").otherwise("very-high")
    return F.concat(F.lit("complexity-"), name)


def regret_level(total: Column) -> Column:
    return F.when(total <= 100, "Mild regret").when(total <= 500, "Moderate regret").when(total <= 2000, "High regret").otherwise("Existential crisis")


def productivity(total: Column, code: Column) -> Column:
    """Label of the share of code; shares between 79.9 and 80, 59.9 and 60, 39.9 and 40 belong to none."""
    p = scores.ratio(code, total) * 100
    return (
        F.when((p >= 80) & (p <= 100), "🔥 Code machine").when((p >= 60) & (p <= 79.9), "💪 Productive").when((p >= 40) & (p <= 59.9), "📝 Documenter").when((p >= 20) & (p <= 39.9), "💬 Commenter")
        .otherwise("🌬️ Air enthusiast")
    )


def quality_indicator(score: Column) -> Column:
    return F.when(score >= 80, "🟢 Good").when(score >= 60, "🟡 Fair").otherwise("🔴 Poor")


def complexity_indicator(value: Column) -> Column:
    return F.when(value <= 5, "🟢 Low").when(value <= 10, "🟡 Medium").otherwise("🔴 High")


def debt_indicator(value: Column) -> Column:
    return F.when(value <= 20, "🟢 Low").when(value <= 40, "🟡 Medium").otherwise("🔴 High")


def estimates(keyed: DataFrame) -> DataFrame:
    """Guesses and classes per extension."""
    c = F.col
    guess = extension_complexity(c("key"), c("total_lines"), c("comment_lines"))
    return keyed.select("key", guess.alias("complexity"), extension_functions(c("key"), c("code_lines")).alias("functions"), extension_class(c("key")).alias("kind"), score_class(guess).alias("level"))


def recommendations(project: DataFrame) -> DataFrame:
    """``title, priority`` for rows of statistics (average_complexity, maintainability, coverage, size_health, max_nesting, debt, average_length, cyclomatic)."""
    c = F.col
    rules = [
        (c("average_complexity") > 10, "High Complexity Functions", "High"),
        (c("maintainability") < 60, "Low Maintainability Index", "High"),
        (c("coverage") < 25, "Low Documentation Coverage", "Medium"),
        (c("size_health") < 70, "Large Functions Detected", "Medium"),
        (c("max_nesting") > 5, "Deep Nesting Detected", "Medium"),
        (c("debt") > 40, "High Technical Debt", "High"),
        (c("average_length") > 50, "Long Functions", "Low"),
        (c("cyclomatic") <= 5, "Good Code Complexity", "Low"),
    ]
    found = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(title).alias("title"), F.lit(priority).alias("priority"))) for when, title, priority in rules)))
    return project.select(F.explode(found).alias("r")).select("r.title", "r.priority")


def complexity_insights(project: DataFrame, *kept: str) -> DataFrame:
    """``insight`` rows of statistics (functions, high, very_high, cyclomatic, average_length, max_nesting), with the columns to keep."""
    c = F.col
    many = c("high") + c("very_high")
    told = [
        F.when(many > 0, scores.told("%.1f%% of functions have high complexity", many / c("functions") * 100)),
        F.when(c("cyclomatic") <= 3, "Excellent complexity management").when(c("cyclomatic") <= 7, "Good complexity levels overall").otherwise("Consider refactoring for better complexity"),
        F.when(c("average_length") <= 20, "Functions are well-sized").when(c("average_length") <= 40, "Function sizes are reasonable").otherwise("Consider breaking down large functions"),
        F.when(c("max_nesting") <= 3, "Good nesting depth control").otherwise("Consider reducing nesting depth"),
    ]
    return project.select(*kept, F.explode(F.array_compact(F.array(*told))).alias("insight"))


def summary(totals: DataFrame, statistics: DataFrame, quality: DataFrame, languages: Column) -> DataFrame:
    """``name, value`` pairs of the short summary; ``languages`` counts the distinct ones in ``totals``."""
    row = totals.withColumn("languages", languages).crossJoin(F.broadcast(statistics.select("functions", "cyclomatic"))).crossJoin(F.broadcast(quality.select("overall")))  # rows of one
    c = F.col
    level = F.when(c("overall") >= 80, "Excellent").when(c("overall") >= 60, "Good").otherwise("Needs Improvement")
    complexity = F.when(c("cyclomatic") <= 5, "Low").when(c("cyclomatic") <= 10, "Medium").otherwise("High")
    pairs = {
        "total_files": c("files").cast("string"), "total_lines": c("total_lines").cast("string"), "code_lines": c("code_lines").cast("string"), "functions": c("functions").cast("string"),
        "avg_complexity": scores.one_decimal(c("cyclomatic")), "quality_score": scores.one_decimal(c("overall")), "languages": c("languages").cast("string"), "quality_level": level,
        "complexity_level": complexity,
    }
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in pairs.items()))).alias("p")).select("p.name", "p.value")


def merge_complexity(reports: DataFrame) -> DataFrame:
    """One row of several reports' statistics: means weighted by functions; lengths and parameters are summed as whole numbers per report; the least length counts zeros."""
    c, n = F.col, F.col("functions")
    weighted = lambda x: F.sum(c(x) * n)
    whole = lambda x: F.sum((c(x) * n).cast("long"))
    mean = lambda x: F.when(c("functions") > 0, c(x) / c("functions")).otherwise(0.0)
    sums = reports.agg(
        F.count(F.lit(1)).alias("reports"), F.sum(n).alias("functions"), weighted("cyclomatic").alias("cyclomatic"), weighted("cognitive").alias("cognitive"), whole("average_length").alias("average_length"),
        F.max("max_length").alias("max_length"), F.min("min_length").alias("min_length"), F.max("max_nesting").alias("max_nesting"), weighted("average_nesting").alias("average_nesting"),
        whole("average_parameters").alias("average_parameters"), F.max("max_parameters").alias("max_parameters"),
    ).where("reports > 0")
    return sums.withColumns({x: mean(x) for x in ("cyclomatic", "cognitive", "average_length", "average_nesting", "average_parameters")})


def structure_pie(counts: DataFrame) -> DataFrame:
    """``label, value`` of the kinds of structures that occur, or the placeholder."""
    kinds = [("Classes", "classes"), ("Interfaces", "interfaces"), ("Traits", "traits"), ("Enums", "enums"), ("Structs", "structs"), ("Modules", "modules")]
    return _slices(counts, kinds, "structures", "No structures found")


def complexity_pie(counts: DataFrame) -> DataFrame:
    """``label, value`` of the complexity classes that occur; the lowest class is left out, its neighbour is labelled from 1 on."""
    kinds = [("Low Complexity (1-10)", "low"), ("Medium Complexity (11-20)", "medium"), ("High Complexity (21-50)", "high"), ("Very High Complexity (50+)", "very_high")]
    total = sum((F.col(c) for _, c in kinds), F.lit(0))
    return _slices(counts.withColumn("shown", total), kinds, "shown", "No functions found")


def _slices(counts: DataFrame, kinds: list[tuple[str, str]], whole: str, placeholder: str) -> DataFrame:
    slices = [F.when((F.col(whole) > 0) & (F.col(c) > 0), F.struct(F.lit(n).alias("label"), F.col(c).cast("long").alias("value"))) for n, c in kinds]
    none = F.when(F.col(whole) == 0, F.struct(F.lit(placeholder).alias("label"), F.lit(1).cast("long").alias("value")))
    return counts.select(F.explode(F.array_compact(F.array(*slices, none))).alias("s")).select("s.*")


def detected_language(files: DataFrame, detected: DataFrame, languages: DataFrame) -> DataFrame:
    """``path, language``: the first name (by position) a detector (name, path, position) gave the extension, else the table's."""
    ext = lambda p: F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1))
    told = detected.groupBy(ext(F.col("path")).alias("known_ext")).agg(F.min_by("name", "position").alias("told"))
    table = F.broadcast(languages.select(F.col("key").alias("table_key"), F.col("language").alias("listed")))
    keyed = files.select("path", ext(F.col("path")).alias("ext"))
    joined = keyed.join(told, F.col("ext") == F.col("known_ext"), "left").join(table, F.col("ext") == F.col("table_key"), "left")
    return joined.select("path", F.coalesce("told", "listed").alias("language"))
