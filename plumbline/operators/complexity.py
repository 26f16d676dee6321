"""Function and structure metrics: extraction, per-file and project statistics, health.

``analyze`` reads each file once, in one Arrow pass, and yields both kinds of rows nested in
the file's row; files without an analyzer are left out before any content is touched.  All
statistics are ordinary aggregations of sums, counts and extremes, so they merge map-side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields
from functools import partial
from itertools import accumulate
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from plumbline.functions import scores
from plumbline.functions.paths import extension
from plumbline.operators.analyzers.engine import Function, Structure
from plumbline.operators.analyzers.languages import analyze as analyze_text
from plumbline.operators.analyzers.rules import EXTENSIONS


def _schema(record) -> StructType:
    kinds = {"str": StringType(), "int": LongType(), "bool": BooleanType(), "str | None": StringType()}
    return StructType([StructField(f.name, kinds[str(f.type)]) for f in fields(record)])


FUNCTION, STRUCTURE = _schema(Function), _schema(Structure)
_RESULT = StructType([StructField("path", StringType()), StructField("ext", StringType()), StructField("functions", ArrayType(FUNCTION)), StructField("structures", ArrayType(STRUCTURE))])


def _arrow(schema: StructType) -> pa.DataType:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return pa.list_(pa.struct([(f.name, kinds[f.dataType.simpleString()]) for f in schema]))


#: So many functions and structures are held as Python objects at once, besides those of one file.
ROWS_AT_ONCE = 8_192


def _nested(found: list[list], schema: StructType) -> pa.ListArray:
    """A list of records per file, built column by column."""
    rows = [x for one in found for x in one]
    columns = zip(*map(attrgetter(*schema.names), rows), strict=True) if rows else [()] * len(schema)
    kind = _arrow(schema)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
    ends = [0, *accumulate(map(len, found))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind)


def _analyzed(parts: Iterator[pa.RecordBatch], structures: bool) -> Iterator[pa.RecordBatch]:
    """Batches of (path, ext, content) as batches of the result, which are given out before they hold much more than ``ROWS_AT_ONCE``."""
    for part in parts:
        start, held, found, built = 0, 0, [], []
        for i in range(part.num_rows):
            f, s = analyze_text(part.column(2)[i].as_py(), part.column(1)[i].as_py(), structures)
            found.append(f)
            built.append(s)
            held += len(f) + len(s)
            if held >= ROWS_AT_ONCE or i + 1 == part.num_rows:
                kept = part.slice(start, len(found))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), _nested(found, FUNCTION), _nested(built, STRUCTURE)], names=_RESULT.names)
                start, held, found, built = i + 1, 0, [], []


def analyze(files: DataFrame, structures: bool = True) -> DataFrame:
    """``path, ext, functions, structures`` of ``files`` (path, content) that have an analyzer. Null or undecodable content has no functions.

    Without ``structures`` these aren't looked for, and their lists are empty.
    """
    ext = F.coalesce(F.lower(extension(F.col("path"))), F.lit("unknown"))
    known = files.select("path", ext.alias("ext"), F.col("content").cast("binary").alias("content")).where(F.col("ext").isin(*EXTENSIONS))
    return known.mapInArrow(partial(_analyzed, structures=structures), _RESULT)


def functions(analyzed: DataFrame) -> DataFrame:
    """One row per function."""
    return analyzed.select("path", "ext", F.explode("functions").alias("f")).select("path", "ext", "f.*")


def structures(analyzed: DataFrame) -> DataFrame:
    """One row per structure."""
    return analyzed.select("path", "ext", F.explode("structures").alias("s")).select("path", "ext", "s.*")


def concerns(f=F.col) -> Column:
    """What makes a function hard to maintain, as a list."""
    rules = [
        (f("line_count") > 50, "Function is too long (>50 lines)"),
        (f("cyclomatic") > 10, "High cyclomatic complexity"),
        (f("cognitive") > 15, "High cognitive complexity"),
        (f("parameter_count") > 5, "Too many parameters"),
        (f("nesting_depth") > 4, "Deep nesting detected"),
        (f("has_recursion"), "Contains recursion"),
        (f("return_path_count") > 5, "Multiple return paths"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in rules)))


def details(rows: DataFrame) -> DataFrame:
    """Function rows with level and concerns; local variables are reported as 0."""
    return rows.withColumns({"level": scores.complexity_level(F.col("cyclomatic")), "concerns": concerns(), "local_variable_count": F.lit(0).cast("long")})


def _mean(column: str) -> Column:
    return F.when(F.count(F.lit(1)) > 0, F.sum(column) / F.count(F.lit(1))).otherwise(0.0)


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def function_score() -> Column:
    """Points of one function for length, both complexities and parameters, up to 130."""
    left = lambda most, c, k: F.greatest(F.lit(0.0), most - F.col(c) * float(k))
    return left(50, "line_count", 1) + left(30, "cyclomatic", 2) + left(30, "cognitive", 2) + left(20, "parameter_count", 3)


def statistics() -> list[Column]:
    """Aggregates over function rows."""
    return [
        F.count(F.lit(1)).alias("functions"),
        _mean("cyclomatic").alias("cyclomatic"),
        _mean("cognitive").alias("cognitive"),
        _mean("line_count").alias("average_length"),
        _zero(F.max("line_count")).alias("max_length"),
        _zero(F.min("line_count")).alias("min_length"),
        _zero(F.max("nesting_depth")).alias("max_nesting"),
        _mean("nesting_depth").alias("average_nesting"),
        _mean("parameter_count").alias("average_parameters"),
        _zero(F.max("parameter_count")).alias("max_parameters"),
    ]


def distribution() -> list[Column]:
    """Functions by cyclomatic number; 0 falls into the last class."""
    c = F.col("cyclomatic")
    classes = [("very_low", c.between(1, 5)), ("low", c.between(6, 10)), ("medium", c.between(11, 20)), ("high", c.between(21, 50)), ("very_high", (c < 1) | (c > 50))]
    return [F.count_if(rule).alias(name) for name, rule in classes]


def structure_counts() -> list[Column]:
    """Structures by kind, and methods per class."""
    kind = F.col("kind")
    kinds = [("classes", ["Class"]), ("interfaces", ["Interface"]), ("traits", ["Trait"]), ("enums", ["Enum"]), ("structs", ["Struct"]), ("modules", ["Module", "Namespace"])]
    of_classes = F.sum(F.when(kind == "Class", F.col("method_count")))
    return [
        F.count(F.lit(1)).alias("structures"),
        *(F.count_if(kind.isin(*names)).alias(n) for n, names in kinds),
        F.when(F.count_if(kind == "Class") > 0, of_classes / F.count_if(kind == "Class")).otherwise(0.0).alias("methods_per_class"),
    ]


def by_extension(rows: DataFrame) -> DataFrame:
    """Per extension what is reported: count, mean cyclomatic and length, nesting. The other fields stay 0, the true cognitive mean is given apart."""
    return rows.groupBy("ext").agg(
        F.count(F.lit(1)).alias("functions"),
        _mean("cyclomatic").alias("cyclomatic"),
        _mean("line_count").alias("average_length"),
        _zero(F.max("nesting_depth")).alias("max_nesting"),
        _mean("nesting_depth").alias("average_nesting"),
        F.lit(0.0).alias("cognitive"),
        _mean("cognitive").alias("true_cognitive"),
    )


def _sums() -> list[Column]:
    """What all health scores need of a file's (or project's) functions."""
    length, cyclomatic, nesting = F.col("line_count"), F.col("cyclomatic"), F.col("nesting_depth")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(function_score()).alias("points"),
        F.sum("cyclomatic").alias("sum_cyclomatic"),
        F.sum("cognitive").alias("sum_cognitive"),
        F.sum("line_count").alias("sum_length"),
        F.sum("nesting_depth").alias("sum_nesting"),
        F.sum("parameter_count").alias("sum_parameters"),
        F.sum(F.when(length > 100, 10.0).when(length > 50, 5.0).otherwise(0.0)).alias("long"),
        F.sum(F.when(nesting > 8, 15.0).when(nesting > 5, 10.0).otherwise(0.0)).alias("deep"),
        F.sum(
            F.when(cyclomatic > 20, 20.0).when(cyclomatic > 10, 10.0).when(cyclomatic > 5, 5.0).otherwise(0.0)
            + F.when(length > 100, 15.0).when(length > 50, 10.0).otherwise(0.0)
            + F.when(nesting > 5, (nesting - 5) * 5.0).otherwise(0.0)
        ).alias("debt"),
    ]


def _clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def _health(joined: DataFrame, kept: list[str], duplication: Column) -> DataFrame:
    """Health scores of rows with line counts and the sums of their functions (null: none)."""
    c = F.col
    some = c("n") > 0
    total, code, told = c("total_lines"), c("code_lines"), c("comment_lines") + c("doc_lines")
    over = total - 500
    tiered = F.when(total > 2000, F.least(over / 100.0, F.lit(40.0))).when(total > 1000, F.least(over / 150.0, F.lit(25.0))).when(total > 500, F.least(over / 200.0, F.lit(15.0))).otherwise(0.0)
    doc_share = told / F.greatest(code, F.lit(1))
    bare = 85 - tiered + F.when(doc_share > 0.2, 10.0).when(doc_share < 0.05, -15.0).otherwise(0.0) - F.when(code < 10, 20.0).otherwise(0.0)
    maintainability = F.when(some, F.greatest(F.lit(0.0), _clamped(c("points") / c("n")) - tiered)).otherwise(_clamped(bare))
    coverage = scores.documentation_coverage(code, c("comment_lines"), c("doc_lines"))
    average = F.when(some, c("sum_cyclomatic") / c("n")).otherwise(0.0)
    unit = code / F.greatest(F.floor(code / 20), F.lit(1))
    plain_size = 75 - F.when(unit > 50, (unit - 50) * 0.5).when(unit < 5, (5 - unit) * 2.0).otherwise(0.0) - F.when(total > 500, F.least(over / 100.0, F.lit(25.0))).otherwise(0.0)
    length, nesting = c("sum_length") / c("n"), c("sum_nesting") / c("n")
    size_health = _clamped(F.when(some, 100 - F.greatest(F.lit(0.0), (length - 20) * 2.0) - c("long")).otherwise(plain_size))
    density = code / F.greatest(total, F.lit(1))
    plain_nesting = 80 - F.when(density > 0.8, 20.0).when(density > 0.6, 10.0).otherwise(0.0) - F.when(total > 1000, 15.0).otherwise(0.0)
    nesting_health = _clamped(F.when(some, 100 - F.greatest(F.lit(0.0), (nesting - 3) * 15.0) - c("deep")).otherwise(plain_nesting))
    debt = c("debt") + F.when(coverage < 20, 30 - coverage).otherwise(0.0)
    debt_ratio = F.when(some, F.least(F.lit(100.0), debt / F.greatest(c("n") * 50.0, F.lit(1.0)) * 100)).otherwise(0.0)
    scored = joined.select(
        *kept, maintainability.alias("maintainability"), coverage.alias("coverage"), average.alias("average_complexity"), size_health.alias("size_health"), nesting_health.alias("nesting_health"),
        duplication.alias("duplication"), debt_ratio.alias("debt"),
    )
    weighed = c("maintainability") * 0.3 + c("coverage") * 0.2 + (100 - F.least(F.lit(100.0), c("average_complexity") * 10)) * 0.25 + c("size_health") * 0.15 + c("nesting_health") * 0.1
    return scored.withColumn("health", _clamped(weighed))


def file_health(stats: DataFrame, rows: DataFrame) -> DataFrame:
    """Health of each file of ``stats`` by its function rows; files without functions are judged by their lines."""
    sums = rows.groupBy(F.col("path").alias("fpath")).agg(*_sums())
    c = F.col
    return _health(stats.join(sums, c("path") == c("fpath"), "left"), ["path"], scores.duplication_estimate(c("total_lines"), c("code_lines"), c("comment_lines"), c("doc_lines")))


def project_health(stats: DataFrame, rows: DataFrame) -> DataFrame:
    """Health of the whole project: one row."""
    totals = stats.agg(*(_zero(F.sum(x)).alias(x) for x in ("total_lines", "code_lines", "comment_lines", "doc_lines")))
    return _health(totals.crossJoin(F.broadcast(rows.agg(*_sums()))), [], scores.project_duplication(F.col("total_lines")))


def file_maintainability(stats: DataFrame, rows: DataFrame) -> DataFrame:
    """Maintainability index of each file; 100 without functions."""
    sums = rows.groupBy(F.col("path").alias("fpath")).agg(F.count(F.lit(1)).alias("n"), F.sum(function_score()).alias("points"))
    c = F.col
    penalty = F.when(c("total_lines") > 500, F.least(F.lit(25.0), (c("total_lines") - 500) / 100.0 * 0.5)).otherwise(0.0)
    index = F.when(c("n") > 0, F.greatest(F.lit(0.0), _clamped(c("points") / c("n")) - penalty)).otherwise(100.0)
    return stats.join(sums, c("path") == c("fpath"), "left").select("path", index.alias("maintainability"))


def project_maintainability(stats: DataFrame, rows: DataFrame) -> DataFrame:
    """Maintainability index of the project, from means over functions and shares of large files."""
    c = F.col
    means = rows.agg(F.count(F.lit(1)).alias("n"), *(_mean(x).alias(x) for x in ("line_count", "cyclomatic", "cognitive", "parameter_count")))
    many = lambda limit: F.count_if(c("total_lines") > limit) / F.greatest(F.count(F.lit(1)), F.lit(1))
    sizes = stats.agg((many(500) * 10 + many(1000) * 15 + many(2000) * 20).alias("penalty"))
    index = F.when(c("n") > 0, F.greatest(F.lit(0.0), _clamped(function_score()) - F.least(F.lit(35.0), c("penalty")))).otherwise(100.0)
    return means.crossJoin(F.broadcast(sizes)).select(index.alias("maintainability"))
