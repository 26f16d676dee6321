"""Filters on files and extensions, discovery joins, and the admission of unknown files."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths, scores
from plumbline.functions.tables import AMBIGUOUS_DIRS, CACHE_TAG, NO_EXTENSION


def parse_size(text: str) -> int | None:
    """``10KB``, ``1.5 MB``, ``2GB``, ``100B`` or plain bytes; None for anything else or below zero."""
    s = text.strip().upper()
    for suffix, unit in (("KB", 1024), ("MB", 1024**2), ("GB", 1024**3), ("B", 1)):
        if s.endswith(suffix):
            s, scale = s[: -len(suffix)].strip(), unit
            break
    else:
        scale = 1
    try:
        value = float(s)
    except ValueError:
        return None
    return None if math.isnan(value) or value < 0 or math.isinf(value) else int(value * scale)


def parse_languages(text: str) -> list[str]:
    return [x for x in (p.strip().lower() for p in text.split(",")) if x]


@dataclass(frozen=True)
class Bounds:
    """Optional limits; None means no limit, empty lists let all pass."""

    min_lines: int | None = None
    max_lines: int | None = None
    min_size: int | None = None
    max_size: int | None = None
    min_doc_ratio: float | None = None
    max_doc_ratio: float | None = None
    min_quality: float | None = None
    max_quality: float | None = None
    min_complexity: float | None = None
    max_complexity: float | None = None
    min_functions: int | None = None
    max_functions: int | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    @property
    def need_functions(self) -> bool:
        return any(x is not None for x in (self.min_complexity, self.max_complexity, self.min_functions, self.max_functions))

    @property
    def need_quality(self) -> bool:
        return self.min_quality is not None or self.max_quality is not None


SHORTCUTS = {"high_complexity": {"min_complexity": 10.0}, "low_quality": {"max_quality": 60.0}, "undocumented": {"max_doc_ratio": 0.1}}


def _between(value: Column, low, high) -> Column:
    keep = F.lit(True)
    if low is not None:
        keep = keep & (value >= low)
    return keep & (value <= high) if high is not None else keep


def _common(b: Bounds, ext: Column) -> Column:
    doc = scores.ratio(F.col("doc_lines"), F.col("total_lines"))
    keep = _between(F.col("total_lines"), b.min_lines, b.max_lines) & _between(F.col("file_size"), b.min_size, b.max_size) & _between(doc, b.min_doc_ratio, b.max_doc_ratio)
    if b.include:
        keep = keep & ext.isin(*(x.lower() for x in b.include))
    return keep & ~ext.isin(*(x.lower() for x in b.exclude)) if b.exclude else keep


def files_within(stats: DataFrame, b: Bounds, functions: DataFrame | None = None) -> DataFrame:
    """Files inside all bounds; complexity bounds read ``functions`` (path, cyclomatic), files without any count as zero."""
    kept = stats.where(_common(b, F.coalesce(F.lower(paths.extension(F.col("path"))), F.lit(NO_EXTENSION))))
    if b.need_quality:
        r = scores.ratios(*(F.col(c) for c in ("total_lines", "code_lines", "comment_lines", "doc_lines", "blank_lines")))
        overall = scores.overall(scores.documentation(r), scores.maintainability(r), scores.readability(r), F.lit(100.0))
        kept = kept.where(_between(overall, b.min_quality, b.max_quality))
    if b.need_functions:
        if functions is None:
            raise ValueError("complexity bounds need function rows")
        index = functions.groupBy(F.col("path").alias("fpath")).agg(F.max("cyclomatic").alias("top"), F.count(F.lit(1)).alias("n"))
        joined = kept.join(index, F.col("path") == F.col("fpath"), "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        kept = joined.where(_between(zero("top"), b.min_complexity, b.max_complexity) & _between(zero("n"), b.min_functions, b.max_functions)).drop("fpath", "top", "n")
    return kept


def keys_within(keyed: DataFrame, b: Bounds) -> DataFrame:
    """Extension rows inside the bounds, which here apply to the sums."""
    return keyed.where(_common(b, F.col("key")))


def retotal(keyed: DataFrame) -> DataFrame:
    """Sums over the rows left, with four unrounded ratios."""
    lines = ("total_lines", "code_lines", "comment_lines", "doc_lines", "blank_lines")
    whole = keyed.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", *lines, "file_size")))
    return whole.withColumns({f"{c[:-6]}_share": scores.ratio(F.col(c), F.col("total_lines")) for c in lines[1:]})


def dispositions(files: DataFrame) -> DataFrame:
    """Adds ``disposition`` to files (path, optionally content)."""
    content = F.col("content") if "content" in files.columns else None
    return files.withColumn("disposition", paths.disposition(F.col("path"), content))


def skip_counts(files: DataFrame) -> DataFrame:
    """Files per disposition."""
    return dispositions(files).groupBy("disposition").agg(F.count(F.lit(1)).alias("files"))


def normalized(path: Column, root: str) -> Column:
    """A detector's path below ``root``: the root, or its last name, cut off the front."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    leaf = root.rstrip("/").rsplit("/", 1)[-1]
    return F.regexp_replace(clean, "^(?:" + re.escape(root.rstrip("/")) + "|" + re.escape(leaf) + ")/", "")


def admitted(files: DataFrame, detected: DataFrame, root: str = ".") -> DataFrame:
    """Source files, and the unknown ones that the detector (path) lists; what was rejected stays rejected."""
    told = dispositions(files)
    listed = detected.select(normalized(F.col("path"), root).alias("listed")).distinct()
    source = told.where(F.col("disposition") == paths.SOURCE)
    return source.unionByName(told.where(F.col("disposition") == paths.UNKNOWN).join(listed, F.col("path") == F.col("listed"), "left_semi"))


def build_folders(entries: DataFrame) -> DataFrame:
    """``dir``: folders of ambiguous names that the listing ``entries`` (path) shows to be build output."""
    evidence = [(n, "beside", m) for n, beside, _ in AMBIGUOUS_DIRS for m in beside.split()]
    evidence += [(n, "within", m) for n, _, within in AMBIGUOUS_DIRS for m in (*within.split(), CACHE_TAG)]
    spark = entries.sparkSession
    rules = F.broadcast(spark.createDataFrame(evidence, "dir_name string, place string, marker string"))  # a fixed table
    names = sorted({n for n, _, _ in evidence})
    parts = F.split("path", "/")
    # Each entry shows every ambiguous folder it lies in.
    spots = F.filter(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.element_at(parts, k).isin(*names))
    folders = entries.where(F.size(parts) > 1).select(F.explode(spots).alias("k"), parts.alias("parts"))
    folders = folders.select(F.array_join(F.slice("parts", 1, F.col("k")), "/").alias("dir"), F.element_at("parts", F.col("k")).alias("dir_name")).distinct()
    parent = F.regexp_replace("dir", r"(^|/)[^/]+$", "")
    asked = folders.join(rules, "dir_name").withColumn("base", F.when(F.col("place") == "beside", parent).otherwise(F.col("dir")))
    asked = asked.withColumn("marker_dir", F.when(F.col("marker").contains("/"), F.concat_ws("/", "base", F.regexp_replace("marker", "/[^/]+$", ""))).otherwise(F.col("base")))
    asked = asked.withColumn("marker_name", F.regexp_replace("marker", "^.*/", ""))
    seen = entries.select(F.regexp_replace("path", r"(^|/)[^/]+$", "").alias("in_dir"), F.element_at(parts, -1).alias("name"))
    wild = F.concat(F.lit("*."), F.lower(F.regexp_extract("name", r"^.+\.([^.]+)$", 1)))
    offered = seen.select("in_dir", F.explode(F.array(F.col("name"), wild)).alias("offer")).distinct()
    return asked.join(offered, (F.col("marker_dir") == F.col("in_dir")) & (F.col("marker_name") == F.col("offer")), "left_semi").select("dir").distinct()


def outside_build(entries: DataFrame) -> DataFrame:
    """The entries that lie in no corroborated build folder."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    inside = entries.select("path", F.explode(ups).alias("up")).join(build_folders(entries), F.col("up") == F.col("dir"), "left_semi").select(F.col("path").alias("inner"))
    return entries.join(inside.distinct(), F.col("path") == F.col("inner"), "left_anti")
