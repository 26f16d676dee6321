"""Library entry: ``analyze(spark, root or files, options) -> Report``.

A report's members are DataFrames, worked out when they are read.  The counted files are
persisted once, since every member starts from them; ``Report.release`` lets them go.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.operators import complexity, findings, reports, rollups, selection
from plumbline.plans import views
from plumbline.sources import tree


@dataclass(frozen=True)
class Options:
    """What to look at. ``reproducible`` leaves out nothing and depends on nothing outside of the tree."""

    extensions: tuple[str, ...] = ()
    hidden: bool = False
    gitignore: bool = True
    max_depth: int | None = None
    ignore: tuple[str, ...] = ()
    bounds: selection.Bounds = field(default_factory=selection.Bounds)

    def with_extensions(self, *extensions: str) -> Options:
        return replace(self, extensions=extensions)


@dataclass
class Report:
    spark: SparkSession
    files: DataFrame  # path, size, content, disposition
    options: Options

    @cached_property
    def stats(self) -> DataFrame:
        """Counted source files inside the bounds."""
        source = self.files.where(F.col("disposition") == paths.SOURCE).where(paths.has_extension(F.col("path"), list(self.options.extensions)))
        counted = views.stats_of(source).withColumn("key", paths.extension_key(F.col("path")))
        functions = self.functions if self.options.bounds.need_functions else None
        return selection.files_within(counted, self.options.bounds, functions).persist()

    @cached_property
    def analyzed(self) -> DataFrame:
        return complexity.analyze(self.files.where(F.col("disposition") == paths.SOURCE)).persist()

    @property
    def functions(self) -> DataFrame:
        return complexity.functions(self.analyzed)

    @property
    def structures(self) -> DataFrame:
        return complexity.structures(self.analyzed)

    @property
    def by_extension(self) -> DataFrame:
        return rollups.by_key(self.stats)

    @property
    def by_language(self) -> DataFrame:
        return rollups.by_language(self.stats, views.languages(self.spark))

    @property
    def totals(self) -> DataFrame:
        return rollups.totals(self.stats)

    @property
    def quality(self) -> DataFrame:
        return rollups.quality(self.stats)

    @property
    def health(self) -> DataFrame:
        return complexity.project_health(self.stats, self.functions)

    @property
    def skipped(self) -> DataFrame:
        return self.files.where(F.col("disposition") != paths.SOURCE).groupBy("disposition").agg(F.count(F.lit(1)).alias("files"))

    @property
    def findings(self) -> DataFrame:
        found = findings.file_findings(self.stats).unionByName(findings.project_findings(self.totals))
        return found.unionByName(findings.complexity_findings(self.stats, complexity.by_extension(self.functions))).unionByName(findings.health_findings(self.stats, self.health))

    def json(self) -> str:
        statistics = self.functions.agg(*complexity.statistics())
        return reports.json_report(self.totals, self.by_extension, rollups.ratios(self.totals), self.quality, statistics).first()["json"]

    def csv(self) -> str:
        return "\n".join([reports.CSV_HEADER, *(r["line"] for r in reports.csv_lines(self.by_extension).orderBy("key").collect())]) + "\n"

    def text(self) -> str:
        return reports.text_report(self.totals, self.quality, self.functions.agg(*complexity.statistics()))

    def html(self) -> str:
        return reports.html_report(self.totals, self.by_extension, self.quality)

    def sarif(self) -> DataFrame:
        return findings.sarif(self.findings)

    def release(self) -> None:
        for name in ("stats", "analyzed"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()


def list_files(spark: SparkSession, root: str, options: Options | None = None) -> DataFrame:
    """Paths that would be counted, in order, without reading any content but the heads of names without extension."""
    files = selection.dispositions(_tree(spark, root, options or Options(), content=False).select("path", "size", "mtime"))
    return files.where(F.col("disposition") == paths.SOURCE).select("path").orderBy(paths.sort_key(F.col("path")))


def _tree(spark: SparkSession, root: str, options: Options, content: bool = True) -> DataFrame:
    tree.register(spark)
    reader = spark.read.format("source_tree").option("hidden", options.hidden).option("gitignore", options.gitignore).option("ignore", ",".join(options.ignore)).option("content", content)
    if options.max_depth is not None:
        reader = reader.option("maxdepth", options.max_depth)
    return reader.load(root)


def analyze(spark: SparkSession, source: str | DataFrame, options: Options | None = None) -> Report:
    """Analyze a tree, or a table of files (path, content and optionally size)."""
    options = options or Options()
    files = _tree(spark, source, options) if isinstance(source, str) else source
    if "size" not in files.columns:
        files = files.withColumn("size", F.octet_length("content").cast("long"))
    head = files.withColumns({"content": F.col("content").cast("binary")})
    text = F.when(paths.extension(F.col("path")).isNull(), F.decode(F.substring("content", 1, 128), "ISO-8859-1"))
    told = head.withColumn("disposition", paths.disposition(F.col("path"), F.coalesce(text, F.lit(""))))
    return Report(spark, told.select("path", "size", "content", "disposition"), options)
